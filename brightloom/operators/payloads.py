"""Payloads and tool arguments checked before they are kept, texts compared line by line, languages of a project's files."""

from __future__ import annotations

import difflib
import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import PATH, SECRET, marks, names_secret, readings, redacted
from ..session import ship

#: The bounds of a payload, of an encoded answer and of a diff.
DEPTH, ITEMS, KEY_CHARS, STRING_CHARS, PAYLOAD_BYTES, INTEGER, DIFF_CHARS = 6, 100, 128, 1024, 65536, 2**53, 16000
#: Languages in the order of a stack, with the file names and endings that show them.
LANGUAGES = {
    "python": r"^(pyproject\.toml|requirements\.txt|setup\.py|poetry\.lock)$|\.py$",
    "typescript": r"^tsconfig\.json$|\.tsx?$",
    "javascript": r"^(package\.json|package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$",
    "rust": r"^cargo\.toml$|\.rs$",
    "go": r"^go\.mod$|\.go$",
    "java": r"^(pom\.xml|build\.gradle|build\.gradle\.kts)$|\.java$",
    "csharp": r"\.(csproj|sln|cs)$",
    "ruby": r"^gemfile$|\.rb$",
    "php": r"^composer\.json$|\.php$",
    "docker": r"^dockerfile($|\.)",
}


def string_fault(text: str) -> str | None:
    if not text or len(text) > STRING_CHARS or re.search(r"[\x00-\x1f]", text):
        return "string"
    for form in readings(text):
        kinds = {kind for _, _, kind in marks(form)}
        if SECRET in kinds:
            return "secret_value"
        if PATH in kinds or form.strip() == "/":
            return "path"
    return None


def fault(payload: str | None) -> str | None:
    """Why a payload is refused, by the first fault in its order; None if it may be kept."""
    try:
        root = json.loads(payload or "")
    except (ValueError, RecursionError):
        return "not_json"
    if not isinstance(root, dict):
        return "not_object"
    todo = [(root, 0)]
    while todo:
        value, depth = todo.pop()
        found = None
        if depth > DEPTH:
            found = "depth"
        elif isinstance(value, str):
            found = string_fault(value)
        elif isinstance(value, (dict, list)):
            if len(value) > ITEMS:
                found = "items"
            elif isinstance(value, dict):
                wrong = (("key" if not 0 < len(k) <= KEY_CHARS else string_fault(k)) or ("secret_key" if names_secret(k) else None) for k in value)
                found = next(filter(None, wrong), None)
            todo += [(v, depth + 1) for v in reversed(value.values() if isinstance(value, dict) else value)]
        elif isinstance(value, float) and not math.isfinite(value):
            found = "number"
        elif isinstance(value, int) and not isinstance(value, bool) and abs(value) > INTEGER:
            found = "integer"
        if found:
            return found
    size = len(json.dumps(root, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "surrogatepass"))
    return "bytes" if size > PAYLOAD_BYTES else None


def payload_fault(spark: SparkSession, payload: Column) -> Column:
    """Why a payload (JSON text) is refused: not_json, not_object, depth, items, key, secret_key, secret_value, path, string, number, integer or
    bytes; null if it may be kept. A missing payload is not_json. JSON nests, which column functions do not follow, so a pandas UDF walks it."""
    ship(spark)
    return F.pandas_udf(lambda p: p.map(fault, na_action=None), "string")(payload)


def argument_fault(args: Column, required: tuple[str, ...], integers: dict[str, tuple[int, int]], optional: tuple[str, ...] = ()) -> Column:
    """Why arguments (a JSON object as text) do not fit: not_object, unknown_key, missing_key, not_integer, bound; null if they do.

    integers: least and most by key; true and false are no integers, nor is 1.0."""
    keys, parsed = F.json_object_keys(args), F.try_parse_json(args)
    named = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    found = F.when(keys.isNull() | parsed.isNull(), "not_object").when(F.size(F.array_except(keys, named((*required, *optional)))) > 0, "unknown_key")
    found = found.when(F.size(F.array_except(named(required), keys)) > 0, "missing_key")
    for key in integers:
        part = F.try_variant_get(parsed, f"$.{key}", "variant")
        found = found.when(F.array_contains(keys, key) & (F.coalesce(F.schema_of_variant(part), F.lit("VOID")) != "BIGINT"), "not_integer")
    for key, (least, most) in integers.items():
        found = found.when(~F.try_variant_get(parsed, f"$.{key}", "bigint").between(least, most), "bound")
    return found


def bounded_answer(answer: Column) -> Column:
    """An encoded answer if it is within the byte bound and shows neither a secret nor an absolute path, else null."""
    return F.when((F.octet_length(answer) <= PAYLOAD_BYTES) & (redacted(answer) == answer), answer)


def unified_diff(spark: SparkSession, path: Column, before: Column, after: Column) -> Column:
    """struct(text, binary, truncated): the redacted unified diff of two texts, cut at its bound; missing sides are empty.

    A text with a NUL is binary. Header and hunk lines have no line ends of their own, so equal texts give an empty diff."""
    ship(spark)

    @F.pandas_udf("string")
    def lines(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        rows = zip(p, a.fillna(""), b.fillna(""))
        return pd.Series(["".join(difflib.unified_diff(x.splitlines(True), y.splitlines(True), f"a/{q}", f"b/{q}", lineterm="")) for q, x, y in rows], dtype=object)

    nul = F.lit("\u0000")
    binary = F.coalesce(F.contains(before, nul), F.lit(False)) | F.coalesce(F.contains(after, nul), F.lit(False))
    text = F.when(binary, "[binary diff omitted]").otherwise(redacted(lines(path, F.when(~binary, before), F.when(~binary, after))))
    long = F.length(text) > DIFF_CHARS
    shown = F.when(long, F.concat(F.left(text, F.lit(DIFF_CHARS)), F.lit("\n[diff truncated]"))).otherwise(text)
    return F.struct(shown.alias("text"), binary.alias("binary"), long.alias("truncated"))


def language_of(name: Column) -> Column:
    """The language that a file's name shows, null if none."""
    return F.coalesce(*[F.when(F.rlike(F.lower(name), F.lit(p)), k) for k, p in LANGUAGES.items()])


def language_stacks(files: DataFrame, group: str, name: str = "name") -> DataFrame:
    """(group, languages): the languages of a group's files in the order of a stack; the sets that are shuffled hold ten values at most."""
    seen = files.groupBy(group).agg(F.collect_set(language_of(F.col(name))).alias("_s"))
    return seen.select(group, F.filter(F.array(*map(F.lit, LANGUAGES)), lambda x: F.array_contains("_s", x)).alias("languages"))
