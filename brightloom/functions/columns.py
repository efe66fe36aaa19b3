"""Column functions: identity hashes, token estimates, paths, JSON guards, provenance."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Provenance by rank; the least of a sum's parts is the sum's own.
PROVENANCE = ("UNAVAILABLE", "UNKNOWN", "ESTIMATED", "EXACT")
#: Language by file suffix.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "md": "markdown", "json": "json", "sql": "sql", "html": "html", "css": "css"}
SECRET = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\s*[:=]|akia[0-9a-z]{12,}"


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is costly and used more than once, also in other lambdas: it is computed once a row."""
    return F.transform(F.array(value), made)[0]


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def list_fingerprint(*items: Column) -> Column:
    """SHA-256 over items, each after its length in bytes as 8 big-endian bytes; so ("ab", "c") and ("a", "bc") differ."""
    parts = [x for i in items for x in (F.unhex(F.lpad(F.hex(F.octet_length(i).cast("long")), 16, "0")), F.encode(i, "UTF-8"))]
    return F.sha2(F.concat(*parts), 256)


def git_blob_sha1(content: Column) -> Column:
    """The id that git gives the bytes as a blob."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content.cast("binary")))


def token_estimate(text: Column) -> Column:
    """A token for every four bytes of UTF-8, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def basename(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def newline_normalise(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


#: Fixed value: the pieces of an identifier: an acronym before a capitalised piece, a digit or the end; a piece with or without a capital; digits.
PIECES = r"[A-Z]+(?=[A-Z][a-z]|\d|$)|[A-Z]?[a-z]+|\d+"


def identifier_tokens(text: Column) -> Column:
    """Lower-case pieces of identifiers: runs of letters and digits, cut at humps, acronyms and digits; a run without an ASCII piece stays whole."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)[^\W_]+"), F.lit(0))
    pieces = lambda w: F.regexp_extract_all(w, F.lit(PIECES), F.lit(0))
    cut = F.transform(runs, lambda w: F.struct(w.alias("w"), pieces(w).alias("p")))
    found = F.flatten(F.transform(cut, lambda x: F.when(F.size(x["p"]) > 0, x["p"]).otherwise(F.array(x["w"]))))
    return F.transform(found, lambda w: F.replace(F.lower(w), F.lit("ß"), F.lit("ss")))


def search_text(text: Column) -> Column:
    return F.concat(text, F.lit("\n"), F.array_join(identifier_tokens(text), " "))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def file_language(path: Column) -> Column:
    """Language by the suffix of the path's last segment; null if none is known."""
    suffix = F.lower(F.regexp_extract(basename(path), r"\.([A-Za-z0-9]+)$", 1))
    return reduce(lambda c, kv: c.when(suffix == kv[0], kv[1]), LANGUAGES.items(), F.when(F.lit(False), ""))


def has_secret(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(SECRET)), F.lit(False))


def json_number(payload: Column, key: str) -> Column:
    """A JSON number as a double; null for anything else, also for true, false and numbers in quotes."""
    raw = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    kind = F.schema_of_variant(raw)
    return F.when(F.rlike(kind, F.lit("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")), F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "double"))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, held to 0..1; null where the whole is missing or 0."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / F.nullif(whole, F.lit(0)))), digits)


def provenance_rank(name: Column) -> Column:
    return F.greatest(F.lit(0), F.array_position(F.array(*map(F.lit, PROVENANCE)), F.coalesce(name, F.lit(""))) - 1).cast("int")


def provenance_name(rank: Column) -> Column:
    """The name of a rank; UNAVAILABLE for null, since what is missing is never a zero."""
    return F.element_at(F.array(*map(F.lit, PROVENANCE)), F.coalesce(rank, F.lit(0)).cast("int") + 1)


def snippet(text: Column, tokens: Column, width: int = 640) -> Column:
    """The text if it fits, else a window of `width` characters, a third of it before the first place of any token, with ... where text is cut off.

    Near the end the window is moved back, so it is always full. Without a token it is the beginning.
    """
    at = F.array_min(F.filter(F.transform(tokens, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.least(F.coalesce(at, F.lit(1)) - width // 3, F.length(text) - width + 1))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, F.lit(width)), F.when(start + width - 1 < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= width, text).otherwise(cut)


def cosine_distance(vector: Column, query: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 - dot(vector, query) / F.nullif(F.sqrt(dot(vector, vector) * dot(query, query)), F.lit(0.0))


def variant_number(payload: Column, key: str) -> Column:
    """A number of a parsed payload as a double; null for anything else, also for true, false and numbers in quotes."""
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{key}", "variant"))
    return F.when(F.rlike(kind, F.lit("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")), F.try_variant_get(payload, f"$.{key}", "double"))


def variant_integer(payload: Column, key: str) -> Column:
    """A whole number of a parsed payload as a long; null for anything else, also for 1.0 and true."""
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{key}", "variant"))
    return F.when(kind == "BIGINT", F.try_variant_get(payload, f"$.{key}", "bigint"))


def variant_flag(payload: Column, key: str) -> Column:
    """true or false of a parsed payload; null for anything else, also for 1 and "true"."""
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{key}", "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(payload, f"$.{key}", "boolean"))


def variant_string(payload: Column, key: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{key}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(payload, f"$.{key}", "string"))


#: Other names of EXACT in payloads.
EXACT_NAMES = ("PROVIDER_FINAL", "RECONCILED", "FINAL")


def named_provenance(name: Column) -> Column:
    """A provenance as payloads write it; null for an unknown name."""
    name = F.upper(name)
    return F.when(name.isin(*EXACT_NAMES), "EXACT").when(name.isin(*PROVENANCE), name)


def payload_provenance(payload: Column) -> Column:
    """How sure a payload's values are if nothing is said of a single one: the first name known among its fields, then its flags, UNKNOWN otherwise."""
    fields = [named_provenance(variant_string(payload, f)) for f in ("metric_provenance", "token_provenance", "usage_provenance")]
    said = lambda k: F.coalesce(variant_flag(payload, k), F.lit(False))
    flags = F.when(said("provider_final_usage") | said("usage_reconciled"), "EXACT").when(said("estimated") | said("tokens_estimated"), "ESTIMATED").otherwise("UNKNOWN")
    return F.coalesce(*fields, flags)
