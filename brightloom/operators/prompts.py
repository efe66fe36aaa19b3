"""Prompts in two parts: a stable prefix that a provider can cache, and a dynamic suffix; with the proof that both together are the whole."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sha256_text, token_estimate
from ..session import ship

#: Versions that a prompt names, the bounds of its parts, and keys that may not be anywhere in what is stable.
VERSIONS = {"envelope_version": "provider-prompt-envelope-v1", "canonical_input_version": "provider-canonical-input-v1", "stable_prefix_policy_version": "stable-prompt-prefix-v1"}
INSTRUCTION_CHARS, SEGMENT_CHARS = 16_000, 2_000_000
NON_MATERIAL = {"api_key", "apikey", "authorization", "cache_hit", "counter", "credential", "credentials", "nonce", "process_id", "request_id", "run_id", "secret", "timestamp", "token_count", "ttl", "usage"}
#: The elements of a prompt in their order, by part.
STABLE = (*VERSIONS, "project_id", "capability_identity", "model", "model_revision", "stable_instruction", "stable_material")
DYNAMIC = ("delivery_mode", "context_output_fingerprint", "dynamic_material")
NON_MATERIAL_FOUND, TOO_LARGE, BAD_FINGERPRINT, BAD_SEGMENT, MISMATCH, BAD_MATERIAL = "stable_material_contains_nonmaterial_identity", "stable_instruction_too_large", "context_output_fingerprint_invalid", "segment_invalid", "semantic_composition_mismatch", "material_invalid"


def canonical(text: str | None) -> str | None:
    """A JSON object with sorted keys and no spaces; None for what is none."""
    try:
        value = json.loads(text or "")
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None


def is_material(text: str | None) -> bool:
    """Whether no key at any depth of a JSON object is one of what varies without meaning, in either case and with dashes or underscores."""
    todo = [json.loads(text)] if text else []
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            if any(k.strip().casefold().replace("-", "_") in NON_MATERIAL for k in value):
                return False
            todo += value.values()
        elif isinstance(value, list):
            todo += value
    return True


def _record(name: str, value: Column, part: str) -> Column:
    """One element as JSON with sorted keys; its value is JSON already."""
    return F.concat(F.lit(f'{{"name":"{name}","segment":"{part}","value":'), value, F.lit("}"))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def envelopes(requests: DataFrame) -> DataFrame:
    """requests with prefix, suffix, their fingerprints and sizes, `verified` and `error`.

    requests: project_id, delivery_mode, stable, dynamic (JSON objects as text), context_output_fingerprint, capability_identity, model, model_revision,
    instruction. The whole is every element in its order, a line each; prefix and suffix are taken from it by their part, and `verified` says that joined
    again they are the whole, byte for byte. A request with a fault has an error and neither part: material that is no JSON object, a key in the stable part that
    means nothing, an instruction or a part out of bounds, no fingerprint. Equal stable elements give equal prefixes whatever is dynamic. Null texts are empty.
    """
    ship(requests.sparkSession)
    clean = F.pandas_udf(lambda s: s.map(canonical, na_action=None), "string")
    fine = F.pandas_udf(lambda s: pd.Series([is_material(x) for x in s], dtype="bool"), "boolean")
    r = requests.withColumn("_stable", clean(F.col("stable"))).withColumn("_dynamic", clean(F.col("dynamic"))).withColumn("_material", fine(F.col("_stable")))
    text = lambda c: quoted(F.coalesce(F.col(c).cast("string"), F.lit("")))
    values = {k: quoted(F.lit(v)) for k, v in VERSIONS.items()} | {"stable_instruction": text("instruction"), "stable_material": F.col("_stable"), "dynamic_material": F.col("_dynamic")}
    part = lambda names, which: [_record(n, values[n] if n in values else text(n), which) for n in names]
    stable, dynamic = part(STABLE, "stable"), part(DYNAMIC, "dynamic")
    r = r.withColumn("_whole", F.array_join(F.array(*stable, *dynamic), "\n")).withColumn("prefix", F.array_join(F.array(*stable), "\n")).withColumn("suffix", F.array_join(F.array(*dynamic), "\n"))
    sized = lambda c: F.length(c).between(1, SEGMENT_CHARS)
    same = F.col("_whole") == F.concat_ws("\n", "prefix", "suffix")
    error = F.when(F.col("_stable").isNull() | F.col("_dynamic").isNull(), BAD_MATERIAL).when(~F.col("_material"), NON_MATERIAL_FOUND).when(F.length(F.coalesce("instruction", F.lit(""))) > INSTRUCTION_CHARS, TOO_LARGE)
    error = error.when(~F.coalesce(F.rlike("context_output_fingerprint", F.lit("^[0-9a-f]{64}$")), F.lit(False)), BAD_FINGERPRINT).when(~sized("prefix") | ~sized("suffix"), BAD_SEGMENT).when(~same, MISMATCH)
    r = r.withColumn("error", error)
    shown = lambda c: F.when(F.col("error").isNull(), c)
    return r.select(
        *requests.columns, shown(F.col("prefix")).alias("prefix"), shown(F.col("suffix")).alias("suffix"), shown(sha256_text(F.col("prefix"))).alias("prefix_fingerprint"), shown(sha256_text(F.col("_whole"))).alias("whole_fingerprint"),
        shown(F.octet_length("prefix").cast("long")).alias("prefix_bytes"), shown(token_estimate(F.col("prefix"))).alias("prefix_tokens"), shown(token_estimate(F.col("_whole"))).alias("tokens"), (F.col("error").isNull() & same).alias("verified"), "error",
    )


def untampered(stored: DataFrame) -> DataFrame:
    """Stored envelopes with `intact`: whether prefix and suffix are still what the fingerprints were taken of, and what the request itself gives."""
    made = envelopes(stored.select("project_id", "delivery_mode", "stable", "dynamic", "context_output_fingerprint", "capability_identity", "model", "model_revision", "instruction", F.col("prefix").alias("_p"), F.col("suffix").alias("_s"), F.col("prefix_fingerprint").alias("_pf"), F.col("whole_fingerprint").alias("_wf"), *[F.col(c).alias(f"_id_{c}") for c in stored.columns if c == "request_id"]))
    own = (sha256_text(F.col("_p")) == F.col("_pf")) & (sha256_text(F.concat_ws("\n", "_p", "_s")) == F.col("_wf")) & (F.col("prefix") == F.col("_p")) & (F.col("suffix") == F.col("_s"))
    return made.select(*[F.col(c).alias(c.removeprefix("_id_")) for c in made.columns if c.startswith("_id_")], F.coalesce(own, F.lit(False)).alias("intact"))
