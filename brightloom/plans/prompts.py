"""Queries of prompts in two parts and of their proofs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import sha256_text
from ..operators import prompts as P
from .registry import query, table


def requests(spark, sf_dir):
    """A conversation turn is a request: its project by conversation, its role is stable, its text and number are dynamic; some are faulty."""
    c, i = table(spark, sf_dir, "conversations"), F.col("turn")
    quoted = lambda x: P.quoted(F.coalesce(x, F.lit("")))
    stable = F.concat(F.lit('{ "role": '), quoted(F.col("role")), F.lit(', "policy": {"b": 1, "a": [1, 2]'), F.when(i % 11 == 3, ', "Run-Id": 7').otherwise(""), F.lit("} }"))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), (F.col("conv_id") % 5).alias("project_id"), F.when(i % 2 == 0, "FULL").otherwise("DELTA").alias("delivery_mode"), F.when(i % 11 == 4, F.lit("[1]")).otherwise(stable).alias("stable"),
        F.concat(F.lit('{"turn":'), i.cast("string"), F.lit(',"text":'), quoted(F.col("text")), F.lit("}")).alias("dynamic"), F.when(i % 11 == 5, "none").otherwise(sha256_text(F.coalesce("text", F.lit("")))).alias("context_output_fingerprint"),
        F.lit("cap").alias("capability_identity"), F.lit("m").alias("model"), F.lit("1").alias("model_revision"), F.lit("Answer.").alias("instruction"),
    )


_PROMPT = """c AS (SELECT conv_id || '-' || turn AS request_id, turn AS i, conv_id % 5 AS p, role, coalesce(text, '') AS t FROM conversations),
    r AS (SELECT request_id, CASE i % 11 WHEN 3 THEN 'stable_material_contains_nonmaterial_identity' WHEN 4 THEN 'material_invalid' WHEN 5 THEN 'context_output_fingerprint_invalid' END AS error,
        '{"name":"envelope_version","segment":"stable","value":"provider-prompt-envelope-v1"}' || chr(10) || '{"name":"canonical_input_version","segment":"stable","value":"provider-canonical-input-v1"}' || chr(10) || '{"name":"stable_prefix_policy_version","segment":"stable","value":"stable-prompt-prefix-v1"}'
        || chr(10) || '{"name":"project_id","segment":"stable","value":"' || p || '"}' || chr(10) || '{"name":"capability_identity","segment":"stable","value":"cap"}' || chr(10) || '{"name":"model","segment":"stable","value":"m"}' || chr(10) || '{"name":"model_revision","segment":"stable","value":"1"}'
        || chr(10) || '{"name":"stable_instruction","segment":"stable","value":"Answer."}' || chr(10) || '{"name":"stable_material","segment":"stable","value":{"policy":{"a":[1,2],"b":1},"role":' || to_json(coalesce(role, ''))::VARCHAR || '}}' AS prefix,
        '{"name":"delivery_mode","segment":"dynamic","value":"' || CASE WHEN i % 2 = 0 THEN 'FULL' ELSE 'DELTA' END || '"}' || chr(10) || '{"name":"context_output_fingerprint","segment":"dynamic","value":"' || sha256(t) || '"}'
        || chr(10) || '{"name":"dynamic_material","segment":"dynamic","value":{"text":' || to_json(t)::VARCHAR || ',"turn":' || i || '}}' AS suffix FROM c)"""


@query(f"WITH {_PROMPT} SELECT request_id, CASE WHEN error IS NULL THEN sha256(prefix) END AS prefix_fingerprint, CASE WHEN error IS NULL THEN sha256(prefix || chr(10) || suffix) END AS whole_fingerprint, CASE WHEN error IS NULL THEN strlen(prefix)::BIGINT END AS prefix_bytes, error IS NULL AS verified, error FROM r")
def prompt_envelopes(spark, sf_dir):
    return P.envelopes(requests(spark, sf_dir)).select("request_id", "prefix_fingerprint", "whole_fingerprint", "prefix_bytes", "verified", "error")


@query("SELECT conv_id || '-' || turn AS request_id, turn % 11 NOT IN (3, 4, 5) AND turn % 7 > 1 AS intact FROM conversations")
def prompt_tampering(spark, sf_dir):
    made = P.envelopes(requests(spark, sf_dir))
    n = F.split_part("request_id", F.lit("-"), F.lit(2)).cast("int") % 7
    return P.untampered(made.withColumn("suffix", F.when(n == 0, F.concat("suffix", F.lit(" "))).otherwise(F.col("suffix"))).withColumn("prefix", F.when(n == 1, F.replace("prefix", F.lit("Answer."), F.lit("Answer!"))).otherwise(F.col("prefix"))))
