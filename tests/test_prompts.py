import hashlib
import json

from brightloom.operators import prompts as P

ROW = "request_id string, project_id long, delivery_mode string, stable string, dynamic string, context_output_fingerprint string, capability_identity string, model string, model_revision string, instruction string"


def row(i, stable='{"b": [1, {"a": "é"}]}', dynamic="{}", fingerprint="f" * 64, instruction="do"):
    return (str(i), 1, "FULL", stable, dynamic, fingerprint, "cap", "m", "r", instruction)


def plain(r):
    """The whole prompt, line by line."""
    said = dict(P.VERSIONS, project_id="1", capability_identity="cap", model="m", model_revision="r", stable_instruction=r[9] or "", stable_material=json.loads(r[3]), delivery_mode="FULL", context_output_fingerprint=r[5], dynamic_material=json.loads(r[4]))
    line = lambda n, part: json.dumps({"name": n, "value": said[n], "segment": part}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return "\n".join([line(n, "stable") for n in P.STABLE]), "\n".join([line(n, "dynamic") for n in P.DYNAMIC])


def test_envelopes_are_the_plain_ones(spark):
    good = [row(0), row(1, dynamic='{"q": "a\\"b\\n/\\u2028 ü", "n": 1.50}'), row(2, stable="{}", instruction=None), row(3, stable='{"tokens": {"run": 1}}', instruction='say "x"\n\\')]
    bad = {
        10: (row(10, stable='{"a": [{"Run-ID ": 1}]}'), P.NON_MATERIAL_FOUND), 11: (row(11, stable="[]"), P.BAD_MATERIAL), 12: (row(12, dynamic=None), P.BAD_MATERIAL), 13: (row(13, fingerprint="F" * 64), P.BAD_FINGERPRINT),
        14: (row(14, fingerprint=None), P.BAD_FINGERPRINT), 15: (row(15, instruction="x" * 16_001), P.TOO_LARGE), 16: (row(16, dynamic=json.dumps({"x": "y" * 2_000_000})), P.BAD_SEGMENT), 17: (row(17, stable='{"ttl": 1}'), P.NON_MATERIAL_FOUND),
    }
    made = P.envelopes(spark.createDataFrame(good + [b for b, _ in bad.values()], ROW))
    got = {int(r.request_id): r for r in made.collect()}
    for r in good:
        prefix, suffix = plain(r)
        g = got[int(r[0])]
        assert (g.prefix, g.suffix, g.error, g.verified) == (prefix, suffix, None, True)
        assert g.whole_fingerprint == hashlib.sha256(f"{prefix}\n{suffix}".encode()).hexdigest() and g.tokens == -(-len(f"{prefix}\n{suffix}".encode()) // 4)
    assert got[0].prefix_fingerprint == got[1].prefix_fingerprint != got[2].prefix_fingerprint
    assert {i: got[i].error for i in bad} == {i: e for i, (_, e) in bad.items()} and not any(got[i].verified or got[i].prefix for i in bad)
    assert all(r.intact == (int(r.request_id) < 10) for r in P.untampered(made).collect())
