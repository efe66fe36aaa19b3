import math

import pytest

from brightloom.operators import inference as I

PROFILE = I.Profile("p", "m", "1", 2)


def provider(kind=None, at=None):
    """Answers [length, first letter]; a batch that has the text `at` is answered wrongly in the given way."""

    class Answers:
        def embed(self, texts):
            found = [(i, [float(len(t)), float(ord(t[0])) if t else 0.0]) for i, t in enumerate(texts)][::-1]
            if at in texts:
                if kind == "raise":
                    raise TimeoutError
                found = {"count": found[1:], "index": [(0, v) for _, v in found], "nan": [(i, [math.nan, 1.0]) for i, _ in found], "long": [(i, [*v, 1.0]) for i, v in found], "flag": [(i, [True, 1.0]) for i, _ in found]}[kind]
            return found

    return Answers()


def chunks(spark, texts):
    return spark.createDataFrame([(f"c{i}", t, f"h-{t}") for i, t in texts], "chunk_id string, content string, content_sha256 string").coalesce(1)


@pytest.mark.parametrize(("kind", "error"), [("raise", I.REQUEST_FAILED), ("count", I.WRONG_COUNT), ("index", I.WRONG_INDEX), ("nan", I.WRONG_VECTOR), ("long", I.WRONG_VECTOR), ("flag", I.WRONG_VECTOR)])
def test_a_bad_batch_leaves_the_others_stored(spark, tmp_path, kind, error):
    path, texts = str(tmp_path / "semantic"), [(i, f"{i:02}") for i in range(20)]
    a = I.sync(spark, path, chunks(spark, texts), provider(kind, "07"), PROFILE, "r1", batch=4)
    assert (a["status"], a["error"], a["failed_batches"]) == ("FAILED", error, 1) and a["new"] == a["current"] == 16
    b = I.sync(spark, path, chunks(spark, texts), provider(), PROFILE, "r2", batch=4)
    assert (b["status"], b["new"], b["reused"], b["requests"]) == ("COMPLETED", 4, 16, 1)
    c = I.sync(spark, path, chunks(spark, texts), provider("raise", "07"), PROFILE, "r3", batch=4)
    assert (c["status"], c["new"], c["requests"]) == ("COMPLETED", 0, 0)
    got = {r.chunk_id: list(r.embedding) for r in I.vectors(spark, path, PROFILE).collect()}
    assert got == {f"c{i}": [2.0, float(ord(t[0]))] for i, t in texts}
    assert {r.run_id: r.status for r in I.runs(spark, path).collect()} == {"r1": "FAILED", "r2": "COMPLETED", "r3": "COMPLETED"}


def test_contents_are_sent_once_and_profiles_apart(spark, tmp_path):
    path = str(tmp_path / "semantic")
    assert I.vectors(spark, path).count() == 0 and I.runs(spark, path).count() == 0
    rows = chunks(spark, [(1, "same"), (2, "same"), (2, "same"), (3, ""), (4, None)])
    a = I.sync(spark, path, rows, provider(), PROFILE, "r1", batch=100)
    assert (a["current"], a["new"], a["requests"]) == (3, 3, 1)
    other = PROFILE._replace(revision="2")
    assert I.sync(spark, path, rows, provider(), other, "r2")["new"] == 3
    assert I.vectors(spark, path).count() == 6 and I.vectors(spark, path, other).count() == 3
    assert I.sync(spark, path, rows.limit(0), provider(), PROFILE, "r3")["status"] == "COMPLETED"
