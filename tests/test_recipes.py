import numpy as np

from tessera.operators import simulate as S
from tessera.plans import recipes


def test_listings(spark):
    lines = spark.createDataFrame([(0, "450 3 Beds, 2.5 baths (big)!"), (1, "12,000 13"), (2, ""), (3, "n/a It's NR"), (4, "x Quiet street.")], "line_no long, value string")
    got = {r["doc_id"]: (r["y"], r["text"]) for r in recipes.listings(lines).collect()}
    assert set(got) == {0, 4} and got[0][0] == 450 and "beds , 2.5 baths ( big ) !" in got[0][1] and got[4] == (None, "quiet street . ")


def test_sweeps(spark):
    docs = S.corpus(spark, 60, np.ones(2), S.topics(2, 60, 0.2, 1), np.array([1.0, 4.0]), 40).selectExpr("doc_id", "abs(y) + 1 as y", "text")
    got = recipes.lsa_sweep(docs, "wb", 2, 3).collect()
    assert [r["adjustment"] for r in got] == ["w", "b"] and all(0 <= r["r2"] <= 1 and 1 <= r["best"] <= 8 for r in got)
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(k, float(x[0] + rng.normal()), x.tolist()) for k, x in enumerate(rng.standard_normal((80, 3)))], "doc_id long, y double, x array<double>")
    sizes = recipes.validated_sizes(rows, [0, 1], 3, 4).collect()
    assert len(sizes) == 4 + 3 and sum(r["best"] for r in sizes) == 2


def test_taggers(spark):
    pairs = [("the", "D"), ("big", "A"), ("house", "N"), ("is", "V"), ("red", "A")] * 40
    tagged = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate(pairs)], "seq long, type string, pos string")
    out = recipes.held_out_tagger(tagged, 150, projections=4, clusters=5)
    assert out["score"].first()["n"] == 150 and out["validation_score"].first()["n"] == 50
    sweep = recipes.tagger_sweep(tagged, [{"projections": 4, "clusters": 5}, {"projections": 4, "clusters": 2, "scale_data": True}]).collect()
    assert len(sweep) == 2 and sweep[0]["accuracy"] == 1
