import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster as C
from tessera.operators import dictionary as D
from tessera.operators import evaluate as E
from tessera.operators import linalg as L
from tessera.operators import regression as R
from tessera.operators import simulate as S
from tessera.operators import tagged as G
from tessera.plans import programs as P


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4))
    y = x @ [1, 2, 0, -1] + rng.standard_normal(300)
    return x, y, spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(300)], "doc_id long, y double, x array<double>")


def test_randomized_svd(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((40, 4)) @ np.diag([9, 6, 4, 2]) @ rng.standard_normal((4, 20))
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(40) for j in range(20)], "i long, j long, v double")
    u, d, v = L.randomized_svd(cells, 4, 1, 1)
    assert np.allclose(d, np.linalg.svd(a)[1][:4])
    um = np.array([r["x"] for r in u.orderBy("i").collect()])
    vm = np.array([r["x"] for r in v.orderBy("i").collect()])
    assert np.allclose(um @ np.diag(d) @ vm.T, a) and np.allclose(um.T @ um, np.eye(4))
    left, top, right = L.rank_one(cells, 100, 1e-9)
    assert abs(top - d[0]) < 1e-3


def test_regression_against_numpy(design):
    x, y, rows = design
    want = np.linalg.lstsq(np.c_[np.ones(300), x], y, rcond=None)[0]
    assert np.allclose([r["coefficient"] for r in R.ols(rows, list("abcd"))], want)
    steps = R.sequence(R.design_gram(rows, 4), list("abcd"))
    fit = np.c_[np.ones(300), x] @ want
    assert abs(steps[-1].rss - ((y - fit) ** 2).sum()) < 1e-6
    picked = [s["name"] for s in R.stepwise(R.design_gram(rows, 4), list("abcd"))]
    assert picked[0] == "b" and sorted(picked) == ["a", "b", "d"]


def test_cross_validation_against_numpy(design):
    x, y, rows = design
    out = R.validated_sequence(rows, [], list("abcd"), 3, 0)
    fold, ss = np.arange(300) % 3, 0.0
    for f in range(3):
        a = np.c_[np.ones(300), x]
        beta = np.linalg.lstsq(a[fold != f], y[fold != f], rcond=None)[0]
        ss += ((y - a @ beta)[fold == f] ** 2).sum()
    assert abs(out[-1]["cvss"] - ss) < 1e-6 and len(out) == 5


def test_singular_column_is_skipped(spark):
    rows = spark.createDataFrame([(i, float(i), [float(i % 3), 2.0 * (i % 3)]) for i in range(30)], "doc_id long, y double, x array<double>")
    assert [s.added for s in R.sequence(R.design_gram(rows, 2), ["a", "b"], [0, 0])] == [True, False]


def test_kmeans_finds_shifted_groups(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, (np.array([i % 4 * 3.0] * 3) + rng.normal(0, 0.05, 3)).tolist()) for i in range(80)], "id long, x array<double>")
    got = C.fit(rows, 4).assign(rows)
    assert all(r["cluster"] == r["id"] % 4 for r in got.collect())
    assert C.cluster_members(got, 2).where("cluster = 1").first()["members"] == [1, 5]


def test_confusion(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", "B")], "truth string, est string")
    r = E.accuracy_purity(df).first()
    assert (r["accuracy"], r["purity"]) == (0.75, 0.75)
    df = spark.createDataFrame([("A", "X"), ("A", "X"), ("B", "Y"), ("B", "Y")], "truth string, est string")
    r = E.accuracy_purity(df).first()
    assert (r["accuracy"], r["purity"]) == (0, 1) and E.confusion(df).count() == 16
    assert E.confusion(df.limit(0)).count() == 0


def test_dictionary(spark):
    rows = spark.createDataFrame([(0, "UNK", [9.0, 9.0]), (1, "the", [1.0, 1.0]), (2, "zzz", [5.0, 5.0]), (3, "the", [2.0, 2.0])], "line_no long, type string, vec array<double>")
    vocab = spark.createDataFrame([("the",), ("cat",)], "type string")
    d = D.restrict(rows, vocab, 2)
    got = {r["type"]: r["vec"] for r in d.collect()}
    assert got["OOV"] == [9, 9] and got["the"] == [2, 2] and np.isnan(got["NA"]).all() and len(got) == 3
    assert [r[0] for r in D.missing(vocab, d).collect()] == ["cat"] and D.restrict(rows, vocab, 3).count() == 0
    toks = spark.createDataFrame([(1, "the"), (1, "nope"), (2, "nope")], "doc_id long, tok string")
    assert [tuple(r) for r in D.centroids(toks, d, 2).orderBy("doc_id").collect()] == [(1, 1, [2.0, 2.0]), (2, 0, [0.0, 0.0])]
    normal = D.random_dictionary(vocab, 3, 5)
    assert normal.count() == 4 and str(normal.collect()) == str(D.random_dictionary(vocab, 3, 5).collect())


def test_tags(spark):
    df = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate([("a", "N"), ("a", "V"), ("b", "N"), ("b", "N"), ("b", "V"), ("c", "X")])], "seq long, type string, pos string")
    tm = G.TaggedTokens(df, 0.2)
    assert {r["pos"]: r["n"] for r in tm.tags().collect()} == {"N": 3, "V": 2, "OTH": 1}
    assert {r["type"]: r["pos"] for r in tm.majority.collect()} == {"a": "N", "b": "N", "c": "OTH"}
    a = G.ambiguity(tm.counts).first()
    assert a["n_ambiguous"] == 2 and tm.type_freq("b") == 3 and tm.type_freq("zz") == 0 and tm.known_type("a")


def test_cca_and_varimax(spark):
    rng = np.random.default_rng(2)
    z = rng.standard_normal((200, 1))
    a, b = np.c_[z, rng.standard_normal((200, 1))], np.c_[rng.standard_normal((200, 1)), z]
    rows = spark.createDataFrame([(a[k].tolist(), b[k].tolist()) for k in range(200)], "a array<double>, b array<double>")
    r, _, _ = L.canonical_correlations(rows, "a", "b", 2, 2)
    assert r[0] > 0.999 and r[1] < 0.3
    rotated, q = L.varimax(rng.standard_normal((10, 3)))
    assert np.allclose(q.T @ q, np.eye(3))


def test_whole_analyses(spark):
    docs = S.corpus(spark, 60, np.ones(2), S.topics(2, 60, 0.2, 1), np.array([0.0, 2.0]), 40)
    out = P.lsa(docs, 2, "b", n_projections=3)
    assert out["features"].count() == 60 and len(out["steps"]) == 8
    assert docs.collect() == S.corpus(spark, 60, np.ones(2), S.topics(2, 60, 0.2, 1), np.array([0.0, 2.0]), 40).collect()
    assert P.lsa(docs.drop("y"), 2, quadratic=True, n_projections=2)["d"] is None


def test_quadratic_image_takes_all_pairs(spark):
    rng = np.random.default_rng(4)
    m = np.where(rng.random((3, 400)) < 0.3, rng.random((3, 400)), 0)
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i, j in zip(*map(np.ndarray.tolist, m.nonzero()), strict=True)], "i long, j long, v double")
    j, k = np.triu_indices(400)
    want = (m[:, j] * m[:, k]) @ L.uniform_rows(j.astype(np.uint64) << np.uint64(32) | k.astype(np.uint64), 3, 9)
    got = {r["i"]: r["x"] for r in L.quadratic_image(cells, 3, 9).collect()}
    assert np.allclose([got[i] for i in range(3)], want)


def test_quadratic_mode_heeds_scaling_and_power(spark):
    docs = S.corpus(spark, 30, np.ones(2), S.topics(2, 60, 0.2, 1), np.array([0.0, 2.0]), 40).drop("y")
    basis = lambda *a, **b: np.array([r["x"] for r in P.lsa(docs, 2, *a, quadratic=True, n_projections=2, **b)["features"].orderBy("i").collect()])
    raw, scaled, passed = basis("w"), basis("b"), basis("b", power_iter=1)
    assert np.allclose(scaled.T @ scaled, np.eye(2))
    assert not np.allclose(raw @ raw.T, scaled @ scaled.T) and not np.allclose(scaled @ scaled.T, passed @ passed.T)


def test_regressor_goes_past_500_words(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(d, float(rng.random() + 1), " ".join(f"w{j}" for j in rng.integers(0, 700, 200))) for d in range(40)], "doc_id long, y double, text string")
    out = P.regressor(docs, 3, n_projections=2)
    n = out["types"].count()
    assert n > 500 and len(out["steps"]) == 5 + n
    x = np.array([r["x"] for r in out["rows"].collect()])
    counts = {(r["doc_id"], r["idx"]): r["n"] for r in out["dtm"].collect()}
    docs_at = [r["doc_id"] for r in out["rows"].select("doc_id").collect()]
    assert x.shape == (40, n) and all(x[docs_at.index(d), j] == c for (d, j), c in counts.items()) and x.sum() == sum(counts.values())
    assert np.allclose(L.gram(out["rows"], n), x.T @ x)
    assert P._parser().parse_args(["regressor"]).n_words == 3000


def test_command_line(spark, tmp_path):
    src = tmp_path / "corpus.txt"
    src.write_text("\n".join(f"{k % 7 + 1}.5 the {'big' if k % 2 else 'small'} house {'is' if k % 3 else 'was'} red" for k in range(40)))
    P.main(["lsa_regr", "-i", str(src), "-y", "-l", "-a", "b", "-f", "2", "-r", "2", "-o", str(tmp_path / "out")], spark)
    assert spark.read.csv(str(tmp_path / "out" / "lsa_ym"), sep="\t", header=True).count() == 40


def test_streaming_counts(spark, tmp_path):
    from tessera.streaming.counts import stream_type_counts

    spark.createDataFrame([("a b a",), ("b",)], "text string").write.parquet(str(tmp_path / "in"))
    q = stream_type_counts(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["type"]: r["freq"] for r in spark.table("streamed").collect()} == {"a": 2, "b": 2}
    assert F is not None
