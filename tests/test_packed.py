"""Steps that keep documents whole: indices by row, packed pairs and packed
matrices, against plain loops and the same matrices as triplets."""

import inspect
from collections import Counter

import numpy as np
import pytest

from tessera.operators import counts as N
from tessera.operators import linalg as L
from tessera.operators import vocab as V
from tessera.plans import programs as P


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{int(w)}" for w in rng.zipf(1.3, int(rng.integers(0, 40))) if w < 500) for _ in range(60)]
    return spark.createDataFrame([(3 * d, t) for d, t in enumerate(texts)], "doc_id long, text string")


@pytest.fixture
def few_sent(monkeypatch):
    """Almost nothing is sent out, so that the joins do the work."""
    for module, name, value in ((V, "BROADCAST_TYPES", 4), (V, "SLICE_TOKENS", 50), (V, "HOT_PARTS", 3), (N, "SLICE_PAIRS", 64), (N, "PART_PAIRS", 9), (N, "ROW_PAIRS", 3), (L, "BROADCAST_NUMBERS", 12), (L, "SLICE_CELLS", 40)):
        monkeypatch.setattr(module, name, value)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _loops(docs, v, skip):
    """(documents as indices, counts of pairs) by plain loops."""
    at = {r["type"]: r["idx"] for r in v.types.collect()}
    rows = [(r["doc_id"], [at.get(w, at.get("OOV", -1)) for w in [*r["text"].split(), "EOL"]]) for r in docs.orderBy("doc_id").collect()]
    flat = [i for _, ids in rows for i in ids]
    return rows, Counter(zip(flat, flat[skip + 1 :], strict=False))


@pytest.mark.parametrize("skip", [0, 1, 4])
def test_pairs_are_merged_from_packed_slices(spark, docs, few_sent, skip):
    """F8 to F17."""
    v = V.Vocabulary(docs, 0, True, 2)
    rows, want = _loops(docs, v, skip)
    assert sorted((r["doc_id"], r["ids"]) for r in v.ids.collect()) == rows
    packed = N.bigram_rows(v.ids, skip).collect()
    assert max(len(r["js"]) for r in packed) <= 3
    got = {(r["i"], r["j"]): r["n"] for r in v.bigrams(skip).collect()}
    assert got == want
    for how, value in (("b", lambda i, j: (f[i] * f[j]) ** -0.5), ("left", lambda i, j: 1 / f[i]), ("c", lambda i, j: f[j] ** -0.5)):
        f = {r["idx"]: r["freq"] for r in v.types.collect()}
        scaled = {(r["i"], r["j"]): r["v"] for r in N.scale_bigrams(v.bigrams(skip), v.types, how).collect()}
        assert scaled.keys() == want.keys() and all(abs(x - want[c] * value(*c)) < 1e-12 for c, x in scaled.items())


def test_documents_are_counted_where_they_are_read(spark, docs, few_sent):
    """F18, F20 to F24: no aggregate over cells; rows of one doc_id add up."""
    v = V.Vocabulary(docs, 0, True, 2)
    rows, _ = _loops(docs, v, 0)
    assert "Aggregate" not in _plan(v.document_counts())
    assert {(r["doc_id"], r["idx"]): r["n"] for r in v.document_counts().collect()} == Counter((d, i) for d, ids in rows for i in ids)
    twice = spark.createDataFrame([(1, "a b"), (1, "b"), (2, "b")], "doc_id long, text string")
    assert sorted(map(tuple, V.Vocabulary(twice, 0, False, 1).document_counts().collect())) == [(1, 0, 2), (1, 1, 1), (2, 0, 1)]


@pytest.mark.parametrize(("skip", "eol"), [(0, False), (2, True)])
def test_texts_are_split_as_spark_splits_them(spark, few_sent, skip, eol):
    docs = spark.createDataFrame([(0, " a\tb\x0bc\x0c d\r\n"), (1, None), (2, ""), (3, " \n "), (4, "x\u00a0y \u2003 z a b c"), (5, "a" * 400)], "doc_id long, text string")
    arrays = {r["doc_id"]: r["toks"] for r in V.token_arrays(docs, skip, eol).collect()}
    v = V.Vocabulary(docs, skip, eol, 1)
    name = {r["idx"]: r["type"] for r in v.types.collect()}
    assert {r["doc_id"]: [name[i] for i in r["ids"]] for r in v.ids.collect()} == arrays
    assert {r["doc_id"]: r["m"] for r in v.texts.lengths().collect()} == {d: len(t) for d, t in arrays.items() if t}
    assert {r["type"]: r["freq"] for r in v.counts.collect()} == Counter(w for t in arrays.values() for w in t)


def test_tokens_without_a_type(spark):
    types = V.Vocabulary(spark.createDataFrame([(1, "a a b")], "doc_id long, text string"), 0, False, 1).types
    other = V.token_arrays(spark.createDataFrame([(5, "a x b"), (6, None)], "doc_id long, text string"))
    ids = V.indexed_arrays(other, types)
    assert sorted(map(tuple, ids.collect())) == [(5, [0, -1, 1]), (6, [])]
    assert sorted(map(tuple, N.bigram_counts(ids, types).collect())) == [(-1, 1, 1), (0, -1, 1)]


def test_pairs_of_types_need_no_join(spark, docs):
    """a document's pairs come from its own arrays."""
    rows = N.document_rows(V.Vocabulary(docs, 0, True, 2).ids)
    cells = [tuple(r) for r in N.row_cells(rows).collect()]
    for types in (None, 5):
        pairs = N.column_pairs(rows, types)
        assert "Join" not in _plan(pairs) and "Aggregate" not in _plan(pairs)
        want = [(d, j, k, x * y) for d, j, x in cells for e, k, y in cells if d == e and j <= k and (types is None or k < types)]
        assert sorted(map(tuple, pairs.collect())) == sorted(want) == sorted(map(tuple, N.column_pairs(N.row_cells(rows).select("*"), types).collect()))


@pytest.mark.parametrize("how", list("wrcbn"))
def test_packed_products_match_triplets(spark, docs, few_sent, how):
    """images and products both ways, without joining cells."""
    v = V.Vocabulary(docs, 0, True, 2)
    rows = N.document_rows(v.ids)
    packed = N.scaled_rows(rows, how, N.frequencies(v.types))
    cells = N.scale_documents(N.row_cells(rows), how).selectExpr("doc_id i", "cast(idx as long) j", "v").collect()
    a = np.zeros((180, v.n_types()))
    for r in cells:
        a[r["i"], r["j"]] = r["v"]
    dense = lambda df, n: np.array([{r["i"]: r["x"] for r in df.collect()}.get(i, [0.0] * 3) for i in range(n)])
    p = lambda n: spark.createDataFrame([(i, q[i].tolist()) for i in range(n)], "i long, x array<double>")
    q = np.random.default_rng(2).standard_normal((180 + a.shape[1], 3))
    assert np.allclose(dense(L.random_image(packed, 3, 5), 180), a @ L.uniform_rows(np.arange(a.shape[1]), 3, 5))
    assert np.allclose(dense(L.random_image(L.flip(packed), 3, 5), a.shape[1]), a.T @ L.uniform_rows(np.arange(180), 3, 5))
    assert np.allclose(dense(L.times_rows(packed, p(a.shape[1]), 3), 180), a @ q[: a.shape[1]])
    assert np.allclose(dense(L.times_rows(L.flip(packed), p(180), 3), a.shape[1]), a.T @ q[:180])


def test_matrices_beside_each_other(spark, docs, few_sent):
    """[F^-1/2 B F^-1/2 | F^-1/2 W'] as it stands in unified_matrix."""
    v = V.Vocabulary(docs, 0, True, 2)
    rows, runs, n = N.document_rows(v.ids), N.frequencies(v.types), v.n_types()
    both = L.Beside(N.scaled_bigram_rows(N.bigram_rows(v.ids), "b", runs), L.flip(N.scaled_rows(rows, "n", runs, over_types=True)), n)
    a = np.zeros((n, n + 180))
    for r in N.unified_matrix(v.bigrams(0), rows, v.types, n).collect():
        a[r["i"], r["j"]] = r["v"]
    dense = lambda df, m: np.array([{r["i"]: r["x"] for r in df.collect()}.get(i, [0.0] * 3) for i in range(m)])
    assert np.allclose(dense(L.random_image(both, 3, 5), n), a @ L.uniform_rows(np.arange(n + 180), 3, 5))
    q = np.random.default_rng(2).standard_normal((n + 180, 3))
    p = lambda m: spark.createDataFrame([(i, q[i].tolist()) for i in range(m)], "i long, x array<double>")
    assert np.allclose(dense(L.times_rows(both, p(n + 180), 3), n), a @ q)
    assert np.allclose(dense(L.times_rows(L.flip(both), p(n), 3), n + 180), a.T @ q[:n])


def test_quadratic_image_of_packed_rows(spark, docs, monkeypatch):
    """rows stay packed, and their pairs are made in blocks."""
    monkeypatch.setattr(L, "PAIR_BLOCK", 7)
    rows = N.document_rows(V.Vocabulary(docs, 0, True, 2).ids)
    packed = N.scaled_rows(rows, "w", None)
    plan = _plan(L.quadratic_image(packed, 3, 9))
    assert "Aggregate" not in plan and "Join" not in plan
    got = {r["i"]: r["x"] for r in L.quadratic_image(packed, 3, 9).collect()}
    for r in rows.collect():
        j, n = np.array(r["js"], np.uint64), np.array(r["ns"], float)
        a, b = np.triu_indices(len(j))
        assert np.allclose(got[r["doc_id"]], (n[a] * n[b]) @ L.uniform_rows(j[a] << np.uint64(32) | j[b], 3, 9))


def test_clusters_from_arrays_at_hand(spark):
    """tokens aren't gathered again, and judging goes by counts."""
    assert "toks" in inspect.signature(P.cluster_types).parameters
    pairs = [("the", "D"), ("big", "A"), ("house", "N"), ("is", "V"), ("red", "A")] * 40
    tagged = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate(pairs)], "seq long, type string, pos string")
    arrays = spark.createDataFrame([(d, [t for t, _ in pairs[50 * d : 50 * d + 50]]) for d in range(4)], "doc_id long, toks array<string>")
    how = {"projections": 4, "clusters": 3, "bidirectional": True, "weight_centroid": True}
    one, two = P.cluster_types(tagged, **how), P.cluster_types(tagged, **how, toks=arrays)
    assert sorted(map(tuple, one["confusion"].collect())) == sorted(map(tuple, two["confusion"].collect()))
    assert one["score"].first() == two["score"].first() and two["score"].first()["n"] == 200
