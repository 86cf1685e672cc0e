import pytest
from pyspark.sql import functions as F

from tessera.operators import counts as N
from tessera.operators.vocab import Vocabulary, collapse, ranked, top_share, totals, type_counts


def test_vocabulary_with_oov(lines):
    v = Vocabulary(lines, 0, True, 2)
    got = [tuple(r) for r in v.types.orderBy("idx").collect()]
    assert got == [("OOV", 16, 0), ("EOL", 5, 1), ("with", 2, 2), ("the", 2, 3)]
    assert v.n_tokens() == 25 and v.type_index("unseen") == 0 and v.type_index("the") == 3


def test_bigrams_cross_documents(lines):
    v = Vocabulary(lines, 0, True, 2)
    name = {r["idx"]: r["type"] for r in v.types.collect()}
    got = {(name[r["i"]], name[r["j"]]): r["n"] for r in v.bigrams(0).collect()}
    assert got[("OOV", "OOV")] == 11 and got[("OOV", "EOL")] == 4 and got[("EOL", "with")] == 2 and sum(got.values()) == 24


@pytest.mark.parametrize("skip", [0, 1, 3, 7])
def test_bigrams_match_the_whole_order(spark, skip):
    docs = [(k * 1000, " ".join(f"w{(k * j) % 5}" for j in range(k % 4))) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    from tessera.operators.vocab import token_arrays

    flat = [w for _, t in docs for w in t.split()]
    want = {}
    for a, b in zip(flat, flat[skip + 1 :], strict=False):
        want[a, b] = want.get((a, b), 0) + 1
    got = {(r["left"], r["right"]): r["c"] for r in N.raw_pairs(token_arrays(df), skip).collect()}
    assert got == want


def test_bigrams_of_an_empty_corpus(spark):
    from tessera.operators.vocab import token_arrays

    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.raw_pairs(token_arrays(df)).count() == 0


def test_scalings(lines):
    v = Vocabulary(lines, 0, False, 2)
    dtm = v.document_counts().persist()
    assert dtm.agg(F.sum("n")).first()[0] == 20
    rows = N.scale_documents(dtm, "n").groupBy("doc_id").agg(F.sum("v").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in rows)
    both = {(r["doc_id"], r["idx"]): r["v"] for r in N.scale_documents(dtm, "b").collect()}
    m, f = {3: 5}, v.types.where("type = 'the'").first()
    assert abs(both[3, f["idx"]] - 2 / (m[3] * f["freq"]) ** 0.5) < 1e-12
    with pytest.raises(ValueError):
        N.scale_documents(dtm, "z")


def test_totals_and_share(lines):
    v = Vocabulary(lines, 0, False, 2)
    t = totals(lines, v.counts, 2).first()
    assert (t["n_lines"], t["n_tokens"], t["n_types"], t["n_kept"], t["n_oov"]) == (5, 20, 18, 2, 16)
    assert {r["k"]: round(r["share"], 3) for r in top_share(v.counts, (1, 2)).collect()} == {1: 0.1, 2: 0.2}


def test_literal_oov_adds_up(spark):
    df = spark.createDataFrame([("OOV",)] * 3 + [("x",)], "tok string")
    assert [tuple(r) for r in ranked(collapse(type_counts(df), 2)).collect()] == [("OOV", 4, 0)]


def test_column_pairs_of_all_types(spark):
    cells = [(d, j, 1 + (d + j) % 3) for d in range(2) for j in range(d, 300, 2 + d)]
    got = [tuple(r) for r in N.column_pairs(spark.createDataFrame(cells, "doc_id long, idx int, n long")).collect()]
    want = [(d, j, k, x * y) for d, j, x in cells for e, k, y in cells if d == e and j <= k]
    assert sorted(got) == sorted(want) and max(k for _, _, k, _ in got) > 250


def test_all_quadratic_terms_have_a_query(spark, monkeypatch):
    from tessera.plans import catalog, registry

    dtm = spark.createDataFrame([(1, 0, 2), (1, 25, 3)], "doc_id long, idx int, n long")
    monkeypatch.setattr(catalog, "_dtm", lambda *_: dtm)
    got = registry.queries()["quadratic_terms_all"](spark, "")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 4), (1, 0, 25, 6), (1, 25, 25, 9)]


def test_top_tfidf_all_goes_past_500_types(spark, monkeypatch):
    from tessera.plans import catalog, registry

    cells = [(d, j, 1 + j) for d in range(2) for j in range(d * 100, 600)]
    monkeypatch.setattr(catalog, "_dtm", lambda *_: spark.createDataFrame(cells, "doc_id long, idx int, n long"))
    got = registry.queries()["top_tfidf_all"](spark, "").orderBy("place").collect()
    assert len(got) == 600 and [r["idx"] for r in got[:2]] == [99, 98] and got[0]["score"] == pytest.approx(100 * 0.693147, abs=1e-3)
