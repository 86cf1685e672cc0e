"""Distributions, paths, Poisson regression and others against numpy or by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions as Q
from tessera.functions import text as T
from tessera.operators import counts as N
from tessera.operators import dictionary as D
from tessera.operators import evaluate as E
from tessera.operators import linalg as L
from tessera.operators import regression as R
from tessera.operators import simulate as S
from tessera.operators import vocab as V


def _area(f, lo, hi, n=200_001):
    x = np.linspace(lo, hi, n)
    return float(np.trapezoid(f(x), x))


@pytest.mark.parametrize("df", [1, 3, 10, 200])
def test_t_shares_are_areas_under_its_density(df):
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    density = lambda x: front * (1 + x * x / df) ** (-(df + 1) / 2)
    for t in (0.1, 1.0, 2.5):
        assert abs(Q.t_two_sided(t, df) - (1 - 2 * _area(density, 0, t))) < 1e-8
        assert abs(Q.t_quantile(1 - Q.t_two_sided(t, df) / 2, df) - t) < 1e-8
    assert abs(Q.t_quantile(0.025, df) + Q.t_quantile(0.975, df)) < 1e-9


def test_known_quantiles():
    assert abs(Q.t_quantile(0.975, 10) - 2.2281388520) < 1e-8 and abs(Q.t_quantile(0.975, 1) - 12.7062047362) < 1e-6
    assert abs(Q.f_above(4.9646027437, 1, 10) - 0.05) < 1e-8 and abs(Q.f_above(3.0, 2, 7) - (1 + 2 * 3 / 7) ** -3.5) < 1e-12
    assert Q.f_above(0, 2, 3) == 1 and Q.beta_share(0, 1, 1) == 0 and Q.beta_share(1, 1, 1) == 1 and abs(Q.beta_share(0.3, 1, 1) - 0.3) < 1e-12


def test_normal_scores(spark):
    from statistics import NormalDist

    values = [3.0, 1.0, 2.0, 2.0, None, 9.0] + [float(k) for k in range(20, 420)]
    got = {r["value"]: (r["n"], r["q"]) for r in R.normal_scores(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    kept = sorted(v for v in values if v is not None)
    for v in set(kept):
        n = kept.count(v)
        assert got[v][0] == n and abs(got[v][1] - NormalDist().inv_cdf((kept.index(v) + n / 2) / len(kept))) < 1e-6
    assert R.normal_scores(spark.createDataFrame([], "v double"), "v").count() == 0


def test_five_numbers_are_exact(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 500):
        v = rng.integers(0, 60, n).astype(float)
        row = E.five_numbers(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double"), "v").first()
        assert np.allclose(list(row), np.quantile(v, [0, 0.25, 0.5, 0.75, 1]))


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0.3], [0, 0, 0, 1]])
    y = x @ [2.0, 0, -1.0, 0.3] + rng.standard_normal(200)
    return x, y, spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(200)], "doc_id long, y double, x array<double>")


def test_least_angle_path(design):
    x, y, rows = design
    path = R.lar_path(R.design_gram(rows, 4), list("abcd"))
    z, r = (x - x.mean(0)) / x.std(0), y - y.mean()
    at = lambda step: np.array([sum(p["coefficient"] for p in path if p["step"] == step and p["name"] == m) for m in "abcd"])
    last = np.linalg.lstsq(z, r, rcond=None)[0]
    assert np.allclose(at(4), last)
    for step in (1, 2, 3):  # those that are in stay equally correlated, the others less
        c = np.abs(z.T @ (r - z @ at(step))) / 200
        inside = [k for k, m in enumerate("abcd") if any(p["step"] == step and p["name"] == m for p in path)]
        assert len(inside) == step and np.allclose(c[inside], c[inside][0]) and all(c[k] <= c[inside][0] + 1e-9 for k in range(4))


def test_p_values_nested_f_and_summaries(design):
    x, y, rows = design
    model = R.ols(rows, list("abcd"))
    assert all(abs(r["p"] - Q.t_two_sided(r["t"], 195)) < 1e-12 for r in model)
    steps = R.sequence(R.design_gram(rows, 4), list("abcd"))
    f, p = R.nested_f(steps[2].rss, steps[3].rss, 196, 195)
    t = model[4]["t"]
    assert abs(f - t * t) < 1e-6 and abs(p - model[4]["p"]) < 1e-9
    assert R.best_step(steps)["aicc"] == min(s.aicc for s in steps)
    assert abs(sum(s["step"] for s in R.increments(steps)) - steps[-1].r2) < 1e-12
    assert [r["name"] for r in R.largest_t(model, 2)] == ["a", "c"]
    s = R.t_summary([r["t"] for r in model], 195)
    assert abs(s["bound"] - Q.t_quantile(1 - 0.025 / 5, 195)) < 1e-9
    flat = R.power_law([8.0 / k**0.5 for k in range(1, 30)])
    assert abs(flat["slope"] + 0.5) < 1e-9 and abs(R.power_law([1.0, 2.0, 5.0, 3.0], True)["square"]) > 0


def test_trimmed_training_leaves_outliers_out(spark, design):
    x, y, _ = design
    y = y.copy()
    y[:4] += 80
    rows = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(200)], "doc_id long, y double, x array<double>")
    out = R.trimmed_mse(rows, 4, 4, 3.0, 0)
    fold = np.arange(200) % 4
    for r in out:
        train, held = fold != r["fold"], fold == r["fold"]
        a = np.c_[np.ones(200), x]
        fit = lambda m: np.linalg.lstsq(a[m], y[m], rcond=None)[0]
        res = y - a @ fit(train)
        sigma = math.sqrt((res[train] ** 2).sum() / (train.sum() - 5))
        keep = train & (np.abs(res) <= 3 * sigma)
        assert keep.sum() == r["trained"] < train.sum() and abs(((y - a @ fit(keep))[held] ** 2).mean() - r["mse"]) < 1e-6


def test_poisson_solves_its_score_equations(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 2)) * 0.5
    y = rng.poisson(np.exp(0.7 + x @ [0.8, -0.4]))
    rows = spark.createDataFrame([(float(y[i]), x[i].tolist()) for i in range(300)] + [(None, [0.0, 0.0])], "y double, x array<double>")
    beta = np.array([r["coefficient"] for r in R.poisson(rows, ["a", "b"])])
    a = np.c_[np.ones(300), x]
    assert np.abs(a.T @ (y - np.exp(a @ beta))).max() < 1e-6


def test_factors_and_too_many_levels(spark):
    rows = spark.createDataFrame([("a", [1.0]), (None, [2.0]), ("a", [3.0]), ("b", [4.0])], "g string, x array<double>")
    out, names = R.group_columns(rows, "g")
    assert names == ["g=(null)", "g=b"] and [r["x"] for r in out.collect()] == [[1, 0, 0], [2, 1, 0], [3, 0, 0], [4, 0, 1]]
    with pytest.raises(ValueError):
        R.group_columns(rows, "g", 2)


def test_canonical_correlations_are_singular_values_of_scaled_bigrams(spark):
    rows = S.toy_pairs(spark, 3000, 4)
    r, _, _ = L.canonical_correlations(rows, "a", "b", 4, 4, center=False)
    aa, ab, bb = L.cross_gram(rows, "a", "b", 4, 4)
    scaled = ab / np.sqrt(np.outer(np.diag(aa), np.diag(bb)))
    assert np.allclose(r, np.linalg.svd(scaled)[1]) and abs(r[0] - 1) < 1e-9


def test_products_with_hot_inner_indices(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a = np.where(rng.random((60, 30)) < 0.2, rng.random((60, 30)), 0)
    a[:, 3] = 1
    p = rng.standard_normal((30, 5))
    cells = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*a.nonzero(), strict=True)], "i long, j long, v double")
    rows = spark.createDataFrame([(j, p[j].tolist()) for j in range(30)], "i long, x array<double>")
    got = lambda: np.array([r["x"] for r in L.times_rows(cells, rows, 5).orderBy("i").collect()])
    assert np.allclose(got(), a @ p)
    monkeypatch.setattr(L, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(L, "HOT_PARTS", 10)
    monkeypatch.setattr(L, "NARROW", 2)
    assert np.allclose(got(), a @ p)


def test_large_vocabularies_meet_tokens_by_join(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"the w{k % 7} the x{k} OOV") for k in range(40)], "doc_id long, text string")
    v = V.Vocabulary(docs, 0, True, 3)
    frames = lambda: (sorted(map(tuple, v.document_counts().collect())), sorted(map(tuple, v.bigrams(1).collect())))
    small = frames()
    monkeypatch.setattr(V, "BROADCAST_TYPES", 0)
    monkeypatch.setattr(V, "HOT_PARTS", 5)
    assert frames() == small and sum(n for *_, n in small[0]) == 40 * 6


def test_bigrams_across_many_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_DOCS", 3)
    rng = np.random.default_rng(7)
    texts = [" ".join(str(w) for w in rng.integers(0, 4, int(rng.integers(0, 4)))) for _ in range(100)]
    ids = sorted(int(x) for x in rng.choice(10_000, 100, replace=False))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    toks = " ".join(texts).split()
    for skip in (0, 2):
        want = {}
        for a, b in zip(toks, toks[skip + 1 :], strict=False):
            want[a, b] = want.get((a, b), 0) + 1
        assert {(r["left"], r["right"]): r["c"] for r in N.raw_pairs(V.token_arrays(docs), skip).collect()} == want


def test_small_operators(spark):
    rows = spark.createDataFrame([(k, f"line{k}") for k in range(10)], "k int, s string")
    assert E.head_tail_split(rows, "k", 3).where("train").count() == 3 and E.head_tail_split(rows.limit(0), "k", 3).count() == 0
    assert [r["k"] for r in E.first_rows(rows, "k", 2).collect()] == [0, 1] and {r["k"] for r in E.last_rows(rows, "k", 2).collect()} == {8, 9}
    assert rows.select(T.from_char(F.col("s"), 3)).first()[0] == "ne0"
    words = spark.createDataFrame([("a",), ("a",), ("c",)], "word string")
    assert {tuple(r) for r in E.match_counts(words, spark.createDataFrame([("a",), ("b",)], "type string")).collect()} == {("a", 2), ("b", 0)}
    docs = S.topics_used(spark.createDataFrame([([3, 0, 1],)], "z array<long>"))
    assert docs.first()["n_topics"] == 2
    noisy = S.dither(spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1.0).alias("v")), "v", 0.1)
    assert sorted(r["v"] for r in noisy.collect()) == sorted(r["v"] for r in S.dither(spark.range(500).repartition(3).select(F.col("id").alias("doc_id"), F.lit(1.0).alias("v")), "v", 0.1).collect())
    assert abs(noisy.agg(F.stddev("v")).first()[0] - 0.1) < 0.02
    vectors = D.train_vectors(spark.createDataFrame([(["a", "b", "c"] * 20,)] * 4, "toks array<string>"), 5)
    assert {r["type"] for r in vectors.collect()} == {"a", "b", "c"} and all(len(r["vec"]) == 5 for r in vectors.collect())
    listed = E.random_pairs(spark.createDataFrame([(float(k), float(-k)) for k in range(30)], "y double, f double"), 10)
    assert listed.count() == 10 and E.concordant_pairs(listed).first()["concordant"] == 0


def test_rotations_and_plain_projections(spark):
    q = L.random_rotation(6, 1)
    assert np.allclose(q @ q.T, np.eye(6))
    cells = spark.createDataFrame([(0, 1, 2.0), (1, 0, 1.0), (2, 1, -1.0)], "i long, j long, v double")
    both = {r["i"]: r["x"] for r in L.plain_projection(cells, 4, 3, both_sides=True).collect()}
    one, two = (L.uniform_rows(np.arange(3), 2, s) for s in (3, 4))
    b = np.zeros((3, 3))
    b[[0, 1, 2], [1, 0, 1]] = [2, 1, -1]
    assert np.allclose([both[i] for i in range(3)], np.c_[b.T @ one, b @ two])
    with pytest.raises(ValueError):
        L.plain_projection(cells, 3, both_sides=True)


def test_lighthouse_average_runs_and_loess(spark, design):
    _, _, rows = design
    hats = R.lighthouse(rows.withColumn("z", F.when(F.col("doc_id") % 2 == 0, F.col("x")[0] * 2 + 1)), list("abcd"), ["z"])
    assert hats.where(F.abs(F.col("z_hat") - (F.col("x")[0] * 2 + 1)) > 1e-6).count() == 0
    runs = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0), (1, 1, 5.0)], "run int, step int, cvss double")
    assert {tuple(r) for r in R.average_runs(runs).collect()} == {(0, 3.0), (1, 5.0)}
    line = spark.createDataFrame([("g", float(k), 3.0 * k + 1) for k in range(20)], "g string, a double, b double")
    assert all(abs(r["smooth"] - r["b"]) < 1e-9 for r in R.loess(line, ["g"], "a", "b").collect())
    g = R.design_gram(rows, 4)
    by, bc = R.partial_residuals(g, 3, [0, 1, 2])
    x, y, _ = design
    a = np.c_[np.ones(200), x[:, :3]]
    slope = ((y - a @ by) @ (x[:, 3] - a @ bc)) / ((x[:, 3] - a @ bc) ** 2).sum()
    assert abs(slope - R.ols(rows, list("abcd"))[4]["coefficient"]) < 1e-9
    tt = R.train_test_sequence(g, g, [2, 4])
    assert abs(tt[1]["sse"] - R.ols(rows, list("abcd"))[0]["rss"]) < 1e-6
