"""Registered queries of regression, decompositions and clustering whose SQL
twins are closed forms: least squares by Cramer's rule over moments, spectra
of two columns by the quadratic formula, Lloyd steps one by one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import distributions as Q
from tessera.functions import text as T
from tessera.operators import cluster as C
from tessera.operators import counts as N
from tessera.operators import dictionary as D
from tessera.operators import evaluate as E
from tessera.operators import linalg as L
from tessera.operators import regression as R
from tessera.operators import vocab as V
from tessera.plans import programs as P
from tessera.plans.catalog import KM, LINE, _docs, _lines, _points, _r, _start, _table
from tessera.plans.registry import query
from tessera.session import shared_dir
from tessera.sources import sinks, text_sources
from tessera.sources.tables import table

# --- SQL of least squares


def _det(m: list[list[str]]) -> str:
    """The determinant of a matrix of SQL expressions, along its first row."""
    if len(m) == 1:
        return m[0][0]
    parts = [f"{'-' if k % 2 else '+'} {m[0][k]} * ({_det([r[:k] + r[k + 1 :] for r in m[1:]])})" for k in range(len(m))]
    return " ".join(parts).removeprefix("+ ")


def _moments(x: list[str], rows: str) -> str:
    """CTEs r(y, x1...), c (means) and s (centred sums s_i_j; y is number 0)."""
    k = len(x)
    names = ["y", *[f"x{i}" for i in range(1, k + 1)]]
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(names))
    sums = ", ".join(f"sum(({a} - m{i}) * ({b} - m{j})) AS s_{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)
    return f"r AS ({rows}), c AS (SELECT count(*)::DOUBLE AS n, {means} FROM r), s AS (SELECT any_value(n) AS n, {', '.join(f'any_value(m{i}) AS m{i}' for i in range(k + 1))}, {sums} FROM r, c)"


def _s(i: int, j: int) -> str:
    return f"s_{min(i, j)}_{max(i, j)}"


def _fit(k: int, out: str = "b", of: str = "s") -> str:
    """CTE `out`: b1..bk, b0, rss and the diagonal d1..dk of the inverse."""
    cells = [[_s(i, j) for j in range(1, k + 1)] for i in range(1, k + 1)]
    whole = f"({_det(cells)})"
    beta = [f"({_det([[_s(i, 0) if j == c else cells[i - 1][j - 1] for j in range(1, k + 1)] for i in range(1, k + 1)])}) / {whole} AS b{c}" for c in range(1, k + 1)]
    diagonal = [f"({_det([[cells[i][j] for j in range(k) if j != c] for i in range(k) if i != c]) if k > 1 else '1.0'}) / {whole} AS d{c + 1}" for c in range(k)]
    inner = f"SELECT *, {', '.join(beta)}, {', '.join(diagonal)} FROM {of}"
    rest = "s_0_0 - (" + " + ".join(f"b{c} * {_s(0, c)}" for c in range(1, k + 1)) + ")"
    zero = "m0 - (" + " + ".join(f"b{c} * m{c}" for c in range(1, k + 1)) + ")"
    return f"{out} AS (SELECT *, {rest} AS rss, {zero} AS b0 FROM ({inner}))"


def _coefficients(names: list[str], places: int, of: str = "b") -> str:
    """Rows name, coefficient, se, t of a CTE of _fit, slopes alone."""
    k = len(names)
    return " UNION ALL ".join(f"SELECT '{m}' AS name, round(b{c}, {places}) AS coefficient, round(sqrt(d{c} * rss / (n - {k + 1})), {places}) AS se, round(b{c} / sqrt(d{c} * rss / (n - {k + 1})), 4) AS t FROM {of}" for c, m in enumerate(names, 1))


def _slopes(spark, model: list[dict], places: int) -> DataFrame:
    kept = [{"name": r["name"], "coefficient": r["coefficient"], "se": r["se"], "t": r["t"]} for r in model if r["name"] != "(constant)"]
    return _table(spark, kept, "name string, coefficient double, se double, t double").select("name", _r("coefficient", places).alias("coefficient"), _r("se", places).alias("se"), _r("t", 4).alias("t"))


# --- features of documents: a response that depends on its columns

TEXT_NAMES = ["tokens", "commas", "lines", "points", "capitals"]
_count = lambda c: f"(length(text) - length(replace(text, {c}, '')))::DOUBLE"
TEXT_ROWS = f"SELECT length(text) / 1000.0 AS y, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) / 100.0 AS x1, {_count(chr(39) + ',' + chr(39))} AS x2, {_count('chr(10)')} AS x3, {_count(chr(39) + '.' + chr(39))} AS x4, length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE AS x5, doc_id FROM documents WHERE text IS NOT NULL"
LINE_ROWS = "SELECT l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem"


def _text_rows(spark, sf_dir) -> DataFrame:
    text = F.col("text")
    gone = lambda c: (F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    x = F.array(F.size(T.tokens(text)) / 100.0, gone(","), gone("\n"), gone("."), F.char_length(F.regexp_replace(text, "[^A-Z]", "")).cast("double"))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", (F.char_length(text) / 1000.0).alias("y"), x.alias("x"))


@query("ols_fit", f"WITH {_moments(LINE, LINE_ROWS)}, {_fit(3)} {_coefficients(LINE, 3)}")
def ols_fit(spark, sf_dir):
    return _slopes(spark, R.ols(_lines(spark, sf_dir), LINE), 3)


@query("ols_text", f"WITH {_moments(TEXT_NAMES, TEXT_ROWS)}, {_fit(5)} {_coefficients(TEXT_NAMES, 5)}")
def ols_text(spark, sf_dir):
    return _slopes(spark, R.ols(_text_rows(spark, sf_dir), TEXT_NAMES), 5)


def _sequence_sql(names: list[str]) -> str:
    steps = []
    for k, m in enumerate(names, 1):
        q = k + 1
        steps.append(f"SELECT {k} AS place, '{m}' AS name, 1 - rss / s_0_0 AS r2, 1 - (rss / (n - {q})) / (s_0_0 / (n - 1)) AS adj_r2, rss, {q} AS q, n * ln(rss / n) + {2 * q} + {2 * q * (q + 1)} / (n - {q + 1}) AS aicc, n FROM b{k}_")
    return f"WITH {_moments(names, TEXT_ROWS)}, {', '.join(_fit(k, f'b{k}_') for k in range(1, len(names) + 1))}, steps AS ({' UNION ALL '.join(steps)})"


def _text_steps(spark, sf_dir) -> list:
    return R.sequence(R.design_gram(_text_rows(spark, sf_dir), len(TEXT_NAMES)), TEXT_NAMES)


@query("seq_r2", f"{_sequence_sql(TEXT_NAMES)} SELECT name, round(r2, 6) AS r2, round(adj_r2, 6) AS adj_r2, round(rss, 4) AS rss, q, round(aicc, 3) AS aicc FROM steps")
def seq_r2(spark, sf_dir):
    out = _table(spark, _text_steps(spark, sf_dir), "name string, r2 double, adj_r2 double, rss double, q int, aicc double")
    return out.select("name", _r("r2").alias("r2"), _r("adj_r2").alias("adj_r2"), _r("rss", 4).alias("rss"), "q", _r("aicc", 3).alias("aicc"))


@query("best_aicc", f"{_sequence_sql(TEXT_NAMES)} SELECT place, name, round(aicc, 3) AS aicc FROM steps ORDER BY aicc LIMIT 1")
def best_aicc(spark, sf_dir):
    return _table(spark, [R.best_step(_text_steps(spark, sf_dir))], "place int, name string, aicc double").withColumn("aicc", _r("aicc", 3))


@query("r2_increments", f"{_sequence_sql(TEXT_NAMES)} SELECT place, round(r2 - coalesce(lag(r2) OVER (ORDER BY place), 0), 6) AS step, round(r2, 6) AS upto FROM steps")
def r2_increments(spark, sf_dir):
    return _table(spark, R.increments(_text_steps(spark, sf_dir)), "place int, step double, upto double").select("place", _r("step").alias("step"), _r("upto").alias("upto"))


@query("predictive_r2", f"{_sequence_sql(TEXT_NAMES)} SELECT round(r2, 6) AS r2, round(adj_r2, 6) AS adj_r2, round(1 - (rss / (n - 12)) / (rss / (1 - r2) / (n - 1)), 6) AS predictive_r2 FROM steps WHERE place = 5")
def predictive_r2(spark, sf_dir):
    g = R.design_gram(_text_rows(spark, sf_dir), 5)
    last = R.sequence(g, TEXT_NAMES)[-1]
    three = R.predictive_r2(last.rss, g[1, 1] - g[0, 1] ** 2 / g[0, 0], int(g[0, 0]), last.q)
    return spark.createDataFrame([tuple(float(x) for x in three)], "r2 double, adj_r2 double, predictive_r2 double").select(*[_r(c).alias(c) for c in ("r2", "adj_r2", "predictive_r2")])


@query("nested_f", f"{_sequence_sql(TEXT_NAMES)} SELECT round((a.rss - b.rss) / 3 / (b.rss / (b.n - 6)), 3) AS f FROM steps a, steps b WHERE a.place = 2 AND b.place = 5")
def nested_f(spark, sf_dir):
    steps = _text_steps(spark, sf_dir)
    n = _text_rows(spark, sf_dir).count()
    f, _ = R.nested_f(steps[1].rss, steps[4].rss, n - 3, n - 6)
    return spark.createDataFrame([(float(f),)], "f double").withColumn("f", _r("f", 3))


@query("stepwise_forward")
def stepwise_forward(spark, sf_dir):
    names = [*TEXT_NAMES, *[f"{a}*{b}" for k, a in enumerate(TEXT_NAMES) for b in TEXT_NAMES[k + 1 :]]]
    g = R.design_gram(R.interactions(_text_rows(spark, sf_dir), 5), len(names))
    return _table(spark, R.stepwise(g, names), "step int, name string, t double, rss double, q int")


@query("stepwise_first", f"WITH {_moments(TEXT_NAMES, TEXT_ROWS)}, one AS (" + " UNION ALL ".join(f"SELECT '{m}' AS name, s_0_{k} * s_0_{k} / (s_0_0 * s_{k}_{k}) AS r2, n FROM s" for k, m in enumerate(TEXT_NAMES, 1)) + ") SELECT name, round(sqrt(r2 / (1 - r2) * (n - 2)), 4) AS t FROM one ORDER BY r2 DESC LIMIT 1")
def stepwise_first(spark, sf_dir):
    g = R.design_gram(_text_rows(spark, sf_dir), 5)
    return _table(spark, R.stepwise(g, TEXT_NAMES, most=1), "name string, t double").withColumn("t", _r("t", 4))


@query("lar_path")
def lar_path(spark, sf_dir):
    return _table(spark, R.lar_path(R.design_gram(_text_rows(spark, sf_dir), 5), TEXT_NAMES), "step int, name string, coefficient double")


@query("largest_coefficients", f"WITH {_moments(TEXT_NAMES, TEXT_ROWS)}, {_fit(5)}, t AS ({_coefficients(TEXT_NAMES, 5)}) SELECT * FROM t ORDER BY abs(t) DESC LIMIT 3")
def largest_coefficients(spark, sf_dir):
    return _slopes(spark, R.largest_t(R.ols(_text_rows(spark, sf_dir), TEXT_NAMES), 3), 5)


@query("calibration", f"WITH {_moments(TEXT_NAMES[:2], TEXT_ROWS)}, {_fit(2)}, f AS (SELECT r.y, b.b0 + b.b1 * r.x1 + b.b2 * r.x2 AS fit FROM r, b), r2_ AS (SELECT y, fit AS x1, fit * fit AS x2 FROM f), q AS (WITH {_moments(TEXT_NAMES[:2], 'SELECT * FROM r2_')}, {_fit(2)} SELECT * FROM b) {_coefficients(['fit_1', 'fit_2'], 5, 'q')}")
def calibration(spark, sf_dir):
    rows = _text_rows(spark, sf_dir).withColumn("x", F.slice("x", 1, 2))
    beta = [r["coefficient"] for r in R.ols(rows, TEXT_NAMES[:2])]
    return _slopes(spark, R.calibration(R.fitted(rows, beta), 2), 5)


_RAW = [["1.0", "y", "x1", "x2"][k] for k in range(4)]


def _fold_sql(folds: int) -> str:
    """Mean squared error of held-out folds of a fit on x1 and x2, from raw
    moments by fold: train is the whole less the fold."""
    names = ["one", "y", "x1", "x2"]
    sums = ", ".join(f"sum({a} * {b}) AS g_{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)
    cell = lambda p, i, j: f"{p}_{min(i, j)}_{max(i, j)}"
    train = ", ".join(f"sum(g_{i}_{j}) OVER () - g_{i}_{j} AS t_{i}_{j}" for i in range(4) for j in range(4) if i <= j)
    at = [0, 2, 3]
    a = [[cell("t", i, j) for j in at] for i in at]
    b = [cell("t", i, 1) for i in at]
    beta = ", ".join(f"({_det([[b[i] if j == c else a[i][j] for j in range(3)] for i in range(3)])}) / ({_det(a)}) AS b{c}" for c in range(3))
    cross = " + ".join(f"b{c} * {cell('g', at[c], 1)}" for c in range(3))
    square = " + ".join(f"b{c} * b{d} * {cell('g', at[c], at[d])}" for c in range(3) for d in range(3))
    return f"WITH r AS ({TEXT_ROWS}), g AS (SELECT doc_id % {folds} AS fold, {sums} FROM (SELECT *, 1.0 AS one FROM r) GROUP BY 1), t AS (SELECT *, {train} FROM g), b AS (SELECT *, {beta} FROM t), e AS (SELECT fold::INT AS fold, g_0_0 AS n, g_1_1 - 2 * ({cross}) + {square} AS ss FROM b)"


@query("cv_mse_in_turn", f"{_fold_sql(5)} SELECT fold, n::DOUBLE AS n, round(ss / n, 6) AS mse FROM e")
def cv_mse_in_turn(spark, sf_dir):
    rows = _text_rows(spark, sf_dir).withColumn("x", F.slice("x", 1, 2))
    return _table(spark, R.cross_validated_mse(rows, 2, 5, 1, 0), "fold int, n double, mse double").withColumn("mse", _r("mse"))


@query("cv_ss_in_turn", f"{_fold_sql(5)} SELECT round(sum(ss), 4) AS cvss FROM e")
def cv_ss_in_turn(spark, sf_dir):
    rows = _text_rows(spark, sf_dir).withColumn("x", F.slice("x", 1, 2))
    return _table(spark, R.validated_sequence(rows, TEXT_NAMES[:1], TEXT_NAMES[1:2], 5, 0)[-1:], "cvss double").withColumn("cvss", _r("cvss", 4))


@query("trimmed_cv")
def trimmed_cv(spark, sf_dir):
    return _table(spark, R.trimmed_mse(_text_rows(spark, sf_dir), 5, 5), "fold int, n double, trained double, mse double")


@query("group_regression", "WITH g AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1), base AS (SELECT m FROM g ORDER BY n DESC, p LIMIT 1), k AS (SELECT p FROM g ORDER BY n DESC, p LIMIT 1) SELECT CASE WHEN p = (SELECT p FROM k) THEN '(constant)' ELSE 'o_orderpriority=' || p END AS name, round(CASE WHEN p = (SELECT p FROM k) THEN m ELSE m - (SELECT m FROM base) END, 4) AS coefficient FROM g")
def group_regression(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderpriority").select("o_orderpriority", F.col("o_totalprice").alias("y"), F.array().cast("array<double>").alias("x"))
    rows, names = R.group_columns(orders, "o_orderpriority")
    return _table(spark, R.ols(rows, names), "name string, coefficient double").withColumn("coefficient", _r("coefficient", 4))


@query("poisson_groups", "WITH g AS (SELECT l_returnflag AS p, ln(avg(l_quantity)) AS m, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT p, m FROM g ORDER BY n DESC, p LIMIT 1) SELECT CASE WHEN g.p = k.p THEN '(constant)' ELSE 'l_returnflag=' || g.p END AS name, round(CASE WHEN g.p = k.p THEN g.m ELSE g.m - k.m END, 6) AS coefficient FROM g, k")
def poisson_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_quantity", "l_returnflag").select("l_returnflag", F.col("l_quantity").alias("y"), F.array().cast("array<double>").alias("x"))
    rows, names = R.group_columns(lines, "l_returnflag")
    return _table(spark, R.poisson(rows, names), "name string, coefficient double").withColumn("coefficient", _r("coefficient"))


@query("indicator_regression", f"WITH v AS (SELECT value AS y, event_id % 7 - 2.0 AS raw FROM events WHERE value IS NOT NULL), {_moments(['x', 'x_seen'], 'SELECT y, CASE WHEN raw > 0 THEN raw ELSE (SELECT avg(raw) FROM v WHERE raw > 0) END AS x1, CASE WHEN raw > 0 THEN 1.0 ELSE 0.0 END AS x2 FROM v')}, {_fit(2)} {_coefficients(['x', 'x_seen'], 5)}")
def indicator_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "value").where("value is not null").select(F.col("value").alias("y"), (F.col("event_id") % 7 - 2.0).alias("x"))
    return _slopes(spark, R.indicator_ols(rows, ["x"]), 5)


@query("leverages", "WITH c AS (SELECT count(*)::DOUBLE AS n, avg(p_size) AS a, avg(p_retailprice) AS b FROM part), s AS (SELECT sum((p_size - a) ** 2) AS aa, sum((p_size - a) * (p_retailprice - b)) AS ab, sum((p_retailprice - b) ** 2) AS bb FROM part, c) SELECT p_partkey AS i, round(1 / n + (bb * (p_size - a) ** 2 - 2 * ab * (p_size - a) * (p_retailprice - b) + aa * (p_retailprice - b) ** 2) / (aa * bb - ab * ab), 5) AS leverage FROM part, c, s")
def leverages(spark, sf_dir):
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select(F.col("p_partkey").alias("i"), F.array(F.lit(1.0), F.col("p_size").cast("double"), "p_retailprice").alias("x"))
    return L.leverages(rows, 3).select("i", _r("leverage", 5).alias("leverage"))


_poly = lambda c, x: "(" * (len(c) - 1) + repr(c[0]) + "".join(f" * {x} + {v!r})" for v in c[1:])
_tail = lambda p: f"({_poly(Q.TAIL, f'sqrt(-2 * ln({p}))')} / {_poly(Q.TAIL_BELOW, f'sqrt(-2 * ln({p}))')})"


@query("normal_scores", f"WITH n AS (SELECT c_acctbal AS value, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1), p AS (SELECT value, n, (sum(n) OVER (ORDER BY value) - n / 2) / (SELECT sum(n) FROM n) AS p FROM n) SELECT value, n, round(CASE WHEN p < {Q.TAIL_AT} THEN {_tail('p')} WHEN p > {1 - Q.TAIL_AT} THEN -{_tail('(1 - p)')} ELSE (p - 0.5) * {_poly(Q.MIDDLE, '((p - 0.5) * (p - 0.5))')} / {_poly(Q.MIDDLE_BELOW, '((p - 0.5) * (p - 0.5))')} END, 6) AS q FROM p")
def normal_scores(spark, sf_dir):
    return R.normal_scores(table(spark, sf_dir, "customer", "c_acctbal"), "c_acctbal").withColumn("q", _r("q"))


@query("autocorrelation", "SELECT lag::INT AS lag, round(corr(a.value, b.value), 6) AS r FROM range(1, 4) t(lag) JOIN events a ON true JOIN events b ON b.event_id = a.event_id + lag GROUP BY 1")
def autocorrelation(spark, sf_dir):
    return R.autocorrelation(table(spark, sf_dir, "events", "event_id", "value"), "event_id", "value", 3).select("lag", _r("r").alias("r"))


# --- decompositions of two columns

_TWO = "x AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)"
_ROOTS = "SELECT (p + q) / 2 + sqrt(((p - q) / 2) ** 2 + o * o) AS hi, (p + q) / 2 - sqrt(((p - q) / 2) ** 2 + o * o) AS lo FROM g"


def _two(spark, sf_dir) -> DataFrame:
    return _points(spark, sf_dir).select(F.col("id").alias("i"), F.slice("x", 1, 2).alias("x"))


@query("svd_two_columns", f"WITH {_TWO}, g AS (SELECT sum(a * a) AS p, sum(b * b) AS q, sum(a * b) AS o FROM x), e AS ({_ROOTS}) SELECT 0 AS k, round(sqrt(hi), 6) AS d FROM e UNION ALL SELECT 1, round(sqrt(lo), 6) FROM e")
def svd_two_columns(spark, sf_dir):
    _, d, _ = L.exact_svd(_two(spark, sf_dir), 2, 2)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(d)], "k int, d double").withColumn("d", _r("d"))


@query("random_svd_two_columns", f"WITH {_TWO}, g AS (SELECT sum(a * a) AS p, sum(b * b) AS q, sum(a * b) AS o FROM x), e AS ({_ROOTS}) SELECT 0 AS k, round(sqrt(hi), 5) AS d FROM e UNION ALL SELECT 1, round(sqrt(lo), 5) FROM e")
def random_svd_two_columns(spark, sf_dir):
    cells = _two(spark, sf_dir).select("i", F.posexplode("x").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")
    _, d, _ = L.randomized_svd(cells, 2)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(d)], "k int, d double").withColumn("d", _r("d", 5))


@query("pca_two_columns", f"WITH {_TWO}, g AS (SELECT var_samp(a) AS p, var_samp(b) AS q, covar_samp(a, b) AS o FROM x), e AS ({_ROOTS}) SELECT 0 AS k, round(hi, 6) AS variance FROM e UNION ALL SELECT 1, round(lo, 6) FROM e")
def pca_two_columns(spark, sf_dir):
    w, _ = L.principal_components(_two(spark, sf_dir), 2, 2)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "k int, variance double").withColumn("variance", _r("variance"))


@query("centred_comparison", f"WITH {_TWO}, g AS (SELECT sum(a * a) AS p, sum(b * b) AS q, sum(a * b) AS o FROM x), e AS ({_ROOTS}), h AS (SELECT var_pop(a) * count(*) AS p, var_pop(b) * count(*) AS q, covar_pop(a, b) * count(*) AS o FROM x), f AS ({_ROOTS.replace('FROM g', 'FROM h')}) SELECT 1 AS place, round(sqrt(e.hi), 6) AS plain, round(sqrt(f.hi), 6) AS centred FROM e, f UNION ALL SELECT 2, round(sqrt(e.lo), 6), round(sqrt(f.lo), 6) FROM e, f")
def centred_comparison(spark, sf_dir):
    return _table(spark, L.centred_comparison(_two(spark, sf_dir), 2, 2), "place int, plain double, centred double").select("place", _r("plain").alias("plain"), _r("centred").alias("centred"))


@query("cca_one_by_one", f"WITH {_TWO} SELECT round(abs(corr(a, b)), 6) AS correlation FROM x")
def cca_one_by_one(spark, sf_dir):
    rows = _two(spark, sf_dir).select(F.slice("x", 1, 1).alias("a"), F.slice("x", 2, 1).alias("b"))
    r, _, _ = L.canonical_correlations(rows, "a", "b", 1, 1)
    return spark.createDataFrame([(float(r[0]),)], "correlation double").withColumn("correlation", _r("correlation"))


@query("cca_one_by_two", "WITH c AS (SELECT corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS a, corr(embedding[1]::DOUBLE, embedding[3]::DOUBLE) AS b, corr(embedding[2]::DOUBLE, embedding[3]::DOUBLE) AS o FROM embeddings) SELECT round(sqrt((a * a + b * b - 2 * a * b * o) / (1 - o * o)), 6) AS correlation FROM c")
def cca_one_by_two(spark, sf_dir):
    rows = _points(spark, sf_dir).select(F.slice("x", 1, 1).alias("a"), F.slice("x", 2, 2).alias("b"))
    r, _, _ = L.canonical_correlations(rows, "a", "b", 1, 2)
    return spark.createDataFrame([(float(r[0]),)], "correlation double").withColumn("correlation", _r("correlation"))


@query("subspace_agreement", "SELECT 4 AS directions, 4 AS high, 1.0::DOUBLE AS share")
def subspace_agreement(spark, sf_dir):
    """Four columns span what four combinations of them do."""
    x = F.col("x")
    mixed = F.array(x[0] + x[1], x[1] - x[2], x[2] * 2, x[3] + x[0])
    rows = _points(spark, sf_dir).select(F.slice("x", 1, 4).alias("a"), mixed.alias("b"))
    return _table(spark, [L.subspace_agreement(rows, "a", "b", 4, 4)], "directions int, high int, share double")


def _identity(name: str, k: int, features) -> None:
    @query(name, f"SELECT i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS g FROM range({k}) a(i), range({k}) b(j)")
    def one(spark, sf_dir):
        g = np.abs(L.gram(features(spark, sf_dir), k))
        return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(k) for j in range(k)], "i int, j int, g double").withColumn("g", _r("g"))


_identity("lsa_orthonormal", 6, lambda spark, sf_dir: P.lsa(_docs(spark, sf_dir), 3, "b", n_projections=6)["features"])


@query("top_loadings", f"WITH {_TWO}, v AS (SELECT 0 AS component, i, a AS v FROM x UNION ALL SELECT 1, i, b FROM x UNION ALL SELECT -1, i, a * a + b * b FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(v) DESC, i)::INT AS place FROM v) SELECT component, place, i, round(v, 6) AS v FROM r WHERE place <= 5")
def top_loadings(spark, sf_dir):
    return L.top_loadings(_two(spark, sf_dir), 2, [0, 1], 5).select("component", "place", "i", _r("v").alias("v"))


@query("column_squares", f"WITH {_TWO} SELECT 0 AS k, round(sum(a * a), 6) AS ss FROM x UNION ALL SELECT 1, round(sum(b * b), 6) FROM x")
def column_squares(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(L.column_squares(_two(spark, sf_dir), 2))), "k int, ss double").withColumn("ss", _r("ss"))


# --- clusters


def _again(name: str, before: str, dims: int = 64) -> str:
    """CTEs of one Lloyd step after an assignment near(id, cluster, d2)."""
    centres = f"c{name} AS (SELECT cluster, list(v ORDER BY k) AS x FROM (SELECT cluster, k, avg(x[k]) AS v FROM {before} JOIN p USING (id), range(1, {dims + 1}) t(k) GROUP BY 1, 2) GROUP BY 1)"
    d2 = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"{centres}, near{name} AS (SELECT id, cluster, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cluster) AS r FROM (SELECT p.id, c.cluster, {d2} AS d2 FROM p CROSS JOIN c{name} c)) WHERE r = 1)"


@query("kmeans_two_updates", f"WITH {KM}, {_again('1', 'near')}, {_again('2', 'near1')} SELECT id, cluster, round(d2, 5) AS d2 FROM near2")
def kmeans_two_updates(spark, sf_dir):
    pts = _points(spark, sf_dir).select("id", "x")
    return C.fit(pts, 8, most=3).assign(pts).select("id", "cluster", _r("d2", 5).alias("d2"))


@query("kmeans_weighted_step", f"WITH {KM}, e AS (SELECT cluster, id % 3 + 1 AS w, x FROM near JOIN p USING (id)) SELECT cluster, sum(w)::DOUBLE AS w, round(sum(w * x[1]) / sum(w), 6) AS x0, round(sum(w * x[64]) / sum(w), 6) AS x63 FROM e GROUP BY 1")
def kmeans_weighted_step(spark, sf_dir):
    pts, centres = _start(spark, sf_dir)
    sums, w = C.centre_sums(pts.select("x", (F.col("id") % 3 + 1).alias("w")), centres)
    rows = [(k, float(w[k]), float(sums[k, 0] / w[k]), float(sums[k, 63] / w[k])) for k in range(len(w)) if w[k]]
    return spark.createDataFrame(rows, "cluster int, w double, x0 double, x63 double").select("cluster", "w", _r("x0").alias("x0"), _r("x63").alias("x63"))


def _weighted(spark, sf_dir) -> DataFrame:
    pts, centres = _start(spark, sf_dir)
    return C.assign(pts.select("id", "x", (F.col("id") % 3 + 1).alias("w")), centres)


@query("within_variance", f"WITH {KM}, v AS (SELECT sum((id % 3 + 1) * d2) / sum(id % 3 + 1) AS v FROM near GROUP BY cluster) SELECT round(avg(v), 6) AS variance FROM v")
def within_variance(spark, sf_dir):
    return C.within_variance(_weighted(spark, sf_dir)).select(_r("variance").alias("variance"))


@query("overall_summary", f"WITH {KM}, m AS (SELECT list(v ORDER BY k) AS g FROM (SELECT k, avg(x[k]) AS v FROM p, range(1, 65) t(k) GROUP BY 1)), d AS (SELECT id, sqrt(list_sum(list_transform(list_zip(x, g), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS far FROM p, m) SELECT round(avg(far), 6) AS to_mean, round(avg(sqrt(d2)), 6) AS to_centre, round(sum((id % 3 + 1) * sqrt(d2)) / sum(id % 3 + 1), 6) AS weighted, round(max(sqrt(d2)), 6) AS furthest FROM near JOIN d USING (id)")
def overall_summary(spark, sf_dir):
    out = C.overall_summary(_weighted(spark, sf_dir), 64)
    return out.select(*[_r(c).alias(c) for c in out.columns])


@query("rare_cases", f"WITH {KM} SELECT cluster, (id % 3 + 1) AS w, count(*) AS n FROM near WHERE id % 3 + 1 IN (1, 2) GROUP BY 1, 2")
def rare_cases(spark, sf_dir):
    return C.rare_cases(_weighted(spark, sf_dir))


@query("sums_of_squares", f"WITH {KM}, e AS (SELECT cluster, k, x[k] AS v FROM near JOIN p USING (id), range(1, 65) t(k)), t AS (SELECT sum(q) AS totss FROM (SELECT var_pop(v) * count(*) AS q FROM e GROUP BY k)), w AS (SELECT sum(q) AS withinss FROM (SELECT var_pop(v) * count(*) AS q FROM e GROUP BY cluster, k)) SELECT round(totss, 5) AS totss, round(withinss, 5) AS withinss, round(totss - withinss, 5) AS betweenss FROM t, w")
def sums_of_squares(spark, sf_dir):
    out = C.sums_of_squares(_weighted(spark, sf_dir), 64)
    return out.select(*[_r(c, 5).alias(c) for c in out.columns])


@query("cluster_members", f"WITH {KM}, r AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY id) AS k FROM near) SELECT cluster, count(*) AS n, string_agg(id, ' ' ORDER BY id) FILTER (k <= 4) AS members FROM r GROUP BY 1")
def cluster_members(spark, sf_dir):
    pts, centres = _start(spark, sf_dir)
    out = C.cluster_members(C.assign(pts.select("id", "x"), centres), 4)
    return out.select("cluster", "n", F.array_join(F.transform("members", lambda v: v.cast("string")), " ").alias("members"))


# --- rows, columns and files


@query("head_tail_split", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) <= 500 AS train FROM orders) SELECT train, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM r GROUP BY 1")
def head_tail_split(spark, sf_dir):
    return E.head_tail_split(table(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", 500).groupBy("train").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("first_and_last_rows", "SELECT * FROM ((SELECT 'first' AS side, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20) UNION ALL (SELECT 'last', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20))")
def first_and_last_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    return E.first_rows(orders, "o_orderkey", 20).select(F.lit("first").alias("side"), "o_orderkey").unionByName(E.last_rows(orders, "o_orderkey", 20).select(F.lit("last").alias("side"), "o_orderkey"))


@query("lines_from_third_character", "SELECT conv_id, turn, substr(text, 3) AS text FROM conversations")
def lines_from_third_character(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", T.from_char(F.col("text"), 3).alias("text"))


@query("match_counts", "WITH w AS (SELECT source AS word FROM documents), t AS (SELECT DISTINCT lang AS type FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) SELECT type, count(word) AS n FROM t LEFT JOIN w ON word = type GROUP BY 1")
def match_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "lang", "source")
    types = d.select(F.col("lang").alias("type")).unionByName(d.select(F.col("source").alias("type"))).where("type is not null")
    return E.match_counts(d.select(F.col("source").alias("word")), types)


@query("missing_sample", "WITH d AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS type FROM documents), m AS (SELECT type, row_number() OVER (ORDER BY type) AS n FROM d WHERE type NOT IN (SELECT 'the')) SELECT type FROM m WHERE (n - 1) % 128 = 0")
def missing_sample(spark, sf_dir):
    vocab = V.tokens(_docs(spark, sf_dir)).select(F.col("tok").alias("type"))
    return D.missing_sample(vocab, spark.createDataFrame([("the",)], "type string"))


_ORDERED = "l_orderkey, l_linenumber"


@query("matrix_files", "SELECT count(*) AS n, round(sum(l_extendedprice * l_quantity), 2) AS xy, round(sum(l_quantity * l_tax), 4) AS xz FROM lineitem")
def matrix_files(spark, sf_dir):
    """Three matrices written as files of other shapes, read and aligned."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")
    read = []
    for k, c in enumerate(("l_extendedprice", "l_quantity", "l_tax")):
        path = shared_dir(spark, f"matrix-{c}")
        sinks.write_tsv(lines.repartitionByRange(k + 2, "l_orderkey", "l_linenumber").sortWithinPartitions("l_orderkey", "l_linenumber").select(c), path)
        read.append(text_sources.matrix(spark, path, [c]))
    m = text_sources.aligned(*read).select(F.col("x0")[0].alias("y"), F.col("x1")[0].alias("q"), F.col("x2")[0].alias("t"))
    return m.agg(F.count("*").alias("n"), _r(F.sum(F.col("y") * F.col("q")), 2).alias("xy"), _r(F.sum(F.col("q") * F.col("t")), 4).alias("xz"))


_FLAT = "regexp_replace(coalesce(text, ''), '[\\n\\r]', ' ', 'g')"


@query("corpus_file", f"SELECT round(n_chars::DOUBLE, 3) AS y, count(*) AS n, sum(len(list_filter(regexp_split_to_array({_FLAT}, '[ \\t\\x0B\\f]+'), lambda x: x <> '')))::BIGINT AS tokens FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def corpus_file(spark, sf_dir):
    """Documents written as lines with their response first, and read back."""
    docs = table(spark, sf_dir, "documents", "text", "n_chars").where("n_chars is not null")
    path = shared_dir(spark, "corpus")
    sinks.lines(docs.select(F.concat_ws(" ", F.col("n_chars").cast("string"), F.regexp_replace(F.coalesce("text", F.lit("")), "[\\n\\r]", " ")).alias("value")), path)
    back = text_sources.corpus(spark, path, True)
    return back.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.size(T.tokens(F.col("text")))).cast("long").alias("tokens"))


@query("tagged_file", "WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS type, coalesce(lang, 'none') AS pos FROM documents) SELECT pos, count(*) AS n, count(DISTINCT type) AS types FROM t GROUP BY 1")
def tagged_file(spark, sf_dir):
    """Tagged tokens written as a stream of pairs, and read back."""
    docs = table(spark, sf_dir, "documents", "text", "lang")
    pairs = F.transform(T.tokens(F.col("text")), lambda t: F.concat(t, F.lit(" "), F.coalesce(F.col("lang"), F.lit("none"))))
    path = shared_dir(spark, "tagged")
    sinks.lines(docs.select(F.array_join(pairs, " ").alias("value")), path)
    return text_sources.tagged_tokens(spark, path).groupBy("pos").agg(F.count("*").alias("n"), F.count_distinct("type").alias("types"))


@query("vector_file", "SELECT 'w' || vec_id AS type, embedding[1]::DOUBLE AS x, embedding[64]::DOUBLE AS y FROM embeddings")
def vector_file(spark, sf_dir):
    """Word vectors written with names in quotes, and read back."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    rows = e.select(F.concat_ws(" ", F.concat(F.lit('"w'), F.col("vec_id").cast("string"), F.lit('"')), *[F.col("embedding")[d].cast("string") for d in range(64)]).alias("value"))
    head = spark.createDataFrame([("name " + " ".join(f"c{d}" for d in range(64)),)], "value string")
    path = shared_dir(spark, "vectors")
    sinks.lines(head.unionByName(rows).coalesce(1), path)
    back = text_sources.quoted_vectors(spark, path)
    exact = lambda d: F.col("vec")[d].cast("float").cast("double")
    return back.select("type", exact(0).alias("x"), exact(63).alias("y"))


@query("frequency_order", "WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS tok FROM documents), f AS (SELECT tok, count(*) AS n FROM t GROUP BY 1), k AS (SELECT CASE WHEN n < 3 THEN 'OOV' ELSE tok END AS type, sum(n)::BIGINT AS freq FROM f GROUP BY 1) SELECT type, freq FROM k")
def frequency_order(spark, sf_dir):
    """Type frequencies as the commands write them, read back."""
    vocab = V.Vocabulary(_docs(spark, sf_dir), 0, False, 3)
    path = shared_dir(spark, "freq")
    sinks.write_tsv(vocab.frequencies().select("type", "freq"), path, header=False)
    return text_sources.counts_tsv(spark, path).select("type", F.col("n").alias("freq"))


@query("distinct_topics")
def distinct_topics(spark, sf_dir):
    from tessera.operators import simulate as S

    docs = S.corpus(spark, 200, np.ones(4) * 0.2, S.topics(4, 300, 0.1, 7), np.arange(4.0), 20, seed=7)
    return S.topics_used(docs).groupBy("n_topics").agg(F.count("*").alias("n"))


@query("document_centroid_squares", "SELECT round(sum(n::DOUBLE * n), 2) AS ss FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS t FROM documents) GROUP BY 1)")
def document_centroid_squares(spark, sf_dir):
    """B 1 through the product of triplets and rows: squares of row sums."""
    v = V.Vocabulary(_docs(spark, sf_dir), 0, False, 3)
    cells = N.scaled_rows(N.document_rows(v.ids), "w", None)
    ones = v.types.select(F.col("idx").cast("long").alias("i"), F.array(F.lit(1.0)).alias("x"))
    return L.times_rows(cells, ones, 1).agg(_r(F.sum(F.col("x")[0] * F.col("x")[0]), 2).alias("ss"))
