"""Recipes: preparation, sweeps over settings and held-out evaluation, composed
from the programs. Each returns a frame with one row a setting or model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluate as E
from tessera.operators import linalg as L
from tessera.operators import regression as R
from tessera.operators.vocab import Vocabulary
from tessera.plans import programs as P


def listings(lines: DataFrame, quotes: bool = True) -> DataFrame:
    """(doc_id, y, text) of numbered lines (line_no, value) `price text...`:
    lines without text go, the rest is cleaned; y is null where the first field
    isn't a number."""
    kept = lines.where(T.is_text_line(F.col("value")))
    y = F.regexp_extract("value", "^ *([^ ]*)", 1).try_cast("double")
    rest = F.regexp_replace("value", "^ *[^ ]* ?", "")
    clean = T.clean_listing(rest) if quotes else T.chain(T.ascii_lower(rest), T.LISTING_JOINS)
    return kept.select(F.col("line_no").alias("doc_id"), y.alias("y"), clean.alias("text"))


def lsa_sweep(docs: DataFrame, adjustments: str = "wrcbt", min_frequency: int = 3, n_projections: int = 50, power_iter: int = 0, use_log: bool = True, seed: int = 77777) -> DataFrame:
    """(adjustment, r2, adj_r2, aicc, best): the last model of the regressions
    on LSA features under each scaling, and the number of models up to the one
    of smallest AICc. Counts are made once."""
    vocab = Vocabulary(docs, 0, False, min_frequency)
    counted, dtm = P._counts(vocab)
    out = []
    for how in adjustments:
        cells = P._scaled(counted, dtm, vocab.types, how)
        u, _, _ = L.randomized_svd(cells, n_projections, power_iter, seed)
        steps = R.sequence_r2(P._with_rows(docs, dtm, u, n_projections, use_log), [f"L{k}" for k in range(n_projections)])
        out.append((how, float(steps[-1].r2), float(steps[-1].adj_r2), float(steps[-1].aicc), R.best_step(steps)["place"]))
    return docs.sparkSession.createDataFrame(out, "adjustment string, r2 double, adj_r2 double, aicc double, best int")


def held_out_tagger(tagged: DataFrame, n: int, **how) -> dict:
    """A cluster tagger of the first n tokens of tagged(seq, type, pos), scored
    on the tokens after them."""
    split = E.head_tail_split(tagged, "seq", n)
    train, test = (split.where(F.col("train") == side).drop("train") for side in (True, False))
    return P.cluster_types(train, validation=test, **how)


def tagger_sweep(tagged: DataFrame, settings: list[dict]) -> DataFrame:
    """(setting, n, accuracy, purity) of cluster taggers under each setting
    (options of cluster_types)."""
    rows = []
    for s in settings:
        r = P.cluster_types(tagged, **s)["score"].first()
        rows.append((" ".join(f"{k}={v}" for k, v in sorted(s.items())), int(r["n"]), float(r["accuracy"]), float(r["purity"])))
    return tagged.sparkSession.createDataFrame(rows, "setting string, n long, accuracy double, purity double")


def validated_sizes(rows: DataFrame, sizes: list[int], n_columns: int, folds: int = 10, seed: int = 2837) -> DataFrame:
    """(base, added, cvss) of every base size and number of columns after it,
    with the smallest of each base marked."""
    swept = P.feature_sweep(rows, sizes, n_columns, folds, seed)
    best = {b: min(r["cvss"] for r in swept if r["base"] == b) for b in sizes}
    return rows.sparkSession.createDataFrame([(r["base"], r["added"], r["cvss"], r["cvss"] == best[r["base"]]) for r in swept], "base int, added int, cvss double, best boolean")
