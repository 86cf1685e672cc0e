"""Registered queries against their SQL twins on the smallest data."""

import os

import duckdb
import pytest

from tessera.plans import registry
from tessera.sources.tables import NAMES

DIR = os.environ.get("TESSERA_TEST_DIR", "/root/testdata/sf0.001")
CHECKED = ["vocab_index", "vocab_totals", "dtm_cca", "dtm_tfidf", "bigram_counts_eol", "bigram_counts_skip1", "bigrams_across_corpora", "tag_majority", "tag_ambiguity", "doc_centroids", "confusion_long", "kmeans_assign", "numeric_tokens", "clean_listing", "ols_simple"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 5) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_log_ratios_all_holds_every_language(spark, duck):
    got = registry.queries()["log_ratios_all"](spark, DIR)
    want = duck.execute(registry.oracle_sql()["log_ratios_all"])
    assert _rows(got.columns, got.collect()) == _rows([d[0] for d in want.description], want.fetchall())
    assert {r["grp"] for r in got.select("grp").collect()} > {"en", "de"}


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_imports_without_optional_parts(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert registry.FLAGSHIP in entry.queries() and not any(n.startswith("op1") for n in entry.queries())
