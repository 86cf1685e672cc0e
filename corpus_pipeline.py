"""A training corpus from `documents`, in five stages: language, toxicity, near
duplicates, source weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; run() writes each to the shared folder and reads it
back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, minmax_dedup, mixing, packing, toxicity
from tessera.session import drop_path, shared_dir
from tessera.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document has no known language if it is less like its nearest profile than
#: this share of the median over the documents nearest to that profile.
LEAST_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Texts without letters go, and those far less
    like their nearest profile than its documents usually are: noise, and
    languages that no profile is of. The medians are over all rows. A null lang
    becomes the one found; a given one stays."""
    docs = docs.select(*COLUMNS)
    profiles = language_id.learn(docs)
    # predicted once for the medians and once for the rows: cheaper than a second copy of all texts
    found = language_id.predict(docs, profiles, keep=COLUMNS).where(F.col("lang_pred") != language_id.UNKNOWN)
    usual = found.groupBy("lang_pred").agg(F.percentile_approx("lang_score", 0.5, 1000).alias("usual"))  # one row a profile
    kept = found.join(F.broadcast(usual), "lang_pred").where(F.col("lang_score") >= F.lit(LEAST_SHARE) * F.col("usual"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels, doesn't reject."""
    docs = docs.select(*COLUMNS)
    net = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, net, keep=COLUMNS).where("tox_pred = 0").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest doc_id. Where
    several rows have that doc_id, one of each different text stays; rows
    without a doc_id all stay."""
    docs = docs.select(*COLUMNS)
    classes = minmax_dedup.near_classes(docs, words=5, percent=80)
    ids = classes.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = docs.join(ids, "doc_id")
    if ids.where("rows > 1").limit(1).count():
        kept = kept.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", "digest"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix of sources: repeated, whole or in part, as the
    target weights ask."""
    return mixing.mixed_texts(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Trained models and pseudorandom draws: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote goes once the next one has
    written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
