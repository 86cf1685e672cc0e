"""Tagged tokens: (seq, type, pos) rows with part-of-speech tags or any labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.counts import bigram_counts, cross_bigrams
from tessera.operators.vocab import Texts, ranked
from tessera.session import cut

OTHER = "OTH"


def tag_counts(tagged: DataFrame) -> DataFrame:
    """(pos, n)."""
    return tagged.groupBy("pos").agg(F.count("*").alias("n"))


def type_tag_counts(tagged: DataFrame) -> DataFrame:
    """(type, pos, n)."""
    return tagged.groupBy("type", "pos").agg(F.count("*").alias("n"))


def collapse_tags(tagged: DataFrame, threshold: float) -> DataFrame:
    """Tags whose share of all tokens is under the threshold become OTH."""
    counts = tag_counts(tagged)
    share = counts.crossJoin(counts.agg(F.sum("n").alias("total"))).where(F.col("n") / F.col("total") < threshold).select(F.col("pos").alias("rare"))
    return tagged.join(share, F.col("pos") == F.col("rare"), "left").withColumn("pos", F.when(F.col("rare").isNotNull(), F.lit(OTHER)).otherwise(F.col("pos"))).drop("rare")


def majority_tags(counts: DataFrame) -> DataFrame:
    """(type, pos, n): each type's most frequent tag; of equals the smallest."""
    best = counts.groupBy("type").agg(F.max("n").alias("n"))
    return counts.join(best, ["type", "n"]).groupBy("type", "n").agg(F.min("pos").alias("pos")).select("type", "pos", "n")


def tags_of_types(counts: DataFrame) -> DataFrame:
    """(type, tags): tags with counts, least frequent first."""
    return counts.groupBy("type").agg(F.sort_array(F.collect_list(F.struct("n", "pos"))).alias("tags"))


def ambiguity(counts: DataFrame) -> DataFrame:
    """One row: n_tokens, n_ambiguous (tokens whose type has a commoner tag) and
    purity in percent."""
    per = counts.groupBy("type").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    both = per.agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") - F.col("top")).alias("n_ambiguous"))
    return both.withColumn("purity", 100 * (1 - F.col("n_ambiguous") / F.col("n_tokens")))


def rare_type_histogram(counts: DataFrame, most: int = 5) -> DataFrame:
    """(freq, types): how many types occur once, twice, ..."""
    per = counts.groupBy("type").agg(F.sum("n").alias("freq"))
    return per.where(F.col("freq") <= most).groupBy("freq").agg(F.count("*").alias("types"))


def rare_type_tags(counts: DataFrame, most: int = 2) -> DataFrame:
    """(freq, pos, types): majority tags of the rarest types, common first."""
    per = counts.groupBy("type").agg(F.sum("n").alias("freq")).where(F.col("freq") <= most)
    return per.join(majority_tags(counts).select("type", "pos"), "type").groupBy("freq", "pos").agg(F.count("*").alias("types")).orderBy("freq", F.desc("types"), "pos")


def common_types(counts: DataFrame, k: int = 10) -> DataFrame:
    per = counts.groupBy("type").agg(F.sum("n").alias("freq"))
    return per.orderBy(F.desc("freq"), F.desc("type")).limit(k)


def unseen_types(tagged: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct types of `other` that `tagged` doesn't have."""
    return other.select("type").distinct().join(tagged.select("type").distinct(), "type", "left_anti")


def group_proportions(rows: DataFrame) -> DataFrame:
    """(grp, type, p): a type's share of the tokens of its group."""
    n = rows.groupBy("grp", "type").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("grp").agg(F.sum("n").alias("total")), "grp").select("grp", "type", (F.col("n") / F.col("total")).alias("p"))


@dataclass
class TaggedTokens:
    """A tagged corpus (seq, type, pos), as frames that compute when asked. Where
    its types are at hand as arrays (doc_id, toks) in order of seq, bigrams read
    these. written: counts are written once, for all that is made from them."""

    rows: DataFrame
    threshold: float = 0.0
    toks: DataFrame | Texts | None = None
    written: bool = False

    def __post_init__(self) -> None:
        self.tagged = collapse_tags(self.rows, self.threshold) if self.threshold > 0 else self.rows
        self.counts = type_tag_counts(self.tagged)
        if self.written:
            self.counts = cut(self.counts, "tags")
        freq = self.counts.groupBy("type").agg(F.sum("n").alias("freq"))
        self.types = ranked(freq)
        self.majority = majority_tags(self.counts)

    def input_length(self) -> int:
        return self.tagged.count()

    def n_types(self) -> int:
        return self.types.count()

    def n_tags(self) -> int:
        return self.tagged.select("pos").distinct().count()

    def type_freq(self, word: str) -> int:
        return self.counts.where(F.col("type") == word).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def tag_freq(self, pos: str) -> int:
        return self.tagged.where(F.col("pos") == pos).count()

    def known_type(self, word: str) -> bool:
        return self.type_freq(word) > 0

    def tags(self) -> DataFrame:
        return tag_counts(self.tagged).orderBy(F.desc("n"), "pos")

    def n_types_oov(self, other: TaggedTokens) -> int:
        return unseen_types(self.tagged, other.tagged).count()

    def arrays(self, run: int = 1 << 14) -> DataFrame | Texts:
        """Tokens in runs of seq, as the arrays that bigram counts read."""
        if self.toks is not None:
            return self.toks
        grp = F.floor(F.col("seq") / run).cast("long")
        return self.tagged.groupBy(grp.alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "type"))), lambda s: s["type"]).alias("toks"))

    def bigrams(self, skip: int = 0, other: TaggedTokens | None = None, transpose: bool = False) -> DataFrame:
        if other is None and not transpose:
            return bigram_counts(self.arrays(), self.types, skip)
        return cross_bigrams(self.arrays(), self.types, (other or self).types, skip, transpose)


def top_windows(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent tags of every type, with their place."""
    w = Window.partitionBy("type").orderBy(F.desc("n"), "pos")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
