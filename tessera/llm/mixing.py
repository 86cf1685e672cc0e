"""Mixing sources to target weights (op3). DataFrame functions alone.

Words of a source, document after document, are packed into blocks of BLOCK
words (the last may be shorter). A source's target is its share by weight of
RATIO times all words, stopped at CAP times its size; it is drawn in passes
over the source's blocks, so it has a fixed number of slots. Each source's
slots are drawn to output shards by a multinomial of equal shares (draws are
hashes of seed, source and draw; they are counted in runs before they are
added up). A shard then takes its count of consecutive slots of the source.
Slot j takes the block permutation(j mod blocks) of its source, a pseudorandom
bijection of the indices (swap-or-not rounds); blocks are joined by (source,
index). The slot that reaches the target is cut, so that a source gives its
target to the word: counts per shard are random, totals are not.

Document order inside a source is by a hash of doc_id, dealt to CHUNKS chunks
so that running totals need no task that sees a whole source.

Defined results: size 0 (null, empty or blank text) takes nothing; the null
source comes last among sources; repeated rows each take their part; null
doc_ids are mixed as others; targets are 0 where no text has words; other
columns are ignored. The same rows give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

WEIGHTS, RATIO, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK, SHARD_SLOTS, RUN, CHUNKS, ROUNDS, SEED = 256, 1 << 16, 4096, 4096, 16, 41
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """source, source_size and target, one row a source. What stops at its cap
    leaves the rest to the others by weight: sources in order of cap / weight
    fill up first, so the level of the others is one running sum away."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", cycle).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    whole = Window.partitionBy()
    per = per.withColumn("rest", F.sum("source_size").over(whole) * F.lit(float(ratio)) - (F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most")))
    per = per.withColumn("open", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", F.when(F.col("rest") / F.col("open") * F.col("weight") <= F.col("most"), F.col("rest") / F.col("open")))
    level = F.coalesce(F.max("level").over(whole), F.lit(0.0))  # the first level that fits is the highest that fits
    first = F.min(F.when(F.col("level").isNotNull(), F.col("most") / F.col("weight"))).over(whole)
    per = per.withColumn("level", F.when(first.isNull(), F.lit(float("inf"))).otherwise(level))
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("most"), F.col("weight") * F.col("level")).alias("target"))


def source_number() -> Column:
    """A key for a source that is never null."""
    return F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())


def place(docs: DataFrame) -> DataFrame:
    """Rows with their size, a digest of their content, their turn in the order
    of a source and their chunk of it."""
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    sized = sized.withColumn("digest", F.xxhash64("text", "source")).withColumn("number", source_number())
    return sized.withColumn("turn", F.xxhash64("doc_id", F.lit(SEED))).withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(CHUNKS)).cast("int"))


def _permuted(j: Column, n: Column, key: Column, back: bool = False) -> Column:
    """A pseudorandom bijection of 0 <= j < n: in each round j may swap places
    with its mirror at a keyed offset, as a bit of a keyed hash of the larger
    of the two says. Every round undoes itself; back runs them in reverse."""

    def one(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, mirror), key, r + 1000), F.lit(2)) == 1, mirror).otherwise(x)

    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), j, one)


def _runs(rows: DataFrame, count: str, parts: int, *keys: str) -> DataFrame:
    """rows with (from, to): the numbers below `count` in runs of RUN, dealt over
    the tasks before they are made one by one. A number of partitions that is
    given isn't changed at run time, so a small input can't end in one task."""
    wide = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {RUN}"))))
    wide = wide.repartition(parts, *keys, "_run")
    low = F.col("_run") * RUN
    return wide.withColumn("from", low).withColumn("to", F.least(low + RUN, F.col(count)) - 1).drop("_run")


def shard_counts(sources: DataFrame, parts: int) -> DataFrame:
    """(number, shard, count, first) of sources (number, slots, shards): the
    multinomial draw of each source's slots to shards, and the first slot that
    a shard takes."""
    draws = _runs(sources.select("number", "slots", "shards"), "slots", parts, "number").select("number", "shards", F.explode(F.sequence("from", "to")).alias("draw"))
    shard = F.pmod(F.xxhash64("number", "draw", F.lit(SEED + 2)), F.col("shards"))
    counts = draws.groupBy("number", shard.alias("shard")).agg(F.count("*").alias("count"))
    upto = F.sum("count").over(Window.partitionBy("number").orderBy("shard"))  # one row a shard
    return counts.withColumn("first", upto - F.col("count"))


def plan(sized: DataFrame, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed documents, sources, slots). Placed: sized rows with `start`
    inside their source and the source's figures; slots: source number, shard,
    slot, pass, block index and the words taken from the block's start."""
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = sized.select("doc_id", "digest", "source", "number", "size", "turn", "chunk")
    sources = targets(sized, **how).withColumn("number", source_number())
    want = F.floor(F.col("target") + 0.5).cast("long")
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(BLOCK)).cast("long")).withColumn("want", want)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(F.lit(0).cast("long")))
    # slots of a source: whole passes, then as many blocks as reach the target
    shards = F.greatest(F.lit(1), F.ceil(F.sum("want").over(Window.partitionBy()) / F.lit(BLOCK * SHARD_SLOTS))).cast("long")
    sources = sources.withColumn("shards", shards).withColumn("left", F.col("want") - F.col("passes") * F.col("source_size"))
    # one slot more for a short last block; the cut below drops what isn't needed
    over = F.when(F.col("left") > 0, F.least(F.col("blocks"), F.ceil(F.col("left") / BLOCK).cast("long") + 1)).otherwise(F.lit(0))
    sources = sources.withColumn("slots", (F.col("passes") * F.col("blocks") + over).cast("long"))
    sources = cut(sources, "sources")

    chunks = sized.groupBy("number", "chunk").agg(F.sum("size").alias("chunk_size"))
    chunks = chunks.withColumn("chunk_start", F.sum("chunk_size").over(Window.partitionBy("number").orderBy("chunk")) - F.col("chunk_size"))
    inside = Window.partitionBy("number", "chunk").orderBy("turn", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    figures = chunks.select("number", "chunk", "chunk_start").join(sources.select("number", "source_size", "target"), "number")
    placed = placed.join(figures.hint("merge"), ["number", "chunk"]).withColumn("start", F.col("chunk_start") + F.col("inside"))
    placed = placed.select("doc_id", "digest", "source", "number", "size", "source_size", "target", "start")

    s = sources.where("want > 0")
    last = F.col("blocks") - 1
    key = lambda p: F.xxhash64("number", p, F.lit(SEED))
    # in the last pass: where the short block stands decides where the target is reached
    s = s.withColumn("tail", F.col("source_size") - last * BLOCK).withColumn("short_at", _permuted(last, F.col("blocks"), key("passes"), back=True))
    counts = cut(shard_counts(s, parts), "shards")
    s = s.select("number", "blocks", "passes", "left", "tail", "short_at")
    wide = _runs(counts.join(s, "number"), "count", parts, "number", "shard")
    slot = wide.withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + F.col("to"))))
    slot = slot.withColumn("pass", F.expr("slot div blocks")).withColumn("j", F.expr("slot % blocks"))
    slot = slot.withColumn("block", _permuted(F.col("j"), F.col("blocks"), key("pass")))
    before = F.col("j") * BLOCK - F.when(F.col("short_at") < F.col("j"), BLOCK - F.col("tail")).otherwise(F.lit(0))
    full = F.when(F.col("block") == last, F.col("tail")).otherwise(F.lit(BLOCK))
    words = F.when(F.col("pass") < F.col("passes"), full).otherwise(F.least(full, F.col("left") - before))
    slot = slot.withColumn("words", words).where("words > 0").select("number", "shard", "slot", "pass", "block", "words")
    return placed, sources, slot


def taken_pieces(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """Each slot's pieces of documents: doc_id, start (of the document in its
    source), slot, pass, shard, first word inside the document, words."""
    pieces = placed.where("size > 0").select("doc_id", "digest", "number", "size", "start", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}"))).alias("block"))
    both = pieces.join(slots.hint("merge"), ["number", "block"])
    low = F.greatest(F.col("start"), F.col("block") * BLOCK)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("words"))
    return both.withColumn("first", low - F.col("start")).withColumn("n", high - low).where("n > 0").select("doc_id", "digest", "number", "start", "slot", "pass", "shard", "first", "n")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the first and last shard
    that take words of it, for every row of docs(doc_id, source, text)."""
    sized = cut(place(docs).select("doc_id", "digest", "source", "number", "size", "turn", "chunk"), "sized")
    placed, sources, slots = plan(sized, **how)
    placed = cut(placed, "placed")
    took = taken_pieces(placed, slots).groupBy("number", "start").agg(F.sum("n").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    filled = placed.where("size > 0").join(took.hint("merge"), ["number", "start"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    none = F.lit(None).cast("long")
    empty = placed.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), none.alias("first_shard"), none.alias("last_shard"))
    return filled.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard").unionByName(empty)


def mixed_blocks(docs: DataFrame, **how) -> DataFrame:
    """The mix by shards: (shard, number, slot, place, doc_id, first, n), where n
    words of a document from its word `first` stand at `place` in the block
    that a shard's slot takes."""
    sized = cut(place(docs).select("doc_id", "digest", "source", "number", "size", "turn", "chunk"), "sized")
    placed, _, slots = plan(sized, **how)
    pieces = taken_pieces(cut(placed, "placed"), slots)
    return pieces.select("shard", "number", "slot", F.expr(f"(start + first) % {BLOCK}").alias("place"), "doc_id", "first", "n")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows of docs (doc_id, text, source and any others): one for
    each pass over its source that takes words of the document. A document
    taken whole keeps its text; else the text is its taken words, in their
    order, joined by spaces, and n_chars, where there is one, follows."""
    sized = cut(place(docs).select("doc_id", "digest", "source", "number", "size", "turn", "chunk"), "sized")
    placed, sources, slots = plan(sized, **how)
    placed = cut(placed, "placed")
    sizes = placed.select("number", "start", "size").where("size > 0")
    spans = taken_pieces(placed, slots).groupBy("doc_id", "digest", "number", "start", "pass").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("first", "n"))).alias("spans"))
    spans = spans.join(sizes.hint("merge"), ["number", "start"]).select(F.col("doc_id").alias("d1"), F.col("digest").alias("g1"), (F.col("n") < F.col("size")).alias("part"), "spans")
    texts = docs.withColumn("g0", F.xxhash64("text", "source"))
    # rows alike in id and content stand for each other: one of them is joined
    if sized.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "g0"])
    both = texts.join(spans.hint("merge"), (F.col("g0") == F.col("g1")) & F.col("doc_id").eqNullSafe(F.col("d1")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut_text = F.array_join(F.flatten(F.transform("spans", lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["n"].cast("int")))), " ")
    changed = {"text": F.when(F.col("part"), cut_text).otherwise(F.col("text"))}
    out = both.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
