"""Whole analyses, as functions over frames and as commands over files.

    python -m tessera.plans.programs lsa_regr --file corpus.txt --has_y -a b -r 50 -o out

Each function takes frames and returns frames (or lists of model steps); the
commands read files, call it and write tab-separated folders.
"""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import cluster as C
from tessera.operators import counts as N
from tessera.operators import dictionary as D
from tessera.operators import linalg as L
from tessera.operators import regression as R
from tessera.operators.tagged import TaggedTokens, ambiguity
from tessera.operators.vocab import Texts, Vocabulary, indexed_arrays
from tessera.session import cut
from tessera.sources import sinks, text_sources


def _cells(dtm: DataFrame) -> DataFrame:
    return dtm.select(F.col("doc_id").alias("i"), F.col("idx").cast("long").alias("j"), "v")


def _counts(vocab: Vocabulary, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Written counts of documents as rows, and the same as triplets."""
    rows = cut(N.document_rows(vocab.ids if ids is None else ids), "dtm")
    return rows, N.row_cells(rows)


def _scaled(rows: DataFrame, dtm: DataFrame, types: DataFrame, how: str) -> DataFrame | L.Packed:
    """Scaled counts of the documents that types come from."""
    return N.scaled_rows(rows, how, N.frequencies(types)) if how in "wrcbn" else cut(_cells(N.scale_documents(dtm, how)), "cells")


def _with_rows(docs: DataFrame, dtm: DataFrame, rows: DataFrame, k: int, log_y: bool) -> DataFrame:
    """(doc_id, y, m, x) for regression; documents without features get zeros."""
    y = F.log("y") if log_y else F.col("y")
    lengths = N.document_lengths(dtm)
    feats = rows.select(F.col("i").alias("doc_id"), "x")
    return docs.select("doc_id", y.alias("y")).join(lengths, "doc_id").join(feats, "doc_id", "left").withColumn("x", F.coalesce("x", F.array_repeat(F.lit(0.0), k)))


def lsa(docs: DataFrame, min_frequency: int = 3, adjustment: str = "w", quadratic: bool = False, use_log: bool = False, power_iter: int = 0, n_projections: int = 50, random_seed: int = 77777) -> dict:
    """LSA features of docs(doc_id, y, text) by randomised SVD of the scaled
    counts, and the sequence of regressions of y (if there is one) on log
    length and features. Quadratic mode projects the products of all pairs of
    scaled types and has no singular values."""
    vocab = Vocabulary(docs, 0, False, min_frequency)
    types = vocab.types
    counted, dtm = _counts(vocab)
    out = {"vocab": vocab, "types": types, "dtm": dtm}
    cells = _scaled(counted, dtm, types, adjustment)
    if quadratic:
        q = L.quadratic_range(cells, n_projections, power_iter, random_seed)
        out |= {"features": cut(q, "lsa"), "d": None, "v": None}
    else:
        u, d, v = L.randomized_svd(cells, n_projections, power_iter, random_seed)
        out |= {"features": cut(u, "lsa"), "d": d, "v": v}
    if "y" in docs.columns:
        rows = _with_rows(docs, dtm, out["features"], n_projections, use_log)
        out["rows"] = rows
        out["steps"] = R.sequence_r2(rows, [f"L{k}" for k in range(n_projections)])
    return out


def bigram_features(docs: DataFrame, min_frequency: int = 3, adjustment: str = "w", power_iter: int = 0, n_projections: int = 50, random_seed: int = 77777, bigram_skip: int = 0) -> dict:
    """Documents as count-weighted means of their types' bigram directions:
    D^-1 W P, with P a random range of the scaled bigram counts."""
    vocab = Vocabulary(docs, 0, True, min_frequency)
    types = vocab.types
    counted, dtm = _counts(vocab)
    pairs = N.bigram_rows(vocab.ids, bigram_skip)
    cells = N.scaled_bigram_rows(cut(pairs, "bigrams") if power_iter else pairs, adjustment, N.frequencies(types))
    p = L.random_range(cells, n_projections, power_iter, random_seed)
    a = L.times_rows(N.scaled_rows(counted, "n", None), p, n_projections)
    out = {"types": types, "dtm": dtm, "directions": p, "features": cut(a, "bigram")}
    if "y" in docs.columns:
        rows = _with_rows(docs, dtm, out["features"], n_projections, True)
        out |= {"rows": rows, "steps": R.sequence_r2(rows, [f"B{k}" for k in range(n_projections)])}
    return out


def vocab_bigrams(vocab: Vocabulary, types: DataFrame, skip: int = 0) -> DataFrame:
    return N.bigram_counts(vocab.ids, types, skip)


def bigram_sides(docs: DataFrame, min_frequency: int = 3, power_iter: int = 0, n_projections: int = 50, random_seed: int = 77777) -> dict[str, tuple]:
    """Left and right directions of raw, left-, right- and both-scaled bigrams:
    name -> (u rows, d, v rows)."""
    vocab = Vocabulary(docs, 0, True, min_frequency)
    types = vocab.types
    cells = cut(vocab_bigrams(vocab, types), "bigrams")
    return {name: L.randomized_svd(N.scale_bigrams(cells, types, how), n_projections, power_iter, random_seed) for name, how in (("raw", "w"), ("left", "left"), ("right", "right"), ("sym", "b"))}


def regressor(docs: DataFrame, min_frequency: int = 3, bigram_skip: int = 0, bidirectional: bool = False, power_iter: int = 0, n_projections: int = 50, random_seed: int = 77777, n_words: int = 3000, vocab_docs: DataFrame | None = None) -> dict:
    """Regressions of log y on the leading word columns, with the parsed
    attributes, LSA and bigram features beside them. Vocabulary and bigrams
    come from vocab_docs(doc_id, text) where given, else from docs."""
    vocab, types, counted, dtm = _two_corpora(docs, vocab_docs, min_frequency)
    names = [r["type"] for r in types.where(F.col("idx") < n_words).orderBy("idx").collect()]
    k = len(names)
    words = cut(L.dense_rows(_cells(N.scale_documents(dtm, "w")), k), "words")
    rows = _with_rows(docs, dtm, words, k, True)
    cells = N.scale_bigrams(vocab_bigrams(vocab, types, bigram_skip), types, "b")
    p = L.random_range(cells, n_projections, power_iter, random_seed)
    centroid = L.times_rows(_cells(N.entropy_weighted(dtm)), p, n_projections)
    out = {"vocab": vocab, "types": types, "dtm": dtm, "rows": rows, "steps": R.sequence_r2(rows, names), "parsed": docs.select("doc_id", *numeric.parse_all(F.col("text"))), "bigram": centroid}
    if bidirectional:
        q = L.random_range(L.flip(cells), n_projections, power_iter, random_seed + 1)
        out["bigram_right"] = L.times_rows(_cells(N.entropy_weighted(dtm)), q, n_projections)
    out["lsa"] = L.randomized_svd(_cells(N.scale_documents(dtm, "b")), n_projections, power_iter, random_seed)[0]
    return out


def _two_corpora(docs: DataFrame, vocab_docs: DataFrame | None, min_frequency: int) -> tuple[Vocabulary, DataFrame, DataFrame, DataFrame]:
    """(vocabulary of one corpus, its types, counts of the other's documents by
    rows and as triplets)."""
    vocab = Vocabulary(docs if vocab_docs is None else vocab_docs, 0, True, min_frequency)
    ids = vocab.ids if vocab_docs is None else indexed_arrays(Texts(docs, 0, True), vocab.types)
    return vocab, vocab.types, *_counts(vocab, ids)


def unified(docs: DataFrame, min_frequency: int = 3, bigram_skip: int = 0, power_iter: int = 0, n_projections: int = 50, random_seed: int = 77777, vocab_docs: DataFrame | None = None) -> dict:
    """Features from [F^-1/2 B F^-1/2 | F^-1/2 W'] together: P its random
    range, scaled back by F^-1/2, and A = W P with rows of W summing to one.
    Vocabulary and bigrams come from vocab_docs where given."""
    vocab, types, counted, dtm = _two_corpora(docs, vocab_docs, min_frequency)
    runs = N.frequencies(types)
    cells = L.Beside(N.scaled_bigram_rows(cut(N.bigram_rows(vocab.ids, bigram_skip), "bigrams"), "b", runs), L.flip(N.scaled_rows(counted, "n", runs, over_types=True)), types.count())
    p = L.random_range(cells, n_projections, power_iter, random_seed)
    f = types.select(F.col("idx").cast("long").alias("i"), F.sqrt("freq").alias("s"))
    p = p.join(f, "i").select("i", F.transform("x", lambda v: v / F.col("s")).alias("x"))
    a = cut(L.times_rows(N.scaled_rows(counted, "n", None), p, n_projections), "unified")
    out = {"vocab": vocab, "types": types, "dtm": dtm, "directions": p, "features": a}
    if "y" in docs.columns:
        rows = _with_rows(docs, dtm, a, n_projections, True)
        out |= {"rows": rows, "steps": R.sequence_r2(rows, [f"U{k}" for k in range(n_projections)])}
    return out


def seq_regression(rows: DataFrame, first: list[str], names: list[str], folds: int = 0, seed: int = 2837, key: str = "row_id") -> list[dict]:
    """rows(row_id, y, x): x holds the columns `first`, then `names`. A random
    rotation of rows would change none of these figures and is left out."""
    return R.validated_sequence(rows, first, names, folds, seed, key)


def cluster_types(tagged: DataFrame, skip: int = 0, threshold: float = 0.0, bidirectional: bool = False, projections: int = 30, scale_data: bool = False, weight_centroid: bool = False, clusters: int = 100, scale_centroid: bool = False, iterations: int = 10, seed: int = 77777, validation: DataFrame | None = None, toks: DataFrame | Texts | None = None) -> dict:
    """Types clustered by projected bigram rows and used as a tagger, scored by
    a confusion matrix; a validation corpus is projected with the same random
    columns and classified by the nearest centre. toks: the tokens of tagged as
    arrays (doc_id, toks) in its order, if there are any; they needn't be
    gathered then."""
    tm = TaggedTokens(tagged, threshold, toks, written=True)
    types = cut(tm.types, "types")
    pairs = cut(N.bigram_rows(N.as_ids(tm.arrays(), types), skip), "bigrams")
    cells = N.scaled_bigram_rows(pairs, "w", None)
    rows = L.plain_projection(cells, projections, seed, bidirectional).select(F.col("i").alias("id"), "x")
    if weight_centroid:
        rows = rows.join(pairs.groupBy(F.col("i").cast("long").alias("id")).agg(F.sum(F.aggregate("ns", F.lit(0.0), lambda a, n: a + n)).alias("w")), "id")
    rows = cut(rows, "projected")
    model = C.fit(rows, clusters, bidirectional, scale_data, scale_centroid, iterations)
    assigned = cut(model.assign(rows), "assigned")
    named = assigned.join(types.select(F.col("idx").cast("long").alias("id"), "type"), "id").join(tm.majority.select("type", "pos"), "type")
    classifier = C.ClusterClassifier.of(named)
    out = {"ambiguity": ambiguity(tm.counts), "model": model, "assigned": assigned, "summary": C.cluster_summary(assigned), "classifier": classifier, "confusion": classifier.confusion(tm.counts), "score": classifier.score(tm.counts), "margins": tm.counts}
    if validation is not None:
        vm = TaggedTokens(validation, threshold)
        own = cut(vm.types, "types")
        # columns keep the training indices, so the random columns are the same
        vcells = N.cross_bigrams(vm.arrays(), own, types, skip).select("i", "j", F.col("n").cast("double").alias("v"))
        if bidirectional:
            half = projections // 2
            back = N.cross_bigrams(vm.arrays(), own, types, skip, transpose=True).select("i", "j", F.col("n").cast("double").alias("v"))
            zeros = F.array_repeat(F.lit(0.0), half)
            a = L.random_image(back, half, seed).select("i", F.col("x").alias("a"))
            b = L.random_image(vcells, half, seed + 1).select("i", F.col("x").alias("b"))
            vrows = a.join(b, "i", "full").select(F.col("i").alias("id"), F.concat(F.coalesce("a", zeros), F.coalesce("b", zeros)).alias("x"))
        else:
            vrows = L.random_image(vcells, projections, seed).select(F.col("i").alias("id"), "x")
        placed = model.assign(vrows).join(own.select(F.col("idx").cast("long").alias("id"), "type"), "id").select("type", "cluster")
        tagger = C.ClusterClassifier(placed, classifier.labels)
        out |= {"validation_confusion": tagger.confusion(vm.tagged), "validation_score": tagger.score(vm.tagged)}
    return out


def encode_replies(replies: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(doc_id, found, vec) of replies(doc_id, toks): centroids of the tokens'
    vectors, with vectors(line_no, type, vec) read as a dictionary."""
    toks = replies.select("doc_id", F.explode_outer("toks").alias("tok"))
    vocab = toks.where("tok is not null").select(F.col("tok").alias("type")).distinct()
    return D.centroids(toks, D.restrict(vectors, vocab, dims), dims)


def feature_sweep(rows: DataFrame, first_sizes: list[int], n_columns: int, folds: int = 10, seed: int = 2837) -> list[dict]:
    """Cross-validated squares by size of the base block and features added:
    one set of fold sums serves every size."""
    parts = R.fold_grams(rows, n_columns, folds, seed)
    out = []
    for size in first_sizes:
        held = [R._grow(parts.sum(0) - p, size, n_columns) for p in parts]
        for step in range(n_columns - size + 1):
            ss = 0.0
            for p, models in zip(parts, held, strict=True):
                beta = models[step][2]
                ss += p[1, 1] - 2 * beta @ np.delete(p[1], 1) + beta @ np.delete(np.delete(p, 1, 0), 1, 1) @ beta
            out.append({"base": size, "added": step, "cvss": float(ss)})
    return out


# --- commands


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="program", required=True)

    def program(name: str, *options: str, **defaults) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        known = {
            "file": ("-i", "--file", {}), "text_file": ("-t", "--text_file", {}), "regr_file": ("-i", "--regr_file", {}), "vocab_file": ("-v", "--vocab_file", {}),
            "min_frequency": ("-f", "--min_frequency", {"type": int, "default": 3}), "adjustment": ("-a", "--adjustment", {"default": "w"}), "quadratic": ("-q", "--quadratic", {"action": "store_true"}),
            "has_y": ("-y", "--has_y", {"action": "store_true"}), "use_log": ("-l", "--use_log", {"action": "store_true"}), "power_iter": ("-p", "--power_iter", {"type": int, "default": 0}),
            "n_projections": ("-r", "--n_projections", {"type": int, "default": 50}), "random_seed": ("-s", "--random_seed", {"type": int, "default": 77777}), "output_path": ("-o", "--output_path", {"default": "."}),
            "bigram_skip": ("-k", "--bigram_skip", {"type": int, "default": 0}), "bidirectional": ("-b", "--bidirectional", {"action": "store_true"}),
            "n_words": ("-w", "--n_words", {"type": int, "default": 3000}),
        }
        for o in options:
            short, long, how = known[o]
            p.add_argument(short, long, **how)
        return p

    common = ("min_frequency", "power_iter", "n_projections", "random_seed", "output_path")
    program("lsa_regr", "file", "adjustment", "quadratic", "has_y", "use_log", *common)
    program("bigram_regr", "file", "adjustment", *common)
    program("bigram", "text_file", *common)
    program("regressor", "vocab_file", "regr_file", "bigram_skip", "bidirectional", "n_words", *common)
    program("unified_regressor", "vocab_file", "regr_file", "bigram_skip", *common)
    s = program("seq_regression")
    for short, long, how in (("-n", "--n", {"type": int}), ("-Y", "--y_file", {}), ("-i", "--n_i", {"type": int, "default": 0}), ("-I", "--i_file", {}), ("-x", "--n_x", {"type": int, "default": 0}), ("-X", "--x_file", {}), ("-v", "--folds", {"type": int, "default": 0}), ("-s", "--seed", {"type": int, "default": 2837}), ("-r", "--rotate", {"action": "store_true"}), ("-o", "--output_file", {"default": "results"})):
        s.add_argument(short, long, **how)
    c = program("cluster")
    for short, long, how in (("-i", "--file", {}), ("-k", "--skip", {"type": int, "default": 0}), ("-t", "--threshold", {"type": float, "default": 0.0}), ("-b", "--bidirectional", {"action": "store_true"}), ("-r", "--projections", {"type": int, "default": 30}), ("-s", "--scale_data", {"action": "store_true"}), ("-w", "--weight_centroid", {"action": "store_true"}), ("-c", "--clusters", {"type": int, "default": 100}), ("-C", "--scale_centroid", {"action": "store_true"}), ("-n", "--iterations", {"type": int, "default": 10}), ("-p", "--print", {"type": int, "default": 0}), ("-v", "--validation", {"default": None}), ("-o", "--output_path", {"default": "."})):
        c.add_argument(short, long, **how)
    a = program("reply_encoder", "file", "output_path")
    a.add_argument("-V", "--vectors")
    a.add_argument("-d", "--dims", type=int, required=True)
    program("porter", "file", "output_path")
    return top


def _vocabulary_files(vocab: Vocabulary, path: str) -> None:
    """Type frequencies and the first 200 types that OOV stands for."""
    sinks.frequencies(vocab.types, f"{path}/type_freq")
    sinks.first_oov(vocab.oov, 200, f"{path}/oov")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName(f"tessera-{o.program}").getOrCreate()
    common = {k: getattr(o, k) for k in ("min_frequency", "power_iter", "n_projections", "random_seed") if hasattr(o, k)}
    if o.program == "lsa_regr":
        docs = text_sources.corpus(spark, o.file, o.has_y)
        docs = docs if o.has_y else docs.drop("y")
        out = lsa(docs, adjustment=o.adjustment, quadratic=o.quadratic, use_log=o.use_log, **common)
        base = f"{o.output_path}/{'lsaq' if o.quadratic else 'lsa'}_{o.adjustment}_{o.n_projections}_p{o.power_iter}"
        _vocabulary_files(out["vocab"], o.output_path)
        sinks.word_columns(out["dtm"], out["types"], 7500, f"{o.output_path}/word_counts")
        if out["d"] is None:
            sinks.matrix(out["features"], o.n_projections, "L", f"{base}_u", "i")
        else:
            sinks.svd(out["features"], out["d"], out["v"], o.n_projections, base)
        if o.has_y:
            sinks.responses(out["rows"], f"{o.output_path}/lsa_ym")
            sinks.steps(spark, out["steps"], f"{base}_steps")
    elif o.program == "bigram_regr":
        if o.adjustment not in ("w", "r", "c", "n", "b"):
            raise SystemExit(f"no adjustment {o.adjustment}; one of w r c n b")
        out = bigram_features(text_sources.corpus(spark, o.file, True), adjustment="w" if o.adjustment == "n" else o.adjustment, **common)
        sinks.responses(out["rows"], f"{o.output_path}/bigram_ym")
        sinks.matrix(out["features"], o.n_projections, "B", f"{o.output_path}/bigram_{o.adjustment}_{o.n_projections}_p{o.power_iter}", "i")
        sinks.steps(spark, out["steps"], f"{o.output_path}/bigram_steps")
    elif o.program == "bigram":
        docs = text_sources.corpus(spark, o.text_file, True).select("doc_id", "text")
        for name, (u, _, v) in bigram_sides(docs, **common).items():
            sinks.matrix(u, o.n_projections, "U", f"{o.output_path}/u_{name}", "i")
            sinks.matrix(v, o.n_projections, "V", f"{o.output_path}/v_{name}", "i")
    elif o.program in ("regressor", "unified_regressor"):
        docs = text_sources.corpus(spark, o.regr_file, True)
        common["vocab_docs"] = text_sources.corpus(spark, o.vocab_file).select("doc_id", "text") if o.vocab_file else None
        if o.program == "regressor":
            out = regressor(docs, bigram_skip=o.bigram_skip, bidirectional=o.bidirectional, n_words=o.n_words, **common)
            sinks.write_tsv(out["parsed"], f"{o.output_path}/parsed")
            sinks.matrix(out["lsa"], o.n_projections, "L", f"{o.output_path}/LSA_{o.n_projections}", "i")
            sinks.matrix(out["bigram"], o.n_projections, "B", f"{o.output_path}/bigram_{o.n_projections}_{o.bigram_skip}", "i")
        else:
            out = unified(docs, bigram_skip=o.bigram_skip, **common)
            sinks.responses(out["rows"], f"{o.output_path}/unified_y_m")
            sinks.matrix(out["features"], o.n_projections, "U", f"{o.output_path}/unified_svd_{o.n_projections}", "i")
        _vocabulary_files(out["vocab"], o.output_path)
        sinks.steps(spark, out["steps"], f"{o.output_path}/steps")
    elif o.program == "seq_regression":
        names, blocks = [], []
        for path, most in ((o.i_file, o.n_i), (o.x_file, o.n_x)):
            own = text_sources.header(spark, path)[:most] if path else []
            names.append(own)
            blocks.append(text_sources.matrix(spark, path, text_sources.header(spark, path)).select("row_id", F.slice("x", 1, len(own)).alias("x")) if path else None)
        y = text_sources.matrix(spark, o.y_file, text_sources.header(spark, o.y_file))
        rows = text_sources.aligned(y, *[b for b in blocks if b is not None])
        if o.n is not None and rows.count() != o.n:
            raise SystemExit(f"{rows.count()} rows, not {o.n}")
        rows = rows.select("row_id", F.col("x0")[0].alias("y"), F.concat(F.array().cast("array<double>"), *[f"x{k}" for k in range(1, len(rows.columns) - 1)]).alias("x"))
        sinks.steps(spark, seq_regression(rows, names[0], names[1], o.folds, o.seed), o.output_file)
    elif o.program == "cluster":
        val = text_sources.tagged_tokens(spark, o.validation) if o.validation else None
        out = cluster_types(text_sources.tagged_tokens(spark, o.file), o.skip, o.threshold, o.bidirectional, o.projections, o.scale_data, o.weight_centroid, o.clusters, o.scale_centroid, o.iterations, validation=val)
        for name in ("summary", "confusion", "score"):
            sinks.write_tsv(out[name], f"{o.output_path}/{name}")
        sinks.tag_margins(out["margins"], f"{o.output_path}/margins")
        sinks.centres(spark, out["model"].centres, out["summary"], f"{o.output_path}/centres")
        if o.print:
            out["summary"].orderBy(F.desc("n")).show(o.print)
    elif o.program == "reply_encoder":
        out = encode_replies(text_sources.replies(spark, o.file), text_sources.plain_vectors(spark, o.vectors), o.dims)
        sinks.matrix(out.withColumnRenamed("vec", "x"), o.dims, "c", f"{o.output_path}/centroids", "doc_id", "found")
    else:
        from tessera.functions.stem import stem_text

        sinks.lines(stem_text(spark.read.text(o.file), "value"), f"{o.output_path}/stemmed")


if __name__ == "__main__":
    main()
