"""op3, op5, op8, op10 and the pipeline against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, minmax_dedup, mixing, topk
from tessera.llm.components import components

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def shingles(text, n):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    return {i: top(i) for i, _ in sets}


def near_corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = [str(x) for x in rng.choice(vocab, int(rng.integers(20, 160)))]
        for c in range(int(rng.integers(1, 9))):
            words = list(base)
            for at in rng.integers(0, len(words), c // 2):
                words[at] = str(rng.choice(vocab))
            rows.append(" ".join(words))
    rows += ["", None, "  \n", "one", "ONE", "one two", "one  two", "two one", rows[0], rows[0].upper()]
    return [(int(k), t) for k, t in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_classes_equal_brute_force(spark, n, percent):
    rows = near_corpus()
    df = spark.createDataFrame([(k, t, 7) for k, t in rows] + [(None, "one", 7)], "doc_id long, text string, component_id int")
    out = minmax_dedup.near_classes(df, n, percent).collect()
    want = classes(rows, n, percent)
    got = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    assert len(out) == len(rows) + 1 and got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out if r["doc_id"] is not None)
    assert {r["doc_id"]: r["n_shingles"] for r in out if r["doc_id"] is not None} == {k: len(shingles(t, n)) for k, t in rows}


def test_blocks_of_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "BLOCK", 4)
    rows = near_corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minmax_dedup.near_classes(df, 3, 85).collect()} == classes(rows, 3, 85)


def test_no_documents_no_classes(spark):
    assert minmax_dedup.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(1, 2), (3, 2), (7, 8), (9, 8), (10, 9), (4, 4)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got[3] == 1 and got[10] == 7 and got[140] == 100 and 4 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [None, "a", "b", "é", "z"][int(rng.integers(0, 5))] if k % 3 else "a", " ".join(["w"] * int(rng.integers(0, 900))), 5) for k in range(200)]
    rows += [(500, "b", None, 5), (501, "empty", "  ", 5), (1, "a", "again and again", 5), (1, "a", "again and again", 5), (None, "a", "no id", 5), (502, "a", "v " * 5000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    size = {}
    for _, s, t, _ in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        left, free = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped), [s for s in order if s not in capped]
        over = {s for s in free if weight[s] * left / sum(weight[x] for x in free) > 2 * size[s]}
        if not over:
            break
        capped |= over
    want = {s: 2 * size[s] if s in capped else weight[s] * left / sum(weight[x] for x in free) for s in order}
    source = {}
    for k, s, t, _ in rows:
        source.setdefault((k, len(WORD.findall(t or ""))), s)
    taken = {}
    for r in out:
        s = source[r["doc_id"], r["size"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == size[s]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)


def test_mixed_texts_hold_the_words_taken(spark):
    rows = [(k, "ab"[k % 2], " ".join(f"d{k}w{j}" for j in range(k * 37 % 700))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    words = {k: t.split() for k, _, t in rows}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    got = {}
    for r in mixing.mixed_texts(df).collect():
        mine = r["text"].split()
        at = [words[r["doc_id"]].index(w) for w in mine]
        assert at == sorted(set(at))
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(mine)
    assert got == {k: n for k, n in taken.items() if n}


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long")).alias("x"))
        assert sorted(r[0] for r in df.collect()) == list(range(n))


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df).count() == 0
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, "a", "")], df.schema)).collect()] == [(1, 0, 0, 0.0, 0, None, None)]


@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_topk_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)).round(1)
    x[40:80] = x[40]
    rows = [(k, x[k].tolist()) for k in range(120)] + [(200, None), (201, [1.0, None] + [0.0] * 4), (202, [float("nan")] * 6), (250, [float("inf")] * 6), (7, x[3].tolist()), (None, x[0].tolist())]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<float>, score string")
    good = [(k, np.floor(256 * np.float32(v).astype(float)).astype(int)) for k, v in rows[:120] + [rows[124]]]
    want = []
    for q, v in good[:120]:
        if q % 50 == 0:
            best = sorted(((-int(v @ w), k) for k, w in good if k != q))[:5]
            want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(best)]
    got = topk.search(df, F.col("vec_id") % 50 == 0, 5, block).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == want
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_with_few_and_huge(spark):
    df = spark.createDataFrame([(0, [1e5, 2.0]), (1, [3e5, 1.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    got = topk.search(df, F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 25600000 * 76800000 + 512 * 256), (2, 25600000 * 256)]


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_edited_texts_and_likeness(spark, partitions):
    rng = np.random.default_rng(4)
    rows = [(int(k) * 10, " ".join(str(w) for w in rng.integers(0, 50, int(rng.integers(0, 80))))) for k in rng.permutation(60)] + [(5, None), (6, ""), (7, "ééé ü"), (10, "a repeat of ten"), (None, "last of all")]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_chars int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = fingerprints.compare_next(df, with_text=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (k, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), e))
    key = lambda r: (str(r[0]), r[2])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["edited_text"]) for r in out), key=key) == sorted(want, key=key)
    single = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).where("doc_id <> 10").collect()}
    assert all(single[r["doc_id"]] == r["fingerprint"] for r in out if r["doc_id"] not in (10, None))
    assert fingerprints.compare_next(df.limit(0)).count() == 0


def test_likeness_estimates_jaccard():
    f = fingerprints.Family()
    a = " ".join(f"w{k}" for k in range(600))
    b = " ".join(f"w{k}" if k < 480 else f"x{k}" for k in range(600))
    x, y = (shingle_set(t) for t in (a, b))
    assert abs(fingerprints.likeness(*f.prints([a, b])) - len(x & y) / len(x | y)) < 0.12
    assert fingerprints.likeness(*f.prints([a, a])) == 1 and fingerprints.likeness(*f.prints([a, "q r s"])) < 0.05


def shingle_set(t):
    w = t.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_near_groups_by_the_fingerprint_s_own_bands(spark):
    rows = [(k, t) for k, t in near_corpus(5) if t is None or t == t.lower()]
    extra = [(None, "one two", 7), (rows[0][0], rows[0][1], 7)]
    df = spark.createDataFrame([(k, t, 7) for k, t in rows] + extra, "doc_id long, text string, bands int")
    out = fingerprints.near_groups(df).collect()
    assert len(out) == len(rows) + 2
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == classes(rows, 5, 80)
    assert fingerprints.near_groups(df.limit(0)).count() == 0


def test_likeness_of_each_row_against_exact_jaccard(spark):
    rows = [(k, t) for k, t in near_corpus(6) if t and len(t.split()) > 30]
    out = fingerprints.compare_next(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    text, order = dict(rows), sorted(dict(rows), reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    jaccard = lambda a, b: len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))
    for r in out:
        assert abs(r["near_edited"] - jaccard(text[r["doc_id"]], r["edited_text"])) < 0.2
        assert abs(r["near_next"] - jaccard(text[r["doc_id"]], text[following[r["doc_id"]]])) < 0.2


def test_many_rows_without_an_id_fill_several_ranges(spark):
    df = spark.createDataFrame([(None, f"t{k}") for k in range(300)] + [(1, "x")], "doc_id long, text string")
    assert fingerprints._ranged(df).where("not copy").select("range").distinct().count() > 2
    assert fingerprints.compare_next(df).count() == 301


def test_hot_sets_are_met_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "HOT_LEAST", 2)
    rows = [(k, "same words here and now") for k in range(20)] + [(k, f"other words {k // 2} here to stay") for k in range(20, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minmax_dedup.near_classes(df, 3, 85).collect()} == classes(rows, 3, 85)


def test_shards_take_the_slots_that_were_drawn_for_them(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 4)
    monkeypatch.setattr(mixing, "RUN", 16)
    rows = [(k, "abc"[k % 3] if k % 5 else None, "w " * (k * 53 % 900)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = mixing.place(df)
    placed, sources, slots = mixing.plan(sized)
    counts = {(r["number"], r["shard"]): r["count"] for r in mixing.shard_counts(sources.where("want > 0"), 4).collect()}
    total = {r["number"]: (r["slots"], r["shards"], r["want"]) for r in sources.collect()}
    for n, (size, shards, _) in total.items():
        mine = [c for (m, _), c in counts.items() if m == n]
        assert sum(mine) == size and len(mine) <= shards and shards > 5
        assert max(mine) < size / shards + 6 * (size / shards) ** 0.5 + 3
    got = {}
    for r in slots.collect():
        got.setdefault((r["number"], r["shard"]), set()).add(r["slot"])
    # all but slots past the target are there, and each shard's are consecutive
    assert all(len(s) <= counts[k] and max(s) - min(s) == len(s) - 1 for k, s in got.items())
    words = {}
    for r in mixing.mixed_blocks(df).collect():
        words[r["number"]] = words.get(r["number"], 0) + r["n"]
        assert 0 <= r["place"] < mixing.BLOCK and r["place"] + r["n"] <= mixing.BLOCK
        assert r["slot"] in got[r["number"], r["shard"]]
    assert words == {n: w for n, (_, _, w) in total.items()}
    spread = mixing.mix(df).where("first_shard < last_shard").count()
    assert spread > 0


def test_pipeline_stages(spark):
    import os

    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rng = np.random.default_rng(9)
    noise = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(n))) for n in rng.integers(2, 9, 60))
    finnish = "Suomen kieli on uralilainen kieli, jota puhutaan pääasiassa Suomessa. Se on toinen maan virallisista kielistä."
    extra = spark.createDataFrame([(9001, None, None, None, 0), (9002, "12 34 !!", "en", "src0", 8), (9003, noise, None, "src0", 8), (9004, finnish, None, "src0", 8)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs.unionByName(extra), d)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept.columns == list(corpus_pipeline.COLUMNS) and kept.count() == docs.count()
    one = stages["near_duplicates"](spark, docs, d)
    want = classes([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == set(want.values())
    clean = stages["toxicity"](spark, docs, d)
    assert 0.5 * docs.count() < clean.count() <= docs.count()
    assert stages["packing"](spark, docs.limit(20), d).count() >= 20


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline

    rows = [(1, "one text of some words here", "en", "s", 5, 0), (1, "another text that has other words", "en", "s", 5, 0), (1, "one text of some words here", "en", "s", 5, 0), (2, "one text of some words here", "en", "s", 5, 0), (None, "no id", "en", None, 5, 0), (3, None, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    one = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert sorted(map(str, one.select("doc_id", "text").collect())) == sorted(map(str, docs.where("doc_id is null or doc_id = 1 or doc_id = 3").select("doc_id", "text").distinct().collect()))


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
