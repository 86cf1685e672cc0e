"""op2, op4 and op9: ids, files, packing and counts against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import huffman, packing, token_counts
from tessera.llm.wordbpe import WordBpe, tokenizer_path
from tessera.llm.words import Held, slices

TEXTS = ["", None, " ", "a", "The  cat's 12 naïve cafés!\n\tOK", "x" * 3000, "<|endoftext|> and <|startoftext|>s", "漢字 テスト é é", "don't WE'LL 'S", "a\x00b\x1cc\x85d e f", "ÀÉ ß ÿ × ÷ Ÿ İ ſ", "word " * 5000, "▁x ▁ ▁▁y", "tail ", "  lead", "a  b   c", "a\nb\n\n c", "<s> </s> <unk> <0x0A>", "🙂🙂 ok"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "ignored", k) for k, t in enumerate(TEXTS)] + [(3, "again", "x", 1), (None, "no id", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start long")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_word_bpe_equals_the_library(library):
    bpe = WordBpe(tokenizer_path())
    assert bpe.plain
    rng = random.Random(4)
    alphabet = "aabcdesltvrm''''  .,;-\t\n09AZSTÀÉßÿ÷×<|>_日é́\x1c "
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for texts in (TEXTS, odd, ["<", "|x", "'", "s", "É"], []):
        got = bpe.encode(pa.array(texts, pa.string()))
        for t, ids in zip(texts, got, strict=True):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    assert [x.tolist() for x in bpe.encode(pa.array([None, "a"]), 7)] == [[7], [*library.encode("a", add_special_tokens=False).ids, 7]]
    bpe.plain = False
    assert [x.tolist() for x in bpe.encode(pa.array(TEXTS))] == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_word_bpe_survives_small_memories(library):
    bpe = WordBpe(tokenizer_path(), most=500)
    for t in TEXTS:
        assert bpe.encode(pa.array([t]))[0].tolist() == library.encode(t or "", add_special_tokens=False).ids
    assert bpe.ids.held <= 500 or len(bpe.ids) == 1


def test_what_workers_keep_is_bounded_and_of_one_operator():
    a, b = Held(1000), Held(1000)
    a.claim()
    for k in range(100):
        a.keep(b"%d" % k, b"x")
        assert a.held <= 1000
    b.claim()
    assert not a and a.held == 0


def test_slices_hold_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "x" * 50, "", "de"])], names=["text"])
    got = [x.column(0).to_pylist() for x in slices([batch], most=5)]
    assert [t for x in got for t in x] == batch.column(0).to_pylist()
    assert all(len(x) == 1 or sum(len(t or "") for t in x) <= 5 for x in got)


def test_piece_counts_equal_the_library(spark, docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(docs).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 3}
    for k, t in enumerate(TEXTS):
        if k != 3:
            assert by[k]["n_tokens"] == len(sp.encode(t or "")), t
            assert by[k]["n_bytes"] == len((t or "").encode()) and by[k]["over_limit"] == (by[k]["n_tokens"] > 4096)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_counts_hold_over_many_slices(spark, docs, monkeypatch):
    want = sorted(map(str, token_counts.count_tokens(docs).collect()))
    monkeypatch.setattr(token_counts, "SLICE", 20)
    assert sorted(map(str, token_counts.count_tokens(docs.repartition(3, "doc_id")).collect())) == want
    doubled = token_counts.count_tokens(docs.unionByName(docs).repartition(5, "doc_id", "text")).collect()
    assert sorted(map(str, doubled)) == sorted(want * 2)


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    counts = np.zeros(1 << 16, np.int64)
    counts[:2000] = (1e6 / np.arange(1, 2001) ** 1.5).astype(int) + 1
    for limit in (11, 14, 18):
        n = huffman.code_lengths(counts, limit)
        used = n[n > 0].astype(float)
        assert len(used) == 2000 and used.max() <= limit and abs((2.0**-used).sum() - 1) < 1e-12
    p = counts[counts > 0] / counts.sum()
    assert (huffman.code_lengths(counts) * counts).sum() / counts.sum() < -(p * np.log2(p)).sum() + 0.1
    assert huffman.code_lengths(np.zeros(10, np.int64)).sum() == 0
    one = np.zeros(10, np.int64)
    one[4] = 7
    assert huffman.code_lengths(one).tolist() == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)
    assert rng is not None


@pytest.mark.parametrize("sizes", [[0], [1], [5, 0, 300], [129, 128, 127, 1000]])
def test_block_round_trip(sizes):
    rng = np.random.default_rng(1)
    docs = [rng.zipf(1.3, n).clip(max=40000).astype(np.uint16) for n in sizes]
    n = huffman.code_lengths(np.bincount(np.concatenate(docs), minlength=1 << 16) + (np.arange(1 << 16) == 9))
    data = huffman.encode_block([None, *range(len(sizes) - 1)], docs, huffman.canonical(n), n)
    keys, got, ids = huffman.decode_block(data, huffman.decode_table(n))
    assert keys == [None, *range(len(sizes) - 1)] and got.tolist() == sizes and (ids == np.concatenate(docs)).all()
    with pytest.raises(ValueError):
        huffman.decode_block(b"x" * 64, huffman.decode_table(n))


def test_files_round_trip(spark, docs, library, tmp_path):
    out = f"file://{tmp_path}/files"
    huffman.write(docs, out)
    got = huffman.read(spark, out, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got][0] is None and [r["doc_id"] for r in got][1:] == sorted([*range(len(TEXTS)), 3])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"]
        if r["doc_id"] not in (3, None):
            assert np.frombuffer(r["ids"], "<u2").tolist() == library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids + [1]


def test_files_of_an_empty_table(spark, docs):
    assert huffman.encode_and_read(docs.limit(0)).collect() == []


def _covered(rows, ids):
    """Each id in exactly one piece, sequences gapless and at most 4096 long."""
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for k, full in ids.items():
        at = 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(full)
            assert r["ids_crc32"] == zlib.crc32(np.array(full[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(full)
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0


def test_packing_covers_every_id_once(spark, docs, library):
    rows = packing.pack(docs.where("doc_id <> 3").coalesce(1), unit_tokens=2000, with_ids=True).collect()
    _covered(rows, {k: library.encode(t or "", add_special_tokens=False).ids + [2] for k, t in enumerate(TEXTS) if k != 3})
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs.where("doc_id is null or doc_id = 3")).count() >= 3


def test_step_groups_are_balanced():
    sizes = [4096] * 40 + [256] * 160 + [1024] * 20
    loads = {}
    for s, g in zip(sizes, packing.step_groups(sizes, 1 << 15), strict=True):
        loads[g] = loads.get(g, 0) + s
    assert max(loads.values()) - min(loads.values()) <= 4096
