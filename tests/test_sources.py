"""Readers, writers and commands over small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import programs as P
from tessera.sources import sinks, text_sources


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "6"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_lines_are_numbered_in_file_order(spark, tmp_path, small_splits):
    for name, n in (("b.txt", 90), ("a.txt", 7), ("c.txt", 300)):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(n)))
    got = text_sources.numbered(spark.read.text(str(tmp_path))).collect()
    want = [f"{name} {k}" for name, n in (("a.txt", 7), ("b.txt", 90), ("c.txt", 300)) for k in range(n)]
    assert {r["line_no"]: r["value"] for r in got} == dict(enumerate(want)) and len(got) == len(want)


def test_tagged_tokens_are_one_stream(spark, tmp_path, small_splits):
    rng = np.random.default_rng(0)
    toks = [f"t{k}" for k in range(601)]
    lines, at = [], 0
    while at < len(toks):
        n = int(rng.integers(0, 6))
        lines.append(" ".join(toks[at : at + n]))
        at += n
    (tmp_path / "x").write_text("\n".join(lines) + "\n")
    got = {r["seq"]: (r["type"], r["pos"]) for r in text_sources.tagged_tokens(spark, str(tmp_path / "x")).collect()}
    assert got == {k: (toks[2 * k], toks[2 * k + 1]) for k in range(300)}
    (tmp_path / "y").write_text("a\tN\nb\nc\tV\n")
    assert [tuple(r) for r in text_sources.tagged_tsv(spark, str(tmp_path / "y")).orderBy("seq").collect()] == [(0, "a", "N"), (2, "c", "V")]


def test_seq_regression_keeps_every_row(spark, tmp_path, small_splits):
    rng = np.random.default_rng(1)
    n = 400
    x, z = rng.standard_normal((n, 3)).round(3), rng.standard_normal((n, 1)).round(9)
    y = (x @ [1.0, -2.0, 0.0] + z[:, 0] + rng.standard_normal(n)).round(1)
    for name, m, head in (("y", y[:, None], ["Y"]), ("i", z, ["z0"]), ("x", x, ["x0", "x1", "x2"])):
        (tmp_path / name).write_text("\t".join(head) + "\n" + "\n".join("\t".join(map(str, r)) for r in m) + "\n")
    args = ["seq_regression", "-n", str(n), "-Y", str(tmp_path / "y"), "-i", "1", "-I", str(tmp_path / "i"), "-x", "3", "-X", str(tmp_path / "x"), "-o", str(tmp_path / "out")]
    P.main(args, spark)
    got = {r["name"]: float(r["rss"]) for r in spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out")).collect()}
    for k, name in enumerate(["(base)", "x0", "x1", "x2"]):
        a = np.c_[np.ones(n), z, x[:, :k]]
        assert abs(got[name] - ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()) < 1e-6
    with pytest.raises(SystemExit):
        P.main([*args[:2], "7", *args[3:]], spark)
    (tmp_path / "i").write_text("z0\n1\n2\n")
    with pytest.raises(ValueError):
        P.main(args, spark)


def test_vector_files(spark, tmp_path):
    (tmp_path / "q").write_text('"name" c1 c2\n"the" 1 2\n"a b" 3 4\n"' + "x" * 48 + '" 1 2\n"short" 1\n')
    got = text_sources.quoted_vectors(spark, str(tmp_path / "q")).collect()
    assert [(r["type"], r["vec"]) for r in sorted(got, key=lambda r: r["line_no"])] == [("the", [1, 2]), ("a b", [3, 4])]
    (tmp_path / "p").write_text("OOV 9 9\nThe 1 2\n")
    got = text_sources.plain_vectors(spark, str(tmp_path / "p"), True).orderBy("line_no").collect()
    assert [(r["line_no"], r["type"], r["vec"]) for r in got] == [(0, "oov", [9, 9]), (1, "the", [1, 2])]


def test_small_readers(spark, tmp_path):
    (tmp_path / "v").write_text("b a\nA b\n")
    assert {r[0] for r in text_sources.vocabulary(spark, str(tmp_path / "v"), True).collect()} == {"a", "b"}
    (tmp_path / "c").write_text("the\t5\nof\t3\n")
    assert [tuple(r) for r in text_sources.counts_tsv(spark, str(tmp_path / "c")).orderBy("type").collect()] == [("of", 3), ("the", 5)]
    (tmp_path / "s").write_text('id,InterviewerTranscript,Code0,Code1\n1,"said ""x"",\ny",3,3\n2,none,,4\n')
    got = text_sources.coded_survey(spark, str(tmp_path / "s"), 2).orderBy("id").collect()
    assert [(r["codes"], r["n_codes"]) for r in got] == [([3, 3], 1), ([4], 1)] and "\n" in got[0]["transcript"]
    (tmp_path / "r").write_text("I like  It\n\n")
    assert [r["toks"] for r in text_sources.replies(spark, str(tmp_path / "r")).orderBy("doc_id").collect()] == [["i", "like", "it"], []]
    assert text_sources.count_lines(spark, str(tmp_path / "c")) == 2 and text_sources.count_fields(spark, str(tmp_path / "c")) == 2
    (tmp_path / "y").write_text("1.5 a b\nx c\n")
    got = text_sources.corpus(spark, str(tmp_path / "y"), True).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, 1.5, "a b"), (1, None, "x c")]


def test_writers(spark, tmp_path):
    read = lambda name: ["\t".join(str(v) for v in r) for r in spark.read.option("sep", "\t").csv(str(tmp_path / name)).collect()]
    types = spark.createDataFrame([("b", 2, 0), ("a", 5, 1)], "type string, freq long, idx int")
    sinks.frequencies(types.coalesce(1), str(tmp_path / "f"))
    assert read("f") == ["5", "2"]
    sinks.first_oov(types.select("type", "freq"), 1, str(tmp_path / "o"))
    assert read("o") == ["type\tfreq", "a\t5"]
    dtm = spark.createDataFrame([(1, 0, 4), (1, 1, 1), (2, 1, 3)], "doc_id long, idx int, n long")
    sinks.word_columns(dtm, types, 2, str(tmp_path / "w"))
    assert sorted(read("w"))[:2] == ["1\t4\t1", "2\t0\t3"]
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "i long, x array<double>")
    sinks.named_vectors(rows, types, 2, str(tmp_path / "n"))
    assert "b\t1.0\t2.0" in read("n") and "a\t3.0\t4.0" in read("n")
    sinks.svd(rows, [7.0, 5.0], rows, 2, str(tmp_path / "svd"))
    assert "0\t7.0" in read("svd_d") and "1\t3.0\t4.0" in read("svd_u") and len(read("svd_v")) >= 3
    sinks.tag_margins(spark.createDataFrame([("a", "N", 3), ("b", "N", 1), ("a", "V", 1)], "type string, pos string, n long"), str(tmp_path / "m"))
    assert "a\t4" in read("m_types") and "N\t4" in read("m_tags")
    sinks.centres(spark, np.array([[3.0, 4.0]]), spark.createDataFrame([(0, 2, 1.0, 1.5)], "cluster int, n long, rms double, furthest double"), str(tmp_path / "c"))
    assert read("c")[-1].split("\t") == ["0", "2", "1.0", "1.5", "5.0", "3.0", "4.0"]
    sinks.column_stream(spark.createDataFrame([(1, 5, 2.5), (2, 6, None)], "k int, a int, b double"), {"b": "y"}, str(tmp_path / "s"), "k")
    assert [r[0] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["a", "x", "5\t6", "b", "y", "2.5"]


def test_two_corpora(spark, tmp_path):
    (tmp_path / "v").write_text("\n".join(f"red house {'big' if k % 2 else 'small'} garden" for k in range(30)))
    (tmp_path / "r").write_text("\n".join(f"{k + 1}.5 red house {'big' if k % 2 else 'odd'}" for k in range(12)))
    P.main(["regressor", "-v", str(tmp_path / "v"), "-i", str(tmp_path / "r"), "-f", "2", "-r", "2", "-o", str(tmp_path / "out")], spark)
    freq = [int(r[0]) for r in spark.read.csv(str(tmp_path / "out" / "type_freq")).collect()]
    assert sorted(freq) == [15, 15, 30, 30, 30, 30]  # the first corpus alone: EOL, big, garden, house, red, small
    parsed = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out" / "parsed"))
    assert parsed.count() == 12
    out = P.unified(text_sources.corpus(spark, str(tmp_path / "r"), True), 2, n_projections=2, vocab_docs=text_sources.corpus(spark, str(tmp_path / "v")).select("doc_id", "text"))
    assert out["types"].count() == 6 and out["features"].count() == 12


def test_cluster_command(spark, tmp_path):
    (tmp_path / "t").write_text("\n".join("the D big A house N is V red A the D dog N runs V" for _ in range(20)))
    P.main(["cluster", "-i", str(tmp_path / "t"), "-r", "4", "-c", "3", "-w", "-v", str(tmp_path / "t"), "-o", str(tmp_path / "out")], spark)
    read = lambda name: spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out" / name))
    assert read("margins_tags").agg(F.sum(F.col("n").cast("long"))).first()[0] == 160
    assert read("centres").count() == 3 and "D3" in read("centres").columns and read("score").count() == 1
