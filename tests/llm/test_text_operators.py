"""op1, op6 and op7: classifiers on made-up corpora, main text of small pages."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import html_text, language_id, toxicity
from tessera.llm.html_text import Page


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("<div>a <b>x</b>y<p>b&amp;c <span class=ad>buy</span> d</div>", "a xy b&c d"),
        ("<nav>m<article><p>t<p>u", "t u"),
        ('a < b <p title="x>y">c', "a < b c"),
        ('<p>x<script>var a="</p>"</script>y</p>', "xy"),
        ("<!-- a", ""),
        ("<p>a<ul><li>1<li>2</ul>t", "a 1 2 t"),
        ("<main><h1>H</h1><form>f</form><div id='comments'>c</div>z</main>o", "H z"),
        ('<div class="has-sidebar">k<div class=sidebar>s</div></div>', "k"),
        ("<header>top</header><article><header><h1>T</h1></header><p>b<br>c&nbsp;&eacute;</article><footer>f", "T b c é"),
        ("<article>one</article><aside>x</aside><article>two</article>", "one two"),
        ("<p>a<style>p{}</style></p><p hidden>h</p><div style='display: none'>n</div><table><tr><td>1<td>2</table>", "a 1 2"),
        ("<article>a<section class='comments'><article>c</article></section></article>", "a"),
    ],
)
def test_main_text(html, want):
    assert Page(html).main_text() == want


def test_repeated_branches_of_a_host_go(spark):
    rows = [(k, f"http://h.org/{k}", f"<body><div class=x>Same words on all pages</div><div class=y>text {k} {'z' * k}</div></body>", 1) for k in range(30)]
    rows += [(100, "http://solo.org/", "<body><div class=x>Only page</div></body>", 1), (101, None, None, 1), (102, "odd", "", 1), (0, "http://h.org/0", rows[0][2], 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert len(got) == 34
    text = {r["page_id"]: r["text"] for r in got}
    assert text[3] == "text 3 zzz" and text[100] == "Only page" and text[101] == text[102] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


def test_repeated_branches_inside_the_article_go(spark):
    page = lambda k: f"<body><main><article><div class=x>Same words on all pages</div><p>text {k}</p>own {k}</article></main></body>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(30)] + [(k, f"http://same.org/{k}", "<article><p>One text</p></article>") for k in range(30, 40)]
    text = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text[3] == "text 3 own 3" and text[35] == "One text"


WORDS = {"en": "the of and to in that with this from have".split(), "de": "der die und das nicht mit auf eine über ist".split(), "fr": "le la les des une dans que pour être français".split()}


def _corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        words = [str(w) for w in rng.choice(WORDS[lang], 30)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for at in rng.integers(0, 30, 3):
                words[at] = {"en": "idiotic", "de": "blödmann", "fr": "crétinou"}[lang]
        rows.append((k, " ".join(words), lang, toxic))
    return rows


def test_languages_are_told_apart(spark):
    extra = [(1001, None, "en", 0), (1002, "123 !!", "en", 0), (1003, "", None, 0), (1004, "der die das " * 200_000, None, 0), (5, "le la les", "fr", 0)]
    df = spark.createDataFrame([*_corpus(), *extra], "doc_id long, text string, lang string, score int")
    rows = language_id.identify(df).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 605
    held = [k for k, *_ in _corpus() if got[k]["held_out"]]
    truth = {k: lang for k, _, lang, _ in _corpus()}
    assert 100 < len(held) < 200 and np.mean([got[k]["lang_pred"] == truth[k] for k in held if k != 5]) > 0.99
    assert [got[k]["lang_pred"] for k in (1001, 1002, 1003, 1004)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.limit(3).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_ngram_counts_by_hand():
    keys, n = language_id.ngrams("ab a!")
    pack = lambda s: sum((ord(c) + 1 if c != "_" else 1) << 21 * (len(s) - 1 - k) for k, c in enumerate(s))
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == {pack(g): c for g, c in {"a": 2, "b": 1, "_a": 2, "ab": 1, "b_": 1, "a_": 1, "_ab": 1, "ab_": 1, "_a_": 1}.items()}


def test_out_of_place_distance_by_hand():
    m = language_id.Matcher({"x": np.array([5, 6, 7]), "y": np.array([7, 6, 9])}, 3)
    assert m.place.shape == (2, 5) and m.langs == ["x", "y"]


def _brute_ranks(text, size):
    """A text's n-grams by falling count, ties by code points, in plain loops."""
    words, counts = "".join(c if c.isalpha() else " " for c in text.lower()).split(), {}
    for w in words:
        w = f"_{w}_"
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1):
                g = w[k : k + n]
                if g != "_" and not (n == 3 and g[1] == "_"):
                    counts[g] = counts.get(g, 0) + 1
    for x, y in zip(words, words[1:], strict=False):
        assert x and y
    key = lambda g: sum((1 if c == "_" else ord(c) + 1) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return [key(g) for g in sorted(counts, key=lambda g: (-counts[g], key(g)))][:size]


def test_predictions_equal_brute_force_distances(spark):
    rows, size = _corpus(90, 3), 40
    texts = [t for _, t, _, _ in rows] + ["Ünlü şeyler 123 of-the", "x", "\U00030000\U00030001 \U0002ebf0"]
    profiles = {}
    for lang in WORDS:
        profiles[lang] = _brute_ranks(" ".join(t for _, t, x, _ in rows if x == lang), size)
    learned = language_id.learn(spark.createDataFrame([(t, x) for _, t, x, _ in rows], "text string, lang string"), size)
    assert {k: v.tolist() for k, v in learned.items()} == profiles
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(docs, learned, size).collect()}
    for k, t in enumerate(texts):
        own = _brute_ranks(t, size)
        away = {lang: sum(abs(p.index(g) - r) if g in p else size for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert got[k]["lang_pred"] == best and abs(got[k]["lang_score"] - (1 - away[best] / (size * len(own)))) < 1e-12


def test_long_texts_count_as_one_piece(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("ab cdé  .İ"), 3000))
    whole = language_id.ngrams(text)
    for size in (1, 2, 3, 7, 100, 2999):
        monkeypatch.setattr(language_id, "_CHUNK", size)
        got = language_id.ngrams(text)
        assert got[0].tolist() == whole[0].tolist() and got[1].tolist() == whole[1].tolist()


def test_toxicity_learns_and_keeps_rules(spark):
    rows = _corpus(900, 1)
    extra = [(2001, None, "en", 0), (2002, "", "en", 0), (2003, "the of " * 40_000 + "idiotic idiotic idiotic", "en", 0), (5, rows[5][1], "fr", 0)]
    docs = spark.createDataFrame([(k, t, lang, "x") for k, t, lang, _ in [*rows, *extra]], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, _, y in rows] + [(5, None), (9999, 1), (None, 1)], "doc_id long, toxic int")
    out = toxicity.classify(docs, labels).collect()
    got, truth = {r["doc_id"]: r for r in out}, {k: y for k, _, _, y in rows}
    assert len(out) == 904
    held = [k for k in truth if got[k]["held_out"]]
    assert len(held) > 200 and np.mean([got[k]["predicted"] == truth[k] for k in held]) > 0.98
    assert got[2001]["predicted"] == got[2002]["predicted"] == 0 and got[2003]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    small = toxicity.fit(docs, labels, chars=2000)
    assert small is not None and toxicity.score(docs, small).count() == 904
    assert {r["predicted"] for r in toxicity.classify(docs.limit(5), labels.limit(0)).collect()} == {0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_words_stay_packed_on_the_driver(spark, monkeypatch):
    """2,000,000 words are 24 MB as three int32 each. Peak when they came and stayed so: 47 MB; packed: 23 MB."""
    texts = ["a b a", "", "x" * 300, "One two  three\u00e9", " "]
    plain = toxicity.words_of(pa.array(texts))
    packed = toxicity.Packed([(len(w), toxicity.pack(w)) for w in plain])
    assert len(packed) == 5 and all(np.array_equal(a, b) and a.dtype == b.dtype and a.shape == b.shape for a, b in zip(packed, plain, strict=True))
    assert [len(w) for w in packed[2:]] == [len(w) for w in plain[2:]]
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 500, 5000)) + " bad" * (k % 2), "en", k % 2) for k in range(400)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").cache()
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    del rows
    docs.count()
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    tracemalloc.start()
    try:
        assert toxicity.fit(docs, labels) is not None
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        docs.unpersist()
    assert most < 36 << 20, most


def test_segments_of_long_texts_change_nothing():
    net = toxicity.Net()
    words = toxicity.words_of(pa.array([" ".join(f"w{k % 700}" for k in range(3000))]))[0]
    whole, old = net.features(words), toxicity._SEGMENT
    try:
        toxicity._SEGMENT = 256
        assert np.allclose(net.features(words), whole)
    finally:
        toxicity._SEGMENT = old


def test_pooled_features_and_scores_equal_plain_loops():
    net = toxicity.Net(3)
    texts = ["you idiotic THE-the x", "one", "", "Ärger über \u0130stanbul " * 9]
    for t, word in zip(texts, toxicity.words_of(pa.array(texts)), strict=True):
        words = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in t.lower()).split()
        assert len(words) == len(word)
        x = [net.embed[w].sum(0) for w in word] + [np.zeros(toxicity.DIM, np.float32)] * 2
        pooled = []
        for c in net.conv:
            for f in range(toxicity.FILTERS):
                pooled.append(max((sum(float(x[at + j] @ c[j][:, f]) for j in range(len(c))) for at in range(len(word))), default=-np.inf))
        assert np.allclose(net.features(word), pooled, atol=1e-4)
        if words:
            z = sum(max(p + b, 0) * o for p, b, o in zip(pooled, net.bias, net.out, strict=True)) + net.last
            assert abs(net.probability(word) - 1 / (1 + np.exp(-z))) < 1e-4
    same = toxicity.words_of(pa.array(["abcdX abcdY", "abcdx"]))
    assert same[0][0, 2] == same[0][1, 2] and (same[0][0] == same[1][0]).all()


def test_importance_equals_brute_force_entropy(spark):
    import math

    rng = np.random.default_rng(2)
    page = lambda k: "<body><div class='a b c d e f'>" + "".join(f"<p>{rng.integers(0, 6)}</p>" for _ in range(int(rng.integers(1, 4)))) + f"</div><article><h1>t{k}</h1><p>same</p></article></body>"
    html = [page(k) for k in range(20)]
    rows = [(k, f"http://h.org/{k}", h) for k, h in enumerate(html)]
    got = {r["node"]: (r["m"], r["importance"]) for r in html_text.node_importance(html_text._host(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    pages = [Page(h) for h in html]
    nodes = {n for p in pages for _, ns, *_ in p.blocks for n in ns[1:]}
    for node in nodes:
        own = lambda kind, node=node: [{x for x, at in ([(t, ns[-1]) for t, ns, *_ in p.blocks] if kind == 1 else [(s, n) for n, _, s in p.shapes]) if at == node} for p in pages]  # noqa: E731, B023
        m = sum(any(node == ns[-1] for _, ns, *_ in p.blocks) or any(n == node for n, *_ in p.shapes) for p in pages)

        def spread(sets, m):
            # each content's entropy over the pages that have it, to the base m; the mean over occurrences
            n = {x: sum(x in s for s in sets) for s in sets for x in s}
            return 1 - sum(k * math.log(k) / math.log(m) for k in n.values()) / sum(n.values()) if n and m > 1 else 1.0

        below, weight = 0.0, 0
        for leaf in nodes:
            sets = [{t for t, ns, *_ in p.blocks if ns[-1] == leaf and node in ns} for p in pages]
            size = sum(map(len, sets))
            pages_of = sum(any(leaf == ns[-1] for _, ns, *_ in p.blocks) or any(n == leaf for n, *_ in p.shapes) for p in pages)
            below, weight = below + size * spread(sets, pages_of) if size else below, weight + size
        mean = below / weight if weight else 1.0
        shapes = own(2)
        want = html_text.GAMMA * mean + (1 - html_text.GAMMA) * spread(shapes, m) if any(shapes) else mean
        assert got[node][0] == m and abs(got[node][1] - want) < 1e-9


def test_low_nodes_by_join_as_by_broadcast(spark, monkeypatch):
    rows = [(k, f"http://h.org/{k}", f"<body><div class=x>Same words</div><div class=y>text {k}</div></body>") for k in range(30)] + [(99, None, "<p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    monkeypatch.setattr(html_text, "BROADCAST_NODES", 0)
    assert sorted(map(tuple, html_text.extract(df).collect()), key=str) == want and want[3][2].startswith("text")
