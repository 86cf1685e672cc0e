"""Registered queries over the driver's tables, with SQL twins where SQL can
say the same. Floating results are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.functions import text as T
from tessera.functions.stem import stem_types as stems
from tessera.operators import cluster as C
from tessera.operators import counts as N
from tessera.operators import dictionary as D
from tessera.operators import evaluate as E
from tessera.operators import linalg as L
from tessera.operators import regression as R
from tessera.operators import simulate as S
from tessera.operators import tagged as G
from tessera.operators import vocab as V
from tessera.plans import programs as P
from tessera.plans.registry import query
from tessera.session import cut
from tessera.sources.tables import table

SPLIT = "regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+')"
ARR = f"arr AS (SELECT doc_id, list_filter({SPLIT}, lambda x: x <> '') AS a FROM documents)"
TOK = f"{ARR}, tok AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS tok FROM arr)"
TOK_EOL = f"{ARR}, tok AS (SELECT doc_id, unnest(range(1, len(a) + 2)) AS pos, unnest(list_append(a, 'EOL')) AS tok FROM arr)"
FREQ = "freq AS (SELECT tok AS type, count(*) AS freq FROM tok GROUP BY tok)"
VOCAB = f"{FREQ}, kept AS (SELECT CASE WHEN freq < 3 THEN 'OOV' ELSE type END AS type, sum(freq)::BIGINT AS freq FROM freq GROUP BY 1), vocab AS (SELECT type, freq, (row_number() OVER (ORDER BY freq DESC, type DESC) - 1)::INT AS idx FROM kept)"
DTM = f"{TOK}, {VOCAB}, dtm AS (SELECT t.doc_id, coalesce(v.idx, (SELECT idx FROM vocab WHERE type = 'OOV'))::INT AS idx, count(*) AS n FROM tok t LEFT JOIN vocab v ON t.tok = v.type GROUP BY 1, 2)"
ROWS = "m AS (SELECT doc_id, sum(n) AS m FROM dtm GROUP BY doc_id), f AS (SELECT idx, sum(n) AS f, count(*) AS df FROM dtm GROUP BY idx)"
TAGGED = f"{TOK}, tagged AS (SELECT t.tok AS type, d.lang AS pos FROM tok t JOIN documents d USING (doc_id)), tt AS (SELECT type, pos, count(*) AS n FROM tagged GROUP BY 1, 2)"


def _r(c, places: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places)


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def _vocab(spark, sf_dir, eol: bool = False):
    return V.Vocabulary(_docs(spark, sf_dir), 0, eol, 3)


def _dtm(spark, sf_dir):
    return _vocab(spark, sf_dir).document_counts()


def _tagged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return docs.select(F.col("lang").alias("pos"), F.explode(T.tokens(F.col("text"))).alias("type"))


# --- vocabularies


@query("vocab_top_oov", f"WITH {TOK}, {VOCAB} SELECT * FROM vocab ORDER BY idx LIMIT 20")
def vocab_top_oov(spark, sf_dir):
    return _vocab(spark, sf_dir).types.orderBy("idx").limit(20)


@query("vocab_index", f"WITH {TOK}, {VOCAB} SELECT * FROM vocab")
def vocab_index(spark, sf_dir):
    return _vocab(spark, sf_dir).types


@query("vocab_index_eol", f"WITH {TOK_EOL}, {VOCAB} SELECT * FROM vocab")
def vocab_index_eol(spark, sf_dir):
    return _vocab(spark, sf_dir, True).types


@query("vocab_totals", f"WITH {TOK}, {FREQ} SELECT (SELECT count(*) FROM documents) AS n_lines, sum(freq)::BIGINT AS n_tokens, count(*) AS n_types, count(*) FILTER (freq >= 3) AS n_kept, coalesce(sum(freq) FILTER (freq < 3), 0)::BIGINT AS n_oov FROM freq")
def vocab_totals(spark, sf_dir):
    v = _vocab(spark, sf_dir)
    return V.totals(v.docs, v.counts, 3)


@query("oov_first", f"WITH {TOK}, {FREQ} SELECT * FROM freq WHERE freq < 3 ORDER BY type LIMIT 100")
def oov_first(spark, sf_dir):
    return _vocab(spark, sf_dir).first_oov(100)


@query("type_freq_rare_hist", f"WITH {TAGGED}, p AS (SELECT type, sum(n)::BIGINT AS freq FROM tt GROUP BY 1) SELECT freq, count(*) AS types FROM p WHERE freq <= 5 GROUP BY 1")
def type_freq_rare_hist(spark, sf_dir):
    return G.rare_type_histogram(G.type_tag_counts(_tagged(spark, sf_dir)))


@query("top_k_share", f"WITH {TOK}, {FREQ}, c AS (SELECT row_number() OVER w AS k, sum(freq) OVER w AS c FROM freq WINDOW w AS (ORDER BY freq DESC, type DESC ROWS UNBOUNDED PRECEDING)) SELECT k::INT AS k, round(c / (SELECT sum(freq) FROM freq), 6) AS share FROM c WHERE k IN (50, 100, 250, 500, 1000)")
def top_k_share(spark, sf_dir):
    return V.top_share(_vocab(spark, sf_dir).counts, (50, 100, 250, 500, 1000)).select("k", _r("share").alias("share"))


@query("zipf_fit", f"WITH {TOK}, {FREQ}, t AS (SELECT ln(freq) AS y, ln(row_number() OVER (ORDER BY freq DESC, type DESC)) AS x FROM freq ORDER BY freq DESC, type DESC LIMIT 500) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM t")
def zipf_fit(spark, sf_dir):
    return V.zipf(_vocab(spark, sf_dir).counts).select(_r("slope").alias("slope"), _r("intercept").alias("intercept"))


@query("distinct_types_lower", f"SELECT DISTINCT unnest(list_filter({SPLIT.replace('coalesce(text', 'coalesce(translate(text, ' + chr(39) + T.UPPER + chr(39) + ', ' + chr(39) + T.LOWER + chr(39) + ')')}, lambda x: x <> '')) AS type FROM conversations")
def distinct_types_lower(spark, sf_dir):
    return V.lowercase_types(table(spark, sf_dir, "conversations", "text"))


# --- document x type


@query("doc_lengths", f"WITH {TOK} SELECT doc_id, count(*) AS m FROM tok GROUP BY 1")
def doc_lengths(spark, sf_dir):
    return V.Texts(_docs(spark, sf_dir)).lengths()


@query("doc_frequency", f"WITH {DTM} SELECT idx, count(*) AS df FROM dtm GROUP BY 1")
def doc_frequency(spark, sf_dir):
    return N.document_frequency(_dtm(spark, sf_dir))


@query("dtm_counts", f"WITH {DTM} SELECT * FROM dtm")
def dtm_counts(spark, sf_dir):
    return _dtm(spark, sf_dir)


def _scaled(name: str, how: str, sql: str) -> None:
    @query(name, f"WITH {DTM}, {ROWS} SELECT doc_id, idx, round({sql}, 6) AS v FROM dtm JOIN m USING (doc_id) JOIN f USING (idx)")
    def one(spark, sf_dir):
        return N.scale_documents(cut(_dtm(spark, sf_dir), "dtm"), how).select("doc_id", "idx", _r("v").alias("v"))


_scaled("dtm_raw", "w", "n::DOUBLE")
_scaled("dtm_row", "r", "n / sqrt(m)")
_scaled("dtm_col", "c", "n / sqrt(f)")
_scaled("dtm_cca", "b", "n / sqrt(m * f)")
_scaled("dtm_rowprob", "n", "n / m")
_scaled("dtm_tfidf", "t", "n * ln((SELECT count(DISTINCT doc_id) FROM dtm)::DOUBLE / df)")


@query("dtm_expected", f"WITH {DTM}, {ROWS} SELECT doc_id, idx, round(n / sqrt(m * f + 0.5), 6) AS v FROM dtm JOIN m USING (doc_id) JOIN f USING (idx)")
def dtm_expected(spark, sf_dir):
    return N.expected_scaling(cut(_dtm(spark, sf_dir), "dtm")).select("doc_id", "idx", _r("v").alias("v"))


ENTROPY = "h AS (SELECT idx, (0.0 - sum(n / f * ln(n / f))) / ln((SELECT count(DISTINCT doc_id) FROM dtm)) AS e FROM dtm JOIN f USING (idx) GROUP BY idx)"


@query("column_entropy", f"WITH {DTM}, {ROWS}, {ENTROPY} SELECT idx, round(e, 6) AS entropy FROM h")
def column_entropy(spark, sf_dir):
    return N.column_entropy(cut(_dtm(spark, sf_dir), "dtm")).select("idx", _r("entropy").alias("entropy"))


@query("dtm_entropy_weighted", f"WITH {DTM}, {ROWS}, {ENTROPY} SELECT doc_id, idx, round(n / m * (1 - e), 6) AS v FROM dtm JOIN m USING (doc_id) JOIN h USING (idx)")
def dtm_entropy_weighted(spark, sf_dir):
    return N.entropy_weighted(cut(_dtm(spark, sf_dir), "dtm")).select("doc_id", "idx", _r("v").alias("v"))


@query("top_tfidf", f"WITH {DTM}, {ROWS}, s AS (SELECT idx, round(sum(n * ln((SELECT count(DISTINCT doc_id) FROM dtm)::DOUBLE / df)), 6) AS score FROM dtm JOIN f USING (idx) GROUP BY idx) SELECT idx, score FROM s ORDER BY score DESC, idx LIMIT 500")
def top_tfidf(spark, sf_dir):
    dtm = cut(_dtm(spark, sf_dir), "dtm")
    return N.top_by_tfidf(dtm, 500).select("idx", _r("score").alias("score"))


@query("top_tfidf_all")
def top_tfidf_all(spark, sf_dir):
    return N.top_by_tfidf(cut(_dtm(spark, sf_dir), "dtm"), 5000)


@query("word_columns", f"WITH {DTM} SELECT doc_id, sum(CASE WHEN idx = 0 THEN n ELSE 0 END)::BIGINT AS w0, sum(CASE WHEN idx = 1 THEN n ELSE 0 END)::BIGINT AS w1, sum(CASE WHEN idx = 2 THEN n ELSE 0 END)::BIGINT AS w2 FROM dtm WHERE idx < 3 GROUP BY doc_id")
def word_columns(spark, sf_dir):
    few = _dtm(spark, sf_dir).where("idx < 3").groupBy("doc_id").pivot("idx", [0, 1, 2]).agg(F.sum("n")).na.fill(0)
    return few.select("doc_id", *[F.col(str(k)).alias(f"w{k}") for k in range(3)])


@query("quadratic_terms", f"WITH {DTM} SELECT a.doc_id, a.idx AS j, b.idx AS k, a.n * b.n AS v FROM dtm a JOIN dtm b ON a.doc_id = b.doc_id AND a.idx <= b.idx WHERE a.idx < 20 AND b.idx < 20")
def quadratic_terms(spark, sf_dir):
    return N.column_pairs(N.document_rows(_vocab(spark, sf_dir).ids), 20)


@query("quadratic_terms_all")
def quadratic_terms_all(spark, sf_dir):
    return N.column_pairs(_dtm(spark, sf_dir))


# --- bigrams


def _pairs_sql(skip: int, eol: bool) -> str:
    return f"WITH {TOK_EOL if eol else TOK}, {VOCAB}, oov AS (SELECT idx FROM vocab WHERE type = 'OOV'), x AS (SELECT coalesce(v.idx, (SELECT idx FROM oov))::INT AS i, lead(coalesce(v.idx, (SELECT idx FROM oov))::INT, {skip + 1}) OVER (ORDER BY doc_id, pos) AS j FROM tok LEFT JOIN vocab v ON tok.tok = v.type), big AS (SELECT i, j, count(*) AS n FROM x WHERE j IS NOT NULL GROUP BY 1, 2)"


def _bigrams(spark, sf_dir, skip: int, eol: bool):
    return _vocab(spark, sf_dir, eol).bigrams(skip)


def _bigram_query(name: str, skip: int, eol: bool) -> None:
    @query(name, f"{_pairs_sql(skip, eol)} SELECT * FROM big")
    def one(spark, sf_dir):
        return _bigrams(spark, sf_dir, skip, eol)


_bigram_query("bigram_counts", 0, False)
_bigram_query("bigram_counts_eol", 0, True)
_bigram_query("bigram_counts_skip1", 1, False)
_bigram_query("bigram_counts_skip4_eol", 4, True)


@query("bigram_margins", f"{_pairs_sql(0, True)} SELECT 'row' AS side, i AS idx, sum(n)::BIGINT AS total FROM big GROUP BY i UNION ALL SELECT 'column', j, sum(n)::BIGINT FROM big GROUP BY j")
def bigram_margins(spark, sf_dir):
    return N.margins(cut(_bigrams(spark, sf_dir, 0, True), "bigrams"))


def _scaled_bigrams(name: str, how: str, sql: str) -> None:
    @query(name, f"{_pairs_sql(0, True)} SELECT i, j, round({sql}, 6) AS v FROM big JOIN vocab a ON i = a.idx JOIN vocab b ON j = b.idx")
    def one(spark, sf_dir):
        v = _vocab(spark, sf_dir, True)
        return N.scale_bigrams(v.bigrams(0), v.types, how).select("i", "j", _r("v").alias("v"))


_scaled_bigrams("bigram_scaled_row", "r", "n / sqrt(a.freq)")
_scaled_bigrams("bigram_scaled_column", "c", "n / sqrt(b.freq)")
_scaled_bigrams("bigram_scaled_sym", "b", "n / sqrt(a.freq * b.freq)")
_scaled_bigrams("bigram_left", "left", "n / a.freq")
_scaled_bigrams("bigram_right", "right", "n / b.freq")


@query(
    "unified_matrix",
    f"{_pairs_sql(0, True)}, dtm AS (SELECT t.doc_id, coalesce(v.idx, (SELECT idx FROM oov))::INT AS idx, count(*) AS n FROM tok t LEFT JOIN vocab v ON t.tok = v.type GROUP BY 1, 2), m AS (SELECT doc_id, sum(n) AS m FROM dtm GROUP BY 1) "
    "SELECT i, j::BIGINT AS j, round(n / sqrt(a.freq * b.freq), 6) AS v FROM big JOIN vocab a ON i = a.idx JOIN vocab b ON j = b.idx UNION ALL SELECT idx, (SELECT count(*) FROM vocab) + doc_id, round(n / m / sqrt(freq), 6) FROM dtm JOIN m USING (doc_id) JOIN vocab USING (idx)",
)
def unified_matrix(spark, sf_dir):
    v = _vocab(spark, sf_dir, True)
    types = v.types
    out = N.unified_matrix(v.bigrams(0), N.document_rows(v.ids), types, types.count())
    return out.select("i", "j", _r("v").alias("v"))


@query("bigrams_across_corpora", f"WITH {ARR}, seq AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS tok FROM arr), x AS (SELECT tok AS l, lead(tok) OVER (ORDER BY doc_id, pos) AS r FROM seq), own AS (SELECT tok AS type, row_number() OVER (ORDER BY count(*) DESC, tok DESC) - 1 AS idx FROM seq WHERE doc_id % 2 = 0 GROUP BY 1), other AS (SELECT tok AS type, row_number() OVER (ORDER BY count(*) DESC, tok DESC) - 1 AS idx FROM seq WHERE doc_id % 2 = 1 GROUP BY 1) SELECT own.idx::INT AS i, other.idx::INT AS j, count(*) AS n FROM x JOIN own ON l = own.type JOIN other ON r = other.type GROUP BY 1, 2")
def bigrams_across_corpora(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    types = [V.ranked(V.type_counts(V.tokens(docs.where(F.col("doc_id") % 2 == k)))) for k in (0, 1)]
    return N.cross_bigrams(V.token_arrays(docs), *types)


# --- tags


@query("tag_counts", f"WITH {TAGGED} SELECT pos, sum(n)::BIGINT AS n FROM tt GROUP BY 1")
def tag_counts(spark, sf_dir):
    return G.tag_counts(_tagged(spark, sf_dir))


@query("tag_majority", f"WITH {TAGGED} SELECT type, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, pos) AS r FROM tt) WHERE r = 1")
def tag_majority(spark, sf_dir):
    return G.majority_tags(cut(G.type_tag_counts(_tagged(spark, sf_dir)), "tags"))


@query("tag_ambiguity", f"WITH {TAGGED}, p AS (SELECT sum(n) AS n, max(n) AS top FROM tt GROUP BY type) SELECT sum(n)::BIGINT AS n_tokens, sum(n - top)::BIGINT AS n_ambiguous, round(100 * (1 - sum(n - top) / sum(n)), 6) AS purity FROM p")
def tag_ambiguity(spark, sf_dir):
    return G.ambiguity(G.type_tag_counts(_tagged(spark, sf_dir))).withColumn("purity", _r("purity"))


@query("tag_other_collapse", f"WITH {TAGGED}, c AS (SELECT pos, sum(n) AS n FROM tt GROUP BY 1) SELECT CASE WHEN n / (SELECT sum(n) FROM c) < 0.12 THEN 'OTH' ELSE pos END AS pos, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def tag_other_collapse(spark, sf_dir):
    return G.tag_counts(G.collapse_tags(_tagged(spark, sf_dir), 0.12))


@query("rare_type_tags", f"WITH {TAGGED}, p AS (SELECT type, sum(n)::BIGINT AS freq FROM tt GROUP BY 1 HAVING sum(n) <= 2), t AS (SELECT type, pos, row_number() OVER (PARTITION BY type ORDER BY n DESC, pos) AS r FROM tt) SELECT freq, pos, count(*) AS types FROM p JOIN t USING (type) WHERE r = 1 GROUP BY 1, 2")
def rare_type_tags(spark, sf_dir):
    return G.rare_type_tags(cut(G.type_tag_counts(_tagged(spark, sf_dir)), "tags"))


@query("tags_of_types", f"WITH {TAGGED}, o AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n, pos) AS r FROM tt) SELECT type, string_agg(pos || ':' || n, ' ' ORDER BY r) AS tags FROM o GROUP BY 1")
def tags_of_types(spark, sf_dir):
    t = G.tags_of_types(G.type_tag_counts(_tagged(spark, sf_dir)))
    return t.select("type", F.array_join(F.transform("tags", lambda s: F.concat(s["pos"], F.lit(":"), s["n"].cast("string"))), " ").alias("tags"))


@query("oov_types_between_splits", f"WITH {TOK}, a AS (SELECT DISTINCT tok FROM tok WHERE doc_id % 5 <> 0), b AS (SELECT DISTINCT tok FROM tok WHERE doc_id % 5 = 0) SELECT count(*) AS n FROM b WHERE tok NOT IN (SELECT tok FROM a)")
def oov_types_between_splits(spark, sf_dir):
    toks = V.tokens(_docs(spark, sf_dir)).select("doc_id", F.col("tok").alias("type"))
    return G.unseen_types(toks.where("doc_id % 5 <> 0"), toks.where("doc_id % 5 = 0")).agg(F.count("*").alias("n"))


@query("tokens_unindexed", f"WITH {TOK}, a AS (SELECT DISTINCT tok FROM tok WHERE doc_id % 5 <> 0) SELECT count(*) AS n_missed FROM tok WHERE doc_id % 5 = 0 AND tok NOT IN (SELECT tok FROM a)")
def tokens_unindexed(spark, sf_dir):
    toks = V.tokens(_docs(spark, sf_dir))
    return toks.where("doc_id % 5 = 0").join(toks.where("doc_id % 5 <> 0").select("tok").distinct(), "tok", "left_anti").agg(F.count("*").alias("n_missed"))


@query("group_proportions", f"WITH {TOK}, g AS (SELECT CASE WHEN len(a) >= 200 THEN 'long' ELSE 'short' END AS grp, unnest(a) AS type FROM arr), n AS (SELECT grp, type, count(*) AS n FROM g GROUP BY 1, 2) SELECT grp, type, round(n / sum(n) OVER (PARTITION BY grp), 6) AS p FROM n")
def group_proportions(spark, sf_dir):
    arrays = V.token_arrays(_docs(spark, sf_dir))
    rows = arrays.select(F.when(F.size("toks") >= 200, "long").otherwise("short").alias("grp"), F.explode("toks").alias("type"))
    return G.group_proportions(rows).select("grp", "type", _r("p").alias("p"))


# --- scalar text


def _chain_sql(column: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        quoted = "'" + pattern.replace("'", "''") + "', '" + to.replace("'", "''").replace("$1", "\\1").replace("$2", "\\2") + "'"
        column = f"regexp_replace({column}, {quoted}, 'g')"
    return column


_LOWERED = f"translate({_chain_sql('text', T.LISTING_PADS)}, '{T.UPPER}', '{T.LOWER}')"


@query("clean_listing", f"SELECT doc_id, {_chain_sql(_LOWERED, T.LISTING_JOINS + T.QUOTES)} AS clean FROM documents")
def clean_listing(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_listing(F.col("text")).alias("clean"))


@query("clean_quotes", f"SELECT conv_id, turn, {_chain_sql('text', T.QUOTES)} AS clean FROM conversations")
def clean_quotes(spark, sf_dir):
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", T.clean_quotes(F.col("text")).alias("clean"))


@query("clean_reply", f"SELECT conv_id, turn, {_chain_sql('text', T.REPLIES)} AS clean FROM conversations")
def clean_reply(spark, sf_dir):
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", T.clean_reply(F.col("text")).alias("clean"))


@query("text_lines", f"SELECT doc_id FROM documents WHERE text <> '' AND NOT regexp_matches(text, '{T.ONLY_NUMBERS}') AND NOT contains(text, 'NR')")
def text_lines(spark, sf_dir):
    return _docs(spark, sf_dir).where(T.is_text_line(F.col("text"))).select("doc_id")


_STOP = "substr(body, length(head) + 1, 1)"


@query(
    "numeric_tokens",
    f"""WITH {TOK}, c AS (SELECT DISTINCT tok FROM tok WHERE regexp_matches(tok, '{numeric.NUMERIC}')), b AS (SELECT tok, CASE WHEN tok LIKE '$%' THEN substr(tok, 2) ELSE tok END AS body FROM c), h AS (SELECT *, regexp_extract(body, '^([0-9,]*)', 1) AS head FROM b), d AS (SELECT *, replace(head, ',', '') AS digits, {_STOP} AS stop FROM h), e AS (SELECT *, CASE WHEN stop = 'k' THEN digits || '000' ELSE digits END AS fulln FROM d)
    SELECT tok, CASE WHEN stop = '-' THEN CASE WHEN length(digits) = 3 THEN 'PH' || digits ELSE 'PH' END ELSE (CASE WHEN tok LIKE '$%' THEN 'USD' ELSE '' END) || CASE WHEN length(fulln) > 1 THEN '1' || repeat('0', length(fulln) - 1) ELSE fulln END END AS magnitude FROM e""",
)
def numeric_tokens(spark, sf_dir):
    toks = V.tokens(_docs(spark, sf_dir)).select("tok").where(numeric.is_numeric(F.col("tok"))).distinct()
    return toks.select("tok", numeric.magnitude(F.col("tok")).alias("magnitude"))


LISTINGS = ["3 bdrm   2bth  1800sf", "3 beds   2.5bths  1,800 sq ft", "3 bsdfdrm   2ssdbth  1800sdf", "12 beds"]


@query("listing_attributes", "WITH l AS (SELECT unnest(['" + "','".join(LISTINGS) + "']) AS text UNION ALL SELECT p_name || ' ' || p_size || ' sq ft ' || p_size % 7 || ' bedrooms' FROM part) SELECT text, " + ", ".join(f"coalesce(try_cast(replace(regexp_extract(text, '{p}', 1), ',', '') AS DOUBLE), 0) AS {n}" for n, p in (("square_footage", numeric.SQUARE_FEET), ("bedrooms", numeric.BEDROOMS), ("bathrooms", numeric.BATHROOMS))) + " FROM l")
def listing_attributes(spark, sf_dir):
    parts = table(spark, sf_dir, "part", "p_name", "p_size").select(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" sq ft "), (F.col("p_size") % 7).cast("string"), F.lit(" bedrooms")).alias("text"))
    return spark.createDataFrame([(x,) for x in LISTINGS], "text string").unionByName(parts).select("text", *numeric.parse_all(F.col("text")))


@query("stem_types")
def stem_types(spark, sf_dir):
    return stems(V.tokens(_docs(spark, sf_dir)).select(T.ascii_lower(F.col("tok")).alias("type")))


# --- dictionaries: embeddings by label names


EMB = "dict AS (SELECT 'w' || vec_id AS type, embedding AS vec FROM embeddings WHERE vec_id % 3 <> 0), want AS (SELECT 'w' || vec_id AS type FROM embeddings WHERE vec_id % 2 = 0)"


def _dictionary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    name = F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("type")
    return e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("line_no"), name, F.col("embedding").alias("vec")), e.where("vec_id % 2 = 0").select(name)


@query("dict_semi", f"WITH {EMB} SELECT type, round(vec[1]::DOUBLE, 6) AS x FROM dict WHERE type IN (SELECT type FROM want) AND type <> (SELECT 'w' || min(vec_id) FROM embeddings WHERE vec_id % 3 <> 0)")
def dict_semi(spark, sf_dir):
    d, want = _dictionary(spark, sf_dir)
    return D.restrict(d, want).where(~F.col("type").isin("OOV", "NA")).select("type", _r(F.col("vec")[0].cast("double")).alias("x"))


@query("dict_missing", f"WITH {EMB} SELECT type FROM want WHERE type NOT IN (SELECT type FROM dict)")
def dict_missing(spark, sf_dir):
    d, want = _dictionary(spark, sf_dir)
    return D.missing(want, d)


@query("dict_lookup_default", f"WITH {EMB} SELECT type, round(coalesce(vec[1], 0)::DOUBLE, 6) AS x, coalesce(len(vec), 64)::INT AS dims FROM want LEFT JOIN dict USING (type)")
def dict_lookup_default(spark, sf_dir):
    d, want = _dictionary(spark, sf_dir)
    return D.lookup(want, d.select("type", F.col("vec").cast("array<double>").alias("vec")), 64).select("type", _r(F.col("vec")[0]).alias("x"), F.size("vec").alias("dims"))


@query("dict_last_wins", "WITH d AS (SELECT vec_id AS line_no, 'w' || vec_id % 60 AS type, embedding AS vec FROM embeddings), l AS (SELECT type, arg_max(vec, line_no) AS vec FROM d WHERE line_no > (SELECT min(line_no) FROM d) GROUP BY 1) SELECT type, round(vec[1]::DOUBLE, 6) AS x, round(vec[2]::DOUBLE, 6) AS y FROM l WHERE substr(type, 2)::INT % 2 = 0 UNION ALL SELECT 'OOV', round(arg_min(vec, line_no)[1]::DOUBLE, 6), round(arg_min(vec, line_no)[2]::DOUBLE, 6) FROM d UNION ALL SELECT 'NA', 'nan'::DOUBLE, 'nan'::DOUBLE")
def dict_last_wins(spark, sf_dir):
    name = lambda c: F.concat(F.lit("w"), (F.col(c) % 60).cast("string")).alias("type")
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    rows = e.select(F.col("vec_id").alias("line_no"), name("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    want = spark.range(0, 60, 2).select(name("id"))
    return D.restrict(rows, want, 2).select("type", _r(F.col("vec")[0]).alias("x"), _r(F.col("vec")[1]).alias("y"))


@query(
    "doc_centroids",
    f"WITH {ARR}, tok AS (SELECT doc_id, 'w' || (len(t) * 7 % 500) AS type FROM (SELECT doc_id, unnest(a) AS t FROM arr)), {EMB}, hit AS (SELECT doc_id, vec FROM tok JOIN dict USING (type)), c AS (SELECT doc_id, count(*) AS found, avg(vec[1]::DOUBLE) AS x, avg(vec[64]::DOUBLE) AS y FROM hit GROUP BY 1) SELECT d.doc_id, coalesce(found, 0) AS found, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS y FROM (SELECT DISTINCT doc_id FROM tok) d LEFT JOIN c USING (doc_id)",
)
def doc_centroids(spark, sf_dir):
    d, _ = _dictionary(spark, sf_dir)
    toks = V.tokens(_docs(spark, sf_dir)).select("doc_id", F.concat(F.lit("w"), (F.char_length("tok") * 7 % 500).cast("string")).alias("tok"))
    return D.centroids(toks, d, 64).select("doc_id", "found", _r(F.col("vec")[0]).alias("x"), _r(F.col("vec")[63]).alias("y"))


# --- evaluation

JUDGED = "judged AS (SELECT quality::VARCHAR AS truth, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END AS est FROM labels JOIN documents USING (doc_id))"


def _judged(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents", "doc_id", "n_chars"), "doc_id")
    return both.select(F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("est"))


@query("confusion_long", f"WITH {JUDGED}, l AS (SELECT truth AS x FROM judged UNION SELECT est FROM judged) SELECT a.x AS truth, b.x AS est, count(j.truth) AS n FROM l a CROSS JOIN l b LEFT JOIN judged j ON j.truth = a.x AND j.est = b.x GROUP BY 1, 2")
def confusion_long(spark, sf_dir):
    return E.confusion(_judged(spark, sf_dir))


@query("confusion_margins", f"WITH {JUDGED} SELECT truth, est, count(*) AS n FROM judged GROUP BY CUBE (truth, est)")
def confusion_margins(spark, sf_dir):
    return E.margins(_judged(spark, sf_dir))


@query("accuracy_purity", f"WITH {JUDGED}, c AS (SELECT truth, est, count(*) AS n FROM judged GROUP BY 1, 2) SELECT sum(n)::BIGINT AS n, round(sum(CASE WHEN truth = est THEN n ELSE 0 END) / sum(n), 6) AS accuracy, round((SELECT sum(t) FROM (SELECT max(n) AS t FROM c GROUP BY est)) / sum(n), 6) AS purity FROM c")
def accuracy_purity(spark, sf_dir):
    return E.accuracy_purity(_judged(spark, sf_dir)).select("n", _r("accuracy").alias("accuracy"), _r("purity").alias("purity"))


@query("pair_order_agreement", "WITH p AS (SELECT a.l_extendedprice AS y1, b.l_extendedprice AS y2, a.l_quantity AS f1, b.l_quantity AS f2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber) SELECT count(*) AS pairs, count(*) FILTER (sign(y1 - y2) * sign(f1 - f2) > 0) AS concordant FROM p")
def pair_order_agreement(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_extendedprice").alias("y1"), F.col("l_quantity").alias("f1"))
    b = li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y2"), F.col("l_quantity").alias("f2"))
    return E.concordant_pairs(a.join(b, ["l_orderkey", "l_linenumber"]))


@query("mean_impute_indicator", "SELECT event_id, round(CASE WHEN value > 40 THEN value - 40 ELSE (SELECT avg(value - 40) FROM events WHERE value > 40) END, 6) AS x, CASE WHEN value > 40 THEN 1 ELSE 0 END AS x_seen FROM events")
def mean_impute_indicator(spark, sf_dir):
    ev = table(spark, sf_dir, "events", "event_id", "value").select("event_id", (F.col("value") - 40).alias("x"))
    return E.mean_imputed(ev, "x").withColumn("x", _r("x"))


@query("column_moments", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS sd, round(kurtosis_pop({c}) + 3, 4) AS kurtosis FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def column_moments(spark, sf_dir):
    m = E.moments(table(spark, sf_dir, "lineitem", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"])
    return m.select("name", "n", *[_r(c, 4).alias(c) for c in ("mean", "sd", "kurtosis")])


@query("five_numbers", "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS {n}" for n, q in (("low", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1.0))) + " FROM lineitem")
def five_numbers(spark, sf_dir):
    f = E.five_numbers(table(spark, sf_dir, "lineitem", "l_extendedprice"), "l_extendedprice")
    return f.select(*[_r(c, 4).alias(c) for c in f.columns])


@query("histogram", "SELECT floor((l_quantity - 0) / 5)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1")
def histogram(spark, sf_dir):
    return E.histogram(table(spark, sf_dir, "lineitem", "l_quantity"), "l_quantity", 0, 5)


@query("correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem")
def correlations(spark, sf_dir):
    c = ["l_quantity", "l_extendedprice", "l_tax"]
    return E.correlations(table(spark, sf_dir, "lineitem", *c), c).select("a", "b", _r("r").alias("r"))


DIST = "d AS (SELECT lang, source AS key, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS p FROM documents WHERE lang IN ('en', 'de') GROUP BY 1, 2)"


@query("symmetric_divergence", f"WITH {DIST}, b AS (SELECT x.p AS a, y.p AS b FROM d x JOIN d y USING (key) WHERE x.lang = 'en' AND y.lang = 'de') SELECT round(sum(a * ln(a / b)), 6) AS forward, round(sum(b * ln(b / a)), 6) AS backward, round((sum(a * ln(a / b)) + sum(b * ln(b / a))) / 2, 6) AS mean FROM b")
def symmetric_divergence(spark, sf_dir):
    n = table(spark, sf_dir, "documents", "lang", "source").groupBy("lang", F.col("source").alias("key")).agg(F.count("*").alias("n"))
    p = n.join(n.groupBy("lang").agg(F.sum("n").alias("t")), "lang").withColumn("p", F.col("n") / F.col("t"))
    out = E.symmetric_divergence(p.where("lang = 'en'"), p.where("lang = 'de'"))
    return out.select(*[_r(c).alias(c) for c in out.columns])


@query("log_ratios", f"WITH {DIST.replace('source AS key', 'source AS type')} SELECT x.lang AS grp, x.type, round(ln(greatest(x.p, 0.0001) / greatest(y.p, 0.0001)), 6) AS v FROM d x JOIN d y ON x.lang = y.lang AND y.type = 'src0' WHERE x.type <> 'src0'")
def log_ratios(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", "lang", "source").where("lang in ('en', 'de')").select(F.col("lang").alias("grp"), F.col("source").alias("type"))
    return E.log_ratios(G.group_proportions(rows), "src0").select("grp", "type", _r("v").alias("v"))


DIST_ALL = "d AS (SELECT lang, source AS type, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS p FROM documents GROUP BY 1, 2)"


@query("log_ratios_all", f"WITH {DIST_ALL} SELECT x.lang AS grp, x.type, round(ln(greatest(x.p, 0.0001) / greatest(y.p, 0.0001)), 6) AS v FROM d x JOIN d y ON x.lang = y.lang AND y.type = 'src0' WHERE x.type <> 'src0'")
def log_ratios_all(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", "lang", "source").select(F.col("lang").alias("grp"), F.col("source").alias("type"))
    return E.log_ratios(G.group_proportions(rows), "src0").select("grp", "type", _r("v").alias("v"))


@query("set_operations", "WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 500), b AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "documents", "doc_id", "n_chars").where("n_chars > 500").select("doc_id")
    b = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1").select("doc_id")
    count = lambda d, name: d.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "first")).unionByName(count(a.union(b).distinct(), "either"))


@query("sequence_differences", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS step, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS upto FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def sequence_differences(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return o.select("o_orderkey", _r(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 4).alias("step"), _r(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("upto"))


# --- clusters


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("pos"))


_DIST2 = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
KM = f"p AS (SELECT vec_id AS id, list_transform(embedding, lambda z: z::DOUBLE) AS x FROM embeddings), c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cluster, x FROM p ORDER BY id LIMIT 8), dd AS (SELECT p.id, c.cluster, {_DIST2} AS d2 FROM p CROSS JOIN c), near AS (SELECT id, cluster, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cluster) AS r FROM dd) WHERE r = 1)"


def _start(spark, sf_dir):
    import numpy as np

    pts = _points(spark, sf_dir)
    return pts, np.array([r["x"] for r in pts.orderBy("id").limit(8).collect()])


@query("kmeans_assign", f"WITH {KM} SELECT id, cluster, round(d2, 6) AS d2 FROM near")
def kmeans_assign(spark, sf_dir):
    pts, centres = _start(spark, sf_dir)
    return C.assign(pts.select("id", "x"), centres).select("id", "cluster", _r("d2").alias("d2"))


@query("kmeans_one_step", f"WITH {KM}, e AS (SELECT cluster, unnest(range(1, 65)) AS k, unnest(x) AS v FROM near JOIN p USING (id)) SELECT cluster, (k - 1)::INT AS d, round(avg(v), 6) AS v FROM e GROUP BY 1, 2")
def kmeans_one_step(spark, sf_dir):
    pts, centres = _start(spark, sf_dir)
    sums, weights = C.centre_sums(pts.select("x", F.lit(1.0).alias("w")), centres)
    rows = [(k, d, float(sums[k, d] / weights[k])) for k in range(len(weights)) for d in range(sums.shape[1]) if weights[k]]
    return spark.createDataFrame(rows, "cluster int, d int, v double").select("cluster", "d", _r("v").alias("v"))


@query("cluster_summary", f"WITH {KM} SELECT cluster, count(*) AS n, round(sqrt(avg(d2)), 6) AS rms, round(sqrt(max(d2)), 6) AS furthest FROM near GROUP BY 1")
def cluster_summary(spark, sf_dir):
    pts, centres = _start(spark, sf_dir)
    return C.cluster_summary(C.assign(pts.select("id", "x"), centres)).select("cluster", "n", _r("rms").alias("rms"), _r("furthest").alias("furthest"))


@query("cluster_labels", f"WITH {KM}, v AS (SELECT cluster, label::VARCHAR AS pos, count(*) AS n FROM near JOIN embeddings ON id = vec_id GROUP BY 1, 2) SELECT cluster, pos FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, pos) AS r FROM v) WHERE r = 1")
def cluster_labels(spark, sf_dir):
    pts, centres = _start(spark, sf_dir)
    return C.cluster_labels(C.assign(pts, centres))


@query("kmeans_fit")
def kmeans_fit(spark, sf_dir):
    pts = _points(spark, sf_dir).select("id", "x")
    return C.fit(pts, 8, scale_data=True).assign(pts).select("id", "cluster", "d2")


@query("cluster_classifier")
def cluster_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    tagged = docs.select(F.col("lang").alias("pos"), "doc_id", F.posexplode(T.tokens(F.col("text"))).alias("k", "type")).select((F.col("doc_id") * (1 << 20) + F.col("k")).alias("seq"), "type", "pos")
    return P.cluster_types(tagged, projections=10, clusters=20, bidirectional=True, scale_data=True, toks=V.Texts(docs))["confusion"]


# --- regression

LINE = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", *LINE)
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").alias("y"), F.array(*LINE).alias("x"))


_ALL = ["1.0", "(l_extendedprice / 1e5)", *LINE]


@query("gram_matrix", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum({a} * {b}) / count(*), 5) AS g FROM lineitem" for i, a in enumerate(_ALL) for j, b in enumerate(_ALL)) + ")")
def gram_matrix(spark, sf_dir):
    g = R.design_gram(_lines(spark, sf_dir).withColumn("y", F.col("y") / 1e5), 3)
    return spark.createDataFrame([(i, j, float(g[i, j] / g[0, 0])) for i in range(5) for j in range(5)], "i int, j int, g double").withColumn("g", _r("g", 5))


@query("ols_simple", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_simple(spark, sf_dir):
    o = R.ols(_lines(spark, sf_dir).withColumn("x", F.slice("x", 1, 1)), LINE[:1])
    return spark.createDataFrame([(o[1]["coefficient"], o[0]["coefficient"], float(o[0]["r2"]))], "slope double, intercept double, r2 double").select(_r("slope", 4).alias("slope"), _r("intercept", 3).alias("intercept"), _r("r2").alias("r2"))


def _table(spark, rows: list, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    dicts = [r if isinstance(r, dict) else r.__dict__ for r in rows]
    plain = lambda v: v.item() if hasattr(v, "item") else v
    return spark.createDataFrame([tuple(plain(d[n]) for n in names) for d in dicts], schema)


@query("cv_ss")
def cv_ss(spark, sf_dir):
    return _table(spark, R.validated_sequence(_lines(spark, sf_dir), LINE[:1], LINE[1:], 5), "step int, name string, r2 double, rss double, aicc double, cvss double")


@query("cv_mse")
def cv_mse(spark, sf_dir):
    return _table(spark, R.cross_validated_mse(_lines(spark, sf_dir), 3, 5, 2), "rep int, fold int, n double, mse double")


@query("lasso_path")
def lasso_path(spark, sf_dir):
    return _table(spark, R.lasso_path(R.design_gram(_lines(spark, sf_dir), 3), LINE), "step int, penalty double, name string, coefficient double")


# --- features


def _labelled(spark, sf_dir):
    return _docs(spark, sf_dir).join(table(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", F.col("n_chars").cast("double").alias("y")), "doc_id")


@query("lsa_features")
def lsa_features(spark, sf_dir):
    return P.lsa(_docs(spark, sf_dir), 3, "b", power_iter=1, n_projections=10)["features"]


@query("lsa_quadratic")
def lsa_quadratic(spark, sf_dir):
    return P.lsa(_docs(spark, sf_dir), 3, "w", quadratic=True, n_projections=8)["features"]


@query("lsa_regression")
def lsa_regression(spark, sf_dir):
    return _table(spark, P.lsa(_labelled(spark, sf_dir), 3, "b", use_log=True, n_projections=10)["steps"], "name string, r2 double, adj_r2 double, rss double, q int, aicc double, added boolean")


@query("bigram_features")
def bigram_features(spark, sf_dir):
    return P.bigram_features(_docs(spark, sf_dir), 3, "b", n_projections=10)["features"]


@query("unified_features")
def unified_features(spark, sf_dir):
    return P.unified(_docs(spark, sf_dir), 3, n_projections=10)["features"]


@query("cca_blocks")
def cca_blocks(spark, sf_dir):
    rows = _points(spark, sf_dir).select(F.slice("x", 1, 8).alias("a"), F.slice("x", 9, 8).alias("b"))
    r, _, _ = L.canonical_correlations(rows, "a", "b", 8, 8)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(r)], "k int, correlation double")


@query("principal_components")
def principal_components(spark, sf_dir):
    w, _ = L.principal_components(_points(spark, sf_dir), 10, 64)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "k int, variance double")


@query("als_rank1")
def als_rank1(spark, sf_dir):
    cells = _points(spark, sf_dir).select(F.col("id").alias("i"), F.posexplode("x").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")
    return L.rank_one(cut(cells, "cells"))[0]


@query("topic_simulation")
def topic_simulation(spark, sf_dir):
    import numpy as np

    return S.corpus(spark, 200, np.ones(4), S.topics(4, 300, 0.1, 7, common=20), np.arange(4.0), 80, seed=7)
