import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.functions import text as T
from tessera.functions.stem import _plurals_and_tenses, stem, stem_line, stem_text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


@pytest.mark.parametrize("text, want", [("3 bdrm   2bth  1800sf", (3, 2, 1800)), ("3 beds   2.5bths  1,800 sq ft", (3, 2.5, 1800)), ("3 bsdfdrm   2ssdbth  1800sdf", (0, 0, 0)), ("12 beds", (2, 0, 0))])
def test_attributes(spark, text, want):
    assert (one(spark, numeric.bedrooms, text), one(spark, numeric.bathrooms, text), one(spark, numeric.square_footage, text)) == want


@pytest.mark.parametrize("token, want", [("333-333-3333", "PH333"), ("234-087", "PH234"), ("46464", "10000"), ("$100", "USD100"), ("$100k", "USD100000"), ("$123,123.12", "USD100000"), ("$98.62", "USD10"), ("$", "USD"), ("7k", "1000")])
def test_magnitudes(spark, token, want):
    assert one(spark, numeric.is_numeric, token) and one(spark, numeric.magnitude, token) == want


def test_not_numeric(spark):
    assert not one(spark, numeric.is_numeric, "3jdh")


def test_stemmer_first_step():
    want = dict(caresses="caress", ponies="poni", ties="ti", cats="cat", feed="feed", agreed="agree", disabled="disable", matting="mat", mating="mate", meeting="meet", milling="mill", messing="mess", meetings="meet")
    assert {w: _plurals_and_tenses(w) for w in want} == want


def test_stemmer_whole():
    want = dict(relational="relat", conditional="condit", happy="happi", sky="sky", generalization="gener", oscillators="oscil", possibly="possibl", apology="apolog", be="be", hopefulness="hope", adjustment="adjust")
    assert {w: stem(w) for w in want} == want
    assert stem_line("Cats' 12 ponies!") == "cat' 12 poni!"


def test_stem_text_keeps_columns(spark):
    df = spark.createDataFrame([(1, "cats"), (2, None)], "id long, text string")
    assert [tuple(r) for r in stem_text(df).orderBy("id").collect()] == [(1, "cat"), (2, None)]


def test_cleaners(spark):
    assert one(spark, T.clean_listing, 'Big W/D, 1/2 acre (3.5 baths)... $1,200!') .strip() == "big w/ d , 1/2 acre ( 3.5 baths ) ... $1,200 !"
    assert one(spark, T.clean_quotes, "the 'big' house") == "the ' big ' house"
    assert one(spark, T.clean_reply, "I don't; dk <rf>").split() == ["I", "do", "not", "do", "not", "know", "refused"]
    assert one(spark, T.tokens, " a\tb\x0bc\n ") == ["a", "b", "c"] and one(spark, T.tokens, None) == []


def test_fields_and_filters(spark):
    assert one(spark, lambda c: T.keep_fields(c, [1], complement=True), "a b c") == "b c"
    assert one(spark, lambda c: T.drop_first(T.tokens(c), 1), "a b c") == ["b", "c"]
    assert [one(spark, T.is_text_line, x) for x in ("12, 3.", "NR", "", "yes 1")] == [False, False, False, True]
