"""The Porter stemmer (1980), over distinct types in Arrow batches.

A word's shape is written as c and v runs; the measure counts "vc" in it. Rules
are tables of (ending, replacement) by step. Three departures from the paper:
words of one or two letters stay, -bli becomes -ble, -logi becomes -log.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Endings of the published steps 2 to 4.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(rules: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(":")) for r in rules.split()), key=lambda r: -len(r[0]))


_STEP2, _STEP3, _STEP4 = _table(STEP2), _table(STEP3), sorted(STEP4.split(), key=len, reverse=True)


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return word[-1:] == word[-2:-1] != "" and shape(word)[-1] == "c"


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    for ending, to in rules:
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + to if measure(stem) > 0 else word
    return word


def _plurals_and_tenses(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for ending in ("ed", "ing"):
        stem = w[: -len(ending)]
        if w.endswith(ending) and "v" in shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short(stem) else stem
    return w


def _drop_residual(w: str) -> str:
    for ending in _STEP4:
        if w.endswith(ending):
            stem = w[: -len(ending)]
            if ending == "ion" and stem[-1:] not in ("s", "t"):
                return w
            return stem if measure(stem) > 1 else w
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        stem, m = w[:-1], measure(w[:-1])
        if m > 1 or (m == 1 and not _short(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Stem of a word of lower-case letters a-z."""
    if len(word) <= 2:
        return word
    w = _plurals_and_tenses(word)
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for step in (lambda x: _replace(x, _STEP2), lambda x: _replace(x, _STEP3), _drop_residual, _tidy):
        if len(w) < 2:
            return w
        w = step(w)
    return w


def stem_line(text: str) -> str:
    """Every run of letters stemmed in lower case; all else passes through."""
    return re.sub("[A-Za-z]+", lambda m: stem(m[0].lower()), text)


def stem_types(types: DataFrame, column: str = "type") -> DataFrame:
    """(column, stem) for each distinct value of a column of words."""
    from tessera.session import ship

    ship(types.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.functions.stem import stem_line

        for b in batches:
            words = b.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([None if w is None else stem_line(w) for w in words.to_pylist()], pa.string())], names=[column, "stem"])

    return types.select(column).distinct().mapInArrow(run, f"`{column}` string, stem string")


def stem_tokens(tokens: DataFrame, column: str = "tok") -> DataFrame:
    """Tokens with their stems: the stemmer runs once per distinct type."""
    return tokens.join(stem_types(tokens, column), column, "left")


def stem_text(lines: DataFrame, column: str = "text") -> DataFrame:
    """Lines with every letter run stemmed (stem_line), other columns kept."""
    from tessera.session import ship

    ship(lines.sparkSession)
    at = lines.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.functions.stem import stem_line

        for b in batches:
            done = pa.array([None if t is None else stem_line(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([done if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return lines.mapInArrow(run, lines.schema)
