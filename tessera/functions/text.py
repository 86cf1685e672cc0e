"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of the C locale, spelt out: other engines' \s differ.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    """White-space tokens of a text; null and empty give an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda x: x != "")


def drop_first(tokens_column: Column, k: int) -> Column:
    """Tokens without the first k."""
    return F.slice(tokens_column, k + 1, F.greatest(F.size(tokens_column) - k, F.lit(0))) if k else tokens_column


def keep_fields(c: Column, fields: list[int], sep: str = " ", complement: bool = False) -> Column:
    """Fields of a delimited line by number from 1, or all others."""
    parts = F.split(c, f"[{sep}]")
    wanted = F.array(*[F.lit(f) for f in fields])
    keep = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda s: F.array_contains(wanted, s["i"]) != F.lit(complement))
    return F.array_join(F.transform(keep, lambda s: s["x"]), sep)


def from_char(c: Column, k: int) -> Column:
    """A line from its k-th character on."""
    return F.substring(c, k, 2147483647)


def chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered global replacements: (pattern, replacement)."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


# Ordered replacements of the listing, quotation and reply cleaners.
LISTING_PADS = [(",", " , "), ("[.]", " . "), ("!", " ! "), ("[(]", " ( "), ("[)]", " ) "), (";", " ; "), (":", " : "), ("/", " / "), ("[*]", " * "), ('["]', ' " '), ("~~~", " "), ("  *", " ")]
LISTING_JOINS = [(" w / ", " w/ "), ("([0-9]) [.] ([0-9])", "$1.$2"), ("([0-9]) , ([0-9])", "$1,$2"), ("([a-z])- ", "$1 - "), (" 1 / 2 ", " 1/2 "), (" [.] [.] [.] ", " ... ")]
QUOTES = [(" '([A-Za-z])", " ' $1"), ("([A-Za-z])' ", "$1 ' "), ("^'([A-Za-z])", "' $1"), ("([A-Za-z])'$", "$1 '"), ("([A-Za-z])'s ", "$1 's ")]
REPLIES = [
    ("n't", " not "), ("'s", " is"), ("'m", " am"), ("'d", " would"), ("'ve", " have"), ("'re", " are"),
    ("dk", "do not know"), ("<dk>", "do not know"), ("dk", "do not know"), ("d.k.", "do not know"), ("<rf>", "refused"),
    ("([^ \\t\\n\\x0B\\f\\r])[.]", "$1 ."), ("<>", " . "), ("[?]", " "), (";", " "), ('"', ""), ("\\\\", ""),
]
ONLY_NUMBERS = "^[0-9,. \\t]+$"


def clean_quotes(c: Column) -> Column:
    """Detach opening and closing apostrophes and possessives."""
    return chain(c, QUOTES)


def clean_listing(c: Column) -> Column:
    """Tokens of a property listing, separated by single spaces."""
    return clean_quotes(chain(ascii_lower(chain(c, LISTING_PADS)), LISTING_JOINS))


def clean_reply(c: Column) -> Column:
    """Survey replies: contractions and answer codes written out."""
    return chain(c, REPLIES)


def reply_tokens(c: Column) -> Column:
    """Lower-case tokens between single spaces."""
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), " "), lambda x: x != "")


def is_text_line(c: Column) -> Column:
    """False for blank lines, lines of digits and points, and lines with NR."""
    return (c != "") & ~c.rlike(ONLY_NUMBERS) & ~c.contains("NR")
