"""Numbers in text: numeric tokens and attributes of listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of numeric tokens and of the three attributes.
NUMERIC = "^(\\$|[0-9])[0-9,.\\-]*k?$"
SQUARE_FEET = "(\\d+(,\\d{3})*)((sq?ft?)|( sq(uare)? ?f(ee)?t))"
BEDROOMS = "(\\d(\\.\\d)?) ?((bd?rm?s?)|(bed(room)?s?))"
BATHROOMS = "(\\d(\\.\\d)?) ?((baths?)|bths?)"


def is_numeric(c: Column) -> Column:
    """A token that starts with $ or a digit and reads as a number, price or
    telephone number."""
    return c.rlike(NUMERIC)


def magnitude(c: Column) -> Column:
    """A numeric token as its order of magnitude: $100k is USD100000, a
    telephone number PH with its area code."""
    dollar = c.startswith("$")
    body = F.when(dollar, F.substring(c, 2, 1 << 30)).otherwise(c)
    # what stands before the sign that ends the scan: -, . or k
    head = F.regexp_extract(body, "^([0-9,]*)", 1)
    digits = F.replace(head, F.lit(","), F.lit(""))
    stop = F.substring(body, F.length(head) + 1, 1)
    phone = F.when(F.length(digits) == 3, F.concat(F.lit("PH"), digits)).otherwise(F.lit("PH"))
    full = F.when(stop == "k", F.concat(digits, F.lit("000"))).otherwise(digits)
    size = F.when(F.length(full) > 1, F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(full) - 1))).otherwise(full)
    return F.when(stop == "-", phone).otherwise(F.concat(F.when(dollar, F.lit("USD")).otherwise(F.lit("")), size))


def first_number(c: Column, pattern: str) -> Column:
    """The number in the first match's first group, commas dropped; else 0."""
    found = F.regexp_extract(c, pattern, 1)
    return F.coalesce(F.replace(found, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def square_footage(c: Column) -> Column:
    return first_number(c, SQUARE_FEET)


def bedrooms(c: Column) -> Column:
    return first_number(c, BEDROOMS)


def bathrooms(c: Column) -> Column:
    return first_number(c, BATHROOMS)


#: Named parsers of a text line, each a column expression.
PARSERS = {"square_footage": square_footage, "bedrooms": bedrooms, "bathrooms": bathrooms}


def parse_all(c: Column, parsers: dict | None = None) -> list[Column]:
    """One column a parser."""
    return [f(c).alias(name) for name, f in (parsers or PARSERS).items()]


def register(spark) -> None:
    """SQL functions of the same names, for use in spark.sql."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION square_footage(s STRING) RETURNS DOUBLE RETURN coalesce(try_cast(replace(regexp_extract(s, r'{SQUARE_FEET}', 1), ',', '') AS DOUBLE), 0D)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bedrooms(s STRING) RETURNS DOUBLE RETURN coalesce(try_cast(regexp_extract(s, r'{BEDROOMS}', 1) AS DOUBLE), 0D)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bathrooms(s STRING) RETURNS DOUBLE RETURN coalesce(try_cast(regexp_extract(s, r'{BATHROOMS}', 1) AS DOUBLE), 0D)")
