"""Cleaning of text columns: trimming, name keys, stable ids, null tokens, statuses, counts."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What exports write where they have no value.
NULL_TOKENS = ("Nsp", "nsp", "NSP", "Néant", "Neant", "néant", "", "None", "null", "NULL")
#: Category of a point whose operator is not known, as opposed to a null one.
UNKNOWN = "unknown"


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """The ASCII part of characters' compatibility decompositions: those with one letter or digit, these, and those with several."""
    one, many = [], {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if (whole := unicodedata.normalize("NFKD", c)) != c:
            plain = "".join(x for x in whole if x.isascii() and x.isalnum())
            if len(plain) == 1:
                one.append((c, plain))
            elif plain:
                many[c] = plain
    return "".join(a for a, _ in one), "".join(b for _, b in one), many


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_all(df: DataFrame) -> DataFrame:
    """Every string column stripped; the others as they are."""
    return df.select(*[stripped(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema])


def name_key(c: Column) -> Column:
    """A name's join key: decomposed, what is not ASCII dropped, upper case, letters A-Z and digits only.

    A character that decomposes into several letters or digits gives them all; one without an ASCII
    part, such as the sharp s, is dropped.
    """
    one, plain, many = _folding()
    pairs = F.str_to_map(F.lit("\n".join(f"{a}\t{b}" for a, b in many.items())), F.lit("\n"), F.lit("\t"))
    spelt = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(pairs, x), x)), "")
    # found by table: a class of so many characters in an expression is tried one after the other
    rare = F.when(F.translate(c, "".join(many), "") != c, spelt).otherwise(c)
    folded = F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(rare, one, plain))
    return F.upper(F.regexp_replace(folded, "[^A-Za-z0-9]", ""))


def degrees_text(micro: Column) -> Column:
    """Micro-degrees as the shortest decimal text of the degrees, with one decimal at least."""
    whole = F.abs(micro)
    fraction = F.regexp_replace(F.lpad((whole % 1_000_000).cast("string"), 6, "0"), "(?<=.)0+$", "")
    return F.concat(F.when(micro < 0, "-").otherwise(""), F.floor(whole / 1_000_000).cast("string"), F.lit("."), fraction)


def stable_id(name: Column, lon_u: Column, lat_u: Column) -> Column:
    """An id that survives re-exports: the start of the SHA-1 of name key and position."""
    return F.substring(F.sha1(F.concat_ws("|", name_key(name), degrees_text(lon_u), degrees_text(lat_u))), 1, 16)


def micro_degrees(degrees: Column) -> Column:
    return F.round(degrees * 1e6).cast("long")


def is_null_token(c: Column) -> Column:
    return c.isNull() | stripped(c).isin(*NULL_TOKENS)


def wkt_lon(c: Column) -> Column:
    return F.round(F.regexp_extract(c, r"POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)", 1).try_cast("double"), 6)


def wkt_lat(c: Column) -> Column:
    return F.round(F.regexp_extract(c, r"POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)", 2).try_cast("double"), 6)


def without_prefix(c: Column, prefix: str) -> Column:
    """A category without its fixed leading word."""
    return F.regexp_replace(c, rf"^{prefix}\s+", "")


def branch_is_active(status: Column, closed: str = "Ferm") -> Column:
    """Open unless the status says closed; an unknown status counts as open."""
    return ~F.coalesce(status.contains(closed), F.lit(False))


def data_centre_is_active(status: Column, used: str = "Utilise") -> Column:
    """In use only if the status says so; an unknown status counts as not in use."""
    return F.coalesce(status.contains(used), F.lit(False))


def operators_of(raw: Column) -> Column:
    """A multivalued operator as an array; unknown tokens become one category, null stays null."""
    parts = F.transform(F.split(raw, r"\s*,\s*"), lambda x: F.when(F.trim(x).isin("Nsp", "Neant", "Néant"), UNKNOWN).otherwise(F.trim(x)))
    return F.when(raw.isNotNull(), parts)


def parsed_count(c: Column) -> Column:
    """An integer written with blanks or no-break spaces between thousands; null if anything but digits is left."""
    digits = F.translate(c, " \u00a0", "")
    return F.when(digits.rlike("^[0-9]+$"), digits).try_cast("bigint")


def first_match(c: Column, classes: dict[str, str]) -> Column:
    """The name of the first class whose expression is found in the text, in either case; null if none is."""
    return F.coalesce(*[F.when(c.rlike(f"(?iu){pattern}"), F.lit(name)) for name, pattern in classes.items()])


def indent(line: Column) -> Column:
    """White space before the first other character."""
    return F.char_length(F.regexp_extract(line, r"(?U)^\s*", 0))


def parent_name(c: Column) -> Column:
    """`NAME` of a child called `NAME 3`; null for other names."""
    return F.nullif(F.regexp_extract(c, r"^(.+?)\s+(\d+)$", 1), F.lit(""))


def unit_kind(c: Column) -> Column:
    """total, level3 (the name ends in a number) or level2."""
    return F.when(c.rlike("(?i)^TOTAL"), "total").when(c.rlike(r"\d\s*$"), "level3").otherwise("level2")


def facility_label(kind: Column, operator: Column) -> Column:
    return F.when(kind == "data centre", F.lit("Data centre")).otherwise(F.concat(F.lit("Branch "), operator))
