"""Ordered context: carried titles, segments opened by a parent row, split labels, pairing by position."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_match, indent, parent_name, parsed_count, stripped, unit_kind


def carried(rows: DataFrame, by: list[str], order: list[str], value: Column, to: str) -> DataFrame:
    """Adds `to`: the last non-null value up to this row, within each document."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(upto))


def segments(rows: DataFrame, by: list[str], order: list[str], opens: Column, to: str = "segment") -> DataFrame:
    """Adds `to`: how many opening rows came so far; 0 before the first."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.sum(opens.cast("int")).over(upto))


def segment_sums(rows: DataFrame, by: list[str], order: list[str], opens: Column, value: str) -> DataFrame:
    """(by, segment, parent, children, ok): an opening row's value against the sum of those that follow it."""
    s = segments(rows.withColumn("__opens", opens), by, order, F.col("__opens")).filter("segment > 0")
    sums = s.groupBy(*by, "segment").agg(F.sum(F.when(F.col("__opens"), F.col(value))).alias("parent"), F.coalesce(F.sum(F.when(~F.col("__opens"), F.col(value))), F.lit(0)).alias("children"))
    return sums.withColumn("ok", F.col("parent") == F.col("children"))


def hierarchical_sums(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(parent, declared, children, n_children, ok): `NAME` against the sum of `NAME 1`, `NAME 2`, ...; parents without children are left out."""
    children = rows.withColumn("parent", parent_name(F.col(name))).filter("parent IS NOT NULL").groupBy("parent").agg(F.sum(value).alias("children"), F.count("*").alias("n_children"))
    return rows.join(children, F.col(name) == F.col("parent")).select("parent", F.col(value).alias("declared"), "children", "n_children", (F.col(value) == F.col("children")).alias("ok"))


def pages(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, page, body): a text's pages, separated by form feeds, from 1."""
    return texts.select(doc, F.posexplode(F.split(text, "\f")).alias("n", "body")).select(doc, (F.col("n") + 1).alias("page"), "body")


def page_context(page_rows: DataFrame, doc: str, title: str) -> DataFrame:
    """Adds `context`, the title last seen; pages with several titles (summaries) are left out and carry nothing on. `title` is a regular expression with one group."""
    found = page_rows.withColumn("__titles", F.regexp_extract_all("body", F.lit(title), F.lit(1))).filter(F.size("__titles") <= 1)
    return carried(found, [doc], ["page"], F.get("__titles", F.lit(0)), "context").drop("__titles")


def paired(left: DataFrame, right: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows of both sides joined by their position within each group; groups whose sides differ in length are left out."""
    w, group = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    a = left.withColumn("__n", F.row_number().over(w)).withColumn("__size", F.count("*").over(group)).drop(order)
    b = right.withColumn("__n", F.row_number().over(w)).withColumn("__size", F.count("*").over(group)).drop(order)
    return a.join(b, [*by, "__n", "__size"]).drop("__size").withColumnRenamed("__n", "position")


def merge_labels(rows: DataFrame, by: list[str], order: str, label: str, connectors: tuple[str, ...], openers: tuple[str, ...]) -> DataFrame:
    """Labels that were split over two rows, put together.

    A label that ends in a hyphen takes the next row, without a blank between; one that ends on a
    connector, or whose next row starts with an opener, takes it with one. Words count in either case.
    From the top; a taken row takes none.
    """

    def merged(label_rows: pd.DataFrame) -> pd.DataFrame:
        ordered = label_rows.sort_values(order, kind="stable")
        texts, orders = [x or "" for x in ordered[label].tolist()], ordered[order].tolist()
        out, k = [], 0
        while k < len(texts):
            now, after = texts[k], texts[k + 1] if k + 1 < len(texts) else None
            last, opener = (now.split() or [""])[-1].upper(), ((after or "").split() or [""])[0].upper()
            hyphen = after is not None and now.rstrip().endswith("-")
            joins = hyphen or after is not None and (last in connectors or opener in openers)
            out.append((orders[k], now.rstrip() + after.lstrip() if hyphen else f"{now} {after}".strip() if joins else now))
            k += 2 if joins else 1
        keys = {c: ordered[c].iloc[0] for c in by}
        return pd.DataFrame([{**keys, order: o, label: t} for o, t in out])

    schema = rows.select(*by, order, label).schema
    return rows.select(*by, order, label).groupBy(*by).applyInPandas(merged, schema)


@dataclass(frozen=True)
class TableRules:
    """How the pages of printed tables are read. Expressions are Java's; `context` has one group; words are upper case."""

    mark: str
    classes: dict[str, str]
    context: str
    total: str
    noise: str
    connectors: tuple[str, ...]
    openers: tuple[str, ...]
    most_indent: int = 3
    slack: int = 8


def classified_pages(page_rows: DataFrame, doc: str, rules: TableRules) -> DataFrame:
    """(doc, page, body, level, context): pages with at most one title, with the class and context of the last title that has a class."""
    one = page_rows.filter(F.size(F.regexp_extract_all("body", F.lit(rules.mark), F.lit(0))) <= 1)
    title = F.trim(F.regexp_replace(F.regexp_extract("body", rf"(?s){rules.mark}(.{{0,200}})", 1), r"(?U)\s+", " "))
    found = one.withColumn("__title", title).withColumn("__level", first_match(F.col("__title"), rules.classes))
    seen = F.when(F.col("__level").isNotNull(), F.struct(F.col("__level").alias("level"), F.trim(F.regexp_extract("__title", rules.context, 1)).alias("context")))
    return carried(found, [doc], ["page"], seen, "__seen").select(doc, "page", "body", "__seen.level", "__seen.context").filter("level IS NOT NULL")


def table_rows(page_rows: DataFrame, doc: str, rules: TableRules) -> DataFrame:
    """(doc, page, position, level, context, label, value): the rows of printed tables, a label's value from the column of totals.

    Below or above the line with the word `total`, a line gives a label if it is little indented, and
    a value if its last part is a number that stands under that word. Noise lines are skipped. Pages
    whose labels and values differ in number are left out.
    """
    by = [doc, "page"]
    pages = classified_pages(page_rows, doc, rules).withColumn("lines", F.split("body", r"\r?\n"))
    pages = pages.withColumn("header", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit(rules.total))), True)).filter("header > 0")
    pages = pages.withColumn("column", F.instr(F.get("lines", F.col("header").cast("int") - 1), rules.total) - 1)
    lines = pages.select(*by, "column", "header", F.posexplode("lines").alias("n", "line")).filter("n + 1 <> header").withColumn("text", stripped(F.col("line")))
    lines = lines.filter((F.col("text") != "") & ~F.col("text").rlike(rules.noise)).withColumn("parts", F.split("text", r"(?U)\s{3,}"))
    first = stripped(F.regexp_replace(F.get("parts", F.lit(0)), r"(?U)\s{2,}\d[\d\s]*$", ""))
    labels = lines.withColumn("label", first).filter((F.col("label") != "") & ~F.col("label").rlike(r"(?U)^\d[\d\s]*$") & (indent(F.col("line")) <= rules.most_indent))
    last = F.element_at("parts", -1)
    end = F.char_length(F.regexp_replace("line", r"(?U)\s+$", ""))
    values = lines.withColumn("value", parsed_count(last)).filter((F.col("value").isNotNull()) & (end - F.char_length(last) >= F.col("column") - rules.slack))
    whole = merge_labels(labels, by, "n", "label", rules.connectors, rules.openers)
    return paired(whole, values.select(*by, "n", "value"), by, "n").join(pages.select(*by, "level", "context"), by)


def without_sub_units(rows: DataFrame, label: str, country: str) -> DataFrame:
    """Rows that add up to the country: no totals, no sub-units (which start with a hyphen), not the country itself."""
    name = stripped(F.col(label))
    return rows.filter((unit_kind(name) != "total") & ~name.startswith("-") & (F.upper(name) != country))
