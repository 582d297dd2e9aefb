"""Queries on printed census tables: pages of text, made from the tables, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parsed_count
from ..operators.ordered import TableRules, classified_pages, merge_labels, pages, table_rows, without_sub_units
from . import fixtures as X
from .inventory import PRELUDE
from .registry import query

# Words that a label does not end on, and words that it does not start with.
CONNECTORS = ("DE", "DU", "DES", "D'", "LA", "LE", "LES", "ET", "SANS", "GRAND", "GRANDE", "SUR", "AU", "AUX", "PREFECTURE", "COMMUNE", "REGION")
OPENERS = ("SANS", "ET")
RULES = TableRules(
    mark=r"Tableau\s*\d+\s*:",
    classes={
        "level1": r"résidente\s+des\s+régions\s+par\s+sexe",
        "level2": r"résidente\s+du\s+Togo\s+par\s+préfecture",
        "level3": r"résidente\s+par\s+commune\s+et\s+sexe",
        "quarter": r"résidente\s+des\s+quartiers",
        "level4": r"résidente\s+des\s+cantons",
        "town": r"résidente\s+des\s+villes",
    },
    context=r"(?iu)préfecture\s+de\s+([^(]+?)\s*(?:\(Région|$)",
    total="Ensemble",
    noise=r"(?iu)^(Tableau|Graphique|Source|Région\s*/|Préfecture\s*/|Commune\s*/|Sexe|Masculin|Féminin|[IVX]+\.\s|[0-9]+\.[0-9]+\s)",
    connectors=CONNECTORS,
    openers=OPENERS,
)


def _grouped(n: Column) -> Column:
    """Thousands apart: by a no-break space where the number is even, else by a blank."""
    text = F.format_number(n, 0)
    return F.when(n % 2 == 0, F.translate(text, ",", "\u00a0")).otherwise(F.translate(text, ",", " "))


def _line(label: Column, n: Column) -> Column:
    """A table's line: label, men, women and their sum."""
    men = F.floor(n / 3)
    return F.concat(F.rpad(label, 40, " "), *[F.lpad(_grouped(x), 16, " ") for x in (men, n - men, n)])


def booklets(spark: SparkSession, d: str) -> DataFrame:
    """(doc, text): per first-level unit a booklet with a summary, a page per second-level unit, and pages that the rules leave out.

    A unit's first child is printed over two lines, split at a hyphen; the second follows a connector.
    Each page has a sub-unit's row, which starts with a hyphen, and the country's. On the page of a unit whose number is a multiple of 7 a value is missing.
    """
    units = X.units2(spark, d).select("level2", "k2")
    rows = X.population3(spark, d).join(F.broadcast(units), "level2").withColumn("seg", F.regexp_extract("level3", r"(\d+)$", 1).cast("int"))
    name = F.col("level2")
    spelt = F.when(F.col("seg") == 1, F.concat(F.lit("BAS-\n"), _line(F.concat(name, F.lit(" 1")), F.col("population")))).when(
        F.col("seg") == 2, F.concat(F.lit("Commune de\n"), _line(F.concat(name, F.lit(" 2")), F.col("population")))
    ).when((F.col("seg") == 3) & (F.col("k2") % 7 == 0), F.col("level3")).otherwise(_line(F.col("level3"), F.col("population")))
    head = F.concat(F.lit("Tableau "), F.col("k2").cast("string"), F.lit(": Population résidente par commune  et sexe, préfecture de "), name, F.lit(" (Région "), F.col("level1"), F.lit(")\n"))
    title = F.concat(F.rpad(F.lit("Commune / Canton"), 40, " "), F.lpad(F.lit("Masculin"), 16, " "), F.lpad(F.lit("Féminin"), 16, " "), F.lpad(F.lit("Ensemble"), 16, " "))
    lines = rows.groupBy("level1", "level2", "k2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", spelt.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.sum("population").alias("sum"))
    parts = F.concat(_line(F.lit("- dont urbain"), F.col("sum")), F.lit("\n"), _line(F.lit("TOGO"), F.col("sum")))
    page = lines.select("level1", "k2", F.concat(head, title, F.lit("\n"), "lines", F.lit("\n"), parts, F.lit("\n"), _line(F.concat(F.lit("TOTAL "), name), F.col("sum")), F.lit("\nSource : recensement")).alias("page"))
    body = page.groupBy("level1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k2", "page"))), lambda x: x["page"]), "\f").alias("body"))
    return body.select(F.col("level1").alias("doc"), F.concat(F.lit("Sommaire\nTableau 1: a\nTableau 2: résidente des régions par sexe\f"), "body", F.lit("\fnotes without a table")).alias("text"))


@query(PRELUDE + """k AS (SELECT u2.level1, k2, u2.level2, p3.level3, population, regexp_extract(level3, '(\\d+)$', 1)::INT AS seg FROM p3 JOIN u2 ON u2.level2 = p3.level2),
n AS (SELECT k2, dense_rank() OVER (PARTITION BY level1 ORDER BY k2) + 1 AS page FROM (SELECT DISTINCT level1, k2 FROM k))
SELECT level1 AS doc, page::INT AS page, level2 AS context, CASE seg WHEN 1 THEN 'BAS-' || level2 || ' 1' WHEN 2 THEN 'Commune de ' || level2 || ' 2' ELSE level3 END AS label, population AS value
FROM k JOIN n USING (k2) WHERE k2 % 7 <> 0 OR NOT EXISTS (SELECT 1 FROM k x WHERE x.k2 = k.k2 AND x.seg = 3)""")
def census_rows(spark: SparkSession, d: str) -> DataFrame:
    """Booklets read back: classified pages, carried titles, merged labels, values by column, pairing, no totals."""
    found = table_rows(pages(booklets(spark, d), "doc", "text"), "doc", RULES)
    return without_sub_units(found, "label", "TOGO").select("doc", "page", "context", "label", "value")


@query(PRELUDE + """k AS (SELECT level2, level3, regexp_extract(level3, '(\\d+)$', 1)::INT AS seg FROM p3)
SELECT level2, CASE seg WHEN 1 THEN 'BAS-' || level3 WHEN 2 THEN 'prefecture De ' || level3 WHEN 3 THEN level3 || ' sans centre' ELSE level3 END AS label FROM k""")
def merged_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names split over two rows by hyphen, connector or opener, put together again."""
    k = X.population3(spark, d).select("level2", "level3", F.regexp_extract("level3", r"(\d+)$", 1).cast("int").alias("seg"))
    name = F.col("level3")
    parts = F.when(F.col("seg") == 1, F.array(F.lit("BAS- "), F.concat(F.lit(" "), name))).when(F.col("seg") == 2, F.array(F.lit("prefecture De"), name)).when(F.col("seg") == 3, F.array(name, F.lit("sans centre"))).otherwise(F.array(name))
    rows = k.select("level2", "seg", F.posexplode(parts).alias("p", "label")).withColumn("n", F.col("seg") * 2 + F.col("p"))
    return merge_labels(rows, ["level2"], "n", "label", CONNECTORS, OPENERS).select("level2", "label")


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 1000 + 5 WHEN 2 THEN o_custkey * 1000 + 7 END AS n FROM orders""")
def parsed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts written with blanks and no-break spaces; signs, tabs, letters and nothing at all give null."""
    k = F.col("o_custkey").cast("string")
    written = F.element_at(F.array(k, F.concat(k, F.lit(" 005")), F.concat(F.lit(" "), k, F.lit("\u00a0007 ")), F.concat(F.lit("-"), k), F.concat(k, F.lit("\t1")), F.concat(k, F.lit("a")), F.lit(" ")), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return X.table(spark, d, "orders").select("o_orderkey", parsed_count(written).alias("n"))


# A title of each class; those of a second-level unit name it.
TITLES = (
    ("level1", "Population résidente  des régions par sexe", ""),
    ("level2", "Population résidente du Togo\npar préfecture et sexe", ""),
    ("level3", "Population résidente par commune et sexe, préfecture de {} (Région {})", "context"),
    ("quarter", "Population RÉSIDENTE des quartiers, préfecture de {}", "context"),
    ("level4", "Population résidente des cantons, préfecture de {} (Région {})", "context"),
    ("town", "Population résidente des villes", ""),
    (None, "continued", ""),
)


@query(PRELUDE + f"""t AS (SELECT i, [{', '.join(repr(x or 'town') for x, *_ in TITLES)}][i + 1] AS level, i IN (2, 3, 4) AS named FROM range({len(TITLES)}) r(i))
SELECT level1 AS doc, (k2 * {len(TITLES)} + i)::INT AS page, level, CASE WHEN named THEN level2 ELSE '' END AS context FROM u2, t""")
def page_classes(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every class of title, and one without a title, which carries on the class before it."""
    bodies = []
    for level, title, _ in TITLES:
        start, *rest = title.split("{}")
        names = (F.col("level2"), F.col("level1"))
        text = F.concat(F.lit(start), *[c for name, piece in zip(names, rest, strict=False) for c in (name, F.lit(piece))])
        bodies.append(F.concat(F.lit("Tableau 7 : "), text) if level else text)
    rows = X.units2(spark, d).select("level1", "k2", F.posexplode(F.array(*bodies)).alias("i", "body"))
    found = classified_pages(rows.select(F.col("level1").alias("doc"), (F.col("k2") * len(TITLES) + F.col("i")).cast("int").alias("page"), "body"), "doc", RULES)
    return found.select("doc", "page", "level", "context")
