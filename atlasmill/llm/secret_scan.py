"""Secret scans by a trigram inverted index, in DataFrame and SQL functions only.

Each rule's expression gives a Boolean trigram query. The index holds, for each trigram that the
rules ask for, the documents with it: compressed posting bitmaps over hashed document slots, in
chunks of 32,768 slots. A rule's query is answered on the postings alone: bitmaps are intersected
within an alternative, united over a clause's alternatives and intersected over clauses. Documents
in the result are candidates (slots may be shared, so they are a superset), and the rule's
expression verifies them on the whole text. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_KEYS, row_key, staged, text_or_empty
from .trigram_query import trigram_query

CHUNK = 32768
#: Candidate bitmaps up to so many bytes go to every task; larger ones are joined with keys, not with texts.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` count if `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # maximal runs: the same as runs of any length of which short ones are dropped
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _terms(rules: tuple[Rule, ...]) -> list[tuple[int, int, int, str, int, int]]:
    """(rule, clause, alternative, trigram, trigrams in the alternative, clauses of the rule)."""
    out = []
    for r, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        for c, clause in enumerate(query):
            out += [(r, c, a, t, len(alternative), len(query)) for a, alternative in enumerate(clause) for t in alternative]
    return out


def _slot(slots: int) -> Column:
    """A row's slot, by its id and text, so that rows with one id, or with none, are dealt out too."""
    return F.pmod(F.xxhash64("id", "text"), F.lit(slots)) + 1


def postings(rows: DataFrame, trigrams: list[str], slots: int) -> DataFrame:
    """The inverted index: (trigram, chunk, bitmap of slots). `rows` has id and text."""
    low = rows.select(_slot(slots).alias("slot"), F.lower("text").alias("low"))
    found = low.select("slot", F.explode(F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))).alias("trigram"))
    dealt = found.select("trigram", F.bitmap_bucket_number("slot").alias("chunk"), F.bitmap_bit_position("slot").alias("bit"))
    # dealt out first: bitmaps are made once, not for every task and chunk
    return dealt.repartition("trigram", "chunk").groupBy("trigram", "chunk").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def candidates(index: DataFrame, terms: list[tuple]) -> DataFrame:
    """(chunk, bitmaps: rule -> bitmap of its candidates)."""
    values = ", ".join(f"({r}, {c}, {a}, {_literal(t)}, {n}, {m})" for r, c, a, t, n, m in terms)
    wanted = index.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(rule, clause, alternative, trigram, n_trigrams, n_clauses)")
    every = (
        index.join(F.broadcast(wanted), "trigram")
        .groupBy("rule", "clause", "alternative", "chunk", "n_trigrams", "n_clauses")
        .agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n"))
        .filter("n = n_trigrams")
    )
    any_of = every.groupBy("rule", "clause", "chunk", "n_clauses").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    both = any_of.groupBy("rule", "chunk", "n_clauses").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n")).filter("n = n_clauses")
    return both.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("rule", "bitmap"))).alias("bitmaps"))


def _is_candidate(rule: int) -> Column:
    bitmap = F.col("bitmaps")[F.lit(rule)]
    byte = F.conv(F.hex(F.substring(bitmap, (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1, F.lit(False))


def _with_candidates(placed: DataFrame, chosen: DataFrame, indexed: list[int]) -> DataFrame:
    """look<rule> for each text, by a join of the bitmaps with rows that hold no text: only the keys of candidates come back to the texts."""
    key = row_key("id", "text")
    found = placed.select(*key, "chunk", "bit").join(chosen, "chunk").select("id", "check", "n_bytes", *[_is_candidate(k).alias(f"look{k}") for k in indexed])
    keys = found.groupBy("id", "check", "n_bytes").agg(*[F.bool_or(f"look{k}").alias(f"look{k}") for k in indexed])
    keys = staged(keys.filter(" OR ".join(f"look{k}" for k in indexed)), "candidate-keys")
    keys = keys.select(F.col("id").alias("c_id"), F.col("check").alias("c_check"), F.col("n_bytes").alias("c_bytes"), *[f"look{k}" for k in indexed])
    few = keys.count() <= BROADCAST_KEYS
    same = F.col("id").eqNullSafe(F.col("c_id")) & (key[1] == F.col("c_check")) & (key[2] == F.col("c_bytes"))
    joined = placed.select("id", "text").join(F.broadcast(keys) if few else keys, same, "left")
    return joined.select("id", "text", *[F.coalesce(f"look{k}", F.lit(False)).alias(f"look{k}") for k in indexed])


#: Matches whose spans are summed up together; the blocks' starts are then sums of whole blocks.
_BLOCK = 256


def _spans(kind: int, rule: Rule) -> Column:
    """Array of (start, kind, end) of the rule's matches in `text`, in code points.

    A match starts where the texts between matches and the matches before it end: running sums, by blocks.
    """
    pattern, text = F.lit(rule.pattern), F.col("text")
    hits, values = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern), F.lit(1), F.size(hits))
    sized = F.arrays_zip(
        F.transform(gaps, F.char_length).alias("gap"), F.transform(hits, F.char_length).alias("length"), F.transform(values, F.char_length).alias("value")
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["length"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    def moved(block: Column, by: Column) -> Column:
        return F.transform(block["found"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    count = F.ceil(F.size(sized) / _BLOCK).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(numbers, lambda b: F.aggregate(F.slice(sized, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("found")), step))
    starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
    all_spans = F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), moved))
    kept = F.filter(all_spans, lambda s: s["value"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[Rule, ...] = MORE) -> DataFrame:
    """A row per document: id, n_assign, n_access, n_hex, base_sha256, spans.

    Matches are leftmost and do not overlap within a kind. Spans are kind:start:end, in code points,
    by start and then by kind; those of the rules `more` come in addition to the base ones. A null
    text counts as empty; repeated rows give repeated rows; an empty table gives an empty result;
    other columns are ignored.
    """
    rules = BASE + tuple(more)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    terms = _terms(rules)
    indexed = {t[0] for t in terms}
    slots = 1 << max(15, (docs.count() - 1).bit_length())
    index = staged(postings(rows, sorted({t[3] for t in terms}), slots), "postings")
    chosen = staged(candidates(index, terms), "candidates")
    held = (chosen.agg(F.sum(F.size("bitmaps"))).first()[0] or 0) * CHUNK // 8
    placed = rows.withColumn("slot", _slot(slots)).select("id", "text", F.bitmap_bucket_number("slot").alias("chunk"), F.bitmap_bit_position("slot").alias("bit"))
    if held <= BROADCAST_BYTES:
        joined = placed.join(F.broadcast(chosen), "chunk", "left").withColumns({f"look{k}": _is_candidate(k) for k in sorted(indexed)})
    else:
        joined = _with_candidates(placed, chosen, sorted(indexed))
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for k, rule in enumerate(rules):
        look = F.col(f"look{k}") if k in indexed else F.col("text").rlike(rule.pattern)
        found.append(F.when(look, _spans(k, rule)).otherwise(nothing).alias(f"s{k}"))
    spans = joined.select("id", *found)
    base, every = [F.col(f"s{k}") for k in range(len(BASE))], [F.col(f"s{k}") for k in range(len(rules))]
    return spans.select(
        F.col("id").alias(id_col),
        *[F.size(s).cast("long").alias(f"n_{r.kind}") for s, r in zip(base, BASE, strict=True)],
        F.sha2(_joined(F.concat(*base), rules), 256).alias("base_sha256"),
        _joined(F.concat(*every), rules).alias("spans"),
    )
