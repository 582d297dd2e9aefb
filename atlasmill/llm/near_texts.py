"""Near-dedup of texts by long SimHash fingerprints: five-word shingles, similarity 0.8.

A text has two fingerprints of 1,024 bits: one of its set of words and one of its set of five-word
shingles. The words' fingerprint is split into 32 blocks of 32 bits. Texts that differ in at most 31
bits share a block by the pigeonhole principle, and near copies, whose words differ in some 60 bits,
share several: the blocks' join gives the candidates. A candidate pair is verified by the Hamming
distance of the shingles' fingerprints, which is the angle between the two sets and so their Jaccard
similarity, with a standard error of 0.026 at 0.8. Links make components, of which one text stays.

A block that few texts share compares them in pairs. In a larger one all are compared with a leader,
in rounds: those that are in no leader's component choose the next leader, until all are or ROUNDS are
over; so a group of near copies, however large, costs a row for each of its texts and blocks. What is
left, texts of one block in different components, is then compared in full, tile by tile, but for those
that the triangle inequality excludes: two texts whose distances to a leader differ by more bits than a
link may have. No pair that shares a block goes unseen. Rows grow with the texts and the tiles that they
meet; the comparisons of texts that share a block and are near misses of each other stay quadratic.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, keep_rows, per_text, row_key

#: 64-bit words of a fingerprint, and words of a shingle.
LONGS, SHINGLE = 16, 5
#: Similarity that links, less a little more than the fingerprint's standard error.
SIMILARITY, MARGIN = 0.8, 0.03
#: Up to so many texts a block compares in pairs.
PAIRWISE = 8
#: Rounds of leaders in blocks of more texts.
ROUNDS = 4
#: Texts on either side of one task that compares texts of a block.
PART = 2048
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEPS = (np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def majority_bits(hashes: np.ndarray) -> bytes:
    """The fingerprint of a set of 64-bit hashes: each bit is the one that more than half of them have."""
    ones, step = np.zeros(64 * LONGS, np.int64), 255  # so many fit a byte
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), step):
            x = hashes[k : k + step, None] + _STEPS
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def fingerprints(text: str) -> tuple[bytes, bytes]:
    """Of the set of words, and of the set of shingles (of fewer words than a shingle: of the whole sequence); zeros without words. A-Z count as lower case."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return bytes(8 * LONGS), bytes(8 * LONGS)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    spans = zip(starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist(), strict=True)
    shingles = np.fromiter({xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans}, np.uint64)
    return majority_bits(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in set(words)), np.uint64)), majority_bits(shingles)


def most_bits(similarity: float) -> int:
    """Differing bits that sets of equal size with that Jaccard similarity have on average."""
    return math.floor(64 * LONGS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _longs(print_: Column) -> Column:
    """A fingerprint's bytes as an array of longs."""
    return F.transform(F.sequence(F.lit(0), F.lit(LONGS - 1)), lambda k: F.conv(F.hex(F.substring(print_, k * 8 + 1, F.lit(8))), 16, -10).cast("long"))


def links_between(most: int, same: bool, root_a: np.ndarray, bits_a: np.ndarray, root_b: np.ndarray, bits_b: np.ndarray) -> set[tuple[int, int]]:
    """The pairs of different components that a text of either tile links; with `same` the tiles are one, and each pair is looked at once."""
    found = set()
    for r in np.unique(root_a):
        mine, others = bits_a[root_a == r], root_b > r if same else root_b != r
        theirs, roots = bits_b[others], root_b[others]
        at_once = max(1, (1 << 17) // max(1, len(theirs)))
        for k in range(0, len(mine) if len(theirs) else 0, at_once):
            apart = np.bitwise_count(mine[k : k + at_once, None] ^ theirs).sum(2, dtype=np.int64)
            found.update((int(r), int(o)) for o in np.unique(roots[(apart <= most).any(0)]))
    return found


def _rest(crowd: DataFrame, leaders: DataFrame, roots: DataFrame, prints: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """The links (a, b) in `crowd` (k, key, node) between components, as pairs of their roots: all pairs of a block that the distances to its `leaders` (k, key, b, sb) leave open.

    A block's texts are dealt to bands of distance to the first leader and, in a band, to tiles of PART
    texts at most. Pairs of bands whose ranges are too far apart for any leader go; each other pair of
    tiles is a task, which compares texts of different components and returns each pair of components
    once. So a text is copied once for each tile that it meets, not for each text or component.
    """
    block = ["k", "key"]
    placed = crowd.join(roots, "node", "left").select(*block, "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy(*block).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select(*block)
    marks = leaders.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("b", "sb"))).alias("marks"))
    rows = placed.join(mixed, block).join(marks, block).join(prints, "node")
    rows = rows.withColumn("far", F.transform("marks", lambda m: distance(F.col("shingles"), m["sb"]))).drop("marks")
    rows = scratch.staged(rows.withColumn("band", F.floor(F.col("far")[0] / (most + 1))), "mixed-blocks")
    ends = [f(F.get("far", F.lit(i))).alias(f"{n}{i}") for i in range(ROUNDS) for n, f in (("lo", F.min), ("hi", F.max))]
    bands = scratch.staged(rows.groupBy(*block, "band").agg(F.ceil(F.count("*") / PART).alias("parts"), *ends), "bands")
    named = lambda side: bands.select(*block, *[F.col(c).alias(f"{side}_{c}") for c in bands.columns if c not in block])
    met = named("a").join(named("b"), block).filter("a_band <= b_band")
    for i in range(ROUNDS):
        # a block with fewer leaders has nulls, which exclude nothing
        met = met.filter(F.coalesce((F.col(f"a_lo{i}") - F.col(f"b_hi{i}") <= most) & (F.col(f"b_lo{i}") - F.col(f"a_hi{i}") <= most), F.lit(True)))
    for side in "ab":
        met = met.withColumn(f"{side}_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{side}_parts") - 1)))
    tile = lambda side: F.struct(F.col(f"{side}_band").alias("band"), F.col(f"{side}_part").alias("part"))
    tasks = met.select(*block, tile("a").alias("ta"), tile("b").alias("tb")).filter("ta <= tb").withColumn("task", F.xxhash64(*block, "ta", "tb"))
    sides = F.when(F.col("ta") == F.col("tb"), F.array(F.struct(F.lit(0).alias("side"), F.col("ta").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("ta").alias("t")), F.struct(F.lit(1).alias("side"), F.col("tb").alias("t"))))
    tasks = tasks.select(*block, "task", F.explode(sides).alias("s")).select(*block, "task", "s.side", "s.t.band", "s.t.part")
    dealt = rows.join(bands.select(*block, "band", "parts"), [*block, "band"])
    dealt = dealt.select(*block, "band", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "root", "shingles")

    def compared(group: pa.Table) -> pa.Table:
        side, root = group.column("side").to_numpy(), group.column("root").to_numpy()
        bits = group.column("shingles").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)
        a, b = side == 0, side == 1
        # a task of one tile has one side only
        one = not b.any()
        b = a if one else b
        found = sorted(links_between(most, one, root[a], bits[a], root[b], bits[b]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    told = tasks.join(dealt, [*block, "band", "part"]).select(*block, "task", "side", "root", "shingles")
    return told.groupBy(*block, "task").applyInArrow(compared, "a long, b long").distinct()


def _edges(nodes: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(node, root) of the components of `nodes` (node, words, shingles; both arrays of longs)."""
    block = F.posexplode(F.flatten(F.transform("words", lambda x: F.array(F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))))).alias("k", "key")
    rows = nodes.select("node", block)
    shared = rows.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = scratch.staged(rows.join(shared, ["k", "key"]), "blocks")
    prints = nodes.select("node", "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) within the distance."""
        of_a = prints.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        of_b = prints.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        return pairs.join(of_a, "a").join(of_b, "b").filter(distance(F.col("sa"), F.col("sb")) <= most).select("a", "b")

    few = members.filter(F.col("n") <= PAIRWISE)
    left, right = few.select("k", "key", F.col("node").alias("a")), few.select("k", "key", F.col("node").alias("b"))
    edges = scratch.staged(verified(left.join(right, ["k", "key"]).filter("a < b").select("a", "b").distinct()), "near-pairs")
    crowd = members.filter(F.col("n") > PAIRWISE).select("k", "key", "node")
    lead = F.min_by(F.struct("node", "shingles"), F.xxhash64("k", "key", "node")).alias("leader")
    left_over, roots, leaders = crowd, None, None
    for _ in range(ROUNDS if not crowd.isEmpty() else 0):
        # each block's leader carries its fingerprint, so that no text meets all rows of a leader
        chosen = left_over.join(prints, "node").groupBy("k", "key").agg(lead).select("k", "key", F.col("leader.node").alias("b"), F.col("leader.shingles").alias("sb"))
        chosen = scratch.staged(chosen, "leaders")
        leaders = chosen if leaders is None else leaders.unionByName(chosen)
        met = left_over.join(chosen, ["k", "key"]).filter("node <> b").select(F.col("node").alias("a"), "b", "sb")
        close = met.join(prints.withColumnRenamed("node", "a"), "a").filter(distance(F.col("shingles"), F.col("sb")) <= most).select("a", "b")
        edges = scratch.staged(edges.unionByName(close.distinct()), "near-pairs")
        roots = components(edges)
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        placed = left_over.join(of("node"), "node", "left").withColumn("own", F.coalesce("node_root", "node"))
        heads = chosen.select("k", "key", "b").join(of("b"), "b", "left").select("k", "key", F.coalesce("b_root", "b").alias("head"))
        left_over = scratch.staged(placed.join(heads, ["k", "key"]).filter("own <> head").select("k", "key", "node"), "left-over")
        if left_over.isEmpty():
            break
    if roots is None:
        return components(edges)
    more = scratch.staged(_rest(crowd, leaders, roots, prints, most, scratch), "near-pairs")
    return roots if more.isEmpty() else components(edges.unionByName(more))


def near_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: id, check, n_bytes (which tell rows apart), and first, the (no_id, id, check, n_bytes) of its group's first document.

    Null, empty and blank texts have fingerprints of zeros and are one group. Repeated rows give
    repeated rows; null ids come last in a group; an empty table gives an empty result.
    """
    scratch = Scratch()
    key = ["id", "check", "n_bytes"]
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))

    def work(texts: list[str]) -> list:
        made = [fingerprints(t) for t in texts]
        return [[m[0] for m in made], [m[1] for m in made]]

    prints = per_text(rows, "text", key, lambda: work, "words binary, shingles binary")
    prints = scratch.staged(prints.withColumn("node", F.xxhash64("words", "shingles")), "fingerprints")
    nodes = prints.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), *key)).alias("least"), F.min("words").alias("words"), F.min("shingles").alias("shingles"))
    nodes = scratch.staged(nodes.select("node", "least", _longs(F.col("words")).alias("words"), _longs(F.col("shingles")).alias("shingles")), "nodes")
    roots = _edges(nodes, most_bits(similarity - MARGIN), scratch)
    linked = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = linked.groupBy("root").agg(F.min("least").alias("first"))
    return prints.select(*key, "node").join(linked.join(first, "root").select("node", "first"), "node").select(*key, "first")


def drop_near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The document with the smallest id of each group of near copies, with all its columns and no others.

    Of documents with the same id in one group the one with the smallest text hash stays, of repeated
    rows one occurrence; a null id stays only where a group has no other. An empty table gives an
    empty result.
    """
    found = near_text_groups(docs, id_col, text_col, similarity).groupBy("id", "check", "n_bytes").agg(F.count("*").alias("copies"), F.min("first").alias("first"))
    mine = F.struct(F.col("id").isNull().alias("no_id"), "id", "check", "n_bytes")
    return keep_rows(docs, id_col, text_col, found.withColumn("kept", mine.eqNullSafe(F.col("first"))))
