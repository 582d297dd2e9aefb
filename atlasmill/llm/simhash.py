"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, connected components.

A fingerprint of 64 bits is split into 2 d blocks, where d is the distance that links. Two
fingerprints that differ in at most d bits agree on at least d whole blocks, so they meet under one
of the choices of d blocks (32 bits each; 6 choices at two bits, 70 at four), where their distance
is verified. Equal fingerprints are one node from the start. A bucket of few nodes compares its
pairs; in a larger one each node names itself and all fingerprints at most d / 2 differing bits
away: two nodes are at distance d or less if and only if they name one in common, so linking each
name's nodes to the smallest loses no link and emits no pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import keep_rows, per_text, row_key, staged

BITS, SHINGLE, DISTANCE = 64, 3, 2
#: Up to this many nodes, a bucket's pairs are compared one by one.
PAIRWISE = 32
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer. Words are runs without ASCII white space, A-Z in lower case."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans]
    ones, step = np.zeros(BITS, np.int64), 1 << 16
    for k in range(0, len(hashes), step):
        part = np.array(hashes[k : k + step], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints `nodes` (fp): those within `distance` bits are connected, no others.

    distance is even and 2 * distance divides 64: 2, 4 or 8, of which 8 needs 12,870 keys a node.
    """
    if distance < 2 or distance % 2 or BITS % (2 * distance):
        raise ValueError("distance must be even, and twice of it divide 64")
    width = BITS // (2 * distance)
    blocks = [((1 << width) - 1) << (k * width) for k in range(2 * distance)]
    masks = F.array(*[F.lit(_signed(sum(some))) for some in combinations(blocks, distance)])
    rows = nodes.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = rows.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = staged(rows.join(shared, ["k", "key"]), "buckets")
    few = members.filter(F.col("n") <= PAIRWISE)
    left, right = few.select("k", "key", F.col("fp").alias("a")), few.select("k", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["k", "key"]).filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    crowd = members.filter(F.col("n") > PAIRWISE).select("fp").distinct()
    return (pairs if crowd.isEmpty() else pairs.unionByName(_crowd_links(crowd, distance))).distinct()


def _crowd_links(crowd: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that connect the fingerprints `crowd` (fp) within `distance` bits, by names one bit away, then two and so on.

    From the second round on only names that different components share are linked.
    """
    at = crowd.withColumn("root", F.col("fp"))
    for radius in range(1, distance // 2 + 1):
        flips = [_signed(sum(1 << b for b in some)) for n in range(radius + 1) for some in combinations(range(BITS), n)]
        named = at.select("root", "fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select("root", F.col("fp").bitwiseXOR(F.col("flip")).alias("name"))
        least = named.groupBy("name").agg(F.min("root").alias("b"), F.max("root").alias("top")).filter("b < top").select("name", "b")
        stars = named.join(least, "name").filter("root <> b").select(F.col("root").alias("a"), "b")
        roots = components(stars).withColumnRenamed("root", "to")
        at = at.join(roots, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("to", "root").alias("root"))
    return at.filter("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))


def groups(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """A row per document: id, check, n_bytes, fp, and first, the (no_id, id, check, n_bytes) of its component's first document."""
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    key = ["id", "check", "n_bytes"]
    prints = staged(per_text(rows, "text", key, lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]], "fp long"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), *key)).alias("least"))
    roots = components(links(nodes.select("fp"), distance))
    linked = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("first"))
    return prints.join(linked.join(least, "root").select("fp", "first"), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """A row per document: id, fingerprint (16 hex digits), component_id.

    Fingerprints of shingles of `shingle` words link at `distance` or fewer differing bits.
    component_id is the smallest id that is reachable over links, the document's own included.
    Documents without words (null, empty, white space) have fingerprint zero and link like any
    other; fewer words than a shingle make one shingle. Null ids never are a component's id, unless
    it has no other. Repeated rows give repeated rows; an empty table gives an empty result; other
    columns are ignored.
    """
    found = groups(docs, id_col, text_col, shingle, distance)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The document with the smallest id of each component of near_groups, with all its columns.

    Of documents with the same id in one component the one with the smallest text hash stays, of
    repeated rows one occurrence. Null, empty and blank texts have fingerprint zero and are one
    component, of which one document stays; a null id stays only where a component has no other. An
    empty table gives an empty result.
    """
    found = groups(docs, id_col, text_col, shingle, distance).groupBy("id", "check", "n_bytes").agg(F.count("*").alias("copies"), F.min("first").alias("first"))
    mine = F.struct(F.col("id").isNull().alias("no_id"), "id", "check", "n_bytes")
    return keep_rows(docs, id_col, text_col, found.withColumn("kept", mine.eqNullSafe(F.col("first"))))
