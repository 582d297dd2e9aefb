"""Line dedup by an exact set-similarity join.

A line is its set of words. Equal sets are settled first, by the earliest line of each 128-bit
digest and size; all later ones go. That is all there is to sets so small that one word more or less
takes them below the threshold. The others' earliest lines are joined: words are ordered by rarity
(counts over all documents, in a table of fixed size; equal counts by hash), so lines with Jaccard
similarity `threshold` or more share one of the first words of each: the prefix. Only prefixes are
shuffled, by word. Where a word's lines meet, a line is held against the earlier ones: by length, by
the word's positions, and by a parity sketch of the words, all of which keep every true pair. Each
line's likeliest candidate is then verified on the whole sets. Lines that it does not settle, though
others may match, meet all their partners again, by word and with their whole sets, and are verified
there. A line goes if any earlier line matches.

The texts are read as words twice, once for digests and word counts and once for prefixes; later
passes split only the lines that they look for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, parts, row_key, staged, text_or_empty

THRESHOLD = 0.8
#: Lines with fewer distinct words always stay, where a caller names no other number.
LEAST_WORDS = 1
#: Words are counted by hash in so many counters.
COUNTERS = 1 << 18
#: In groups of up to so many lines every earlier line is looked at together; larger ones are walked through in blocks.
SMALL = 32
BLOCK = 64
#: In larger groups than this, all lines count as candidates of those that have several.
MARKED = 16_384
#: Bits of a bitmap that goes to every task, at most (16 MB).
MOST_BITS = 1 << 27
_CHUNK = 32768
#: Prefix rows of a bucket of words, about; a task gathers twice as many before it hands them on.
BUCKET_ROWS = 500_000
#: A word counted more often than this, and than so many times the mean counter, is dealt out by the lines' sizes too.
HOT_WORD = 1 << 17
HOT_SHARE = 16
#: Sets that occur in more than this share of all lines are known to every task: 100,000 at most.
HOT_SET = 1e-5
#: Removed lines up to so many bytes go to every task.
BROADCAST_BYTES = 16 << 20

# Fixed values of the word hash: a random number for each byte (0 for ASCII white space) at each of so many positions.
_POSITIONS = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, (_POSITIONS, 256), np.uint64) | np.uint64(1)
_TABLE[:, _SPACE] = 0


def byte_values(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random number for each byte at its place in its word; farther on, the table's numbers are mixed with the round they are in."""
    value = _TABLE.ravel()[(place & (_POSITIONS - 1)) << 8 | data]
    far = np.flatnonzero((place >= _POSITIONS) & (value > 0))
    if len(far):
        value[far] = _mixed(value[far], place[far] >> 8)
    return value


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text and a 64-bit hash for each word: runs without ASCII white space, in order.

    A word's hash is the sum of its bytes' random numbers, which are independent from place to place:
    two different words have the same one with a probability of 2^-64, whatever they look like.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0] - first
    begins[heads] = inside[heads]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = data[start[0] :]
    span = np.diff(np.append(start, start[0] + len(data)))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(start - start[0], span)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(byte_values(data, place), start - start[0])
    return np.searchsorted(offsets - first, start, "right") - 1, _mixed(h)


class Lines:
    """The words of many lines at once; only lines of the bitmap, where one is given."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, some: Bitmap | None = None):
        split = pc.split_pattern(texts, "\n")
        n_lines = np.asarray(pc.list_value_length(split), np.int64)
        self.ids, self.numbers, lines = np.repeat(ids, n_lines), ranges_of(n_lines), split.flatten()
        if some is not None:
            inside = some.has(self.ids, self.numbers)
            self.ids, self.numbers, lines = self.ids[inside], self.numbers[inside], lines.filter(pa.array(inside))
        self.line, self.token = hashed_words(lines)


def ranges_of(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _lines(batches: Iterator[pa.RecordBatch], some: Bitmap | None = None) -> Iterator[Lines]:
    for batch in batches:
        for part in parts(batch, "text", 1 << 20):  # small enough for a processor's cache
            yield Lines(np.asarray(part.column("id"), np.int64), part.column("text"), some)


class Sets:
    """The lines' sets of words, flat: hash by hash in the order of rarity, line after line."""

    def __init__(self, of: Lines, counts: np.ndarray | None, least: int):
        count = np.zeros(len(of.token), np.uint64) if counts is None else np.minimum(counts[of.token % np.uint64(COUNTERS)], (1 << 20) - 1).astype(np.uint64)
        line, token = of.line.astype(np.uint64), of.token
        bits = 42 if counts is None else 22
        key = line << np.uint64(42) | count << np.uint64(22) | token >> np.uint64(64 - bits)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        if len(of.ids) >= 1 << 22 or (same & (token[order][1:] != token[order][:-1])).any():
            order = np.lexsort((token, count, line))
        line, token = line[order], token[order]
        new = np.append(True, (line[1:] != line[:-1]) | (token[1:] != token[:-1])) if len(token) else np.zeros(0, bool)
        line, token = line[new].astype(np.int64), token[new]
        n = np.bincount(line, minlength=len(of.ids))
        stay = n >= max(least, 1)  # enough distinct words
        self.token, self.n = token[stay[line]], n[stay]
        self.ids, self.numbers = of.ids[stay], of.numbers[stay]
        self.start = np.cumsum(self.n) - self.n

    def only(self, some: np.ndarray) -> None:
        """Leaves out the lines that are not marked."""
        self.token = self.token[np.repeat(some, self.n)]
        self.n, self.ids, self.numbers = self.n[some], self.ids[some], self.numbers[some]
        self.start = np.cumsum(self.n) - self.n

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """128 parities of the words by hash: what differs between two sketches differs between the sets."""
        bit = self.token >> np.uint64(57)
        one = np.uint64(1) << (bit & np.uint64(63))
        return tuple(np.bitwise_xor.reduceat(np.where(half, one, np.uint64(0)), self.start) if len(self.n) else np.zeros(0, np.uint64) for half in (bit < 64, bit >= 64))

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that depend on the set only."""
        if not len(self.n):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return np.add.reduceat(self.token, self.start), np.add.reduceat(_mixed(self.token), self.start)


def least_overlap(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Words that sets of n and m words must share to reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9).astype(np.int64)


def least_joined(threshold: float) -> int:
    """Words of the smallest set that may reach the threshold with another one than its equal."""
    return math.ceil(threshold / max(1 - threshold, 1e-9) - 1e-9)


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def may_match(n, p, m, q, differ, need) -> np.ndarray:
    """Whether sets of sizes n and m, whose first common word has positions p and q and whose sketches differ in so many bits, may share `need` words."""
    exact = (p < 255) & (q < 255)  # positions are kept up to 255
    return (np.minimum(n, m) >= need) & (~exact | (np.minimum(n - p, m - q) >= need)) & (differ <= n + m - 2 * need)


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of integer columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c.astype(np.int64, copy=False).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return h


class Bitmap:
    """A set of hashed keys, of bounded size; it may hold more than was put in, never less."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, *columns: np.ndarray) -> np.ndarray:
        at = _mixed(*columns) % np.uint64(self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @staticmethod
    def of(keys: DataFrame, n: int) -> Bitmap:
        """Of the integer columns of `keys`, n rows: some 16 bits a row, MOST_BITS in all at most."""
        bits = min(MOST_BITS, max(_CHUNK, 1 << (16 * n).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = _mixed(*[np.asarray(c) for c in b.columns]) % np.uint64(bits)
                yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int64) + 1)})

        made = keys.mapInArrow(run, "at long").distinct()
        chunks = made.groupBy(F.bitmap_bucket_number("at").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        data = np.zeros(bits // 8, np.uint8)
        for r in chunks.toLocalIterator():  # MOST_BITS in all at most
            data[(r.chunk - 1) * _CHUNK // 8 : r.chunk * _CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
        return Bitmap(bits, data)


def line_digests(docs: DataFrame, least: int) -> DataFrame:
    """(id, line, d0, d1, n) of all lines of `least` distinct words or more; and, with `part` set, each task's word counts, in 64 parts."""
    step = COUNTERS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for of in _lines(batches):
            counts += np.bincount((of.token % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            sets = Sets(of, None, least)
            d0, d1 = sets.digests()
            none = pa.nulls(len(sets.n))
            yield pa.RecordBatch.from_pydict({"id": sets.ids, "line": sets.numbers, "d0": d0.view(np.int64), "d1": d1.view(np.int64), "n": sets.n, "part": none.cast(pa.int32()), "counts": none.cast(pa.binary())})
        none = pa.nulls(64, pa.int64())
        yield pa.RecordBatch.from_pydict({**dict.fromkeys(("id", "line", "d0", "d1", "n"), none), "part": pa.array(range(64), pa.int32()), "counts": pa.array([counts[k * step : (k + 1) * step].tobytes() for k in range(64)], pa.binary())})

    return docs.mapInArrow(run, "id long, line long, d0 long, d1 long, n long, part int, counts binary")


def summed_counts(parts: DataFrame) -> np.ndarray:
    """Occurrences of words, by hash, over all lines of all documents: COUNTERS counters."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    # two rounds of sums, so that no task adds up the counters of all others
    rows = parts.select("part", "counts").withColumn("some", F.pmod(F.spark_partition_id(), F.lit(32)))
    some = rows.groupBy("part", "some").applyInArrow(add, "part int, counts binary")
    counts, step = np.zeros(COUNTERS, np.int64), COUNTERS // 64
    for r in some.groupBy("part").applyInArrow(add, "part int, counts binary").collect():  # 64 rows
        counts[r.part * step : (r.part + 1) * step] = np.frombuffer(r.counts, np.int64)
    return counts


class Heavy:
    """The sets with most copies: digests in order, and the first line of each."""

    def __init__(self, rows: list):
        rows = sorted((r.d0 % (1 << 64), r.d1 % (1 << 64), r.id, r.line) for r in rows)
        self.d0, self.d1 = (np.array([r[k] for r in rows], np.uint64) for k in (0, 1))
        self.ids, self.numbers = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))

    def copies(self, sets: Sets) -> np.ndarray:
        """Which lines are copies of such a set's first line. Of sets that share half a digest, one is known."""
        if not len(self.d0) or not len(sets.n):
            return np.zeros(len(sets.n), bool)
        d0, d1 = sets.digests()
        at = np.minimum(np.searchsorted(self.d0, d0), len(self.d0) - 1)
        return (self.d0[at] == d0) & (self.d1[at] == d1) & ((self.ids[at] != sets.ids) | (self.numbers[at] != sets.numbers))


_PREFIX = ("token", "id", "at", "s0", "s1")


def prefixes(docs: DataFrame, shared, hot_from: float, threshold: float, least: int, buckets: int) -> DataFrame:
    """The words of the lines' prefixes with their lines, packed as arrays by bucket of words.

    shared: word counts, bitmap of lines, sets with most copies. hot_from: the count above which a word is hot. at: line number, size and position;
    s0, s1: the sketch. The rows of a hot word carry a key of word and size band; each line is in its
    own band and in that below, so that any two lines of like sizes meet in one.
    """
    base = max(math.log(1 / threshold), 1e-9)

    def made(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        bucket = (columns[0].view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket.astype(np.int64), minlength=buckets)
        some = np.flatnonzero(sizes)
        offsets = pa.array(np.append(0, np.cumsum(sizes[some])).astype(np.int32))
        packed = {c: pa.ListArray.from_arrays(offsets, pa.array(x[order])) for c, x in zip(_PREFIX, columns, strict=True)}
        return pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), **packed})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lines, heavy = shared.value
        hot = counts > hot_from
        held, rows = [], 0
        for of in _lines(batches, lines):
            sets = Sets(of, counts, least)
            sets.only(~heavy.copies(sets))
            n, sketch = sets.n, sets.sketches()
            take = prefix_length(n, threshold)
            row, pos = np.repeat(np.arange(len(n)), take), ranges_of(take)
            token = sets.token[sets.start[row] + pos]
            if (many := hot[token % np.uint64(COUNTERS)]).any():
                band = np.floor(np.log(n[row[many]]) / base + 1e-9).astype(np.int64)
                keys = [_mixed(token[many], band), _mixed(token[many], band - 1)]
                row, pos = np.concatenate([row[~many], row[many], row[many]]), np.concatenate([pos[~many], pos[many], pos[many]])
                token = np.concatenate([token[~many], *keys])
            at = sets.numbers[row] << 36 | n[row] << 8 | np.minimum(pos, 255)
            held.append([token.view(np.int64), sets.ids[row], at, sketch[0][row].view(np.int64), sketch[1][row].view(np.int64)])
            rows += len(row)
            if rows >= 2 * BUCKET_ROWS:
                yield made(held)
                held, rows = [], 0
        if rows:
            yield made(held)

    return docs.mapInArrow(run, "bucket int, " + ", ".join(f"{c} array<long>" for c in _PREFIX))


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 36, at >> 8 & (1 << 28) - 1, at & 255


def _pairs_by_block(part: np.ndarray, others: np.ndarray, n: np.ndarray, s0: np.ndarray, s1: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a row of `part` and an earlier one of `others` whose sketches are near enough, and in how many bits they differ."""
    differ = np.bitwise_count(s0[part][:, None] ^ s0[others]) + np.bitwise_count(s1[part][:, None] ^ s1[others])
    i, j = np.nonzero((differ <= most * (n[part][:, None] + n[others]) + 1e-6) & (part[:, None] > others))
    return i, others[j], differ[i, j].astype(np.int64)


def _candidates(token, doc, at, s0, s1, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order of (token, id, line): each row's likeliest earlier candidate or -1, how many bits its sketch has to spare (as a negative number), whether there are more, and whether the row is a candidate of another."""
    line, n, pos = _unpacked(at)
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(token)))
    nth = np.arange(len(token)) - np.repeat(start, size)
    small = np.repeat(size <= SMALL, size)
    found, best, many, partner = np.full(len(token), -1), np.full(len(token), 1 << 40), np.zeros(len(token), bool), np.zeros(len(token), bool)
    most = 1 - 2 * threshold / (1 + threshold)  # the sketches may differ in this share of both sizes at most

    def hold(r: np.ndarray, o: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs may match, and the spare bits of all."""
        need = least_overlap(n[r], n[o], threshold)
        return may_match(n[r], pos[r], n[o], pos[o], differ, need) & ((doc[r] != doc[o]) | (line[r] != line[o])), differ - (n[r] + n[o] - 2 * need)

    def take(hit: np.ndarray, other: np.ndarray, spare: np.ndarray) -> None:
        many[hit] |= found[hit] >= 0
        better = spare < best[hit]
        found[hit[better]], best[hit[better]] = other[better], spare[better]

    rows = np.flatnonzero(small & (nth >= 1))
    for back in range(1, SMALL):
        rows = rows[nth[rows] >= back]
        if not len(rows):
            break
        others = rows - back
        differ = np.bitwise_count(s0[rows] ^ s0[others]).astype(np.int64) + np.bitwise_count(s1[rows] ^ s1[others])
        near = differ <= most * (n[rows] + n[others]) + 1e-6  # rules most of them out
        r, o, differ = rows[near], others[near], differ[near]
        ok, spare = hold(r, o, differ)
        take(r[ok], o[ok], spare[ok])
        partner[o[ok]] = True
    for a, g in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        waiting, over = np.arange(a + 1, a + g), np.zeros(0, np.int64)
        for first in range(a, a + g - 1, BLOCK):
            others = np.arange(first, min(first + BLOCK, a + g))
            waiting = waiting[np.searchsorted(waiting, first, "right") :]
            for k in range(0, len(waiting), 4096):
                part = waiting[k : k + 4096]
                i, o, differ = _pairs_by_block(part, others, n, s0, s1, most)
                ok, spare = hold(part[i], o, differ)
                i, o, spare = i[ok], o[ok], spare[ok]
                if len(i):
                    partner[o] = True
                    order = np.lexsort((spare, i))
                    i, o, spare = i[order], o[order], spare[order]
                    head = np.append(True, i[1:] != i[:-1])
                    many[part[np.bincount(i, minlength=len(part)) > 1]] = True
                    take(part[i[head]], o[head], spare[head])
            if g <= MARKED:  # a row that has several candidates waits for no more, but what else may match it is marked
                unmarked = others[~partner[others]]
                over = over[np.searchsorted(over, first, "right") :]
                for k in range(0, len(over) if len(unmarked) else 0, 4096):
                    partner[_pairs_by_block(over[k : k + 4096], unmarked, n, s0, s1, most)[1]] = True
                over = np.union1d(over, waiting[many[waiting]])
            waiting = waiting[~many[waiting]]
            if not len(waiting) and (g > MARKED or not len(over)):
                break
        if g > MARKED and many[a : a + g].any():
            partner[a : a + g] = True
    return found, best, many, partner


def candidates(rows: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """(token, id, line, c_id, c_line, spare, more) for each prefix row with a candidate, and, with null candidates, for rows that are one."""

    def made(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.argsort(columns[0])
        sorted_ = columns[0][order]
        again = np.append(False, sorted_[1:] == sorted_[:-1]) if len(order) else np.zeros(0, bool)
        again[:-1] |= again[1:]
        token, doc, at, s0, s1 = (c[order[again]] for c in columns)  # words of one line only are of no use
        order = np.lexsort((at, doc, token))
        token, doc, at, s0, s1 = (c[order] for c in (token, doc, at, s0, s1))
        found, spare, more, partner = _candidates(token, doc, at, s0.view(np.uint64), s1.view(np.uint64), threshold)
        out = np.flatnonzero((found >= 0) | partner)
        none, other = found[out] < 0, np.maximum(found[out], 0)
        of = lambda c: pa.array(c[other], mask=none)
        return pa.RecordBatch.from_pydict({"token": token[out], "id": doc[out], "line": at[out] >> 36, "c_id": of(doc), "c_line": of(at >> 36), "spare": spare[out], "more": more[out]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            of = np.asarray(b.column("bucket"))
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    if held and of[i] != bucket:
                        yield made(held)
                        held = []
                    bucket = of[i]
                    held.append([np.asarray(b.column(c).slice(i, j - i).flatten()) for c in _PREFIX])
        if held:
            yield made(held)

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "token long, id long, line long, c_id long, c_line long, spare long, more boolean")


def line_sets(docs: DataFrame, least: int, lines: Bitmap) -> DataFrame:
    """(id, line, tokens) of the lines in the bitmap."""
    of = docs.sparkSession.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _lines(batches, of.value):
            sets = Sets(some, None, least)
            offsets = np.append(sets.start, len(sets.token)).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sets.token.view(np.int64)))
            yield pa.RecordBatch.from_pydict({"id": pa.array(sets.ids), "line": pa.array(sets.numbers), "tokens": tokens})

    return docs.mapInArrow(run, "id long, line long, tokens array<long>")


_LINE, _OTHER = ["id", "line"], ["c_id", "c_line"]


def verified(docs: DataFrame, pairs: DataFrame, threshold: float, least: int, scratch: Scratch) -> DataFrame:
    """The (id, line) of those pairs (id, line, c_id, c_line), one for each line, whose sets reach the threshold."""
    both = pairs.select(*_LINE).unionByName(pairs.select(F.col("c_id").alias("id"), F.col("c_line").alias("line")))
    sets = scratch.staged(line_sets(docs, least, Bitmap.of(both, 2 * pairs.count())), "line-sets")
    joined = pairs.join(sets, _LINE).join(sets.select(*[F.col(c).alias(f"c_{c}") for c in sets.columns]), _OTHER)
    common = F.size(F.array_intersect("tokens", "c_tokens"))
    return joined.filter(common >= F.lit(threshold) * (F.size("tokens") + F.size("c_tokens") - common) - F.lit(1e-9)).select(*_LINE)


def common_words(place: np.ndarray, start: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the sets i and j share, pair by pair. place: numbered words, set after set."""
    take = np.concatenate([n[i], n[j]])
    pair = np.tile(np.arange(len(i)), 2)
    word = place[np.repeat(start[np.concatenate([i, j])], take) + ranges_of(take)]
    key = np.sort(np.repeat(pair, take) << 40 | word)
    return np.bincount(key[1:][key[1:] == key[:-1]] >> 40, minlength=len(i))


def settled(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, line) of the waiting lines that an earlier line of the same word matches. rows: token, id, line, waiting, tokens."""
    most = 1 - 2 * threshold / (1 + threshold)

    def matched(table: pa.Table) -> np.ndarray:
        """The rows, of one word and in order, that match an earlier one and wait."""
        lists = table.column("tokens").combine_chunks()
        n = np.asarray(pc.list_value_length(lists), np.int64)
        token = np.asarray(lists.flatten()).view(np.uint64)
        start = np.cumsum(n) - n
        place = np.unique(token, return_inverse=True)[1]
        bit = token >> np.uint64(57)
        one = np.uint64(1) << (bit & np.uint64(63))
        s0, s1 = (np.bitwise_xor.reduceat(np.where(half, one, np.uint64(0)), start) for half in (bit < 64, bit >= 64))
        waiting, out = np.flatnonzero(np.asarray(table.column("waiting").combine_chunks().to_numpy(zero_copy_only=False), bool)), []
        for first in range(0, len(n), 1024):
            others = np.arange(first, min(first + 1024, len(n)))
            waiting = waiting[np.searchsorted(waiting, first, "right") :]
            for k in range(0, len(waiting), 256):
                part = waiting[k : k + 256]
                i, o, _ = _pairs_by_block(part, others, n, s0, s1, most)
                for c in range(0, len(i), 20_000):
                    r, q = part[i[c : c + 20_000]], o[c : c + 20_000]
                    common = common_words(place, start, n, r, q)
                    out.append(np.unique(r[common >= threshold * (n[r] + n[q] - common) - 1e-9]))
            waiting = np.setdiff1d(waiting, np.concatenate([np.zeros(0, np.int64), *out]))
        return np.unique(np.concatenate([np.zeros(0, np.int64), *out]))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("line", "ascending")])
        return table.take(pa.array(matched(table))).select(_LINE)

    return rows.groupBy("token").applyInArrow(run, "id long, line long").distinct()


def matched_lines(docs: DataFrame, threshold: float, least: int, scratch: Scratch) -> DataFrame:
    """`docs` has unique ids (id long, text). (id, line) of the lines that an earlier line matches; lines count from 0."""
    spark = docs.sparkSession
    joined = max(least, least_joined(threshold))
    made = scratch.staged(line_digests(docs, least), "line-digests")
    counts, every = summed_counts(made.filter("part IS NOT NULL")), made.filter("part IS NULL").select("id", "line", "d0", "d1", "n")
    firsts = every.groupBy("d0", "d1", "n").agg(F.min(F.struct(*_LINE)).alias("first"), F.count("*").alias("lines"))
    firsts = scratch.staged(firsts.select("d0", "d1", "n", "first.*", "lines"), "line-firsts")
    copies = scratch.staged(every.select(*_LINE).join(firsts.select(*_LINE), _LINE, "left_anti"), "line-copies")
    some = firsts.filter(F.col("n") >= joined)
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1
    total = some.agg(F.count("*").alias("n"), F.sum(prefix).alias("rows"), F.sum("lines").alias("lines")).first()
    if not total.n:
        return copies
    # the bitmap may let copies through: they match their first, and are left out again; sets with most copies are known
    heavy = some.filter(F.col("lines") > max(64, int(total.lines * HOT_SET))).select("d0", "d1", *_LINE).collect()
    shared = spark.sparkContext.broadcast((counts, Bitmap.of(some.select(*_LINE), total.n), Heavy(heavy)))
    buckets = 1 + total.rows // BUCKET_ROWS
    hot_from = max(HOT_WORD, HOT_SHARE * float(counts.mean()))
    found = scratch.staged(candidates(prefixes(docs, shared, hot_from, threshold, joined, buckets), threshold, buckets), "line-candidates")
    other = F.struct(*_OTHER)
    first = found.filter("c_id IS NOT NULL").groupBy(*_LINE).agg(F.min(F.struct("spare", *_OTHER)).alias("c"), (F.max("more") | (F.min(other) != F.max(other))).alias("more"))
    first = scratch.staged(first.select(*_LINE, "c.c_id", "c.c_line", "more").join(copies, _LINE, "left_anti"), "line-first-candidates")
    near = scratch.staged(verified(docs, first.select(*_LINE, *_OTHER), threshold, joined, scratch), "line-matches")
    left = scratch.staged(first.filter("more").select(*_LINE).join(near, _LINE, "left_anti"), "lines-left")
    sure = copies.unionByName(near)
    if left.isEmpty():
        return sure
    # the lines left over meet the candidates of their words again, with the whole sets
    words = found.filter("c_id IS NOT NULL").join(left, _LINE, "left_semi").select("token").distinct()
    members = scratch.staged(found.select("token", *_LINE).join(words, "token", "left_semi").distinct(), "line-members")
    lines = members.select(*_LINE).distinct()
    sets = line_sets(docs, joined, Bitmap.of(lines, lines.count()))
    rows = members.join(left.withColumn("waiting", F.lit(True)), _LINE, "left").join(sets, _LINE)
    return sure.unionByName(settled(rows.select("token", *_LINE, F.coalesce("waiting", F.lit(False)).alias("waiting"), "tokens"), threshold))


def _numbered(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with unique ids, and, where ids had to be replaced, the keys that they stand for.

    Ids that are null or name several texts are replaced by numbers in the order of (id, null last,
    text hash); repeated rows share a number.
    """
    rows = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text"))
    keys = rows.groupBy("id").agg(F.count("*").alias("rows"))
    if keys.filter("rows > 1 OR id IS NULL").isEmpty():
        return rows.select(F.col("id").cast("long").alias("id"), "text"), None
    distinct = rows.select("id", "check", "n_bytes").distinct().orderBy(F.col("id").asc_nulls_last(), "check", "n_bytes")
    keys = scratch.staged(distinct.withColumn("number", F.monotonically_increasing_id()), "doc-numbers")
    same = rows.id.eqNullSafe(keys.id) & (rows.check == keys.check) & (rows.n_bytes == keys.n_bytes)
    return rows.join(keys, same).select(F.col("number").alias("id"), "text").dropDuplicates(["id"]), keys


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """(id, check, n_bytes, removed) for the documents with lines to remove: sorted numbers from 0. A staged table."""
    scratch = Scratch()
    rows, keys = _numbered(docs, id_col, text_col, scratch)
    by_doc = matched_lines(rows, threshold, least, scratch).groupBy("id").agg(F.array_sort(F.collect_list(F.col("line").cast("int"))).alias("removed"))
    if keys is None:
        out = by_doc.select("id", F.lit(None).cast("long").alias("check"), F.lit(None).cast("int").alias("n_bytes"), "removed")
    else:
        out = keys.join(by_doc.withColumnRenamed("id", "number"), "number").select("id", "check", "n_bytes", "removed")
    out = staged(out, "removed-lines")
    scratch.clear()
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """A row per document: id, n_lines, n_removed, removed (numbers from 0, joined by commas), text (without those lines).

    A line, that is what line feeds separate, is removed if an earlier line, in the order of id and
    then of place, has Jaccard similarity `threshold` or more to it; lines with fewer than `least`
    distinct words stay, and so does every line without words. Words are runs without ASCII white
    space. Null texts count as empty: one line, no words. Repeated rows (same id and text) are treated
    alike and count as one document. An empty table gives an empty result; other columns are ignored.
    """
    gone = removed_lines(docs, id_col, text_col, threshold, least)
    held = gone.agg(F.coalesce(F.sum(F.size("removed") * 4 + 40), F.lit(0))).first()[0]
    rows = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text"))
    other = gone.select(F.col("id").alias("r_id"), F.col("check").alias("r_check"), F.col("n_bytes").alias("r_bytes"), F.col("removed").alias("gone"))
    same = rows.id.eqNullSafe(other.r_id) & F.coalesce(rows.check == other.r_check, F.lit(True)) & F.coalesce(rows.n_bytes == other.r_bytes, F.lit(True))
    joined = rows.join(F.broadcast(other) if held <= BROADCAST_BYTES else other, same, "left").withColumn("lines", F.split("text", "\n"))
    empty = F.array().cast("array<int>")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda k: F.get("lines", k)), "\n"))
    return joined.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.coalesce("gone", empty), ",").alias("removed"),
        text.alias("text"),
    )
