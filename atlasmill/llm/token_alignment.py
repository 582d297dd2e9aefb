"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Every text is encoded by A (byte-level BPE) and by B (SentencePiece BPE). One NumPy state vector then
holds an A and a B pointer for each text of a batch; a step emits the link of the two tokens pointed
at, emits a cut where both end at one byte, advances the pointers whose tokens end there, and compacts
away the texts that are done. A long text enters the vector as several lanes that start at A tokens,
so that a batch takes some thousand steps whatever its longest text is.

How many documents hold an id pair linked is counted over all documents. The most frequent pairs, a
bounded number of them, go to every task; links of other pairs, none of which is hot, are joined with
their counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sentencepiece_bpe import SPACE, _Pool, ranges
from .shared import parts, staged, text_or_empty

#: Units whose tokens a worker remembers, and their characters.
MEMORY, MEMORY_CHARS = 300_000, 1 << 24
#: Characters that are aligned at a time; longer texts are aligned in several pieces.
BATCH, PIECE = 1 << 20, 1 << 19
#: A tokens in a lane.
LANE = 1024
#: The most frequent id pairs, up to so many, that every task knows (17 bytes each).
KNOWN = 1 << 20
#: Id pairs that a counting task gathers before it sums them.
GATHERED = 1 << 22


def read_tokenizers(path_a: str, path_b: str) -> dict:
    """What the tasks need of both files; only the driver reads them."""
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return {"a": a.read(), "b": b.read()}


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def lockstep(end_a: np.ndarray, end_b: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (index into A, index into B) in order, and whether both tokens end at the link's end.

    A lane starts at the tokens a, b and is done at the A token stop; room bounds its links.
    """
    out = np.cumsum(room) - room
    total = int(room.sum())
    link_a, link_b, cut = np.full(total, -1, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
    live = a < stop
    a, b, stop, out = a[live], b[live], stop[live], out[live]
    while len(a):
        x, y = end_a[a], end_b[b]
        link_a[out], link_b[out], cut[out] = a, b, x == y
        a, b, out = a + (x <= y), b + (y <= x), out + 1
        live = a < stop
        if not live.all():
            a, b, stop, out = a[live], b[live], stop[live], out[live]
    made = link_a >= 0
    return link_a[made], link_b[made], cut[made]


def packed(values: np.ndarray) -> bytes:
    """Integers of 0 and more as differences in byte planes, which compress well."""
    steps = np.diff(values, prepend=np.int64(0)).astype("<i8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


class Aligner:
    """Encodes texts with both tokenizers and aligns their tokens; remembers the units of earlier texts."""

    def __init__(self, files: dict, memory: int = MEMORY):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files["a"])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files["b"])
        spec = json.loads(files["a"])
        of = _byte_of_char()
        entries = self.a.get_vocab(with_added_tokens=True)
        shown_a = [b""] * (max(entries.values(), default=-1) + 1)
        for entry, i in entries.items():
            shown_a[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        shown_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.shown_a, self.shown_b, self.size_b = _Pool(shown_a), _Pool(shown_b), len(shown_b)
        self.decimal_a = _Pool([b"%d%c" % (i, c) for c in b",|" for i in range(len(shown_a))])
        self.decimal_b = _Pool([b"%d%c" % (i, c) for c in b",;" for i in range(len(shown_b))])
        # Between two characters that are no white space, a space starts a token of A (its pattern puts
        # it before the next word) and of B (no piece holds a space after another character).
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        apart = not any(x != SPACE == y for p in pieces for x, y in zip(p, p[1:], strict=False))
        pre = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cut = re.compile(r"(?<=\S) (?=\S)") if apart and plain else None
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids = {w: np.zeros(1 << 16, np.int32) for w in "ab"}
        self.used = dict.fromkeys("ab", 0)
        self.start = {w: np.zeros(1 << 12, np.int64) for w in "ab"}
        self.length = {w: np.zeros(1 << 12, np.int64) for w in "ab"}
        self.same = np.zeros(1 << 12, bool)

    def _learn(self, units: list[str]) -> None:
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        if not new:
            return
        made = {"a": [e.ids for e in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)], "b": self.b.encode(new, num_threads=1)}
        n, k = len(self.number), len(new)
        whole = np.ones(k, bool)
        target = [b" " + u.encode() for u in new]
        for w, pool in (("a", self.shown_a), ("b", self.shown_b)):
            lengths = np.fromiter(map(len, made[w]), np.int64, k)
            ids = np.fromiter((i for x in made[w] for i in x), np.int32, int(lengths.sum()))
            data, ends = pool.gather(ids)
            data, ends = data.tobytes(), np.append(0, ends)[np.append(0, np.cumsum(lengths))].tolist()
            whole &= np.fromiter((data[x:y] == t for x, y, t in zip(ends, ends[1:], target, strict=False)), bool, k)
            while self.used[w] + len(ids) > len(self.ids[w]):
                self.ids[w] = np.concatenate([self.ids[w], np.zeros_like(self.ids[w])])
            while n + k > len(self.start[w]):
                self.start[w], self.length[w] = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start[w], self.length[w]))
            self.ids[w][self.used[w] : self.used[w] + len(ids)] = ids
            self.start[w][n : n + k] = self.used[w] + np.cumsum(lengths) - lengths
            self.length[w][n : n + k] = lengths
            self.used[w] += len(ids)
        while n + k > len(self.same):
            self.same = np.concatenate([self.same, np.zeros_like(self.same)])
        self.same[n : n + k] = whole
        self.chars += sum(map(len, new))
        self.number.update(zip(new, range(n, n + k), strict=True))

    def encode(self, units: list[str]) -> tuple[dict, np.ndarray]:
        """Ids of all units by tokenizer, flat, with each unit's number of ids; and whether a unit's bytes are kept by both."""
        if len(self.number) > self.memory or self.chars > MEMORY_CHARS:
            self.forget()
        self._learn(units)
        k = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        return {w: (self.ids[w][ranges(self.start[w][k], self.length[w][k])], self.length[w][k]) for w in "ab"}, self.same[k]

    def align(self, tokens: dict, first: np.ndarray) -> list[dict]:
        """For each piece of a text (units first[i] to first[i + 1]): n_a, n_b, n_groups, n_links, groups (bytes), and its id pairs and the number of their links."""
        pieces = range(len(first) - 1)
        ids, start, ends = {}, {}, {}
        for w, pool in (("a", self.shown_a), ("b", self.shown_b)):
            ids[w], per_unit = tokens[w]
            start[w] = np.append(0, np.cumsum(per_unit))[first]
            ends[w] = np.cumsum(pool.length[ids[w]])
        (ida, idb), (sa, sb), (ea, eb) = ids.values(), start.values(), ends.values()
        # lanes: A tokens at equal distances in each piece, and the B token at whose byte they start
        n_a = np.diff(sa)
        lanes = -(-n_a // LANE)
        a = np.repeat(sa[:-1], lanes) + (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        of = np.repeat(np.arange(len(pieces)), lanes)
        stop = np.minimum(a + LANE, sa[of + 1])
        b = np.searchsorted(eb, np.append(0, ea)[a], side="right")
        last_b = np.searchsorted(eb, ea[stop - 1] if len(stop) else stop, side="left")
        link_a, link_b, cut = lockstep(ea, eb, a, b, stop, (stop - a) + (last_b - b) + 1)
        piece_a = np.repeat(np.arange(len(pieces)), n_a)
        piece = piece_a[link_a]
        # groups: the number of cuts before a token; a group's A tokens come before its B tokens
        cuts = ea[link_a[cut]]
        group_a, group_b = np.searchsorted(cuts, ea, side="left"), np.searchsorted(cuts, eb, side="left")
        place_a = np.arange(len(ida)) + np.searchsorted(group_b, group_a, side="left")
        place_b = np.arange(len(idb)) + np.searchsorted(group_a, group_b, side="right")
        last_in_a, last_in_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
        shown = np.zeros(len(ida) + len(idb), np.int64)
        half_a = len(self.decimal_a.start) // 2
        shown[place_a] = ida + half_a * last_in_a
        shown[place_b] = idb + self.size_b * last_in_b + 2 * half_a
        data, at = self._both().gather(shown)
        data, at = data.tobytes(), np.append(0, at)
        text_ends = at[sa + sb]
        # distinct id pairs of each piece
        code = ida[link_a].astype(np.int64) * self.size_b + idb[link_b]
        order = np.lexsort((code, piece))
        code, owner = code[order], piece[order]
        new = np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))[: len(code)]
        heads = np.flatnonzero(new)
        times = np.diff(np.append(heads, len(code)))
        of_piece = np.searchsorted(owner[heads], np.arange(len(pieces) + 1))
        n_links, n_groups = np.bincount(piece, minlength=len(pieces)), np.bincount(piece[cut], minlength=len(pieces))
        codes = code[heads]
        return [
            {"n_a": int(n_a[i]), "n_b": int(sb[i + 1] - sb[i]), "n_groups": int(n_groups[i]), "n_links": int(n_links[i]), "groups": data[text_ends[i] : text_ends[i + 1]],
             "codes": codes[of_piece[i] : of_piece[i + 1]], "times": times[of_piece[i] : of_piece[i + 1]]}
            for i in pieces
        ]

    def _both(self) -> _Pool:
        if not hasattr(self, "_shown"):
            both = object.__new__(_Pool)
            both.data = np.concatenate([self.decimal_a.data, self.decimal_b.data])
            both.length = np.concatenate([self.decimal_a.length, self.decimal_b.length])
            both.start = np.cumsum(both.length) - both.length
            self._shown = both
        return self._shown

    def run(self, texts: list[str], with_groups: bool = False) -> list[list]:
        """n_a, n_b, n_groups, n_links, groups_sha256, codes, times (both packed) and, if asked, groups, of each text."""
        none = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0}
        found: list[list[dict]] = [[] for _ in texts]
        differs = {d for d, text in enumerate(texts) if SPACE in text}  # B gives the mark back as a space
        waiting: list[tuple[int, list[str]]] = []
        chars = 0

        def flush() -> None:
            nonlocal waiting, chars
            if not waiting:
                return
            tokens, same = self.encode([u for _, piece in waiting for u in piece])
            counts = np.fromiter((len(piece) for _, piece in waiting), np.int64, len(waiting))
            good = np.logical_and.reduceat(same, np.cumsum(counts) - counts)
            differs.update(d for (d, _), g in zip(waiting, good.tolist(), strict=True) if not g)
            kept = np.repeat(good, counts)
            tokens = {w: (ids[np.repeat(kept, n)], n[kept]) for w, (ids, n) in tokens.items()}
            made = self.align(tokens, np.cumsum(np.append(0, counts[good])))
            for (d, _), one in zip((x for x, g in zip(waiting, good.tolist(), strict=True) if g), made, strict=True):
                found[d].append(one)
            waiting, chars = [], 0

        for d, text in enumerate(texts):
            if not text or d in differs:
                continue
            units = self.cut.split(text) if self.cut else [text]
            step = len(units) if len(text) <= PIECE else max(1, len(units) * PIECE // len(text))
            for k in range(0, len(units), step):
                piece = units[k : k + step]
                waiting.append((d, piece))
                chars += sum(map(len, piece)) + len(piece)
                if chars >= BATCH:
                    flush()
        flush()
        rows = []
        for d, of_text in enumerate(found):
            if not of_text or d in differs:
                rows.append([*none.values(), "", b"", b"", ""])
                continue
            codes, times = of_text[0]["codes"], of_text[0]["times"]
            if len(of_text) > 1:
                codes, where = np.unique(np.concatenate([x["codes"] for x in of_text]), return_inverse=True)
                times = np.bincount(where, np.concatenate([x["times"] for x in of_text])).astype(np.int64)
            digest = hashlib.sha256()
            for k, x in enumerate(of_text):
                digest.update(x["groups"] if k < len(of_text) - 1 else memoryview(x["groups"])[:-1])
            shown = b"".join(x["groups"] for x in of_text)[:-1].decode() if with_groups else ""
            rows.append([*(sum(x[n] for x in of_text) for n in none), digest.hexdigest(), packed(codes), packed(times), shown])
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)]


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(key: str, files: dict) -> Aligner:
    """A Python worker's aligner: it lasts from task to task."""
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(files)
    return _ALIGNERS[key]


def _counted(sample: DataFrame) -> DataFrame:
    """(pair, n): how many rows of `sample` hold each id pair. Tasks sum what they have gathered before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        size = 0

        def sums(gathered: list[np.ndarray]) -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(gathered), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

        for batch in batches:
            for data in batch.column(0).to_pylist():
                gathered.append(unpacked(data))
                size += len(gathered[-1])
                if size >= GATHERED:
                    yield sums(gathered)
                    gathered, size = [], 0
        if size:
            yield sums(gathered)

    return sample.select("codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _scored(rows: DataFrame, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Adds n_best and count_sum over links of known pairs; rest and rest_links hold the other pairs."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            made: list[list] = [[], [], [], []]
            for codes, times in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True):
                code, links = unpacked(codes), unpacked(times)
                at = np.minimum(np.searchsorted(pair, code), max(0, len(pair) - 1))
                here = pair[at] == code if len(pair) else np.zeros(len(code), bool)
                at = at[here]
                for c, x in zip(made, (int(links[here][best[at]].sum()) if len(at) else 0, int((links[here] * n[at]).sum()) if len(at) else 0, code[~here].tolist(), links[~here].tolist()), strict=True):
                    c.append(x)
            kept = [c for c in batch.schema.names if c not in ("codes", "times")]
            arrays = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in made[2:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], [*kept, "n_best", "count_sum", "rest", "rest_links"])

    kept = [f for f in rows.schema.fields if f.name not in ("codes", "times")]
    longs = T.ArrayType(T.LongType())
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rest", longs), T.StructField("rest_links", longs)]))


def _with_counts(rows: DataFrame, size_b: int, most: int) -> DataFrame:
    """Adds n_best and count_sum to rows with uid, codes and times."""
    pairs = staged(_counted(rows), "pairs").withColumn("a", F.floor(F.col("pair") / F.lit(size_b)))
    best = pairs.groupBy("a").agg(F.max("n").alias("top"))  # a row for each of A's ids at most
    pairs = staged(pairs.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"), F.floor(F.log2("n") * 16).alias("band")), "pair-counts")
    # the most frequent bands of pairs that together stay within the bound; there are at most some thousand bands
    cut, total, all_known = None, 0, True
    for band, count in pairs.groupBy("band").count().orderBy(F.desc("band")).collect():
        if total + count > most:
            all_known = False
            break
        cut, total = band, total + count
    top = pairs.filter(F.col("band") >= cut).select("pair", "n", "best").toPandas().sort_values("pair") if cut is not None else None
    known = (top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy(bool)) if top is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    scored = _scored(rows, known)
    if all_known:
        return scored.drop("rest", "rest_links", "uid")
    scored = staged(scored, "scored")
    lesser = pairs if cut is None else pairs.filter(F.col("band") < cut)
    links = scored.select("uid", F.explode(F.arrays_zip("rest", "rest_links")).alias("x")).select("uid", F.col("x.rest").alias("pair"), F.col("x.rest_links").alias("links"))
    more = links.join(lesser, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    both = scored.drop("rest", "rest_links").join(more, "uid", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum", "uid")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, known: int = KNOWN) -> DataFrame:
    """A row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with with_groups=True the groups.

    A encodes a space and the text, B the text, which it puts a space before; special tokens' strings
    are plain text. Groups are cut where tokens of both end; a group reads `a1,a2|b1`, and groups are
    joined by `;`. n_links counts the A-B token occurrences that share a byte, n_best those whose id
    pair is, of its A id's pairs, linked in most documents (ties included), count_sum the documents of
    all links' pairs. Documents whose text is null or empty, or whose bytes A or B does not give back,
    have zeros and an empty groups_sha256. Repeated rows give repeated rows and count as often; null
    ids stay; an empty table gives an empty result; other columns are ignored.

    A text is handled in pieces of bounded length; one without a single space between other characters
    is one piece. Tables of A's and B's tokens and at most `known` id pairs are in every task.
    """
    files = read_tokenizers(path_a, path_b)
    shared = docs.sparkSession.sparkContext.broadcast(files)
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_proto=files["b"]).get_piece_size()
    key = f"{path_a}|{path_b}"
    longs = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner, row = _aligner(key, shared.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in parts(batch, "text"):
                columns = aligner.run(part.column("text").to_pylist(), with_groups)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.arange(row, row + part.num_rows)), *arrays], ["id", "uid", *longs, "groups_sha256", "codes", "times", "groups"])
                row += part.num_rows

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("uid", T.LongType()), *[T.StructField(n, T.LongType()) for n in longs], T.StructField("groups_sha256", T.StringType()), T.StructField("codes", T.BinaryType()), T.StructField("times", T.BinaryType()), T.StructField("groups", T.StringType())])
    made = staged(rows.mapInArrow(run, schema), "aligned")
    return _with_counts(made, size_b, known).select(F.col("id").alias(id_col), *longs, "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)
