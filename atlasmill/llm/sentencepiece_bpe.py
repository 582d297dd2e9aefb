"""SentencePiece (BPE with byte fallback) encoding and decoding in vectorised merge rounds.

Texts are cut into units, between which no piece of the vocabulary reaches; equal units are encoded
once. All new units are encoded together: their characters are one flat array of symbols; a round
finds each unit's minimum pair rank (a segmented minimum), merges that pair's occurrences from the
left all at once, and compacts the arrays; units without a pair leave. Where a merge makes a pair
that ranks before, or as, the one just merged, the unit's occurrences up to the leftmost such one are
merged in that round, so the order of merges is the library's own. A unit of very many characters
(unbroken text) would need very many rounds: its merges are taken one by one from a queue, in the same
order.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .shared import per_text

SPACE = "▁"
#: Units whose encoding a task remembers, their characters in all, and characters that are encoded at a time.
MEMORY, MEMORY_CHARS, FLUSH = 300_000, 1 << 24, 1 << 20
#: Units of more characters are merged by queue: from about here on the rounds, of which there are as many as a unit's merges, take longer.
LONG = 300


def read_vocabulary(path: str) -> dict:
    """Pieces, scores and kinds of the model file, which the sentencepiece library reads."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = ["control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "byte" if sp.is_byte(i) else "unused" if sp.is_unused(i) else "normal" for i in range(n)]
    return {"pieces": [sp.id_to_piece(i) for i in range(n)], "scores": [sp.get_score(i) for i in range(n)], "kinds": kinds, "eos": sp.eos_id()}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of all items, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Bpe:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, vocabulary: dict):
        pieces, scores, kinds = vocabulary["pieces"], vocabulary["scores"], vocabulary["kinds"]
        self.eos, self.size = vocabulary["eos"], len(pieces)
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == "normal"}
        if any(a != SPACE == b for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds a space after another character: texts can't be cut at spaces")
        # symbols: the pieces' ids, then characters that only occur inside pieces
        symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            symbol[c] = self.size + len(symbol) - len(normal)
        rank_of = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        pairs: dict[int, int] = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                if (a := symbol.get(p[:k])) is not None and (b := symbol.get(p[k:])) is not None:
                    pairs[a << 20 | b] = i
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.int64(1) << 62)
        self.merged = np.array([*(pairs[k] for k in keys.tolist()), -1], np.int32)
        rank = np.zeros(self.size, np.int32)
        for i in normal.values():
            rank[i] = rank_of[scores[i]]
        self.never = len(rank_of)
        self.rank = np.where(self.merged >= 0, rank[self.merged], self.never).astype(np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for c, s in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = s
        byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == "byte"}
        self.byte_id = np.array([byte_id[b] for b in range(256)], np.int32)
        joined = "".join(p for p in normal if len(p) > 1)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if "\n" not in joined else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # what each id stands for in a decoded text, and as a decimal number and a space
        shown = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else b" \xe2\x81\x87 " if k == "unknown" else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.shown, self.decimal = _Pool(shown), _Pool([b"%d " % i for i in range(self.size)])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into keys for each pair, the last entry (that never ranks) if it is none."""
        key = np.where((left < 0) | (right < 0), np.int64(-1), left.astype(np.int64) << 20 | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, flat, and the number of each unit's."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        # a character's symbol; -1 - code where no piece has it: those go to bytes at the end
        sym = self.char[code].astype(np.int64)
        sym = np.where(sym < 0, -1 - code.astype(np.int64), sym)
        unit = np.repeat(np.arange(len(units)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if (long := np.flatnonzero(lengths > LONG)).size:
            ends = np.cumsum(lengths)
            for u in long.tolist():
                merged = self.merged_by_queue(sym[ends[u] - lengths[u] : ends[u]])
                done.append((np.full(len(merged), u), merged))
            short = lengths[unit] <= LONG
            sym, unit = sym[short], unit[short]
        while len(sym):
            at = self.pair(sym[:-1], sym[1:])
            at = np.where(unit[:-1] == unit[1:], at, len(self.keys) - 1)
            rank = np.append(self.rank[at], self.never)
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(sym)))
            ready = best == self.never
            if ready.any():
                leave = np.repeat(ready, counts)
                done.append((unit[leave], sym[leave]))
                stay = ~leave
                sym, unit, rank, at = sym[stay], unit[stay], rank[stay], np.append(at, 0)[stay]
                if not len(sym):
                    break
                best, counts = best[~ready], counts[~ready]
                starts = np.cumsum(counts) - counts
            else:
                at = np.append(at, 0)
            least = np.repeat(best, counts)
            hit = np.flatnonzero(rank == least)
            # of hits in a row that overlap (each the next one's left side), every second one is merged
            run = np.flatnonzero(np.append(True, np.diff(hit) > 1))
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[nth % 2 == 0]
            new = self.merged[at[hit]].astype(np.int64)
            after = sym.copy()
            after[hit] = new
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            # pairs that the merges make, to the left and to the right
            place = np.cumsum(keep) - 1
            s2, u2 = after[keep], unit[keep]
            p = place[hit]
            early = np.zeros(len(hit), bool)
            left = np.flatnonzero((p > 0) & (u2[np.maximum(p - 1, 0)] == u2[p]))
            early[left] |= self.rank[self.pair(s2[p[left] - 1], s2[p[left]])] <= best_of(least, hit[left])
            right = np.flatnonzero((p + 1 < len(s2)) & (u2[np.minimum(p + 1, len(s2) - 1)] == u2[p]))
            early[right] |= self.rank[self.pair(s2[p[right]], s2[p[right] + 1])] <= best_of(least, hit[right])
            if early.any():
                first = np.append(True, np.diff(unit[hit]) > 0)
                before = np.cumsum(early) - early  # early ones to the left, of any unit
                hit = hit[before == np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(hit))))]
                after, keep = sym.copy(), np.ones(len(sym), bool)
                after[hit] = self.merged[at[hit]]
                keep[hit + 1] = False
                s2, u2 = after[keep], unit[keep]
            sym, unit = s2, u2
        if not done:
            return np.zeros(0, np.int32), lengths
        unit, sym = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(unit, kind="stable")
        return self._to_bytes(unit[order], sym[order], len(units))

    def merged_by_queue(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols of one unit after all merges: always the pair of the least rank, of equal ranks the leftmost."""
        n, none = len(symbols), len(self.keys) - 1
        sym, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        at = self.pair(symbols[:-1], symbols[1:])
        place = np.flatnonzero(at != none)
        queue = ((self.rank[at[place]].astype(np.int64) << 32) | place).tolist()
        pending = dict(zip(place.tolist(), at[place].tolist(), strict=True))  # the pair that now starts at a place
        heapq.heapify(queue)
        known: dict[int, int] = {}

        def offer(left: int, right: int) -> None:
            a, b = sym[left], sym[right]
            key = a << 20 | b if a >= 0 <= b else -1
            if (k := known.get(key, -1)) < 0:
                k = known[key] = int(self.pair(np.array([a]), np.array([b]))[0])
            if k != none:
                pending[left] = k
                heapq.heappush(queue, int(self.rank[k]) << 32 | left)
            else:
                pending.pop(left, None)

        while queue:
            entry = heapq.heappop(queue)
            left = entry & 0xFFFFFFFF
            k = pending.get(left, -1)
            if k < 0 or self.rank[k] != entry >> 32:
                continue
            right = after[left]
            sym[left], sym[right] = int(self.merged[k]), None
            pending.pop(right, None)
            del pending[left]
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                offer(left, right)
            if before[left] >= 0:
                offer(before[left], left)
        return np.array([x for x in sym if x is not None], np.int64)

    def _to_bytes(self, unit: np.ndarray, sym: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(odd):
            inside = {int(s): c for c, s in ((c, self.char[c]) for c in np.flatnonzero(self.char >= self.size).tolist())}
            codes = [-1 - s if s < 0 else inside[s] for s in sym[odd].tolist()]
            data = [chr(c).encode("utf-8", "surrogatepass") for c in codes]
            wide = np.ones(len(sym), np.int64)
            wide[odd] = [len(d) for d in data]
            out, start = np.repeat(sym, wide), np.cumsum(wide) - wide
            out[ranges(start[odd], wide[odd])] = self.byte_id[np.frombuffer(b"".join(data), np.uint8)]
            unit, sym = np.repeat(unit, wide), out
        return sym.astype(np.int32), np.bincount(unit, minlength=n)

    def units(self, text: str) -> list[str]:
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []


def best_of(least: np.ndarray, at: np.ndarray) -> np.ndarray:
    return least[at]


class _Pool:
    """Byte strings by number, laid end to end."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.length = np.fromiter(map(len, items), np.int64, len(items))
        self.start = np.cumsum(self.length) - self.length

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of all ids, and the offset at which each ends."""
        lengths = self.length[ids]
        return self.data[ranges(self.start[ids], lengths)], np.cumsum(lengths)


class Coder:
    """Encodes texts with an end id and decodes the ids; remembers the units of earlier texts."""

    def __init__(self, bpe: Bpe, memory: int = MEMORY):
        self.bpe, self.memory = bpe, memory
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids, self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def learn(self, units: list[str]) -> None:
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        if not new:
            return
        ids, lengths = self.bpe.encode_units(new)
        n, k = len(self.number), len(new)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + k > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + k] = lengths
        self.used += len(ids)
        self.chars += sum(map(len, new))
        self.number.update(zip(new, range(n, n + k), strict=True))

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, flat, and each unit's number of ids."""
        if len(self.number) > self.memory or self.chars > MEMORY_CHARS:
            self.forget()
        self.learn(units)
        k = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        return self.ids[ranges(self.start[k], self.length[k])], self.length[k]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.bpe.shown.gather(ids)[0].tobytes()

    def run(self, texts: list[str], sink: Callable[[int, np.ndarray], None]) -> None:
        """Gives sink the ids of each text in order, a long text's in several parts; the end id comes last."""
        units, owner, chars = [], [], 0

        def flush() -> None:
            nonlocal units, owner, chars
            if not owner:
                return
            ids, lengths = self.encode(units)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            at = 0
            for doc, n, last in owner:
                part = ids[ends[at] : ends[at + n]]
                sink(doc, np.append(part, np.int32(self.bpe.eos)) if last else part)
                at += n
            units, owner, chars = [], [], 0

        for doc, text in enumerate(texts):
            own = self.bpe.units(text)
            step = max(1, len(own)) if len(text) <= FLUSH else 1 << 16
            for a in range(0, max(1, len(own)), step):
                part = own[a : a + step]
                units += part
                owner.append((doc, len(part), a + step >= len(own)))
                chars += len(text) * len(part) // max(1, len(own))
                if chars >= FLUSH:
                    flush()
        flush()

    def digests(self, texts: list[str]) -> list[list]:
        """n_tokens, ids_sha256 and decoded_sha256 of each text."""
        n = [0] * len(texts)
        of_ids, of_text = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]

        def sink(doc: int, ids: np.ndarray) -> None:
            first, last = n[doc] == 0, len(ids) and ids[-1] == self.bpe.eos
            n[doc] += len(ids)
            if len(ids):
                numbers = self.bpe.decimal.gather(ids)[0].tobytes()
                of_ids[doc].update(numbers[:-1] if last else numbers)
                # the first space stands for the start of the text
                shown = self.decode_bytes(ids)
                of_text[doc].update(shown[1:] if first and shown[:1] == b" " else shown)

        self.run(texts, sink)
        return [n, [h.hexdigest() for h in of_ids], [h.hexdigest() for h in of_text]]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, as the library's decode gives it: bytes that are no UTF-8 become U+FFFD each."""
        shown = self.decode_bytes(np.asarray(ids, np.int64))
        text = re.sub("[\udc80-\udcff]", "�", shown.decode("utf-8", "surrogateescape"))
        return text[1:] if text[:1] == " " and len(ids) and self.bpe.shown.length[ids[0]] and ids[0] not in self.bpe.byte_id else text


_CODERS: dict[str, Coder] = {}


def _coder(key: str, vocabulary: dict) -> Coder:
    """A Python worker's coder: it lasts from task to task."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(Bpe(vocabulary))
    return _CODERS[key]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text with an end id, and decodes the ids again.

    A row per document: id (and the columns `keep`), n_tokens, ids_sha256 (of the decimal ids joined
    by spaces), decoded_sha256; with with_ids=True also `ids` (the ids joined by spaces) and
    `decoded`. A null text counts as empty: its only id is the end id. Repeated rows give repeated rows;
    other columns are ignored, whatever their names, but those of `keep`, which may not be called as a
    column of the result is. An empty table gives an empty result. The model is read once, on the driver; its vocabulary, of fixed size, goes to the tasks.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def start() -> Callable[[list[str]], list]:
        coder = _coder(model, vocabulary.value)

        def work(texts: list[str]) -> list:
            out = coder.digests(texts)
            if with_ids:
                parts: list[list[np.ndarray]] = [[] for _ in texts]
                coder.run(texts, lambda doc, ids: parts[doc].append(ids))
                ids = [np.concatenate(p).tolist() for p in parts]
                out += [[" ".join(map(str, x)) for x in ids], [coder.decode(x) for x in ids]]
            return out

        return work

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_ids
    return per_text(docs, text_col, [id_col, *(keep or [])], start, schema)
