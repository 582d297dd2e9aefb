"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans.

Words are runs of letters. A word's script, by ranges of code points, leaves the languages that are
written in it; its character n-grams and the word itself give each of those a log probability. The
best sequence of labels, where a change of language costs a penalty, cuts a text into spans; the
language with most letters is the text's. All texts of a batch take their steps together.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import per_text, staged

#: The model is fitted on at most so many distinct texts of each language, those of the smallest hashes,
#: and on the languages with most distinct texts, at most so many.
TEXTS, LANGUAGES = 1000, 128
#: Hashed n-grams and words have so many counts a language; n-grams have up to so many characters.
BUCKETS, GRAM = 1 << 16, 4
#: A change of language costs so much; a word's log probabilities end at the floor; and n-grams, which
#: overlap, count by the tempering factor.
PENALTY, FLOOR, TEMPER, WORD_WEIGHT = 4.0, -7.0, 0.4, 2.0
#: A language uses a script for at least this share of its letters.
SHARE = 0.01
#: Words whose scores a worker remembers.
MEMORY = 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]{1,32}")
# The first code point of a run of blocks, and the script that it is used for.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"),
    (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0800, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([first for first, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams (with marks at both ends), the word of each, the bucket of each whole word, and each word's script."""
    lower = [w.lower() for w in words]
    n = np.fromiter(map(len, lower), np.int64, len(lower))
    code = np.frombuffer("".join(f"\x01{w}\x02" for w in lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), n + 2)
    buckets, owner = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(code), np.uint64)
        for k in range(GRAM):
            h = h[: len(code) - k] * np.uint64(0x100000001B3) + code[k:] + np.uint64(k + 1)
            inside = of[: len(h)] == of[k : k + len(h)]
            if k == 0:
                inside &= code > 2
            mixed = (h[inside] ^ (h[inside] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append(((mixed ^ (mixed >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64))
            owner.append(of[: len(h)][inside])
    whole = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in lower), np.int64, len(lower))
    real = code > 2
    script = _SCRIPT[np.searchsorted(_STARTS, code[real].astype(np.int64), side="right") - 1]
    seen = np.bincount(of[real] * len(_NAMES) + script, minlength=len(words) * len(_NAMES)).reshape(len(words), -1)
    return np.concatenate(buckets), np.concatenate(owner), whole, seen.argmax(1)


def _letters(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


@dataclass(frozen=True)
class Model:
    """Languages; log probabilities of n-grams and of words (bucket, language); and who uses which script (script, language)."""

    languages: list[str]
    grams: np.ndarray
    words: np.ndarray
    uses: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probabilities (word, language) of the languages, FLOOR at least."""
        bucket, owner, whole, script = _features(words)
        total = WORD_WEIGHT * self.words[whole].astype(float)
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(words)))
        total += np.add.reduceat(self.grams[bucket[order]].astype(float), starts, axis=0)
        candidate = self.uses[script]
        candidate = candidate | ~candidate.any(1, keepdims=True)  # a script that nobody uses tells nothing
        total = np.where(candidate, TEMPER * total, -np.inf)
        total -= total.max(1, keepdims=True)
        return np.maximum(total - np.log(np.exp(total).sum(1, keepdims=True)), FLOOR)


def viterbi(scores: np.ndarray, word: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of every word. `word` numbers rows of scores, the texts' words one after another; all texts step together."""
    label = np.zeros(len(word), np.int32)
    order = np.argsort(-counts, kind="stable")
    counts, starts = counts[order], (np.cumsum(counts) - counts)[order]
    longest = int(counts.max(initial=0))
    stays, best = np.ones((len(word), scores.shape[1]), bool), np.zeros(len(word), np.int32)
    active = np.searchsorted(-counts, -np.arange(longest), side="left")  # texts with more words than that
    value = np.zeros((len(counts), scores.shape[1]))
    for t in range(longest):
        m = active[t]
        at, v = starts[:m] + t, value[:m]
        if t:
            top = v.argmax(1)
            moved = v[np.arange(m), top] - penalty
            stays[at], best[at] = v >= moved[:, None], top
            v = np.maximum(v, moved[:, None])
        value[:m] = v + scores[word[at]]
    state = value.argmax(1).astype(np.int32)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at, s = starts[:m] + t, state[:m]
        label[at] = s
        state[:m] = np.where(stays[at, s], s, best[at])
    return label


class Identifier:
    """Labels texts; remembers the scores of earlier words."""

    def __init__(self, model: Model, penalty: float = PENALTY, memory: int = MEMORY):
        self.model, self.penalty, self.memory = model, penalty, memory
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores, self.letters = np.zeros((1 << 12, len(self.model.languages)), np.float32), np.zeros(1 << 12, np.int32)

    def _learn(self, words: list[str]) -> None:
        if len(self.number) > self.memory:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        n = len(self.number)
        while n + len(new) > len(self.scores):
            self.scores, self.letters = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
        for k in range(0, len(new), 1 << 16):
            part = new[k : k + (1 << 16)]
            self.scores[n + k : n + k + len(part)] = self.model.scores(part)
            self.letters[n + k : n + k + len(part)] = [*map(_letters, part)]
        self.number.update(zip(new, range(n, n + len(new)), strict=True))

    def run(self, texts: list[str], with_spans: bool = False) -> list[list]:
        """Language, score and number of spans of each text, and with with_spans its spans (start, end, language)."""
        if not self.model.languages:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)] + [[[] for _ in texts]] * with_spans
        found = [_WORD.findall(t) for t in texts]
        flat = [w for words in found for w in words]
        self._learn(flat)
        word = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))
        kept = np.flatnonzero(self.letters[word] > 0)
        word, of = word[kept], of[kept]
        label = viterbi(self.scores, word, np.bincount(of, minlength=len(texts)), self.penalty)
        width = len(self.model.languages)
        letters = np.bincount(of * width + label, weights=self.letters[word], minlength=len(texts) * width).reshape(len(texts), width)
        total, top = letters.sum(1), letters.argmax(1)
        turn = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(label) != 0))[: len(of)])
        names = [self.model.languages[k] if n else UNKNOWN for k, n in zip(top.tolist(), total.tolist(), strict=True)]
        out = [names, (letters.max(1) / np.maximum(total, 1)).tolist(), np.bincount(of[turn], minlength=len(texts)).tolist()]
        if with_spans:
            place = np.array([x.span() for t in texts for x in _WORD.finditer(t)], np.int64).reshape(-1, 2)[kept]
            ends = np.append(turn[1:], len(of)) - 1
            spans: list[list] = [[] for _ in texts]
            for d, a, b, k in zip(of[turn].tolist(), place[turn, 0].tolist(), place[ends, 1].tolist() if len(ends) and len(of) else [], label[turn].tolist(), strict=True):
                spans[d].append((a, b, self.model.languages[k]))
            out.append(spans)
        return out


def _sample(docs: DataFrame, text_col: str, lang_col: str, texts: int, languages: int) -> DataFrame:
    """(lang, text): distinct texts of the smallest hashes of each language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND length(text) > 0").withColumn("h", F.xxhash64("text"))
    keys = staged(rows.select("lang", "h").distinct(), "language-keys")
    most = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    # a share of each language's hashes that holds about twice as many texts, so that few rows are ranked
    few = keys.join(F.broadcast(most), "lang").filter(F.pmod("h", F.lit(1 << 20)) <= F.ceil(F.lit(2.0 * texts * (1 << 20)) / F.col("count"))).select("lang", "h")
    nth = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h"))).filter(F.col("nth") <= texts)
    cuts = nth.groupBy("lang").agg(F.max(F.struct(F.pmod("h", F.lit(1 << 20)).alias("low"), "h")).alias("cut"))  # a row per language
    chosen = rows.join(F.broadcast(cuts), "lang").filter(F.struct(F.pmod("h", F.lit(1 << 20)).alias("low"), "h") <= F.col("cut"))
    return chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS, languages: int = LANGUAGES) -> Model:
    """Fits on rows whose text and language are not null, on at most `texts` texts of each of `languages` languages."""
    kinds = {"gram": 0, "word": 1, "script": 2}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not (words := [w for w in _WORD.findall(text) if _letters(w)]):
                    continue
                now = counts.setdefault(lang, np.zeros(3 * BUCKETS, np.int64))
                for k in range(0, len(words), 1 << 16):
                    part = words[k : k + (1 << 16)]
                    bucket, _, whole, script = _features(part)
                    now[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    now[BUCKETS : 2 * BUCKETS] += np.bincount(whole, minlength=BUCKETS)
                    now[2 * BUCKETS :] += np.bincount(script, weights=[*map(_letters, part)], minlength=BUCKETS).astype(np.int64)
        for lang, now in counts.items():
            at = np.flatnonzero(now)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(now[at])], ["lang", "at", "n"])

    made = _sample(docs, text_col, lang_col, texts, languages).mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(made["lang"].unique())
    counts = np.zeros((3 * BUCKETS, len(names)))
    counts[made["at"].to_numpy(int), made["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int)] = made["n"].to_numpy(float)
    parts = {k: counts[i * BUCKETS : (i + 1) * BUCKETS] for k, i in kinds.items()}

    def log_odds(n: np.ndarray) -> np.ndarray:
        return np.log((n + 0.5) / (n.sum(0) + 0.5 * BUCKETS)).astype(np.float32)

    script = parts["script"][: len(_NAMES)]
    return Model(names, log_odds(parts["gram"]), log_odds(parts["word"]), script >= SHARE * np.maximum(script.sum(0), 1))


_IDENTIFIERS: dict[str, Identifier] = {}


def identify(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None, keep: list[str] | None = None, penalty: float = PENALTY, with_spans: bool = False) -> DataFrame:
    """A row per document: id (and the columns `keep`), lang_pred, score, n_spans, and with with_spans=True the spans as start:end:language, joined by commas.

    The model is fitted on the rows where `learn` holds, all if it is None, unless one is given. score
    is the share of the text's letters that lie in spans of lang_pred. Texts that are null, or hold no
    letter, and all texts where no language was learned, have lang_pred `und`, score 0 and no spans.
    Of languages with as many letters the first in code-point order is taken. Repeated rows give
    repeated rows; null ids stay; an empty table gives an empty result; other columns are ignored.
    """
    if model is None:
        model = train(docs if learn is None else docs.filter(learn), text_col, lang_col)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def start() -> Callable[[list[str]], list]:
        if key not in _IDENTIFIERS:  # lasts from task to task
            _IDENTIFIERS.clear()
            _IDENTIFIERS[key] = Identifier(shared.value, penalty)
        one = _IDENTIFIERS[key]

        def work(texts: list[str]) -> list:
            out = one.run(texts, with_spans)
            if with_spans:
                out[3] = [",".join(f"{a}:{b}:{k}" for a, b, k in spans) for spans in out[3]]
            return out

        return work

    schema = "lang_pred string, score double, n_spans long" + ", spans string" * with_spans
    return per_text(docs, text_col, [id_col, *(keep or [])], start, schema)


def fold(id_col: Column, folds: int = 5) -> Column:
    """The crc32 of an id as text, modulo `folds`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
