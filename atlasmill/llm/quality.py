"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

A logistic model, fitted on labelled documents, gives each document's log odds of being good, without
the base rate. It weighs text statistics and the log odds of the document's hashed words and character
n-grams, which are cross-fitted: a labelled document's n-grams are weighed by the other half's counts.
Sites are nested: host, then path within the host. Grouped sums of the documents' posteriors give each
site's share of good documents, shrunk towards the level above it (a sparse path towards its host, a
sparse host towards all documents) by a strength that the spread between sites determines. A document's
posterior is its evidence with its path's share as the prior; its own part in the shares is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_KEYS, per_text, row_key, staged, text_or_empty

#: At most so many labelled documents, those of the smallest hashes, fit the classifier.
LABELLED_DOCS = 20_000
#: Hashed words and character n-grams have so many weights each; n-grams have so many bytes.
BUCKETS, GRAM = 1 << 14, 4
#: Site tables up to so many rows go to every task.
BROADCAST_ROWS = 100_000
#: Documents below this posterior are rejected.
THRESHOLD = 0.5
_MARKS, _PIPES, _UPPER, _LOWER, _DIGITS, _ENDS = b"#$%&*_~^<>{}[]=+@/\\", b"|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".!?"
STATISTICS = ("marks", "pipes", "bangs", "upper", "digits", "repeated", "stutter", "ends", "word_length", "log_words")
FEATURES = (*STATISTICS, "words", "grams")


def statistics(text: str) -> list[float]:
    """Text statistics per word or per letter; all finite, also for an empty text."""
    data, words = text.encode("utf-8", "surrogatepass"), text.split()
    n = max(1, len(words))

    def share(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    upper = share(_UPPER)
    stutter = sum(map(str.__eq__, words, words[1:]))
    return [
        min(share(_MARKS) / n, 3.0),
        min(share(_PIPES) / n, 3.0),
        min(data.count(b"!") / n, 3.0),
        upper / max(1, upper + share(_LOWER)),
        min(share(_DIGITS) / n, 3.0),
        1 - len(set(words)) / n if n >= 20 else 0.0,
        stutter / n,
        min(share(_ENDS) / n, 1.0),
        min(len(text) / n, 30.0) / 10,
        min(np.log1p(len(words)), 6.0),
    ]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the character n-grams of a text, one for each occurrence, in lower case for ASCII."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    inside = ~(((data >= 9) & (data <= 13)) | (data == 32))
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(low) - GRAM + 1), np.uint64)
        for k in range(GRAM):
            grams = grams * np.uint64(0x100000001B3) + low[k : k + len(grams)] + np.uint64(1)
        start = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
        words = np.zeros(0, np.uint64)
        if len(start):
            span = np.diff(np.append(start, len(low)))
            place = np.arange(start[0], len(low)) - np.repeat(start, span)
            powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(span.max()), 0x9E3779B97F4A7C15, np.uint64)))
            words = np.add.reduceat(np.where(inside[start[0] :], low[start[0] :] + np.uint64(1), np.uint64(0)) * powers[place], start - start[0])
    return _mixed(words).astype(np.int64), _mixed(grams).astype(np.int64)


@dataclass(frozen=True)
class Grams:
    """The log odds of words and of character n-grams, by bucket."""

    words: np.ndarray
    grams: np.ndarray

    def of(self, text: str) -> list[float]:
        """Mean log odds of the text's words and of its n-grams; 0 without any."""
        return [float(odds[at].mean()) if len(at) else 0.0 for odds, at in zip((self.words, self.grams), hashed(text), strict=True)]


def gram_odds(counts: np.ndarray, docs: np.ndarray) -> Grams:
    """Log odds by bucket, with pseudo-counts. counts: good (0, 1), words or n-grams, bucket: documents with it; docs: good."""
    share = (counts + 1) / (docs + 2.0)[:, None, None]
    odds = np.log(share[1]) - np.log(share[0])
    return Grams(odds[0], odds[1])


def count_grams(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents by fold, good, words or n-grams, and bucket; and documents by fold and good. `sample` has fold, y and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, 2, BUCKETS + 1), np.int64)
        for batch in batches:
            for fold, y, text in zip(*(batch.column(c).to_pylist() for c in ("fold", "y", "text")), strict=True):
                for which, at in enumerate(hashed(text)):
                    counts[fold, y, which, np.append(np.unique(at), BUCKETS)] += 1
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(8), pa.int32()), "counts": pa.array([c.tobytes() for c in counts.reshape(8, -1)], pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((8, BUCKETS + 1), np.int64)
    for r in sample.select("fold", "y", "text").mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():  # 8 rows
        counts[r.part] = np.frombuffer(r.counts, np.int64)
    counts = counts.reshape(2, 2, 2, -1)
    return counts[..., :-1], counts[:, :, 0, -1]


@dataclass(frozen=True)
class Model:
    """Standardised logistic regression; evidence() is log odds less those of the training base rate."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float
    grams: Grams

    def features(self, text: str) -> list[float]:
        return [*statistics(text), *self.grams.of(text)]

    def evidence(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        z = (x - self.mean) / self.scale
        return np.clip(np.column_stack([np.ones(len(z)), z]) @ self.weights - self.prior, -20, 20)


def fit(x: np.ndarray, y: np.ndarray, grams: Grams, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Newton's method with a ridge penalty. With one class, or no rows, there is no evidence either way."""
    width = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.0, grams)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.diag([0.0, *[ridge] * width])
    w = np.zeros(width + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty
        w = w + np.linalg.solve(hessian, z.T @ (y - p) - penalty @ w)
    rate = y.mean()
    return Model(mean, scale, w, float(np.log(rate / (1 - rate))), grams)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED_DOCS) -> Model:
    """Fits on at most `most` labelled documents; labels that are null, not 0 or 1, or name no document are skipped."""
    y = F.col(label_col).cast("int")
    chosen = labels.select(F.col(id_col).alias("id"), y.alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").distinct().orderBy(F.xxhash64("id"), "id", "y").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = staged(texts.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")), "labelled")
    counts, n = count_grams(sample)
    folds = sample.sparkSession.sparkContext.broadcast([gram_odds(counts[1 - k], n[1 - k]) for k in (0, 1)])
    schema = ", ".join(f"{f} double" for f in FEATURES)

    def features(texts: list[str]) -> list:
        rows = [[*statistics(t), *folds.value[0].of(t), *folds.value[1].of(t)] for t in texts]
        return [*zip(*rows, strict=True)] if rows else [[]] * (len(FEATURES) + 2)

    made = per_text(sample, "text", ["id", "y", "fold"], lambda: features, schema + ", words_1 double, grams_1 double")
    got = made.orderBy("id", "y", *FEATURES).limit(2 * most).toPandas()  # numbers only
    for c in ("words", "grams"):
        got[c] = got[c].where(got["fold"] == 0, got[f"{c}_1"])
    return fit(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float), gram_odds(counts.sum(0), n.sum(0)))


def _evidence(docs: DataFrame, text_col: str, keep: list, model: Model) -> DataFrame:
    of = docs.sparkSession.sparkContext.broadcast(model)
    return per_text(docs, text_col, keep, lambda: lambda texts: [of.value.evidence(texts)], "evidence double")


def _site(docs: DataFrame, host_col: str, path_col: str) -> Column:
    """Host and path as one struct without nulls: a null is a site of its own."""
    return F.struct(
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(host_col).isNull().alias("no_host"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(path_col).isNull().alias("no_path"),
    )


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def _exact(p: Column) -> Column:
    """A sum of shares that does not depend on the order of its rows."""
    return F.sum(F.round(p, 6).cast("decimal(18,6)")).cast("double")


def _strength(table: DataFrame, n: str, good: str, above: Column) -> float:
    """Pseudo-documents of the level above, by moments: sites that differ little from it are shrunk much.

    The squared differences of the sites' shares from the level above, less what p(1-p)/n explains,
    leave the variance between sites.
    """
    p = F.col(good) / F.col(n)
    within = above * (1 - above)
    r = table.select((F.col(n) * (p - above) * (p - above)).alias("d"), within.alias("w"), F.col(n).alias("n")).agg(F.sum("d").alias("d"), F.sum("w").alias("w"), F.sum(F.col("n") * F.col("w")).alias("nw"), F.sum("n").alias("n")).first()
    if not r.n:
        return 1.0
    between = max((r.d - r.w) / r.n, 1e-6)
    return float(round(min(max(r.nw / r.n / between - 1, 1.0), 1000.0), 6))


@dataclass(frozen=True)
class Sites:
    """A row per path with the sums of its documents and of its host's; the sums of all; and the strengths of shrinkage."""

    table: DataFrame
    n: float
    good: float
    base: float
    host_k: float
    path_k: float

    def own(self, evidence: Column) -> Column:
        """What a document counts in the sums: its posterior with the overall share as the prior."""
        return F.round(1 / (1 + F.exp(-(evidence + float(np.log(self.base / (1 - self.base)))))), 6)

    def shares(self, n: Column, good: Column, host_n: Column, host_good: Column, own: Column | None = None) -> tuple[Column, Column]:
        """The host's and the path's shrunk share of good documents, without one document where `own` is its part in the sums."""
        less, part = (F.lit(0.0), F.lit(0.0)) if own is None else (F.lit(1.0), own)
        rest = F.lit(self.n) - less
        overall = F.when(rest > 0, (F.lit(self.good) - part) / rest).otherwise(self.base)
        host = (host_good - part + self.host_k * overall) / (host_n - less + self.host_k)
        return host, (good - part + self.path_k * host) / (n - less + self.path_k)


def site_sums(evidence: DataFrame) -> Sites:
    """`evidence` has (site, evidence)."""
    plain = evidence.agg(F.count("*").alias("n"), _exact(1 / (1 + F.exp(-F.col("evidence")))).alias("good")).first()
    base = min(max(plain.good / plain.n if plain.n else 0.5, 1e-3), 1 - 1e-3)
    p = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(base / (1 - base))))))
    paths = staged(evidence.groupBy("site").agg(F.count("*").alias("n"), _exact(p).alias("good")), "sites")
    hosts = paths.groupBy("site.host", "site.no_host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    overall = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = overall.good / overall.n if overall.n else 0.5
    host_k = _strength(hosts, "host_n", "host_good", F.lit(share))
    nested = paths.withColumns({"host": F.col("site.host"), "no_host": F.col("site.no_host")}).join(hosts, ["host", "no_host"])
    above = (F.col("host_good") + host_k * share) / (F.col("host_n") + host_k)
    path_k = _strength(nested.withColumn("above", above), "n", "good", F.col("above"))
    return Sites(staged(nested.select("site", "n", "good", "host_n", "host_good"), "site-sums"), float(overall.n or 0), float(overall.good or 0), base, host_k, path_k)


def site_priors(evidence: DataFrame) -> DataFrame:
    """`evidence` has (site, evidence); gives (site, host_share, path_share): shrunk shares of good documents."""
    sites = site_sums(evidence)
    host, path = sites.shares(*map(F.col, ("n", "good", "host_n", "host_good")))
    return sites.table.select("site", host.alias("host_share"), path.alias("path_share"))


def _posterior(rows: DataFrame) -> DataFrame:
    """Adds host_share, path_share (both without the row itself) and posterior to rows with site and evidence."""
    sites = site_sums(rows)
    small = sites.table.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(sites.table) if small else sites.table, "site")
    host, path = sites.shares(*map(F.col, ("n", "good", "host_n", "host_good")), sites.own(F.col("evidence")))
    shared = joined.withColumns({"host_share": host, "path_share": path})
    return shared.withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_share"))))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: id, evidence, host_share, path_share, posterior, good.

    Null texts count as empty; a null host or path is a site of its own; repeated rows give repeated
    rows; an empty table gives an empty result; other columns are ignored. Without labels of both
    classes there is no evidence and every posterior is the neutral one, which counts as good.
    """
    model = model or train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("id"), _site(docs, host_col, path_col).alias("site"), F.col(text_col).alias("text"))
    scored = staged(_evidence(rows, "text", ["id", "site"], model), "evidence")
    return _posterior(scored).select(
        F.col("id").alias(id_col), *[F.round(c, 9).alias(c) for c in ("evidence", "host_share", "path_share", "posterior")], (F.round("posterior", 9) >= threshold).alias("good")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose posterior reaches the threshold, with all their columns and no others.

    As in classify(), null texts count as empty, repeated rows stay or go together, and without labels
    of both classes all stay; an empty table gives an empty result. Each text goes to Python once; the
    keys of rejected rows come back to the documents, whose texts stay where they are if the keys are few.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    key = ["id", "check", "n_bytes", "site"]
    rows = docs.select(*row_key(id_col, text_col), _site(docs, host_col, path_col).alias("site"), F.col(text_col).alias("text"))
    scored = staged(_evidence(rows, "text", key, model), "evidence")
    gone = staged(_posterior(scored).filter(F.round("posterior", 9) < threshold).select(key).distinct(), "rejected")
    own = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col), _site(docs, host_col, path_col).alias("site"))
    same = own.id.eqNullSafe(gone.id) & (own.check == gone.check) & (own.n_bytes == gone.n_bytes) & (own.site == gone.site)
    return own.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, same, "left_anti").select("row.*")
