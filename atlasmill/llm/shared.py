"""Helpers that several corpus operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import discard, shared_dir, staged

#: `[^\x20\x09-\x0D]+`: a word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Staged tables that go together once their result is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(staged(df, label))
        return self.tables[-1]

    def clear(self) -> None:
        for table in self.tables:
            discard(table)
        self.tables = []


def text_or_empty(text: str) -> F.Column:
    return F.coalesce(F.col(text), F.lit(""))


_SPARK = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
#: Texts are handed to Python work in parts of about so many bytes, one text at least.
PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, text: str, at_once: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    group = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // at_once if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def per_text(docs: DataFrame, text_col: str, keep: list[str], start: Callable[[], Callable[[list[str]], list]], schema: str) -> DataFrame:
    """The columns `keep`, untouched, and those of `schema` made from each whole text; null texts count as empty.

    start() is called once in each task and returns the work: a list of texts to a list of columns.
    Arrow batches stream through the task in parts of bounded size.
    """
    fields = [tuple(x.split()) for x in schema.split(", ")]
    made = pa.schema([(n, _ARROW[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in parts(batch, "__text"):
                columns = work(part.column("__text").to_pylist())
                arrays = [pa.array(c, f.type) for c, f in zip(columns, made, strict=True)]
                kept = [n for n in part.schema.names if n != "__text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *arrays], [*kept, *made.names])

    rows = docs.select(*[F.col(c) for c in keep], text_or_empty(text_col).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, _SPARK[t]) for n, t in fields]]))


#: Keys up to this number go to every task (at most some 32 MB each); beyond it both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def row_key(id_col: str, text_col: str) -> list[F.Column]:
    """Columns id, check and n_bytes: what tells rows apart. Only repeated rows share all three."""
    text = text_or_empty(text_col)
    return [F.col(id_col).alias("id"), F.xxhash64(text).alias("check"), F.octet_length(text).alias("n_bytes")]


def _same(a: DataFrame, b: DataFrame) -> F.Column:
    return a.id.eqNullSafe(b.id) & (a.check == b.check) & (a.n_bytes == b.n_bytes)


def keep_rows(docs: DataFrame, id_col: str, text_col: str, verdicts: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns and no others.

    verdicts: id, check, n_bytes, copies, kept, a row per key. Few dropped keys are broadcast, so that
    texts stay where they are. Of a repeated row that is kept, one occurrence stays.
    """
    verdicts = staged(verdicts.select("id", "check", "n_bytes", "copies", "kept"), "verdicts")
    gone, twice = verdicts.filter("NOT kept"), verdicts.filter("kept AND copies > 1")
    sizes = verdicts.agg(F.count_if(~F.col("kept")).alias("gone"), F.count_if(F.col("kept") & (F.col("copies") > 1)).alias("twice")).first()

    def side(keys: DataFrame, n: int) -> DataFrame:
        return F.broadcast(keys) if n <= BROADCAST_KEYS else keys

    rows = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col))
    left = rows.join(side(gone, sizes.gone), _same(rows, gone), "left_anti") if sizes.gone else rows
    if not sizes.twice:
        return left.select("row.*")
    one = left.join(side(twice, sizes.twice), _same(left, twice), "left_semi").groupBy("id", "check", "n_bytes").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    rest = left.join(side(twice, sizes.twice), _same(left, twice), "left_anti")
    return rest.select("row.*").unionByName(one.select("row.*"))
