"""Counter-based random numbers: every number is a hash of its seed and its place, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *place: Column | int) -> Column:
    """A number strictly between 0 and 1: the first 52 bits of the md5 of `seed:place:...`, as a fraction."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in place])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def gamma(seed: int, shape: int, *place: Column | int) -> Column:
    """A number of the gamma law with an integer shape: a sum of exponentials."""
    ks = F.sequence(F.lit(0), F.lit(shape - 1))
    return F.aggregate(ks, F.lit(0.0), lambda total, k: total - F.log(uniform(seed, *place, k)))


def dirichlet(seed: int, parts: int, shape: int, *place: Column | int) -> Column:
    """An array of weights that sum to 1, of the symmetric Dirichlet law with an integer shape."""
    raw = F.array(*[gamma(seed, shape, *place, part) for part in range(parts)])
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def sql_uniform(seed: int, *place: str) -> str:
    """uniform() in DuckDB; `place` are SQL expressions."""
    text = " || ':' || ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in place]])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / {float(1 << 52)!r})"
