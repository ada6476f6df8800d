"""Exact order statistics of columns of any length by repeated histograms.

A histogram between a column's least and greatest value tells in which of its bins a wanted rank lies; the next one is of
that bin's values alone. State is a count, a least and a greatest value for each bin and each wanted rank, whatever the
number of rows; a bin that holds only a few values is read in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024
#: Values of a bin that are few enough to be read.
FEW = 2048


@dataclass
class _Wanted:
    column: str
    rank: int  # among the values from low to high
    low: float
    high: float
    n: int


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], bins: int = BINS, few: int = FEW) -> dict[tuple[str, int], float]:
    """(column, rank) -> the value at that rank, from 0, of the column's values in order; nulls and NaN are no values.

    df is read once for each round: it should be a written table. There are two rounds for most data; each takes away
    from a bin that is still too large at least its least or its greatest value.
    """
    found: dict[tuple[str, int], float] = {}
    names = [c for c, wanted in ranks.items() if wanted]
    if not names:
        return found
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    whole = df.agg(*[f(value(c)).alias(f"{i}{n}") for i, c in enumerate(names) for n, f in (("low", F.min), ("high", F.max), ("n", F.count))]).first()
    open_: dict[tuple[str, int], _Wanted] = {}
    for i, c in enumerate(names):
        for rank in ranks[c]:
            if not 0 <= rank < whole[f"{i}n"]:
                raise ValueError(f"{c} has no rank {rank}")
            open_[c, rank] = _Wanted(c, rank, whole[f"{i}low"], whole[f"{i}high"], whole[f"{i}n"])
    while open_:
        for key, w in list(open_.items()):
            if w.low == w.high:
                found[key] = w.low
                del open_[key]
        spans = sorted({(w.column, w.low, w.high, w.n) for w in open_.values()})
        small = {s for s in spans if s[3] <= few}
        # one pass over df for all spans; a value may lie in several
        parts = []
        for i, (c, low, high, n) in enumerate(spans):
            at = F.least(F.floor((value(c) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int") if math.isfinite(high - low) else F.when(value(c) < 0, 0).otherwise(1)
            inside = (value(c) >= low) & (value(c) <= high)
            parts.append(F.when(inside, F.struct(F.lit(i).alias("span"), (F.lit(0) if (c, low, high, n) in small else at).alias("bin"), value(c).alias("v"))))
        if not parts:
            break
        rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.*")
        few_rows = [i for i, s in enumerate(spans) if s in small]
        listed: dict[int, list[float]] = {}
        for r in rows.where(F.col("span").isin(few_rows)).collect() if few_rows else []:  # `few` for each span at most
            listed.setdefault(r["span"], []).append(r["v"])
        counted: dict[int, list] = {}
        if len(few_rows) < len(spans):
            for r in rows.where(~F.col("span").isin(few_rows)).groupBy("span", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():  # `bins` rows a span
                counted.setdefault(r["span"], []).append((r["bin"], r["n"], r["low"], r["high"]))
        for key, w in list(open_.items()):
            i = spans.index((w.column, w.low, w.high, w.n))
            if i in listed:
                found[key] = sorted(listed[i])[w.rank]
                del open_[key]
                continue
            for _, n, low, high in sorted(counted[i]):
                if w.rank < n:
                    open_[key] = _Wanted(w.column, w.rank, low, high, n)
                    break
                w.rank -= n
    return found


def percentiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], **options) -> dict[str, list[float]]:
    """The linear percentiles of each column (low + (high - low) * rest); of a column without values none."""
    counts = df.agg(*[F.count(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    places = {c: [s * (counts[f"n{i}"] - 1) for s in shares] for i, c in enumerate(columns) if counts[f"n{i}"]}
    wanted = {c: sorted({f(p) for p in ps for f in (math.floor, math.ceil)}) for c, ps in places.items()}
    values = order_statistics(df, wanted, **options)
    return {c: [(low := values[c, math.floor(p)]) + (values[c, math.ceil(p)] - low) * (p - math.floor(p)) for p in ps] for c, ps in places.items()}
