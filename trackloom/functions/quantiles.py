"""Exact quantiles of whole columns without gathering a column in one task.

Every pass counts values by 4,096 equal parts of what is left around each wanted place, so tasks pass on counts, and what
is left shrinks to one distinct value. Few passes are usual; repeated values end a search at once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 4096


def order_statistics(table: DataFrame, places: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """Of each column the values at those places (from 0) of its finite values in ascending order."""
    found: dict[str, dict[int, float]] = {c: {} for c in places}
    # Of each place what is still searched: least and greatest value there, and how many values lie below.
    ends = table.agg(*[f(_finite(c)).alias(f"{n}{i}") for i, c in enumerate(places) for n, f in (("low", F.min), ("high", F.max))]).first()
    open_ = {(c, k): (ends[f"low{i}"], ends[f"high{i}"], 0) for i, (c, ks) in enumerate(places.items()) for k in ks if ends[f"low{i}"] is not None}
    while open_:
        for (c, k), (low, high, _) in list(open_.items()):
            if low == high:
                found[c][k] = low
                del open_[c, k]
        spans = sorted({(c, low, high) for (c, _), (low, high, _) in open_.items()})
        if not spans:
            break
        parts = []
        for i, (c, low, high) in enumerate(spans):
            v = _finite(c)
            # Halves, since the whole span may exceed a double; the part never decreases as v grows.
            part = F.least(F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * PARTS), F.lit(PARTS - 1)).cast("int")
            parts.append(F.when(v.between(low, high), F.struct(F.lit(i).alias("span"), part.alias("part"), v.alias("v"))))
        counted = table.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("s")).groupBy("s.span", "s.part").agg(F.count("*").alias("n"), F.min("s.v").alias("low"), F.max("s.v").alias("high")).collect()
        by: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["span"], r["part"])):
            by.setdefault(r["span"], []).append(r)
        number = {s: i for i, s in enumerate(spans)}
        for (c, k), (low, high, below) in list(open_.items()):
            for r in by[number[c, low, high]]:
                if k < below + r["n"]:
                    open_[c, k] = (r["low"], r["high"], below)
                    break
                below += r["n"]
    return found


def _finite(c: str):
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < math.inf), v)


def quantiles(table: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Of each column the quantiles of its finite values, between two values in proportion; None where it has none."""
    count = table.agg(*[F.count(_finite(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    n = {c: count[f"n{i}"] for i, c in enumerate(columns)}
    wanted = {c: sorted({k for q in shares for k in (math.floor(q * (n[c] - 1)), math.ceil(q * (n[c] - 1)))}) for c in columns if n[c]}
    at = order_statistics(table, wanted) if wanted else {}

    def value(c: str, q: float) -> float | None:
        if not n[c]:
            return None
        place = q * (n[c] - 1)
        low, high = at[c][math.floor(place)], at[c][math.ceil(place)]
        return low + (high - low) * (place - math.floor(place))

    return {c: [value(c, q) for q in shares] for c in columns}
