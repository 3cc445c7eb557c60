"""Preparation of a feature table: what is missing, scaling, pruning. Statistics come from one aggregation, a row that is
joined to every other; its size is that of the list of features. Quantiles come from counts, passes that run at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, ratio
from ..functions.quantiles import quantiles

#: Parts of about as many rows into which the values of a feature are cut to be ranked.
CUTS = 256
SCALERS = ("zscore", "minmax", "robust", "rank", "none")


def cleaned(table: DataFrame, features: list[str]) -> DataFrame:
    """Doubles, with NULL for NaN and infinities."""
    return table.withColumns({c: finite(F.col(c).cast("double")) for c in features})


def with_statistics(table: DataFrame, statistics: dict[str, Column]) -> DataFrame:
    return table.crossJoin(F.broadcast(table.agg(*[c.alias(k) for k, c in statistics.items()])))


def scaled(table: DataFrame, features: list[str], kind: str = "zscore") -> DataFrame:
    """Features centred and scaled: population deviation, range, interquartile range, or average rank; a scale of zero is
    one. rank maps to ((rank - 0.5) / n) and has no inverse."""
    if kind not in SCALERS:
        raise ValueError(f"scaler {kind!r} is none of {', '.join(SCALERS)}")
    if kind == "none":
        return table
    if kind == "rank":
        return ranked(table, features)
    if kind == "robust":
        at = quantiles(table, features, [0.25, 0.5, 0.75])
        span = {c: (q[2] - q[0]) or 1.0 for c, q in at.items() if q[1] is not None}
        return table.withColumns({c: (F.col(c) - at[c][1]) / span[c] for c in span})
    both = {"zscore": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c))}[kind]
    stats = {f"_{w}_{c}": x for c in features for w, x in zip(("centre", "scale"), both(c), strict=True)}
    out = with_statistics(table, stats)
    scale = lambda c: F.when(F.col(f"_scale_{c}") > 0, F.col(f"_scale_{c}")).otherwise(1.0)
    return out.withColumns({c: (F.col(c) - F.col(f"_centre_{c}")) / scale(c) for c in features}).drop(*stats)


def ranked(table: DataFrame, features: list[str]) -> DataFrame:
    """Features as (rank - 0.5) / n, ties averaged. Distinct values are counted and ranked in parts between rough quantiles,
    whose totals give each part its start; rows meet the ranks by value."""
    shares = [i / CUTS for i in range(CUTS)]
    cuts = dict(zip(features, table.agg(*[F.percentile_approx(c, shares, 4 * CUTS) for c in features]).first(), strict=True))
    for c in features:
        low = sorted(set(cuts[c] or []))
        counts = table.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_t"))
        counts = counts.withColumn("_part", F.size(F.filter(F.array(*[F.lit(q) for q in low]), lambda q: q <= F.col("_v"))) if low else F.lit(0))
        sizes = counts.groupBy(F.col("_part").alias("_p")).agg(F.sum("_t").alias("_n"))
        start = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
        before = F.coalesce(F.sum("_t").over(Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = counts.withColumn("_before", before).join(F.broadcast(start), F.col("_part") == F.col("_p"))
        ranks = ranks.select("_v", ((F.col("_start") + F.col("_before") + (F.col("_t") + 1) / 2 - 0.5) / F.col("_all")).alias("_rank"))
        table = table.join(ranks, F.col(c) == F.col("_v"), "left").withColumn(c, F.col("_rank")).drop("_v", "_rank")
    return table


def inverse(table: DataFrame, features: list[str], centre: dict[str, float], scale: dict[str, float], weight: dict[str, float] | None = None) -> DataFrame:
    """Back to the features' own units."""
    return table.withColumns({c: F.col(c) / (weight or {}).get(c, 1.0) * scale[c] + centre[c] for c in features})


def winsorised(table: DataFrame, features: list[str], q: float) -> DataFrame:
    """Clipped to the quantiles q and 1-q."""
    ends = {c: e for c, e in quantiles(table, features, [q, 1 - q]).items() if e[0] is not None}
    return table.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low))) for c, (low, high) in ends.items()})


def imputed(table: DataFrame, features: list[str]) -> DataFrame:
    """The median in place of NULL."""
    at = quantiles(table, features, [0.5])
    return table.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, (m,) in at.items() if m is not None})


def complete_rows(table: DataFrame, features: list[str]) -> DataFrame:
    return table.dropna(subset=features)


def complete_features(table: DataFrame, features: list[str]) -> list[str]:
    """Features without a NULL."""
    row = table.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in features]).first()
    return [c for c in features if not row[c]]


def varying(table: DataFrame, features: list[str], least: float = 1e-12) -> list[str]:
    """Features whose range is above `least`."""
    row = table.agg(*[(F.max(c) - F.min(c)).alias(c) for c in features]).first()
    return [c for c in features if row[c] is not None and row[c] > least]


def correlations(table: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) of every pair of features, a before b in the list; NULL where one of them is constant.

    Rows that have both count. A task passes on its sums of products, a row a pair, whatever the number of its rows.
    """
    if len(features) < 2:
        raise ValueError("two features are needed")
    shift = [float(v or 0.0) for v in table.agg(*[F.avg(c) for c in features]).first()]
    left, right = np.triu_indices(len(features), 1)
    names = ("n", "x", "y", "xx", "yy", "xy")

    def sums(batches):
        total = np.zeros((6, len(features), len(features)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - shift
            there = np.isfinite(x)
            z, h = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([h.T @ h, z.T @ h, h.T @ z, (z * z).T @ h, h.T @ (z * z), z.T @ z])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (left.astype(np.int32), right.astype(np.int32), *total[:, left, right])], ["i", "j", *names])

    doubles = table.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(features)])
    parts = doubles.mapInArrow(sums, "i int, j int, " + ", ".join(f"{n} double" for n in names)).groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])
    at = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(k) + 1)
    mean = lambda c: ratio(F.col(c), F.col("n"))
    spread = lambda c, k: F.when((mean(c + c) - mean(c) * mean(c) > 1e-14 * mean(c + c)) & (mean(c + c) > 1e-24 * F.pow(at(shift, k), 2)), mean(c + c) - mean(c) * mean(c))
    r = (mean("xy") - mean("x") * mean("y")) / F.sqrt(spread("x", "i") * spread("y", "j"))
    return parts.select(at(features, "i").alias("a"), at(features, "j").alias("b"), r.alias("r"))


def uncorrelated(table: DataFrame, features: list[str], most: float = 0.98) -> list[str]:
    """Features in order, without those that correlate above `most` with an earlier one that stays."""
    if len(features) <= 2:
        return features
    r = {(x["a"], x["b"]): abs(x["r"] or 0.0) for x in correlations(table, features).collect()}
    out: list[str] = []
    for c in features:
        if all(r.get((a, c), 0.0) <= most for a in out):
            out.append(c)
    return out


def weighted(table: DataFrame, weights: dict[str, float]) -> DataFrame:
    return table.withColumns({c: F.col(c) * w for c, w in weights.items()})


def summary(table: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, mean, sd, median, min, max) of each feature; population deviation."""
    long = table.select(F.explode(F.array([F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("e")).select("e.*")
    median = F.create_map(*[F.lit(x) for c, (m,) in quantiles(table, features, [0.5]).items() for x in (c, m)]).cast("map<string,double>")
    out = long.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"))
    return out.select("feature", "n", "mean", "sd", F.element_at(median, F.col("feature")).alias("median"), "min", "max")


def group_codes(table: DataFrame, group: str) -> DataFrame:
    """(group, code): groups by name, codes from 0."""
    return table.select(F.col(group).alias("group")).distinct().withColumn("code", F.row_number().over(Window.orderBy("group")) - 1)


def one_hot(table: DataFrame, group: str, values: list[str]) -> DataFrame:
    return table.withColumns({f"is_{v}": (F.col(group) == v).cast("int") for v in values})


def long_form(table: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """(keep, feature, v) without NULL."""
    at = F.explode(F.array([F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features]))
    return table.select(*keep, at.alias("e")).select(*keep, "e.feature", "e.v").where("v is not null")

