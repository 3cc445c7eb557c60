"""From detections to the derived quantities of each step of a track.

One shuffle by track: all windows share its partitioning and order, and the aggregations that follow keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TrackConfig
from ..functions.columns import ratio, wrapped

MORPHOLOGY = {"area": 2, "major": 1, "minor": 1, "diameter": 1}


def canonical(spots: DataFrame, cfg: TrackConfig) -> DataFrame:
    """Rows with x, y and t, calibrated; lengths and areas too."""
    out = spots.dropna(subset=["x", "y", "t"])
    for c, power in {"x": 1, "y": 1, **MORPHOLOGY}.items():
        if c in out.columns and cfg.scale != 1.0:
            out = out.withColumn(c, F.col(c) * cfg.scale**power)
    return out.withColumn("t", F.col("t") * cfg.time_scale) if cfg.time_scale != 1.0 else out


def long_enough(spots: DataFrame, cfg: TrackConfig) -> DataFrame:
    """Tracks of min_spots rows or more."""
    n = F.count("*").over(Window.partitionBy("uid"))
    return spots.withColumn("_n", n).where(F.col("_n") >= cfg.min_spots).drop("_n")


def inside(spots: DataFrame, cfg: TrackConfig) -> DataFrame:
    """Rows away from the image's edges, in uncalibrated coordinates; then again only tracks that are long enough."""
    m = cfg.edge_margin
    if m <= 0 or not cfg.image_width or not cfg.image_height:
        return spots
    kept = F.col("x").between(m, cfg.image_width - m) & F.col("y").between(m, cfg.image_height - m)
    return long_enough(spots.where(kept), cfg)


def selected(spots: DataFrame, cfg: TrackConfig) -> DataFrame:
    return canonical(inside(long_enough(spots, cfg), cfg), cfg)


def nearest_heading(dy: str, dx: str) -> Column:
    """atan2 to within rounding of the true angle, which Spark's own misses by a last bit in one of six; too slow for all rows."""
    return F.reflect(F.lit("org.apache.commons.math3.util.FastMath"), F.lit("atan2"), F.col(dy).cast("double"), F.col(dx).cast("double")).cast("double")


def kinematics(spots: DataFrame, tie: str = "t") -> DataFrame:
    """spots (calibrated) with i, dt, dx, dy, step, speed, heading, turn, dt_mid, ang_vel, accel, ang_acc and jerk.

    A step whose time does not advance has no dt, and so no speed; its heading stays. tie orders rows of one time.
    The sign of a turn straight on or back hangs on the last bits of the headings, which are found more exactly there.
    """
    w = Window.partitionBy("uid").orderBy("t", tie)
    before = lambda c: F.lag(c).over(w)
    k = spots.withColumns({"i": F.row_number().over(w), "dt0": F.col("t") - before("t"), "dx": F.col("x") - before("x"), "dy": F.col("y") - before("y")})
    k = k.withColumns({"dt": F.when(F.col("dt0") > 0, F.col("dt0")), "step": F.hypot("dx", "dy"), "heading": F.when(F.col("dx").isNotNull(), F.atan2("dy", "dx"))})
    k = k.withColumn("speed", ratio(F.col("step"), F.col("dt")))
    k = k.withColumns({"dh": F.col("heading") - before("heading"), "dx1": before("dx"), "dy1": before("dy"), "dt_mid": 0.5 * (F.col("dt") + before("dt")), "dv": F.col("speed") - before("speed")})
    straight = (F.abs(F.sin("dh")) < 1e-9) & (F.col("dy") != 0)
    k = k.withColumn("turn", wrapped(F.when(straight, nearest_heading("dy", "dx") - nearest_heading("dy1", "dx1")).otherwise(F.col("dh"))))
    k = k.withColumns({"ang_vel": ratio(F.degrees("turn"), F.col("dt_mid")), "accel": ratio(F.col("dv"), F.col("dt_mid"))})
    k = k.withColumn("dt_mid2", 0.5 * (F.col("dt_mid") + before("dt_mid")))
    k = k.withColumns({"ang_acc": ratio(F.col("ang_vel") - before("ang_vel"), F.col("dt_mid2")), "jerk": ratio(F.col("accel") - before("accel"), F.col("dt_mid2"))})
    return k.withColumn("meander", F.abs(ratio(F.degrees("turn"), F.col("step") + before("step")))).drop("dt0", "dv", "dh", "dx1", "dy1")


def halt_threshold(steps: DataFrame, bins: int = 128) -> DataFrame:
    """One row, threshold: Otsu's split of the logarithms of all positive speeds, but the median at most; with fewer than
    fifty speeds their tenth percentile."""
    v = steps.where("speed > 0").select("speed", F.log10("speed").alias("v"))
    span = v.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"), F.percentile("speed", 0.5).alias("median"), F.percentile("speed", 0.1).alias("tenth"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.least(F.floor(ratio(F.col("v") - F.col("low"), width)), F.lit(bins - 1))
    hist = v.join(F.broadcast(span)).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("c"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("n").alias("n"), F.first("median").alias("median"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    centre = F.col("low") + (F.col("bin") + 0.5) * width
    part = hist.withColumns({"centre": centre, "omega": F.sum(F.col("c") / F.col("n")).over(upto), "mu": F.sum(F.col("c") / F.col("n") * centre).over(upto)})
    part = part.withColumn("total", F.max(F.struct("bin", "mu")).over(Window.partitionBy())["mu"])
    between = ratio(F.pow(F.col("total") * F.col("omega") - F.col("mu"), 2), F.col("omega") * (1 - F.col("omega")))
    best = part.where(F.col("omega") < 1 - 1e-12).agg(F.max_by(F.col("centre"), F.struct(between, -F.col("bin"))).alias("centre"), F.first("median").alias("m"))
    few = F.when(F.col("n") < 50, F.col("tenth"))
    return span.join(best).select(F.coalesce(few, F.least(F.pow(F.lit(10.0), "centre"), "median"), F.col("median"), F.lit(0.0)).alias("threshold"))


def bouts(steps: DataFrame, threshold: Column | float) -> DataFrame:
    """(uid, run, moving, length): runs of steps above or not above the threshold, with the time they take."""
    moving = F.coalesce(F.col("speed") > threshold, F.lit(False))
    w = Window.partitionBy("uid").orderBy("i")
    s = steps.where("i > 1").withColumn("moving", moving)
    s = s.withColumn("run", F.sum(F.when(F.col("moving") != F.coalesce(F.lag("moving").over(w), ~F.col("moving")), 1).otherwise(0)).over(w))
    return s.groupBy("uid", "run", "moving").agg(F.coalesce(F.sum("dt"), F.lit(0.0)).alias("length"))


