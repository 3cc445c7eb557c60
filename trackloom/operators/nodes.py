"""Tables of a map's nodes: what they hold, how features change across them, when tracks visit them, where rows are drawn.

A lattice has hundreds of nodes; its tables are built from it and joined to the rows' aggregates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .som import Lattice, hits

#: Colour of a node: least saturation and brightness, of 255, and the turn of all hues. Fixed values.
SATURATION, BRIGHTNESS, ROTATION = 100.0, 70.0, 0.0
#: A hexagon's radius where columns are one apart, and how much of it and of the bearing a row's place may use. Fixed values.
RADIUS, INSIDE, JITTER = 1 / math.sqrt(3), 0.866, 0.20


def composition(assignment: DataFrame, group: str, nodes: int) -> DataFrame:
    """(node, g, hits, fraction, load) of the cells that have rows, of a map of so many nodes: the group's share of its node,
    and where the node's rows lie between those of the emptiest node and the fullest; 0 if all nodes have as many."""
    h = hits(assignment, group)
    n = h.groupBy(F.col("node").alias("at")).agg(F.sum("hits").alias("n"))
    ends = n.agg(F.max("n").alias("most"), F.when(F.count("*") < nodes, F.lit(0)).otherwise(F.min("n")).alias("least"))
    load = F.coalesce(F.try_divide(F.col("n") - F.col("least"), F.col("most") - F.col("least")), F.lit(0.0))
    return h.join(n, F.col("node") == F.col("at")).crossJoin(ends).select("node", "g", "hits", (F.col("hits") / F.col("n")).alias("fraction"), load.alias("load"))  # ends is one row


def colours(assignment: DataFrame, group: str, nodes: int, hues: dict[str, float] | None = None) -> DataFrame:
    """(node, hue, saturation, brightness, present, load) of the occupied nodes: the circular mean of the groups' hues by
    their shares, less saturation the more groups are present, and more brightness the fuller the node. Groups lie evenly
    around the circle in the order of their names unless hues says where."""
    c = composition(assignment, group, nodes)
    if hues is None:
        named = [r[0] for r in c.select(F.col("g").cast("string").alias("g")).distinct().orderBy("g").collect()]
        hues = {g: i / len(named) for i, g in enumerate(named)}
    of = F.create_map(*[F.lit(v) for g, h in hues.items() for v in (str(g), float(h))])
    turn = 2 * math.pi * (F.element_at(of, F.col("g").cast("string")) + ROTATION)
    m = c.groupBy("node").agg(F.sum(F.col("fraction") * F.sin(turn)).alias("s"), F.sum(F.col("fraction") * F.cos(turn)).alias("c"), F.count("*").alias("present"), F.max("load").alias("load"))
    share = F.lit(0.0) if len(hues) <= 1 else (F.col("present") - 1) / (len(hues) - 1)
    low, dark = SATURATION / 255, BRIGHTNESS / 255
    return m.select("node", F.pmod(F.atan2("s", "c") / (2 * math.pi), F.lit(1.0)).alias("hue"), (1 - (1 - low) * share).alias("saturation"), (dark + (1 - dark) * F.col("load")).alias("brightness"), "present", "load")


def codebook_table(spark, codebook: np.ndarray, names: list[str] | None = None) -> DataFrame:
    """(node, feature, value) of a codebook."""
    names = names or [f"f{i}" for i in range(codebook.shape[1])]
    return spark.createDataFrame([(int(i), names[j], float(v)) for (i, j), v in np.ndenumerate(codebook)], "node int, feature string, value double")


def local_gradients(values: DataFrame, lattice: Lattice) -> DataFrame:
    """(node, feature, gx, gy, magnitude): the slope of each feature at each node, from the plane through the differences to
    its lattice neighbours (least squares; of several such planes the flattest). A node of fewer than two neighbours has
    slope 0; a neighbour without a value counts as level."""
    step = []
    for i, near in enumerate(lattice.adjacent):
        at = np.flatnonzero(near)
        if len(at) > 1:
            fit = np.linalg.pinv(np.c_[lattice.xy[at] - lattice.xy[i], np.ones(len(at))])
            step += [(i, int(j), float(x), float(y)) for j, x, y in zip(at, fit[0], fit[1], strict=True)]
    spark = values.sparkSession
    weight = F.broadcast(spark.createDataFrame(step, "node int, other int, wx double, wy double"))  # at most six a node
    other = values.select(F.col("node").alias("other"), "feature", F.col("value").alias("there"))
    x = values.join(weight, "node", "left").join(other, ["other", "feature"], "left")
    rise = F.coalesce(F.col("there") - F.col("value"), F.lit(0.0))
    g = x.groupBy("node", "feature").agg(*[F.coalesce(F.sum(F.col(w) * rise), F.lit(0.0)).alias(n) for w, n in (("wx", "gx"), ("wy", "gy"))])
    return g.withColumn("magnitude", F.hypot("gx", "gy"))


def nearest_node(columns: list[str], nodes: np.ndarray, digits: int = 9) -> Column:
    """The node nearest to the columns' values, of equal ones (to so many digits) the smaller; for maps of few nodes and
    columns, as an expression."""
    away = lambda w: sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, w, strict=True)), F.lit(0.0))
    return F.array_min(F.array(*[F.struct(F.round(away(w), digits).alias("d"), F.lit(i).alias("node")) for i, w in enumerate(nodes)]))["node"]


def visits(rows: DataFrame, node: str, t: str, group: str, bins: int = 24) -> DataFrame:
    """(bin, g, node, n, share): a kymograph of where each group's rows are. Bins are equal spans of the whole time, the
    last one closed; share is of the group's rows in the bin. Rows without a time or node are left out; if all times are
    equal, all rows are in bin 0."""
    there = rows.where(F.col(t).isNotNull() & F.col(node).isNotNull())
    low, high = there.agg(F.min(t).cast("double"), F.max(t).cast("double")).first()
    span = (high - low) if low is not None else 0.0
    at = F.least(F.floor((F.col(t) - low) / span * bins), F.lit(bins - 1)).cast("int") if span else F.lit(0)
    n = there.groupBy(at.alias("bin"), F.col(group).alias("g"), F.col(node).alias("node")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bin", "g")))


def positions(assignment: DataFrame, key: str, lattice: Lattice, scale: tuple[float, float] | None = None, jitter: float = JITTER) -> DataFrame:
    """(key, bmu, fit, x, y): where a row is drawn in its node: the farther out the worse it fits, towards its runner-up.

    fit is the quantisation error within scale, 0 to 1; scale is (best, worst), by default the errors' 5 % and 95 %
    quantiles. The bearing is turned by a hash of the key, so a row stays where it is from frame to frame.
    """
    if scale is None:
        from ..functions.quantiles import quantiles

        low, high = quantiles(assignment, ["bmu_distance"], [0.05, 0.95])["bmu_distance"]
        if low is None:
            low, high = 0.0, 1.0
        if high - low <= 1e-12:
            high = max(assignment.agg(F.max("bmu_distance")).first()[0], low + 1e-12)
        scale = (low, high)
    low, high = scale
    fit = F.least(F.greatest((F.col("bmu_distance") - low) / (high - low), F.lit(0.0)), F.lit(1.0)) if high - low > 1e-12 else F.lit(0.0)
    place = F.broadcast(lattice.table(assignment.sparkSession).select("node", F.col("x").alias("x0"), F.col("y").alias("y0")))
    other = place.select(F.col("node").alias("node2"), F.col("x0").alias("x2"), F.col("y0").alias("y2"))
    a = assignment.join(place, F.col("bmu") == F.col("node")).join(other, F.col("runner_up") == F.col("node2"))
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    bearing = F.atan2(F.col("y2") - F.col("y0"), F.col("x2") - F.col("x0")) + (drawn - 0.5) * 2 * jitter
    out = F.coalesce(F.nanvl(fit, F.lit(0.0)), F.lit(0.0))
    return a.select(key, "bmu", out.alias("fit"), (F.col("x0") + F.cos(bearing) * out * RADIUS * INSIDE).alias("x"), (F.col("y0") + F.sin(bearing) * out * RADIUS * INSIDE).alias("y"))
