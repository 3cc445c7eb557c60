"""Track queries over the table events: a user is a track, value and props.k its coordinates, hours its time.

replicate is user_id % 12 and group is replicate % 4, so replicates are nested in groups.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TrackConfig
from ..operators import kinematics as kin
from ..operators import metrics as met

CFG = TrackConfig(coords_are_calibrated=True, times_are_calibrated=True)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    replicate = F.col("user_id") % 12
    return e.select(
        F.col("user_id").cast("string").alias("uid"), (replicate % 4).cast("string").alias("group"), replicate.cast("string").alias("replicate"), F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"), "event_id",
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kin.kinematics(kin.selected(spots(spark, sf_dir), CFG), "event_id")


SPOTS = """spots0 AS (SELECT CAST(user_id AS VARCHAR) AS uid, CAST((user_id % 12) % 4 AS VARCHAR) AS "group", CAST(user_id % 12 AS VARCHAR) AS replicate, value AS x,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, epoch_us(ts) / 3.6e9 AS t, event_id FROM events),
spots AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY uid) AS n_ FROM spots0) WHERE n_ >= 20 AND x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL)"""
STEPS = f"""{SPOTS},
k1 AS (SELECT *, row_number() OVER w AS i, t - lag(t) OVER w AS dt0, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM spots WINDOW w AS (PARTITION BY uid ORDER BY t, event_id)),
k2 AS (SELECT *, CASE WHEN dt0 > 0 THEN dt0 END AS dt, sqrt(dx * dx + dy * dy) AS step, atan2(dy, dx) AS heading FROM k1),
k3 AS (SELECT *, step / dt AS speed, heading - lag(heading) OVER w AS a, (dt + lag(dt) OVER w) * 0.5 AS dt_mid FROM k2 WINDOW w AS (PARTITION BY uid ORDER BY i)),
k4 AS (SELECT *, a - 2 * pi() * floor((a + pi()) / (2 * pi())) AS turn, speed - lag(speed) OVER w AS dv, (dt_mid + lag(dt_mid) OVER w) * 0.5 AS dt_mid2, step + lag(step) OVER w AS two FROM k3 WINDOW w AS (PARTITION BY uid ORDER BY i)),
k5 AS (SELECT *, degrees(turn) / dt_mid AS ang_vel, dv / dt_mid AS accel, abs(degrees(turn) / nullif(two, 0)) AS meander FROM k4),
k AS (SELECT *, (ang_vel - lag(ang_vel) OVER w) / dt_mid2 AS ang_acc, (accel - lag(accel) OVER w) / dt_mid2 AS jerk FROM k5 WINDOW w AS (PARTITION BY uid ORDER BY i))"""


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _central(column: str) -> str:
    v = f"list_sort(list({column}) FILTER ({column} IS NOT NULL))"
    return f"CASE WHEN len({v}) < 5 THEN {v} ELSE {v}[CAST(floor(len({v}) * (0.5 - 0.6 / 2)) AS BIGINT) + 1 : least(CAST(floor(len({v}) * (0.5 + 0.6 / 2)) AS BIGINT) + 1, len({v}))] END"


def _trimmed(name: str) -> str:
    c = _central(met.TRIMMED[name])
    return f"{r(f'list_avg({c})', f'avg_{name}')}, {r(f'list_stddev_pop({c})', f'std_{name}')}"


THRESHOLD = """hv AS (SELECT speed, log10(speed) AS v FROM k WHERE speed > 0),
hs AS (SELECT min(v) AS low, max(v) AS high, count(*) AS n, quantile_cont(speed, 0.5) AS median FROM hv),
hh AS (SELECT least(CAST(floor((v - low) / ((high - low) / 128)) AS BIGINT), 127) AS bin, count(*) AS c, any_value(low) AS low, any_value(high) AS high, any_value(n) AS n, any_value(median) AS median FROM hv, hs GROUP BY 1),
hc AS (SELECT *, low + (bin + 0.5) * (high - low) / 128 AS centre FROM hh),
ho AS (SELECT *, sum(c / CAST(n AS DOUBLE)) OVER (ORDER BY bin) AS omega, sum(c / CAST(n AS DOUBLE) * centre) OVER (ORDER BY bin) AS mu FROM hc),
hb AS (SELECT *, pow((SELECT sum(c / CAST(n AS DOUBLE) * centre) FROM hc) * omega - mu, 2) / (omega * (1 - omega)) AS b FROM ho WHERE omega < 1 - 1e-12),
threshold AS (SELECT least(pow(10.0, centre), median) AS threshold FROM hb ORDER BY b DESC, bin LIMIT 1)"""
BOUTS = """b1 AS (SELECT uid, i, dt, coalesce(speed > THR, false) AS moving FROM k WHERE i > 1),
b2 AS (SELECT *, CASE WHEN moving <> coalesce(lag(moving) OVER (PARTITION BY uid ORDER BY i), NOT moving) THEN 1 ELSE 0 END AS new FROM b1),
b3 AS (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY i) AS run FROM b2),
b AS (SELECT uid, run, moving, coalesce(sum(dt), 0.0) AS length FROM b3 GROUP BY uid, run, moving)"""
HALT, LAGS = 5.0, [1, 2, 3, 4, 5, 6, 8, 10]


def _msd_sql(tail: str) -> str:
    pairs = " UNION ALL ".join(f"SELECT uid, {n} AS lag, pow(x - lag(x, {n}) OVER w, 2) + pow(y - lag(y, {n}) OVER w, 2) AS d FROM k WINDOW w AS (PARTITION BY uid ORDER BY i)" for n in LAGS)
    return f"WITH {STEPS}, p AS ({pairs}), m AS (SELECT uid, lag, avg(d) AS msd FROM p WHERE d IS NOT NULL GROUP BY uid, lag) {tail}"


SQL = {
    "spots_canonical": f"WITH {SPOTS} SELECT uid, \"group\", replicate, {r('x', 'x')}, {r('y', 'y')}, {r('t', 't')} FROM spots",
    "spot_summary": f"WITH {SPOTS} SELECT \"group\", replicate, count(DISTINCT uid) AS tracks, count(*) AS spots, {r('count(*) / CAST(count(DISTINCT uid) AS DOUBLE)', 'spots_per_track')} FROM spots GROUP BY ALL",
    "short_track_filter": "SELECT CAST(user_id AS VARCHAR) AS uid, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 60",
    "edge_trim": f"WITH {SPOTS}, e AS (SELECT uid FROM spots WHERE x BETWEEN 10 AND 190 AND y BETWEEN 10 AND 90) SELECT uid, count(*) AS n FROM e GROUP BY uid HAVING count(*) >= 20",
    "kin_steps": f"WITH {STEPS} SELECT uid, i, {r('dt', 'dt')}, {r('step', 'step')}, {r('speed', 'speed')}, {r('heading', 'heading')} FROM k",
    "kin_turns": f"WITH {STEPS} SELECT uid, i, {r('turn', 'turn')}, {r('ang_vel', 'ang_vel', 3)} FROM k WHERE turn IS NOT NULL",
    "kin_accel": f"WITH {STEPS} SELECT uid, i, {r('accel', 'accel', 3)} FROM k WHERE accel IS NOT NULL",
    "kin_jerk": f"WITH {STEPS} SELECT uid, count(jerk) AS n, {r('ln(avg(jerk * jerk))', 'log_jerk')}, {r('ln(avg(ang_acc * ang_acc))', 'log_ang_acc')} FROM k GROUP BY uid",
    "halt_threshold_otsu": f"WITH {STEPS}, {THRESHOLD} SELECT {r('threshold', 'threshold')} FROM threshold",
    "halt_bouts": f"WITH {STEPS}, {BOUTS.replace('THR', str(HALT))} SELECT uid, CAST(run AS BIGINT) AS run, moving, {r('length', 'length')} FROM b",
    "metric_basic": f"WITH {STEPS} SELECT uid, count(*) AS n_spots, {r('max(t) - min(t)', 'duration')}, {r('coalesce(sum(step), 0)', 'accum_distance')}, {_trimmed('velocity')}, {_trimmed('acce')} FROM k GROUP BY uid",
    "metric_angular": f"WITH {STEPS} SELECT uid, {_trimmed('angv')}, {_trimmed('angacc')} FROM k GROUP BY uid",
    "metric_meander": f"WITH {STEPS} SELECT uid, {_trimmed('meander')} FROM k GROUP BY uid",
    "metric_heading": f"WITH {STEPS}, h AS (SELECT uid, avg(sin(heading)) AS s, avg(cos(heading)) AS c FROM k GROUP BY uid), g AS (SELECT *, sqrt(s * s + c * c) AS r FROM h) SELECT uid, {r('degrees(atan2(s, c))', 'mean_heading')}, {r('r', 'heading_R')}, {r('degrees(sqrt(-2 * ln(least(r, 1))))', 'heading_circ_sd')} FROM g",
    "metric_rayleigh": f"WITH {STEPS}, h AS (SELECT uid, count(heading) AS n, avg(sin(heading)) AS s, avg(cos(heading)) AS c FROM k GROUP BY uid), g AS (SELECT *, n * (s * s + c * c) AS z FROM h) SELECT uid, {r('greatest(0, least(1, exp(sqrt(1 + 4 * n + 4 * (n * n - z * z)) - (1 + 2 * n))))', 'rayleigh_p')} FROM g",
    "metric_turn_shape": f"WITH {STEPS} SELECT uid, {r('degrees(avg(abs(turn)))', 'turn_abs_mean')}, {r('degrees(atan2(avg(sin(turn)), avg(cos(turn))))', 'turn_bias')}, {r('kurtosis_pop(turn)', 'turn_kurtosis')} FROM k GROUP BY uid",
    "metric_turn_entropy": f"WITH {STEPS}, c AS (SELECT uid, least(floor((degrees(turn) + 180) / 20), 17) AS bin, count(*) AS c FROM k WHERE turn IS NOT NULL GROUP BY ALL), p AS (SELECT uid, c / CAST(sum(c) OVER (PARTITION BY uid) AS DOUBLE) AS p FROM c) SELECT uid, {r('-sum(p * log2(p))', 'turn_entropy')} FROM p GROUP BY uid",
    "metric_path": f"WITH {STEPS}, a AS (SELECT uid, sum(step) AS path, sqrt(pow(max_by(x, i) - min_by(x, i), 2) + pow(max_by(y, i) - min_by(y, i), 2)) AS net FROM k GROUP BY uid) SELECT uid, {r('net', 'net_displacement')}, {r('net / path', 'straightness')}, {r('path / net', 'tortuosity', 4)} FROM a",
    "metric_sinuosity": f"WITH {STEPS} SELECT uid, {r('1.18 * stddev_pop(turn) / sqrt(avg(step))', 'sinuosity')} FROM k GROUP BY uid",
    "metric_gyration": f"WITH {STEPS} SELECT uid, {r('sqrt(var_pop(x) + var_pop(y))', 'radius_gyration')} FROM k GROUP BY uid",
    "metric_bbox": f"WITH {STEPS}, a AS (SELECT uid, (var_samp(x) + var_samp(y)) / 2 AS h, sqrt(pow((var_samp(x) - var_samp(y)) / 2, 2) + pow(covar_samp(x, y), 2)) AS q FROM k GROUP BY uid) SELECT uid, {r('sqrt((h + q) / (h - q))', 'bbox_aspect')} FROM a",
    "metric_katz": f"WITH {STEPS}, f AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM k WINDOW w AS (PARTITION BY uid ORDER BY i)), a AS (SELECT uid, log10(count(*) - 1) AS lg, max(sqrt(pow(x - x0, 2) + pow(y - y0, 2))) AS far, sum(step) AS path FROM f GROUP BY uid) SELECT uid, {r('lg / (lg + log10(far / path))', 'fractal_dimension')} FROM a",
    "metric_speed_dist": f"WITH {STEPS}, m AS (SELECT uid, avg(speed) AS m, stddev_pop(speed) AS s, quantile_cont(speed, 0.95) AS q FROM k GROUP BY uid), z AS (SELECT uid, avg(pow((speed - m) / s, 3)) AS skew FROM k JOIN m USING (uid) GROUP BY uid) SELECT uid, {r('q', 'speed_max', 4)}, {r('s / m', 'speed_cv')}, {r('skew', 'speed_skew')} FROM m JOIN z USING (uid)",
    "metric_rms": f"WITH {STEPS} SELECT uid, {r('ln(sqrt(avg(accel * accel)))', 'log_accel_rms')}, {r('ln(sqrt(avg(jerk * jerk)))', 'log_jerk_rms')} FROM k GROUP BY uid",
    "metric_intermittency": f"WITH {STEPS}, {BOUTS.replace('THR', str(HALT))}, l AS (SELECT *, max(run) OVER (PARTITION BY uid) AS last FROM b), a AS (SELECT uid, sum(length) AS time, coalesce(sum(length) FILTER (moving), 0) AS mt, coalesce(avg(length) FILTER (NOT moving), 0) AS halt, coalesce(stddev_pop(length) FILTER (NOT moving), 0) AS hs, coalesce(avg(length) FILTER (moving), 0) AS run_mean, count(*) FILTER (moving AND run < last) AS stops FROM l GROUP BY uid) SELECT uid, {r('halt', 'avg_haltT')}, {r('hs', 'std_haltT')}, {r('mt / time', 'fraction_moving')}, {r('stops / time', 'stop_frequency')}, {r('run_mean', 'mean_run_duration')} FROM a",
    "metric_burstiness": f"WITH {STEPS}, {BOUTS.replace('THR', str(HALT))}, r AS (SELECT *, lag(length) OVER (PARTITION BY uid ORDER BY run) AS before FROM b WHERE moving) SELECT uid, {r('CASE WHEN count(*) > 2 THEN (stddev_pop(length) - avg(length)) / (stddev_pop(length) + avg(length)) END', 'burstiness')}, {r('CASE WHEN count(*) > 3 THEN corr(length, before) END', 'memory_coefficient')} FROM r GROUP BY uid",
    "metric_position": f"WITH {STEPS} SELECT uid, {r('avg(x) - min(x)', 'avg_X')}, {r('avg(y) - min(y)', 'avg_Y')}, {r('sqrt(stddev_pop(x) * stddev_pop(y))', 'XYdispersion')} FROM k GROUP BY uid",
    "metric_msd_curve": _msd_sql(f"SELECT uid, lag, {r('msd', 'msd', 4)} FROM m"),
    "metric_msd": _msd_sql(f", d AS (SELECT uid, quantile_cont(dt, 0.5) AS dt FROM k GROUP BY uid HAVING count(dt) = count(*) - 1), l AS (SELECT uid, ln(lag * dt) AS lx, ln(msd) AS ly FROM m JOIN d USING (uid) WHERE msd > 0 AND dt > 0) SELECT uid, {r('regr_slope(ly, lx)', 'msd_alpha')}, {r('exp(regr_intercept(ly, lx)) / 4', 'msd_D', 4)}, {r('regr_r2(ly, lx)', 'msd_r2')} FROM l GROUP BY uid HAVING count(*) >= 4"),
}


TABLE = ("metric_basic", "metric_angular", "metric_meander", "metric_heading", "metric_rayleigh", "metric_turn_shape", "metric_turn_entropy", "metric_sinuosity", "metric_katz", "metric_gyration", "metric_bbox", "metric_position", "metric_intermittency")
SQL["metric_table"] = "WITH " + ", ".join(f"q{i} AS ({SQL[n]})" for i, n in enumerate(TABLE)) + " SELECT * FROM q0 " + " ".join(f"JOIN q{i} USING (uid)" for i in range(1, len(TABLE)))


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that are aggregates, a row a track."""
    k = steps(spark, sf_dir)
    t = met.table(k, CFG, HALT)
    return rounded(t.drop("net_displacement", "straightness", "tortuosity", "burstiness", "memory_coefficient", "mean_pause_duration", "speed_max", "speed_cv", "speed_skew", "accel_rms", "jerk_rms"))


def _of(build, *columns: str, digits: dict[str, int] | None = None):
    """A query: build(steps), rounded, of the columns."""

    @functools.wraps(build)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = build(steps(spark, sf_dir))
        t = t.select(*columns) if columns else t
        return t.select(*[F.round(c, (digits or {}).get(c, 6)).alias(c) if d == "double" else F.col(c) for c, d in t.dtypes])

    return query


def queries() -> dict:
    log = lambda c: F.log(c)
    return {
        "spots_canonical": lambda s, d: rounded(kin.selected(spots(s, d), CFG).select("uid", "group", "replicate", "x", "y", "t")),
        "spot_summary": lambda s, d: rounded(kin.selected(spots(s, d), CFG).groupBy("group", "replicate").agg(F.countDistinct("uid").alias("tracks"), F.count("*").alias("spots")).withColumn("spots_per_track", F.col("spots") / F.col("tracks"))),
        "short_track_filter": lambda s, d: kin.long_enough(spots(s, d), TrackConfig(min_spots=60)).groupBy("uid").agg(F.count("*").alias("n")),
        "edge_trim": lambda s, d: kin.inside(kin.selected(spots(s, d), CFG), TrackConfig(edge_margin=10, image_width=200, image_height=100)).groupBy("uid").agg(F.count("*").alias("n")),
        "kin_steps": _of(lambda k: k, "uid", "i", "dt", "step", "speed", "heading"),
        "kin_turns": _of(lambda k: k.where("turn is not null"), "uid", "i", "turn", "ang_vel", digits={"ang_vel": 3}),
        "kin_accel": _of(lambda k: k.where("accel is not null"), "uid", "i", "accel", digits={"accel": 3}),
        "kin_jerk": _of(lambda k: k.groupBy("uid").agg(F.count("jerk").alias("n"), log(F.avg(F.col("jerk") * F.col("jerk"))).alias("log_jerk"), log(F.avg(F.col("ang_acc") * F.col("ang_acc"))).alias("log_ang_acc"))),
        "halt_threshold_otsu": _of(kin.halt_threshold),
        "halt_bouts": _of(lambda k: kin.bouts(k, HALT)),
        "metric_basic": _of(lambda k: met.basic(k, CFG)),
        "metric_angular": _of(lambda k: met.angular(k, CFG), "uid", "avg_angv", "std_angv", "avg_angacc", "std_angacc"),
        "metric_meander": _of(lambda k: met.angular(k, CFG), "uid", "avg_meander", "std_meander"),
        "metric_heading": _of(met.heading, "uid", "mean_heading", "heading_R", "heading_circ_sd"),
        "metric_rayleigh": _of(met.heading, "uid", "rayleigh_p"),
        "metric_turn_shape": _of(met.turns, "uid", "turn_abs_mean", "turn_bias", "turn_kurtosis"),
        "metric_turn_entropy": _of(met.turns, "uid", "turn_entropy"),
        "metric_path": _of(met.path, "uid", "net_displacement", "straightness", "tortuosity", digits={"tortuosity": 4}),
        "metric_sinuosity": _of(met.path, "uid", "sinuosity"),
        "metric_gyration": _of(met.path, "uid", "radius_gyration"),
        "metric_bbox": _of(met.path, "uid", "bbox_aspect"),
        "metric_katz": _of(met.path, "uid", "fractal_dimension"),
        "metric_position": _of(met.path, "uid", "avg_X", "avg_Y", "XYdispersion"),
        "metric_speed_dist": _of(met.speed, "uid", "speed_max", "speed_cv", "speed_skew", digits={"speed_max": 4}),
        "metric_rms": _of(lambda k: met.speed(k).select("uid", log("accel_rms").alias("log_accel_rms"), log("jerk_rms").alias("log_jerk_rms"))),
        "metric_intermittency": _of(lambda k: met.intermittency(k, HALT), "uid", "avg_haltT", "std_haltT", "fraction_moving", "stop_frequency", "mean_run_duration"),
        "metric_burstiness": _of(lambda k: met.intermittency(k, HALT), "uid", "burstiness", "memory_coefficient"),
        "metric_msd_curve": _of(lambda k: met.displacement(k, LAGS), digits={"msd": 4}),
        "metric_msd": _of(lambda k: met.diffusion(k, LAGS), digits={"msd_D": 4}),
        "metric_table": metric_table,
    }
