"""Track metrics on tracks whose answers are known, and the readers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.config import Config, TrackConfig
from trackloom.operators import kinematics as kin
from trackloom.operators import metrics as met
from trackloom.operators import track_arrays as ta
from trackloom.sources import synthetic, tables
from trackloom.streaming import summary

CFG = TrackConfig(coords_are_calibrated=True, times_are_calibrated=True, min_spots=2)


def steps(spark, **tracks):
    rows = [(k, float(x), float(y), float(t)) for k, points in tracks.items() for x, y, t in points]
    return kin.kinematics(kin.selected(spark.createDataFrame(rows, "uid string, x double, y double, t double"), CFG))


def line(n=40):
    return [(2 * i, 0, i) for i in range(n)]


def circle(n=72):
    return [(math.cos(a), math.sin(a), i) for i, a in enumerate(np.linspace(0, 2 * np.pi, n + 1))]


def test_straight_line(spark):
    k = steps(spark, a=line())
    b, p, h = met.basic(k, CFG).first(), met.path(k).first(), met.heading(k).first()
    assert b["n_spots"] == 40 and b["accum_distance"] == 78 and b["avg_velocity"] == 2 and b["std_velocity"] == 0
    assert p["straightness"] == 1 and p["net_displacement"] == 78 and h["heading_R"] == pytest.approx(1) and h["mean_heading"] == 0
    s = ta.series_metrics(k).first()
    assert s["hull_area"] is None and s["lateral_amplitude"] == pytest.approx(0.41, abs=0.6)


def test_circle(spark):
    k = steps(spark, a=circle())
    t = met.turns(k).first()
    assert t["turn_abs_mean"] == pytest.approx(5) and t["turn_bias"] == pytest.approx(5)
    assert met.path(k).first()["radius_gyration"] == pytest.approx(1, rel=0.02)
    s = ta.series_metrics(k).first()
    assert s["hull_area"] == pytest.approx(math.pi, rel=0.01) and s["hull_perimeter"] == pytest.approx(2 * math.pi, rel=0.01)


def test_square_hull():
    assert ta.hull(np.array([0, 1, 1, 0, 0.5]), np.array([0, 0, 1, 1, 0.5])) == (1, 4)


def test_stop_and_go(spark):
    x, points = 0.0, []
    for i in range(31):
        points.append((x, 0, i))
        x += 3 if i % 10 < 6 else 0
    m = met.intermittency(steps(spark, a=points), 1.0).first()
    assert m["mean_run_duration"] == 6 and m["avg_haltT"] == 4 and m["fraction_moving"] == pytest.approx(0.6) and m["stop_frequency"] == pytest.approx(0.1)


def test_time_that_does_not_advance(spark):
    k = steps(spark, a=[(0, 0, 0), (1, 0, 1), (2, 0, 1), (3, 0, 2)])
    r = k.orderBy("i").collect()
    assert r[2]["dt"] is None and r[2]["speed"] is None and r[2]["heading"] == 0 and r[3]["speed"] == 1


def test_missing_coordinates_and_short_tracks(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, float(i)) for i in range(5)] + [("b", 1.0, 1.0, 0.0), ("a", None, 1.0, 9.0)], "uid string, x double, y double, t double")
    got = kin.selected(rows, TrackConfig(min_spots=3, pixel_size=2.0, frame_interval=0.5))
    assert got.count() == 5 and got.agg(F.max("x"), F.max("t")).first()[:] == (2.0, 2.0)


def test_brownian_diffusion(spark):
    r = np.random.default_rng(0)
    xy = np.cumsum(r.normal(0, 1, (2, 20_000)), 1)
    d = met.diffusion(steps(spark, a=[(*p, i) for i, p in enumerate(xy.T)]), [1, 2, 4, 8, 16]).first()
    assert d["msd_alpha"] == pytest.approx(1, abs=0.05) and d["msd_D"] == pytest.approx(0.5, rel=0.1)


def test_spectrum_and_correlation():
    t = np.arange(200)
    f, share = ta.dominant(np.sin(2 * np.pi * t / 20), 10.0)
    assert f == pytest.approx(0.5) and share > 0.5
    assert ta.correlation_time(np.sin(2 * np.pi * t / 40), 1.0) == pytest.approx(7.6, abs=1)
    r = np.random.default_rng(1).normal(size=4000)
    assert ta.fluctuation(r) == pytest.approx(0.5, abs=0.1) and ta.fluctuation(np.cumsum(r)) == pytest.approx(1.5, abs=0.15)


def test_smoothing_keeps_parabolas():
    t = np.arange(30.0)
    assert np.allclose(ta.smoothed(3 + 2 * t - t**2, 7), 3 + 2 * t - t**2)


def test_morphology(spark):
    rows = spark.createDataFrame([("a", 10.0 + i, 4.0, 2.0, 170.0 if i % 2 else 10.0) for i in range(4)], "uid string, area double, major double, minor double, angle double")
    m = met.morphology(rows, CFG).first()
    assert m["avg_Area"] == 11.5 and m["aspect_ratio"] == 2 and abs(m["avg_AngleP"]) < 1e-9


def test_readers(spark, tmp_path):
    p = tmp_path / "spots_drug_high_rep2.csv"
    p.write_text("LABEL; TRACK_ID ;POSITION_X;POSITION_Y;FRAME;ID\nLabel;Track;X;Y;Frame;Id\n;;(um);(um);;\na;1;1.5;2;0;7\na;1;2.5;2;1;8\nb;2;x;2;1;9\n")
    s = tables.read_spots(spark, [str(p)])
    rows = s.orderBy("t").collect()
    assert [r["x"] for r in rows] == [1.5, 2.5] and rows[0]["uid"].startswith("drug_high|2|spots_drug_high_rep2|1")
    assert tables.guessed("tracks_control") == ("control", "1") and not tables.detected(["ID", "x", "y"]).complete
    with pytest.raises(ValueError):
        tables.spots(s, tables.detected(["x"]))
    tables.write_table(s, str(tmp_path / "out"), "csv", single=True)
    assert tables.read_table(spark, str(tmp_path / "out"), ",").count() == 2


def test_config_round_trip():
    c = Config()
    c.som.epochs = 7
    assert Config.from_json(c.to_json()[:-2] + ', "other": {"x": 1}}').som.epochs == 7


def test_synthetic_tracks(spark):
    w = synthetic.walks(spark, "wander", tracks=3, frames=50)
    assert w.count() == 150 and w.groupBy("track").count().count() == 3


def test_streaming_summary(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0, 2.0), ("2024-01-01 00:20:00", "a", 3.0, 2.0), ("2024-01-01 02:00:00", "b", 0.0, 0.0)], "ts string, uid string, x double, y double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = summary.windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["uid"], r["n_spots"], r["extent_x"]) for r in spark.table("windows").collect()) == [("a", 2, 2.0), ("b", 1, 0.0)]


@pytest.mark.parametrize(
    ("stem", "want"),
    [("tumor7", ("tumor7", "1")), ("spots_her2", ("her2", "1")), ("ctrl_3", ("ctrl", "3")), ("wt_batch_2", ("wt", "2")), ("spot_a-r04", ("a", "4")), ("a_rep 2", ("a", "2")), ("a 2", ("a 2", "1")), ("rep2", ("rep2", "1")), ("", ("1", "1"))],
)
def test_groups_in_names(stem, want):
    assert tables.guessed(stem) == want


def test_roles_of_columns():
    role = tables.detected(["Track ID", "X [µm]", "Position Y", "Timepoint", "est_z", "Length", "Width", "movie", "Cluster", "Std_Intensity_Ch2", "x"]).role
    assert role == {"track": "Track ID", "x": "X [µm]", "y": "Position Y", "t": "Timepoint", "z": "est_z", "major": "Length", "minor": "Width", "replicate": "movie", "group": "Cluster", "intensity_std": "Std_Intensity_Ch2"}
    assert tables.detected(["my_track_no"]).role == {"track": "my_track_no"} and tables.detected(["ID"]).role == {}


def test_lags_of_each_track(spark):
    """Tracks of several lengths: each is fitted over its own lags, and eleven rows are too few."""
    r = np.random.default_rng(5)
    tracks = {f"n{n}": [(x, y, i) for i, (x, y) in enumerate(np.cumsum(r.normal(size=(n, 2)), 0).tolist())] for n in (11, 12, 40, 300)}
    got = {x["uid"]: x for x in met.diffusion(steps(spark, **tracks)).collect()}
    assert set(got) <= {"n12", "n40", "n300"} and {"n40", "n300"} <= set(got)
    for uid, points in tracks.items():
        if uid not in got:
            continue
        p = np.array(points)[:, :2]
        lags = met.lags_of(len(p), 0.25)
        msd = [((p[g:] - p[:-g]) ** 2).sum(1).mean() for g in lags]
        slope, cut = np.polyfit(np.log(lags), np.log(msd), 1)
        assert got[uid]["msd_alpha"] == pytest.approx(slope) and got[uid]["msd_D"] == pytest.approx(math.exp(cut) / 4)


def test_every_metric_and_wanted_ones(spark):
    rows = [("a", float(i), 0.1 * i * (i % 3), float(i), 4.0, 2.0, 45.0, 3.0, 1.0, 10.0 + i % 5) for i in range(40)]
    spots = spark.createDataFrame(rows, "uid string, x double, y double, t double, major double, minor double, angle double, area double, intensity_mean double, intensity_std double")
    k = kin.kinematics(kin.selected(spots, CFG))
    t = met.everything(k, CFG, 1.0)
    assert t.columns == ["uid", *met.METRICS] and t.count() == 1 and len(met.METRICS) == len(set(met.METRICS)) == 77
    m = t.first()
    heading = np.arctan2(np.diff([x[2] for x in rows]), np.diff([x[1] for x in rows]))
    twice = 2 * (np.radians(45) - heading)
    drift = np.degrees(np.abs((twice + np.pi) % (2 * np.pi) - np.pi)) / 2
    assert m["avg_drift"] == pytest.approx(drift.mean()) and m["std_drift"] == pytest.approx(drift.std())
    z = np.array([i % 5 for i in range(40)]) / 4
    assert m["avg_estZ"] == pytest.approx(z.mean()) and m["std_estZ"] == pytest.approx(z.std())
    assert m["speed_bodylengths"] == pytest.approx(m["avg_velocity"] / 4) and m["reynolds"] == pytest.approx(997 * m["avg_velocity"] * 4e-12 / 8.9e-4)
    assert m["persistence_length"] is None or m["persistence_length"] == pytest.approx(m["dir_autocorr_time"] * m["avg_velocity"])
    assert met.everything(k, CFG, 1.0, ["reynolds", "straightness"]).columns == ["uid", "reynolds", "straightness"]
    bare = k.select("uid", *[c for c in k.columns if c not in ("uid", *met.SHAPE_FROM)])
    few = met.everything(bare, CFG, 1.0)
    assert not {"avg_Area", "reynolds"} & set(few.columns) and "strouhal" in few.columns
    assert met.available(few.withColumn("none", F.lit(None).cast("double")), ["none", "n_spots"]) == ["n_spots"]
    assert met.everything(k.limit(0), CFG, 1.0).count() == 0
    with pytest.raises(ValueError):
        met.everything(k, CFG, 1.0, ["no_such"])


def test_smoothing_of_tracks(spark):
    points = [("a", 3 + 2.0 * i - i * i, float(i % 2), float(i), "x") for i in range(30)] + [("b", 1.0, 2.0, 0.0, "x")]
    spots = spark.createDataFrame(points, "uid string, x double, y double, t double, other string").repartition(3)
    got = {(r["uid"], r["t"]): r for r in ta.smooth(spots, 7).collect()}
    assert all(got[u, t]["x"] == pytest.approx(x) and got[u, t]["other"] == "x" for u, x, _, t, _ in points)
    assert abs(got["a", 15.0]["y"] - 0.5) < 0.3 and got["b", 0.0]["y"] == 2 and ta.smooth(spots, 0) is spots


def test_turns_straight_on_and_back_have_the_signs_of_sql(spark, tmp_path):
    import duckdb
    import numpy as np
    from trackloom.plans import tracks

    r, n = np.random.default_rng(3), 40_000
    duck = duckdb.connect()
    rows = {"event_id": np.arange(n), "user_id": np.arange(n) // 100, "value": np.round(r.integers(0, 4, n) * 1.11, 2), "k": r.integers(0, 4, n)}
    import pandas as pd

    frame = pd.DataFrame(rows)  # noqa: F841
    duck.execute(f"""copy (select event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id * 7) as ts, user_id, 'view' as event_type, value, '{{"k": ' || k || '}}' as props from frame) to '{tmp_path}/events.parquet'""")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    for name in ("kin_turns", "metric_turn_entropy"):
        got, want = tracks.queries()[name](spark, str(tmp_path)).toPandas(), duck.execute(tracks.SQL[name]).df()
        got, want = (t[sorted(t.columns)].sort_values([c for c in ("uid", "i") if c in t.columns]).reset_index(drop=True) for t in (got, want))
        for c in got.columns:
            assert (np.abs(got[c].astype(float) - want[c].astype(float)) < 2e-3).all(), (name, c)
