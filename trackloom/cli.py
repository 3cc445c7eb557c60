"""python -m trackloom.cli run FILES -o OUT [--config JSON] [--features-table] [--metrics NAMES] [--sheet NAME]
| scan TABLE -o OUT --method NAME [--grid NAME=V,V ...] [--criterion NAME] | sheets FILE | metrics | methods"""

from __future__ import annotations

import argparse
import glob
import itertools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .analysis import analyse, report
from .config import Config
from .operators import kinematics as kin
from .operators import metrics as met
from .operators import prepare as prep
from .operators import projection as pr
from .operators import registry, scan
from .operators import track_arrays
from .sources import tables, workbook


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trackloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("files", nargs="+")
    run.add_argument("-o", "--out", required=True)
    run.add_argument("--config")
    run.add_argument("--features-table", action="store_true")
    run.add_argument("--metrics", help="names, with commas between them; all if not given")
    run.add_argument("--sheet", default="0", help="of workbooks: its name, or its place from 0")
    each = sub.add_parser("scan")
    each.add_argument("table")
    each.add_argument("-o", "--out", required=True)
    each.add_argument("--method", required=True, help="a projection, or som")
    each.add_argument("--grid", nargs="*", default=[], help="values to try, as perplexity=5,10,30; by default the method's own")
    each.add_argument("--criterion")
    each.add_argument("--sheet", default="0")
    sub.add_parser("sheets").add_argument("file")
    sub.add_parser("metrics")
    sub.add_parser("methods")
    args = parser.parse_args(argv)
    if args.command in ("metrics", "methods"):
        print("\n".join(met.METRICS if args.command == "metrics" else [*registry.known(), *(m for m in pr.ELSEWHERE if m not in registry.known())]))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "sheets":
        for r in workbook.sheets(spark, args.file).orderBy("path", "position").toLocalIterator():
            print(r["sheet"])
        return 0
    sheet = int(args.sheet) if args.sheet.isdecimal() else args.sheet
    if args.command == "scan":
        return scanned(feature_table(spark, args.table, sheet), args.method, dict(valued(g) for g in args.grid), args.criterion, args.out)
    cfg = Config()
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            cfg = Config.from_json(f.read())
    paths = sorted({p for pattern in args.files for p in (glob.glob(pattern) or [pattern])})
    if args.features_table:
        table, names = feature_table(spark, paths[0], sheet)
    else:
        table, names = features_of(tables.read_spots(spark, paths, sheet), cfg, f"{args.out}/tables/features", [m.strip() for m in args.metrics.split(",")] if args.metrics else None)
    result = analyse(table, names, cfg)
    for name, t in result.tables.items():
        tables.write_table(t, f"{args.out}/tables/{name}")
    spark.createDataFrame([(report(result),)], "text string").coalesce(1).write.mode("overwrite").text(f"{args.out}/report")
    spark.createDataFrame([(cfg.to_json(),)], "text string").coalesce(1).write.mode("overwrite").text(f"{args.out}/config")
    return 0


def feature_table(spark: SparkSession, path: str, sheet: str | int = 0):
    """A table of measured samples and the names of its features; columns that are left out are told."""
    t = tables.read_table(spark, path, sheet=sheet)
    role = {c.lower(): c for c in t.columns}
    roles = {role[k] for k in ("group", "replicate", "sample") if k in role}
    names = [c for c in tables.numeric_columns(t) if c not in roles]
    if left := [c for c in t.columns if c not in names and c not in roles]:
        print(f"left out, no numbers: {', '.join(left)}")
    return tables.features(t, names, role.get("sample"), role.get("group"), role.get("replicate")), names


def valued(text: str) -> tuple[str, list]:
    """perplexity=5,10 as the name and its values: whole numbers, numbers or words."""

    def value(v: str):
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    name, _, values = text.partition("=")
    if not values:
        raise ValueError(f"{text!r}: NAME=VALUE,VALUE is needed")
    return name, [value(v) for v in values.split(",")]


def scanned(table_and_names, method: str, chosen: dict[str, list], criterion: str | None, out: str) -> int:
    """Scans a method over the scaled, complete rows of a feature table; writes the scores and every layout."""
    t, names = table_and_names
    t = prep.scaled(prep.imputed(t, names), names).withColumn("features", F.array(*names))
    if method == "som":
        chosen = chosen or {"width": [4, 6, 8], "height": [3, 4, 5]}
        grid = [dict(zip(chosen, v, strict=True)) for v in itertools.product(*chosen.values())]
        result, cells = scan.map_scan(t, "features", grid, criterion=criterion or "quantisation_error")
        layouts = scan.placed(t, "sample", "features", cells)
    else:
        result, layouts = scan.layout_scan(t, "sample", "features", "group", method, chosen or None, criterion or "rnx_auc")
    tables.write_table(result, f"{out}/scan")
    tables.write_table(layouts, f"{out}/layouts")
    return 0


def features_of(spots, cfg: Config, path: str, wanted: list[str] | None = None):
    """Metrics of each track as a feature table, written to path and read again, since all that follows reads it many
    times; and the names of those that some track has. The speeds of all tracks, short ones too and before smoothing,
    decide what a halt is."""
    chosen = kin.selected(spots, cfg.track)
    k = kin.kinematics(track_arrays.smooth(chosen, cfg.track.smoothing_window))
    threshold = kin.halt_threshold(kin.kinematics(kin.canonical(spots, cfg.track))).first()[0] if cfg.track.auto_halt else cfg.track.halt_threshold_px * cfg.track.pixel_size / max(cfg.track.frame_interval, 1e-9)
    t = met.everything(k, cfg.track, threshold, wanted)
    names = [c for c in t.columns if c != "uid"]
    who = chosen.groupBy(F.col("uid").alias("u")).agg(F.min("group").alias("group"), F.min("replicate").alias("replicate"))
    tables.write_table(t.join(who, F.col("uid") == F.col("u")).select(F.col("uid").alias("sample"), "group", "replicate", *[F.col(c).cast("double").alias(c) for c in names]), path)
    t = spots.sparkSession.read.parquet(path)
    return t, met.available(t, names)


if __name__ == "__main__":
    raise SystemExit(main())
