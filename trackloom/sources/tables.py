"""Readers of detection and feature tables, and writers of results."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workbook

REQUIRED = ("track", "x", "y", "t")
OPTIONAL = ("z", "group", "replicate", "area", "major", "minor", "angle", "intensity_mean", "intensity_std", "diameter")
#: Names of columns in tracking exports, most specific first. Fixed values.
NAMES: dict[str, tuple[str, ...]] = {
    "track": ("track_id", "trackid", "track", "track_#", "id_track", "particle", "trajectory"),
    "x": ("position_x", "x", "centroid_x", "pos_x", "x_um", "x_px", "xm"),
    "y": ("position_y", "y", "centroid_y", "pos_y", "y_um", "y_px", "ym"),
    "t": ("position_t", "frame", "t", "time", "slice", "timepoint"),
    "z": ("position_z", "z", "est_z", "pos_z"),
    "group": ("group", "cluster", "treatment", "condition", "cond", "class"),
    "replicate": ("replicate", "subset", "rep", "batch", "movie", "well", "plate"),
    "area": ("area", "avg_area"),
    "major": ("ellipse_major", "major", "length", "major_axis"),
    "minor": ("ellipse_minor", "minor", "width", "minor_axis"),
    "angle": ("ellipse_theta", "ellipse_angle", "angle_p", "orientation", "angle", "theta"),
    "intensity_mean": ("mean_intensity_ch", "mean_intensity", "mean_intnsty", "mean", "intensity_mean"),
    "intensity_std": ("std_intensity_ch", "std_intensity", "stddev", "std_intnsty", "intensity_std"),
    "diameter": ("estimated_diameter", "radius", "diameter"),
}


@dataclass
class SpotColumns:
    """Which source column plays which role."""

    role: dict[str, str] = field(default_factory=dict)

    @property
    def complete(self) -> bool:
        return all(r in self.role for r in REQUIRED)


def detected(columns: list[str]) -> SpotColumns:
    """Roles of columns by their names, in any case; spaces, underscores, units in brackets and a channel's number don't
    count. The first name of a role that a column has decides, and of two such columns the first. Where no column has a
    track's name, the first that begins with track is the track, else the first with track in it; a bare id is none. x and y may go on with letters, as in
    x_coord, which counts before other names than position_x and x."""

    def plain(name: str) -> str:
        name = re.sub(r"[\s_]*\[[^\]]*\]$", "", name.strip().lower())
        return re.sub(r"(?<=ch)[0-9]$", "", re.sub(r"[\s_]+", "", name))

    known = {plain(c): c for c in reversed(columns)}
    role = {role: known[n] for role, names in NAMES.items() for n in [plain(n) for n in names[::-1]] if n in known}
    if "track" not in role and (c := min((c for c in columns if "track" in c.lower()), key=lambda c: not c.strip().lower().startswith("track"), default=None)):
        role["track"] = c
    for axis in ("x", "y"):
        lettered = (c for c in columns if re.fullmatch(rf"{axis}[\s_]?\[?[a-zµ]*\]?", c.strip().lower()))
        if plain(role.get(axis, "")) not in (axis, f"position{axis}") and (c := next(lettered, None)):
            role[axis] = c
    return SpotColumns(role)


def guessed(stem: str) -> tuple[str, str]:
    """Group and replicate in a file's name: spots_drug_high_rep2 is drug_high and 2, ctrl_3 is ctrl and 3; 1 where
    nothing is said. A number counts only after a separator: tumor7 is a group."""
    body = re.sub(r"^(spots?|tracks?|features)_", "", stem, flags=re.IGNORECASE)
    words = re.split(r"([\s_-]+)", body)  # words and what stands between them
    number = re.fullmatch(r"(rep|replicate|r|batch)?([0-9]+)", words[-1], re.IGNORECASE)
    named = len(words) > 4 and words[-3].lower() in ("rep", "replicate", "r", "batch")
    if len(words) < 3 or not number or not (number[1] or named or words[-2].strip()):
        return body or "1", "1"
    return "".join(words[: -4 if named and not number[1] else -2]) or "1", str(int(number[2]))


def sniffed(line: str) -> str:
    try:
        return csv.Sniffer().sniff(line, ",;\t|").delimiter
    except csv.Error:
        return ","


def read_table(spark: SparkSession, path: str, separator: str | None = None, sheet: str | int = 0) -> DataFrame:
    """A delimited, Parquet, JSON or ORC table or a workbook's sheet, with stripped names; what looks like further header rows goes."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "json", "orc"):
        return spark.read.format(kind).load(path)
    if kind in workbook.KINDS:
        return typed(without_headers(workbook.read_sheet(spark, path, sheet)))
    if kind in ("xls", "xlsb", "ods"):
        raise ValueError(f"{path}: save it as xlsx; {kind} is not read")
    if separator is None:
        first = spark.read.text(path).limit(1).collect()
        separator = "\t" if kind in ("tsv", "txt") else sniffed(first[0][0] if first else "")
    t = spark.read.csv(path, header=True, sep=separator)
    t = t.toDF(*[c.strip() for c in t.columns])
    return typed(without_headers(t))


def without_headers(t: DataFrame) -> DataFrame:
    """t (strings) without rows that repeat units or names: where most rows are numbers, those with hardly any."""
    numeric = sum((F.when(F.col(f"`{c}`").try_cast("double").isNotNull(), 1).otherwise(0) for c in t.columns), F.lit(0))
    few = max(1, len(t.columns) // 5)
    counted = t.withColumn("_numeric", numeric)
    share = counted.agg(F.avg((F.col("_numeric") > few).cast("double"))).first()[0]
    return counted.where(F.col("_numeric") > few).drop("_numeric") if share and share > 0.5 and share < 1 else t


def typed(t: DataFrame, share: float = 0.9) -> DataFrame:
    """String columns as doubles where at least that share of their values are numbers."""
    texts = [c for c, k in t.dtypes if k == "string"]
    if not texts:
        return t
    row = t.agg(*[F.try_divide(F.count(F.col(f"`{c}`").try_cast("double")), F.count(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(texts)]).first()
    good = [c for i, c in enumerate(texts) if row[f"c{i}"] is not None and row[f"c{i}"] >= share]
    return t.select(*[F.col(f"`{c}`").try_cast("double").alias(c) if c in good else F.col(f"`{c}`") for c in t.columns])


def spots(table: DataFrame, columns: SpotColumns, source: str = "", group: str = "1", replicate: str = "1") -> DataFrame:
    """The canonical table of detections: uid, group, replicate, source, track, x, y, t and the optional columns that are
    there. The table's own group and replicate come before the given ones; rows without x, y or t go."""
    if not columns.complete:
        raise ValueError(f"columns for {', '.join(r for r in REQUIRED if r not in columns.role)} are missing")
    col = lambda role: F.col(f"`{columns.role[role]}`")
    own = {k: F.coalesce(col(k).cast("string"), F.lit(v)) if k in columns.role else F.lit(v) for k, v in (("group", group), ("replicate", replicate))}
    numbers = {r: col(r).try_cast("double") for r in ("x", "y", "t", *OPTIONAL) if r in columns.role and r not in own}
    out = table.select(*[c.alias(k) for k, c in own.items()], F.lit(source).alias("source"), col("track").cast("string").alias("track"), *[F.when(~F.isnan(c), c).alias(k) for k, c in numbers.items()])
    return out.dropna(subset=["x", "y", "t"]).withColumn("uid", F.concat_ws("|", "group", "replicate", "source", "track"))


def read_spots(spark: SparkSession, paths: list[str], sheet: str | int = 0) -> DataFrame:
    """Files of detections as one table; group and replicate from each file's name unless its columns say them."""
    out = None
    for path in paths:
        stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        t = read_table(spark, path, sheet=sheet)
        one = spots(t, detected(t.columns), stem, *guessed(stem))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def numeric_columns(table: DataFrame) -> list[str]:
    """Columns of numbers of any type, truth values among them."""
    return [c for c, k in table.dtypes if k in ("double", "float", "tinyint", "smallint", "int", "bigint", "boolean") or k.startswith("decimal")]


def features(table: DataFrame, names: list[str], sample: str | None = None, group: str | None = None, replicate: str | None = None) -> DataFrame:
    """A table of samples that are measured already: sample, group, replicate and the named features as doubles."""
    ident = F.col(sample).cast("string") if sample else F.format_string("S%04d", F.monotonically_increasing_id() + 1)
    return table.select(ident.alias("sample"), *[(F.col(c).cast("string") if c else F.lit("1")).alias(k) for k, c in (("group", group), ("replicate", replicate))], *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names])


def write_table(df: DataFrame, path: str, kind: str = "parquet", single: bool = False) -> None:
    """One file if single, for tables that are small by nature; else one a partition."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.format(kind).save(path)
