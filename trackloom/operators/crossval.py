"""Cross-validation as sums: fold plans as a table, and discriminants of every fold and every pair of groups from moments.

One pass gathers counts, sums and products by (repeat, fold, group); the training moments of a fold are the totals less its
own, so no fold reads rows again. A second pass gathers the fourth moments that the shrinkage needs, a third predicts each
row by the models that did not see it. What a pass returns is of the size of folds x groups x features squared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordination import configured, summed

#: Rows that are ranked together when folds are dealt.
TOGETHER = 100_000


def fold_plan(rows: DataFrame, key: str, group: str, replicate: str | None = None, scheme: str = "auto", k: int = 5, repeats: int = 5, seed: int = 0) -> tuple[DataFrame, str]:
    """((key, folds array<int>: one for each repeat), the scheme that was taken).

    auto: grouped where there are three replicates or more, else repeated_stratified, as are the schemes by replicates
    without them. stratified: rows of a group, in the order of md5 of seed, repeat and key, take folds in turn.
    leave_one_replicate_out: each replicate is a fold. grouped: replicates, the largest first, go to the fold whose shares
    of the groups they even out most. Folds are at most the rows of the smallest group, two at least. key is unique; rows
    whose key or group is null are left out, those of a null replicate share one.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(group).isNotNull()).select(F.col(key).alias("key"), F.col(group).cast("string").alias("g"), *([F.coalesce(F.col(replicate).cast("string"), F.lit("")).alias("r")] if replicate else []))
    counts = rows.groupBy(*rows.columns[1:]).agg(F.count("*").alias("n")).collect()
    per: dict[str, int] = defaultdict(int)
    for c in counts:
        per[c["g"]] += c["n"]
    k = max(2, min(k, min(per.values(), default=2)))
    blocks = sorted({c["r"] for c in counts}) if replicate else []
    scheme = ("grouped" if len(blocks) >= 3 else "repeated_stratified") if scheme == "auto" or scheme in ("grouped", "leave_one_replicate_out") and len(blocks) < 3 else scheme
    if scheme in ("grouped", "leave_one_replicate_out"):
        fold = {r: i for i, r in enumerate(blocks)} if scheme != "grouped" else grouped_folds([(c["r"], c["g"], c["n"]) for c in counts], max(2, min(k, len(blocks))))
        table = rows.sparkSession.createDataFrame([(r, [f]) for r, f in fold.items()], "r string, folds array<int>")
        return rows.join(table, "r").select("key", "folds"), scheme
    if scheme not in ("stratified", "repeated_stratified"):
        raise ValueError(f"scheme {scheme!r} is not known")
    digits = 0  # the first hexadecimal digits of a hash part the rows in the order of the hashes
    while 16**digits * TOGETHER < sum(per.values()):
        digits += 1
    times = repeats if scheme == "repeated_stratified" else 1
    rows = rows.withColumns({f"h{i}": F.md5(F.concat(F.lit(f"{seed}|{i}|"), F.col("key").cast("string"))) for i in range(times)})
    for i in range(times):
        rows = rows.withColumn("b", F.substring(f"h{i}", 1, digits))
        size = rows.groupBy(F.col("b").alias("sb"), F.col("g").alias("sg")).agg(F.count("*").alias("n"))
        before = size.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sg").orderBy("sb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        rank = F.row_number().over(Window.partitionBy("b", "g").orderBy(f"h{i}", "key"))
        rows = rows.withColumn("rank", rank).join(F.broadcast(before), (F.col("b") == F.col("sb")) & (F.col("g") == F.col("sg")))
        rows = rows.withColumn(f"h{i}", ((F.col("rank") - 1 + F.col("before")) % k).cast("int")).drop("b", "rank", "sb", "sg", "before")
    return rows.select("key", F.array(*[f"h{i}" for i in range(times)]).alias("folds")), scheme


def grouped_folds(counts: list[tuple[str, str, int]], k: int) -> dict[str, int]:
    """A fold for each replicate, from (replicate, group, rows)."""
    groups = sorted({g for _, g, _ in counts})
    of: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(groups)))
    for r, g, n in counts:
        of[r][groups.index(g)] += n
    total, load, out = sum(of.values()), np.zeros((k, len(groups))), {}
    for r in sorted(of, key=lambda r: (-of[r].std(), -of[r].sum(), r)):
        trial = [(float((np.r_[load[:f], [load[f] + of[r]], load[f + 1 :]] / total).std(0).mean()), float(load[f].sum()), f) for f in range(k)]
        out[r] = min(trial)[2]
        load[out[r]] += of[r]
    return out


class Discriminants:
    """Linear discriminants with a shrunk covariance of every problem (a set of groups), repeat and fold."""

    def __init__(self, rows: DataFrame, plan: DataFrame, key: str, group: str, vector: str):
        configured(rows.sparkSession)
        rows = rows.select(F.col(key).alias("key"), F.col(group).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
        self.rows = rows.join(plan, "key").select("g", "v", "folds").checkpoint()
        self.groups = [r["g"] for r in self.rows.select("g").distinct().orderBy("g").collect()]
        self._moments()

    def _moments(self) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, np.ndarray] = {}
            for g, x, folds in arrays(batches):
                z = np.c_[np.ones(len(x)), x]
                for name in set(g.tolist()):
                    for r in range(folds.shape[1]):
                        for f in np.unique(folds[g == name, r]).tolist():
                            part = z[(g == name) & (folds[:, r] == f)]
                            total[name, r, f] = total.get((name, r, f), 0) + part.T @ part
            yield pa.RecordBatch.from_pydict({"at": pa.array([f"{r}|{f}|{name}" for name, r, f in total], pa.string()), "w": pa.array([m.tobytes() for m in total.values()], pa.binary())})

        self.sums: dict[tuple[int, int, str], np.ndarray] = {}
        for row in summed(self.rows.mapInArrow(run, "at string, w binary"), "at").toLocalIterator():
            r, f, name = row["at"].split("|", 2)
            flat = np.frombuffer(row["w"], float)
            self.sums[int(r), int(f), name] = flat.reshape(int(np.sqrt(len(flat))), -1)
        self.folds = sorted({k[:2] for k in self.sums})

    def training(self, r: int, f: int, name: str) -> np.ndarray:
        """Moments of a group's rows out of a fold."""
        return sum((m for (a, b, g), m in self.sums.items() if a == r and b != f and g == name), np.zeros_like(next(iter(self.sums.values()))))

    def fitted(self, problems: list[tuple[str, ...]]) -> dict[tuple[int, int], list[tuple]]:
        """Of each (repeat, fold) and problem: (groups that were trained on, weights, offsets)."""
        parts: dict[tuple[int, int], list] = {}
        for r, f in self.folds:
            of = {g: self.training(r, f, g) for g in self.groups}
            parts[r, f] = []
            for problem in problems:
                there = [g for g in problem if of[g][0, 0] > 0]
                if not there:
                    parts[r, f].append(None)
                    continue
                n = np.array([of[g][0, 0] for g in there])
                means = np.stack([of[g][0, 1:] / of[g][0, 0] for g in there])
                mean = n @ means / n.sum()
                within = sum(of[g][1:, 1:] - of[g][0, 0] * np.outer(m, m) for g, m in zip(there, means, strict=True))
                scale = np.sqrt(np.maximum(sum(np.diag(of[g][1:, 1:]) for g in there) / n.sum() - mean**2, 0))
                scale = np.where(scale > 1e-12 * np.maximum(np.abs(mean), 1e-300), scale, 1)
                parts[r, f].append((there, n, means, mean, scale, within / np.outer(scale, scale) / n.sum()))
        fourth = self._fourth(parts, problems)
        out: dict[tuple[int, int], list[tuple]] = {}
        for at, models in parts.items():
            out[at] = []
            for p, model in enumerate(models):
                if model is None:
                    out[at].append(((), None, None))
                    continue
                there, n, means, mean, scale, s = model
                d, rows, mu = len(s), n.sum(), np.trace(s) / len(s)
                delta = ((s - mu * np.eye(d)) ** 2).sum() / d
                beta = min(delta, (fourth.get((*at, p), 0.0) / rows - (s**2).sum()) / (d * rows))
                a = beta / delta if delta > 0 else 0.0
                z = (means - mean) / scale
                w = np.linalg.pinv((1 - a) * s + a * mu * np.eye(d)) @ z.T
                out[at].append((tuple(there), w / scale[:, None], -0.5 * (z * w.T).sum(1) + np.log(n / rows) - (mean / scale) @ w))
        return out

    def _fourth(self, parts: dict, problems: list[tuple[str, ...]]) -> dict[tuple[int, int, int], float]:
        """Sums of the fourth powers of scaled distances to the training means, by (repeat, fold, problem)."""
        of_group = {g: [p for p, names in enumerate(problems) if g in names] for g in self.groups}
        held = {at: [None if m is None else ({g: c for g, c in zip(m[0], m[2], strict=True)}, 1 / m[4] ** 2) for m in models] for at, models in parts.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, float] = defaultdict(float)
            for g, x, folds in arrays(batches):
                for (r, f), models in held.items():
                    for name in set(g.tolist()):
                        pick = (g == name) & (folds[:, r] != f)
                        known = [p for p in of_group[name] if models[p] is not None and name in models[p][0]]
                        if pick.any() and known:
                            square = (x[pick] - models[known[0]][0][name]) ** 2 @ np.stack([models[p][1] for p in known], 1)
                            for p, s in zip(known, (square**2).sum(0).tolist(), strict=True):
                                total[r, f, p] += s
            rows = list(total)
            yield pa.RecordBatch.from_pydict({c: pa.array([k[i] for k in rows], pa.int32()) for i, c in enumerate("rfp")} | {"s": pa.array([total[k] for k in rows], pa.float64())})

        got = self.rows.mapInArrow(run, "r int, f int, p int, s double").groupBy("r", "f", "p").agg(F.sum("s").alias("s")).toLocalIterator()
        return {(x["r"], x["f"], x["p"]): x["s"] for x in got}

    def confusion(self, problems: list[tuple[str, ...]]) -> DataFrame:
        """(problem, repeat, y, predicted, n) of all rows, each predicted out of its fold. A fold whose training rows hold
        one group predicts it, one without training rows predicts null."""
        models = self.fitted(problems)
        of_group = {g: [p for p, names in enumerate(problems) if g in names] for g in self.groups}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, int] = defaultdict(int)
            for g, x, folds in arrays(batches):
                for (r, f), fits in models.items():
                    for name in set(g.tolist()):
                        pick = (g == name) & (folds[:, r] == f)
                        for p in of_group[name] if pick.any() else []:
                            there, w, b = fits[p]
                            if not there:
                                total[p, r, name, None] += int(pick.sum())
                                continue
                            at, n = np.unique((x[pick] @ w + b).argmax(1), return_counts=True)
                            for i, c in zip(at.tolist(), n.tolist(), strict=True):
                                total[p, r, name, there[i]] += c
            rows = list(total)
            yield pa.RecordBatch.from_pydict({"problem": pa.array([k[0] for k in rows], pa.int32()), "repeat": pa.array([k[1] for k in rows], pa.int32()), "y": pa.array([k[2] for k in rows], pa.string()), "predicted": pa.array([k[3] for k in rows], pa.string()), "n": pa.array([total[k] for k in rows], pa.int64())})

        return self.rows.mapInArrow(run, "problem int, repeat int, y string, predicted string, n long").groupBy("problem", "repeat", "y", "predicted").agg(F.sum("n").alias("n"))


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(groups, vectors, folds by repeat) of batches of (g, v, folds)."""
    for b in batches:
        if b.num_rows:
            yield np.array(b.column(0).to_pylist(), object), *(c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in b.columns[1:])


def recalls(confusion: DataFrame) -> DataFrame:
    """(problem, repeat, y, n, recall)."""
    hit = F.sum(F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0))
    return confusion.groupBy("problem", "repeat", "y").agg(F.sum("n").alias("n"), (hit / F.sum("n")).alias("recall"))


def recall_table(rows: DataFrame, key: str, group: str, vector: str, replicate: str | None = None, scheme: str = "auto", k: int = 5, repeats: int = 5, seed: int = 0) -> DataFrame:
    """(group, n, recall, balanced_accuracy, accuracy): recall of each group and overall figures of the classifier of all
    groups, means over repeats."""
    plan, _ = fold_plan(rows, key, group, replicate, scheme, k, repeats, seed)
    tool = Discriminants(rows, plan, key, group, vector)
    per = recalls(tool.confusion([tuple(tool.groups)])).groupBy(F.col("y").alias("group")).agg(F.max("n").alias("n"), F.avg("recall").alias("recall"))
    whole = per.agg(F.avg("recall").alias("balanced_accuracy"), (F.sum(F.col("recall") * F.col("n")) / F.sum("n")).alias("accuracy"))
    return per.crossJoin(F.broadcast(whole))  # one row


def pairwise_accuracy(rows: DataFrame, key: str, group: str, vector: str, replicate: str | None = None, scheme: str = "auto", k: int = 5, repeats: int = 5, seed: int = 0, least: int = 6) -> DataFrame:
    """(group_a, group_b, n_a, n_b, balanced_accuracy) of each pair of groups with `least` rows or more together; means over
    repeats. All pairs share the folds and the three passes."""
    plan, _ = fold_plan(rows, key, group, replicate, scheme, k, repeats, seed)
    tool = Discriminants(rows, plan, key, group, vector)
    pairs = list(combinations(tool.groups, 2))
    names = rows.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "p int, group_a string, group_b string")
    per = recalls(tool.confusion(pairs)).groupBy("problem", "y").agg(F.max("n").alias("n"), F.avg("recall").alias("recall"))
    both = names.join(per, F.col("p") == F.col("problem")).groupBy("p", "group_a", "group_b")
    n = lambda c: F.max(F.when(F.col("y") == F.col(c), F.col("n")))
    return both.agg(n("group_a").alias("n_a"), n("group_b").alias("n_b"), F.avg("recall").alias("balanced_accuracy")).where(F.col("n_a") + F.col("n_b") >= least).drop("p")
