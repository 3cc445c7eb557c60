"""Cross-validated discriminants under many draws of folds and labels, from moments, for rows of any number.

A draw gives every row a label and a fold. A block of rows deals its own share of all cells (label, fold) by hypergeometric
halving, so a draw is a uniform one over the whole table and is made anew in each pass instead of being stored. Three passes
serve DRAWS draws: sums and products by cell, the fourth moments of the shrinkage, and counts of true and predicted groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import Classification
from .ordination import array, dealt, packed, summed

#: Draws of a pass; one takes folds x features squared numbers, which reach the driver as sums.
DRAWS = 100


def accuracy(confusion: np.ndarray) -> float:
    """Balanced accuracy of counts by (true, predicted)."""
    n = confusion.sum(1)
    return float(np.mean(np.diag(confusion)[n > 0] / n[n > 0]))


class Draws:
    """Blocks of rows, and labels and folds of each draw over them. A draw is (seed, shuffled): true labels or dealt ones."""

    def __init__(self, rows: DataFrame, key: str, group: str, vector: str, k: int = 5):
        rows = rows.where(F.col(group).isNotNull())
        self.rows, self.sizes = packed(rows, key, group, vector)
        count = self.rows.select("block", F.explode("g").alias("g")).groupBy("block", "g").count().collect()
        self.groups = sorted({r["g"] for r in count}, key=lambda g: (len(g), g))
        self.per = np.zeros((len(self.groups), len(self.sizes)), np.int64)
        for r in count:
            self.per[self.groups.index(r["g"]), r["block"]] = r["count"]
        self.k, self.n, self.spark = k, int(self.per.sum()), rows.sparkSession

    def cells(self) -> Callable:
        """(block, its labels, (seed, shuffled)) to labels and folds of its rows."""
        per, sizes, k = self.per, np.array(self.sizes), self.k

        def counts(seed: int) -> np.ndarray:
            start = np.random.default_rng([seed, 1]).integers(k, size=len(per))
            whole = per.sum(1)
            return whole[:, None] // k + ((np.arange(k) - start[:, None]) % k < (whole % k)[:, None])

        def of(block: int, y: np.ndarray, draw: tuple[int, bool]) -> tuple[np.ndarray, np.ndarray]:
            seed, mixed = draw
            want, rng = counts(seed), np.random.default_rng([seed, 2, block])
            if mixed:
                cell = rng.permutation(np.repeat(np.arange(want.size), dealt(sizes, want.ravel(), block, seed)))
                return cell // k, cell % k
            fold = np.zeros(len(y), int)
            for g in np.unique(y):
                fold[y == g] = rng.permutation(np.repeat(np.arange(k), dealt(per[g], want[g], block, seed * len(per) + int(g))))
            return y, fold

        return of

    def over(self, draws: list[tuple[int, bool]], start: Callable, add: Callable) -> dict[int, np.ndarray]:
        """Sums over all blocks: add(total, draw's number, x, labels, folds, true labels) into start() of each draw."""
        groups, sizes, of = {g: i for i, g in enumerate(self.groups)}, self.sizes, self.cells()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for at, g, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    y, x = np.array([groups[c] for c in g]), array(x, sizes[at])
                    total = [start() for _ in draws] if total is None else total
                    for i, draw in enumerate(draws):
                        add(total[i], i, x, *of(at, y, draw), y, at)
            for i, w in enumerate(total or []):
                yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})

        few = self.rows.select("block", "g", "x").coalesce(32)
        return {r["at"]: np.frombuffer(r["w"], float) for r in summed(few.mapInArrow(run, "at int, w binary"), "at").collect()}

    def fitted(self, draws: list[tuple[int, bool]], scaled: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Weights (draw, fold, features, groups) and offsets of the models that did not see a fold. A group without training
        rows is never predicted."""
        one = self.rows.select(F.size("g").alias("n"), F.length("x").alias("bytes")).first()
        m, k, d = len(self.groups), self.k, one["bytes"] // 8 // one["n"]

        def moments(total: np.ndarray, i: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray, *_: object) -> None:
            cell = np.eye(m * k)[y * k + fold]
            total[: m * k * (d + 1)] += np.hstack([cell.sum(0)[:, None], cell.T @ x]).ravel()
            total[m * k * (d + 1) :] += np.stack([x[fold == f].T @ x[fold == f] for f in range(k)]).ravel()

        found, size = self.over(draws, lambda: np.zeros(m * k * (d + 1) + k * d * d), moments), m * k * (d + 1)
        n, means, scale, s = np.zeros((len(draws), k, m)), np.zeros((len(draws), k, m, d)), np.ones((len(draws), k, d)), np.zeros((len(draws), k, d, d))
        for i in range(len(draws)):
            cell, product = found[i][:size].reshape(m, k, d + 1), found[i][size:].reshape(k, d, d)
            rest, products = (cell.sum(1, keepdims=True) - cell).transpose(1, 0, 2), product.sum(0) - product
            n[i], means[i] = rest[..., 0], rest[..., 1:] / np.maximum(rest[..., :1], 1)
            for f in range(k):
                rows, mean = n[i, f].sum(), rest[f, :, 1:].sum(0) / max(n[i, f].sum(), 1)
                if scaled:
                    sd = np.sqrt(np.maximum(np.diag(products[f]) / max(rows, 1) - mean**2, 0))
                    scale[i, f] = np.where(sd > 1e-12 * np.maximum(np.abs(mean), 1e-300), sd, 1)
                s[i, f] = (products[f] - (means[i, f] * n[i, f][:, None]).T @ means[i, f]) / np.outer(scale[i, f], scale[i, f]) / max(rows, 1)

        def fourth(total: np.ndarray, i: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray, *_: object) -> None:
            for f in range(k):
                c = (x[fold != f] - means[i, f][y[fold != f]]) / scale[i, f]
                total[f] += ((c * c).sum(1) ** 2).sum()

        power = self.over(draws, lambda: np.zeros(k), fourth)
        weights, offsets = np.zeros((len(draws), k, d, m)), np.zeros((len(draws), k, m))
        for i in range(len(draws)):
            for f in range(k):
                rows, v = max(n[i, f].sum(), 1), s[i, f]
                mu = np.trace(v) / d
                delta = ((v - mu * np.eye(d)) ** 2).sum() / d
                beta = min(delta, (power[i][f] / rows - (v**2).sum()) / (d * rows))
                a = beta / delta if delta > 0 else 0.0
                z = means[i, f] / scale[i, f]
                w = np.linalg.pinv((1 - a) * v + a * mu * np.eye(d), hermitian=True) @ z.T
                with np.errstate(divide="ignore"):
                    weights[i, f], offsets[i, f] = w / scale[i, f][:, None], -0.5 * (z * w.T).sum(1) + np.log(n[i, f] / rows)
        return weights, offsets

    def confusions(self, draws: list[tuple[int, bool]]) -> np.ndarray:
        """Counts (draw, true, predicted), each row predicted by the model that did not see it; one more entry counts the
        predictions most frequent over the draws (the least of equals), against the rows' own labels."""
        (w, b), m = self.fitted(draws), len(self.groups)
        last, seen = len(draws) - 1, []

        def count(total: np.ndarray, i: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray, own: np.ndarray, *_: object) -> None:
            got = np.zeros(len(x), int)
            for f in np.unique(fold):
                got[fold == f] = (x[fold == f] @ w[i, f] + b[i, f]).argmax(1)
            total[: m * m] += np.bincount(y * m + got, minlength=m * m)
            if i == 0:
                seen.clear()
            seen.append(got)
            if i == last:
                modal = np.stack([(np.array(seen) == g).sum(0) for g in range(m)]).argmax(0)
                total[m * m :] += np.bincount(own * m + modal, minlength=m * m)

        got = self.over(draws, lambda: np.zeros(2 * m * m), count)
        return np.array([got[i][: m * m].reshape(m, m) for i in range(len(draws))] + [got[last][m * m :].reshape(m, m)])


def classify(rows: DataFrame, key: str, group: str, vector: str, k: int = 5, repeats: int = 5, permutations: int = 0, bootstrap: int = 1000, seed: int = 0) -> Classification:
    """As classify.classify with shrunk discriminants and without blocks; predictions stay with the rows."""
    tool = Draws(rows, key, group, vector, k)
    found = tool.confusions([(seed + r, False) for r in range(repeats)])
    modal, n = found[-1], tool.n
    score = float(np.mean([accuracy(c) for c in found[:-1]]))
    drawn = np.random.default_rng(seed).multinomial(n, modal.ravel() / n, bootstrap).reshape(bootstrap, *modal.shape)  # rows drawn again, by cell
    hit = float(np.trace(modal) / n)
    chance = float((modal.sum(1) / n) @ (modal.sum(0) / n))
    p = None
    if permutations:
        null = np.concatenate([[accuracy(c) for c in tool.confusions([(seed + repeats + i, True) for i in range(a, min(a + DRAWS, permutations))])[:-1]] for a in range(0, permutations, DRAWS)])
        p = float((1 + np.sum(null >= accuracy(found[0]) - 1e-12)) / (1 + permutations))
    return Classification("lda_shrinkage", score, *np.quantile([accuracy(c) for c in drawn], [0.025, 0.975]).tolist(), hit, (hit - chance) / (1 - chance) if chance < 1 else 0.0, 1 / len(tool.groups), p, np.zeros(0, int))


def importance(rows: DataFrame, key: str, group: str, vector: str, k: int = 5, repeats: int = 10, seed: int = 0) -> np.ndarray:
    """As classify.importance; a fold's values are permuted within its rows of a block of up to 500 rows."""
    tool = Draws(rows, key, group, vector, k)
    draw = [(seed, False)]
    (w, b), m = tool.fitted(draw, scaled=False), len(tool.groups)
    w, b = w[0], b[0]
    d = w.shape[1]

    def count(total: np.ndarray, i: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray, own: np.ndarray, block: int) -> None:
        hits = total.reshape(k, d + 1, 2, m)  # features, and the untouched rows last; hits and rows by group
        for f in np.unique(fold):
            z, g, rng = x[fold == f], y[fold == f], np.random.default_rng([seed, 3, block, int(f)])
            score, n = z @ w[f] + b[f], np.bincount(g, minlength=m)
            hits[f, d] += [np.bincount(g[score.argmax(1) == g], minlength=m), n]
            for j in range(d):
                for _ in range(repeats):
                    moved = score + (rng.permutation(z[:, j]) - z[:, j])[:, None] * w[f, j]
                    hits[f, j] += [np.bincount(g[moved.argmax(1) == g], minlength=m), n]

    hits = tool.over(draw, lambda: np.zeros(k * (d + 1) * 2 * m), count)[0].reshape(k, d + 1, 2, m)
    recall = np.where(hits[:, :, 1] > 0, hits[:, :, 0] / np.maximum(hits[:, :, 1], 1), np.nan)
    score = np.nanmean(recall[hits[:, d, 1].sum(1) > 0], axis=2)
    return (score[:, d :] - score[:, :d]).mean(0)
