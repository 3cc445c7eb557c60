"""Declared projection methods: what they are called with, which values suit how many rows, and which are worth scanning.

A method of one's own is added by register(); scans, the command line's list and layouts by name then know it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from typing import Any

import numpy as np

from . import projection as pr
from . import umap as um


@dataclass(frozen=True)
class Parameter:
    """A parameter. suggested and ceiling take the number of rows; scanned are the values of a scan."""

    name: str
    default: Any
    low: float | None = None
    high: float | None = None
    suggested: Callable[[int], Any] | None = None
    ceiling: Callable[[int], float] | None = None
    scanned: tuple = ()
    help: str = ""

    def value(self, n: int, given: Any = None) -> Any:
        """What is given, else what suits n rows, else the default."""
        return given if given is not None else self.suggested(n) if self.suggested else self.default

    def values(self, n: int) -> list:
        """The scanned values within what n rows bear, without those that become equal."""
        tops = [v for v in (self.high, self.ceiling(n) if self.ceiling else None) if v is not None]

        def within(v: Any) -> Any:
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                return v
            w = min([v, *tops])
            w = w if self.low is None else max(w, self.low)
            return int(w) if isinstance(self.default, int) else float(w)

        return list(dict.fromkeys(within(v) for v in self.scanned))


@dataclass(frozen=True)
class Method:
    """A projection: run(x, y, **parameters) gives two coordinates a row; y (group numbers or None) matters only where
    the method is supervised, and such a method says what its picture can't prove."""

    name: str
    run: Callable[..., np.ndarray]
    parameters: tuple[Parameter, ...] = ()
    supervised: bool = False
    caveat: str = ""
    least: int = 3

    def __post_init__(self) -> None:
        if self.supervised and not self.caveat:
            raise ValueError(f"{self.name} uses the groups and needs a caveat")

    def filled(self, n: int, given: dict | None = None) -> dict:
        """All parameters for n rows; a name that the method lacks raises."""
        given = given or {}
        if unknown := set(given) - {p.name for p in self.parameters}:
            raise ValueError(f"{self.name} has no {', '.join(sorted(unknown))}")
        return {p.name: p.value(n, given.get(p.name)) for p in self.parameters}

    def grid(self, n: int, chosen: dict[str, list] | None = None) -> list[dict]:
        """The cells of a scan: all combinations of the given values, else of those that the method declares."""
        chosen = chosen or {p.name: v for p in self.parameters if (v := p.values(n))}
        if not chosen:
            raise ValueError(f"{self.name} declares nothing to scan")
        self.filled(n, {k: v[0] for k, v in chosen.items()})
        return [dict(zip(chosen, values, strict=True)) for values in product(*chosen.values())]

    def unusable(self, n: int, groups: int) -> str:
        """Why the method can't run on n rows of so many groups; empty if it can."""
        if self.supervised and groups < 2:
            return f"{self.name} needs two groups"
        return f"{self.name} needs {self.least} rows, not {n}" if n < self.least else ""


_KNOWN: dict[str, Method] = {}


def register(method: Method, replace: bool = False) -> Method:
    if method.name in _KNOWN and not replace:
        raise ValueError(f"{method.name} is registered already")
    _KNOWN[method.name] = method
    return method


def get(name: str) -> Method:
    if name not in _KNOWN:
        raise KeyError(f"{name}; known are {', '.join(_KNOWN)}")
    return _KNOWN[name]


def known() -> list[str]:
    return list(_KNOWN)


def _neighbours(n: int) -> int:
    return int(np.clip(round(n**0.5), 5, min(30, max(2, n - 1))))


def _perplexity(n: int) -> float:
    return float(np.clip(round(n / 5), 5, min(30.0, max(2.0, (n - 1) / 3))))


GROUPS = "groups were used to make this layout, so their separation in it proves nothing"
register(Method("pca", lambda x, y: pr.pca(x)[0]))
register(Method("mds", lambda x, y: pr.mds(x)))
register(Method("smacof", lambda x, y, steps: pr.smacof(x, steps=steps)[0], (Parameter("steps", 200, 1, 5000, scanned=(50, 200, 500)),)))
register(Method("kpca", lambda x, y: pr.kernel_pca(x)))
register(Method("isomap", lambda x, y, neighbours: pr.isomap(x, neighbours), (Parameter("neighbours", 15, 2, 200, _neighbours, lambda n: max(2, n - 1), (5, 10, 15, 25, 40)),)))
register(Method("tsne", lambda x, y, perplexity, steps: pr.tsne(x, perplexity, steps=steps), (Parameter("perplexity", 15.0, 2, 200, _perplexity, lambda n: max(2.0, (n - 1) / 3), (5, 10, 15, 20, 30, 50)), Parameter("steps", 400, 50, 20000)), least=10))
register(Method("umap", lambda x, y, neighbours, min_dist, epochs: um.dense(x, neighbours, min_dist, epochs), (Parameter("neighbours", 15, 2, 200, _neighbours, lambda n: max(2, n - 1), (5, 10, 15, 25, 40)), Parameter("min_dist", 0.1, 0.0, 1.0, scanned=(0.0, 0.1, 0.25, 0.5)), Parameter("epochs", 200, 10, 5000)), least=10))
register(Method("lda", lambda x, y: pr.lda(x, y), supervised=True, caveat=GROUPS))
register(Method("plsda", lambda x, y: pr.plsda(x, y)[0], supervised=True, caveat=GROUPS))
