"""Named blocks of the flat parameter vector."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Parameters:
    """Ordered blocks ``{name: (lower, upper, size)}``; their order is the order of theta. Immutable, hashable."""

    __slots__ = ("_names", "_lower", "_upper", "_sizes")

    def __init__(self, blocks: Mapping[str, tuple[float, float, int]] | Iterable[tuple[str, tuple[float, float, int]]]):
        items = list(blocks.items() if isinstance(blocks, Mapping) else blocks)
        names = [n for n, _ in items]
        if not items:
            raise ValueError("at least one parameter block is needed")
        if len(set(names)) < len(names):
            raise ValueError(f"block names repeat: {names}")
        for n, spec in items:
            if not isinstance(spec, tuple) or len(spec) != 3:
                raise ValueError(f"block {n!r} must be (lower, upper, size), not {spec!r}")
            lo, hi, k = spec
            if isinstance(k, bool) or not isinstance(k, (int, np.integer)) or k < 1:
                raise ValueError(f"size of block {n!r} must be a positive integer, not {k!r}")
            if not float(lo) <= float(hi):
                raise ValueError(f"block {n!r} has lower {lo} above upper {hi}")
        put = object.__setattr__
        put(self, "_names", tuple(names))
        put(self, "_sizes", tuple(int(s[2]) for _, s in items))
        put(self, "_lower", tuple(float(s[0]) for _, s in items))
        put(self, "_upper", tuple(float(s[1]) for _, s in items))

    def __setattr__(self, name, value):
        raise AttributeError("Parameters can't be changed")

    def __reduce__(self):
        return Parameters, (tuple((n, (lo, hi, k)) for n, lo, hi, k in zip(self._names, self._lower, self._upper, self._sizes, strict=True)),)

    def __eq__(self, other) -> bool:
        return isinstance(other, Parameters) and self.__reduce__() == other.__reduce__()

    def __hash__(self) -> int:
        return hash(self.__reduce__()[1])

    @property
    def names(self) -> tuple[str, ...]:
        return self._names

    @property
    def K(self) -> int:
        return sum(self._sizes)

    @property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of every coordinate."""
        return np.repeat(self._lower, self._sizes), np.repeat(self._upper, self._sizes)

    def block(self, name: str) -> slice:
        """Where a block lies in theta."""
        i = self._names.index(name) if name in self._names else -1
        if i < 0:
            raise KeyError(name)
        start = sum(self._sizes[:i])
        return slice(start, start + self._sizes[i])

    def pack(self, values: Mapping[str, object]) -> np.ndarray:
        """Theta of values by block; a number fills its whole block."""
        if set(values) != set(self._names):
            raise ValueError(f"blocks {sorted(values)} given, {sorted(self._names)} needed")
        out = np.empty(self.K)
        for n in self._names:
            v = np.asarray(values[n], float)
            if v.ndim and v.shape != out[self.block(n)].shape:
                raise ValueError(f"block {n!r} has shape {v.shape}")
            out[self.block(n)] = v
        return out

    def unpack(self, theta) -> dict[str, np.ndarray]:
        theta = np.asarray(theta, float)
        if theta.shape != (self.K,):
            raise ValueError(f"theta has shape {theta.shape}, not ({self.K},)")
        return {n: theta[self.block(n)].copy() for n in self._names}

    def named(self, theta: Column | str) -> Column:
        """A map of block name to its slice of a theta column."""
        parts = [F.slice(theta, self.block(n).start + 1, self.block(n).stop - self.block(n).start) for n in self._names]
        return F.map_from_arrays(F.array(*[F.lit(n) for n in self._names]), F.array(*parts))

    def table(self, spark: SparkSession) -> DataFrame:
        """block, pos, lower, upper: a row per coordinate."""
        rows = [(n, self.block(n).start + i, lo, hi) for n, lo, hi, k in zip(self._names, self._lower, self._upper, self._sizes, strict=True) for i in range(k)]
        return spark.createDataFrame(rows, "block string, pos int, lower double, upper double")
