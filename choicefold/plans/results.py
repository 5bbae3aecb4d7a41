"""Results of estimation, on the driver and as DataFrames."""

from __future__ import annotations

import dataclasses
import json
import math
import platform
import resource
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import IntEnum, IntFlag

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.layout import Parameters
from .master import CutRow


class RunInfoLevel(IntEnum):
    OFF = 0
    DEFAULT = 1
    META = 2
    FULL = 3


class Publication(IntFlag):
    """What a fit returns beside the estimate."""

    SUMMARY = 0
    SLACK = 1
    ACTIVE_SET = 2
    DUAL = 4
    FULL = 7
    #: Cuts with duals and slacks as a DataFrame, which needs no driver memory.
    TABLE = 8


@dataclass(frozen=True)
class Certification:
    """How exactly agents were priced, over all calls."""

    n_priced: int = 0
    n_inexact: int = 0
    worst_gap: float = 0.0

    def __post_init__(self):
        if not 0 <= self.n_inexact <= self.n_priced or math.isnan(self.worst_gap) or (self.n_inexact == 0) != (self.worst_gap == 0):
            raise ValueError("certification counts contradict each other")

    def plus(self, other: Certification) -> Certification:
        return Certification(self.n_priced + other.n_priced, self.n_inexact + other.n_inexact, max(self.worst_gap, other.worst_gap))

    def to_dict(self) -> dict:
        unknown = math.isinf(self.worst_gap)
        return {"n_priced": self.n_priced, "n_inexact": self.n_inexact, "worst_gap": None if unknown else self.worst_gap, "worst_gap_unknown": unknown}


@dataclass(frozen=True)
class RunInfo:
    seconds: float
    python: str
    spark: str
    master: str
    peak_mb: float

    @classmethod
    def of(cls, spark: SparkSession, began: float) -> RunInfo:
        kb = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        return cls(time.perf_counter() - began, platform.python_version(), spark.version, spark.sparkContext.master, kb / (1024 if platform.system() == "Linux" else 1 << 20))


@dataclass(frozen=True)
class FitResult:
    theta_hat: np.ndarray
    objective: float
    empirical_moment: np.ndarray
    converged: bool
    iterations: int
    n_active_cuts: int
    parameters: Parameters
    certification: Certification
    slack: dict[int, float] | None = None
    cuts: list[CutRow] | None = None
    cut_duals: dict[tuple[int, bytes], float] | None = None
    bound_duals: dict[int, float] = field(default_factory=dict)
    run_info: RunInfo | None = None
    trace: list[dict] = field(default_factory=list)
    #: agent_id, bundle_key, phi, epsilon, pi, slack; readable until :meth:`close`.
    cut_table: DataFrame | None = None
    _close: Callable[[], None] | None = field(default=None, repr=False, compare=False)

    def close(self) -> None:
        """Frees the files behind ``cut_table``."""
        if self._close is not None:
            self._close()

    @property
    def theta_named(self) -> dict[str, np.ndarray]:
        return self.parameters.unpack(self.theta_hat)

    @property
    def empirical_moment_named(self) -> dict[str, np.ndarray]:
        return self.parameters.unpack(self.empirical_moment)

    def to_dict(self) -> dict:
        """JSON-ready estimate."""
        return {
            "theta_hat": self.theta_hat.tolist(), "objective": self.objective, "empirical_moment": self.empirical_moment.tolist(), "converged": self.converged, "iterations": self.iterations,
            "n_active_cuts": self.n_active_cuts, "certification": self.certification.to_dict(), "run_info": dataclasses.asdict(self.run_info) if self.run_info else None,
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    def to_df(self, spark: SparkSession) -> DataFrame:
        row = (self.theta_hat.tolist(), float(self.objective), bool(self.converged), int(self.iterations), int(self.n_active_cuts))
        return spark.createDataFrame([row], "theta array<double>, objective double, converged boolean, iterations int, n_active_cuts int")

    def slack_summary(self) -> dict:
        if self.slack is None:
            raise ValueError("slack was not published")
        v = np.array(list(self.slack.values()) or [0.0])
        return {"total": float(v.sum()), "mean": float(v.mean()), "max": float(v.max()), "n_zero": int((v == 0).sum()) if self.slack else 0}

    def duals_df(self, spark: SparkSession, rep_id: int = 0) -> DataFrame:
        """rep_id, agent_id, bundle_key, pi of cuts with a dual above zero."""
        rows = [(rep_id, a, bytearray(k), float(p)) for (a, k), p in (self.cut_duals or {}).items() if p > 0]
        return spark.createDataFrame(rows, "rep_id int, agent_id bigint, bundle_key binary, pi double")


@dataclass(frozen=True)
class BootstrapResult:
    thetas: np.ndarray
    converged: np.ndarray
    parameters: Parameters
    point: np.ndarray | None = None
    certification: Certification = Certification()
    iterations: np.ndarray | None = None
    fits: list[FitResult] | None = None

    @property
    def n_converged(self) -> int:
        return int(self.converged.sum())

    def _used(self, converged_only: bool, least: int = 1) -> np.ndarray:
        """Replications of a summary, which needs ``least`` of them."""
        used = self.thetas
        if converged_only and not self.converged.all():
            warnings.warn(f"{int((~self.converged).sum())} replications did not converge and are left out", stacklevel=3)
            used = self.thetas[self.converged]
        if len(used) < least:
            raise ValueError(f"{len(used)} replications can be used, {least} are needed")
        return used

    def mean(self, converged_only: bool = True) -> np.ndarray:
        return self._used(converged_only).mean(0)

    def se(self, converged_only: bool = True) -> np.ndarray:
        return self._used(converged_only, 2).std(0, ddof=1)

    def cov(self, converged_only: bool = True) -> np.ndarray:
        return np.cov(self._used(converged_only, 2), rowvar=False, ddof=1).reshape(self.thetas.shape[1], -1)

    def ci(self, level: float = 0.95, converged_only: bool = True) -> tuple[np.ndarray, np.ndarray]:
        if not 0 < level < 1:
            raise ValueError("level must be in (0, 1)")
        lo, hi = np.percentile(self._used(converged_only), [50 * (1 - level), 50 * (1 + level)], axis=0)
        return lo, hi

    @property
    def se_named(self) -> dict[str, np.ndarray]:
        return self.parameters.unpack(self.se())

    def ci_named(self, level: float = 0.95) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        lo, hi = (self.parameters.unpack(v) for v in self.ci(level))
        return {n: (lo[n], hi[n]) for n in self.parameters.names}

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, bool(c), t.tolist()) for i, (t, c) in enumerate(zip(self.thetas, self.converged, strict=True))]
        return spark.createDataFrame(rows, "rep_id int, converged boolean, theta array<double>")

    @classmethod
    def concat(cls, results: list[BootstrapResult]) -> BootstrapResult:
        """Replications of several runs over one layout and point estimate."""
        if not results:
            raise ValueError("nothing to join")
        a = results[0]
        for r in results[1:]:
            same = (a.point is None and r.point is None) or (a.point is not None and r.point is not None and np.array_equal(a.point, r.point))
            if r.parameters != a.parameters or not same or (a.fits is None) != (r.fits is None):
                raise ValueError("runs differ in layout, point estimate or what they hold")
        cert = a.certification
        for r in results[1:]:
            cert = cert.plus(r.certification)
        fits = [f for r in results for f in r.fits] if a.fits is not None else None
        return cls(np.vstack([r.thetas for r in results]), np.concatenate([r.converged for r in results]), a.parameters, a.point, cert, None, fits)
