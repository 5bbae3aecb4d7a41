"""Refits over an outer parameter: one master is kept, and only the constants of its cuts are rewritten."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from .fit import NSLACK, Data, LoopConfig, Model, Problem, run_fit
from .master import CutRow, Master
from .results import FitResult


class PersistentFit:
    """``rhs(row, psi)`` is a cut's epsilon at the outer parameter psi; ``data(psi)`` the data there. Weights, objective and box must stay as they are.

    ``geometry(psi)`` describes what cuts' phi depend on, in a value or an array; where it differs from that of the first fit, the kept
    cuts would be wrong, and a refit is an error before anything changes.
    """

    def __init__(self, model: Model, data: Callable[[object], Data], rhs: Callable[[CutRow, object], float], geometry: Callable[[object], object] | None = None, **controls):
        if model.formulation != NSLACK:
            raise ValueError("only cuts by agent can be rewritten")
        self.geometry, self.described = geometry, None
        self.model, self.data, self.rhs, self.config = model, data, rhs, LoopConfig(**controls)
        self.master: Master | None = None
        self.c: np.ndarray | None = None

    def _check(self, psi: object) -> None:
        if self.geometry is not None and self.master is not None and not np.array_equal(self.geometry(psi), self.described):
            raise ValueError("the geometry of the cuts changed between refits")

    def fit(self, psi: object, warm_cuts: Iterable[CutRow] = ()) -> FitResult:
        self._check(psi)
        p = Problem(self.model, self.data(psi))
        try:
            if self.c is not None and (self.c.tobytes() != p.c.tobytes() or self.shape != (p.n, p.S)):
                raise ValueError("objective or shape of the data changed between refits")
            if self.master is not None:
                self.master.set_rhs({r.key: float(self.rhs(r, psi)) for r in self.master.extract_cuts()})
            self.c, self.shape = p.c, (p.n, p.S)
            first = self.master is None
            result, self.master = run_fit(p, self.config, list(warm_cuts), self.master)
            if first and self.geometry is not None:
                self.described = self.geometry(psi)
            return result
        finally:
            p.close()

    def reevaluate(self, psi: object) -> float:
        """Objective at psi over the cuts there are, without pricing anew."""
        if self.master is None:
            raise ValueError("nothing was fitted yet")
        self._check(psi)
        self.master.set_rhs({r.key: float(self.rhs(r, psi)) for r in self.master.extract_cuts()})
        return self.master.objective()

    def close(self) -> None:
        self.master = None
