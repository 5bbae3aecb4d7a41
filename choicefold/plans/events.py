"""Progress of fits and bootstraps: a log that becomes a DataFrame, and a table for the eye."""

from __future__ import annotations

import json
import sys
import time
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession


class EventLog:
    """Give ``log`` as ``on_event``: keeps every event with its time."""

    def __init__(self):
        self.events: list[dict] = []

    def __call__(self, event: dict) -> None:
        self.events.append({"at": time.time(), **event})

    def table(self, spark: SparkSession) -> DataFrame:
        """at, event, iteration, detail (JSON)."""
        rows = [(e["at"], e["event"], e.get("iteration"), json.dumps({k: v for k, v in e.items() if k not in ("at", "event", "iteration")})) for e in self.events]
        return spark.createDataFrame(rows, "at double, event string, iteration int, detail string")


class ProgressTable:
    """Give it as ``on_event``: a line for each iteration. ``level``: 0 nothing, 1 begin and end, 2 every iteration."""

    def __init__(self, level: int = 2, out: TextIO | None = None):
        self.level, self.out = level, out or sys.stderr

    def __call__(self, event: dict) -> None:
        kind = event["event"]
        if self.level >= 2 and kind == "iteration":
            print(f"{event['iteration']:>5} {event['gap']:>14.6e} {event['n_cuts']:>9} {event['objective']:>18.9f}", file=self.out)
        elif self.level >= 1 and kind != "iteration":
            print(" ".join(f"{k}={v}" for k, v in event.items()), file=self.out)
