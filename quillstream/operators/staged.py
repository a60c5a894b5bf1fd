"""Analyses in stages that can be watched and stopped: rows and seconds of each stage, and one run cancelled among others."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

Stage = Callable[[dict[str, DataFrame]], DataFrame]


class Cancelled(Exception):
    """The run was cancelled before its end."""


@dataclass(frozen=True)
class Progress:
    """A stage that ended: its number from 1 of `of`, the rows that it made and the seconds that it took."""

    stage: str
    number: int
    of: int
    rows: int
    seconds: float


class Run:
    """A run of named stages. Each stage gets the frames of those before it by name; its own is kept in the checkpoint folder.

    The rows of a stage are counted while it is written, by an observed metric, so that watching costs no further pass. All
    jobs of a run carry its tag: cancel() stops them, and no later stage begins, while other runs of the session go on.
    """

    def __init__(self, spark: SparkSession, stages: dict[str, Stage], watch: Callable[[Progress], None] = lambda _: None) -> None:
        self.spark, self.stages, self.watch = spark, stages, watch
        self.tag = f"quillstream-{uuid.uuid4().hex}"
        self.done: list[Progress] = []
        self.frames: dict[str, DataFrame] = {}
        self._stop = threading.Event()

    def cancel(self) -> None:
        """Stops the run, from any thread. A run that has ended stays as it is."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self) -> dict[str, DataFrame]:
        """The frames of all stages. An error of a stage is raised as it is, a cancelled run raises Cancelled."""
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            for number, (name, stage) in enumerate(self.stages.items(), 1):
                if self._stop.is_set():
                    raise Cancelled(name)
                began, seen = time.monotonic(), Observation(f"{self.tag}-{number}")
                try:
                    frame = cut(stage(dict(self.frames)).observe(seen, F.count(F.lit(1)).alias("rows")))
                except Exception as error:
                    if self._stop.is_set():
                        raise Cancelled(name) from error
                    raise
                self.frames[name] = frame
                step = Progress(name, number, len(self.stages), int(seen.get["rows"]), time.monotonic() - began)
                self.done.append(step)
                self.watch(step)
            return self.frames
        finally:
            context.removeJobTag(self.tag)

    def table(self) -> DataFrame:
        """(number, stage, rows) of the stages that have ended."""
        rows = [(p.number, p.stage, p.rows) for p in self.done]
        return self.spark.createDataFrame(rows, "number long, stage string, rows long")
