"""Progress of a call, and a way to stop it.

``observed`` runs a block under a job group of its own; a thread asks Spark how
many tasks of the group's stages are done and tells a callback, which stops the
block by returning False.  A ``threading.Event`` stops it too.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .config import SettingError


class Cancelled(SettingError):
    """The observed call was stopped."""


@dataclass(frozen=True)
class Progress:
    """Tasks of the jobs started so far."""

    jobs: int
    tasks: int
    done: int


def progress(spark: SparkSession, group: str) -> Progress:
    tracker = spark.sparkContext.statusTracker()
    jobs = list(tracker.getJobIdsForGroup(group))
    stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    found = [info for s in stages if (info := tracker.getStageInfo(s))]
    return Progress(len(jobs), sum(s.numTasks for s in found), sum(s.numCompletedTasks for s in found))


@contextmanager
def observed(spark: SparkSession, callback: Callable[[Progress], object] | None = None, *, cancel: threading.Event | None = None, every: float = 0.2) -> Iterator[str]:
    """Run a block whose jobs are watched; raises ``Cancelled`` if it was stopped."""
    context, group = spark.sparkContext, f"observed-{uuid.uuid4().hex}"
    over, stopped = threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(every):
            asked = callback(progress(spark, group)) if callback else None
            if asked is False or (cancel is not None and cancel.is_set()):
                stopped.set()
            if stopped.is_set():  # again and again: jobs may start meanwhile
                context.cancelJobGroup(group)

    context.setJobGroup(group, "observed call", interruptOnCancel=True)
    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield group
    except Exception as error:
        if stopped.is_set():
            raise Cancelled("the call was stopped") from error
        raise
    finally:
        over.set()
        thread.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)  # type: ignore[arg-type]
    if stopped.is_set():
        raise Cancelled("the call was stopped")
    if callback:
        callback(progress(spark, group))
