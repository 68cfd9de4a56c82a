"""Named stages, each written to its own folder: switches, settings, skipping, repeats, time limits, a graph of needs.

A stage whose table is complete is read, not run again, so a run that broke off goes on where it stopped.
Stages that don't need each other can run at once, each in a scheduler pool of its own name.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextvars import copy_context
from dataclasses import dataclass
from string import Template

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from .storage import complete


class StageTimeout(RuntimeError):
    """A stage ran longer than it may; its jobs were cancelled."""


@dataclass(frozen=True)
class Stage:
    """make(spark, settings, tables so far by stage) gives the stage's table.

    attempts: how often it is made while it comes out empty or fails; seconds: the limit of one attempt.
    needs: the stages that come before it, whose tables it sees; all that stand before it if not given.
    """

    name: str
    make: Callable[[SparkSession, Mapping[str, str], Mapping[str, DataFrame]], DataFrame]
    on: bool = True
    attempts: int = 1
    seconds: float | None = None
    needs: Collection[str] | None = None


def filled(settings: Mapping[str, str]) -> dict[str, str]:
    """Settings with ${name} in their values replaced by other settings; an unknown name is an error."""
    out = dict(settings)
    for _ in out:
        out = {k: Template(v).substitute(out) for k, v in out.items()}
    open_ = [k for k, v in out.items() if "${" in v]
    if open_:
        raise ValueError(f"settings that name each other in a ring: {open_}")
    return out


def run_stages(
    spark: SparkSession, stages: Sequence[Stage], root: str, settings: Mapping[str, str] | None = None, only: Collection[str] | None = None, at_once: int = 1
) -> dict[str, DataFrame]:
    """Tables of the stages by name. `only` names the stages to run, in place of their own switches.

    A stage that is switched off is left out unless its table is complete from an earlier run. Up to `at_once`
    stages run together, in their order, each as soon as all that it needs have ended. If one fails, those
    that need it, directly or not, are left out; the others are run to their end, and then the error is raised.
    """
    names = [s.name for s in stages]
    unknown = set(only or ()) - set(names)
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")
    needs = {s.name: set(names[:i] if s.needs is None else s.needs) for i, s in enumerate(stages)}
    late = sorted(f"{s} needs {n}" for i, s in enumerate(names) for n in needs[s] - set(names[:i]))
    if late:
        raise ValueError(f"stages that are needed before they stand: {late}")
    values, tables, failed = filled(settings or {}), {}, {}
    ended: set[str] = set()
    running: dict[Future, Stage] = {}
    waiting = list(stages)

    def run(stage: Stage, seen: Mapping[str, DataFrame]) -> DataFrame | None:
        path = f"{root}/{stage.name}"
        if not complete(spark, path):
            if not (stage.on if only is None else stage.name in only):
                return None
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", stage.name)
            _attempt(spark, stage, path, values, seen)
        return spark.read.parquet(path)

    with ThreadPoolExecutor(at_once) as pool:
        while waiting or running:
            lost = [s for s in waiting if needs[s.name] & set(failed)]
            failed |= {s.name: None for s in lost}
            waiting = [s for s in waiting if s not in lost]
            for stage in [s for s in waiting if needs[s.name] <= ended][: at_once - len(running)]:
                seen = {n: t for n, t in tables.items() if n in needs[stage.name]}
                task = inheritable_thread_target(spark)(lambda stage=stage, seen=seen: run(stage, seen))
                running[pool.submit(copy_context().run, task)] = stage
                waiting.remove(stage)
            for future in wait(running, return_when=FIRST_COMPLETED).done if running else ():
                stage = running.pop(future)
                error = future.exception()
                if error is not None:
                    failed[stage.name] = error
                else:
                    ended.add(stage.name)
                    if future.result() is not None:
                        tables[stage.name] = future.result()
    errors = [e for e in failed.values() if e is not None]
    if len(errors) == 1:
        raise errors[0]
    if errors:
        raise ExceptionGroup("stages failed", errors)
    return {n: tables[n] for n in names if n in tables}


def _attempt(spark: SparkSession, stage: Stage, path: str, values: Mapping[str, str], tables: Mapping[str, DataFrame]) -> None:
    """Write the stage's table; made anew while attempts are left and it fails or is empty. A timeout is final."""
    for left in range(stage.attempts - 1, -1, -1):
        try:
            with _Limit(spark, stage):
                stage.make(spark, values, tables).write.mode("overwrite").parquet(path)
        except StageTimeout:
            raise
        except Exception:
            if not left:
                raise
        else:
            if not left or not spark.read.parquet(path).isEmpty():
                return


class _Limit:
    """Cancels the jobs that start inside once the stage's seconds are over, later ones included."""

    def __init__(self, spark: SparkSession, stage: Stage) -> None:
        self.spark, self.stage, self.tag = spark, stage, f"stage-{uuid.uuid4().hex}"
        self.over = threading.Event()
        self.done = threading.Event()
        self.watch = threading.Thread(target=self._cancel, daemon=True)

    def _cancel(self) -> None:
        if self.done.wait(self.stage.seconds):
            return
        self.over.set()
        while not self.done.wait(0.2):
            self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def __enter__(self) -> None:
        if self.stage.seconds is not None:
            self.spark.sparkContext.addJobTag(self.tag)
            self.watch.start()

    def __exit__(self, kind: type | None, error: BaseException | None, _: object) -> None:
        if self.stage.seconds is None:
            return
        self.done.set()
        self.watch.join()
        self.spark.sparkContext.removeJobTag(self.tag)
        if error is not None and self.over.is_set():
            raise StageTimeout(f"{self.stage.name} ran longer than {self.stage.seconds} s") from error
