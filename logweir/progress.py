"""How far the jobs of one thread have read a file, from the status tracker."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from threading import Event, Thread

from pyspark.sql import SparkSession


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of a folder's files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


@contextmanager
def watched(spark: SparkSession, paths: Sequence[str], on_progress: Callable[[int, int], None], every: float = 0.3) -> Iterator[None]:
    """While the block runs, tells on_progress (bytes read, bytes in all): the share of tasks that have ended in the
    group's largest stage so far. Reports rise; the last one says that all is read. An error in on_progress ends the
    reports and is raised at the end."""
    context, group, size = spark.sparkContext, f"logweir-{uuid.uuid4().hex[:8]}", sum(file_size(spark, path) for path in paths)
    done, problems = Event(), []

    def share() -> float:
        tracker = context.statusTracker()
        jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if j]
        stages = [s for s in (tracker.getStageInfo(k) for j in jobs for k in j.stageIds) if s and s.numTasks]
        largest = max(stages, key=lambda s: s.numTasks, default=None)
        return largest.numCompletedTasks / largest.numTasks if largest else 0.0

    def report() -> None:
        told = -1
        try:
            while not done.wait(every):
                now = int(share() * size)
                if told < now < size:
                    on_progress(now, size)
                    told = now
        except Exception as problem:  # raised in the caller's thread
            problems.append(problem)

    watcher = Thread(target=report, daemon=True)
    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
    context.setJobGroup(group, f"reading {paths[0]}" if len(paths) == 1 else f"reading {len(paths)} files")
    watcher.start()
    try:
        yield
    finally:
        done.set()
        watcher.join()
        for k, v in before.items():
            context.setLocalProperty(k, v)
    if problems:
        raise problems[0]
    on_progress(size, size)
