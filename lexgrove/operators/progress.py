"""How far the jobs of a step are, told while they run."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between looks.
EVERY = 0.05


@contextmanager
def told(spark: SparkSession, progress: Callable[[float], None] | None) -> Iterator[None]:
    """Run the jobs of a block as one group; ``progress`` hears 0.0, then the share of their tasks that is done, and 1.0 at the end.

    Values never fall: jobs and stages that begin later would lower the share, so it stays until it is passed again, and below 1.0
    until the block ends. Nothing more is heard when it fails.
    """
    if progress is None:
        yield
        return
    context, group, done, heard = spark.sparkContext, f"lexgrove-{uuid.uuid4().hex}", threading.Event(), [0.0]
    keys = ("spark.jobGroup.id", "spark.job.description")
    before = [context.getLocalProperty(k) for k in keys]

    def watch() -> None:
        tracker = context.statusTracker()
        while not done.wait(EVERY):
            finished = total = 0
            for job in tracker.getJobIdsForGroup(group):
                info = tracker.getJobInfo(job)
                for stage in [tracker.getStageInfo(s) for s in (info.stageIds if info else [])]:
                    if stage:
                        finished, total = finished + stage.numCompletedTasks, total + stage.numTasks
            share = min(0.99, finished / total) if total else 0.0
            if share > heard[0]:
                heard[0] = share
                progress(share)

    progress(0.0)
    context.setJobGroup(group, "index build")
    watcher = threading.Thread(target=watch, name="lexgrove-progress", daemon=True)
    watcher.start()
    try:
        yield
    finally:
        done.set()
        watcher.join()
        for k, v in zip(keys, before):
            context.setLocalProperty(k, v)
    progress(1.0)
