"""Running independent Spark actions of one report side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

PARALLEL_JOBS = 4


def together(spark: SparkSession, actions: Sequence[Callable[[], Any]], jobs: int = PARALLEL_JOBS) -> list[Any]:
    """The results of the actions, in order. Each is a call that starts Spark jobs and shares nothing with the
    others, so the scheduler can fill the tail of one job with tasks of the next."""
    with ThreadPoolExecutor(max_workers=max(1, min(jobs, len(actions)))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(action)) for action in actions]
        return [r.result() for r in running]
