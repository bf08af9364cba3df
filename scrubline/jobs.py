"""Independent Spark jobs submitted at the same time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(*calls: Callable):
    """Results of calls that need nothing of each other, run side by side.

    Each call submits its own jobs, so idle executors take up the next one
    while the first is still planning or in its tail.
    """
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(calls)) as pool:
        futures = [pool.submit(inherit(call)) for call in calls]
        return [f.result() for f in futures]
