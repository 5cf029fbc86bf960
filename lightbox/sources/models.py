"""Model files on a cluster: which processor to run them on, how many at a time, and where a worker finds them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark import SparkFiles
from pyspark.sql import SparkSession

# Names of the runtime's processors, the best first.
PROCESSORS = ["CUDAExecutionProvider", "DmlExecutionProvider", "CPUExecutionProvider"]
MOST_WITH_GPU = 4


def processors(available: list[str] | None = None) -> list[str]:
    """The best processor there is, then the one that always is. Without a list the runtime is asked, if it is installed."""
    if available is None:
        try:
            import onnxruntime

            available = onnxruntime.get_available_providers()
        except ImportError:
            available = []
    best = next((p for p in PROCESSORS if p in available), PROCESSORS[-1])
    return list(dict.fromkeys([best, PROCESSORS[-1]]))


def tasks_at_once(cores: int, found: list[str]) -> int:
    """How many pictures a machine should look at together: a core stays free, and a graphics card serves few."""
    free = max(1, cores - 1)
    return min(MOST_WITH_GPU, free) if found[0] != PROCESSORS[-1] else free


def distributed(spark: SparkSession, path: str) -> Callable[[], str]:
    """Sends a file to every worker's machine once; the function gives its path there."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: SparkFiles.get(name)
