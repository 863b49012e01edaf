"""Extensions beyond batch: per-batch guards for streams of fact tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def guarded(expected: DataFrame, on: list[str], process: Callable[[DataFrame, int], None], retry: Callable[[DataFrame], None]):
    """A foreachBatch function: a batch that lacks expected keys asks for those once, then is processed."""

    def each(batch: DataFrame, epoch: int) -> None:
        lost = expected.join(batch, on, "left_anti")
        if not lost.isEmpty():
            retry(lost)
        process(batch, epoch)

    return each
