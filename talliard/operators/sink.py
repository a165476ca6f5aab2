"""Handing entities to a store in batches, at least once, without ever dropping one."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliard.operators.numbering import number


def batches(entities: DataFrame, size: int, groups: list[str] | None = None, order: str = "seq") -> DataFrame:
    """entities with ``batch``: consecutive ones of at most ``size``, as a writer that always has a full queue takes them."""
    return number(entities, groups or [], [order], "__n").select(
        *entities.columns, F.floor(F.col("__n") / size).cast("bigint").alias("batch")
    )


class RetryingWriter:
    """For ``foreachBatch``: calls ``persist(df, batch_id)`` until it succeeds, waiting ``pause`` seconds between attempts. After
    ``attempts`` (None: never) the error is raised, the query fails, and a restart sends the same batch again, so ``persist``
    must be idempotent for a batch id. A batch id that was written before is skipped."""

    def __init__(self, persist: Callable[[DataFrame, int], None], pause: float = 1.0, attempts: int | None = None):
        self.persist, self.pause, self.attempts = persist, pause, attempts
        self.done = -1
        self.failures = 0
        self.seconds: list[float] = []

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        if batch_id <= self.done:
            return
        tries = 0
        while True:
            began = time.monotonic()
            try:
                self.persist(df, batch_id)
                break
            except Exception:
                tries += 1
                self.failures += 1
                if self.attempts is not None and tries >= self.attempts:
                    raise
                time.sleep(self.pause)
        self.seconds.append(time.monotonic() - began)
        self.done = batch_id
