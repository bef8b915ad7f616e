"""Cancellation of running work: checked between steps, and running jobs are interrupted by their tag."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession

from .errors import Cancelled


class Cancellation:
    """A context whose jobs ``cancel``, called from any thread, ends; work under it then raises ``Cancelled``.

    Jobs started in the ``with`` block by its thread carry a tag of this object alone, so other work of the session goes
    on. What a block has written by then stays written: a Spark write that is interrupted commits nothing.
    """

    def __init__(self, spark: SparkSession):
        self._context = spark.sparkContext
        self._tag = f"datumgate-{uuid.uuid4().hex}"
        self._asked = threading.Event()

    def cancel(self) -> None:
        self._asked.set()
        self._context.cancelJobsWithTag(self._tag)

    @property
    def cancelled(self) -> bool:
        return self._asked.is_set()

    def check(self) -> None:
        """Called between steps, as a job may start just after the running ones were interrupted."""
        if self.cancelled:
            raise Cancelled("Cancelled by the caller")

    def __enter__(self) -> Cancellation:
        self.check()
        self._context.addJobTag(self._tag)
        return self

    def __exit__(self, kind: type | None, failure: BaseException | None, trace: object) -> None:
        self._context.removeJobTag(self._tag)
        if self.cancelled and isinstance(failure, Exception) and not isinstance(failure, Cancelled):
            # The interrupted job's own error.
            raise Cancelled("Cancelled by the caller") from failure
