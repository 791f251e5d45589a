"""Counts of a run taken while it runs: by observations on batches, by a listener on streams."""

from __future__ import annotations

from collections import defaultdict
from threading import Condition

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def page_metrics(columns: list[str], extractors: tuple[str, ...] = ()) -> list[Column]:
    """Rows, rows of which an extractor failed, and failures of each extractor, as far as the columns tell."""
    failures = F.col("errors") if "errors" in columns else F.array().cast("array<string>")
    each = [F.count_if(F.array_contains(failures, name)).alias(f"failed_{name}") for name in extractors]
    return [F.count(F.lit(1)).alias("rows"), F.count_if(F.size(failures) > 0).alias("failed"), *each]


def observed(rows: DataFrame, *metrics: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that holds the metrics once an action has read all of them."""
    seen = Observation()
    return rows.observe(seen, *metrics), seen


class RunMetrics(StreamingQueryListener):
    """Sums of the numeric metrics that streams report under one name, over all batches, by the query's id.

    Events come on a thread of their own, some time after the batch: :meth:`totals` waits for the end of the query.
    """

    def __init__(self, name: str) -> None:
        self.name = name
        self.sums: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.ended: dict[str, str | None] = {}
        self.changed = Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self.changed:
                for key, value in row.asDict().items():
                    self.sums[str(event.progress.id)][key] += value or 0

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.changed:
            self.ended[str(event.id)] = event.exception
            self.changed.notify_all()

    def totals(self, query_id: str, seconds: float = 60) -> dict[str, int]:
        """The sums of a query that has ended; an error if its end is not reported in time."""
        with self.changed:
            if not self.changed.wait_for(lambda: query_id in self.ended, seconds):
                raise TimeoutError(f"no end of {query_id} within {seconds} s")
            return dict(self.sums[query_id])
