"""First-seen marks of bodies on a stream: every row stays, with a mark on those whose body came before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The columns of the body's hash and of the time in milliseconds; what the hash begins with for empty bodies, which are
#: never duplicates.
KEY, TIME, EMPTY = "body_key", "body_ms", "-"
#: Keys that empty bodies are dealt to.
EMPTY_KEYS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def mark_bodies(pages: DataFrame, order: list[str], keep: list[str], body: str = "html", time: str = "captured_at", late: str = "1 day", keep_ms: int = 0) -> DataFrame:
    """The columns ``keep`` of every row of a stream, and ``is_duplicate``: whether its body came before.

    Of one batch's rows with the same body, the first in ``order`` (columns of ``keep``) counts as first; empty and null bodies
    are no duplicates and leave no state. State is the body's hash alone; it is forgotten once the watermark is
    ``keep_ms`` beyond the time of the first sight, never if that is 0. The session must use the RocksDB provider
    (:func:`use_rocksdb`). Bodies themselves do not reach the operator unless they are kept.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    # empty bodies spread over all tasks, many to a key
    key = F.when(F.octet_length(text) > 0, F.sha2(text, 256)).otherwise(F.concat(F.lit(EMPTY), F.pmod(F.xxhash64(F.to_json(F.struct(*keep))), F.lit(EMPTY_KEYS)).cast("string")))
    keyed = pages.withWatermark(time, late).select(*keep, *([] if time in keep else [time]), key.alias(KEY), F.unix_millis(time).alias(TIME))
    schema = T.StructType([*(keyed.schema[c] for c in keyed.columns if c not in (KEY, TIME)), T.StructField("is_duplicate", T.BooleanType())])
    marked = keyed.groupBy(KEY).transformWithStateInPandas(FirstSeen(order, keep_ms), schema, "Append", "EventTime" if keep_ms else "None")
    return marked.select(*keep, "is_duplicate")


def use_rocksdb(spark: SparkSession) -> None:
    """State of arbitrary size lives on disk, checkpointed to the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def earliest(rows: pd.DataFrame, order: list[str]) -> int:
    """The place of the first row in an order; nulls stand last, and of equal rows the first counts."""
    if len(rows) == 1:
        return 0
    values = rows[order[0]].to_numpy()
    if len(order) == 1 and values.dtype.kind in "iu":
        return int(values.argmin())
    return int(rows[order].reset_index(drop=True).sort_values(order, kind="stable").index[0])


class FirstSeen(StatefulProcessor):
    """State of one body: that it was seen, and a timer that forgets it.

    Rows come in pieces; of the rows not seen before only the earliest so far is held, however many there are.
    """

    def __init__(self, order: list[str], keep_ms: int) -> None:
        self.order, self.keep_ms = order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        empty = key[0].startswith(EMPTY)
        known = empty or self.seen.exists()
        first = None
        for piece in rows:
            kept = {c: piece[c] for c in piece.columns if c not in (KEY, TIME)}
            if known:
                yield pd.DataFrame(kept | {"is_duplicate": not empty})
                continue
            if first is not None:
                piece = pd.concat([first, piece])
            place = earliest(piece, self.order)
            first = piece.iloc[place : place + 1]
            if len(piece) > 1:
                others = np.arange(len(piece)) != place
                yield pd.DataFrame({c: piece[c][others] for c in kept} | {"is_duplicate": True})
        if first is not None:
            yield pd.DataFrame({c: first[c] for c in first.columns if c not in (KEY, TIME)} | {"is_duplicate": False})
            at = int(first[TIME].iloc[0])
            self.seen.update((at,))
            if self.keep_ms:
                self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass
