"""Retention as time passes: live postings of a stream go on their day, told by timers of groups of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.store import MOST_DAYS, NO_DEADLINE_DAYS

_STATES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def retirement(published: Column, deadline: Column, profile: Column) -> Column:
    """struct<dia, motivo>: the first day on which retention takes a posting out, and why; of reasons of one day the first of its rule counts. Null if it never goes."""
    limit = F.when(profile == "publico", NO_DEADLINE_DAYS["publico"]).otherwise(NO_DEADLINE_DAYS["privado"])
    due = lambda day, rank, why: F.when(day.isNotNull(), F.struct(day.alias("dia"), F.lit(rank).alias("orden"), F.lit(why).alias("motivo")))
    first = F.least(due(F.date_add(deadline, 1), 0, "plazo_vencido"), due(F.when(deadline.isNull(), F.date_add(published, limit + 1)), 1, "sin_plazo"), due(F.date_add(published, MOST_DAYS + 1), 2, "antiguedad"))
    return F.when(first.isNotNull(), F.struct(first["dia"].alias("dia"), first["motivo"].alias("motivo")))


#: Groups of postings that share a state and a timer: a posting that is seen rewrites its group's state, so about
#: one for a thousand postings that wait. A running stream keeps the number it began with.
GROUPS = 4096


class Retire(StatefulProcessor):
    """Keeps for each posting of a group when and why it goes, and one timer, for the first of them; a later version
    of a posting takes the place of the one before.

    A state and a timer for each posting would take several calls and frames of one row a posting."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "clave array<string>, at array<bigint>, motivo array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, passed, over = self._read(), timerValues.getCurrentWatermarkInMs(), {}
        timer = _first(waiting)
        last = pd.concat(list(rows)).sort_values("visto", kind="stable").drop_duplicates("clave", keep="last")
        for posting, due, why in zip(last["clave"].tolist(), last["due"].tolist(), last["motivo"].tolist(), strict=True):
            posting = None if pd.isna(posting) else posting
            waiting.pop(posting, None)
            if not pd.isna(due):  # of those seen again when it is over already, no timer waits
                (over if due <= passed else waiting)[posting] = (int(due), why)
        self._write(waiting, timer)
        yield from _rows(over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, passed = self._read(), timerValues.getCurrentWatermarkInMs()
        over = {k: v for k, v in waiting.items() if v[0] <= passed}
        # Spark takes away the timer that has run out
        self._write({k: v for k, v in waiting.items() if k not in over}, None)
        yield from _rows(over)

    def _read(self) -> dict:
        held = self.waiting.get()
        return {} if held is None else {k: (at, why) for k, at, why in zip(*held, strict=True)}

    def _write(self, waiting: dict, timer: int | None) -> None:
        """Keeps these and moves the timer, if there is one, to the first of them."""
        if waiting:
            self.waiting.update((list(waiting), [at for at, _ in waiting.values()], [why for _, why in waiting.values()]))
        else:
            self.waiting.clear()
        first = _first(waiting)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def close(self) -> None:
        pass


def _first(waiting: dict) -> int | None:
    return min((at for at, _ in waiting.values()), default=None)


def _rows(over: dict) -> Iterator[pd.DataFrame]:
    if over:
        yield pd.DataFrame({"clave": list(over), "retirada": pd.to_datetime([at for at, _ in over.values()], unit="ms", utc=True), "motivo": [why for _, why in over.values()]})


def retired(stream: DataFrame, key: str, seen: str, late: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """clave, retirada, motivo of the postings (key, publicado, vence, perfil) that go, each when event time
    (``seen``, with lateness ``late``) has passed its day. A posting that is seen again is judged by its last version."""
    ready(stream.sparkSession)
    out = retirement(F.col("publicado"), F.col("vence"), F.col("perfil"))
    rows = stream.select(F.col(key).cast("string").alias("clave"), F.col(seen).cast("timestamp").alias("visto"), (F.unix_date(out["dia"]).cast("long") * 86_400_000).alias("due"), out["motivo"].alias("motivo"))
    rows = rows.withColumn("grupo", F.pmod(F.xxhash64("clave"), F.lit(groups))).withWatermark("visto", late)
    return rows.groupBy("grupo").transformWithStateInPandas(Retire(), "clave string, retirada timestamp, motivo string", "Append", "EventTime")


def ready(spark: SparkSession) -> None:
    """Timers need states that can be listed by time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATES)
