"""Budget enforcement on a stream of save requests.

Same rules as ``operators.selection``; a repository's state is its total and
the accepted paths, both bounded by the cap.  With a time column requests wait
in a reorder buffer until the watermark has passed them and are taken by time
and ``seq``, so the result does not depend on how they were batched; without one
order across batches is arrival order, and inside a batch ``seq``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusmill.params import BudgetParams

OUTPUT = "repo_url string, seq bigint, reason string, rank bigint, running_total bigint"
#: Rows of one frame that a processor hands on.
FRAME_ROWS = 4096
BUFFERED = StructType(
    [StructField(n, LongType()) for n in ("at", "seq", "loc")]
    + [StructField(n, StringType()) for n in ("norm_path", "missing", "flaw")]
)


class BudgetProcessor(StatefulProcessor):
    """Takes requests in arrival order, those of one batch by ``seq``."""

    def __init__(self, params: BudgetParams) -> None:
        self.target, self.cap = params.target_loc, params.cap_loc

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = StructType([StructField("value", LongType())])
        name = StructType([StructField("norm_path", StringType())])
        self.total = handle.getValueState("total", number)
        self.accepted = handle.getMapState("accepted", name, number)

    def taken(self, key, requests: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        """Outcome of (seq, loc, norm_path, missing, flaw) in this order, in frames of bounded size."""
        total = self.total.get()[0] if self.total.exists() else 0
        rank = sum(1 for _ in self.accepted.keys())
        out = []
        for seq, loc, norm_path, missing, flaw in requests:
            path, reason = (norm_path,), None
            if missing:
                reason = missing
            elif self.accepted.containsKey(path):
                reason = "duplicate"
            elif flaw:
                reason = flaw
            elif total + loc > self.cap:
                reason = "budget_exhausted" if total >= self.target else "too_large"
            if reason is None:
                total, rank = total + int(loc), rank + 1
                self.accepted.updateValue(path, (int(loc),))
                out.append((key[0], seq, None, rank, total))
            else:
                out.append((key[0], seq, reason, None, None))
            if len(out) == FRAME_ROWS:
                yield self._frame(out)
                out = []
        self.total.update((total,))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["repo_url", "seq", "reason", "rank", "running_total"])
        return frame.astype({"rank": "Int64", "running_total": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        columns = [batch[c] for c in ("seq", "loc", "norm_path", "missing", "flaw")]
        yield from self.taken(key, zip(*columns, strict=True))

    def close(self) -> None:
        pass


class OrderedBudgetProcessor(BudgetProcessor):
    """Holds requests back until the watermark has passed them; event-time timers let them go in order."""

    def __init__(self, params: BudgetParams, idle_ms: int | None) -> None:
        super().__init__(params)
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", BUFFERED)
        # Earliest waiting time, which has a timer, and the time of the last request that was taken.
        self.clock = handle.getValueState("clock", StructType([StructField("timer", LongType()), StructField("last", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, last = self.clock.get() if self.clock.exists() else (None, None)
        for frame in rows:
            columns = [frame[c] for c in ("at", "seq", "loc", "norm_path", "missing", "flaw")]
            held = [(int(a), int(s), int(n), p, m, f) for a, s, n, p, m, f in zip(*columns, strict=True)]
            self.waiting.appendList(held)
            first = min(h[0] for h in held)
            if timer is None or first < timer:
                timer = first
                self.handle.registerTimer(timer + 1)
        self.clock.update((timer, last))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, last = self.clock.get() if self.clock.exists() else (None, None)
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [h for h in held if h[0] < now], [h for h in held if h[0] >= now]
        run: list[tuple] = []
        for request in ready:
            if self._idle(last, request[0]):  # whenever this is seen, so the batches do not matter
                yield from self.taken(key, run)
                run = []
                self._forget()
            run.append(request[1:])
            last = request[0]
        yield from self.taken(key, run)
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] + 1)
            self.clock.update((rest[0][0], last))
        elif self._idle(last, now):
            self._forget()
            self.clock.clear()
        else:
            self.clock.update((None, last))
            if self.idle_ms is not None and last is not None:
                self.handle.registerTimer(last + self.idle_ms + 2)

    def _idle(self, last: int | None, now: int) -> bool:
        return self.idle_ms is not None and last is not None and now > last + self.idle_ms

    def _forget(self) -> None:
        self.total.clear()
        for path in [tuple(k) for k in self.accepted.keys()]:
            self.accepted.removeKey(path)


def live_budget(checked: DataFrame, params: BudgetParams = BudgetParams(), idle: str | None = None) -> DataFrame:
    """Outcome of each request of a stream.

    ``checked`` has the columns of ``selection.checked_requests``; its join with
    the line masks is a stream-static join.  If it has a time ``ts`` (with a
    watermark), requests are taken by (ts, seq) once the watermark has passed
    them, and requests later than that are dropped.  ``idle`` (an interval like
    ``30 days``) forgets a repository so long after its last request; it then
    starts anew.  The session needs the RocksDB state store provider.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    ordered = "ts" in checked.columns
    narrow = checked.select(
        "repo_url", "seq", "norm_path", "loc", F.coalesce("missing", F.lit("")).alias("missing"),
        F.coalesce("flaw", F.lit("")).alias("flaw"),
        *([F.unix_millis("ts").alias("at"), "ts"] if ordered else []),
    )
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    return narrow.groupBy("repo_url").transformWithStateInPandas(
        statefulProcessor=OrderedBudgetProcessor(params, idle_ms) if ordered else BudgetProcessor(params),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime" if ordered else "None",
    )
