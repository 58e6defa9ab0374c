"""Stateful steps with map state and event-time timers (STR5, STR6).

Both run as ``transformWithStateInPandas``: state is kept per key in RocksDB, as
single values, map entries or packed blocks, and a timer calls a key when the
watermark has passed a time, also when no row arrived for it.  Rows of a key reach
Python in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: rows of one output batch, and of one packed block that is written back
OUT_ROWS, BLOCK_ROWS = 10_000, 100_000

#: states to which the keys of STR6 are dealt, times the slices
KEY_BUCKETS = 256

MATCH = ("entity_id {key}, prediction_id {id}, feedback_id {id}, ts long, feedback_ts long, "
         "predicted_churn boolean, actual_churn boolean")


class FirstTruth(StatefulProcessor):
    """Waiting predictions and truths of one (bucket of keys, slice), as packed
    blocks of rows: one state entry per arriving batch, matched as columns."""

    COLUMNS = ["entity_id", "micros", "kind", "row_id", "flag"]

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle):
        self.handle = handle
        self.blocks = handle.getListState("blocks", "block binary")
        self.timer = handle.getValueState("timer", "millis long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for b in rows:
            if len(b):
                self.blocks.appendValue((self.pack(b[self.COLUMNS]),))
                t = int(b["micros"].min())
                first = t if first is None else min(first, t)
        if first is not None:
            self.wake(first, timerValues)
        return iter([])

    def wake(self, micros: int, timerValues) -> None:
        """The bucket's one timer: just after the given time, and after the watermark,
        unless an earlier one is set."""
        at = max(micros // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is not None and held <= at:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import numpy as np
        import pandas as pd
        self.timer.clear()
        blocks = [self.unpack(x[0]) for x in self.blocks.get()]
        if not blocks:
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000       # rows to come are not older
        d = pd.concat(blocks, ignore_index=True).drop_duplicates(["entity_id", "kind", "micros", "row_id"], keep="last")
        who, truth = pd.factorize(d["entity_id"])[0], d["kind"].to_numpy() == 0
        order = np.lexsort((pd.factorize(d["row_id"], sort=True)[0], truth, d["micros"].to_numpy(), who))
        d, who, truth = d.iloc[order].reset_index(drop=True), who[order], truth[order]
        t, n = d["micros"].to_numpy(), len(d)
        # the next truth in (key, time, id): at one time, predictions come first
        after = np.minimum.accumulate(np.where(truth, np.arange(n), n)[::-1])[::-1]
        at = np.minimum(after, n - 1)
        found = (after < n) & (who[at] == who) & (t[at] - t <= self.horizon)
        settled_at = np.where(found, t[at], t + self.horizon)
        waiting = ~truth & (settled_at >= passed)
        done = np.flatnonzero(~truth & ~waiting & found)
        oldest = np.full(who.max() + 1, passed)
        np.minimum.at(oldest, who[waiting], t[waiting])
        rest = d[waiting | (truth & (t >= oldest[who]))]
        self.blocks.clear()
        for i in range(0, len(rest), BLOCK_ROWS):
            self.blocks.appendValue((self.pack(rest.iloc[i:i + BLOCK_ROWS]),))
        if waiting.any():
            self.wake(int(settled_at[waiting].min()), timerValues)
        for i in range(0, len(done), OUT_ROWS):
            p = done[i:i + OUT_ROWS]
            mine, its = d.iloc[p], d.iloc[after[p]]
            yield pd.DataFrame({"entity_id": mine["entity_id"].to_numpy(), "prediction_id": mine["row_id"].to_numpy(),
                                "feedback_id": its["row_id"].to_numpy(), "ts": mine["micros"].to_numpy(), "feedback_ts": its["micros"].to_numpy(),
                                "predicted_churn": self.boolean(pd, mine["flag"]), "actual_churn": self.boolean(pd, its["flag"])})

    @staticmethod
    def boolean(pd, flag):
        """-1, 0, 1 as null, false, true."""
        return pd.Series(flag.to_numpy() == 1, dtype="boolean").mask(flag.to_numpy() < 0)

    @staticmethod
    def pack(rows) -> bytes:
        import pyarrow as pa
        b = pa.RecordBatch.from_pandas(rows, preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, b.schema) as w:
            w.write_batch(b)
        return out.getvalue().to_pybytes()

    @staticmethod
    def unpack(block):
        import pyarrow as pa
        return pa.ipc.open_stream(bytes(block)).read_pandas()

    def close(self):
        pass


def first_truths(rows: DataFrame, horizon: int, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Matches of rows (entity_id, slice, ts, micros, kind, row_id, flag).  Keys are
    dealt to ``buckets`` by hash; a bucket's slice is one state."""
    kinds = dict(rows.dtypes)
    schema = MATCH.format(key=kinds["entity_id"], id=kinds["row_id"])
    dealt = rows.withColumns({"bucket": F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int"),
                              "flag": F.coalesce(F.col("flag").cast("int"), F.lit(-1))})
    out = dealt.groupBy("bucket", "slice").transformWithStateInPandas(
        FirstTruth(horizon), schema, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("ts", "feedback_ts")})


class FilledWindows(StatefulProcessor):
    """The start of a monitor's next window, and closed windows that wait for it."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle):
        self.handle = handle
        self.next = handle.getValueState("next", "start long")
        self.early = handle.getMapState("early", "start long", "n long, confidence double, bins array<long>")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for b in rows:
            for start, n, c, bins in zip(b["start"].tolist(), b["n_predictions"].tolist(), b["avg_confidence"].tolist(), b["bins"].tolist()):
                self.early.updateValue((start,), (n, c, [int(x) for x in bins]))
                first = start if first is None else min(first, start)
        if first is not None and not self.next.exists():
            self.next.update((first,))
        return self.closed(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self.closed(key, timerValues)

    def closed(self, key, timerValues):
        """The windows up to the watermark, in order; then a timer for the next."""
        import pandas as pd
        passed, at, out = timerValues.getCurrentWatermarkInMs(), self.next.get()[0], []
        while at + self.every <= passed:
            held = self.early.getValue((at,)) if self.early.containsKey((at,)) else None
            if held is not None:
                self.early.removeKey((at,))
            out.append((key[0], at, *(held or (0, None, []))))
            at += self.every
            if len(out) == OUT_ROWS:
                yield self.rows(pd, out)
                out = []
        self.next.update((at,))
        self.handle.registerTimer(max(at + self.every, passed + 1))
        if out:
            yield self.rows(pd, out)

    @staticmethod
    def rows(pd, out):
        d = pd.DataFrame(out, columns=["monitor", "start", "n_predictions", "avg_confidence", "bins"])
        return d.assign(avg_confidence=d["avg_confidence"].astype("float64"))

    def close(self):
        pass


def filled_windows(closed: DataFrame, every: int) -> DataFrame:
    """All windows (monitor, start, n_predictions, avg_confidence, bins) of
    ``every`` milliseconds from a monitor's first one to the watermark, in append
    mode; windows without rows have 0 predictions, no average and no bins."""
    rows = closed.groupBy("monitor").transformWithStateInPandas(
        FilledWindows(every), "monitor string, start long, n_predictions long, avg_confidence double, bins array<long>", "Append", "EventTime")
    return rows.withColumn("avg_confidence", F.nanvl("avg_confidence", F.lit(None).cast("double")))
