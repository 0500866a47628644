"""The rolling decision on a stream: a block is decided when event time has passed it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.config import AuditConfig
from tidewatch.operators.decide import rules_of
from tidewatch.operators.sweep import Carry, Rules, roll

MICROS = 1_000_000
#: watermarks start in 1970; event times are moved on by so much, so that earlier ones count as well
SHIFT = 10_000 * 365 * 86_400 * MICROS

ROW = "sec array<bigint>, score array<double>, test array<boolean>, done array<boolean>, excluded array<int>"
RULE = "cap array<double>, tau0 array<double>, w array<int>, k array<int>"
FIELDS = ("sec", "score", "test", "done", "excluded", "cap", "tau0", "w", "k")
KINDS = dict(zip(FIELDS, (np.int64, float, bool, bool, np.int64, float, float, np.int64, np.int64)))
CARRY = "t0 bigint, at bigint, closed bigint, timer bigint, tau double, on_b int, tail_b array<int>, on_s int, tail_s array<int>"
MADE = ("tau_budget", "tau_sci", "tau_cap_hit", "flag_budget", "flag_sci")


class BlockDecisions(StatefulProcessor):
    """Rows wait in buckets of one block length; a timer per key decides a block once the watermark is behind it.

    State of a key: rows by (bucket, chunk), as many as one calibration window and the blocks still open
    hold, each bucket read and dropped by itself, so neither the rows of a micro-batch nor those of a series
    are ever together in memory; and one row with the origin of the blocks, the last block whose threshold was
    learned, the time up to which rows are decided, and both hysteresis states.
    """

    def __init__(self, keys: Sequence[str], rules: Rules):
        self.keys, self.rules = list(keys), rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", CARRY)
        self.chunks = handle.getMapState("chunks", "bucket bigint, no int", f"{ROW}, {RULE}")
        #: chunks of a bucket, and its first row that is not decided
        self.buckets = handle.getMapState("buckets", "bucket bigint", "n int, first bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = self._carry()
        for pdf in rows:
            sec = pdf["sec"]
            test = (pdf["period"] == "test").to_numpy()
            late = sec.isna().to_numpy() | (test & (sec < c["closed"]).to_numpy() if c["closed"] is not None else False)
            if late.any():
                yield self._rows(key, pdf[late], None)
            rest, test = pdf[~late], test[~late]
            if not len(rest):
                continue
            at = rest["sec"].to_numpy(np.int64)
            if test.any() and c["closed"] is None:
                first = int(at[test].min())
                c["t0"] = first if c["t0"] is None else min(c["t0"], first)
            n = len(rest)
            values = {
                "sec": at,
                "score": rest["score"].to_numpy(float),
                "test": test,
                "done": ~test,
                "excluded": np.zeros(n, np.int64),
                "cap": rest["cap"].to_numpy(float),
                "tau0": rest["tau_budget"].to_numpy(float),
                "w": rest["w_rows"].fillna(1).to_numpy(np.int64),
                "k": rest["k_hits"].fillna(1).to_numpy(np.int64),
            }
            bucket = at // self.rules.block
            for b in np.unique(bucket).tolist():
                self._append(b, {f: v[bucket == b] for f, v in values.items()})
        self._set_timer(c)
        self._keep(c)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c = self._carry()
        c["timer"] = None
        behind = timerValues.getCurrentWatermarkInMs() * 1000 - SHIFT
        while (first := self._first_open()) is not None:
            d = (first - c["t0"]) // self.rules.block
            end = c["t0"] + (d + 1) * self.rules.block
            if end > behind:
                break
            yield from self._decide(key, c, d)
            c["closed"] = end
            self._forget(end - self.rules.window)
        self._set_timer(c)
        self._keep(c)

    def _decide(self, key, c: dict, d: int) -> Iterator[pd.DataFrame]:
        """Decide block ``d``, the first one with open rows; thresholds are learned for the blocks since the last one."""
        rules, t0 = self.rules, c["t0"]
        begin, end = t0 + d * rules.block, t0 + (d + 1) * rules.block
        low = t0 + (c["at"] + 1) * rules.block - rules.window
        held = {b: self._load(b) for b in sorted(b for b, _, _ in self._known()) if low // rules.block <= b <= (end - 1) // rules.block}
        rows = {f: np.concatenate([x[f] for x in held.values()]) for f in FIELDS}
        now = ~rows["done"] & (rows["sec"] < end)
        past = rows["done"] & (rows["sec"] < begin) & (rows["sec"] >= low)
        order = lambda mask: np.flatnonzero(mask)[np.lexsort((rows["score"][mask], rows["sec"][mask]))]
        now, past = order(now), order(past)
        head = now[0]
        tau = rows["tau0"][head] if c["tau"] is None else c["tau"]
        carry = Carry(float(tau), c["on_b"], list(c["tail_b"]), c["on_s"], list(c["tail_s"]))
        sec, score = rows["sec"][now], rows["score"][now]
        known = (rows["sec"][past], rows["score"][past], rows["excluded"][past])
        setting = float(rows["cap"][head]), int(rows["w"][head]), int(rows["k"][head])
        got = roll(known, sec, score, t0, (c["at"] + 1, d), *setting, carry, rules)
        c.update(vars(carry), at=d)
        rows["excluded"][now] = got.pop("excluded")
        rows["done"][now] = True
        at = 0
        for b, x in held.items():
            size = len(x["sec"])
            if (b + 1) * rules.block > begin:
                self._replace(b, {f: v[at : at + size] for f, v in rows.items()})
            at += size
        yield self._rows(key, pd.DataFrame({"sec": sec, "score": score}), got)

    def _rows(self, key, pdf: pd.DataFrame, got: dict | None) -> pd.DataFrame:
        """Decided rows, or late ones without a decision."""
        out = pd.DataFrame({k: [v] * len(pdf) for k, v in zip(self.keys, key)}, index=pdf.index)
        out["ts"] = pd.to_datetime(pdf["sec"], unit="us", utc=True)
        out["score"] = pdf["score"]
        for name in MADE:
            if got is not None:
                out[name] = got[name]
            else:
                out[name] = np.nan if name.startswith("tau_") and name != "tau_cap_hit" else pd.Series([None] * len(pdf), dtype="Int32", index=pdf.index)
        return out

    def _carry(self) -> dict:
        names = [part.split()[0] for part in CARRY.split(", ")]
        if self.carry.exists():
            return dict(zip(names, self.carry.get()))
        return dict(zip(names, (None, -1, None, None, None, 0, [], 0, [])))

    def _keep(self, c: dict) -> None:
        numbers = lambda x: [int(v) for v in x]
        whole = lambda x: None if x is None else int(x)
        self.carry.update(
            (
                whole(c["t0"]), int(c["at"]), whole(c["closed"]), whole(c["timer"]), None if c["tau"] is None else float(c["tau"]),
                int(c["on_b"]), numbers(c["tail_b"]), int(c["on_s"]), numbers(c["tail_s"]),
            )
        )

    def _known(self) -> list[tuple]:
        return [(int(k[0]), int(v[0]), None if v[1] is None else int(v[1])) for k, v in self.buckets.iterator()]

    def _first_open(self) -> int | None:
        return min((first for _, _, first in self._known() if first is not None), default=None)

    @staticmethod
    def _lists(values: dict) -> tuple:
        return tuple(values[f].tolist() for f in FIELDS)

    @staticmethod
    def _first(values: dict) -> int | None:
        left = values["sec"][~values["done"]]
        return int(left.min()) if len(left) else None

    def _append(self, bucket: int, values: dict) -> None:
        n, first = self.buckets.getValue((bucket,)) if self.buckets.containsKey((bucket,)) else (0, None)
        self.chunks.updateValue((bucket, int(n)), self._lists(values))
        both = [x for x in (first, self._first(values)) if x is not None]
        self.buckets.updateValue((bucket,), (int(n) + 1, int(min(both)) if both else None))

    def _load(self, bucket: int) -> dict:
        n, _ = self.buckets.getValue((bucket,))
        chunks = [self.chunks.getValue((bucket, i)) for i in range(n)]
        return {f: np.concatenate([np.asarray(x[i], KINDS[f]) for x in chunks]) for i, f in enumerate(FIELDS)}

    def _replace(self, bucket: int, values: dict) -> None:
        n, _ = self.buckets.getValue((bucket,))
        for i in range(1, n):
            self.chunks.removeKey((bucket, i))
        self.chunks.updateValue((bucket, 0), self._lists(values))
        self.buckets.updateValue((bucket,), (1, self._first(values)))

    def _forget(self, before: int) -> None:
        """Drop buckets that no window reaches any more."""
        for bucket, n, first in self._known():
            if (bucket + 1) * self.rules.block <= before and first is None:
                for i in range(n):
                    self.chunks.removeKey((bucket, i))
                self.buckets.removeKey((bucket,))

    def _set_timer(self, c: dict) -> None:
        first = self._first_open()
        if first is None:
            wanted = None
        else:
            end = c["t0"] + ((first - c["t0"]) // self.rules.block + 1) * self.rules.block
            wanted = -(-(end + SHIFT) // 1000)
        if wanted != c["timer"]:
            if c["timer"] is not None:
                self.handle.deleteTimer(c["timer"])
            if wanted is not None:
                self.handle.registerTimer(wanted)
            c["timer"] = wanted


def decide_stream(stream: DataFrame, cfg: AuditConfig, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Rolling recalibration: thresholds are learned again at every block.

    ``stream``: ``keys, ts, score, period`` and ``tau_fixed, tau_budget, w_rows, k_hits`` as learned on the
    calibration period; of these a block takes the values of its first row, and the first threshold is that
    of the first test row.  Rows are decided when the watermark, ``late`` behind the newest row of the stream,
    has passed their block, in the order of time, rows of one instant by score; how rows are dealt to
    micro-batches does not show.  The last blocks of a stream that has ended need a ``closing_row``.  Test rows
    of a block that was decided, and rows without a time, come out with null flags.

    Sets the session's state store to RocksDB, which state of this kind needs.
    """
    keys = list(keys)
    spark = stream.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rules = rules_of(cfg)
    rules = replace(rules, block=rules.block * MICROS, window=rules.window * MICROS)
    kinds = {"tau_budget": T.DoubleType(), "tau_sci": T.DoubleType()} | {c: T.IntegerType() for c in MADE[2:]}
    out = T.StructType(
        [stream.schema[c] for c in keys]
        + [T.StructField("ts", T.TimestampType()), T.StructField("score", T.DoubleType())]
        + [T.StructField(c, kinds[c]) for c in MADE]
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = stream.withColumn("_t", F.timestamp_micros(micros + F.lit(SHIFT))).withWatermark("_t", late)
    # a plain number of it: the watermark drives the timers, but no row is dropped for being late
    rows = timed.select(
        *keys,
        (F.unix_micros("_t") - F.lit(SHIFT)).alias("sec"),
        F.col("score").cast("double").alias("score"),
        "period",
        (F.col("tau_fixed") * F.lit(cfg.cap_ratio)).cast("double").alias("cap"),
        F.col("tau_budget").cast("double").alias("tau_budget"),
        F.col("w_rows").cast("int").alias("w_rows"),
        F.col("k_hits").cast("int").alias("k_hits"),
    )
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=BlockDecisions(keys, rules), outputStructType=out, outputMode="append", timeMode="eventTime"
    )
