"""A budget ledger as a stream: what a request may cost is reserved before it is sent, and settled when its cost is known.

State is kept by key: what is spent, and the open reservations with their deadlines. Amounts are whole
millionths, so sums are exact. A reservation that is neither settled nor released by its deadline may have
cost all of it, so it is charged in full: by the next row of its key, or by an event-time timer where none comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISIONS = "key string, seq long, request string, decision string, amount long, spent long, reserved long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ledger(StatefulProcessor):
    """Decides rows(key, seq, at, action, request, amount) of one key, in the order of at (microseconds), then seq."""

    def __init__(self, budget: int, timeout_us: int):
        self.budget, self.timeout = budget, timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "spent long")
        self.open = handle.getMapState("open", "request string", "amount long, deadline long")

    def _state(self) -> tuple[int, dict[str, tuple[int, int]]]:
        spent = int(self.spent.get()[0]) if self.spent.exists() else 0
        return spent, {k[0]: (int(v[0]), int(v[1])) for k, v in self.open.iterator()} if self.open.exists() else {}

    def _expired(self, key: str, spent: int, held: dict, at: int, out: list) -> int:
        for request, (amount, _) in sorted(((r, x) for r, x in held.items() if x[1] <= at), key=lambda z: (z[1][1], z[0])):
            del held[request]
            spent += amount
            out.append((key, None, request, "expired", amount, spent, sum(a for a, _ in held.values())))
        return spent

    def _kept(self, spent: int, held: dict, before: dict) -> None:
        self.spent.update((spent,))
        for request in before.keys() - held.keys():
            self.open.removeKey((request,))
        for request, x in held.items():
            if before.get(request) != x:
                self.open.updateValue((request,), x)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (name,), (spent, held) = key, self._state()
        before, out = dict(held), []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples(index=False):
            spent = self._expired(name, spent, held, r.at, out)
            reserved, amount = sum(a for a, _ in held.values()), int(r.amount)
            if r.action == "reserve":
                decision = "repeated" if r.request in held else "granted" if spent + reserved + amount <= self.budget else "refused"
                if decision == "granted":
                    held[r.request] = (amount, int(r.at) + self.timeout)
            elif r.request not in held:
                decision = "unknown"
            else:
                del held[r.request]
                decision = "settled" if r.action == "settle" else "released"
                spent += amount if r.action == "settle" else 0
            out.append((name, int(r.seq), r.request, decision, amount, spent, sum(a for a, _ in held.values())))
        self._kept(spent, held, before)
        # a call to the JVM each, so only for what is open at the end; timers of before are registered
        for deadline in {x[1] for request, x in held.items() if before.get(request) != x}:
            self.handle.registerTimer(-(-deadline // 1000))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spent, held = self._state()
        before, out = dict(held), []
        spent = self._expired(key[0], spent, held, expiredTimerInfo.getExpiryTimeInMs() * 1000, out)
        self._kept(spent, held, before)
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        df = pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])
        return df.astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def decisions(rows: DataFrame, budget: int, timeout: int, late: str) -> DataFrame:
    """DECISIONS for a stream of rows(key, seq, ts, action, request, amount), and for reservations that expire.

    action is reserve, settle or release. A reservation is granted while what is spent and reserved stays
    within the budget; a settlement charges its own amount. Rows later than the watermark are left out; those
    of one batch are taken in order, so a source should hand out rows of a key in order of time. timeout is in seconds.
    """
    at = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return at.groupBy("key").transformWithStateInPandas(Ledger(budget, timeout * 1_000_000), DECISIONS, "Append", "EventTime")


def run(rows: DataFrame, path: str, budget: int, timeout: int, late: str = "1 hour") -> None:
    """Decides what the stream has now, into a table at path; a later run goes on where this one, or one that was stopped, has ended."""
    spark, name = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        out = decisions(rows, budget, timeout, late).writeStream.format("parquet").option("path", f"{path}/decisions").option("checkpointLocation", f"{path}/checkpoint")
        query = out.outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()


def balances(decided: DataFrame) -> DataFrame:
    """(key, a count of each decision, spent) of DECISIONS."""
    kinds = ("granted", "refused", "repeated", "settled", "released", "unknown", "expired")
    spent = F.sum(F.when(F.col("decision").isin("settled", "expired"), F.col("amount")).otherwise(0))
    return decided.groupBy("key").agg(*[F.count_if(F.col("decision") == k).alias(k) for k in kinds], spent.alias("spent"))
