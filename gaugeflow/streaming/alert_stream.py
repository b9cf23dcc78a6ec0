"""Alert rules as a stateful stream: one state machine for each rule and label set."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.labels import compare_by
from ..operators.alerts import attempt, attempt_each

OUT = "rule string, generation long, labels_sig string, labels map<string,string>, status string, value double, fired_at long, resolved_at long"


class AlertMachine(StatefulProcessor):
    """Holds since when the threshold is crossed and when the alert fired; ticks of a key arrive in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "since long, fired long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rule, generation, sig = key
        since, fired = (int(x) for x in self.state.get()) if self.state.exists() else (-1, -1)
        out = []
        batch = pd.concat(list(rows)).sort_values("tick")
        for tick, value, crossed, hold, labels in batch[["tick", "value", "crossed", "hold_ms", "labels"]].itertuples(index=False, name=None):
            if crossed and fired < 0:
                since = tick if since < 0 else since
                if tick - since >= hold:
                    fired = tick
                    out.append((rule, generation, sig, labels, "firing", value, fired, None))
            elif not crossed:
                if fired >= 0:
                    out.append((rule, generation, sig, labels, "resolved", value, fired, tick))
                since, fired = -1, -1
        self.state.update((since, fired))
        columns = ["rule", "generation", "labels_sig", "labels", "status", "value", "fired_at", "resolved_at"]
        yield pd.DataFrame(out, columns=columns).astype({"fired_at": "Int64", "resolved_at": "Int64"})

    def close(self) -> None:
        pass


def alert_stream(ticks: DataFrame, rules: DataFrame) -> DataFrame:
    """Transitions of a stream of ``ticks`` (rule, labels, labels_sig, tick, value).

    ``rules`` (rule, op, threshold, hold_ms, generation) is static. A rule that stays
    keeps its generation and so its state; one that is dropped and added again gets a
    new generation and can't resume. Needs the RocksDB state store.
    """
    joined = ticks.join(rules, "rule").withColumn("crossed", compare_by(F.col("value"), F.col("op"), F.col("threshold")))
    rows = joined.select("rule", "generation", "labels_sig", "labels", "tick", "value", "crossed", "hold_ms")
    return rows.groupBy("rule", "generation", "labels_sig").transformWithStateInPandas(AlertMachine(), outputStructType=OUT, outputMode="Append", timeMode="None")


def deliver_stream(transitions: DataFrame, folder: str | None, log: str, checkpoint: str, send: Callable[[str], None] | None = None):
    """Hand each transition to ``send`` as it happens, or write it to ``folder`` as a JSON line where there is none, and note its delivery attempt in ``log``."""
    body = F.to_json(F.struct("rule", "status", "value", "labels", "fired_at", "resolved_at")).alias("body")

    def write(batch: DataFrame, batch_id: int) -> None:
        made = batch.select("rule", "labels_sig", "status", body).persist()
        attempt_each(made, send, log) if send else attempt(made, folder, log)
        made.unpersist()

    return transitions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
