"""Submissions as a keyed state machine over a stream of actions, with an audit of what was refused.

transition() holds the rules.  machine() runs them as a stateful operator with a value (the state) and a list (the audit) for each
submission; run_available() feeds it all events there are and returns the last state of each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.operators.store import shared_folder

#: (action, states it is allowed in) -> next state.
RULES = {
    "submit": (("none", "rejected"), "pending"), "review": (("pending", "ingest_failed"), "processing"), "approve": (("processing",), "approved"),
    "reject": (("pending", "ingest_failed"), "rejected"), "fail": (("processing",), "ingest_failed"),
}
OUTPUT = "submission_id long, status string, applied long, refused long, seen long"


def transition(status: str, action: str) -> str | None:
    """The next state, or None if the action is refused."""
    allowed, to = RULES.get(action, ((), None))
    return to if status in allowed else None


class Machine(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, applied long, refused long, seen long")
        self.audit = handle.getListState("audit", "at timestamp, action string, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, applied, refused, seen = self.state.get() if self.state.exists() else ("none", 0, 0, 0)
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():  # one batch's actions on one submission
            to = transition(status, r.action)
            seen += 1
            if to is None:
                refused += 1
            else:
                status, applied = to, applied + 1
                self.audit.appendValue((r.ts.to_pydatetime(), r.action, status))
        self.state.update((status, applied, refused, seen))
        yield pd.DataFrame({"submission_id": [key[0]], "status": [status], "applied": [applied], "refused": [refused], "seen": [seen]})

    def close(self) -> None:
        pass


def actions(events: DataFrame) -> DataFrame:
    """Events as actions on the submission of their user."""
    name = F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "view", "review").when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "click", "reject").otherwise("fail")
    return events.select(F.col("user_id").alias("submission_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", name.alias("action"))


def machine(stream: DataFrame) -> DataFrame:
    """Stream of actions (submission_id, ts, event_id, action) -> states as they change."""
    return stream.groupBy("submission_id").transformWithStateInPandas(statefulProcessor=Machine(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each submission after all events there are, through the stream engine.

    Its checkpoint and the table that it feeds are in the shared checkpoint folder; each batch is written with its number, so that a
    batch that runs again replaces itself."""
    base = shared_folder(spark)
    folder = f"{base}/submissions-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = machine(actions(stream)).writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("submission_id").agg(F.max_by(F.struct("status", "applied", "refused"), "seen").alias("s")).select("submission_id", "s.*")
