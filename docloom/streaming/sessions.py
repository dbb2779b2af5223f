"""Review sessions as keyed state: citations in, verifications in, export gate out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "session_id string, kind string, index int, chunk_id string"
GATE = "session_id string, allowed boolean, total bigint, verified bigint, pending string, awaiting_clarification boolean"


class ReviewSession(StatefulProcessor):
    """State of one session: its citations, what the answer cited, what is verified.

    Event kinds: ``citation`` and ``cited`` (index, chunk), ``verify`` (chunk; ignored when
    the session does not cite it), ``clarify`` and ``answered``.  A session holds a handful
    of citations, so its maps stay small.  Within a micro-batch citations count before
    verifications, however the rows arrive; events are taken frame by frame, and only the
    chunks to verify are kept until the last one.

    With a ``lifetime`` (milliseconds) a session without an event for so long is forgotten as
    a whole: each event moves its timer, and the timer clears all its state.
    """

    def __init__(self, lifetime: int | None = None):
        self.lifetime = lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.citations = handle.getMapState("citations", "index int", "chunk_id string")
        self.cited = handle.getMapState("cited", "index int", "flag boolean")
        self.verified = handle.getMapState("verified", "chunk_id string", "flag boolean")
        self.awaiting = handle.getValueState("awaiting", "flag boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        to_verify, kinds = {}, set()
        for events in rows:
            for kind, index, chunk in zip(events["kind"], events["index"], events["chunk_id"]):
                kinds.add(kind)
                if kind == "citation":
                    self.citations.updateValue((int(index),), (chunk,))
                elif kind == "cited":
                    self.cited.updateValue((int(index),), (True,))
                elif kind == "verify":
                    to_verify[chunk] = True
        if kinds & {"clarify", "answered"}:
            self.awaiting.update(("answered" not in kinds,))
        citations = {k[0]: v[0] for k, v in self.citations.iterator()}
        for chunk in to_verify.keys() & set(citations.values()):
            self.verified.updateValue((chunk,), (True,))
        if self.lifetime is not None:
            for expiry in list(self.handle.listTimers()):
                self.handle.deleteTimer(expiry)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.lifetime)
        cited = {k[0] for k in self.cited.keys()}
        verified = {k[0] for k in self.verified.keys()}
        scope = {i: c for i, c in citations.items() if not cited or i in cited}
        pending = sorted(i for i, c in scope.items() if c not in verified)
        waiting = self.awaiting.exists() and bool(self.awaiting.get()[0])
        yield pd.DataFrame(
            {
                "session_id": [key[0]],
                "allowed": [bool(scope) and not pending],
                "total": [len(scope)],
                "verified": [len(scope) - len(pending)],
                "pending": [" ".join(map(str, pending))],
                "awaiting_clarification": [waiting],
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.citations, self.cited, self.verified, self.awaiting):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def gate_updates(events: DataFrame, lifetime: int | None = None) -> DataFrame:
    """The current export gate of every session that an event touched; see ``ReviewSession``.

    A session is forgotten in the first micro-batch after its ``lifetime`` has passed.  Spark
    keeps such a stream in motion by micro-batches without data; a run over what is
    available (``availableNow``) ends only with
    ``spark.sql.streaming.noDataMicroBatches.enabled`` set to false.
    """
    return events.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=ReviewSession(lifetime), outputStructType=GATE, outputMode="Update",
        timeMode="None" if lifetime is None else "ProcessingTime",
    )


def stored_citations(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session_id, index and chunk_id of the live sessions' citations, read from a stream's checkpoint.

    The last committed micro-batch is read by the state data source, so a running or stopped
    stream can be inspected, and its state joined, without being replayed.
    """
    state = spark.read.format("statestore").option("stateVarName", "citations").load(checkpoint)
    return state.select(
        F.col("key.session_id").alias("session_id"), F.col("user_map_key.index").alias("index"), F.col("user_map_value.chunk_id").alias("chunk_id"))
