"""Run counters that a run's own pass over the rows yields."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class RunMetrics:
    """Named counters of one run, filled by the actions that write its tables.

    ``counted`` puts counters beside the rows of a frame; whatever action reads it fills them, so
    no table is read a second time to be counted.  A frame must be read by one action:
    the first one counts.
    """

    def __init__(self):
        self._observations: dict[str, Observation] = {}

    def counted(self, name: str, rows: DataFrame, **counters: Column) -> DataFrame:
        if name in self._observations:
            raise ValueError(f"{name} is counted already")
        observation = self._observations[name] = Observation(name)
        return rows.observe(observation, *(c.alias(k) for k, c in counters.items()))

    def values(self) -> dict[str, dict]:
        """Counters by name; waits for the action that fills each."""
        return {name: dict(o.get) for name, o in self._observations.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """step, counter, value of the run, for the log."""
        rows = [(name, k, None if v is None else float(v)) for name, own in self.values().items() for k, v in own.items()]
        return spark.createDataFrame(rows, "step string, counter string, value double")


class StreamMetrics(StreamingQueryListener):
    """Sums of the counters that streams observe (``df.observe(name, ...)``), batch by batch.

    Add it with ``spark.streams.addListener``.  ``totals[name][counter]`` sums all batches
    whose query is followed; a batch that is retried reports once, when it is done.
    """

    def __init__(self):
        self.totals: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self.batches: dict[str, set] = defaultdict(set)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, row in progress.observedMetrics.items():
            batch = (str(progress.runId), progress.batchId)
            if batch in self.batches[name]:
                continue
            self.batches[name].add(batch)
            for counter, value in row.asDict().items():
                if value is not None:
                    self.totals[name][counter] += value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def admission_counters() -> dict[str, Column]:
    """The counters of ``catalog.admission_counts`` as aggregates over admitted rows."""
    outcome, many = F.col("outcome"), F.col("occurrences")
    repeats = F.when(outcome == "ingested", many - 1).when(outcome == "skipped_existing", many).otherwise(0)
    return {
        "ingested": F.count_if(outcome == "ingested"),
        "skipped_existing": F.coalesce(F.sum(repeats), F.lit(0)),
        "skipped_pii": F.coalesce(F.sum(F.when(outcome == "skipped_pii", many)), F.lit(0)),
    }
