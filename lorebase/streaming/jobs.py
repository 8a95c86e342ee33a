"""Jobs, events and the crawl frontier: batch folds and their Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States a job passes through, and what follows what.
NEXT = {
    "queued": ("running", "cancelled", "cancelling"),
    "running": ("completed", "failed", "cancelling"),
    "cancelling": ("cancelled", "failed"),
    "completed": (), "failed": (), "cancelled": (),
}
#: Job states as version states; a job that is being cancelled still runs.
VERSION_STATUS = {"queued": "queued", "running": "running", "cancelling": "running", "completed": "completed", "failed": "failed", "cancelled": "cancelled"}


def allowed(old: str | None, new: str) -> bool:
    return new == "queued" if old is None else new in NEXT.get(old, ())


def folded(events: DataFrame) -> DataFrame:
    """(job_id, status, n) of events (job_id, seq, status): the state machine run over each job's events in order; steps that are not allowed are passed over. A job's events are as many as it has states."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        status, n = None, 0
        for s in rows.sort_values("seq")["status"]:
            if allowed(status, s):
                status, n = s, n + 1
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "n": [n]})

    return events.groupBy("job_id").applyInPandas(run, "job_id long, status string, n long")


def streamed(events: DataFrame) -> DataFrame:
    """The same over a stream: each update gives the job's status so far."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else (None, 0)
        for rows in frames:
            for s in rows.sort_values("seq")["status"]:
                if allowed(status, s):
                    status, n = s, n + 1
        state.update((status, n))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "n": [n]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, status string, n long", "status string, n long", "update", GroupStateTimeout.NoTimeout)


def version_status(status: str) -> F.Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in VERSION_STATUS.items() for x in kv]), F.col(status))


def subscribed(events: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Events of the kinds asked for; all without a list. For batches and streams."""
    return events if kinds is None else events.where(F.col("event_type").isin(*kinds))


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need instants: a time without a zone is one in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by hour and kind, late events admitted up to a bound; for batches and streams."""
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a longer pause."""
    return timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def crawl(spark: SparkSession, roots: DataFrame, links: DataFrame, depth: int = 3, most: int | None = None, stored=None) -> DataFrame:
    """(url, depth) reached from roots (url) over snapshot links (url, target), breadth first, to a depth; with ``most`` (a run's page budget) the first by depth and address.

    The frontier is a table: a level is one join and one anti-join. ``stored`` writes a table and reads it again, which cuts the lineage of long crawls.
    """
    keep = stored or (lambda df: df)
    seen = keep(roots.select("url").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for d in range(1, depth + 1):
        level = links.join(level.select("url"), "url").select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        level = keep(level)
        seen = keep(seen.union(level))
        if level.isEmpty():
            break
    return seen if most is None else seen.orderBy("depth", "url").limit(most)


def admitted(discovered: DataFrame, frontier: DataFrame) -> DataFrame:
    """Frontier rows (key, done) with new discoveries (key), in one write: what is there stays as it is."""
    return frontier.select("key", "done").union(discovered.select("key").distinct().join(frontier.select("key"), "key", "left_anti").withColumn("done", F.lit(False)))
