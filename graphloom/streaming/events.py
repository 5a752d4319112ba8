"""Stateful and windowed stream operators, with their batch forms.

The registered queries read the events as a stream and run it over what there is now, in append mode: a window, session
or pending change is emitted once the watermark has passed it, and its state is dropped then.  A last row far behind
all others (`closing`) moves the watermark past everything, as the next day's events would."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators.upsert import compute_delta, mark_synced
from graphloom.plans.model import Graph, twin
from graphloom.staging import shared_path


def merge_event(held: str, new: str) -> str:
    """What is pending for a path after one more event: '' is nothing.

    add then unlink cancel out, unlink then add is a change, unlink overrides, else the first stays."""
    if not held:
        return new
    if new == "unlink":
        return "" if held == "add" else "unlink"
    if held == "unlink" and new == "add":
        return "change"
    return held


def coalesce_events(events: DataFrame) -> DataFrame:
    """Batch form: path, seq, kind to the pending event of each path."""

    def step(held, e):
        kind = e["kind"]
        after = F.when(kind == "unlink", F.when(held == "add", "").otherwise("unlink")).when((held == "unlink") & (kind == "add"), "change").otherwise(held)
        return F.when(held == "", kind).otherwise(after)

    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind")))
    return events.groupBy("path").agg(F.aggregate(ordered, F.lit(""), step).alias("kind")).filter("kind != ''")


def coalesce_stream(events: DataFrame, quiet_ms: int = 500, late: str | None = None) -> DataFrame:
    """Stream form: each path's pending event is emitted once it has been quiet for `quiet_ms`.

    Quiet by the clock, or, with `late` (a watermark's delay), by the events' own column ts.  The state of a path is
    one word; a micro-batch holds no more of a path than the source hands out at once."""
    by_clock = late is None
    if late is not None:
        events = events.withWatermark("ts", late)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        if state.hasTimedOut:
            state.remove()
            if held:
                yield pd.DataFrame({"path": [key[0]], "kind": [held]})
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        for kind in rows["kind"]:
            held = merge_event(held, kind)
        state.update((held,))
        if by_clock:
            state.setTimeoutDuration(quiet_ms)
        else:
            last = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if by_clock else GroupStateTimeout.EventTimeTimeout
    return events.groupBy("path").applyInPandasWithState(run, "path string, kind string", "kind string", "append", timeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of a user by inactivity: start, end of the last event, events."""
    if late:
        events = events.withWatermark("ts", late)
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).select("user_id", "n", "first", "last")


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sliding(events: DataFrame, width: str, slide: str, late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))


def distinct_within(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first of equal events within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def _snapshots(spark: SparkSession, root: str) -> dict[int, str]:
    """The snapshots under a folder that were written to the end, by number."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {}
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    whole = [n for n in names if n.startswith("snapshot-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return {int(n.split("-")[1]): f"{root}/{n}" for n in whole}


def delta_batches(tracked: DataFrame, kind: str, root: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a snapshot of path hashes, one per batch, in a shared folder; `.snapshot` names
    the last.

    All state is in that folder: snapshot n + 1 is what batch n leaves of the one before, so a batch that is done again
    after a failure gives the same snapshot, and a query that is started anew with the same `root` goes on where the
    last one stopped.  Of several rows of a path in a batch the last one (by seq, if there is such a column) counts."""
    spark = tracked.sparkSession
    root = root or shared_path(spark, "snapshots")
    path = lambda n: f"{root}/snapshot-{n:012d}"
    if not _snapshots(spark, root):
        tracked.write.mode("overwrite").parquet(path(0))

    def apply(batch: DataFrame, number: int) -> None:
        before = max(n for n in _snapshots(spark, root) if n <= number)
        old = spark.read.parquet(path(before))
        order = F.col("seq") if "seq" in batch.columns else F.col("hash")
        latest = batch.groupBy("path").agg(F.max_by("hash", order).alias("hash"))
        current = old.join(latest.select("path"), "path", "left_anti").select("path", "hash").unionByName(latest)
        mark_synced(old, compute_delta(old, current, kind), current, kind).write.mode("overwrite").parquet(path(number + 1))
        apply.snapshot = path(number + 1)

    apply.snapshot = path(max(_snapshots(spark, root)))
    return apply


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and return its result; state and output go to the shared folder."""
    spark = stream.sparkSession
    out, where = {}, shared_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{where}/out-{number}"
        batch.write.mode("overwrite").parquet(path)
        out[number] = path

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    paths = [out[k] for k in sorted(out)]
    if not paths:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(paths[-1:] if mode == "complete" else paths))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern, so that the table may be one file as well as a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def closing(stream: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream and a row a year behind its last event, null but for ts: no window that holds an event is
    still open after it, and its own is never closed."""
    where = shared_path(spark, "closing")
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    row = last.select(*[(F.col("ts") + F.expr("INTERVAL 366 DAYS")).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema])
    row.write.mode("overwrite").parquet(where)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(where))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closing(event_stream(spark, sf_dir), spark, sf_dir)


def _watch(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("signup", "view"), "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    return events.select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("path"), F.col("event_id").alias("seq"), kind.alias("kind"), "ts")


def _window(df: DataFrame) -> DataFrame:
    return df.select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


def _session_rows(df: DataFrame) -> DataFrame:
    return df.select("user_id", "n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a new content of its user's path, in micro-batches over a snapshot."""
    g = Graph(spark, sf_dir)
    content = lambda e: e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("hash"))
    tracked = content(g.table("events").filter("event_id % 3 = 0")).groupBy("path").agg(F.max_by("hash", "seq").alias("hash")).withColumn("type", F.lit("code"))
    apply = delta_batches(tracked, "code")
    query = content(event_stream(spark, sf_dir)).writeStream.option("checkpointLocation", shared_path(spark, "delta")).foreachBatch(apply).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(apply.snapshot)


QUERIES = {
    "watch_coalesce": lambda spark, d: drain(coalesce_stream(_watch(_events(spark, d)), 500, "1 day")),
    "sessionization": lambda spark, d: _session_rows(drain(sessions(_events(spark, d), "30 minutes", "1 day"))),
    "sessionization_12h": lambda spark, d: _session_rows(drain(sessions(_events(spark, d), "12 hours", "1 day"))),
    "stream_tumbling": lambda spark, d: _window(drain(tumbling(_events(spark, d), "6 hours", "1 day"))),
    "stream_sliding": lambda spark, d: _window(drain(sliding(_events(spark, d), "2 days", "1 day", "1 day"))),
    "stream_dedup": lambda spark, d: drain(distinct_within(event_stream(spark, d), ["user_id", "event_type"], "1 day").select("user_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n")),
    "delta_sync": _delta,
}

_SESS = """SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL {} THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
ORACLES = {k: twin(v) for k, v in {
    "watch_coalesce": """, ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, CASE WHEN event_type IN ('signup', 'view') THEN 'add' WHEN event_type = 'error' THEN 'unlink' ELSE 'change' END AS kind FROM events),
      fd(user_id, r, held) AS (SELECT user_id, 0::BIGINT, '' FROM ev WHERE r = 1 UNION ALL SELECT ev.user_id, ev.r, CASE WHEN held = '' THEN kind WHEN kind = 'unlink' THEN CASE WHEN held = 'add' THEN '' ELSE 'unlink' END WHEN held = 'unlink' AND kind = 'add' THEN 'change' ELSE held END FROM fd JOIN ev ON ev.user_id = fd.user_id AND ev.r = fd.r + 1)
      SELECT user_id::VARCHAR AS path, held AS kind FROM fd QUALIFY r = max(r) OVER (PARTITION BY user_id) AND held <> ''""",
    "sessionization": _SESS.format("30 MINUTES"),
    "sessionization_12h": _SESS.format("12 HOURS"),
    "stream_tumbling": "SELECT (floor(epoch(ts) / 21600) * 21600)::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sliding": "SELECT ((floor(epoch(ts) / 86400) - k) * 86400)::BIGINT AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL",
    "stream_dedup": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type",
    "delta_sync": "SELECT user_id::VARCHAR AS path, arg_max(event_type, event_id) AS hash, 'code' AS type FROM events GROUP BY 1",
}.items()}
