"""Structured Streaming twins of the batch jobs.

* T1 ``stream_ingest``: raw posting files -> normalise -> first-wins dedup.  Each
  micro-batch is deduplicated by the same aggregation as the batch job and then
  anti-joined against what the sink already holds, inside ``foreachBatch``; the
  result equals the batch ingest when files arrive in crawl order.  The sink is keyed:
  a folder holds the postings of one month of deadlines (a part of the natural key),
  open-ended ones by company hash, and a batch reads the key columns of the folders that
  its own keys fall in and no others.  Deadlines lie after the crawl, so what a batch
  reads does not grow with the closed months behind it.
* T2 ``stream_daily_counts``: events -> event-time tumbling day windows per type with
  a watermark.  Update mode writes every changed window row with its batch id; the
  current value of a window is the row of its latest batch (``max_by``), so readers
  never see a partial overwrite.

Both run with ``Trigger.AvailableNow`` for replay and tests; a cluster deployment
uses a processing-time trigger with the same code.  Checkpoints live below the
session's checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, path_exists
from ..operators import board
from ..operators import normalize as N
from ..operators import tables as S


OPEN_PARTS = 8          # folders of open-ended postings
LOG_BLOCK = 1 << 20     # posting ids of one folder of the alert log


def _fact_cols(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in S.FACT_COLUMNS if c in df.columns])


def fact_part() -> Column:
    """The folder of a posting, a function of its natural key."""
    openly = F.concat(F.lit("open-"), F.pmod(F.xxhash64("company_name"), F.lit(OPEN_PARTS)).cast("string"))
    return (F.when(F.col("deadline").isNull(), "none").when(F.year("deadline") >= 9999, openly)
            .otherwise(F.date_format("deadline", "yyyy-MM")))


def log_part() -> Column:
    """The folder of an alert: postings are numbered as they come, so a batch of new ones
    falls in the last folders."""
    return F.floor(F.col("posting_id") / LOG_BLOCK).cast("string")


def parts_held(spark: SparkSession, sink: str) -> set[str]:
    """The folders of a keyed sink, from one listing."""
    if not path_exists(spark, sink):
        return set()
    p = spark._jvm.org.apache.hadoop.fs.Path(sink)
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return {n.removeprefix("part=") for n in names if n.startswith("part=")}


def held_before(new: DataFrame, sink: str, batch_id: int) -> DataFrame | None:
    """What earlier batches wrote to the folders that ``new`` (with ``part``) falls in;
    None if there is nothing.  The folders of a batch are a few dates or id blocks."""
    spark = new.sparkSession
    touched = {r.part for r in new.select("part").distinct().collect()} & parts_held(spark, sink)
    if not touched:
        return None
    schema = T.StructType([f for f in new.schema if f.name != "part"]).add("part", "string").add("batch_id", "integer")
    # a replayed batch reads what earlier batches stored and overwrites its own folders
    return (spark.read.schema(schema).option("basePath", sink).parquet(*(f"{sink}/part={p}" for p in sorted(touched)))
            .where(F.col("batch_id") < batch_id))


def write_parts(new: DataFrame, sink: str, batch_id: int) -> None:
    """Write ``new`` (with ``part``) as the folders of its batch; a replay replaces them."""
    # few files for a folder; a folder of many rows is written by many tasks
    (new.withColumn("batch_id", F.lit(batch_id)).hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("part", "batch_id").parquet(sink))


def stream_ingest(spark: SparkSession, raw_dir: str, schema, sink: str, checkpoint: str,
                  today: str | None = None):
    """Run until the available files are consumed, as one batch; returns the finished query."""
    src = spark.readStream.schema(schema).parquet(raw_dir)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        ok = N.accepted(N.normalize_postings(batch, today))
        new = materialize(_fact_cols(S.first_wins_dedup(ok)).withColumn("part", fact_part()), "arrived")
        held = held_before(new, sink, batch_id)
        if held is not None:
            new = new.join(held.select("part", *S.FACT_KEY), ["part", *S.FACT_KEY], "left_anti").select(*new.columns)
        write_parts(new, sink, batch_id)

    q = (src.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_daily_counts(spark: SparkSession, events_dir: str, schema, sink: str, checkpoint: str,
                        late_tolerance: str = "2 days"):
    """Per (day window, event type) counts with a watermark; update mode."""
    ev = (spark.readStream.schema(schema).parquet(events_dir)
          .withColumn("ts", F.col("ts").cast("timestamp")))
    counts = (ev.withWatermark("ts", late_tolerance)
              .groupBy(F.window("ts", "1 day").alias("w"), "event_type")
              .agg(F.count(F.lit(1)).alias("count")))

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("window_start"), "event_type", "count")
         .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}"))

    q = (counts.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def current_daily_counts(spark: SparkSession, sink: str) -> DataFrame:
    """Latest value of every window written by ``stream_daily_counts``."""
    d = spark.read.parquet(sink)
    return d.groupBy("window_start", "event_type").agg(F.max_by("count", "batch_id").alias("count"))


def batch_daily_counts(events: DataFrame) -> DataFrame:
    """Batch twin of T2."""
    return (events.withColumn("ts", F.col("ts").cast("timestamp"))
            .groupBy(F.window("ts", "1 day").start.alias("window_start"), "event_type")
            .agg(F.count(F.lit(1)).alias("count")))


def write_in_order(df: DataFrame, order_col: str, chunk_expr, path: str) -> None:
    """Replay helper: write ``df`` as one folder per chunk (``chunk=<c>``) in one distributed
    pass; each chunk is range-split over the tasks by ``order_col``."""
    (df.withColumn("chunk", chunk_expr).repartitionByRange("chunk", order_col)
     .write.mode("overwrite").partitionBy("chunk").parquet(path))


def arrivals(spark: SparkSession, staged: str, path: str):
    """Replay: the chunks staged by ``write_in_order`` arrive below ``path`` one after the
    other, each as distributed files; yields after each one."""
    for c in chunks(spark, staged):
        spark.read.parquet(f"{staged}/chunk={c}").write.mode("append").parquet(path)
        yield c


def chunks(spark: SparkSession, path: str) -> list[int]:
    """The chunks below ``path``, in order, from its folder names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    names = [f.getPath().getName() for f in found]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("chunk="))


def write_log(log: DataFrame, path: str) -> None:
    """The alert log of the time before a stream; one that is known as bits stays bits."""
    made = board.made_of(log)
    if made is not None:
        write_bits(made.bits(), path, -1)
    else:
        write_parts(log.select("user_id", "posting_id").withColumn("part", log_part()), path, -1)


def write_bits(lists: board.Lists, path: str, batch_id: int) -> None:
    """The alerts of a batch as bits, and the postings that they are over; a replay replaces
    them.  The folders begin with ``_``: what reads the log's pairs passes them over."""
    for b in lists.boards:
        b.store(f"{path}/_boards/batch_id={batch_id}/book={b.book}")
    lists.df.write.mode("overwrite").parquet(f"{path}/_bits/batch_id={batch_id}")


def bits_before(spark: SparkSession, path: str, ids: DataFrame | None, batch_id: int | None, id_type) -> DataFrame | None:
    """The alerts that batches before ``batch_id`` wrote as bits, of those batches only whose
    postings share an id with ``ids``; None asks for all.  None if there is nothing."""
    found = []
    if path_exists(spark, f"{path}/_boards"):
        known = [b for b in held_batches(spark, f"{path}/_boards") if batch_id is None or b < batch_id]
        boards = {b: spark.read.parquet(f"{path}/_boards/batch_id={b}/book=*") for b in known}
        if ids is not None and known:
            own = F.broadcast(ids.select(F.col("posting_id").cast("bigint").alias("posting_id")).distinct())
            share = reduce(DataFrame.unionByName, (r.select("posting_id").withColumn("b", F.lit(b)) for b, r in boards.items()))
            share = {r.b for r in share.join(own, "posting_id", "left_semi").select("b").distinct().collect()}
            boards = {b: r for b, r in boards.items() if b in share}
        for b, rows in boards.items():
            made = board.Board.read(rows, id_type)
            df = spark.read.parquet(f"{path}/_bits/batch_id={b}")
            found.append(board.Lists(df, {x.book: x.shared for x in made}, id_type, int(spark.conf.get("spark.sql.shuffle.partitions")), None, made))
    return reduce(board.Lists.union, found).pairs() if found else None


def held_batches(spark: SparkSession, path: str) -> list[int]:
    """The batches below ``path``, in order, from its folder names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))


def read_log(spark: SparkSession, path: str, id_type="bigint") -> DataFrame:
    """(user_id, posting_id) of a log: its pairs and its bits."""
    bits = bits_before(spark, path, None, None, id_type)
    if bits is not None and not parts_held(spark, path):
        return bits
    pairs = spark.read.parquet(path).select("user_id", "posting_id")
    return pairs if bits is None else pairs.unionByName(bits)


def stream_alerts(spark: SparkSession, postings_dir: str, schema, subs: DataFrame, profiles: DataFrame | None,
                  expansions: DataFrame | None, log_path: str, checkpoint: str, requests=None):
    """New postings arrive as files; each micro-batch is matched against the static
    subscriptions, which are made ready once (``requests``, or here), deduplicated per
    user, without what earlier batches logged of its posting ids, and written to the log as
    the batch's own folder of bits over its postings (batch ids below 0 for what ``write_log``
    put there before).  A batch reads the pairs of its id blocks and the bits of batches that
    share an id with it; ``read_log`` gives all as pairs."""
    from ..operators import alerts as AL
    src = spark.readStream.schema(schema).parquet(postings_dir)
    requests = requests or AL.Requests(subs, profiles, expansions, first=True)

    def run(batch: DataFrame, batch_id: int) -> None:
        new = AL.user_matches(AL.match_subscriptions(batch, subs, requests=requests))
        ids = batch.select(F.lit(None).cast(new.schema["user_id"].dataType).alias("user_id"), "posting_id").withColumn("part", log_part())
        for held in (held_before(ids, log_path, batch_id), bits_before(spark, log_path, ids, batch_id, batch.schema["posting_id"].dataType)):
            new = new if held is None else AL.alerts_pending(new, held)
        write_bits(board.made_of(new).bits(), log_path, batch_id)

    q = (src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
