"""Structured Streaming operators.

S1  descriptor cache: ``is_new`` marks the first row of a description, and with a TTL the first one after
    a gap. Every partition of a micro-batch first reduces its rows to one per (description, date), so
    a hot description sends a few rows to its state, not all; the state is the last date seen, per
    description (``applyInPandasWithState``), and an event-time timer drops it when its TTL has passed
    behind the watermark. The stream's output are the sightings (description, date, first row), each
    written once; rows get their flag by a join with them.
S2  hit rate per tumbling event-time window: a watermarked aggregation in append mode; a window is
    written when the watermark passes it, rows later than that are dropped.
S3  spend rollup per (window, customer, merchant): a watermarked aggregation in update mode. Updates go
    to a log by batch that is folded every few batches: windows that the watermark has passed are
    written once, the others replace the last snapshot, so log and snapshot hold open windows only.
S4  enrichment of a stream with batch-fitted lists, micro-batch by micro-batch; a text is matched once a call.

A stream's folder (``root``) holds its checkpoint, state and output: a call with the folder of an
earlier one goes on where that ended.
"""
from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.session import ensure_checkpoint_dir

COMPACT_EVERY = 10
FILE_ROWS = 500_000
SECONDS_A_DAY = 86400


def _root(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:10]}"


# ------------------------------------------------------------------ files
def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _numbered(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers n of the complete folders ``key=n`` below ``path``."""
    found = [int(m[1]) for m in (re.fullmatch(f"{key}=(\\d+)", n) for n in _names(spark, path)) if m]
    return sorted(n for n in found if _exists(spark, f"{path}/{key}={n}/_SUCCESS"))


def write_stream_source(df: DataFrame, by: str = "posted_date", name: str = "source", path: str | None = None,
                        order: str | None = None) -> str:
    """Lay a table out (or, with ``path``, add it to a laid-out one) as one folder per ``by`` value for a file
    stream to replay in event order. Rows are dealt by range of (``by``, ``order``), FILE_ROWS to a range, so a
    large day is several files in the order of ``order`` (default: ``txn_id`` if there is one) and a small
    table has a file a day, whatever the session's shuffle partitions; file times follow that order where
    the file system keeps them."""
    spark = df.sparkSession
    path = path or _root(spark, name)
    order = order or ("txn_id" if "txn_id" in df.columns else None)
    keys = [by] + ([order] if order else [])
    old = {(d, f) for d in _names(spark, path) for f in (_names(spark, f"{path}/{d}") if "=" in d else [])}
    n = max(1, -(-df.count() // FILE_ROWS))
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("append").partitionBy(by).parquet(path)
    files = [(d, f) for d in _names(spark, path) if "=" in d for f in _names(spark, f"{path}/{d}") if f.endswith(".parquet")]
    now = int(time.time() * 1000)
    for i, (d, f) in enumerate(x for x in files if x not in old):
        fs, p = _fs(spark, f"{path}/{d}/{f}")
        fs.setTimes(p, now + i, -1)
    return path


def end_source(path: str, df: DataFrame, after_days: int, by: str = "posted_date") -> None:
    """Adds one row of nulls to a laid-out source, ``after_days`` behind the last date of ``df``: it carries the
    watermark past the last windows."""
    last = df.agg(F.date_add(F.max(by), after_days).alias(by)).filter(F.col(by).isNotNull())
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != by]
    write_stream_source(last.select(by, *empty), by, path=path, order=by)


# ------------------------------------------------------------------ S1
def _first_a_day(it):
    """One row per (description, date) of a partition's batch: the one with the smallest id."""
    for pdf in it:
        if len(pdf):
            yield pdf.groupby(["description", "posted_date"], dropna=False, sort=False)["txn_id"].min().reset_index()


def _sightings(ttl_days: int | None):
    """The state function of one description: the first row of every date that starts a new sighting."""
    def run(key, frames, state):
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["posted_date", "txn_id"]).drop_duplicates("posted_date")
        last = state.get[0] if state.exists else None
        new = []
        for row in rows.itertuples(index=False):
            day = (row.posted_date - pd.Timestamp(0).date()).days
            if last is None or (ttl_days is not None and day - last > ttl_days):
                new.append((key[0], row.posted_date, row.txn_id))
            last = day if last is None else max(last, day)
        state.update((last,))
        if ttl_days is not None:
            state.setTimeoutTimestamp((last + ttl_days + 1) * SECONDS_A_DAY * 1000)
        yield pd.DataFrame(new, columns=["description", "posted_date", "txn_id"])
    return run


def descriptor_sightings(stream: DataFrame, ttl_days: int | None = None, watermark: str = "2 days") -> DataFrame:
    """S1 as a streaming DataFrame: (description, posted_date, txn_id) of every row that is new, from a stream
    with these columns. With ``ttl_days`` a description last seen more than so many days before is new
    again, and rows later than the watermark are not looked at."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in ("description", "posted_date", "txn_id"))
    rows = stream.select("description", "posted_date", "txn_id").mapInPandas(_first_a_day, schema)
    if ttl_days is not None:
        rows = rows.withColumn("_ts", F.col("posted_date").cast("timestamp")).withWatermark("_ts", watermark)
    return rows.groupBy("description").applyInPandasWithState(
        _sightings(ttl_days), schema, "last_day int", "append", "NoTimeout" if ttl_days is None else "EventTimeTimeout")


def _file_stream(spark: SparkSession, path: str, schema, max_files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


PARTITIONS = "spark.sql.shuffle.partitions"


def _drain(spark: SparkSession, writer, root: str) -> None:
    """Runs a query until its source is drained. Every batch visits every partition of its state, however few rows
    it has, and a stream's shuffles are not coalesced: a new query gets no more partitions than two per core
    (one that goes on keeps those of its checkpoint)."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        query = writer.option("checkpointLocation", f"{root}/_ckpt").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PARTITIONS, before)
    query.awaitTermination()


def descriptor_cache_stream(spark: SparkSession, source_path: str, schema, name: str = "s1", max_files: int = 1,
                            ttl_days: int | None = None, watermark: str = "2 days", root: str | None = None) -> DataFrame:
    """Run the descriptor cache over ``source_path`` until it is drained and return its rows
    (txn_id, description, posted_date, is_new) as a batch DataFrame. Rows with equal dates are new in the
    order of ``txn_id``; a row that comes after later dates of its description is not new. With ``root``, a
    later call takes only the files that came since."""
    root = root or _root(spark, name)
    new = descriptor_sightings(_file_stream(spark, source_path, schema, max_files), ttl_days, watermark)
    _drain(spark, new.writeStream.format("parquet").option("path", f"{root}/out"), root)
    rows = spark.read.schema(schema).parquet(source_path).select("txn_id", "description", "posted_date")
    if not _names(spark, f"{root}/out"):
        return rows.withColumn("is_new", F.lit(False))
    seen = spark.read.schema(new.schema).parquet(f"{root}/out").select(
        F.col("txn_id").alias("_t"), F.col("posted_date").alias("_p"), F.col("description").alias("_d"), F.lit(True).alias("_new"))
    same = (F.col("txn_id") == F.col("_t")) & (F.col("posted_date") == F.col("_p")) & F.col("description").eqNullSafe(F.col("_d"))
    return rows.join(seen, same, "left").select("txn_id", "description", "posted_date",
                                                F.coalesce("_new", F.lit(False)).alias("is_new"))


# ------------------------------------------------------------------ S2
def hit_rate_windows(flags: DataFrame, window: str = "1 day", watermark: str = "2 days") -> DataFrame:
    """Cache-hit share per tumbling event-time window of S1's rows, batch or streaming (then
    watermarked). Rows without a flag only carry the time."""
    d = flags.withColumn("ts", F.col("posted_date").cast("timestamp"))
    if d.isStreaming:
        d = d.withWatermark("ts", watermark)
    return (d.groupBy(F.window("ts", window).alias("w"))
            .agg(F.round(F.avg((~F.col("is_new")).cast("double")), 3).alias("hit_rate"), F.count("is_new").alias("n"))
            .filter(F.col("n") > 0).select(F.col("w.start").cast("date").alias("window_start"), "hit_rate", "n"))


def hit_rate_stream(spark: SparkSession, source_path: str, schema, window: str = "1 day", watermark: str = "2 days",
                    max_files: int = 1, name: str = "s2", root: str | None = None) -> DataFrame:
    """S2 on a stream: drain ``source_path`` (S1's rows) and return the windows written so far. A window is
    written once, in append mode, when the watermark passes its end; rows that come later are dropped."""
    root = root or _root(spark, name)
    rates = hit_rate_windows(_file_stream(spark, source_path, schema, max_files), window, watermark)
    _drain(spark, rates.writeStream.format("parquet").option("path", f"{root}/out"), root)
    if not _names(spark, f"{root}/out"):
        return spark.createDataFrame([], rates.schema)
    return spark.read.schema(rates.schema).parquet(f"{root}/out")


# ------------------------------------------------------------------ S3
ROLLUP_KEYS = ["w", "customer_id", "canonical_merchant"]


class RollupTable:
    """The rollup under ``root``: ``log/b=n`` the updates of batch n, ``open/upto=n`` the open windows after
    batch n, ``closed/upto=n`` the windows that the fold at batch n found passed by the watermark."""

    def __init__(self, spark: SparkSession, root: str, schema, watermark: str, compact_every: int):
        self.spark, self.root, self.schema = spark, root, schema
        self.watermark, self.every = watermark, compact_every

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _folded(self, upto: int | None = None) -> tuple[DataFrame, list[int]]:
        """Latest values of the open windows after batch ``upto`` (default: all batches), and the folds before it."""
        folds = [n for n in _numbered(self.spark, f"{self.root}/open", "upto") if upto is None or n < upto]
        last = folds[-1] if folds else -1
        log = [n for n in _numbered(self.spark, f"{self.root}/log", "b") if n > last and (upto is None or n <= upto)]
        rows = self._read([f"{self.root}/log/b={n}" for n in log] + [f"{self.root}/open/upto={last}"] * bool(folds))
        rest = [c for c in rows.columns if c not in ROLLUP_KEYS]
        return (rows.groupBy(*ROLLUP_KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
                .select(*ROLLUP_KEYS, "v.*")), folds

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of updates; a repeated batch writes the same again."""
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.root}/log/b={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self._fold(batch_id)

    def _fold(self, batch_id: int) -> None:
        rows, folds = self._folded(batch_id)
        rows = rows.persist()
        # the watermark behind this batch is the last event time less the delay, or later
        passed = rows.agg(F.max("w.start") - F.expr(f"INTERVAL {self.watermark}")).first()[0]
        closed = F.coalesce(F.col("w.end") <= F.lit(passed), F.lit(False))
        rows.filter(closed).write.mode("overwrite").parquet(f"{self.root}/closed/upto={batch_id}")
        rows.filter(~closed).write.mode("overwrite").parquet(f"{self.root}/open/upto={batch_id}")
        rows.unpersist()
        # the fold before this one stays, a batch that is repeated starts from it
        kept = folds[-1] if folds else -1
        for n in _numbered(self.spark, f"{self.root}/log", "b"):
            if n <= kept:
                self._delete(f"{self.root}/log/b={n}")
        for n in folds[:-1]:
            self._delete(f"{self.root}/open/upto={n}")

    def _delete(self, path: str) -> None:
        fs, p = _fs(self.spark, path)
        fs.delete(p, True)

    def rows(self) -> DataFrame:
        # a fold counts when its second table, the open windows, is complete
        last = max(_numbered(self.spark, f"{self.root}/open", "upto"), default=-1)
        done = [n for n in _numbered(self.spark, f"{self.root}/closed", "upto") if n <= last]
        return self._folded()[0].unionByName(self._read([f"{self.root}/closed/upto={n}" for n in done]))


def spend_rollup_stream(spark: SparkSession, source_path: str, schema, merchant_of: Callable[[DataFrame], DataFrame],
                        name: str = "s3", window: str = "1 day", watermark: str = "2 days", max_files: int = 1,
                        compact_every: int = COMPACT_EVERY, root: str | None = None) -> DataFrame:
    """S3: streaming spend per (window, customer, merchant). ``merchant_of`` maps the stream to one with a
    ``canonical_merchant`` column. Rows later than the watermark are dropped. With ``root``, a later call
    takes only the files that came since."""
    root = root or _root(spark, name)
    s = merchant_of(_file_stream(spark, source_path, schema, max_files))
    s = s.withColumn("ts", F.col("posted_date").cast("timestamp")).withWatermark("ts", watermark)
    agg = (s.groupBy(F.window("ts", window).alias("w"), "customer_id", "canonical_merchant")
           .agg(F.sum(F.abs("amount").cast("decimal(18,2)")).alias("spend"), F.count(F.lit(1)).alias("txn_count")))
    table = RollupTable(spark, root, agg.withColumn("batch", F.lit(0).cast("long")).schema, watermark, compact_every)
    _drain(spark, agg.writeStream.outputMode("update").foreachBatch(table.write), root)
    return table.rows().select(F.col("w.start").cast("date").alias("day"), "customer_id", "canonical_merchant",
                               F.round("spend", 2).cast("double").alias("total_spend"), "txn_count")


# ------------------------------------------------------------------ S4
def enrich_stream(stream: DataFrame, route) -> DataFrame:
    """Apply a batch-fitted route (its lists and priors are static DataFrames) to a
    streaming DataFrame; joins against them are stream-static joins."""
    return route.transform(stream)


def enrich_batches(spark: SparkSession, source_path: str, schema, route, max_files: int = 1, name: str = "s4",
                   root: str | None = None) -> DataFrame:
    """S4 by micro-batch: the route's batch form runs on each. A route that matches texts (``match_texts``) matches
    those of a batch that none before it had; what they match is kept for the call, as a later one may have another
    route. Output is written by batch number, a repeated batch writes the same again."""
    root = root or _root(spark, name)
    stream = _file_stream(spark, source_path, schema, max_files)
    kept = f"{root}/texts-{uuid.uuid4().hex[:10]}"

    def matched(batch: DataFrame, batch_id: int) -> DataFrame:
        done = [f"{kept}/b={n}" for n in _numbered(spark, kept, "b") if n < batch_id]
        texts = route.texts(batch).filter("_fallback is not null")
        if done:
            texts = texts.join(spark.read.parquet(*done).select("_fallback"), "_fallback", "left_anti")
        texts.write.mode("overwrite").parquet(f"{kept}/new")
        # the table is read by the caller's session: a stream's own has no adaptive execution, which skewed joins need
        new = spark.read.schema("query string, _fallback string").parquet(f"{kept}/new")
        route.match_texts(new).write.mode("overwrite").parquet(f"{kept}/b={batch_id}")
        return spark.read.parquet(*done, f"{kept}/b={batch_id}")

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = route.transform(batch, matched(batch, batch_id)) if hasattr(route, "match_texts") else route.transform(batch)
        rows.write.mode("overwrite").parquet(f"{root}/out/b={batch_id}")

    _drain(spark, stream.writeStream.foreachBatch(step), root)
    done = [f"{root}/out/b={n}" for n in _numbered(spark, f"{root}/out", "b")]
    if not done:
        return route.transform(spark.createDataFrame([], stream.schema))
    return spark.read.parquet(*done)
