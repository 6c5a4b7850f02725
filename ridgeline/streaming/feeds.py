"""Event feeds as streams: windows with a watermark, readings delivered twice, versions kept by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and type; state ends with the watermark, and events behind it are left out
    (Spark filters a batch by the watermark that the batch before began with)."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


def once(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _best(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def _folders(spark: SparkSession, path: str) -> tuple[dict[int, str], dict[int, str]]:
    """The complete folders under path, by number: bases (base=N stands for all batches before N) and batches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"base": {}, "batch": {}}
    for entry in fs.listStatus(at(path)) if fs.exists(at(path)) else []:
        kind, _, n = entry.getPath().getName().partition("=")
        if kind in found and fs.exists(at(entry.getPath(), "_SUCCESS")):
            found[kind][int(n)] = entry.getPath().toString()
    return found["base"], found["batch"]


def _since(bases: dict[int, str], batches: dict[int, str], before: int | None = None) -> list[str]:
    """What the current table is read from (as of batch `before`): the last base and the batches that it lacks."""
    last = max((n for n in bases if before is None or n < before), default=None)
    return ([] if last is None else [bases[last]]) + [p for n, p in sorted(batches.items()) if n >= (last or 0) and (before is None or n < before)]


def _drop(spark: SparkSession, paths: list[str]) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at(p), True)


class Fenced(RuntimeError):
    """Another query writes to this folder now."""


def _file(spark: SparkSession, path: str, text: str | None = None) -> str | None:
    """The text of a small file, or null if there is none; with text, the file is written anew."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if text is not None:
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        return text
    return "".join(r.value for r in spark.read.text(path).collect()) if fs.exists(at) else None


def _committed(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that a checkpoint has committed, or -1."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [e.getPath().getName() for e in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n) for n in names if n.isdigit()), default=-1)


def start_upserts(changes: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, compact_every: int = 32) -> StreamingQuery:
    """Keep each batch's newest reading of every key under path/batch=N; a batch that is run again replaces its own folder.

    N goes on over all checkpoints: a query whose checkpoint is new, or after which another query wrote, goes on behind the
    last folder and keeps that start in its checkpoint, so neither does it replace the other's batches nor are its own taken
    for what a base has. The
    query that started last writes: its name is in path/writer, and a query that finds another name there fails before it
    writes (one that was past that look may still write the folder of its own number, which holds its own readings only).

    After each `compact_every` batches the base before and the batches since become one new base, path/base=N, and what only
    the base before it stood on goes, so that the folders that `newest` reads stay few. A base counts once it is whole (has its _SUCCESS file); one
    generation stays behind it, for readers that began before, and for a base that was cut short and is written again.
    """
    spark, name = changes.sparkSession, uuid.uuid4().hex
    bases, batches = _folders(spark, path)
    top, done = max([*bases, *(n + 1 for n in batches)], default=0), _committed(spark, checkpoint)
    begun = _file(spark, f"{checkpoint}/ridgeline-first")
    first = 0 if begun is None else int(begun)
    if begun is None or top > first + done + 2:  # beyond a batch of its own that was written and not committed
        first = top - done - 1
        _file(spark, f"{checkpoint}/ridgeline-first", str(first))
    _file(spark, f"{path}/writer", name)

    def write(batch: DataFrame, number: int) -> None:
        spark, n = batch.sparkSession, first + number
        if _file(spark, f"{path}/writer") != name:
            raise Fenced(f"another query writes to {path}")
        _best(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={n}")
        if (n + 1) % compact_every == 0:
            bases, batches = _folders(spark, path)
            parts = _since(bases, batches, n + 1)
            _best(spark.read.schema(batch.schema).parquet(*parts), keys, order).write.mode("overwrite").parquet(f"{path}/base={n + 1}")
            kept = max((b for b in bases if b < n + 1), default=0)
            _drop(spark, [p for b, p in bases.items() if b < kept] + [p for b, p in batches.items() if b < kept])

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The current table of a feed kept by `start_upserts`."""
    return _best(spark.read.parquet(*_since(*_folders(spark, path))), keys, order)
