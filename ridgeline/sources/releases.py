"""Several tables published as one: each release is a manifest of all tables' folders, and readers see whole ones only.

A run writes its tables to folders of its own and then its manifest, under a temporary name that is renamed to the next
number. Whatever fails before that rename changes nothing that a reader sees; a run that is repeated under its name after
it was published does nothing. Of two runs that publish at once, the one whose number is taken fails and can run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.solver import settle


class Conflict(RuntimeError):
    """Another run published first."""


class Releases:
    """The releases under a folder that all executors share; a manifest is a few lines, read by the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def numbers(self) -> list[int]:
        names = [e.getPath().getName() for e in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, number: int | None = None) -> dict:
        """Of a release, by default the last: number, run and tables (name to folder, rows and schema)."""
        found = self.numbers()
        if not found:
            return {"number": 0, "run": None, "tables": {}}
        number = found[-1] if number is None else number
        lines = self.spark.read.text(f"{self.root}/manifests/{number:08d}.json").collect()
        return json.loads("".join(r.value for r in lines))

    def read(self, table: str, number: int | None = None) -> DataFrame:
        entry = self.manifest(number)["tables"][table]
        return self.spark.read.schema(entry["schema"]).parquet(entry["path"])

    def publish(self, run: str, tables: dict[str, DataFrame], checks: dict[str, Callable[[dict[str, DataFrame]], bool]] | None = None) -> dict:
        """Write the tables and publish them together; tables that are not given stay as the last release has them.

        checks see the written tables by name; if one does not hold, nothing is published.
        """
        for n in self.numbers():
            done = self.manifest(n)
            if done["run"] == run:
                return done
        last = self.manifest()
        entries, folder = dict(last["tables"]), f"{self.root}/runs/{run}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            path = f"{folder}/{name}"
            df.write.parquet(path)
            back = self.spark.read.schema(df.schema).parquet(path)
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
            entries[name] = {"path": path, "rows": back.count(), "schema": fields}
        written = {name: self.spark.read.schema(e["schema"]).parquet(e["path"]) for name, e in entries.items()}
        for name, holds in (checks or {}).items():
            if not holds(written):
                raise ValueError(f"check {name} does not hold, nothing is published")
        new = {"number": last["number"] + 1, "run": run, "tables": entries}
        self._swap(new)
        return new

    def _swap(self, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        to = self._path(f"{self.root}/manifests/{manifest['number']:08d}.json")
        held = self._path(f"{self.root}/manifests/.{manifest['run']}-{uuid.uuid4().hex}.tmp")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri(), self._conf) if held.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        options = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(held, to, options)  # without OVERWRITE: a number that is there is not replaced
        except Exception as e:
            self._fs.delete(held, False)
            if self._fs.exists(to):
                raise Conflict(f"release {manifest['number']} was published by another run") from e
            raise

    def snapshot(self, to: str, number: int | None = None) -> DataFrame:
        """Copy a release's tables to a folder of their own, as release 1 there: (table, rows)."""
        of = self.manifest(number)
        copy = Releases(self.spark, to)
        done = copy.publish(f"snapshot-{of['number']}", {t: self.read(t, of["number"]) for t in of["tables"]})
        return self.spark.createDataFrame([(t, e["rows"]) for t, e in sorted(done["tables"].items())], "table string, rows long")

    def sweep(self, keep: int = 2) -> list[str]:
        """Delete what the last `keep` releases do not stand on: folders of older releases and of runs that failed. To be
        called while no run writes. Returns the folders deleted."""
        numbers = self.numbers()
        used = {e["path"].rsplit("/", 2)[-2] for n in numbers[-keep:] for e in self.manifest(n)["tables"].values()}
        runs = self._path(f"{self.root}/runs")
        gone = [e.getPath() for e in self._fs.listStatus(runs) if e.getPath().getName() not in used] if self._fs.exists(runs) else []
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{n:08d}.json"), False)
        for path in gone:
            self._fs.delete(path, True)
        return [p.getName() for p in gone]


def keyed_rows_hold(value: str, edge: str, value_id: str = "value_id") -> Callable[[dict[str, DataFrame]], bool]:
    """A check for `publish`: every edge's value is among the values."""
    return lambda tables: tables[edge].join(tables[value].select(value_id), value_id, "left_anti").limit(1).count() == 0


def read_json_files(spark: SparkSession, path: str, schema: str, rows: str) -> tuple[DataFrame, DataFrame]:
    """Files of one JSON value each: the elements of its list `rows`, beside file and the other fields, and (file, text) of
    the files that are no such value. Files are parsed once, with the schema given, and kept for both by a checkpoint."""
    read = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    read = read.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))
    read = settle(read)
    fields = [c for c in read.columns if c not in (rows, "_corrupt_record", "file")]
    good = read.filter("_corrupt_record IS NULL").select("file", *fields, F.explode_outer(rows).alias("_row")).select("file", *fields, "_row.*")
    return good, read.filter("_corrupt_record IS NOT NULL").select("file", F.col("_corrupt_record").alias("text"))
