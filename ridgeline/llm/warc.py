"""Deterministic sharded WARC writer and reader.

Records are range-sorted: a shard is a range of record ids, of equal width for all shards, chosen so that a shard holds about
`SHARD_BYTES` on average; a range that holds over twice that is cut further by the leading bits of its records' digests.
Ranges of shards are dealt to tasks (`repartitionByRange`, as many as the bytes ask for), sorted by shard, id and digest; a
task writes each shard into gzip-member archives that roll over by compressed size. Headers and SHA-1 digests are
regenerated from the payload; equal payloads of at least `REVISIT_BYTES` are written once, the others as revisits.

Every file is written under a temporary name of its attempt; the attempt's manifest rows name it, and only manifested files
are renamed. Then what other attempts left in the shard's folder is removed. Renaming is idempotent (a file that is not
there under its final name with the manifest's size stops the commit), and the same rows give the same bytes, however they
are dealt to tasks. The reader checks each file's SHA-256 against the manifest, and each record's digests.

Defined cases: a null payload is empty and a null url is left out; null ids form a range of their own; of repeated ids the
rows are ordered by digest; with equal ids in a group of copies one row is the response and the rest revisit it; empty
tables give an empty archive; very long payloads are written whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import blank, cut, shared_dir, ship, small_broadcast

REVISIT_BYTES = 1000
#: Bytes of a shard and of a task on average, and compressed bytes after which a file rolls over.
SHARD_BYTES = 16 << 20
TASK_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("roll", pa.int64()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, url, payload, size, digest, refers, twin, shard, part): payload null and refers set for revisits."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(blank(F.col(payload_col)), "UTF-8").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    slim = cut(rows.select("id", "size", "digest", "url"), "warc-slim")
    groups = slim.filter(F.col("size") >= REVISIT_BYTES).groupBy("size", "digest").agg(F.max("id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    groups = cut(groups, "warc-groups")
    rows = rows.join(small_broadcast(groups), ["size", "digest"], "left")
    # repeated rows of the head's own id: all but one revisit it
    twins = slim.join(small_broadcast(groups), ["size", "digest"]).filter("id = head").groupBy("id", "size", "digest").count().filter("count > 1").drop("count")
    rows = rows.join(small_broadcast(twins.withColumn("twin", F.lit(True))), ["id", "size", "digest"], "left")
    low, high, total = slim.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    width = 1 if low is None else max(1, -(-(high - low + 1) * shard_bytes // max(total, shard_bytes)))
    shard = lambda: F.coalesce(F.expr(f"cast((cast(id as decimal(20, 0)) - {low or 0}BD) div {width}BD as long)"), F.lit(-1)).alias("shard")
    hot = slim.select(shard(), "size").groupBy("shard").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > 2 * shard_bytes)
    hot = cut(hot.select("shard", F.least(F.lit(28), F.ceil(F.log2(F.col("bytes") / shard_bytes))).cast("int").alias("bits")), "warc-hot")
    refers = F.when(F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head")), F.col("head"))
    rows = rows.select("id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers"), F.coalesce("twin", F.lit(False)).alias("twin"), shard())
    rows = rows.join(small_broadcast(hot), "shard", "left")
    part = F.expr("coalesce(shiftright(cast(conv(substr(digest, 1, 7), 16, 10) as long), 28 - bits), 0L)")
    return rows.withColumn("part", part).drop("bits")


def _record_id(page) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}').urn}>"


def record_bytes(page, url, payload: bytes | None, size: int, digest: str, refers) -> bytes:
    """One record as a gzip member; payload None: a revisit."""
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    head += [f"WARC-Payload-Digest: {sha}", f"X-Payload-Length: {size}"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers)}", f"X-Refers-To-Page-ID: {refers}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    block_sha = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{block_sha}", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def write(records: DataFrame, to: str, roll_bytes: int = ROLL_BYTES, total: int | None = None) -> DataFrame:
    """Write and commit the archive; returns its manifest (shard, part, roll, temporary, name, records, bytes, sha256). total: the
    payloads' bytes, if known; they set the number of tasks."""
    spark = records.sparkSession
    ship(spark)
    total = total if total is not None else records.agg(F.sum("size")).first()[0] or 0
    ordered = records.repartitionByRange(max(1, -(-total // TASK_BYTES)), "shard", "part").sortWithinPartitions("shard", "part", "id", "digest", F.col("refers").desc_nulls_last(), "url")

    def run(batches):
        fs, top = pa.fs.FileSystem.from_uri(to)
        attempt, out, row, last = uuid.uuid4().hex, None, None, None

        def close():
            out.close()
            return pa.RecordBatch.from_pylist([row | {"sha256": row["sha256"].hexdigest()}], schema=MANIFEST)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for r in batch.slice(i, 256).to_pylist():
                    payload, refers = r["payload"], r["refers"]
                    if r["twin"] and (r["id"], r["digest"]) == last:
                        payload, refers = None, r["id"]
                    last = (r["id"], r["digest"])
                    data = record_bytes(r["id"], r["url"], payload, r["size"], r["digest"], refers)
                    same = row is not None and (row["shard"], row["part"]) == (r["shard"], r["part"])
                    if row is not None and not (same and row["bytes"] + len(data) <= roll_bytes):
                        yield close()
                        roll, row = row["roll"] + 1 if same else 0, None
                    elif row is None:
                        roll = 0
                    if row is None:
                        folder = f"shard-{'none' if r['shard'] < 0 else r['shard']}-{r['part']}"
                        name = f"{folder}/{roll:05d}.warc.gz"
                        row = {"shard": r["shard"], "part": r["part"], "roll": roll, "temporary": f"{folder}/.{roll:05d}.{attempt}.tmp", "name": name, "records": 0, "bytes": 0, "sha256": hashlib.sha256()}
                        fs.create_dir(f"{top}/{folder}", recursive=True)
                        out = fs.open_output_stream(f"{top}/{row['temporary']}", compression=None)
                    out.write(data)
                    row["sha256"].update(data)
                    row["records"] += 1
                    row["bytes"] += len(data)
        if row is not None:
            yield close()

    manifest = cut(ordered.mapInArrow(run, "shard long, part long, roll long, temporary string, name string, records long, bytes long, sha256 string"), "warc-manifest")

    def commit(batches):
        fs, top = pa.fs.FileSystem.from_uri(to)
        for batch in batches:
            for r in batch.to_pylist():
                there = fs.get_file_info([f"{top}/{r['temporary']}", f"{top}/{r['name']}"])
                if there[0].type != pa.fs.FileType.NotFound:
                    fs.move(f"{top}/{r['temporary']}", f"{top}/{r['name']}")
                    there[1] = fs.get_file_info(f"{top}/{r['name']}")
                if there[1].size != r["bytes"]:
                    raise ValueError(f"{r['name']} is not what the manifest says")
            yield batch

    done = cut(manifest.mapInArrow(commit, manifest.schema), "warc-commit")

    def sweep(batches):
        fs, top = pa.fs.FileSystem.from_uri(to)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                left = fs.get_file_info(pa.fs.FileSelector(f"{top}/{name.rpartition('/')[0]}"))
                for file in left:
                    if file.path.endswith(".tmp"):
                        fs.delete_file(file.path)
            yield batch

    done.filter("roll = 0").select("name").mapInArrow(sweep, "name string").write.format("noop").mode("overwrite").save()  # what no manifest names
    done.select("name", "records", "bytes", "sha256").write.mode("overwrite").json(f"{to}/manifest")
    return done


class Hashed:
    """A stream that digests what is read of it."""

    def __init__(self, stream):
        self.stream, self.sha256 = stream, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.sha256.update(data)
        return data


def members(stream, size: int = 1 << 18):
    """Yield the bytes of each gzip member of a stream."""
    press, parts, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(size):
        parts.append(press.decompress(data))
        rest = b""
        if press.eof:
            yield b"".join(parts)
            rest = press.unused_data
            press, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("truncated gzip member")


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not match")
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": None if refers is None else int(refers),
    }


def read(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives."""
    ship(spark)
    columns = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if not payloads:
        del columns["payload"]
    schema = pa.schema(columns.items())
    ddl = ", ".join(f"{c} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for c, t in columns.items())

    def run(batches):
        fs, top = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, sha256 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    stream, rows, size = Hashed(stream), [], 0
                    for record in map(parse, members(stream)):
                        rows.append({c: record[c] for c in columns})
                        size += len(record["payload"] or b"") if payloads else 0
                        if len(rows) >= 1024 or size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if stream.sha256.hexdigest() != sha256:
                        raise ValueError(f"the digest of {name} is not the manifest's")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "sha256").repartition(n).mapInArrow(run, ddl)


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write the pages to an archive in the shared folder and read it back."""
    spark = pages.sparkSession
    to = f"{shared_dir(spark)}/ridgeline/warc-{uuid.uuid4().hex}"
    to = to if ":" in to.split("/")[0] else f"file://{to}"
    total = pages.agg(F.sum(F.octet_length(blank(F.col("html"))))).first()[0] or 0
    return read(spark, write(plan_records(pages), to, total=total), to, payloads)
