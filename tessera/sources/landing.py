"""Files fetched by byte ranges and kept as chunks; archives read member by member. Nothing is held whole anywhere.

A file to fetch is planned as ranges, each range is a row that some task fetches. What has landed is a table of chunks below a
root; a transfer that broke off goes on with the ranges that are missing. Digests are taken over a file's chunks in their
order, one chunk in memory at a time. Zip archives are a Spark data source whose partitions are members.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import time
import urllib.request
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range.
CHUNK = 8 << 20
#: Bytes that a task fetches, about.
TASK_BYTES = 64 << 20
#: Tries of a range before it is reported as missing, and seconds between them.
ATTEMPTS, PAUSE = 3, 0.5
_CHUNKS = "name string, offset long, content binary, error string"


class LandingError(ValueError):
    """A name that leaves the root, or a file that is not what its manifest says."""


def within(name: str) -> str:
    """The name as a path below the root; refused if it is absolute, empty, or leaves the root by its parts."""
    parts = PurePosixPath(name).parts
    if not parts or name.startswith("/") or ".." in parts or "\\" in name or "\0" in name or urlparse(name).scheme:
        raise LandingError(f"{name!r} is no path below the root")
    return str(PurePosixPath(*parts))


class HttpFile(io.RawIOBase):
    """A remote file that is read by ranges."""

    def __init__(self, url: str):
        self.url, self.at = url, 0
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as answer:
            self.size = int(answer.headers["Content-Length"])

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.size - self.at)
        if n <= 0:
            return 0
        asked = urllib.request.Request(self.url, headers={"Range": f"bytes={self.at}-{self.at + n - 1}"})
        with urllib.request.urlopen(asked, timeout=60) as answer:
            if answer.status != 206:
                raise OSError(f"{self.url} does not serve ranges")
            data = answer.read(n)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def opened(url: str) -> BinaryIO:
    """A seekable file by path, http or https, or a file system that Arrow knows."""
    scheme = urlparse(url).scheme
    if scheme in ("http", "https"):
        return io.BufferedReader(HttpFile(url), 1 << 16)
    if scheme in ("", "file"):
        return open(unquote(urlparse(url).path), "rb")
    system, path = fs.FileSystem.from_uri(url)
    return system.open_input_file(path)


def placed(url: str) -> tuple[fs.FileSystem, str]:
    """A folder to write in, by path or a file system that Arrow knows."""
    return (fs.LocalFileSystem(), unquote(urlparse(url).path)) if urlparse(url).scheme in ("", "file") else fs.FileSystem.from_uri(url)


def _fetched(url: str, offset: int, length: int) -> bytes:
    with opened(url) as f:
        f.seek(offset)
        data = f.read(length)
    if len(data) != length:
        raise OSError(f"{url} ended {length - len(data)} bytes early in the range at {offset}")
    return data


def sized(manifest: DataFrame) -> DataFrame:
    """The manifest (name, url, size, sha256) with the sizes that it does not state."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for url, size in zip(batch.column("url").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if size is None:
                    with opened(url) as f:
                        size = f.seek(0, 2)
                sizes.append(size)
            yield batch.set_column(batch.schema.get_field_index("size"), "size", pa.array(sizes, pa.int64()))

    return manifest.select("name", "url", F.col("size").cast("long"), "sha256").mapInArrow(ask, "name string, url string, size long, sha256 string")


def ranges(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(name, url, offset, length) of all ranges; an empty file has one of no bytes."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(chunk).cast("long"))
    each = manifest.select("name", "url", "size", F.explode(starts).alias("offset"))
    return each.select("name", "url", "offset", F.least(F.lit(chunk).cast("long"), F.col("size") - F.col("offset")).alias("length"))


def held(spark: SparkSession, root: str) -> DataFrame:
    """(name, offset, content) of what has landed below the root; ranges that failed have no content."""
    schema = _CHUNKS + ", attempt string"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/chunks")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(schema).parquet(f"{root}/chunks") if there else spark.createDataFrame([], schema)
    return rows.where("content IS NOT NULL").select("name", "offset", "content")


def land(manifest: DataFrame, root: str, chunk: int = CHUNK) -> DataFrame:
    """Fetches what is missing of the files and tells each file's state: (name, size, landed, sha256, state).

    Ranges that are there are not fetched again, so a call after a failure goes on where the last one stopped; a range that
    fails ATTEMPTS times is left for the next call and fails no other. States: complete; missing, with ranges to come; digest
    differs, and the file's chunks are removed so that the next call fetches it anew. The chunk size of a root must stay.
    """
    spark = manifest.sparkSession
    for row in manifest.select("name").toLocalIterator():
        within(row["name"])
    wanted = spark.createDataFrame(sized(manifest).toArrow())
    have = held(spark, root).select("name", "offset", F.length("content").cast("long").alias("length"))
    missing = ranges(wanted, chunk).join(have, ["name", "offset", "length"], "left_anti")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                content, error = None, None
                for attempt in range(ATTEMPTS):
                    try:
                        content, error = _fetched(r["url"], r["offset"], r["length"]), None
                        break
                    except OSError as e:
                        error = str(e)
                        time.sleep(PAUSE * (attempt + 1))
                yield pa.RecordBatch.from_pylist([{"name": r["name"], "offset": r["offset"], "content": content, "error": error}], schema=pa.schema([("name", pa.string()), ("offset", pa.int64()), ("content", pa.binary()), ("error", pa.string())]))

    # ranges are dealt evenly, whatever file they are of
    n, size = missing.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-size // TASK_BYTES))
    dealt = missing.repartition(tasks, F.xxhash64("name", "offset"))
    fetched = dealt.mapInArrow(fetch, _CHUNKS).withColumn("attempt", F.lit(str(time.time_ns())))
    fetched.write.mode("append").partitionBy("attempt").parquet(f"{root}/chunks")
    found = digests(held(spark, root))
    state = F.when(F.coalesce("landed", F.lit(-1)) < F.col("size"), "missing").when(F.col("want").isNotNull() & (F.col("want") != F.col("sha256")), "digest differs").otherwise("complete")
    told = wanted.select("name", "size", F.col("sha256").alias("want")).join(found, "name", "left").select("name", "size", F.coalesce("landed", F.lit(0)).alias("landed"), "sha256", state.alias("state"))
    told = spark.createDataFrame(told.toArrow())
    bad = [r["name"] for r in told.where("state = 'digest differs'").select("name").collect()]
    if bad:
        kept = held(spark, root).where(~F.col("name").isin(bad)).withColumns({"error": F.lit(None).cast("string"), "attempt": F.lit(str(time.time_ns()))})
        kept.write.mode("overwrite").partitionBy("attempt").parquet(f"{root}/kept")
        _replace(spark, f"{root}/kept", f"{root}/chunks")
    return told


def _replace(spark: SparkSession, source: str, target: str) -> None:
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    system = paths[1].getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(paths[1], True)
    if not system.rename(*paths):
        raise OSError(f"{source} can't be renamed to {target}")


def in_order(chunks: DataFrame) -> DataFrame:
    """A file's chunks in one task, in their order; a chunk that landed twice comes once. Files are spread over the tasks."""
    return chunks.dropDuplicates(["name", "offset"]).repartition("name").sortWithinPartitions("name", "offset")


def digests(chunks: DataFrame) -> DataFrame:
    """(name, landed, sha256) of each file, as far as it is there without a gap."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, own = None, 0, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_pylist([{"name": name, "landed": at, "sha256": own.hexdigest()}], schema=pa.schema([("name", pa.string()), ("landed", pa.int64()), ("sha256", pa.string())]))
        for batch in batches:
            for k in range(batch.num_rows):
                this, offset, content = (batch.column(c)[k].as_py() for c in range(3))
                if this != name:
                    if name is not None:
                        yield row()
                    name, at, own = this, 0, hashlib.sha256()
                if offset == at:
                    own.update(content)
                    at += len(content)
        if name is not None:
            yield row()

    return in_order(chunks).mapInArrow(fold, "name string, landed long, sha256 string")


def exported(spark: SparkSession, root: str, name: str) -> str:
    """A landed file as a plain one below root/files: written beside its place, flushed to the disks, then renamed, so that a
    reader sees all of it or none. It goes through this process a chunk at a time; Spark itself reads the chunks."""
    target = f"{root}/files/{within(name)}"
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{target}.part", target)]
    system = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(paths[0], True)
    at = 0
    for row in held(spark, root).where(F.col("name") == name).dropDuplicates(["offset"]).orderBy("offset").toLocalIterator():
        if row["offset"] != at:
            raise LandingError(f"{name} lacks the bytes from {at}")
        out.write(bytearray(row["content"]))
        at += len(row["content"])
    out.hsync()
    out.close()
    system.delete(paths[1], False)
    if not system.rename(*paths):
        raise OSError(f"{target} can't be renamed into place")
    return target


def lines(chunks: DataFrame) -> DataFrame:
    """(name, at, text) of the lines of landed files, at being the byte where a line begins. Chunks are split where they are; only
    the pieces at their ends, two of each chunk, are brought together by file."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, offset, content = (batch.column(c)[k].as_py() for c in range(3))
                pieces = content.split(b"\n")
                starts = [offset]
                for p in pieces[:-1]:
                    starts.append(starts[-1] + len(p) + 1)
                last = len(pieces) - 1
                # whole: begins and ends in this chunk; else open to the left, the right, or both
                left, right = [i == 0 and offset > 0 for i in range(last + 1)], [i == last for i in range(last + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * (last + 1)), pa.array(starts), pa.array(pieces, pa.binary()), pa.array(left), pa.array(right)], names=["name", "at", "piece", "left", "right"])

    pieces = chunks.dropDuplicates(["name", "offset"]).mapInArrow(split, "name string, at long, piece binary, left boolean, right boolean")
    text = lambda c: F.decode(c, "UTF-8")
    whole = pieces.where("NOT left AND NOT right").select("name", "at", text("piece").alias("text"))
    ends = pieces.where("left OR right")
    line = F.sum(F.when(F.col("left"), 0).otherwise(1)).over(Window.partitionBy("name").orderBy("at", "left"))
    joined = ends.withColumn("line", line).groupBy("name", "line").agg(F.array_sort(F.collect_list(F.struct("at", "left", "right", "piece"))).alias("p"))
    # what follows a file's last line break is a line only if there is something
    kept = joined.withColumn("piece", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))).where(~F.element_at("p", -1)["right"] | (F.length("piece") > 0))
    return whole.unionByName(kept.select("name", F.col("p")[0]["at"].alias("at"), text("piece").alias("text")))


class Member(InputPartition):
    def __init__(self, bundle: str, member: str):
        super().__init__((bundle, member))


class ZipMembers(DataSource):
    """Lines of the members of zip archives: (bundle, member, line, text), with the options bundles and suffixes as JSON lists.

    Only the archives' directories are read to plan; a task then reads its member as a stream. Written are (member, text), a task's
    lines as an archive of its own in the folder of the path."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "bundle string, member string, line long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(json.loads(self.options["bundles"]), tuple(json.loads(self.options["suffixes"])))


    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise LandingError("archives are added to a folder, none is replaced")
        return _ZipWriter(self.options["path"])


@dataclass
class Archive(WriterCommitMessage):
    name: str | None


class _ZipWriter(DataSourceArrowWriter):
    """An archive's name starts with an underscore, which Spark's listings pass over, until all tasks are done."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archive:
        lines_ = (row for batch in iterator for row in zip(batch.column("member").to_pylist(), batch.column("text").to_pylist(), strict=True))
        first = next(lines_, None)
        if first is None:
            return Archive(None)
        system, root = placed(self.root)
        name = f"{uuid.uuid4().hex}.zip"
        system.create_dir(root)
        try:
            with system.open_output_stream(f"{root}/_{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                for member, own in itertools.groupby(itertools.chain([first], lines_), lambda row: row[0]):
                    if within(member) in z.NameToInfo:
                        raise LandingError(f"the lines of {member!r} do not stand together")
                    with z.open(member, "w", force_zip64=True) as out:
                        for _, text in own:
                            out.write(f"{text}\n".encode())
        except BaseException:
            system.delete_file(f"{root}/_{name}")
            raise
        return Archive(name)

    def commit(self, messages: list[Archive | None]) -> None:
        system, root = placed(self.root)
        system.create_dir(root)
        for m in messages:
            if m and m.name:
                system.move(f"{root}/_{m.name}", f"{root}/{m.name}")

    def abort(self, messages: list[Archive | None]) -> None:
        system, root = placed(self.root)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{root}/_{m.name}")


class _ZipReader(DataSourceReader):
    def __init__(self, bundles: list[str], suffixes: tuple[str, ...]):
        self.bundles, self.suffixes = bundles, suffixes

    def partitions(self) -> list[InputPartition]:
        found = []
        for bundle in self.bundles:
            with opened(bundle) as f, zipfile.ZipFile(f) as z:
                found += [Member(bundle, m) for m in z.namelist() if m.endswith(self.suffixes)]
        return found

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        bundle, member = partition.value
        line, texts = 0, []

        def batch() -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([bundle] * n), pa.array([member] * n), pa.array(range(line - n, line), pa.int64()), pa.array(texts, pa.string())], names=["bundle", "member", "line", "text"])

        with opened(bundle) as f, zipfile.ZipFile(f) as z, z.open(member) as data:
            for row in data:
                texts.append(row.decode("utf-8", "replace").rstrip("\r\n"))
                line += 1
                if len(texts) == 4096:
                    yield batch()
                    texts.clear()
        if texts:
            yield batch()


def zip_members(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """The lines of the members with one of the suffixes, of all archives at the path."""
    spark.dataSource.register(ZipMembers)
    bundles = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    return spark.read.format("zip_members").option("bundles", json.dumps(bundles)).option("suffixes", json.dumps(suffixes)).load()
