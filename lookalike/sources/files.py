"""Listing files, hashing contents, catalog tables on disk, thumbnails."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.catalog import SCHEMA, current_rows
from lookalike.functions.media import thumbnail_key
from lookalike.functions.paths import suffix

#: Files up to this size are hashed whole, larger ones from so many samples of so many bytes.
WHOLE, SAMPLES, SAMPLE = 100 << 20, 10, 1 << 20


def any_case(suffixes: list[str]) -> str:
    """A file name pattern for the suffixes, in either case."""
    one = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s.lstrip("."))
    return "*.{" + ",".join(map(one, suffixes)) + "}"


def listing(spark: SparkSession, folders: list[str], suffixes: list[str] | None = None) -> DataFrame:
    """(path, size, mtime) of non-empty files below the folders, each once.

    Names that begin with a dot, symbolic links, and what lies below such folders are passed over; a folder that
    isn't there gives nothing. Suffixes are matched where files are listed, and no file is opened.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if suffixes:
        read = read.option("pathGlobFilter", any_case(suffixes))
    found = None
    for folder in folders:
        root = folder.rstrip("/") or "/"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            continue
        path = F.regexp_replace("path", "^file:/+", "/")
        rows = read.load(root).select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"))
        bare = root.removeprefix("file://").removeprefix("file:")
        rows = rows.where(~F.expr(f"substring(path, {len(bare) + 1})").contains("/.") & (F.col("size") > 0)).withColumn("root", F.lit(bare))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "path string, size bigint, mtime double")
    if suffixes:
        found = found.where(suffix().isin([s.lower().lstrip(".") for s in suffixes]))
    return found.mapInArrow(without_links, found.schema).dropDuplicates(["path"]).select("path", "size", "mtime")


def without_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose path below its root passes no symbolic link; each folder is looked at once per task."""
    known: dict[str, bool] = {}

    def linked(path: str, root: str) -> bool:
        if len(path) <= len(root) or "://" in path:
            return False
        if path not in known:
            known[path] = os.path.islink(path) or linked(path.rsplit("/", 1)[0], root)
        return known[path]

    for batch in batches:
        keep = [not (linked(p.rsplit("/", 1)[0], r) or os.path.islink(p)) for p, r in zip(batch.column("path").to_pylist(), batch.column("root").to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def content_digest(path: str, size: int, mtime: float, whole: int = WHOLE, sample: int = SAMPLE) -> str:
    """SHA-256 of a file; of one above 100 MiB, of ten 1 MiB samples with size, mtime and suffix. Read by seeking."""
    from lookalike.sources.media import open_file

    try:
        digest = hashlib.sha256()
        with open_file(path) as file:
            if size <= whole:
                while part := file.read(sample):
                    digest.update(part)
            else:
                for i in range(SAMPLES):
                    file.seek(size // SAMPLES * i)
                    digest.update(file.read(sample))
                digest.update(f"{size}_{mtime}_{os.path.splitext(path)[1]}".encode())
        return digest.hexdigest()
    except OSError as e:
        return f"FAIL_{path.rsplit('/', 1)[-1]}_{type(e).__name__}"


def hashed(files: DataFrame, whole: int = WHOLE, sample: int = SAMPLE) -> DataFrame:
    """Adds phash to listed files (path, size, mtime): equal for equal contents. Files are read where the task runs, a
    block at a time; one that can't be read has a text that begins with FAIL_ instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            each = zip(*(batch.column(c).to_pylist() for c in ("path", "size", "mtime")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([content_digest(p, s, m, whole, sample) for p, s, m in each], pa.string())], names=[*names, "phash"])

    return files.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*files.dtypes, ("phash", "string")]))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Overwrite a catalog table, partitioned by mode. Must not be the table that `catalog` reads."""
    catalog.write.mode("overwrite").partitionBy("mode").parquet(path)


def append_catalog(fresh: DataFrame, path: str) -> None:
    """Add writes to a catalog table without reading it: the newest write of a key is its current row. When this
    returns the rows are on disk, so no barrier is needed; a failed append leaves nothing that is read."""
    fresh.write.mode("append").partitionBy("mode").parquet(path)


def compact_catalog(spark: SparkSession, path: str, to: str, files: int | None = None) -> None:
    """Rewrite a catalog table with only the current row of each key, in as few files as asked."""
    rows = current_rows(read_catalog(spark, path), [f.name for f in SCHEMA if f.name not in ("path", "mode")]).select(*[f.name for f in SCHEMA])
    write_catalog(rows.coalesce(files) if files else rows, to)


def write_thumbnails(pictures: DataFrame, listing: DataFrame, path: str) -> None:
    """Append thumbnails (path, picture, ratio) to a table under the key of each file's path, size and mtime."""
    pictures.join(listing.select("path", thumbnail_key().alias("key")), "path").select("key", "picture", "ratio").write.mode("append").parquet(path)


def with_thumbnails(listing: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Adds the stored picture and its content ratio, null if there are none for this size and mtime; thumbnails (key, picture, ratio)."""
    once = thumbnails.groupBy("key").agg(F.first("picture").alias("picture"), F.first("ratio").alias("ratio"))
    return listing.withColumn("key", thumbnail_key()).join(once, "key", "left")
