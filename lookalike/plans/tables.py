"""The inputs that the registered queries share, as frames and as SQL."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lookalike.catalog import current_rows
from lookalike.functions import image
from lookalike.sources.media import encode_png

DIMS = 64
SLIDER = 0.65


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "metadata")


def current(spark: SparkSession, folder: str, columns: list[str], mode: str | None = "visual") -> DataFrame:
    return current_rows(catalog(spark, folder), columns, mode)


def current_of(spark: SparkSession, folder: str, paths: DataFrame, columns: list[str], mode: str | None = "visual") -> DataFrame:
    """Current rows of some paths: rows of others are left out before any are combined."""
    return current_rows(catalog(spark, folder).join(paths.select("path").distinct(), "path", "left_semi"), columns, mode)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files as last seen: the current rows of faces mode stand for a fresh listing."""
    return current(spark, folder, ["size", "mtime"], "faces").select("path", "size", "mtime")


FACTS = ["size", "mtime", "phash", "resolution", "duration", "sharpness", "watermark"]


def members(spark: SparkSession, folder: str, columns: list[str] = FACTS) -> DataFrame:
    """Cluster members with their current visual rows; each path once per cluster, pos by similarity."""
    named = table(spark, folder, "clusters").where(F.col("cluster_id").isNotNull() & F.col("path").isNotNull())
    named = named.groupBy("cluster_id", "path").agg(F.max("similarity").alias("similarity"), F.bool_or(F.coalesce("is_ref", F.lit(False))).alias("is_ref"))
    rows = current_of(spark, folder, named, columns).drop("mode")
    pos = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.coalesce("similarity", F.lit(-1.0)).desc(), "path"))
    return named.join(rows, "path").withColumn("pos", pos)


def framed(rows: DataFrame, column: str = "vector") -> DataFrame:
    """rows with the column read as 8 x 8 pictures: bright where a frame of 64 numbers is positive."""
    cell = lambda x: F.greatest(F.lit(0.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)) * 300)
    one = lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice(v, r * 8 + 1, F.lit(8)), cell))
    first = F.get(F.filter(column, lambda v: F.size(v) == DIMS), F.lit(0))
    return rows.withColumn("picture", F.when(first.isNotNull(), one(first))).drop(column)


def content_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content_ratio) of current visual rows, their first frame standing for a thumbnail."""
    return image.measured(framed(current(spark, folder, ["vector"])).drop("mode"), "picture", "content_ratio")


def staged(rows: DataFrame) -> DataFrame:
    from lookalike.session import stage_table

    return stage_table(rows, "rows")


def as_files(rows: DataFrame, name: str) -> str:
    """Write rows (name, content) as files below a new folder that all workers share; the folder."""
    from lookalike.session import new_folder

    folder = new_folder(rows.sparkSession, name)
    at = folder.removeprefix("file://").removeprefix("file:")

    def write(batches):
        import os

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), at)
        for batch in batches:
            for file, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                system.create_dir(os.path.dirname(f"{base}/{file}"), recursive=True)
                with system.open_output_stream(f"{base}/{file}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.toDF("name", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return at


def pixels(embedding: list[float]) -> np.ndarray:
    """64 numbers as an 8 x 8 picture of bytes."""
    return np.clip(np.floor(128.5 + 300 * np.asarray(embedding, np.float64)), 0, 255).astype(np.uint8).reshape(8, 8)


def bitmap(grid: np.ndarray) -> bytes:
    head = b"BM" + (54 + 192).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (8).to_bytes(4, "little") * 2
    return head + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + np.repeat(grid[::-1, :, None], 3, axis=2).tobytes()


def bitmaps(rows: DataFrame) -> DataFrame:
    """(name, content) from (name, embedding)."""

    def draw(batches):
        for batch in batches:
            made = [bitmap(pixels(e)) for e in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(made, pa.binary())], names=["name", "content"])

    return rows.mapInArrow(draw, "name string, content binary")


def books(rows: DataFrame) -> DataFrame:
    """(name, content) of comic book archives from (book, vec_id, embedding), a page for each row."""

    def bind(pages: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for row in pages.sort_by("vec_id").to_pylist():
                z.writestr(f"{row['vec_id']:09d}.png", encode_png(np.repeat(pixels(row["embedding"])[:, :, None], 3, axis=2)))
        return pa.table({"name": [f"{pages.column('book')[0].as_py()}.cbz"], "content": pa.array([out.getvalue()], pa.binary())})

    return rows.groupBy("book").applyInArrow(bind, "name string, content binary")


#: An embedding as the 64 bytes of a picture, and from it, as g of table g, sharpness and frame hash.
CELLS = "list_transform(embedding, lambda x: greatest(0, least(255, floor(128.5 + 300 * x::double))))"
SHARP = """ij AS (SELECT vec_id, g, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, g, unnest(range(64)) AS i FROM g)),
lap AS (SELECT vec_id, y // 2 AS by_, x // 2 AS bx_, g[(CASE WHEN y = 0 THEN 1 ELSE y - 1 END * 8 + x + 1)::int] + g[(CASE WHEN y = 7 THEN 6 ELSE y + 1 END * 8 + x + 1)::int]
  + g[(y * 8 + CASE WHEN x = 0 THEN 1 ELSE x - 1 END + 1)::int] + g[(y * 8 + CASE WHEN x = 7 THEN 6 ELSE x + 1 END + 1)::int] - 4 * g[(y * 8 + x + 1)::int] AS v FROM ij),
sh AS (SELECT vec_id, round(max(v), 4) AS sharpness FROM (SELECT vec_id, by_, bx_, var_pop(v) AS v FROM lap GROUP BY 1, 2, 3) GROUP BY 1),
nine AS (SELECT vec_id, y, j, round(sum(greatest(0, least(8 * j + 8, 9 * x + 9) - greatest(8 * j, 9 * x)) * g[(y * 8 + x + 1)::int]) / 8, 9) AS v FROM ij, (SELECT unnest(range(9)) AS j) GROUP BY 1, 2, 3),
bits AS (SELECT a.vec_id, a.y * 8 + a.j AS k, (b.v > a.v)::int AS bit FROM nine a JOIN nine b ON a.vec_id = b.vec_id AND a.y = b.y AND b.j = a.j + 1),
dh AS (SELECT vec_id, sum(CASE WHEN k = 0 THEN -bit::hugeint * 9223372036854775808 ELSE bit::hugeint << (63 - k)::int END)::bigint AS dhash FROM bits GROUP BY 1)"""
CUR = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, mode ORDER BY last_scan DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST) AS rn
  FROM metadata WHERE path IS NOT NULL AND mode IS NOT NULL) WHERE rn = 1)"""
LIST = CUR + ", lst AS (SELECT path, size, mtime FROM cur WHERE mode = 'faces')"
MEM = (
    CUR
    + """, mem AS (SELECT c.cluster_id, c.path, c.similarity, c.is_ref, u.size, u.mtime, u.phash, u.resolution, u.duration, u.sharpness, u.watermark,
  row_number() OVER (PARTITION BY c.cluster_id ORDER BY coalesce(c.similarity, -1) DESC, c.path) AS pos
  FROM (SELECT cluster_id, path, max(similarity) AS similarity, bool_or(coalesce(is_ref, false)) AS is_ref FROM clusters
        WHERE cluster_id IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2) c JOIN cur u ON u.path = c.path AND u.mode = 'visual')"""
)


def name(p: str = "path") -> str:
    return f"regexp_replace({p}, '^.*/', '')"


def suffix(p: str = "path") -> str:
    return f"lower(regexp_extract({name(p)}, '.\\.([^.]+)$', 1))"


def kind(p: str = "path") -> str:
    s = suffix(p)
    return f"CASE WHEN {s} IN ('jpg','jpeg','png','webp','bmp','heic') THEN 'image' WHEN {s} IN ('mp4','mov','mkv','webm','avi','m4v') THEN 'video' ELSE 'document' END"


def side(i: int, r: str = "resolution") -> str:
    return f"try_cast(trim(string_split(lower(trim({r})), 'x')[{i}]) AS bigint)"


def sized(r: str = "resolution") -> str:
    return f"(len(string_split(lower(trim({r})), 'x')) = 2 AND {side(1, r)} > 0 AND {side(2, r)} > 0)"


def area(r: str = "resolution") -> str:
    return f"(CASE WHEN {sized(r)} THEN {side(1, r)} * {side(2, r)} ELSE 0 END)"


RATIO = """pic AS (SELECT path, list_transform(list_filter(vector, lambda v: len(v) = 64)[1], lambda x: greatest(0.0, CASE WHEN isnan(x) OR x IS NULL THEN 0.0 ELSE x::double END * 300)) AS g
  FROM cur WHERE mode = 'visual'),
lit AS (SELECT path, len(list_filter(range(8), lambda r: list_sum(g[r * 8 + 1 : r * 8 + 8]) / 8 > 8)) / 8.0 * len(list_filter(range(8), lambda c: list_sum(list_transform(range(8), lambda r: g[r * 8 + c + 1])) / 8 > 8)) / 8.0 AS share FROM pic),
rat AS (SELECT path, CASE WHEN share >= 0.4 THEN share ELSE 1.0 END AS content_ratio FROM lit)"""


def num(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR isnan({c}) THEN 0 ELSE {c} END)"


def penalty(c: str = "watermark") -> str:
    return f"(CASE WHEN {num(c)} <= 0.012 THEN 0 ELSE least(0.30, ({num(c)} - 0.012) * 12.0) END)"


EFFECTIVE = f"({area()} * 1.0 * (1.0 - {penalty()}))"
WITHIN_BARS = f"({area()} * content_ratio * (1.0 - {penalty()}))"
BUCKET = f"(CASE WHEN {EFFECTIVE} <= 1 THEN 0.0 ELSE round_even(ln({EFFECTIVE}) / ln(1.12), 0) END)"
SMART = f"({num('size::double')} / 1048576.0 + 50.0 * ({area()} / 1000000.0) + 10.0 * {num('duration')} + CASE WHEN {num('sharpness')} > 0 THEN 20.0 * ln(1 + {num('sharpness')}) ELSE 0 END)"
QUALITY = f"({EFFECTIVE} + {num('sharpness')})"
EVENTS = """ev AS (SELECT ts, path, lower(trim(event_type)) AS kind, received_at FROM fs_log WHERE path IS NOT NULL
  AND lower(trim(event_type)) IN ('created','modified','deleted','moved','closed'))"""
LAST = EVENTS + """, lastev AS (SELECT path, kind, epoch_us(ts) AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, received_at DESC NULLS LAST, kind DESC) AS rn
  FROM ev WHERE ts IS NOT NULL) WHERE rn = 1), gone AS (SELECT path FROM lastev WHERE kind IN ('deleted','moved'))"""
