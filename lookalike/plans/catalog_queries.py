"""Queries over the catalog: scans, incremental ingest, mutations, scalar functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lookalike.functions import media, paths
from lookalike.operators import ingest, views
from lookalike.operators.similarity import usable
from lookalike.plans import tables as t
from lookalike.sources import actions, files
from lookalike.sources import media as readers
from lookalike.streaming import events

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {t.CUR} SELECT path, mode, size, phash, resolution FROM cur")
def catalog_current(spark, d):
    return t.current(spark, d, ["size", "phash", "resolution"], None)


@query(f"WITH {t.CUR} SELECT path, size, len(vector) AS frames FROM cur WHERE mode = 'visual' AND len(vector) > 0 AND path = (SELECT min(path) FROM metadata)")
def catalog_point(spark, d):
    first = t.catalog(spark, d).agg(F.min("path").alias("path"))
    rows = ingest.items(t.current_of(spark, d, first, ["size", "vector", "last_scan"]))
    return rows.select("path", "size", F.size("vector").cast("bigint").alias("frames"))


@query(f"WITH {t.CUR} SELECT path, size, mtime, coalesce(watermark, 0.0) AS watermark FROM cur WHERE mode = 'visual' AND path IN (SELECT path FROM clusters)")
def catalog_batch(spark, d):
    rows = t.current_of(spark, d, t.table(spark, d, "clusters"), ["size", "mtime", "watermark"])
    return rows.select("path", "size", "mtime", F.coalesce("watermark", F.lit(0.0)).alias("watermark"))


@query(
    f"""WITH {t.CUR} SELECT path, mode, len(CASE WHEN mode = 'faces' THEN faces ELSE vector END) AS frames, len(dhash) AS hashes,
    round((CASE WHEN mode = 'faces' THEN faces ELSE vector END)[-1][1]::double, 6) AS number, dhash[-1] AS last_hash FROM cur
    WHERE path IN (SELECT path FROM clusters)"""
)
def catalog_vectors(spark, d):
    rows = t.current_of(spark, d, t.table(spark, d, "clusters"), ["vector", "faces", "dhash"], None)
    size = lambda c: F.when(c.isNotNull(), F.size(c)).cast("bigint")
    own = F.when(F.col("mode") == "faces", F.col("faces")).otherwise(F.col("vector"))
    number = F.round(F.get(F.try_element_at(own, F.lit(-1)), F.lit(0)).cast("double"), 6)
    return rows.select("path", "mode", size(own).alias("frames"), size(F.col("dhash")).alias("hashes"), number.alias("number"), F.try_element_at("dhash", F.lit(-1)).alias("last_hash"))


@query("SELECT DISTINCT path FROM metadata WHERE path IS NOT NULL")
def catalog_keys(spark, d):
    return t.catalog(spark, d).select("path").where(F.col("path").isNotNull()).distinct()


_DIFF = f"""WITH {t.LIST}, vis AS (SELECT path, size, mtime, len(vector) > 0 AS has FROM cur WHERE mode = 'visual'),
df AS (SELECT l.path, l.size, l.mtime, CASE WHEN v.path IS NULL THEN 'new' WHEN NOT (l.size IS NOT DISTINCT FROM v.size AND l.mtime IS NOT DISTINCT FROM v.mtime) THEN 'changed'
  WHEN v.has THEN 'hit' ELSE 'vectorless' END AS status FROM lst l LEFT JOIN vis v ON v.path = l.path WHERE l.size > 0)"""


@query(_DIFF + " SELECT path, size, mtime, status FROM df")
def ingest_diff(spark, d):
    return ingest.diff(t.listing(spark, d), t.current(spark, d, ["size", "mtime", "vector"]))


@query(_DIFF + " SELECT path, size, mtime FROM df WHERE status <> 'hit'")
def ingest_pending(spark, d):
    return ingest.pending(t.listing(spark, d), t.current(spark, d, ["size", "mtime", "vector"]))


@query(f"WITH {t.CUR} SELECT path, size, resolution, duration, len(vector) AS frames FROM cur WHERE mode = 'visual' AND len(vector) > 0")
def ingest_items(spark, d):
    rows = ingest.items(t.current(spark, d, ["size", "resolution", "duration", "vector", "last_scan"]))
    return rows.select("path", "size", "resolution", "duration", F.size("vector").cast("bigint").alias("frames"))


@query(
    """WITH u AS (SELECT path, last_scan, size, coalesce(len(vector), -1) AS frames FROM metadata WHERE mode = 'visual' AND path IS NOT NULL
  UNION ALL SELECT path, last_scan, size, len(faces) FROM metadata WHERE mode = 'faces' AND len(faces) > 0 AND path IS NOT NULL)
SELECT path, size, frames FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_scan DESC NULLS LAST, size DESC NULLS LAST, frames DESC) AS rn FROM u) WHERE rn = 1"""
)
def catalog_upsert(spark, d):
    rows = t.catalog(spark, d)
    stored = rows.where("mode = 'visual'").select("path", "mode", "last_scan", "size", "vector")
    fresh = rows.where("mode = 'faces'").select("path", F.lit("visual").alias("mode"), "last_scan", "size", F.col("faces").alias("vector"))
    frames = F.when(F.col("vector").isNull(), -1).otherwise(F.size("vector")).cast("bigint")
    both = ingest.upsert(stored.withColumn("frames", frames), fresh.withColumn("frames", frames), ["size", "frames"])
    return both.select("path", "size", "frames")


@query(f"WITH {t.CUR}, {t.LAST} SELECT path, mode, size FROM cur WHERE path NOT IN (SELECT path FROM gone)")
def catalog_delete(spark, d):
    return ingest.delete(t.current(spark, d, ["size"], None), events.removed(t.table(spark, d, "fs_log")))


@query(
    f"""WITH {t.CUR}, mv AS (SELECT path AS src, max('/vol/kept/' || {t.name()}) AS dst FROM clusters WHERE path IS NOT NULL AND NOT coalesce(is_ref, false) GROUP BY 1)
SELECT path, mode, size FROM (SELECT coalesce(dst, cur.path) AS path, mode, size,
  row_number() OVER (PARTITION BY coalesce(dst, cur.path), mode ORDER BY last_scan DESC NULLS LAST, src DESC NULLS LAST) AS n FROM cur LEFT JOIN mv ON cur.path = src) WHERE n = 1"""
)
def catalog_move(spark, d):
    moving = t.table(spark, d, "clusters").where(F.col("path").isNotNull() & ~F.coalesce("is_ref", F.lit(False)))
    moves = moving.select(F.col("path").alias("src"), F.concat(F.lit("/vol/kept/"), paths.basename()).alias("dst"))
    return ingest.move(t.current(spark, d, ["size", "last_scan"], None), moves).select("path", "mode", "size")


@query(f"WITH {t.LIST} SELECT path, mode, size FROM cur WHERE path IN (SELECT path FROM lst)")
def orphan_gc(spark, d):
    return ingest.collect_orphans(t.current(spark, d, ["size"], None), t.listing(spark, d))


@query("SELECT mode, count(*) AS n FROM metadata WHERE mode <> 'faces' GROUP BY 1")
def purge_mode(spark, d):
    return ingest.purge(t.catalog(spark, d), "faces").groupBy("mode").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT path, {t.name()} AS name, regexp_replace(path, '/[^/]*$', '') AS folder, {t.suffix()} AS suffix, {t.kind()} AS kind FROM metadata")
def path_parts(spark, d):
    return t.catalog(spark, d).select("path", paths.basename().alias("name"), paths.parent().alias("folder"), paths.suffix().alias("suffix"), paths.kind().alias("kind")).distinct()


@query("SELECT DISTINCT path, (path = '/vol/intake' OR starts_with(path, '/vol/intake/')) AS is_ref FROM clusters WHERE path IS NOT NULL")
def path_under(spark, d):
    return t.table(spark, d, "clusters").where(F.col("path").isNotNull()).select("path", paths.under("path", "/vol/intake/").alias("is_ref")).distinct()


PROTECTED, DISLIKED = ["archive", "wedding", "family"], ["backup 2", "exports", "old disk", "unsorted", "phone"]


def _segments(names):
    return "(" + " OR ".join(f"contains('/' || lower(path) || '/', '/{n}/')" for n in names) + ")"


@query(f"SELECT DISTINCT path, {_segments(PROTECTED)} AS protected, {_segments(DISLIKED)} AS disliked FROM metadata WHERE path IS NOT NULL")
def path_lists(spark, d):
    rows = t.catalog(spark, d).where(F.col("path").isNotNull())
    return rows.select("path", paths.holds_segment("path", PROTECTED).alias("protected"), paths.holds_segment("path", DISLIKED).alias("disliked")).distinct()


@query(
    """SELECT DISTINCT a AS path, CASE WHEN f = '' THEN '/' ELSE f END AS normal FROM (SELECT a, list_reduce(list_prepend('', string_split(a, '/')),
  lambda acc, x: CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END) AS f FROM edges WHERE a <> '')"""
)
def path_normal(spark, d):
    return t.table(spark, d, "edges").where("a <> ''").select(F.col("a").alias("path"), paths.normal("a").alias("normal")).distinct()


@query(f"SELECT DISTINCT resolution, CASE WHEN {t.sized()} THEN {t.side(1)} END AS w, CASE WHEN {t.sized()} THEN {t.side(2)} END AS h, {t.area()} AS area FROM metadata")
def resolution_parts(spark, d):
    s = media.sides()
    return t.catalog(spark, d).select("resolution", s["w"].alias("w"), s["h"].alias("h"), media.area().alias("area")).distinct()


@query(
    f"""WITH {t.CUR}, {t.RATIO} SELECT path, round({t.penalty()}, 9) AS penalty, round({t.EFFECTIVE}, 4) AS effective_area, {t.BUCKET} AS bucket, round({t.SMART}, 4) AS smart, round({t.QUALITY}, 4) AS quality,
  round({t.WITHIN_BARS}, 4) AS within_bars, round({t.WITHIN_BARS} + {t.num('sharpness')}, 4) AS quality_within_bars
FROM cur JOIN rat USING (path) WHERE mode = 'visual'"""
)
def quality_scores(spark, d):
    rows = t.current(spark, d, ["size", "resolution", "duration", "sharpness", "watermark"]).join(t.content_ratios(spark, d), "path")
    effective, ratio = media.effective_area(), F.col("content_ratio")
    return rows.select(
        "path", F.round(media.penalty(), 9).alias("penalty"), F.round(effective, 4).alias("effective_area"), media.bucket(effective).alias("bucket"),
        F.round(media.smart_score(), 4).alias("smart"), F.round(media.quality_score(), 4).alias("quality"),
        F.round(media.effective_area(content_ratio=ratio), 4).alias("within_bars"), F.round(media.quality_score(ratio), 4).alias("quality_within_bars"),
    )


@query(
    f"""WITH {t.MEM} SELECT cluster_id, path, printf('%.1f MB', size / 1048576.0) AS size_mb, printf('%02d:%02d', floor({t.num('duration')})::bigint // 60, floor({t.num('duration')})::bigint % 60) AS length,
  round(round(similarity * 1000, 6)) / 10 AS percent FROM mem"""
)
def display_columns(spark, d):
    rows = t.members(spark, d)
    return rows.select("cluster_id", "path", media.size_mb().alias("size_mb"), media.minutes_seconds().alias("length"), media.similarity_percent().alias("percent"))


@query(
    """SELECT i AS slider, round(0.30 + 0.45 * i / 100, 6) AS visual_bar, round(greatest(0, 0.30 + 0.45 * i / 100 - 0.18), 6) AS visual_prefilter, round(0.42 + 0.30 * i / 100, 6) AS faces_bar
  FROM (SELECT unnest(range(101)) AS i)"""
)
def slider_bars(spark, d):
    rows = [(i, *(round(x, 6) for x in (*media.bars(i / 100), media.bars(i / 100, "faces")[0]))) for i in range(101)]
    return spark.createDataFrame(rows, "slider bigint, visual_bar double, visual_prefilter double, faces_bar double")


@query(
    """SELECT event_id, printf('%02d:%02d:%02d', user_id // 3600, user_id // 60 % 60, user_id % 60) AS took, CASE WHEN user_id + event_id > 0 THEN floor(user_id * 100 / (user_id + event_id))::int ELSE 0 END AS percent,
  least(100.0, greatest(0.0, value)) AS clamped FROM events"""
)
def scan_progress(spark, d):
    rows = t.table(spark, d, "events")
    user, event = F.col("user_id"), F.col("event_id")
    return rows.select(
        "event_id", media.hours_minutes_seconds(user).alias("took"), media.percent(user, user + event).alias("percent"),
        media.clamp(F.col("value"), 0.0, 100.0).alias("clamped"),
    )


_PRINT = "concat_ws('_', path, size::varchar, round(mtime * 1000)::bigint::varchar)"


@query(
    f"""WITH {t.CUR} SELECT count(*) AS files, bit_xor(('0x' || substr(md5({_PRINT}), 1, 15))::bigint) AS high, bit_xor(('0x' || substr(md5({_PRINT}), 16, 15))::bigint) AS low
FROM cur WHERE mode = 'visual'"""
)
def state_fingerprint(spark, d):
    """Independent of order and combined before the shuffle, where the reference hashes one long text."""
    digest = F.md5(F.concat_ws("_", "path", F.col("size").cast("string"), F.round(F.col("mtime") * 1000).cast("bigint").cast("string")))
    part = lambda at: F.bit_xor(F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint"))
    return t.current(spark, d, ["size", "mtime"]).agg(F.count("*").alias("files"), part(1).alias("high"), part(16).alias("low"))


@query(f"WITH {t.CUR} SELECT path, md5(concat_ws('|', path, size::varchar, round(mtime * 1000)::bigint::varchar)) AS key FROM cur WHERE mode = 'visual'")
def thumbnail_keys(spark, d):
    return t.current(spark, d, ["size", "mtime"]).select("path", media.thumbnail_key().alias("key"))


_GOOD = "coalesce(len(vector) > 0 AND list_bool_and(list_transform(vector, lambda v: v IS NOT NULL AND len(v) = 64 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0)))), false)"


@query(f"WITH {t.CUR} SELECT path, {_GOOD} AS usable FROM cur WHERE mode = 'visual'")
def finite_vectors(spark, d):
    return t.current(spark, d, ["vector"]).select("path", usable("vector", t.DIMS).alias("usable"))


@query("SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS hash FROM documents WHERE text <> ''")
def content_hashes(spark, d):
    """Every text as a file in the shared folder, listed and hashed there."""
    rows = t.table(spark, d, "documents").where("text <> ''")
    folder = t.as_files(rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")), "texts")
    found = files.hashed(files.listing(spark, [folder], [".TXT"]))
    return found.select(F.substring_index(paths.basename(), ".", 1).cast("bigint").alias("doc_id"), "size", F.col("phash").alias("hash"))


@query("SELECT vec_id, label, 246::bigint AS size FROM embeddings WHERE label <> 3")
def listing_files(spark, d):
    """Pictures in a folder for each label: one is hidden, and in each lie a hidden, an empty and another file."""
    rows = t.table(spark, d, "embeddings")
    place = F.concat(F.when(F.col("label") == 3, ".").otherwise(""), F.lit("label"), F.col("label").cast("string"), F.lit("/"))
    stills = t.bitmaps(rows.select(F.concat(place, F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 2 == 0, ".BMP").otherwise(".bmp")).alias("name"), "embedding"))
    others = rows.select(place.alias("place")).distinct()
    for name, content in ((".hidden.bmp", b"x"), ("empty.bmp", b""), ("notes.txt", b"x")):
        stills = stills.union(others.select(F.concat("place", F.lit(name)), F.lit(content)))
    folder = t.as_files(stills, "listed")
    found = files.listing(spark, [folder, folder + "/label1", folder + "/gone"], ["bmp"])
    return found.select(F.regexp_extract("path", r"(\d+)\.[^.]+$", 1).cast("bigint").alias("vec_id"), F.regexp_extract("path", r"label(\d+)/", 1).cast("int").alias("label"), "size")


@query(
    """WITH e AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT 'deleted' AS status, sum(n)::bigint AS files FROM e WHERE label = 1 UNION ALL SELECT 'failed', 1
  UNION ALL SELECT 'trashed', sum(n)::bigint FROM e WHERE label = 2 UNION ALL SELECT 'moved', sum(n)::bigint FROM e WHERE label = 4 UNION ALL SELECT 'left', sum(n)::bigint FROM e WHERE label NOT IN (1, 2)"""
)
def file_actions(spark, d):
    """Files of one label are deleted, of another trashed, of a third moved; one path to delete isn't there."""
    rows = t.table(spark, d, "embeddings")
    name = F.concat(F.lit("label"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".bin"))
    folder = t.as_files(rows.select(name, F.lit(b"x")), "actions")
    listed = files.listing(spark, [folder])
    label = lambda k: listed.where(F.col("path").contains(f"/label{k}/"))
    gone = actions.delete(label(1).select("path").union(spark.createDataFrame([(folder + "/none",)], "path string"))).select("status")
    away = actions.trash(label(2), folder + "/.trash").select(F.lit("trashed").alias("status"))
    moved = actions.move(views.move_plan(label(4), folder + "/kept")).select("status")
    left = t.staged(files.listing(spark, [folder]).select(F.lit("left").alias("status")))
    return gone.union(away).union(moved).union(left).groupBy("status").agg(F.count("*").alias("files"))


@query(
    f"""WITH g AS (SELECT vec_id, {t.CELLS} AS g FROM embeddings), {t.SHARP}
SELECT vec_id, '8x8' AS resolution, 1 AS frames, sharpness, dhash FROM sh JOIN dh USING (vec_id)"""
)
def picture_features(spark, d):
    """Every embedding as a picture file of 8 x 8 pixels, listed, decoded and measured."""
    rows = t.table(spark, d, "embeddings")
    folder = t.as_files(t.bitmaps(rows.select(F.concat(F.col("vec_id").cast("string"), F.lit(".bmp")).alias("name"), "embedding")), "pictures")
    found = readers.features(files.listing(spark, [folder]))
    return found.select(F.substring_index(paths.basename(), ".", 1).cast("bigint").alias("vec_id"), "resolution", "frames", F.round("sharpness", 4).alias("sharpness"), F.get("dhash", F.lit(0)).alias("dhash"))


@query(
    f"""WITH g AS (SELECT vec_id, {t.CELLS} AS g FROM embeddings), {t.SHARP},
p AS (SELECT vec_id // 13 AS book, vec_id, row_number() OVER (PARTITION BY vec_id // 13 ORDER BY vec_id) - 1 AS page, count(*) OVER (PARTITION BY vec_id // 13) AS pages FROM g),
s AS (SELECT * FROM p JOIN sh USING (vec_id) JOIN g USING (vec_id) WHERE page IN (0, CASE WHEN pages > 4 THEN floor(pages * 0.10::double) ELSE 0 END, CASE WHEN pages > 4 THEN floor(pages * 0.30::double) ELSE 0 END, CASE WHEN pages > 4 THEN floor(pages * 0.50::double) ELSE 0 END))
SELECT book, count(*)::int AS frames, max(sharpness) AS sharpness, round(arg_min(g[1] / sqrt(g[1] * g[1] + g[2] * g[2]), (-sharpness, page)), 5) AS first FROM s GROUP BY 1"""
)
def book_features(spark, d):
    """Comic books of 13 pages each: sampled pages are measured and the sharpest is embedded, by its first two pixels."""
    rows = t.table(spark, d, "embeddings").select((F.floor(F.col("vec_id") / 13)).alias("book"), "vec_id", "embedding")
    folder = t.as_files(t.books(rows), "books")

    def embedder():
        return lambda stills: [f[0, :2, 0].astype(float) for f in stills]

    found = readers.features(files.listing(spark, [folder], ["cbz"]), embedder)
    first = F.round(F.get(F.get("vector", F.lit(0)), F.lit(0)).cast("double"), 5)
    return found.select(F.substring_index(paths.basename(), ".", 1).cast("bigint").alias("book"), "frames", F.round("sharpness", 4).alias("sharpness"), first.alias("first"))


@query(f"WITH {t.CUR} SELECT path, round({t.side(1)} / {t.side(2)}, 6) AS ratio, CASE WHEN {t.side(1)} / {t.side(2)} >= 1.5 THEN 'TopToBottom' ELSE 'LeftToRight' END AS stacking FROM cur WHERE mode = 'visual' AND {t.sized()}")
def aspect_ratios(spark, d):
    rows = t.current(spark, d, ["resolution"]).where(media.sides().isNotNull())
    return rows.select("path", F.round(media.aspect(), 6).alias("ratio"), media.stacking(media.aspect()).alias("stacking"))


@query(
    f"""WITH {t.CUR} SELECT path, lower(trim(codec)) AS codec, CASE WHEN fps > 0 AND NOT isnan(fps) THEN round(coalesce(len(dhash), 0) * 90 / fps, 6) ELSE 0 END AS duration
FROM cur WHERE mode = 'visual' AND {t.kind()} = 'video'"""
)
def video_facts(spark, d):
    """Duration from the number of frames, of which one in 90 has a hash here, and their rate."""
    rows = t.current(spark, d, ["codec", "fps", "dhash"]).where(paths.kind() == "video")
    facts = readers.film_facts(F.greatest(F.coalesce(F.size("dhash"), F.lit(0)), F.lit(0)) * 90, F.col("fps"), F.col("codec"))
    return rows.select("path", facts["codec"].alias("codec"), F.round(facts["duration"], 6).alias("duration"))


@query("SELECT DISTINCT sz AS picture, mode, greatest(1, round_even(sz * least(1.0, side / greatest(sz, 300.0)), 0))::int AS width FROM (SELECT p_size * 40 AS sz FROM part), (VALUES ('faces', 1024), ('visual', 512), ('exact', 256)) m(mode, side)")
def resize_policy(spark, d):
    """Width of pictures 300 pixels high after fitting them to the longest side of each mode."""
    sizes = t.table(spark, d, "part").select((F.col("p_size") * 40).cast("int").alias("picture")).distinct()

    def fit(batches):
        for batch in batches:
            wide = batch.column("picture").to_pylist()
            for mode in ("faces", "visual", "exact"):
                widths = [readers.fitted(np.zeros((300, w, 1), np.uint8), readers.largest_side(mode)).shape[1] for w in wide]
                yield pa.RecordBatch.from_pydict({"picture": pa.array(wide, pa.int32()), "mode": [mode] * len(wide), "width": pa.array(widths, pa.int32())})

    return sizes.mapInArrow(fit, "picture int, mode string, width int")
