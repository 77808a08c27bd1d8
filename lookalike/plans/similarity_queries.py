"""Queries of the vector similarity join and its parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lookalike.functions.bits import gradient_hash, least_distance
from lookalike.functions import image
from lookalike.operators import similarity as sim
from lookalike.plans import tables as t
from lookalike.plans.catalog_queries import _GOOD
from lookalike.session import cached_table, result_key
from lookalike.sources import media

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def vector_sql(mode: str = "visual", column: str = "vector") -> str:
    """fr, cen: usable frames and centred frames; nf: frames per path."""
    return f"""{t.CUR}, ok AS (SELECT path, {column} AS vector FROM cur WHERE mode = '{mode}' AND {_GOOD.replace('vector', column)}),
fr AS (SELECT path, unnest(vector) AS vec, unnest(range(len(vector))) AS frame FROM ok),
mean AS (SELECT list(m ORDER BY d) AS mean FROM (SELECT d, avg(x) AS m FROM (SELECT unnest(vec)::double AS x, unnest(range(len(vec))) AS d FROM fr) GROUP BY d)),
cen AS (SELECT path, frame, list_transform(list_zip(vec::double[], mean), lambda z: z[1] - z[2]) AS vec FROM fr, mean),
nf AS (SELECT path, count(*) AS n FROM fr GROUP BY 1)"""


def pairs_sql(least: float, mode: str = "visual", column: str = "vector") -> str:
    return vector_sql(mode, column) + f""", fp AS (SELECT * FROM (SELECT x.path AS a, x.frame AS fa, y.path AS b, y.frame AS fb, list_cosine_similarity(x.vec, y.vec) AS cos
  FROM cen x JOIN cen y ON x.path < y.path) WHERE cos >= {least})"""


BAR, PRE = sim.bars(t.SLIDER)
FACE_BAR, _ = sim.bars(t.SLIDER, "faces")
_VERIFIED = pairs_sql(PRE) + f""", pv AS (SELECT a, b, peak, multi, coverage, peak - 0.25 * (1 - coverage) AS sim FROM (
  SELECT a, b, peak, (x.n > 1 OR y.n > 1) AS multi, CASE WHEN x.n > 1 OR y.n > 1 THEN least(ma, mb) / least(x.n, y.n) ELSE 1.0 END AS coverage
  FROM (SELECT a, b, max(cos) AS peak, count(DISTINCT CASE WHEN cos >= 0.55 THEN fa END) AS ma, count(DISTINCT CASE WHEN cos >= 0.55 THEN fb END) AS mb FROM fp GROUP BY a, b)
  JOIN nf x ON x.path = a JOIN nf y ON y.path = b))"""
_BITS = """hx AS (SELECT path, unnest(dhash) AS h FROM cur WHERE mode = 'visual'), hu AS (SELECT path, h FROM hx WHERE bit_count(h) BETWEEN 5 AND 59)"""
_ACCEPTED = _VERIFIED + f""", {_BITS}, pb AS (SELECT pv.*, (SELECT min(bit_count(xor(p.h, q.h))) FROM hu p, hu q WHERE p.path = pv.a AND q.path = pv.b) AS bits FROM pv),
edge AS (SELECT a, b, sim FROM pb WHERE CASE WHEN multi AND NOT coalesce(bits <= 4, false) AND coverage < 0.30 THEN false WHEN sim >= {BAR} THEN true
  WHEN coalesce(bits <= 4, false) THEN sim >= {BAR} - 0.18 WHEN coalesce(bits <= 6, false) THEN sim >= {BAR} - 0.05 ELSE false END)"""


def items(spark, d, mode="visual"):
    column = "vector" if mode == "visual" else "faces"
    return t.current(spark, d, [column, "dhash"] if mode == "visual" else [column], mode).withColumnRenamed(column, "vector")


@query(f"WITH {vector_sql()} SELECT path, frame, round(vec[1] / sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS first, round(vec[64] / sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS last FROM cen")
def center_norm(spark, d):
    unit = sim.centred(sim.frames(items(spark, d), dims=t.DIMS))
    return unit.select("path", F.col("frame").cast("bigint").alias("frame"), F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(63)), 6).alias("last"))


_EMB = """e AS (SELECT vec_id::varchar AS path, embedding::double[] AS vec FROM embeddings),
mean AS (SELECT list(m ORDER BY d) AS mean FROM (SELECT d, avg(x) AS m FROM (SELECT unnest(vec) AS x, unnest(range(len(vec))) AS d FROM e) GROUP BY d)),
cen AS (SELECT path, list_transform(list_zip(vec, mean), lambda z: z[1] - z[2]) AS vec FROM e, mean)"""


def embedded(spark, d):
    return sim.centred(t.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(0).alias("frame"), F.col("embedding").alias("vec")))


@query(
    f"""WITH {_EMB} SELECT path, other, rank FROM (SELECT x.path, y.path AS other, row_number() OVER (PARTITION BY x.path ORDER BY round(list_cosine_similarity(x.vec, y.vec), 9) DESC, y.path) AS rank
FROM cen x JOIN cen y ON x.path <> y.path) WHERE rank <= 5"""
)
def knn_topk(spark, d):
    return sim.nearest_frames(embedded(spark, d), 5).select("path", "other", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_EMB} SELECT * FROM (SELECT x.path AS a, y.path AS b, round(list_cosine_similarity(x.vec, y.vec), 6) AS cos FROM cen x JOIN cen y ON x.path < y.path) WHERE cos >= 0.3")
def similarity_pairs(spark, d):
    return sim.block_pairs(embedded(spark, d), 0.3 - 5e-7, block=256).select("a", "b", F.round("cos", 6).alias("cos")).where("cos >= 0.3")


@query()
def similarity_pairs_hashed(spark, d):
    """The approximate form for frame counts beyond the exact join."""
    return sim.nearest_frames_hashed(embedded(spark, d), radius=1.1, bucket=1.5, tables=8).select("a", "b", F.round("cos", 6).alias("cos"))


def six_places(c: str) -> Column:
    """A number from 0 to 1 rounded as the SQL rounds it: without the decimals of F.round, which cost more than the rest of a pair's row."""
    return F.floor(F.col(c) * 1e6 + 0.5) / 1e6


@query(f"WITH {_VERIFIED} SELECT a, b, round(peak, 6) AS peak, round(coverage, 6) AS coverage, round(sim, 6) AS sim FROM pv")
def pair_peak_coverage(spark, d):
    pairs = sim.verified(items(spark, d), t.SLIDER, dims=t.DIMS)
    return pairs.select("a", "b", *[six_places(c).alias(c) for c in ("peak", "coverage", "sim")])


@query(f"WITH {_ACCEPTED} SELECT a, b, round(sim, 6) AS sim FROM edge")
def edges_accept_visual(spark, d):
    return sim.edges(items(spark, d), t.SLIDER, dims=t.DIMS).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"WITH {pairs_sql(FACE_BAR, 'faces', 'faces')} SELECT a, b, round(max(cos), 6) AS sim FROM fp GROUP BY 1, 2")
def edges_accept_faces(spark, d):
    return sim.edges(items(spark, d, "faces"), t.SLIDER, "faces", dims=t.DIMS).select("a", "b", F.round("sim", 6).alias("sim"))


@query(
    f"""WITH {t.CUR}, {_BITS}, pr AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM edges WHERE a <> b AND a IN (SELECT path FROM cur WHERE mode = 'visual') AND b IN (SELECT path FROM cur WHERE mode = 'visual'))
SELECT a, b, (SELECT min(bit_count(xor(p.h, q.h))) FROM hu p, hu q WHERE p.path = pr.a AND q.path = pr.b)::int AS bits FROM pr"""
)
def hamming_min(spark, d):
    hashes = t.current(spark, d, ["dhash"]).select("path", "dhash")
    pairs = t.table(spark, d, "edges").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(hashes.toDF("a", "x"), "a").join(hashes.toDF("b", "y"), "b")
    return both.select("a", "b", least_distance("x", "y").alias("bits"))


def _cells():
    return F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.get("embedding", i % 64))


@query(
    """SELECT vec_id, list_reduce(list_prepend(0::bigint, list_transform(range(64), lambda i: CASE WHEN embedding[((i // 8 * 9 + i % 8 + 1) % 64 + 1)::int] > embedding[((i // 8 * 9 + i % 8) % 64 + 1)::int] THEN 1 ELSE 0 END::bigint)),
  lambda h, b: CASE WHEN h >= 4611686018427387904 THEN (h - 9223372036854775808::hugeint) * 2 + b WHEN h < -4611686018427387904 THEN (h + 9223372036854775808::hugeint) * 2 + b ELSE h * 2 + b END::bigint) AS dhash FROM embeddings"""
)
def dhash_bits(spark, d):
    return t.table(spark, d, "embeddings").select("vec_id", gradient_hash(_cells()).alias("dhash"))


@query(
    f"""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, 1200 * x::double)) AS g FROM embeddings), {t.SHARP},
lit AS (SELECT vec_id, len(list_filter(range(8), lambda r: list_sum(g[r * 8 + 1 : r * 8 + 8]) / 8 > 8)) / 8.0 * len(list_filter(range(8), lambda c: list_sum(list_transform(range(8), lambda r: g[r * 8 + c + 1])) / 8 > 8)) / 8.0 AS share FROM g)
SELECT vec_id, sharpness, dhash, CASE WHEN share >= 0.4 THEN share ELSE 1.0 END AS content_ratio FROM sh JOIN dh USING (vec_id) JOIN lit USING (vec_id)"""
)
def image_kernels(spark, d):
    """Every embedding as an 8 x 8 picture, bright where it is positive."""
    cell = lambda x: F.greatest(F.lit(0.0), x.cast("double") * 1200)
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("embedding", r * 8 + 1, F.lit(8)), cell))
    rows = image.measured(t.table(spark, d, "embeddings").select("vec_id", grid.alias("grid")), "grid", "sharpness", "content_ratio", "dhash")
    return rows.withColumn("sharpness", F.round("sharpness", 4))


@query(
    f"""WITH {t.CUR}, ok AS (SELECT path, vector FROM cur WHERE mode = 'visual' AND {_GOOD}),
px AS (SELECT path, i // 8 AS y, i % 8 AS x, stddev_pop(128 + 600 * v[i + 1]::double) AS sd, avg(128 + 600 * v[i + 1]::double) AS m FROM (SELECT path, v, unnest(range(64)) AS i FROM (SELECT path, unnest(vector) AS v FROM ok WHERE len(vector) >= 3)) GROUP BY 1, 2, 3),
ed AS (SELECT *, avg(sd) OVER (PARTITION BY path) AS motion, abs(coalesce(lead(m) OVER (PARTITION BY path, y ORDER BY x) - m, 0)) + abs(coalesce(lead(m) OVER (PARTITION BY path, x ORDER BY y) - m, 0)) AS edge FROM px),
sc AS (SELECT path, CASE WHEN min(motion) < 8 THEN 0.0 ELSE avg((sd < 0.35 * motion AND edge > 18)::int) END AS watermark FROM ed GROUP BY 1)
SELECT path, round(coalesce(watermark, 0.0), 6) AS watermark FROM ok LEFT JOIN sc USING (path)"""
)
def watermark_scores(spark, d):
    """Static marks over the frames of current visual rows, their vectors read as 8 x 8 pictures."""
    ok = items(spark, d).where(sim.usable("vector", t.DIMS))
    grids = F.transform("vector", lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice(v, r * 8 + 1, F.lit(8)), lambda x: 128 + 600 * x.cast("double"))))
    return image.measured(ok.select("path", grids.alias("film")), "film", "watermark").withColumn("watermark", F.round("watermark", 6))


@query(f"WITH {_ACCEPTED} SELECT a, b, round(sim, 6) AS sim FROM edge")
def edges_cached(spark, d):
    """The similarity graph under a name that follows the files and the settings: made once, then read."""
    key = result_key(t.current(spark, d, ["size", "mtime"]), "visual", t.SLIDER)
    found = cached_table(lambda: edges_accept_visual(spark, d), key, "edges-visual", spark)
    return found.select("a", "b", "sim")


@query()
def edges_by_cells(spark, d):
    """The similarity graph of all pairs of cells, as it is made at every size: no pair is missed."""
    return edges_accept_visual(spark, d)


def _indices_sql(sort: str, n: str) -> str:
    some = ", ".join(f"({n} * {s})::decimal(20, 6)" for s in media.SHARES[sort])
    some = f"list_distinct([{', '.join(f'floor({n} * {s}::double)::int' for s in media.SHARES[sort])}])"
    short = f"CASE WHEN {n} > 0 THEN [0] ELSE []::int[] END"
    return f"CASE WHEN {n} > {media.SHORT[sort]} THEN {some} ELSE {short} END"


_N = "coalesce(len(dhash), 0) * 7"


@query(
    f"""WITH {t.CUR} SELECT path, array_to_string(list_sort(CASE WHEN {t.kind()} = 'video' THEN {_indices_sql('video', _N)} WHEN {t.suffix()} = 'gif' THEN {_indices_sql('gif', _N)}
  WHEN {t.suffix()} = 'cbz' THEN {_indices_sql('cbz', _N)} ELSE {_indices_sql('pdf', _N)} END), ',') AS frames FROM cur WHERE mode = 'visual' AND {t.kind()} <> 'image'"""
)
def frame_sampling(spark, d):
    from lookalike.functions.paths import kind, suffix

    n = F.greatest(F.coalesce(F.size("dhash"), F.lit(0)), F.lit(0)) * 7
    picked = F.when(kind() == "video", media.sampled(n, "video")).when(suffix() == "gif", media.sampled(n, "gif")).when(suffix() == "cbz", media.sampled(n, "cbz")).otherwise(media.sampled(n, "pdf"))
    rows = t.current(spark, d, ["dhash"]).where(kind() != "image")
    return rows.select("path", F.array_join(F.array_sort(picked).cast("array<string>"), ",").alias("frames"))


@query(
    f"""WITH {t.CUR}, h AS (SELECT path, lower(phash) AS phash FROM cur WHERE mode = 'visual' AND regexp_full_match(phash, '[0-9a-fA-F]{{64}}')),
g AS (SELECT phash, min(path) AS first, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1) SELECT path, first, copies FROM h JOIN g USING (phash)"""
)
def exact_duplicates(spark, d):
    rows = t.current(spark, d, ["phash"]).where(F.col("phash").rlike("^[0-9a-fA-F]{64}$")).select("path", F.lower("phash").alias("phash"))
    groups = rows.groupBy("phash").agg(F.min("path").alias("first"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    return rows.join(groups, "phash").select("path", "first", "copies")
