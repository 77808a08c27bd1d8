"""Queries over clusters: leader clustering, labels, keepers, views, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookalike.operators import annotate, clustering, keepers, views
from lookalike.operators import similarity as sim
from lookalike.plans import similarity_queries as s
from lookalike.plans import tables as t
from lookalike.plans.catalog_queries import DISLIKED, PROTECTED, _segments
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


# Leaders in SQL: over files in rank order, one leads if no leader before it is a neighbour.
_LEAD = s._ACCEPTED.replace("WITH ", "") + """, nb AS (SELECT a AS u, b AS v, sim FROM edge UNION ALL SELECT b, a, sim FROM edge),
rk AS (SELECT path, row_number() OVER (ORDER BY coalesce(size, 0) DESC, path) AS r FROM cur WHERE mode = 'visual' AND path IN (SELECT u FROM nb)),
adj AS (SELECT x.r, list(y.r) AS up FROM nb JOIN rk x ON x.path = u JOIN rk y ON y.path = v WHERE y.r < x.r GROUP BY 1),
walk AS (SELECT 0::bigint AS r, []::bigint[] AS heads UNION ALL
  SELECT w.r + 1, CASE WHEN a.up IS NOT NULL AND list_has_any(w.heads, a.up) THEN w.heads ELSE list_append(w.heads, w.r + 1) END
  FROM walk w LEFT JOIN adj a ON a.r = w.r + 1 WHERE w.r < (SELECT count(*) FROM rk)),
hd AS (SELECT unnest(heads) AS r FROM walk WHERE r = (SELECT count(*) FROM rk)),
mb AS (SELECT u AS path, arg_min(v, y.r) AS leader, arg_min(sim, y.r) AS similarity FROM nb JOIN rk x ON x.path = u JOIN rk y ON y.path = v
  WHERE y.r IN (SELECT r FROM hd) AND x.r NOT IN (SELECT r FROM hd) GROUP BY 1),
cl AS (SELECT leader, path, similarity FROM mb UNION ALL SELECT DISTINCT leader, leader, 1.0 FROM mb)"""


def clusters(spark, d):
    rows = t.current(spark, d, ["vector", "dhash", "size"])
    sizes = t.current(spark, d, ["size"]).select("path", "size")
    return clustering.leaders(sim.edges(rows, t.SLIDER, dims=t.DIMS), sizes), sizes


@query(f"WITH RECURSIVE {_LEAD} SELECT leader, path, round(similarity, 6) AS similarity FROM cl")
def leader_clusters(spark, d):
    return clusters(spark, d)[0].select("leader", "path", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH RECURSIVE {_LEAD}, num AS (SELECT leader, row_number() OVER (ORDER BY coalesce(size, 0) DESC, leader) AS cluster_id FROM (SELECT DISTINCT leader FROM cl) JOIN cur ON cur.path = leader AND mode = 'visual'),
m AS (SELECT cluster_id, c.path, c.similarity, row_number() OVER (PARTITION BY cluster_id ORDER BY c.path = leader DESC, c.similarity DESC, c.path) AS pos, phash, resolution, size,
  {t.area()} AS area, CASE WHEN {t.sized()} THEN {t.side(1)} / {t.side(2)} END AS ratio FROM cl c JOIN num USING (leader) JOIN cur u ON u.path = c.path AND u.mode = 'visual'),
w AS (SELECT *, first(path) OVER p AS b_path, first(phash) OVER p AS b_hash, first(area) OVER p AS b_area, first(ratio) OVER p AS b_ratio,
  row_number() OVER (PARTITION BY cluster_id ORDER BY area DESC, coalesce(size, 0) DESC, pos) AS best FROM m WINDOW p AS (PARTITION BY cluster_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT cluster_id, path, pos, round(similarity, 6) AS similarity, CASE WHEN path = b_path THEN 'reference' WHEN coalesce(abs(ratio - b_ratio) <= 0.03 * b_ratio AND area <> b_area, false) THEN 'quality'
  WHEN coalesce(phash = b_hash AND phash <> '', false) THEN 'exact' ELSE 'semantic' END AS dup_kind, best = 1 AS keep_priority FROM w"""
)
def duplicate_report(spark, d):
    """The whole way from catalog to labelled clusters."""
    found, sizes = clusters(spark, d)
    facts = t.current(spark, d, ["phash", "resolution", "size"]).drop("mode")
    members = clustering.numbered(found, sizes).join(facts, "path")
    labelled = annotate.keep_priority(annotate.dup_kind(members))
    return labelled.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), "path", F.col("pos").cast("bigint").alias("pos"), F.round("similarity", 6).alias("similarity"), "dup_kind", "keep_priority")


def labelled_sql(extra: str = "") -> str:
    return f"""WITH {t.MEM}, r AS (SELECT *, {t.area()} AS area, CASE WHEN {t.sized()} THEN {t.side(1)} / {t.side(2)} END AS ratio FROM mem),
w AS (SELECT *, first(path) OVER p AS b_path, first(phash) OVER p AS b_hash, first(area) OVER p AS b_area, first(ratio) OVER p AS b_ratio,
  row_number() OVER (PARTITION BY cluster_id ORDER BY area DESC, coalesce(size, 0) DESC, pos) AS best FROM r WINDOW p AS (PARTITION BY cluster_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(
    labelled_sql()
    + """ SELECT cluster_id, path, CASE WHEN path = b_path THEN 'reference' WHEN coalesce(abs(ratio - b_ratio) <= 0.03 * b_ratio AND area <> b_area, false) THEN 'quality'
  WHEN coalesce(phash = b_hash AND phash <> '', false) THEN 'exact' ELSE 'semantic' END AS dup_kind FROM w"""
)
def dup_kind(spark, d):
    return annotate.dup_kind(t.members(spark, d)).select("cluster_id", "path", "dup_kind")


@query(labelled_sql() + " SELECT cluster_id, path, best = 1 AS keep_priority FROM w")
def keep_priority(spark, d):
    return annotate.keep_priority(t.members(spark, d)).select("cluster_id", "path", "keep_priority")


@query(
    f"""WITH {t.MEM} SELECT cluster_id, count(*) AS files, sum(coalesce(size, 0))::bigint AS bytes, coalesce(string_agg(DISTINCT upper(nullif({t.suffix()}, '')), ', ' ORDER BY upper(nullif({t.suffix()}, ''))), '') AS formats,
  round(avg(similarity), 6) AS similarity FROM mem GROUP BY 1"""
)
def cluster_summary(spark, d):
    return clustering.summary(t.members(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH {t.MEM}, {t.LAST}, rest AS (SELECT * FROM mem WHERE path NOT IN (SELECT path FROM gone)), n AS (SELECT cluster_id, count(*) AS files, sum(coalesce(size, 0))::bigint AS bytes FROM rest GROUP BY 1 HAVING count(*) > 1)
SELECT cluster_id, path, size, files, bytes FROM rest JOIN n USING (cluster_id)"""
)
def prune_reaggregate(spark, d):
    return clustering.pruned(t.members(spark, d), events.removed(t.table(spark, d, "fs_log")))


@query(
    f"""WITH {t.MEM}, k AS (SELECT {t.kind()} AS kind, coalesce(size, 0) AS size, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) > 1 AS dup FROM mem),
g AS (SELECT kind, count(*) AS files, sum(size)::bigint AS bytes, sum(dup::int)::bigint AS dups FROM k GROUP BY 1) SELECT *, (files * 100 // (SELECT sum(files) FROM g))::int AS share FROM g"""
)
def kind_statistics(spark, d):
    return views.statistics(t.members(spark, d))


_CHECKED = "chk AS (SELECT DISTINCT path FROM clusters WHERE dup_kind = 'exact' AND path IS NOT NULL)"


def checked(spark, d):
    return t.table(spark, d, "clusters").where((F.col("dup_kind") == "exact") & F.col("path").isNotNull()).select("path").distinct()


@query(f"WITH {t.MEM}, {_CHECKED}, v AS (SELECT DISTINCT path, size FROM mem WHERE path IN (SELECT path FROM chk) AND {t.suffix()} IN ('jpg','jpeg','png','webp','bmp','heic')) SELECT count(*) AS files, coalesce(sum(size), 0)::bigint AS bytes FROM v")
def savings(spark, d):
    return views.savings(views.visible(t.members(spark, d), "image"), checked(spark, d))


@query(f"WITH {t.CUR}, {_CHECKED} SELECT count(*) AS files, coalesce(sum(size), 0)::bigint AS bytes FROM cur WHERE mode = 'visual' AND path IN (SELECT path FROM chk)")
def delete_preview(spark, d):
    return views.savings(t.current(spark, d, ["size"]), checked(spark, d))


@query(
    f"""WITH {t.MEM}, {_CHECKED} SELECT cluster_id, CASE WHEN bool_and(c.path IS NOT NULL) THEN 'all' WHEN bool_or(c.path IS NOT NULL) THEN 'some' ELSE 'none' END AS state
FROM mem LEFT JOIN chk c ON c.path = mem.path WHERE NOT is_ref GROUP BY 1"""
)
def tri_state(spark, d):
    return views.check_states(t.members(spark, d), checked(spark, d))


@query(f"WITH {t.MEM} SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM mem")
def watched_folders(spark, d):
    return views.watched(t.members(spark, d))


@query(f"WITH {t.MEM} SELECT cluster_id, path, pos, row_number() OVER (PARTITION BY cluster_id ORDER BY is_ref DESC, pos) AS place, ((row_number() OVER (PARTITION BY cluster_id ORDER BY is_ref DESC, pos) - 1) // 2)::int AS page FROM mem")
def compare_pages(spark, d):
    return annotate.pages(t.members(spark, d)).select("cluster_id", "path", F.col("pos").cast("bigint").alias("pos"), F.col("place").cast("bigint").alias("place"), "page")


@query(
    f"""WITH {t.CUR} SELECT path, greatest(0, least(coalesce(len(dhash), 0) * 70 // 100, coalesce(len(dhash), 0) - 1))::int AS at70, greatest(0, least(3, coalesce(len(dhash), 0) - 1))::int AS held
FROM cur WHERE mode = 'visual'"""
)
def frame_index(spark, d):
    n = F.greatest(F.coalesce(F.size("dhash"), F.lit(0)), F.lit(0))
    rows = t.current(spark, d, ["dhash"])
    return rows.select("path", annotate.nearest_index(n, F.lit(70)).alias("at70"), annotate.held_index(n, F.lit(3)).alias("held"))


@query(
    f"""WITH {t.MEM}, m2 AS (SELECT *, (path = '/vol/intake' OR starts_with(path, '/vol/intake/')) AS inside FROM mem), g AS (SELECT cluster_id FROM m2 GROUP BY 1 HAVING bool_or(inside) AND bool_or(NOT inside))
SELECT cluster_id, path, inside AS is_ref FROM m2 WHERE cluster_id IN (SELECT cluster_id FROM g)"""
)
def dual_root_clusters(spark, d):
    return annotate.crossing(annotate.reference(t.members(spark, d), "/vol/intake")).select("cluster_id", "path", "is_ref")


@query(f"WITH {t.MEM} SELECT cluster_id, path FROM mem WHERE {t.suffix()} IN ('mp4','mov','mkv','webm','avi','m4v') AND (contains(lower({t.name()}), 'copy') OR contains('cluster ' || cluster_id, 'copy'))")
def view_filter_search(spark, d):
    return views.visible(t.members(spark, d), "video", "Copy").select("cluster_id", "path")


def sort_sql(key: str) -> str:
    return f"""WITH {t.MEM}, k AS (SELECT *, {key} AS key FROM mem), h AS (SELECT cluster_id, row_number() OVER (ORDER BY key DESC NULLS LAST, cluster_id) AS group_pos FROM k WHERE pos = 1)
SELECT cluster_id, path, row_number() OVER (PARTITION BY cluster_id ORDER BY key DESC NULLS LAST, path) AS pos_in_group, group_pos FROM k JOIN h USING (cluster_id)"""


def _sorted(by):
    def run(spark, d):
        rows = views.ordered(t.members(spark, d), by, descending=True)
        return rows.select("cluster_id", "path", F.col("pos_in_group").cast("bigint").alias("pos_in_group"), F.col("group_pos").cast("bigint").alias("group_pos"))

    return run


for _by, _key in {"path": "path", "suffix": t.suffix(), "similarity": "similarity", "size": "coalesce(size, 0)", "resolution": t.area(), "mtime": "coalesce(mtime, 0)"}.items():
    Q[f"view_sort_{_by}"] = _sorted(_by)
    SQL[f"view_sort_{_by}"] = sort_sql(_key)


def keeper_sql(order: str, tier: str = "1") -> str:
    return f"WITH {t.MEM}, k AS (SELECT cluster_id, path, row_number() OVER (PARTITION BY cluster_id ORDER BY {tier}, {order}, path) AS rn, count(*) OVER (PARTITION BY cluster_id) AS n FROM mem)"


_KEPT = " SELECT cluster_id, path FROM k WHERE rn = 1 AND n > 1"
_CASCADE = f"{t.BUCKET} DESC, coalesce(size, 0) DESC, {t.num('mtime')}"
_ORDERS = {
    "keeper_cascade": (_CASCADE, "cascade", {}),
    "keeper_cascade_newer": (_CASCADE + " DESC", "cascade", {"keep_newer": "yes"}),
    "keeper_quality": (f"round({t.QUALITY}, 6) DESC", "quality", {}),
    "keeper_size": ("coalesce(size, 0) DESC", "size", {}),
    "keeper_date": ("coalesce(mtime, 'infinity'::double)", "date", {}),
    "keeper_smart": (f"round({t.SMART}, 6) DESC", "smart", {}),
}
for _name, (_order, _strategy, _options) in _ORDERS.items():
    Q[_name] = lambda spark, d, strategy=_strategy, options=_options: keepers.keepers(t.members(spark, d), strategy, **options)
    SQL[_name] = keeper_sql(_order) + _KEPT

for _name, _order, _strategy in (("keeper_letterbox", _CASCADE.replace(t.EFFECTIVE, t.WITHIN_BARS), "cascade"), ("keeper_quality_letterbox", f"round({t.WITHIN_BARS} + {t.num('sharpness')}, 6) DESC", "quality")):
    Q[_name] = lambda spark, d, strategy=_strategy: keepers.keepers(t.members(spark, d).join(t.content_ratios(spark, d), "path"), strategy)
    SQL[_name] = f"WITH {t.MEM}, {t.RATIO}, k AS (SELECT cluster_id, path, row_number() OVER (PARTITION BY cluster_id ORDER BY {_order}, path) AS rn, count(*) OVER (PARTITION BY cluster_id) AS n FROM mem JOIN rat USING (path))" + _KEPT

_TIER = f"CASE WHEN {_segments(PROTECTED)} THEN 0 WHEN {_segments(DISLIKED)} THEN 2 ELSE 1 END"


@query(keeper_sql(_CASCADE, _TIER) + _KEPT)
def keeper_dir_overlay(spark, d):
    return keepers.keepers(t.members(spark, d), "cascade", protected=PROTECTED, disliked=DISLIKED)


@query(keeper_sql(_CASCADE) + " SELECT k.cluster_id, k.path FROM k JOIN mem ON mem.cluster_id = k.cluster_id AND mem.path = k.path WHERE rn > 1 AND n > 1 AND NOT is_ref")
def mark_for_delete(spark, d):
    return keepers.marked(t.members(spark, d)).select("cluster_id", "path")


@query(
    f"""WITH {t.MEM}, v AS (SELECT * FROM mem WHERE {t.suffix()} IN ('jpg','jpeg','png','webp','bmp','heic')),
k AS (SELECT cluster_id, path, is_ref, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(size, 0) DESC, path) AS rn FROM v) SELECT cluster_id, path FROM k WHERE rn > 1 AND NOT is_ref"""
)
def mark_visible(spark, d):
    """Only what a view shows is ranked and marked."""
    return keepers.marked(views.visible(t.members(spark, d), "image"), "size").select("cluster_id", "path")


@query(f"WITH {t.MEM}, {_CHECKED} SELECT path FROM chk UNION SELECT path FROM mem WHERE NOT is_ref AND cluster_id <= 10")
def selection_toggle(spark, d):
    rows = t.members(spark, d)
    return views.toggled(checked(spark, d), rows, rows.where("cluster_id <= 10"), True)


@query(
    f"""WITH {t.CUR}, {_CHECKED} SELECT path AS src, '/vol/kept/' || {t.name()} AS dst, CASE WHEN row_number() OVER (PARTITION BY {t.name()} ORDER BY path) = 1 THEN 'moved' ELSE 'failed' END AS status
FROM cur WHERE mode = 'visual' AND path IN (SELECT path FROM chk)"""
)
def move_plan(spark, d):
    return views.move_plan(t.current(spark, d, ["size"]).join(checked(spark, d), "path", "left_semi"), "/vol/kept/")


@query(f"WITH {t.CUR}, {_CHECKED} SELECT count(c.path) AS deleted, 0::bigint AS moved, count(*) - count(c.path) AS failed FROM chk LEFT JOIN (SELECT path FROM cur WHERE mode = 'visual') c ON c.path = chk.path")
def delete_counters(spark, d):
    there = t.current(spark, d, ["size"]).select("path", F.lit(True).alias("there"))
    log = checked(spark, d).join(there, "path", "left").select("path", F.when(F.col("there"), "deleted").otherwise("failed").alias("status"))
    return views.counters(log)


@query(f"WITH {t.MEM}, {_CHECKED} SELECT DISTINCT path FROM mem WHERE path IN (SELECT path FROM chk) AND {t.suffix()} IN ('pdf','cbz','gif')")
def checked_visible(spark, d):
    return views.visible(t.members(spark, d), "document").join(checked(spark, d), "path", "left_semi").select("path").distinct()


@query(
    """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) SELECT doc_id FROM s
WHERE n % greatest(1, (SELECT count(*) FROM s) // 50) = 0 AND n < 50 * greatest(1, (SELECT count(*) FROM s) // 50)"""
)
def stride_sample(spark, d):
    return views.stride_sample(t.table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT path FROM (SELECT path FROM clusters UNION SELECT path FROM fs_log) WHERE path NOT IN (SELECT path FROM metadata WHERE path IS NOT NULL)")
def unknown_paths(spark, d):
    named = t.table(spark, d, "clusters").select("path").union(t.table(spark, d, "fs_log").select("path")).distinct().where(F.col("path").isNotNull())
    return named.join(t.catalog(spark, d).select("path"), "path", "left_anti")
