"""Consolidating pairwise matches into groups: connected components by seed-tree pruning."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookalike.catalog import current_rows
from lookalike.session import stage_table

STRONG, WEAK, FRAME_BITS = 0.5925, 0.4125, 4
LEAST_BITS, MOST_BITS = 5, 59


def normal_form(path: str | None) -> str | None:
    """`.`, `..`, doubled and trailing slashes resolved, letters composed (NFC); null and empty give null."""
    if not path:
        return None
    if not unicodedata.is_normalized("NFC", path):
        path = unicodedata.normalize("NFC", path)
    rooted, kept = path.startswith("/"), []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part != "..":
            kept.append(part)
        elif kept and kept[-1] != "..":
            kept.pop()
        elif not rooted:
            kept.append(part)
    return "/" * rooted + "/".join(kept) or None


def normalised(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [pa.array([normal_form(p) for p in batch.column(c).to_pylist()], pa.string()) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*ends, batch.column("sim")], names=["a", "b", "sim"])

    return edges.select("a", "b", "sim").mapInArrow(run, "a string, b string, sim double")


def usable(hashes: str) -> Column:
    """Distinct frame hashes that are neither null nor near-uniform."""
    return F.array_distinct(F.filter(hashes, lambda x: F.bit_count(x).between(LEAST_BITS, MOST_BITS)))


def within(x: str, y: str, bits: int) -> Column:
    """Whether some hash of x is within so many bits of one of y."""
    return F.exists(x, lambda p: F.exists(y, lambda q: F.bit_count(p.bitwiseXOR(q)) <= bits))


def matches(edges: DataFrame, catalog: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v) by node id of every accepted row of edges.

    Rows are reduced to one per pair of ends, with its greatest sim, before they meet the catalog; frame
    hashes are fetched only for ends of pairs that need them.
    """
    sim = F.col("sim")
    # A NaN is no sim; it would compare as greater than all numbers.
    read = normalised(edges.where(~F.isnan("sim") & (sim >= WEAK))).where(F.col("a") != F.col("b"))
    pairs = read.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))
    left, right = nodes.toDF("a", "u"), nodes.toDF("b", "v")
    known = stage_table(pairs.join(left, "a").join(right, "b").select("u", "v", "sim"), "pairs")
    doubtful = known.where(sim < STRONG).select("u", "v")
    ends = doubtful.select("u").union(doubtful.select("v")).toDF("node").distinct()
    of_ends = nodes.join(ends, "node").select("node", "path")
    rows = catalog.where(F.col("mode") == "visual").select("path", "mode", "last_scan", "dhash").join(of_ends, "path")
    hashes = current_rows(rows, ["node", "dhash"]).select("node", usable("dhash").alias("hashes"))
    both = doubtful.join(hashes.toDF("u", "x"), "u").join(hashes.toDF("v", "y"), "v")
    confirmed = both.where(within("x", "y", FRAME_BITS)).select("u", "v")
    return known.where(sim >= STRONG).select("u", "v").union(confirmed)


def components(links: DataFrame) -> DataFrame:
    """(node, seed): every node of the undirected links (u, v) with the seed of its component.

    Each round a node points its neighbourhood at the smallest node in it. Those smallest nodes are
    joined to one another and stay; a node that nobody points at itself leaves the graph and hangs
    below its smallest candidate in the propagation forest. When no links are left, seeds flow down the
    forest by pointer jumping. Minima are taken by combining aggregations, so a node with a third of
    all links is no hot task; only pairs of ids are shuffled and nothing is gathered.
    Self links and repeated links are harmless; null ends are dropped; no links give no rows.
    """
    links = links.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    graph = stage_table(both_ways(links), "graph")
    forest: DataFrame | None = None
    while not graph.isEmpty():
        least = graph.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        pointed = graph.join(least, "u").select(F.col("v").alias("n"), "m").union(least.select("u", "m")).distinct()
        pointed = stage_table(pointed, "pointed")
        choice = pointed.groupBy("n").agg(F.min("m").alias("best"), F.max(F.col("m") == F.col("n")).alias("stays"))
        gone = choice.where(~F.col("stays")).select("n", F.col("best").alias("parent"))
        forest = gone if forest is None else forest.union(gone)
        kept = pointed.join(choice.select("n", "best"), "n").where(F.col("m") != F.col("best"))
        graph = stage_table(both_ways(kept.select(F.col("best").alias("u"), F.col("m").alias("v"))), "graph")
    if forest is None:
        return links.select(F.col("u").alias("node"), F.col("u").alias("seed")).limit(0)
    tree = stage_table(forest, "forest")
    while True:
        up = tree.select(F.col("n").alias("parent"), F.col("parent").alias("above"))
        higher = tree.join(up, "parent", "left")
        tree = stage_table(higher.select("n", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "forest")
        if tree.where("moved").isEmpty():
            break
        tree = tree.select("n", "parent")
    return tree.select("n", "parent").union(tree.select("parent", "parent").distinct()).toDF("node", "seed")


def both_ways(links: DataFrame) -> DataFrame:
    ways = links.select("u", "v").union(links.select("v", "u")).toDF("u", "v")
    return ways.where(F.col("u") != F.col("v")).distinct()


def grouped(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, group_path): every matched catalog path and the smallest path linked to it, itself included.

    A row of edges is a match if both ends in normal form are different catalog paths and sim is at
    least 0.5925, or at least 0.4125 with frame hashes at most 4 bits apart. Null, NaN and negative sim,
    null, empty or unknown ends and self matches are no matches; repeats count once.
    """
    paths = catalog.select("path").where(F.col("path").isNotNull()).distinct()
    nodes = stage_table(paths.withColumn("node", F.monotonically_increasing_id()), "nodes")
    placed = components(matches(edges, catalog, nodes)).join(nodes, "node")
    placed = stage_table(placed.select("seed", "path"), "placed")
    return placed.join(placed.groupBy("seed").agg(F.min("path").alias("group_path")), "seed").select("path", "group_path")


def _normal_sql(end: str) -> str:
    steps = "lambda acc, x: CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END"
    return f"list_reduce(list_prepend('', string_split(nfc_normalize({end}), '/')), {steps})"


SQL = {
    "p3_found": f"""WITH RECURSIVE cur AS (SELECT path, dhash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_scan DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST) AS rn
    FROM metadata WHERE mode = 'visual' AND path IS NOT NULL) WHERE rn = 1),
  hs AS (SELECT path, h FROM (SELECT path, unnest(dhash) AS h FROM cur) WHERE bit_count(h) BETWEEN {LEAST_BITS} AND {MOST_BITS}),
  e AS (SELECT {_normal_sql('a')} AS a, {_normal_sql('b')} AS b, max(sim) AS sim FROM edges WHERE a <> '' AND b <> '' AND NOT isnan(sim) AND sim >= {WEAK} GROUP BY 1, 2),
  k AS (SELECT * FROM e WHERE a <> b AND a IN (SELECT path FROM metadata) AND b IN (SELECT path FROM metadata)),
  m AS (SELECT a, b FROM k WHERE sim >= {STRONG} OR EXISTS (SELECT 1 FROM hs p JOIN hs q ON p.path = k.a AND q.path = k.b AND bit_count(xor(p.h, q.h)) <= {FRAME_BITS})),
  l AS (SELECT a AS u, b AS v FROM m UNION SELECT b, a FROM m),
  reach AS (SELECT u, u AS v FROM l UNION SELECT r.u, l.v FROM reach r JOIN l ON l.u = r.v)
  SELECT u AS path, min(v) AS group_path FROM reach GROUP BY 1"""
}
