"""Near-duplicate records: a MinHash LSH forest over frame hashes, verified exactly.

The records of the forest are frame hashes, each a set of 64 tokens, its bits with their positions: two hashes 4 bits
apart share 60 of 68. A hash has a signature in each tree, the ranks of its minima under 12 random orders of the
tokens. The signatures of a tree, sorted, are its prefix trie. Files are joined by the hashes they match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.catalog import current_rows
from lookalike.llm.groups import FRAME_BITS, usable
from lookalike.session import shuffle_partitions, stage_table

AGREEMENT = 0.5
RECALL = 0.9995
#: Minima of a signature, four bits each, and the least number that two hashes must share to be compared.
DEPTH, SHALLOW = 12, 6
#: Hashes below a node of the trie up to which all of them are compared.
NODE = 24
#: Hashes with one whole signature from which they are measured in blocks, and those with one shallow prefix from
#: which this prefix is no longer held in one task. One hash in FORESEEN is looked at to foresee the latter.
HOT, CROWDED, FORESEEN = 2000, 50_000, 16
#: Trees whose rows are shuffled at once: what bounds the disk.
AT_ONCE = 16


def least_jaccard(bits: int = FRAME_BITS) -> float:
    """Of the token sets of two hashes that differ in `bits` bits."""
    return (64 - bits) / (64 + bits)


def trees_for(recall: float = RECALL, bits: int = FRAME_BITS, depth: int = DEPTH) -> int:
    """So many that even with no prefix shortened below `depth` minima a pair is met with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least_jaccard(bits) ** depth))


def signatures(hashes: DataFrame, trees: range) -> DataFrame:
    """(key, h): for every hash and tree, the number of the tree and then its minima, four bits each."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = (np.arange(256)[:, None] >> np.arange(8)) & 1
        # Least rank among the eight tokens of each value of each byte: a minimum is then that of eight look-ups.
        ranks = [np.stack([np.random.default_rng(9000 + t * DEPTH + d).permutation(128).astype(np.uint8) for d in range(DEPTH)]) for t in trees]
        least = [np.stack([r[:, 2 * (8 * b + np.arange(8)) + bit].min(axis=2) for b in range(8)]) for r in ranks]
        for whole in batches:
            for lo in range(0, whole.num_rows, 20_000):
                h = whole.column("h").slice(lo, 20_000)
                part = np.ascontiguousarray(h.to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
                for t, table in zip(trees, least):
                    minima = table[0][:, part[:, 0]]
                    for b in range(1, 8):
                        np.minimum(minima, table[b][:, part[:, b]], out=minima)
                    key = np.full(len(part), t, np.int64)
                    for d in range(DEPTH):
                        key = (key << 4) | np.minimum(minima[d], 15)
                    yield pa.RecordBatch.from_arrays([pa.array(key), h], names=["key", "h"])

    return hashes.select("h").mapInArrow(sign, "key bigint, h bigint")


def leaves(key: np.ndarray, shallow: int, node: int = NODE) -> np.ndarray:
    """The number of the node that each of the sorted keys is compared in.

    From the whole signature a matched prefix is shortened as long as the node above holds no more than `node`
    hashes, down to `shallow` minima: so every hash ends below the highest node that is small enough, or with its
    whole signature, which gives the recall that the number of trees was chosen for.
    """
    differ = (key[1:] ^ key[:-1]).astype(np.float64)
    common = np.where(differ > 0, DEPTH - 1 - (np.frexp(np.maximum(differ, 1))[1] - 1) // 4, DEPTH)
    cut = np.r_[True, common < shallow]
    for depth in range(shallow + 1, DEPTH + 1):
        part = np.cumsum(cut) - 1
        large = np.bincount(part) > node
        if not large.any():
            break
        cut[1:] |= large[part[1:]] & (common < depth)
    return np.cumsum(cut) - 1


def near_in(part: np.ndarray, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs x < y of one part at most `bits` bits apart, each once; part is sorted."""
    low, high, i, d, u = [h[:0]], [h[:0]], np.arange(len(h) - 1), 1, h.view(np.uint64)
    while len(i):
        i = i[: np.searchsorted(i, len(h) - d)]
        i = i[part[i] == part[i + d]]
        near = i[np.bitwise_count(u[i] ^ u[i + d]) <= bits]
        low.append(np.minimum(h[near], h[near + d]))
        high.append(np.maximum(h[near], h[near + d]))
        d += 1
    pairs = np.unique(np.stack([np.concatenate(low), np.concatenate(high)]), axis=1)
    return pairs[0], pairs[1]


def met(rows: DataFrame, bits: int, hot: int) -> DataFrame:
    """(x, y, key): near pairs with key null; of more than `hot` hashes with one whole signature, instead of
    pairs, its members as x, with y null. rows (key, h, shallow): the trie is walked as the sorted rows pass."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        given_up = -1

        def closed(rows: list[np.ndarray]) -> pa.RecordBatch:
            key, h, shallow = rows
            parts = [np.zeros(0, np.int64)]
            for s in np.unique(shallow):
                own = shallow == s
                parts.append(np.stack([leaves(key[own], int(s)), np.flatnonzero(own)]))
            part = np.zeros(len(key), np.int64)
            for k, found in enumerate(parts[1:]):
                part[found[1]] = found[0] * 2 + k
            whole = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            sizes = np.bincount(np.cumsum(whole) - 1) if len(key) else np.zeros(0, np.int64)
            over = (np.repeat(sizes, sizes) > hot) | (key == given_up)
            x, y = near_in(part[~over], h[~over], bits)
            pair = np.arange(len(x) + over.sum()) < len(x)
            columns = [pa.array(np.r_[x, h[over]]), pa.array(np.r_[y, h[over]], mask=~pair), pa.array(np.r_[x, key[over]], mask=pair)]
            return pa.RecordBatch.from_arrays(columns, names=["x", "y", "key"])

        for batch in batches:
            rows = [np.concatenate([a, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for a, c in zip(held, batch.columns)]
            key, last = rows[0], len(rows[0]) - 1
            if last < 0:
                continue
            start = key[last] >> (4 * (DEPTH - rows[2][last])) << (4 * (DEPTH - rows[2][last]))
            cut = int(np.searchsorted(key, start))
            if rows[2][last] == DEPTH and last + 1 - cut > hot:
                cut, gone = last + 1, key[last]
                yield closed(rows)
                given_up = gone
            else:
                yield closed([r[:cut] for r in rows])
            held = [r[cut:] for r in rows]
        yield closed(held)

    place = F.expr(f"shiftright(key, 4 * ({DEPTH} - shallow))")
    return rows.repartition(shuffle_partitions(rows.sparkSession), place).sortWithinPartitions("key").mapInArrow(walk, "x bigint, y bigint, key bigint").distinct()


def in_blocks(held: DataFrame, bits: int, block: int) -> DataFrame:
    """(x, y), x < y: near pairs among all hashes of one key, every two of its blocks measured in one task."""
    many = held.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("many"))
    own = F.pmod(F.xxhash64("h"), F.col("many")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    sent = held.join(many, "key").withColumn("own", own).withColumn("at", F.explode(others)).select("key", "at.i", "at.j", "own", "h")

    def measure(rows: pa.Table) -> pa.Table:
        own, h = rows.column("own").to_numpy(), rows.column("h").to_numpy()
        left, right = h[own == rows.column("i")[0].as_py()], h[own == rows.column("j")[0].as_py()]
        found = [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(left), 500):
            part = left[lo : lo + 500]
            a, b = np.nonzero(np.bitwise_count(part.view(np.uint64)[:, None] ^ right.view(np.uint64)) <= bits)
            pair = np.stack([part[a], right[b]])
            found.append(np.sort(pair[:, pair[0] != pair[1]], axis=0))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"x": pairs[0], "y": pairs[1]})

    return sent.groupBy("key", "i", "j").applyInArrow(measure, "x bigint, y bigint")


def near_hashes(hashes: DataFrame, bits: int = FRAME_BITS, recall: float = RECALL, hot: int = HOT, crowded: int = CROWDED) -> DataFrame:
    """(x, y), both ways: distinct hashes at most `bits` bits apart. hashes: distinct h, on disk.

    The same trees and depth at every size. A tree's rows are shuffled once, by their shallow prefix, and only 16
    bytes each. A shallow prefix with very many hashes would be walked down to whole signatures anyway, so its rows
    are spread by those.
    """
    trees = trees_for(recall, bits)
    bound = F.expr(f"shiftright(key, {4 * (DEPTH - SHALLOW)})")
    some = signatures(hashes.where(F.pmod(F.xxhash64("h"), F.lit(FORESEEN)) == 0), range(trees))
    large = stage_table(some.groupBy(bound.alias("prefix")).agg(F.count("*").alias("n")).where(F.col("n") > crowded // FORESEEN).select("prefix"), "crowded")
    foreseen = not large.isEmpty()
    found = None
    for lo in range(0, trees, AT_ONCE):
        rows = signatures(hashes, range(lo, min(lo + AT_ONCE, trees)))
        if foreseen:
            marked = large.withColumn("deep", F.lit(DEPTH))
            rows = rows.withColumn("prefix", bound).join(marked, "prefix", "left").select("key", "h", F.coalesce("deep", F.lit(SHALLOW)).alias("shallow"))
        else:
            rows = rows.withColumn("shallow", F.lit(SHALLOW))
        part = stage_table(met(rows, bits, hot), "met")
        found = part if found is None else found.union(part)
    pairs = found.where(F.col("key").isNull()).select("x", "y")
    held = found.where(F.col("key").isNotNull()).select("key", F.col("x").alias("h")).distinct()
    if not held.isEmpty():
        pairs = pairs.union(in_blocks(held, bits, hot))
    pairs = pairs.distinct()
    return pairs.union(pairs.select("y", "x"))


def file_hashes(catalog: DataFrame) -> DataFrame:
    """(path, phash, hashes) of current visual rows; phash lower-cased, null unless 64 hex digits."""
    rows = current_rows(catalog, ["phash", "dhash"], "visual")
    real = F.when(F.col("phash").rlike("^[0-9a-fA-F]{64}$"), F.lower("phash"))
    return rows.select("path", real.alias("phash"), F.array_sort(usable("dhash")).alias("hashes"))


def similar_sets(sets: DataFrame, agreement: float = AGREEMENT, bits: int = FRAME_BITS) -> DataFrame:
    """(a, b), a < b: different hash sets with a frame agreement of at least `agreement`.

    sets: (cls, hashes), distinct and not empty, on disk. Of n hashes a set must match at least
    ceil(agreement * n), so one of any n - ceil(agreement * n) + 1 of its hashes has a match: only the
    rarest so many are looked up, and a hash that a large share of all sets contain is looked up only for
    sets made of little else. The larger set of each pair looks the smaller one up; all are verified.
    """
    frames = stage_table(sets.select("cls", F.size("hashes").alias("n"), F.explode("hashes").alias("h")), "frames")
    counts = frames.groupBy("h").agg(F.count("*").alias("sets"))
    hashes = stage_table(counts.repartition(shuffle_partitions(sets.sparkSession), "h"), "hashes")
    near = near_hashes(hashes, bits).union(hashes.select("h", "h"))
    rare = Window.partitionBy("cls").orderBy("sets", "h")
    asked = frames.join(hashes, "h").withColumn("rank", F.row_number().over(rare))
    asked = asked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * agreement) + 1)
    asked = asked.select(F.col("cls").alias("p"), F.col("n").alias("np"), F.col("h").alias("x"))
    stored = frames.select(F.col("cls").alias("q"), F.col("n").alias("nq"), F.col("h").alias("y"))
    larger = (F.col("np") > F.col("nq")) | ((F.col("np") == F.col("nq")) & (F.col("p") > F.col("q")))
    pairs = asked.join(near.toDF("x", "y"), "x").join(stored, "y").where(larger & (F.col("nq") >= agreement * F.col("np")))
    pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    left, right = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y"))
    matched = lambda one, other: F.size(F.filter(one, lambda p: F.exists(other, lambda q: F.bit_count(p.bitwiseXOR(q)) <= bits)))
    share = F.least(matched("x", "y"), matched("y", "x")) / F.greatest(F.size("x"), F.size("y"))
    return pairs.join(left, "a").join(right, "b").where(share >= agreement).select("a", "b")


def near_duplicates(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, pairs of sets): files (path, phash, cls) and similar pairs (a, b) of different sets.

    Files with one set of usable hashes form a class and are compared once; cls is null without any.
    """
    files = file_hashes(catalog)
    rows = stage_table(files.withColumn("key", F.when(F.size("hashes") > 0, F.md5(F.to_binary(F.concat_ws(",", "hashes"), F.lit("utf-8"))))), "files")
    sets = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("hashes").alias("hashes"))
    sets = stage_table(sets.withColumn("cls", F.monotonically_increasing_id()), "sets")
    placed = rows.join(sets.select("key", "cls"), "key", "left").select("path", "phash", "cls")
    return stage_table(placed, "placed"), stage_table(similar_sets(sets.select("cls", "hashes")), "alike")


def found(catalog: DataFrame) -> DataFrame:
    """(path_a, path_b), path_a < path_b: the same phash, or a frame agreement of at least 0.5.

    Null, empty and near-uniform hashes are passed over; a file without usable hashes agrees with none;
    a phash that is not 64 hex digits equals none; older writes of a path are not read; columns beyond
    path, mode, last_scan, phash and dhash are not read; an empty catalog gives no rows. Every pair is
    a row here because the result is defined so; `classes` gives the same links without expanding copies.
    """
    files, alike = near_duplicates(catalog)
    one, two = files.select(F.col("path").alias("p"), "phash", "cls"), files.select(F.col("path").alias("q"), "phash", "cls")
    ordered = F.col("p") < F.col("q")
    same_hash = one.join(two, "phash").where(ordered).select("p", "q")
    same_set = one.join(two, "cls").where(ordered).select("p", "q")
    across = alike.join(one.withColumnRenamed("cls", "a"), "a").join(two.withColumnRenamed("cls", "b"), "b").select(F.least("p", "q"), F.greatest("p", "q"))
    return same_hash.union(same_set).union(across).toDF("path_a", "path_b").distinct()


def classes(catalog: DataFrame) -> DataFrame:
    """(path, class_path, copies, links): one row per file with usable hashes.

    class_path is the smallest path with the same set of usable hashes, copies their number, links the
    number of other such sets whose frame agreement is at least 0.5.
    """
    files, alike = near_duplicates(catalog)
    ends = alike.select("a").union(alike.select("b")).toDF("cls").groupBy("cls").agg(F.count("*").alias("links"))
    own = files.where(F.col("cls").isNotNull())
    heads = own.groupBy("cls").agg(F.min("path").alias("class_path"), F.count("*").alias("copies"))
    each = own.join(heads.join(ends, "cls", "left"), "cls")
    return each.select("path", "class_path", "copies", F.coalesce("links", F.lit(0)).alias("links"))


SQL = {
    "p4_found": f"""WITH cur AS (SELECT path, phash, dhash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_scan DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST) AS rn
    FROM metadata WHERE mode = 'visual' AND path IS NOT NULL) WHERE rn = 1),
  hs AS (SELECT DISTINCT path, h FROM (SELECT path, unnest(dhash) AS h FROM cur) WHERE bit_count(h) BETWEEN 5 AND 59),
  n AS (SELECT path, count(*) AS n FROM hs GROUP BY 1),
  d AS (SELECT DISTINCT h FROM hs), near AS (SELECT x.h AS x, y.h AS y FROM d x JOIN d y ON bit_count(xor(x.h, y.h)) <= {FRAME_BITS}),
  hit AS (SELECT a.path AS p, b.path AS q, a.h AS x, b.h AS y FROM hs a JOIN near ON near.x = a.h JOIN hs b ON b.h = near.y WHERE a.path < b.path),
  c AS (SELECT p, q, least(count(DISTINCT x), count(DISTINCT y)) AS m FROM hit GROUP BY 1, 2),
  ph AS (SELECT path, lower(phash) AS k FROM cur WHERE regexp_full_match(phash, '[0-9a-fA-F]{{64}}'))
  SELECT p AS path_a, q AS path_b FROM c JOIN n a ON a.path = p JOIN n b ON b.path = q WHERE m >= {AGREEMENT} * greatest(a.n, b.n)
  UNION SELECT x.path, y.path FROM ph x JOIN ph y ON x.k = y.k AND x.path < y.path"""
}
