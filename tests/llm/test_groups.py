"""Groups of matches, survivors and near-duplicate hashes, against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from harness import DATA, compare, connection

from lookalike.llm import edits, groups, queries, survivors


def at(second):
    return dt.datetime(2025, 1, 1, 0, 0, second, tzinfo=dt.timezone.utc)


def union_find(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(0, 40)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.seed for r in groups.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = union_find([(a, b) for a, b in links if a != b])
    roots = {}
    assert set(got) == set(want)
    for node, root in want.items():
        assert roots.setdefault(root, got[node]) == got[node]
    assert len(set(roots.values())) == len(roots)


def test_normal_form():
    assert groups.normal_form("/a//b/./c/../d/") == "/a/b/d"
    assert groups.normal_form("/été") == "/été"
    assert groups.normal_form("") is None and groups.normal_form(None) is None
    assert groups.normal_form("/../a") == "/a" and groups.normal_form("//a") == "/a"


CATALOG = "path string, mode string, last_scan timestamp, phash string, dhash array<bigint>, node int, a string"


def catalog(spark, rows):
    return spark.createDataFrame([(p, "visual", at(when), ph, h, 1, "x") for p, when, ph, h in rows], CATALOG)


def test_grouped(spark):
    h = 0x0F0F0F0F
    cat = catalog(spark, [("/a", 1, None, [h]), ("/b", 1, None, [h ^ 0b1011]), ("/c", 1, None, [h ^ 0b111110000]), ("/d", 1, None, None), ("/é", 1, None, [0, None, -1]), ("/f", 1, None, [h]), ("/f", 2, None, [~h])])
    e = [("/a", "/b", 0.42, None), ("/a/", "/c", 0.5, None), ("/c", "/.//d", 0.5925, at(1)), ("/é", "/d", 0.6, at(1)), ("/a", "/a", 1.0, at(1)), ("/a", "/gone", 0.9, at(1)), (None, "/a", 0.9, at(1)), ("", "/a", 0.9, at(1)), ("/b", "/d", math.nan, at(1)), ("/b", "/c", None, at(1)), ("/b", "/d", -1.0, at(1)), ("/a", "/f", 0.5, at(1)), ("/b", "/a", 0.42, at(1))]
    edges = spark.createDataFrame(e, "a string, b string, sim double, found_at timestamp")
    got = dict(map(tuple, groups.grouped(edges, cat).collect()))
    assert got == {"/a": "/a", "/b": "/a", "/c": "/c", "/d": "/c", "/é": "/c"}
    assert groups.grouped(edges.limit(0), cat).count() == 0 and groups.grouped(edges, cat.limit(0)).count() == 0


def agreement(x, y):
    if not x or not y:
        return 0
    near = lambda p, side: any((p ^ q).bit_count() <= 4 for q in side)
    return min(sum(near(p, y) for p in x), sum(near(q, x) for q in y)) / max(len(x), len(y))


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_against_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = [rng.getrandbits(63) for _ in range(6)]
    rows = []
    for i in range(150):
        base = [rng.getrandbits(63) for _ in range(rng.randint(1, 5))]
        for m in range(rng.randint(1, 3)):
            flipped = [h ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for h in base if rng.random() > 0.2 * m]
            rows.append((f"/n/{i:03d}_{m}", 1, f"{rng.randrange(60):064X}" if rng.random() < 0.3 else "FAIL_x", flipped + rng.sample(shared, m % 2) + [0, -1, None]))
    got = set(map(tuple, edits.found(catalog(spark, rows)).collect()))
    sets = {p: [h for h in set(hs) - {None} if 5 <= (h & (2**64 - 1)).bit_count() <= 59] for p, _, _, hs in rows}
    hashes = {p: ph.lower() for p, _, ph, _ in rows if len(ph) == 64}
    want = {(p, q) for p in sets for q in sets if p < q and (agreement(sets[p], sets[q]) >= 0.5 or hashes.get(p, p) == hashes.get(q, q))}
    assert len(want) > 60 and got <= want and len(got) >= 0.98 * len(want)


def test_same_pictures_and_odd_hashes(spark):
    rows = [("/a", 1, "AB" * 32, None), ("/b", 1, "ab" * 32, []), ("/c", 1, "", [5]), ("/d", 1, None, [5]), ("/e", 1, "zz" * 32, [31, 31]), ("/f", 1, "zz" * 32, [31 << 9 | 1]), ("/g", 1, None, [31]), ("/h", 1, None, [31]), ("/h", 2, None, None)]
    got = sorted(map(tuple, edits.found(catalog(spark, rows)).collect()))
    assert got == [("/a", "/b"), ("/e", "/g")]
    each = {r.path: (r.class_path, r.copies, r.links) for r in edits.classes(catalog(spark, rows)).collect()}
    assert each == {"/e": ("/e", 2, 0), "/g": ("/e", 2, 0), "/f": ("/f", 1, 0)}
    assert edits.found(catalog(spark, rows).limit(0)).count() == 0


def test_forest_reaches_its_recall_with_whole_signatures():
    trees = edits.trees_for()
    assert 1 - (1 - edits.least_jaccard() ** edits.DEPTH) ** trees >= edits.RECALL


def test_prefixes_are_shortened_to_the_highest_small_node():
    unit = lambda *nibbles: sum(n << 4 * (edits.DEPTH - 1 - k) for k, n in enumerate(nibbles))
    key = np.sort(np.array([unit(1, 1, i) for i in range(4)] + [unit(1, 2, 0, i // 2) for i in range(6)] + [unit(2)], np.int64))
    sizes = lambda **options: np.bincount(edits.leaves(key, **options)).tolist()
    assert sizes(shallow=1, node=20) == [10, 1]
    assert sizes(shallow=1, node=6) == [4, 6, 1]
    assert sizes(shallow=1, node=4) == [4, 2, 2, 2, 1]
    assert sizes(shallow=edits.DEPTH, node=1) == [1, 1, 1, 1, 2, 2, 2, 1]


@pytest.mark.parametrize("options", [{}, {"hot": 20, "crowded": 200}, {"hot": 20}])
def test_near_hashes_against_brute_force(spark, options):
    rng = random.Random(4)
    centres = [rng.getrandbits(63) for _ in range(40)] + [rng.getrandbits(63)] * 20
    hashes = {c ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 3))) for c in centres for _ in range(20)} | {rng.getrandbits(64) - 2**63 for _ in range(300)}
    found = edits.near_hashes(spark.createDataFrame([(h,) for h in hashes], "h bigint"), **options)
    got = {(r.x, r.y) for r in found.collect()}
    want = {(x, y) for x in hashes for y in hashes if x != y and ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
    assert got <= want and len(got) >= 0.998 * len(want) > 5000


def test_survivors(spark):
    meta = [
        ("/a", "visual", at(1), "100x100", 5, 1.0, 0.0), ("/b", "visual", at(1), "100 × 100", 5, 2e12, None), ("/c", "visual", at(1), "200X200", -3, None, 0.5),
        ("/d", "visual", at(1), "junk", None, math.nan, math.nan), ("/e", "faces", at(1), "900x900", 9, 1.0, 0.0), ("/f", "visual", at(1), "1x1x1", 0, 0.0, -1.0), ("/a", "visual", None, "999x999", 9, 9.0, 0.0),
    ]
    cat = spark.createDataFrame(meta, "path string, mode string, last_scan timestamp, resolution string, size bigint, mtime double, watermark double")
    groups_ = [(1, "/a"), (1, "/b"), (1, "/a"), (2, "/c"), (2, "/a"), (3, "/d"), (3, "/f"), (4, "/a"), (4, "/e"), (4, "/a"), (None, "/a"), (None, "/b"), (5, None), (5, "/a")]
    clusters = spark.createDataFrame([(c, p, "old") for c, p in groups_], "cluster_id int, path string, resolution string")
    assert dict(map(tuple, survivors.survivors(clusters, cat).collect())) == {1: "/b", 2: "/c", 3: "/d"}
    built = {r.cluster_id: r for r in survivors.merged(clusters, cat).collect()}
    assert built[1].newest == 2e9 and built[1].clean == 0.0 and built[3].clean is None
    assert survivors.survivors(clusters.limit(0), cat).count() == 0 and survivors.survivors(clusters, cat.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    got, want = compare(spark, connection(), queries.QUERIES[name], queries.SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() >= (name != "p1_recall")
