"""Similar vectors and clusters of them, against brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookalike.llm import communities, neighbours, vectors

SCHEMA = "path string, mode string, last_scan timestamp, vector array<array<float>>, faces array<array<float>>, cid int"


def at(second):
    return dt.datetime(2025, 1, 1, 0, 0, second, tzinfo=dt.timezone.utc)


def row(path, frames, mode="visual", when=1):
    value = None if frames is None else [None if f is None else [float(x) for x in f] for f in frames]
    return (path, mode, at(when) if when else None, value if mode == "visual" else None, value if mode == "faces" else None, 7)


def near(rng, base, noise):
    v = base + noise * rng.standard_normal(len(base)) / math.sqrt(len(base)) * np.linalg.norm(base)
    return v * rng.uniform(0.5, 3)


def library(seed=0, groups=40):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.standard_normal(64)
        for m in range(1 + g % 6):
            frames = [near(rng, base, 0.25)] + [rng.standard_normal(64) for _ in range((g + m) % 3)]
            rows.append(row(f"/v/{g:02d}_{m}", frames, "faces" if g % 4 == 0 else "visual"))
    return rows


def brute(rows, least=0.82):
    sims = {}
    unit = [(r[1], r[0], np.array([f / np.linalg.norm(f) for f in np.array(r[3] or r[4], np.float64)])) for r in rows]
    for i, (mode, p, x) in enumerate(unit):
        for other, q, y in unit[:i]:
            if mode == other and (s := (x @ y.T).max()) >= least:
                sims[mode, p, q] = sims[mode, q, p] = s
    return sims


def top_pairs(sims, k=5):
    lists = {}
    for (mode, p, q), s in sims.items():
        lists.setdefault((mode, p), []).append((-s, q))
    return {(mode, min(p, q), max(p, q)) for (mode, p), found in lists.items() for _, q in sorted(found)[:k]}


def test_recall_against_brute_force(spark):
    rows = library()
    got = set(map(tuple, neighbours.found(spark.createDataFrame(rows, SCHEMA)).collect()))
    want = top_pairs(brute(rows))
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.97 * len(got)


def test_copies_list_the_first_of_their_group(spark):
    rng = np.random.default_rng(1)
    same = rng.standard_normal(64)
    rows = [row(f"/c/{i:03d}", [same]) for i in range(200)] + [row("/c/near", [near(rng, same, 0.1)])]
    each = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), 5).collect()
    lists = {}
    for r in sorted(each, key=lambda r: r["rank"]):
        lists.setdefault(r.path, []).append(r.other)
    assert lists["/c/150"] == [f"/c/{i:03d}" for i in range(5)]
    assert lists["/c/002"] == ["/c/000", "/c/001", "/c/003", "/c/004", "/c/005"]
    assert lists["/c/near"] == [f"/c/{i:03d}" for i in range(5)]


def test_what_takes_no_part(spark):
    v = [1.0] * 64
    odd = [row("/x/null", None), row("/x/none", []), row("/x/nan", [v, [math.nan] * 64]), row("/x/zero", [[0.0] * 64]), row("/x/wide", [v + [1.0]]), row("/x/hole", [v, None]), row("/x/inf", [[math.inf] * 64])]
    old = [row("/x/a", [v], when=None), row("/x/a", [[-1.0] + v[1:]], when=1), row("/x/b", [v], when=2), row("/x/c", [v], "faces"), row("/x/b", [v], when=2)]
    got = neighbours.found(spark.createDataFrame(odd + old, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [("visual", "/x/a", "/x/b")]
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.found(empty).count() == 0 and communities.found(empty).count() == 0


def test_nearest_in_hot_buckets_are_exact(spark):
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(64)
    rows = [row(f"/d/{i:03d}", [near(rng, centre, 0.23)] + [near(rng, centre, 0.23)] * (i % 9 == 0)) for i in range(500)]
    old = [(r[0], r[1], at(0), [[float(x) for x in near(rng, centre, 0.01)]], None, 7) for r in rows[:30]]
    df = spark.createDataFrame(rows + old, SCHEMA)
    want = top_pairs(brute(rows))
    got = {tuple(r) for r in neighbours.nearest(df, 5, hot=40).selectExpr("mode", "least(path, other)", "greatest(path, other)").collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got & want) >= 0.99 * len(got)


def test_equal_directions_in_hot_buckets_go_by_path(spark):
    v = np.r_[1.0, np.arange(63) / 100]
    rows = [row(f"/e/{(i * 37) % 100:03d}", [v * 2.0**(i - 50)]) for i in range(100)]
    lists = {}
    for r in sorted(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), 3, hot=20).collect(), key=lambda r: r["rank"]):
        lists.setdefault(r.path, []).append(r.other)
    assert len(lists) == 100 and lists["/e/050"] == ["/e/000", "/e/001", "/e/002"] and lists["/e/001"] == ["/e/000", "/e/002", "/e/003"]


@pytest.mark.parametrize("dims", [32, 64, 100])
def test_sketches_keep_pairs_at_the_bar_and_few_others(dims):
    rng = np.random.default_rng(9)

    def estimates(cos):
        a, b = rng.standard_normal((2, 20_000, dims)).astype(np.float32)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = cos * a + math.sqrt(1 - cos**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        return vectors.estimate(*(x.view(np.uint64) for x in (*vectors.sketches(a), *vectors.sketches(b))))

    bar = vectors.sketch_bar(0.82, dims)
    assert (estimates(0.82) >= bar).mean() >= 0.999 and (estimates(0.95) >= bar).all()
    assert (estimates(0.2) >= bar).mean() < 0.01


def test_estimate_is_the_cosine_of_the_codes():
    rng = np.random.default_rng(3)
    u = rng.standard_normal((50, 64)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    y = vectors.rotated(u, 900) * 8
    codes = np.sign(y) * np.where(np.abs(y) > vectors.LARGE, 3, 1)
    want = (codes[:25] * codes[25:]).sum(axis=1) / np.linalg.norm(codes[:25], axis=1) / np.linalg.norm(codes[25:], axis=1)
    s, m = (x.view(np.uint64) for x in vectors.sketches(u))
    assert np.allclose(vectors.estimate(s[:25], m[:25], s[25:], m[25:]), want)


def test_hadamard_and_rotations_keep_lengths():
    h = vectors.butterflies(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and set(np.round(h * math.sqrt(8)).ravel()) == {-1, 1}
    r = vectors.rotation(64, 3)
    assert np.allclose(r @ r.T, np.eye(64), atol=1e-5)
    u = np.random.default_rng(1).standard_normal((5, 100)).astype(np.float32)
    assert np.allclose(u @ vectors.rotation(100, 3), vectors.pseudo_rotation(u, 3), atol=1e-4)


def cliques(rows, sims):
    near_by = {}
    for mode, p, q in sims:
        near_by.setdefault((mode, p), set()).add(q)
    out = set()
    for (mode, p), others in near_by.items():
        group = others | {p}
        if len(group) >= 3 and all(near_by[mode, q] | {q} == group for q in group):
            best = min(group, key=lambda q: (-round(sum(sims[mode, q, o] for o in group if o != q), 5), q))
            out.add((mode, p, best))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_clusters_against_brute_force(spark, seed):
    rows = library(seed)
    got = set(map(tuple, communities.found(spark.createDataFrame(rows, SCHEMA)).collect()))
    want = cliques(rows, brute(rows))
    assert len(want) > 40 and len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.97 * len(got)


def test_cluster_of_copies_and_one_with_a_link_outside(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal(64)
    e = lambda angle: np.r_[math.cos(angle), math.sin(angle), np.zeros(62)]
    copies = [row(f"/k/{i}", [a]) for i in range(4)]
    chain = [row(f"/l/{i}", [e(0.4 * i)]) for i in range(4)]
    got = communities.found(spark.createDataFrame(copies + chain + copies[:1], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [("visual", f"/k/{i}", "/k/0") for i in range(4)]
    every = {r.path: r.records for r in communities.described(spark.createDataFrame(copies + chain, SCHEMA)).collect()}
    assert every["/k/1"] == 4 and set(every) == {r[0] for r in copies + chain}


def test_a_cluster_with_few_of_its_edges_is_measured(spark, monkeypatch):
    rng = np.random.default_rng(15)
    centre = rng.standard_normal(64)
    rows = [row(f"/t/{i:02d}", [near(rng, centre, 0.2)]) for i in range(20)]
    e = lambda angle: np.r_[math.cos(angle), math.sin(angle), np.zeros(62)]
    df = spark.createDataFrame(rows + [row(f"/u/{i}", [e(0.4 * i)]) for i in range(4)], SCHEMA)
    whole, star = communities.neighbour_graph, sorted(r.cid for r in vectors.contents(df)[0].where("path like '/t/%'").collect())
    monkeypatch.setattr(communities, "neighbour_graph", lambda *a, **k: whole(*a, **k).where(~F.col("a").isin(star[1:])))
    got = {r.path for r in communities.found(df).collect()}
    assert got == {r[0] for r in rows}


def test_large_communities_are_measured_in_blocks(spark):
    rows = library(11, 60)
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    assert set(map(tuple, communities.found(df, block=2).collect())) == set(map(tuple, communities.found(df).collect()))


def test_descent_finds_what_the_tables_miss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [row(f"/w/{g}_{i}", [near(rng, c, 0.25)]) for g, c in enumerate(rng.standard_normal((10, 64))) for i in range(8)]
    current, packed = vectors.contents(spark.createDataFrame(rows, SCHEMA))
    monkeypatch.setattr(communities, "START", vectors.Shape(tables=1, probes=6))
    started = vectors.verified(vectors.candidate_pairs(packed, current, 0.82, 24, communities.START), packed, 0.82).count()
    assert started < 230 and communities.neighbour_graph(current, packed).count() > 260


def test_modularity_separates_two_cliques_with_a_bridge(spark):
    edges = [(i, j, 0.9) for side in (range(0, 6), range(10, 16)) for i in side for j in side if i < j] + [(0, 10, 0.83)]
    got = {r.cid: r.community for r in communities.communities(spark.createDataFrame(edges, "a bigint, b bigint, sim double")).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[1] != got[11]


def test_recall_query_measures_against_brute_force(spark):
    rows = neighbours.recall(spark.createDataFrame(library(8), SCHEMA), every=1).collect()
    assert {r.mode for r in rows} == {"visual", "faces"} and all(r.recall >= 0.9 and r.queries > 20 for r in rows)


def test_buckets_found_hot_while_comparing_and_foreseen_ones_lose_nothing(spark):
    rng = np.random.default_rng(13)
    centre = rng.standard_normal(64)
    df = spark.createDataFrame([row(f"/g/{i:03d}", [near(rng, centre, 0.2)]) for i in range(300)], SCHEMA)
    current, packed = vectors.contents(df)
    lists = []
    for hot in (10**6, 60, 20):
        rows = neighbours.expand(current, neighbours.similar_contents(current, packed, 5, 0.82, hot=hot), 5).collect()
        lists.append({(r.path, r.other) for r in rows})
    assert len(lists[0]) == 1500 and lists[1] == lists[0] and lists[2] == lists[0]
    part = vectors.bucket_mates(vectors.bucket_rows(packed, vectors.Shape(), range(1)), 0.5, 40)
    assert part.where("place is not null and b is null").count() > 40


def test_modes_and_near_names_never_mix(spark):
    v = [float(x) for x in range(1, 65)]
    odd = [row("/m/a", [v]), row("/m/b", [v], "faces"), row("/m/c", [v, None]), row("/m/d", [v, [math.nan] * 64]), row("/m/e", [v, [1.0]]), row("/m/f", [v[:32], v[32:]])]
    assert neighbours.found(spark.createDataFrame(odd, SCHEMA)).count() == 0
