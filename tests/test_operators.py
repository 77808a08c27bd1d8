"""Operators on small tables: sequential reference computations, properties, nulls, ties and empty input."""

import datetime as dt
import math
import os
import random
import re
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lookalike.catalog import SCHEMA, current_rows
from lookalike.functions import bits, image, media, paths
from lookalike.operators import annotate, clustering, ingest, keepers, pieces, similarity, views
from lookalike.sources import files, media as readers
from lookalike.streaming import events


def at(second):
    return dt.datetime(2025, 1, 1, 0, 0, second, tzinfo=dt.timezone.utc)


def test_current_rows_newest_wins_nulls_first_ties_by_value(spark):
    rows = [("/a", "visual", None, 1), ("/a", "visual", at(1), 2), ("/a", "faces", None, 3), ("/b", "visual", at(1), 4), ("/b", "visual", at(1), 5), (None, "visual", at(2), 6)]
    df = spark.createDataFrame(rows, "path string, mode string, last_scan timestamp, size bigint")
    assert sorted(map(tuple, current_rows(df, ["size"]).collect())) == [("/a", "faces", 3), ("/a", "visual", 2), ("/b", "visual", 5)]
    assert current_rows(df.limit(0), ["size"]).count() == 0


def sequential_leaders(edges, sizes):
    near = {}
    for a, b, s in edges:
        near.setdefault(a, {})[b] = s
        near.setdefault(b, {})[a] = s
    taken, out = set(), set()
    for p in sorted(sizes, key=lambda p: (-sizes[p], p)):
        if p in taken:
            continue
        taken.add(p)
        mine = [q for q in near.get(p, {}) if q not in taken]
        taken.update(mine)
        if mine:
            out |= {(p, p, 1.0)} | {(p, q, near[p][q]) for q in mine}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_leaders_equal_the_sequential_order(spark, seed):
    rng = random.Random(seed)
    names = [f"/n{i:02d}" for i in range(40)]
    sizes = {n: rng.randint(0, 9) for n in names}
    edges = {(min(a, b), max(a, b)): round(rng.random(), 3) for a, b in (rng.sample(names, 2) for _ in range(70))}
    edges = [(a, b, s) for (a, b), s in edges.items()]
    got = clustering.leaders(spark.createDataFrame(edges, "a string, b string, sim double"), spark.createDataFrame(list(sizes.items()), "path string, size bigint"))
    assert set(map(tuple, got.collect())) == sequential_leaders(edges, sizes)


def test_leaders_along_a_path_and_without_edges(spark):
    edges = [(f"/p{i:02d}", f"/p{i + 1:02d}", 0.9) for i in range(11)]
    sizes = [(f"/p{i:02d}", 100 - i) for i in range(12)]
    df = spark.createDataFrame(edges, "a string, b string, sim double")
    got = clustering.leaders(df, spark.createDataFrame(sizes, "path string, size bigint"))
    assert set(map(tuple, got.collect())) == sequential_leaders(edges, dict(sizes))
    assert clustering.leaders(df.limit(0), spark.createDataFrame(sizes, "path string, size bigint")).count() == 0


def test_block_pairs_are_exact_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"/f{i // 2:02d}", i % 2, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "path string, frame int, vec array<double>")
    want = {(rows[i][0], rows[i][1], rows[j][0], rows[j][1]) for i in range(90) for j in range(90) if rows[i][0] < rows[j][0] and x[i] @ x[j] >= 0.4}
    for block in (7, 1000):
        assert {(r.a, r.fa, r.b, r.fb) for r in similarity.block_pairs(df, 0.4, block).collect()} == want


def test_hashed_neighbours_find_most(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"/f{i:03d}", 0, v.tolist()) for i, v in enumerate(x)], "path string, frame int, vec array<double>")
    pairs = {(r.a, r.b) for r in similarity.nearest_frames_hashed(df, 0.5).collect()}
    assert sum((f"/f{i:03d}", f"/f{i + 60:03d}") in pairs for i in range(60)) >= 54


def test_acceptance_rules(spark):
    rows = [("/a", "/b", 0.6, 1.0, False, None), ("/a", "/c", 0.58, 0.2, True, 9), ("/a", "/d", 0.45, 0.2, True, 4), ("/a", "/e", 0.55, 1.0, False, 6), ("/a", "/f", 0.55, 1.0, False, 7), ("/a", "/g", 0.7, 0.1, True, None)]
    df = spark.createDataFrame(rows, "a string, b string, sim double, coverage double, multi boolean, bits int")
    assert {r.b for r in similarity.accepted(df, 0.65).collect()} == {"/b", "/d", "/e"}


def test_unusable_vectors_are_left_out(spark):
    rows = [("/a", [[1.0, 0.0]]), ("/b", None), ("/c", []), ("/d", [[math.nan, 1.0]]), ("/e", [[0.0, 0.0]]), ("/f", [[1.0]]), ("/g", [[1.0, math.inf]]), ("/h", [None])]
    df = spark.createDataFrame(rows, "path string, vector array<array<float>>")
    assert [r.path for r in similarity.frames(df, dims=2).collect()] == ["/a"]


def test_keeper_properties(spark):
    def better(a, b):
        base = {"size": 1 << 20, "resolution": "640x480", "duration": 10.0, "sharpness": 10.0, "mtime": 1.0, "watermark": 0.0}
        rows = [(1, f"/{n}", *({**base, **x}[c] for c in base)) for n, x in (("a", a), ("b", b))]
        df = spark.createDataFrame(rows, "cluster_id int, path string, size bigint, resolution string, duration double, sharpness double, mtime double, watermark double")
        return keepers.keepers(df, "smart").first().path

    assert better({}, {"size": 10 << 20}) == "/b"
    assert better({}, {"resolution": "1920x1080"}) == "/b"
    assert better({}, {"duration": 60.0}) == "/b"
    assert better({}, {"sharpness": 100.0}) == "/b"
    assert better({"size": 50 << 20, "resolution": "3840x2160", "sharpness": 100.0}, {"size": 200 << 20}) == "/a"


def test_keepers_overlay_order_and_options(spark):
    rows = [(1, "/x/exports/a.jpg", 9, 1.0), (1, "/x/b.jpg", 5, 2.0), (1, "/x/archive/c.jpg", 1, 3.0), (2, "/x/alone.jpg", 1, 1.0)]
    df = spark.createDataFrame(rows, "cluster_id int, path string, size bigint, mtime double").withColumns({c: F.lit(None).cast(k) for c, k in (("resolution", "string"), ("duration", "double"), ("sharpness", "double"), ("watermark", "double"))})
    kept = lambda **o: [tuple(r) for r in keepers.keepers(df, **o).collect()]
    assert kept(strategy="size", protected=["archive"], disliked=["exports"]) == [(1, "/x/archive/c.jpg")]
    assert kept(strategy="size", disliked=["exports"]) == [(1, "/x/b.jpg")]
    assert kept(strategy="no such") == kept(strategy="smart") == [(1, "/x/exports/a.jpg")]
    assert kept(strategy="date") == [(1, "/x/exports/a.jpg")]
    marked = keepers.marked(df.withColumn("is_ref", F.col("path") == "/x/b.jpg"), "size")
    assert [r.path for r in marked.collect()] == ["/x/archive/c.jpg"]
    assert keepers.truthy("Yes") and not keepers.truthy("0") and keepers.truthy(1)


def test_duplicate_kinds(spark):
    rows = [(1, "/a", 1, "h", "100x100"), (1, "/b", 2, "h", "100x100"), (1, "/c", 3, "h", "200x200"), (1, "/d", 4, "i", "100x50"), (1, "/e", 5, None, None)]
    df = spark.createDataFrame(rows, "cluster_id int, path string, pos int, phash string, resolution string")
    assert {r.path: r.dup_kind for r in annotate.dup_kind(df).collect()} == {"/a": "reference", "/b": "exact", "/c": "quality", "/d": "semantic", "/e": "semantic"}


def test_paths(spark):
    rows = ["/a/b/../c//d/./e.JPG", "/../x", "/", "", None, "/a/.hidden", "/a/b.tar.gz", "/ü/Ä.png/"]
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    assert [r[0] for r in df.select(paths.normal()).collect()] == ["/a/c/d/e.JPG", "/x", "/", None, None, "/a/.hidden", "/a/b.tar.gz", "/ü/Ä.png"]
    assert [r[0] for r in df.select(paths.suffix()).collect()][:7] == ["jpg", "", "", "", None, "", "gz"]
    one = spark.createDataFrame([("/ref/a",), ("/ref",), ("/reference/a",)], "path string")
    assert [r[0] for r in one.select(paths.under("path", "/ref/")).collect()] == [True, True, False]


def test_media_functions(spark):
    df = spark.createDataFrame([("640x480",), ("640X480",), ("0x4",), ("x",), (None,), ("4x",), ("1x2x3",)], "resolution string")
    assert [r[0] for r in df.select(media.area()).collect()] == [307200, 307200, 0, 0, 0, 0, 0]
    wm = spark.createDataFrame([(0.012,), (0.02,), (0.05,), (None,), (math.nan,)], "watermark double")
    assert [round(r[0], 6) for r in wm.select(media.penalty()).collect()] == [0, 0.096, 0.3, 0, 0]
    assert media.bars(0.65) == pytest.approx((0.5925, 0.4125)) and media.bars(0.0, "faces") == (0.42, 0.42)


def test_frame_hash_matches_column_form(spark):
    rng = np.random.default_rng(1)
    grids = rng.integers(0, 255, (20, 8, 9)).astype(float)
    df = spark.createDataFrame([(g.ravel().tolist(), g.tolist()) for g in grids], "cells array<double>, grid array<array<double>>")
    got = image.measured(df.select(bits.gradient_hash(F.col("cells")).alias("x"), "grid"), "grid", "dhash").collect()
    assert all(r.x == r.dhash for r in got)
    assert image.frame_hash(np.tile(np.arange(18.0), (1, 16, 1))).tolist() == [-1]


def test_image_kernels():
    flat, edge = np.full((1, 32, 32), 100.0), np.zeros((1, 32, 32))
    edge[:, :, 16:] = 200
    assert image.sharpness(flat) == 0 and image.sharpness(edge) > 0
    assert image.sharpness(np.zeros((1, 1, 5))) == 0
    # Below 4 pixels a side a block is one pixel high or wide; blocks of a single pixel don't count.
    small = np.zeros((1, 4, 9))
    small[0, 1, 3] = 50
    lap = image.second_differences(small)[0]
    assert lap[1, 3] == -200 and lap[0, 3] == 100 and image.sharpness(small)[0] == max(lap[y, x : x + 2].var() for y in range(4) for x in range(0, 8, 2))
    assert image.sharpness(np.eye(3)[None] * 255)[0] == 0
    boxed = np.full((1, 40, 40), 120.0)
    boxed[:, :8] = boxed[:, -8:] = 0
    assert image.lit_ratio(boxed)[0] == pytest.approx(0.6) and image.lit_ratio(np.zeros((1, 9, 9)))[0] == 1.0


def test_static_marks_count_at_the_pixel_left_of_and_above_the_step():
    rng = np.random.default_rng(0)
    film = rng.uniform(0, 255, (1, 40, 90, 160))
    film[:, :, 10:20, 10:30] = 255
    assert image.static_share(film[:, :2])[0] == 0 and image.static_share(np.full((1, 4, 9, 9), 3.0))[0] == 0
    film[:, :, 10:20, 15:] = 0
    still = np.zeros((90, 160), bool)
    still[10:20, 10:] = True
    mean = film[0].mean(axis=0)
    step = np.pad(np.abs(np.diff(mean, axis=1)), ((0, 0), (0, 1))) + np.pad(np.abs(np.diff(mean, axis=0)), ((0, 1), (0, 0)))
    assert step[15, 14] == 255 and step[15, 15] == 0
    assert image.static_share(film)[0] == pytest.approx((still & (step > 18)).mean())


def test_measured_handles_missing_and_ragged_pictures_and_builds_twice(spark):
    one = [[10.0] * 4] * 4
    rows = [(1, one), (2, None), (3, []), (4, [[1.0], [1.0, 2.0]]), (5, [[0.0] * 4] * 4), (6, [None, [1.0]])]
    for _ in range(2):
        df = spark.createDataFrame(rows, "id int, picture array<array<double>>")
        got = {r.id: (r.content_ratio, r.sharpness, r.dhash is None) for r in image.measured(df, "picture", "content_ratio", "sharpness", "dhash").collect()}
        assert got == {1: (1.0, 0.0, False), 2: (1.0, 0.0, True), 3: (1.0, 0.0, True), 4: (1.0, 0.0, True), 5: (1.0, 0.0, False), 6: (1.0, 0.0, True)}
        assert image.measured(df.limit(0), "picture", "sharpness").count() == 0


def test_pictures_survive_writing_and_reading():
    rng = np.random.default_rng(2)
    frame = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    assert (readers.decode_png(readers.encode_png(frame)) == frame).all()
    lines = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    raw, before = b"", np.zeros((7, 3), int)
    for y, sort in enumerate((1, 2, 3, 4, 0)):
        row, out = np.vstack([np.zeros((1, 3), int), lines[y].astype(int)]), []
        for x in range(1, 7):
            left, up, corner = row[x - 1], before[x], before[x - 1]
            guess = left + up - corner
            far = np.abs(np.stack([guess - left, guess - up, guess - corner]))
            paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
            out.append((row[x] - (0, left, up, (left + up) // 2, paeth)[sort]) % 256)
        raw, before = raw + bytes([sort]) + np.array(out, np.uint8).tobytes(), row
    png = readers.encode_png(lines)
    start = png.index(b"IDAT")
    body = zlib.compress(raw)
    assert (readers.decode_png(png[: start - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + bytes(4)) == lines).all()
    assert readers.fitted(np.zeros((300, 900, 3), np.uint8), 256).shape == (85, 256, 3) and readers.fitted(frame, 256) is frame


def test_faces_are_cropped_by_probability():
    frame = np.arange(100 * 100 * 3, dtype=np.uint32).reshape(100, 100, 3)
    assert readers.cropped(frame, []) is None and readers.cropped(frame, [((40, 40, 60, 60), 0.95)]) is None
    assert readers.cropped(frame, [((40, 40, 60, 60), 0.96), ((0, 0, 10, 10), 0.99)]).shape == (26, 26, 3)
    assert readers.cropped(frame, [((40, 50, 60, 60), 0.96)]).shape == (42, 52, 3)


def test_hash_distance(spark):
    rows = [([0b11111, -1], [0b11110000000000011111]), ([-1, 0], [0b11111]), (None, [0b11111]), ([0b1111100], [0b1111100])]
    df = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>")
    assert [r[0] for r in df.select(bits.least_distance("x", "y")).collect()] == [4, None, None, 0]


def test_ingest(spark):
    schema = "path string, mode string, size bigint, mtime double, vector array<array<float>>, last_scan timestamp"
    cat = spark.createDataFrame([("/a", "visual", 1, 1.0, [[1.0]], at(1)), ("/b", "visual", 1, 1.0, None, at(1)), ("/c", "visual", 1, 1.0, [[1.0]], at(1)), ("/a", "faces", 1, 1.0, [[1.0]], at(1))], schema)
    listing = spark.createDataFrame([("/a", 1, 1.0), ("/b", 1, 1.0), ("/c", 2, 1.0), ("/d", 1, 1.0), ("/e", 0, 1.0), ("/a", 1, 1.0)], "path string, size bigint, mtime double")
    visual = cat.where("mode = 'visual'")
    assert {r.path: r.status for r in ingest.diff(listing, visual).collect()} == {"/a": "hit", "/b": "vectorless", "/c": "changed", "/d": "new"}
    assert sorted(r.path for r in ingest.pending(listing, visual).collect()) == ["/b", "/c", "/d"]
    moved = ingest.move(cat, spark.createDataFrame([("/a", "/c"), ("/c", "/z")], "src string, dst string")).collect()
    assert sorted((r.path, r.mode) for r in moved) == [("/b", "visual"), ("/c", "faces"), ("/c", "visual"), ("/z", "visual")]
    gone = spark.createDataFrame([("/a",)], "path string")
    assert ingest.delete(cat, gone).count() == 2 and ingest.delete(cat, gone, "faces").count() == 3
    fresh = spark.createDataFrame([("/b", "visual", 7, 1.0, [[2.0]], at(2)), ("/q", "visual", 7, 1.0, None, at(2))], schema)
    assert {(r.path, r.mode): r.size for r in ingest.upsert(cat, fresh, ["size"]).collect()}[("/b", "visual")] == 7
    assert ingest.purge(cat).count() == 0 and ingest.purge(cat, "faces").count() == 3


def test_listing_catalog_and_readers(spark, tmp_path):
    lib = tmp_path / "lib"
    (lib / "sub" / ".cache").mkdir(parents=True)
    for name, size in (("a.JPG", 5), ("b.txt", 3), ("empty.jpg", 0), (".dot.jpg", 4), ("sub/c.cbz", 0), ("sub/.cache/d.jpg", 4)):
        (lib / name).write_bytes(b"x" * size)
    (tmp_path / "away").mkdir()
    (tmp_path / "away" / "e.jpg").write_bytes(b"x")
    (lib / "linked.jpg").symlink_to(lib / "a.JPG")
    (lib / "linked").symlink_to(tmp_path / "away")
    with zipfile.ZipFile(lib / "sub" / "c.cbz", "w") as z:
        z.writestr("1.png", b"no picture")
    rows = files.listing(spark, [str(lib), str(lib / "sub"), str(lib / "none")], ["jpg", ".cbz"])
    assert sorted(r.path.rsplit("/", 1)[-1] for r in rows.collect()) == ["a.JPG", "c.cbz"]
    assert "content:binary" not in rows._jdf.queryExecution().executedPlan().toString()
    every = files.listing(spark, [str(lib)])
    got = {r.path.rsplit("/", 1)[-1]: (r.frames, r.error is not None) for r in readers.features(every).collect()}
    assert got == {"a.JPG": (0, True), "b.txt": (0, True), "c.cbz": (0, True)}
    assert files.listing(spark, []).count() == 0 and files.listing(spark, [str(lib / "none")]).count() == 0
    row = spark.createDataFrame([("/a", 1, 2.0, None, None, None, None, None, None, None, None, [[1.0, 2.0], [3.0, 4.0]], None, at(1), "visual")], SCHEMA)
    files.write_catalog(row, str(tmp_path / "cat"))
    assert files.read_catalog(spark, str(tmp_path / "cat")).first().vector == [[1.0, 2.0], [3.0, 4.0]]
    files.append_catalog(row.withColumn("size", F.lit(9).cast("bigint")).withColumn("last_scan", F.lit(at(2))), str(tmp_path / "cat"))
    files.compact_catalog(spark, str(tmp_path / "cat"), str(tmp_path / "less"), 1)
    assert [r["size"] for r in files.read_catalog(spark, str(tmp_path / "less")).collect()] == [9]
    assert readers.indices(100, "video") == [15, 30, 50, 70, 85] and readers.indices(3, "pdf") == [0] and readers.indices(0, "gif") == []


def test_hashes_of_whole_and_sampled_files(spark, tmp_path):
    import hashlib

    content = bytes(range(256)) * 40
    (tmp_path / "a.bin").write_bytes(content)
    (tmp_path / "b.bin").write_bytes(b"y" + content[1:])
    (tmp_path / "c.bin").write_bytes(content[:1] + b"z" + content[2:])
    rows = files.listing(spark, [str(tmp_path)])
    hashes = lambda **options: {r.path[-5]: r.phash for r in files.hashed(rows.withColumn("mtime", F.lit(1.0)), **options).collect()}
    whole = hashes()
    assert whole["a"] == hashlib.sha256(content).hexdigest() and len(set(whole.values())) == 3
    sampled = hashes(whole=100, sample=1)
    assert sampled["a"] == sampled["c"] != sampled["b"]
    assert hashlib.sha256(bytes(content[1024 * i] for i in range(10)) + b"10240_1.0_.bin").hexdigest() == sampled["a"]
    gone = rows.withColumn("path", F.concat("path", F.lit("x")))
    assert all(r.phash.startswith("FAIL_") for r in files.hashed(gone).collect())


def test_thumbnails_are_stored_by_key(spark, tmp_path):
    bars = np.zeros((900, 1000, 3), np.uint8)
    bars[100:800] = 200
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(readers.encode_png(bars))
    (tmp_path / "in" / "b.png").write_bytes(b"broken")
    rows = files.listing(spark, [str(tmp_path / "in")])
    files.write_thumbnails(readers.thumbnails(rows, readers.encode_png), rows, str(tmp_path / "thumbs"))
    stored = spark.read.parquet(str(tmp_path / "thumbs"))
    got = {r.path[-5]: r for r in files.with_thumbnails(rows, stored).collect()}
    assert readers.decode_png(bytes(got["a"].picture)).shape == (576, 640, 3) and got["a"].ratio == pytest.approx(0.78, abs=0.01) and got["b"].picture is None
    assert files.with_thumbnails(rows.withColumn("size", F.col("size") + 1), stored).where("picture is not null").count() == 0


@pytest.mark.parametrize("most", [1, 7, 50])
def test_numbers_are_dense_in_order(spark, most):
    rng = random.Random(most)
    rows = [(rng.randint(0, 5), i) for i in range(200)]
    from lookalike.operators.numbering import numbered

    got = numbered(spark.createDataFrame(rows, "k int, id int").repartition(5), "n", F.col("k").desc(), "id").collect()
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r.n for r in got) == list(range(1, 201))
    assert numbered(spark.createDataFrame([], "k int"), "n", "k").count() == 0
    step = max(1, 200 // most)
    assert sorted(r.id for r in views.stride_sample(spark.createDataFrame(rows, "k int, id int").select("id"), "id", most).collect()) == list(range(0, step * most, step))[:most]


def test_cells_find_nearly_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    rows = [(f"/{g:02d}_{i}", 0, (c + 0.4 * rng.standard_normal(16)).tolist()) for g, c in enumerate(centres) for i in range(6)]
    unit = similarity.centred(spark.createDataFrame(rows, "path string, frame int, vec array<double>")).cache()
    want = {(r.a, r.b) for r in similarity.block_pairs(unit, 0.7).collect()}
    for options in ({"cells": 40, "probes": 12}, {"cells": 40, "probes": 12, "block": 4}):
        got = {(r.a, r.b) for r in similarity.cell_pairs(unit, 0.7, **options).collect()}
        assert got <= want and len(got) >= 0.95 * len(want) > 500
    assert similarity.cell_pairs(unit.limit(0), 0.7).count() == 0


def library(seed, groups=40, dims=64):
    """Items of one to three frames around common centres, at cosines on both sides of every bar, with close and far hashes."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        centre, code = [rng.gauss(0, 1) for _ in range(dims)], rng.getrandbits(63)
        for i in range(6):
            frames = [[x + rng.choice((0.3, 0.8, 1.1)) * rng.gauss(0, 1) for x in centre] for _ in range(rng.choice((1, 1, 1, 2, 3)))]
            hashes = [code ^ sum(1 << rng.randrange(63) for _ in range(rng.choice((0, 1, 2, 4)))) for _ in frames]
            rows.append((f"/{rng.randrange(10)}/{g:02d}_{i}é", rng.choice((hashes, hashes, [0], None, [None, *hashes])), frames))
    return rows


def brute_edges(rows, slider):
    """Peak, coverage and bits of every two items, one after another."""
    bar, prefilter = media.bars(slider)
    mean = np.array([f for _, _, frames in rows for f in frames], np.float32).astype(float).mean(axis=0)
    unit = [(p, h, np.array(f, np.float32).astype(float) - mean) for p, h, f in rows]
    unit = sorted((p, h, v / np.linalg.norm(v, axis=1, keepdims=True)) for p, h, v in unit)
    out = {}
    for i, (a, ha, va) in enumerate(unit):
        for b, hb, vb in unit[i + 1 :]:
            cos = va @ vb.T
            peak, multi = cos.max(), max(cos.shape) > 1
            if peak < prefilter:
                continue
            covered = min((cos.max(axis=1) >= 0.55).sum(), (cos.max(axis=0) >= 0.55).sum()) / min(cos.shape) if multi else 1.0
            far = [(x ^ y).bit_count() for x in ha or () for y in hb or () if x is not None and y is not None and 5 <= x.bit_count() <= 59 and 5 <= y.bit_count() <= 59]
            distance, sim = min(far, default=64), peak - 0.25 * (1 - covered)
            lower = 0.18 if distance <= 4 else 0.05 if distance <= 6 else 0.0
            if not (multi and distance > 4 and covered < 0.3) and sim >= bar - lower:
                out[a, b] = round(sim, 6)
    return out


@pytest.mark.parametrize("files,piece", [(1, 1 << 15), (5, 1 << 15), (5, 16), (2, 50)])
def test_edges_are_exact_over_many_files_and_pieces(spark, monkeypatch, files, piece):
    monkeypatch.setattr(pieces, "PIECE", piece)
    rows = library(files)
    df = spark.createDataFrame(rows, "path string, dhash array<bigint>, vector array<array<float>>").repartition(files)
    want = brute_edges(rows, 0.65)
    got = similarity.edges(df, 0.65).collect()
    assert {(r.a, r.b): round(r.sim, 6) for r in got} == pytest.approx(want, abs=2e-6) and len(got) == len(want) > 200
    assert similarity.edges(df.limit(0), 0.65).count() == 0


def test_tiles_and_slabs_change_no_pair(monkeypatch):
    rows = library(4, groups=12)
    table = pa.table({"path": [r[0] for r in rows], "dhash": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "vector": pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.float32())))})
    seen = []
    for tile, compared in (((1024, 512), 1 << 20), ((7, 13), 10), ((64, 1), 3)):
        monkeypatch.setattr(pieces, "TILE", tile)
        monkeypatch.setattr(pieces, "COMPARED", compared)
        one, rest = pieces.items_of(table.slice(0, 30), 0, [0.0] * 64), pieces.items_of(table.slice(20), 20, [0.0] * 64)
        a, b, peak, coverage, multi = pieces.met(one, rest, True, 0.4, 0.55, True)
        seen.append([*zip(a.tolist(), (b + 20).tolist(), peak.round(9).tolist(), coverage.tolist(), multi.tolist(), pieces.fewest_bits(one, rest, a, b).tolist())])
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 25 and all(x < y for x, y, *_ in seen[0])


def test_the_similarity_join_shuffles_nothing_and_writes_each_frame_once(spark):
    df = spark.createDataFrame(library(9), "path string, dhash array<bigint>, vector array<array<float>>")
    plan = similarity.edges(df, 0.65)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    plan = similarity.verified(df, 0.65)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["leader_clusters", "duplicate_report"])
def test_clusters_make_their_edges_once(spark, monkeypatch, name):
    from harness import DATA
    from lookalike.plans import registry

    plans, stage = {}, clustering.stage_table

    def noted(df, table):
        plans.setdefault(table, df._jdf.queryExecution().executedPlan().toString())
        return stage(df, table)

    monkeypatch.setattr(clustering, "stage_table", noted)
    assert registry.QUERIES[name](spark, DATA).count() > 0
    ways = plans["ways"].split("Initial Plan")[0]
    assert ways.count("MapInArrow") == 1 and "FlatMapGroupsInArrow" not in ways


def test_report_shuffles_ways_and_facts_once_by_path(spark, monkeypatch):
    from harness import DATA
    from lookalike.plans import registry

    plans, stage = {}, clustering.stage_table

    def noted(df, table):
        plans.setdefault(table, df._jdf.queryExecution().executedPlan().toString())
        return stage(df, table)

    monkeypatch.setattr(clustering, "stage_table", noted)
    last = registry.QUERIES["duplicate_report"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(path#\d+, (other|mode)#", plans["ways"] + last)
    above = [x for x in plans["ways"].split("MapInArrow")[0].splitlines() if "Exchange" in x]
    assert "REPARTITION_BY_COL" in above[-1]  # ways are shuffled before any join: none is planned on a guess of their number
    assert "other" in plans["members"] and "other" not in last  # the report reads the members that were staged, not the ways


def test_kept_edges_are_read_without_staging_frames_again(spark, monkeypatch):
    from harness import DATA
    from lookalike.plans import registry, similarity_queries

    staged, stage = [], similarity.stage_table
    monkeypatch.setattr(similarity, "stage_table", lambda df, name: staged.append(name) or stage(df, name))
    monkeypatch.setattr(similarity_queries, "result_key", lambda *_: f"edges-{id(staged)}-{os.getpid()}")
    first = sorted(map(tuple, registry.QUERIES["edges_cached"](spark, DATA).collect()))
    assert first and staged == ["frames"]
    assert sorted(map(tuple, registry.QUERIES["edges_cached"](spark, DATA).collect())) == first and staged == ["frames"]


def test_pairs_are_rounded_as_by_round_without_decimals(spark):
    from harness import DATA
    from lookalike.plans import registry
    from lookalike.plans.similarity_queries import six_places

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(x),) for x in [0, 0.25, 1 / 3, 0.4125, 1, 1 + 2e-16, *rng.random(20_000)]], "x double")
    assert df.where(F.round("x", 6) != six_places("x")).count() == 0
    assert "round(" not in registry.QUERIES["pair_peak_coverage"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_views(spark):
    rows = [(1, "/a/x.jpg", 1, 0.9, 5, False), (1, "/a/y.pdf", 2, 0.8, 7, True), (2, "/b/z.mp4", 1, 1.0, 3, False), (2, "/b/x.xyz", 2, None, None, False)]
    df = spark.createDataFrame(rows, "cluster_id int, path string, pos int, similarity double, size bigint, is_ref boolean")
    assert [r.path for r in views.visible(df, None, "Z.").collect()] == ["/b/z.mp4"]
    assert {r.path for r in views.visible(df, None, "cluster 1").collect()} == {"/a/x.jpg", "/a/y.pdf"}
    stats = {r.kind: (r.files, r.bytes, r.dups, r.share) for r in views.statistics(df).collect()}
    assert stats == {"image": (1, 5, 0, 25), "document": (2, 7, 2, 50), "video": (1, 3, 0, 25)}
    picked = spark.createDataFrame([("/a/x.jpg",), ("/b/z.mp4",)], "path string")
    assert {r.cluster_id: r.state for r in views.check_states(df, picked).collect()} == {1: "all", 2: "some"}
    assert tuple(views.savings(df, picked).first()) == (2, 8)
    plan = spark.createDataFrame([("/a/x.jpg",), ("/b/x.jpg",)], "path string")
    assert sorted(map(tuple, views.move_plan(plan, "/k").collect())) == [("/a/x.jpg", "/k/x.jpg", "moved"), ("/b/x.jpg", "/k/x.jpg", "failed")]
    assert [r.id for r in views.stride_sample(spark.range(100).select("id"), "id", 4).collect()] == [0, 25, 50, 75]


def test_event_stream_prunes_and_restarts(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, events.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))

    put("a", [(at(1), "/a", "deleted", at(2)), (at(1), "/b", " MODIFIED", at(2)), (at(1), None, "deleted", at(2)), (at(1), "/c", None, at(2))])
    seen = []
    take = lambda rows, n: seen.extend((r.path, r.event_type, r["at"], r.got) for r in rows.collect())
    run = lambda: events.prune(events.read(spark, str(tmp_path / "log")), take, str(tmp_path / "ckpt")).awaitTermination()
    gone = lambda listed=None: sorted(r.path for r in events.gone(spark.createDataFrame(seen, "path string, event_type string, at bigint, got bigint"), listed).collect())
    run()
    assert gone() == ["/a"]
    put("b", [(at(3), "/b", "Moved", at(4)), (at(3), "/a", "created", at(4))])
    run()
    assert len(seen) == 4 and gone() == ["/b"]
    assert gone(spark.createDataFrame([("/b",)], "path string")) == []


def test_event_states(spark):
    rows = [(at(1), "/a", "deleted", at(9)), (at(2), "/a", "created", at(2)), (at(5), "/b", "moved", None), (at(5), "/b", "created", at(5)), (None, "/c", "deleted", at(1))]
    df = spark.createDataFrame(rows, events.SCHEMA)
    assert {r.path: r.event_type for r in events.last_states(df).collect()} == {"/a": "created", "/b": "created"}
    twice = events.coalesced(df.union(df)).where("path = '/a'").collect()
    assert sorted(r.events for r in twice) == [2, 2]


def test_features_embed_and_pick(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    frame = np.full((600, 300, 3), 90, np.uint8)
    frame[:, :, 1] = 180
    (tmp_path / "b.png").write_bytes(readers.encode_png(frame))
    rows = files.listing(spark, [str(tmp_path)])

    def embedder():
        return lambda frames: np.array([[f.shape[0], f[..., 1].mean()] for f in frames], float)

    def detector():
        return lambda f: [((0, 0, 100, 100), 0.99 if f.shape[0] > 500 else 0.5)]

    got = {r.path[-5]: r for r in readers.features(rows, embedder).collect()}
    assert got["a"].error and got["a"].vector is None and got["a"].frames == 0
    assert got["b"].resolution == "300x600" and got["b"].vector[0] == pytest.approx([512 / math.hypot(512, 180), 180 / math.hypot(512, 180)], abs=1e-5)
    faces = {r.path[-5]: r.vector for r in readers.features(rows, embedder, "faces", detector).collect()}
    assert faces["a"] is None and faces["b"][0] == pytest.approx([116 / math.hypot(116, 180), 180 / math.hypot(116, 180)], abs=1e-5)
    blurred, sharp = np.full((20, 20, 3), 9, np.uint8), np.tile(np.array([[0], [200]], np.uint8)[None], (20, 10, 3)).reshape(20, 20, 3)
    assert readers.chosen("pdf", [blurred, sharp, sharp])[0] is sharp and len(readers.chosen("gif", [blurred, sharp])) == 2


def test_phases_and_cached_tables(spark):
    from lookalike.session import cached_table, phase

    took, held, key = {}, {}, f"test-{time.time_ns()}"
    with phase(spark, "count", took, held):
        assert cached_table(spark.range(3), key).count() == 3
    assert took["count"] > 0 and held["count"] > 10 and cached_table(spark.range(9), key).count() == 3


def test_results_are_kept_until_files_or_settings_change(spark):
    from lookalike.session import cached_table, result_key, shared_dir

    rows = spark.createDataFrame([("/a", 1, 1.0), ("/b", 2, 2.0)], "path string, size bigint, mtime double")
    key = result_key(rows, "visual", 0.5)
    assert key == result_key(rows.orderBy(F.desc("path")), "visual", 0.5)
    assert len({key, result_key(rows, "faces", 0.5), result_key(rows, "visual", 0.6), result_key(rows.limit(1), "visual", 0.5)}) == 4
    family = f"family-{time.time_ns()}"
    assert cached_table(spark.range(3), "one", family).count() == 3 and cached_table(spark.range(4), "one", family).count() == 3
    assert cached_table(spark.range(4), "two", family).count() == 4 and cached_table(spark.range(5), "one", family).count() == 5
    assert shared_dir(spark)


def test_actions_on_files(spark, tmp_path):
    from lookalike.sources import actions

    for name in ("a", "b", "c", "d/e", "kept/c"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "link").symlink_to(tmp_path / "a")
    paths = lambda *names: spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string")
    assert {r.path[-1]: r.status for r in actions.delete(paths("link", "d", "z", "link")).collect()} == {"k": "deleted", "d": "deleted", "z": "failed"}
    assert (tmp_path / "a").exists() and not (tmp_path / "d").exists() and not (tmp_path / "link").is_symlink()
    assert [r.status for r in actions.trash(paths("a"), str(tmp_path / "away")).collect()] == ["deleted"]
    assert [p.read_text() for p in (tmp_path / "away").iterdir()] == ["a"]
    plan = views.move_plan(paths("b", "c"), str(tmp_path / "kept"))
    assert {r.path[-1]: r.status for r in actions.move(plan).collect()} == {"b": "moved", "c": "failed"}
    assert (tmp_path / "kept" / "c").read_text() == "kept/c" and (tmp_path / "c").exists()


def test_runs_of_events_count_once(spark):
    rows = [(at(1), "/a", "created", None), (at(2), "/a", "modified", None), (at(5), "/a", "deleted", None), (at(1), "/b", "moved", None), (None, "/b", "moved", None)]
    got = {(r.path, r.event_type, r.events) for r in events.debounced(spark.createDataFrame(rows, events.SCHEMA), "2 seconds").collect()}
    assert got == {("/a", "modified", 2), ("/a", "deleted", 1), ("/b", "moved", 1)}
