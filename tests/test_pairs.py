"""Least distances of all objects, against brute force."""

import math
import re
import threading

import numpy as np
import pytest

from cellplan.operators import interaction, measure, pairs

SPACING = (2.0, 0.7, 0.3)


def voxels(n, seed):
    """Rows (image, label, z, y, x) of scattered objects, few of them large."""
    rng = np.random.default_rng(seed)
    return sorted({(int(rng.integers(2)), int(rng.zipf(1.5)) % 12, int(rng.integers(3)), int(rng.integers(-20, 90)), int(rng.integers(60))) for _ in range(n)})


def brute(a, b, own):
    out = {}
    for p in a:
        for q in b:
            if p[0] == q[0] and (not own or p[1] < q[1]):
                d = math.dist([c * s for c, s in zip(p[2:], SPACING, strict=True)], [c * s for c, s in zip(q[2:], SPACING, strict=True)])
                out[p[0], p[1], q[1]] = min(d, out.get((p[0], p[1], q[1]), d))
    return out


@pytest.mark.parametrize("few", [1024, 20])
def test_all_distances(spark, few):
    """Objects that meet in blocks, and those that are too large for it."""
    a, b = voxels(150, 1), voxels(120, 2)
    table = lambda rows: spark.createDataFrame(rows, "image int, label bigint, z bigint, y bigint, x bigint")
    for own in (True, False):
        got = pairs.all_distances(table(a), None if own else table(b), ("image",), SPACING, 3, cell=8, few=few).collect()
        want = brute(a, a if own else b, own)
        assert len(got) == len(want) and {(r.image, r.alabel, r.blabel) for r in got} == want.keys()
        assert all(abs(r.d - want[r.image, r.alabel, r.blabel]) < 1e-4 for r in got)


def test_matrix_moves_no_pairs(spark):
    """The pairs are made where they are given out: nothing groups or sorts them."""
    labels = spark.range(400).selectExpr("id AS label", "CAST(0 AS BIGINT) AS z", "id * 2 div 40 AS y", "id * 2 % 40 AS x")
    out = measure.distance_matrix(labels, dims=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(Aggregate|Window|Sort) \[[^\]]*label", plan)
    assert out.count() == 400 * 399 // 2


def test_cross_distances_of_long_objects(spark):
    """Two channels of long parallel objects, 200,000 surface points each: their points don't all meet."""
    line = lambda n, at: spark.range(n).selectExpr("CAST(1 AS BIGINT) AS label", "CAST(0 AS BIGINT) AS z", "id AS y", f"CAST({at} AS BIGINT) AS x")
    far = line(200_000, 50).unionByName(spark.sql("SELECT CAST(2 AS BIGINT) AS label, CAST(0 AS BIGINT) AS z, CAST(200010 AS BIGINT) AS y, CAST(7 AS BIGINT) AS x"))
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = interaction.cross_distances(line(200_000, 7), far).collect()
    finally:
        late.cancel()
    assert {(r.channel_a_label, r.channel_b_label): r.distance_um for r in got} == {(1, 1): 43.0, (1, 2): 11.0}


def test_blocks_are_written_once(spark, monkeypatch):
    """Many blocks, of one image, of several and of two channels: all pairs are right, and no exchange has more rows than there are blocks."""
    monkeypatch.setattr(pairs, "BLOCK", 16)
    rows = [(k % 40 if k % 3 else 41, k, k % 3, k * 7 % 90, k * 11 % 60) for k in range(300)]
    table = lambda rows, by: spark.createDataFrame(rows, "image int, label bigint, z bigint, y bigint, x bigint").drop(*({"image"} - set(by)))
    for by, own in (((), True), (("image",), True), (("image",), False)):
        a, b = rows, rows if own else rows[::4]
        out = pairs.all_distances(table(a, by), None if own else table(b, by), by, SPACING, 3)
        got = out.collect()
        want = brute([r if by else (0, *r[1:]) for r in a], [r if by else (0, *r[1:]) for r in b], own)
        assert len(got) == len(want) and {(r.image if by else 0, r.alabel, r.blabel) for r in got} == want.keys()
        assert all(abs(r.d - want[r.image if by else 0, r.alabel, r.blabel]) < 1e-4 for r in got)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan
        made = re.findall(r"\n[^\n]*Generate ", plan)
        assert not made  # nothing is repeated for those that it meets
