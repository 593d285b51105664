import math

import numpy as np

from cellplan.llm import ann


def brute(rows, queries, k):
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in queries:
        s = x @ x[list(ids).index(q)]
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
        out[q] = [int(ids[j]) for j in order]
    return out


def test_chi_square():
    assert abs(ann.chi_square(0.95, 1) - 3.841459) < 1e-5 and abs(ann.chi_square(0.5, 8) - 7.344121) < 1e-5 and abs(ann.chi_square(0.99, 10) - 23.209251) < 1e-5


def test_recall_on_table(spark):
    d = "/root/testdata/sf0.1"
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got: dict = {}
    for x in sorted(ann.op5_ann_search(spark, d).collect(), key=lambda x: (x.query_id, x["rank"])):
        got.setdefault(x.query_id, []).append(x)
    want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert got.keys() == want.keys()
    assert all([x["rank"] for x in v] == [1, 2, 3, 4, 5] for v in got.values())
    by = {i: np.array(v, float) for i, v in rows}
    for q, v in got.items():
        for x in v:
            assert math.isclose(x.score, by[q] @ by[x.vec_id] / np.linalg.norm(by[q]) / np.linalg.norm(by[x.vec_id]), abs_tol=1e-12)
        assert [x.score for x in v] == sorted((x.score for x in v), reverse=True)
    assert np.mean([len({x.vec_id for x in got[q]} & set(want[q])) / 5 for q in want]) >= 0.9


def test_recall_over_cells(spark):
    """At the default chance, over many cells, on clustered vectors and on vectors without any structure."""
    r = np.random.default_rng(8)
    centres = r.standard_normal((40, 24))
    for rows in (r.standard_normal((3000, 16)), centres[r.integers(0, 40, 3000)] + 0.3 * r.standard_normal((3000, 24))):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id bigint, embedding array<double>")
        got: dict = {}
        for x in ann.nearest(df, df.where("vec_id % 50 = 0"), cell=200, sample=1500).collect():
            got.setdefault(x.query_id, set()).add(x.vec_id)
        want = brute(list(enumerate(rows)), range(0, 3000, 50), 5)
        assert np.mean([len(got[q] & set(want[q])) / 5 for q in want]) >= 0.9


def test_cells():
    """Every row lies in its cell's box, boxes near a point are found, and clustered points reach few cells."""
    r = np.random.default_rng(2)
    low = r.standard_normal((4000, 6)) + 6 * r.integers(0, 4, (4000, 1))
    cells = ann.Cells(low[:2000], 3, 16)
    own = cells.of(low) - 3
    assert len(np.unique(own)) == len(cells.floor) == 16 and np.bincount(own).max() < 2.5 * 4000 / 16
    assert ((cells.floor[own] <= low) & (low <= cells.roof[own])).all()
    for p, k in zip(low[:100], own, strict=False):
        assert k + 3 in cells.within(p, 0.0)
        near = np.unique(own[((low - p) ** 2).sum(axis=1) <= 1.0]) + 3
        assert set(near) <= set(cells.within(p, 1.0)) and len(cells.within(p, 1.0)) < 16
    assert len(ann.Cells(np.ones((50, 3)), 0, 8).floor) == 1 == len(ann.Cells(np.empty((0, 3)), 0, 8).floor)


def test_cells_copies_and_odd_rows(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((300, 6)).round(3).tolist()
    rows = [(i, base[i % 300] if i < 900 else base[0]) for i in range(1400)]  # copies, and a hot vector
    odd = [(None, base[1]), (2000, None), (2001, [0.0] * 6), (2002, [math.nan] * 6), (2003, [None] * 6), (2004, [math.inf] * 6), (2005, [1.0, 2.0]), (2006, []), (0, base[0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id bigint, embedding array<double>, score string")
    asked = [0, 50, 301, 1000, 1399]
    out = ann.nearest(df, df.where(df.vec_id.isin([*asked, 2005, 2001])), chance=1 - 1e-12, cell=60, sample=200).collect()
    got: dict = {}
    for x in sorted(out, key=lambda x: (x.query_id, x["rank"])):
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == brute(rows, asked, 5)
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 1")).collect()
    assert sorted(x.vec_id for x in few) == [0, 2]
    # Exact ties over many cells and parts: copies far apart in id, the smallest ids first.
    ties = spark.createDataFrame([(i, [float(i % 7 == k) + 1e-3 * k for k in range(8)], 0) for i in range(600)], "vec_id bigint, embedding array<double>, label int")
    for x in ann.nearest(ties, ties.where("vec_id = 300"), k=9, cell=20, sample=100).collect():
        assert x.vec_id == [i for i in range(600) if i % 7 == 300 % 7 and i != 300][x["rank"] - 1]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0
