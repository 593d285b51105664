import random

import numpy as np

from cellplan.llm import neardup as nd


def brute(rows, percent=80, size=2):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, nd.shingles(t, size)) for i, t in rows if i is not None]
    for k, (i, s) in enumerate(sets):
        for j, u in sets[:k]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def edited(r, words, share):
    return [w if r.random() > share else r.choice("abcdefgh") + str(r.randrange(900)) for w in words]


def test_words_and_sketch():
    assert nd.words_of("A b\tC\x0bÄ\x1cx") == [b"a", b"b", b"c", "Ä\x1cx".encode()]
    assert nd.shingles("x") == {(b"x",)} and nd.shingles(" \n") == set() == nd.shingles(None)
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(1000 * 2 * share / (1 + share))
        got = [float((nd.sketch(x[k : k + 1000]) == nd.sketch(x[k + 1000 - n : k + 2000 - n])).mean()) for k in range(0, 900, 60)]
        assert abs(np.mean(got) - share) < 0.04
    assert len(set(nd.sketch(x[:1]).tolist())) == nd.BINS


def test_against_brute_force(spark):
    r = random.Random(3)
    rows, n = [], 0
    for _ in range(30):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 12, 60, 200]))]
        for _ in range(r.randrange(1, 7)):
            rows.append((n, " ".join(edited(r, base, r.choice([0, 0, 0.02, 0.05, 0.12])))))
            n += 1
    chain = [f"c{k}" for k in range(120)]  # each is near the next only
    for k in range(12):
        rows.append((n + 40 - k, " ".join([*(f"d{x}" for x in range(k * 6)), *chain[k * 6 :]])))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "one two"), (0, rows[0][1]), (None, "one two"), (906, "x " * 20_000), (907, "x\n" * 15_000), (3, "quite another text"), (3, "and a third one"), (908, "and a third one")]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "s", 1, "b") for i, t in rows], "doc_id bigint, text string, rep string, n int, bands string").repartition(5)
    got = nd.op8_minhash_near_dedup(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {x.doc_id: x.component_id for x in got if x.doc_id is not None} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got if x.doc_id is not None)
    assert sorted((x.doc_id or -1, x.n_shingles) for x in got) == sorted((i or -1, len(nd.shingles(t))) for i, t in rows)
    kept = nd.keep_one(df.withColumnRenamed("bands", "_kept_id")).withColumnRenamed("_kept_id", "bands")
    assert kept.columns == df.columns
    assert sorted((x.doc_id, x.text or "") for x in kept.collect() if x.doc_id is not None) == sorted({(i, t or "") for i, t in rows if i is not None and want[i] == i})


def test_hot_group_of_near_copies(spark):
    """Copies with edits of very different extent: many are near the group but linked with no member, or with a few."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(edited(r, base, r.random() ** 2 * 0.14))) for k in range(260)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = brute(rows)
    assert len(set(want.values())) > 20
    assert {x.doc_id: x.component_id for x in nd.op8_minhash_near_dedup(df).collect()} == want


def test_whole_table(spark):
    """No link is lost: components of all documents as an index of all their shingles gives them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for size in (2, 5):
        root = {i: i for i in texts}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        index: dict = {}
        sets = {i: nd.shingles(t, size) for i, t in texts.items()}
        for i in sorted(sets):
            both: dict = {}
            for x in sets[i]:
                for j in index.setdefault(x, []):
                    both[j] = both.get(j, 0) + 1
                index[x].append(i)
            for j, n in both.items():
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, size=size).collect()}
        assert got == {i: find(i) for i in texts}


def test_rows_that_move(spark):
    """Members of a hot group that are each a component of their own meet each other in rows that grow with their number."""
    for hold, each in (("1", nd.BLOCK), ("n", nd.HELD)):
        moved = {}
        for m in (1000, 4000):
            rows = spark.range(m).selectExpr("7L AS key", "id AS rep", "id AS comp", "300L AS n", "'x' AS more")
            out = nd._dealt(rows, "key", nd.F.expr(hold), each)
            moved[m] = out.count()
            assert set(out.columns) == {*rows.columns, "part", "slice", "side"}
        assert moved[4000] <= 4.1 * moved[1000]
    # Beyond one part every pair of two components still meets, in some part and slice.
    nd_slice, nd.SLICE = nd.SLICE, 40
    try:
        rows = spark.range(100).selectExpr("id % 2 AS key", "id AS rep", "CASE WHEN id < 30 THEN 0 ELSE id END AS comp", "1L AS n")
        at: dict = {}
        for r in nd._dealt(rows, "key", nd.F.col("n"), 9).collect():
            at.setdefault((r.key, r.part, r.slice), ([], []))[r.side].append((r.rep, r.comp))
        met = {frozenset((a, b)) for few, all_ in at.values() for a, c in few for b, d in all_ if c != d}
        assert met == {frozenset((a, b)) for a in range(100) for b in range(100) if a % 2 == b % 2 and a != b and max(a, b) >= 30}
        assert max(len(few) for few, _ in at.values()) < 30
    finally:
        nd.SLICE = nd_slice


def test_hot_keys(spark):
    rows = spark.range(20_000).selectExpr("id", "CASE WHEN id < 12000 THEN -1 ELSE id DIV 2 END AS key")
    sizes = rows.groupBy("key").count()
    hot = nd.hot_keys(sizes, "key", "count")
    assert hot == [-1]
    binary = sizes.selectExpr("unhex(hex(key)) AS key", "count")
    marked = rows.selectExpr("id", "unhex(hex(key)) AS key")
    joined = nd.hot_join(marked, binary, "key", nd.hot_keys(binary, "key", "count"))
    assert joined.count() == 20_000 and joined.where("count = 12000").count() == 12_000
    table = sizes.selectExpr("key", "key * 2 AS twice")
    assert sorted(map(tuple, nd.hot_join(rows, table, "key", hot).select("id", "twice").collect())) == [(k, -2 if k < 12_000 else k // 2 * 2) for k in range(20_000)]


def test_held():
    """The prefixes let no similar set pass by."""
    r = np.random.default_rng(4)
    base = [r.choice(4000, 60, replace=False).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.where(r.random(60) < share, r.integers(0, 5000, 60).astype(np.uint64), base[k % 6])) for k in range(120) for share in [0.2 * r.random()]]
    held = nd.Held(sets, 80)
    for s in sets:
        near = {k for k, x in enumerate(sets) if 100 * len(np.intersect1d(x, s)) >= 80 * len(np.union1d(x, s))}
        found = held.partners(s)
        assert near <= set(found) and near == {k for k in found if held.linked(k, s)}


def test_empty(spark):
    assert nd.op8_minhash_near_dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
