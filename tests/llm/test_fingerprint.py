import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cellplan.llm import fingerprint as fp


def brute(text, k=fp.K, s=fp.S):
    """Closed syncmers' positions by definition, on hashes of single substrings."""
    one = lambda x: int(fp._rolling(fp.code_points(x), s)[0])
    out = []
    for i in range(len(text) - k + 1):
        v = [one(text[j : j + s]) for j in range(i, i + k - s + 1)]
        if v.index(min(v)) in (0, len(v) - 1):
            out.append(i)
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé🙂 ", min_size=23, max_size=120))
def test_syncmers(text):
    at, h = fp.anchors(text)
    want = brute(text)
    values = [int(fp._rolling(fp.code_points(text[i : i + fp.K]), fp.K)[0] >> np.uint64(32)) for i in want]
    kept = [i for n, i in enumerate(want) if not n or values[n] != values[n - 1]]
    if want:
        assert at.tolist() == kept
    else:
        assert at.tolist() == [0]


def test_context_free_and_aligned():
    r = random.Random(1)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = letters(400)
    a, b = letters(100) + shared + letters(50), letters(33) + shared + letters(70)
    spans = fp.aligned(a, b)
    assert any(i <= 100 and j <= 33 and n >= 400 for i, j, n in spans) and all(a[i : i + n] == b[j : j + n] for i, j, n in spans)
    inside = {x for p, x in zip(*fp.anchors(a), strict=True) if 100 <= p <= 500 - fp.K}
    assert inside <= set(fp.anchors(b)[1].tolist())
    assert fp.likeness(*(fp.levels_of(fp.fingerprint(fp.levels(x))) for x in (a, a))) == 1.0


def test_likeness():
    """Against the longest common subsequence where no anchor repeats, by dynamic programming."""
    r = random.Random(5)
    for _ in range(60):
        a, b = r.sample(range(40), r.randrange(1, 25)), r.sample(range(40), r.randrange(1, 25))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = fp.likeness([np.array(a, np.uint32)], [np.array(b, np.uint32)])
        assert got == (1.0 if a == b else 2 * table[-1][-1] / (len(a) + len(b)))
    empty = [np.empty(0, np.uint32)]
    assert fp.likeness(empty, empty) == 1.0 and fp.likeness(empty, [np.zeros(1, np.uint32)]) == 0.0
    repeats = [np.array([5, 5, 7, 5], np.uint32)], [np.array([5, 7, 5], np.uint32)]
    assert 0 < fp.likeness(*repeats) < 1 and fp.likeness(*repeats) == fp.likeness(*repeats[::-1])


def test_short_texts():
    """A text whose last half is replaced is like the old one, neither equal nor alien, however short it is."""
    r = random.Random(7)
    for n in [*range(4, 60), *range(60, 420, 7)]:
        for after in ("z" * 500, "z" * (n // 4), "QXZV" * 200):
            text = "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
            edited = text[: n - n // 2] + after[: n // 2]
            assert 0 < fp.likeness(fp.levels(text), fp.levels(edited)) < 1, (n, after)
            assert fp.likeness(fp.levels(text), fp.levels(after)) == 0


def expected(rows):
    """By doc_id, in order: the rows that edit_prints() should give for (doc_id, text) rows without repeated ids."""
    rows = sorted((i, t or "") for i, t in rows)
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        mine, theirs, nxt = (fp.levels(y) for y in (t, edited, after))
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(mine), fp.fingerprint(theirs), fp.likeness(mine, theirs), fp.likeness(mine, nxt)


def test_query(spark):
    r = random.Random(2)
    texts = ["", "a", "ab", None, "é🙂" * 40, *("".join(r.choice("thens aro") for _ in range(r.randrange(1, 900))) for _ in range(60)), "z" * 50_000]
    rows = [(7 * i - 20, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "doc_id bigint, text string, ahead string, run int").repartition(7)
    for run in (None, 100, 3000):
        assert sorted(map(tuple, fp.edit_prints(df, run).collect())) == list(expected(rows))
    assert sorted(map(tuple, fp.op9_document_fingerprints(df).collect())) == list(expected(rows))


def test_runs(spark):
    """Runs are even in bytes, one a partition, and cut a doc_id that most rows have."""
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE -5 END AS doc_id", "repeat(concat('text ', id, ' '), 20) AS text").repartition(5)
    rows = fp.with_next(df, 60_000).select("run", fp.F.spark_partition_id().alias("p"), "ahead", fp.F.octet_length("text").alias("n")).collect()
    sizes: dict = {}
    for x in rows:
        sizes.setdefault(x.run, []).append(x.n)
    assert len({(x.run, x.p) for x in rows}) == len(sizes) == len({x.p for x in rows}) and sum(x.ahead for x in rows) == len(sizes)
    total = sorted(map(sum, sizes.values()))
    assert len(total) > 10 and total[-1] <= 2 * total[len(total) // 2]


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (2, "b"), (2, "a longer text"), (None, "cdef"), (None, None), (3, None)]
    doubled = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fp.op9_document_fingerprints(doubled).collect()
    assert sorted((x.doc_id or 0, x.n_chars) for x in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    nameless = next(x for x in got if x.doc_id is None and x.n_chars == 4)
    assert nameless.edited_sha256 == hashlib.sha256(b"cda").hexdigest()
    assert fp.op9_document_fingerprints(doubled.limit(0)).count() == 0
    one = fp.op9_document_fingerprints(doubled.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    alone = fp.op9_document_fingerprints(doubled.where("doc_id is null")).collect()
    assert len(alone) == 2 and all(x.near_next == 1.0 for x in alone)
    assert fp.fingerprints(doubled).count() == len(rows)
