"""Document fingerprints from closed syncmers (Edgar 2021): anchors that depend on nothing but their own k letters.

Fingerprints hold the anchors' hashes in text order and are matched by position: anchors in common count where they come in
the same order in both texts. Short texts have finer anchors besides.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches
from .neardup import mix

#: Letters of an anchor and of the inner substring whose minimum must lie at an edge: one position in (K - S + 1) / 2 is one.
K, S = 23, 8
#: Finer anchors that shorter texts have besides: below how many code points, k and s. Half a text of that many has a coarser one.
FINER = ((160, 5, 2), (16, 2, 1))
#: A run's bytes (but for rows that repeat each other), runs for each core at least, sampled keys a run, and runs at most.
RUN, EACH, KEYS, MOST = 64 << 20, 4, 32, 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rolling(points: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` code points, by doubling: a run of 2n is two runs of n."""
    h, n = points.astype(np.uint64), 1
    power = _BASE
    out, done = None, 0
    left = size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, done = h, n
                else:
                    m = len(points) - done - n + 1
                    out = out[:m] * power + h[done : done + m]
                    done += n
            left >>= 1
            if left:
                m = len(h) - n
                h, power, n = h[:m] * power + h[n : n + m], power * power, 2 * n
    return mix(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width``."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of a text's closed syncmers.

    Of equal minima the leftmost counts. A nonempty text without any (as every one shorter than k) has one anchor, the
    whole text, at 0. An anchor that repeats the one before it, as in a run of one letter, counts once.
    """
    points = code_points(text)
    if len(points) >= k:
        inner = _rolling(points, s)
        width = k - s + 1
        low = _least(inner, width)
        n = len(points) - k + 1
        first = inner[:n] == low
        last = inner[width - 1 :] == low
        if width > 1:
            last &= _least(inner[:-1], width - 1) != low  # the leftmost minimum is the last one
        at = np.flatnonzero(first | last)
        h = (_rolling(points, k)[at] >> np.uint64(32)).astype(np.uint32)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = h[1:] != h[:-1]
            return at[new], h[new]
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
    return np.zeros(1, np.int64), np.frombuffer(whole, np.uint32)


def levels(text: str) -> list[np.ndarray]:
    """Hashes of a text's anchors in order: the coarse ones, then the finer ones of short texts."""
    return [anchors(text)[1], *(anchors(text, k, s)[1] for below, k, s in FINER if len(text) < below)]


def fingerprint(found: list[np.ndarray]) -> str:
    """Levels of anchors' hashes as base64 of little-endian 32-bit integers, with dots between."""
    return ".".join(base64.b64encode(x.astype("<u4").tobytes()).decode() for x in found)


def levels_of(print_: str) -> list[np.ndarray]:
    return [np.frombuffer(base64.b64decode(x), "<u4") for x in print_.split(".")]


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Share of anchors that match in order (twice their number over both texts'), at the finest level that both have.

    The r-th repeat of a hash matches the r-th on the other side; of these pairs the longest chain that ascends in both
    texts counts. 1 for equal fingerprints, two empty ones among them, 0 for disjoint ones.
    """
    if len(a) == len(b) and all(np.array_equal(x, y) for x, y in zip(a, b, strict=True)):
        return 1.0
    level = min(len(a), len(b)) - 1
    x, y = a[level], b[level]
    if not len(x) or not len(y):
        return float(len(x) == len(y))

    def named(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(v, kind="stable")
        low = v[order]
        return low.astype(np.uint64) << np.uint64(32) | (np.arange(len(v)) - np.searchsorted(low, low)).astype(np.uint64), order

    (one, at), (two, to) = named(x), named(y)
    _, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    other = to[j][np.argsort(at[i])]  # places in b of the matches, by their places in a
    if len(other) > 1 and (np.diff(other) < 0).any():
        chain: list[int] = []  # the least last place of an ascending chain of each length
        for p in other.tolist():
            if not chain or p > chain[-1]:
                chain.append(p)
            else:
                chain[bisect_left(chain, p)] = p
        return 2.0 * len(chain) / (len(x) + len(y))
    return 2.0 * len(other) / (len(x) + len(y))


def aligned(a: str, b: str, k: int = K, s: int = S) -> list[tuple[int, int, int]]:
    """Passages that two texts share, as (start in a, start in b, length), found at anchors and grown to both sides."""
    (pa_, ha), (pb, hb) = anchors(a, k, s), anchors(b, k, s)
    by: dict[int, list[int]] = {}
    for p, h in zip(pb.tolist(), hb.tolist(), strict=True):
        by.setdefault(h, []).append(p)
    out: list[tuple[int, int, int]] = []
    reach: dict[int, int] = {}  # by diagonal: where the last passage ended in a
    for p, h in zip(pa_.tolist(), ha.tolist(), strict=True):
        for q in by.get(h, ()):
            if reach.get(p - q, -1) > p or a[p] != b[q]:
                continue
            i, j = p, q
            while i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            end = p
            while end < len(a) and end - p + q < len(b) and a[end] == b[end - p + q]:
                end += 1
            reach[p - q] = end
            out.append((i, j, end - i))
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Rows (id_col, positions, anchors) for every text: its anchors in text order. A null text counts as empty: no anchors."""
    small_batches(df.sparkSession)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [anchors(x or "", k, s) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([h.astype(np.int64) for _, h in found], pa.list_(pa.int64()))], names=[id_col, "positions", "anchors"])

        return run

    return map_batches(df.select(id_col, text_col), make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, positions array<bigint>, anchors array<bigint>")


class Runs:
    """Ascending (doc_id, hash) keys at which runs start, the first one the least of all."""

    def __init__(self, keys: list[tuple[int, int]]):
        self.keys = keys
        self.ids = np.array([i for i, _ in keys], np.int64)

    def of(self, ids: np.ndarray, hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Each row's run, and whether its key starts it."""
        run = np.searchsorted(self.ids, ids, "right") - 1
        for k in np.flatnonzero(self.ids[np.maximum(run, 0)] == ids).tolist():  # the id starts one run or more
            run[k] = bisect_right(self.keys, (int(ids[k]), hashes[k])) - 1
        start = np.array([self.keys[r] == (i, h) for r, i, h in zip(run.tolist(), ids.tolist(), hashes, strict=True)], bool)
        return run, start


def runs_of(ids: DataFrame, run: int | None = None) -> Runs | None:
    """Runs of about ``run`` bytes of ids' rows (doc_id, hash, text); None without rows.

    Fine buckets start at keys sampled by a hash; their bytes are summed over all rows, and neighbours joined to runs. The
    number of buckets follows that of the runs, at most MOST; beyond that runs are larger, but they are streamed.
    """
    size = F.octet_length("text") + 16
    found = ids.agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"), F.min(F.struct("doc_id", "hash")).alias("low")).first()
    if not found.rows:
        return None
    cores = ids.sparkSession.sparkContext.defaultParallelism
    wanted = math.ceil(found.bytes / run) if run else max(math.ceil(found.bytes / RUN), min(EACH * cores, found.bytes >> 20))
    wanted = max(1, min(wanted, MOST))
    step = max(1, found.rows // (KEYS * wanted))
    some = ids.where(F.pmod(F.xxhash64("doc_id", "hash", F.lit(1)), F.lit(step)) == 0).select("doc_id", "hash").distinct()
    fine = Runs(sorted({(found.low.doc_id, found.low.hash), *((r.doc_id, r.hash) for r in some.collect())}))

    def make():
        def run_(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, _ = fine.of(batch.column(0).to_numpy(), batch.column(1).to_pylist())
            bucket, back = np.unique(at, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(np.bincount(back, batch.column(2).to_numpy()).astype(np.int64))], names=["bucket", "bytes"])

        return run_

    weighed = map_batches(ids.select("doc_id", "hash", size.cast("long").alias("bytes")), make, "bucket bigint, bytes bigint").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    held = np.zeros(len(fine.keys))
    for r in weighed.collect():
        held[r.bucket] = r.bytes
    keys, most, now = [fine.keys[0]], held.sum() / wanted, 0.0
    for key, n in zip(fine.keys, held.tolist(), strict=True):
        if now and now + n / 2 > most:
            keys.append(key)
            now = 0.0
        now += n
    return Runs(keys)


def with_next(docs: DataFrame, run: int | None = None) -> DataFrame:
    """Documents in runs by ascending doc_id, then a hash of the text: rows (run, doc_id, text, ahead), a run a partition, sorted.

    A run's last row (ahead) is the first document of the next run, of the first run for the last: whoever reads a
    partition in order has each document's successor without a second shuffle and without one task for all. Rows without
    doc_id are left out. Runs are cut between texts of one doc_id, too; only rows that repeat both stay together.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    runs = runs_of(ids, run)
    n = len(runs.keys) if runs else 1

    def make():
        def run_(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, start = runs.of(batch.column(0).to_numpy(), batch.column(1).to_pylist())
            back = np.flatnonzero(start)
            rows = batch.take(pa.array(np.concatenate([np.arange(len(at)), back])))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, (at[back] - 1) % n]), pa.int32()), *rows.columns, pa.array(np.arange(len(at) + len(back)) >= len(at))], names=["run", "doc_id", "hash", "text", "ahead"])

        return run_

    dealt = map_batches(ids, make, "run int, doc_id bigint, hash bigint, text string, ahead boolean")
    return dealt.repartitionById(n, "run").sortWithinPartitions("run", "ahead", "doc_id", "hash", "text").select("run", "doc_id", "text", "ahead")


def _row(doc_id, text: str, own: list[np.ndarray], after: str, next_: list[np.ndarray]) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    theirs = levels(edited) if half else own
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own), fingerprint(theirs), likeness(own, theirs), likeness(own, next_)


def edit_prints(docs: DataFrame, run: int | None = None) -> DataFrame:
    """Fingerprints every document, and its text with the last half replaced from the next document.

    Rows as ``op9_``'s. The next of a document is the one that follows by ascending doc_id, then a hash of the text; the
    first after the last. A null text is empty, rows that share a doc_id count each. Rows without doc_id are no
    document's next; theirs is the first document, or the row itself if there is none. With one row the next is itself.
    Equal rows don't differ, so their order doesn't matter.
    """
    small_batches(docs.sparkSession)
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)))
    out_schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def in_order(batches):
        held = None  # the document that waits for its next: run, doc_id, text, levels
        took = False  # whether the run's end was seen: rows that share the first key of the next run come several times
        for batch in batches:
            out = []
            for part, doc_id, text, ahead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] != part:
                    held, took = None, False
                mine = None if took else levels(text)
                if held is not None and not took:
                    out.append(_row(*held[1:], text, mine))
                if ahead:
                    held, took = (part, None, None, None), True
                else:
                    held = part, doc_id, text, mine
            yield batch_of(out)

    rows = with_next(docs, run).mapInArrow(in_order, out_schema)
    nameless = docs.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if nameless.isEmpty():
        return rows
    order = F.struct(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")))
    first = docs.where("doc_id is not null").agg(F.min_by(F.coalesce("text", F.lit("")), order)).first()[0]

    def make():
        after = None if first is None else levels(first)

        def run_(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column(1).to_pylist():
                own = levels(text)
                out.append(_row(None, text, own, text if first is None else first, own if after is None else after))
            return batch_of(out)

        return run_

    return rows.unionByName(map_batches(nameless, make, out_schema))


def op9_document_fingerprints(docs: DataFrame) -> DataFrame:
    """edit_prints() of all documents."""
    return edit_prints(docs)
