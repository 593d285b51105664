"""Best-fit packing of token pieces into sequences by the configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence. The program asks for the fewest configurations that cover
the histogram. It is solved by multiplicative weights: prices of lengths fall where the dearest configurations cover them
and rise where they don't, and a knapsack dynamic program finds the configurations of highest price. The solution is
rounded and what is left is packed best-fit decreasing. All of that depends on the histogram only, which has at most as
many entries as a sequence has tokens; pieces then look their places up by length and rank.
"""

from __future__ import annotations

import base64
import math
import zlib
from dataclasses import dataclass
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import BLANKS, CACHE, UNITS, Vocabulary, default_path, made
from .common import fresh, map_batches, small_batches, written

CAPACITY, END = 1024, 2
#: Rounds of price changes, how sharply prices follow coverage, and by how much rounds may be worse than the best to count.
ROUNDS, RATE, SPREAD = 12, 0.05, 0.001
#: Shares of the dearest configuration's price: a configuration within the first is dear, lengths within the second are equal.
NEAR, EQUAL = 0.006, 0.001


class Irregular(ValueError):
    """A part between single spaces that starts or ends with white space."""


class LibraryUnits:
    """Packed token numbers of whole texts, unit by unit as bpe.Units does, from a library that knows the same vocabulary as ranks."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {}
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        vocab = Vocabulary(path)
        self.special = {t: i.to_bytes(4, "little") for t, i in vocab.added.items()}
        self.split = vocab.special.split if vocab.special else lambda x: [x]

        class Whole(dict):
            def __missing__(self, unit: str) -> bytes:
                ids = encode(unit)
                self[unit] = out = pack_ids(f"<{len(ids)}I", *ids)
                return out

        class Spaced(dict):
            def __missing__(self, unit: str) -> bytes:
                if not unit or unit[0] in BLANKS or unit[-1] in BLANKS:
                    raise Irregular
                ids = encode(" " + unit)
                self[unit] = out = pack_ids(f"<{len(ids)}I", *ids)
                return out

        self.whole, self.spaced = Whole(), Spaced()

    def one(self, text: str) -> bytes:
        head, *tail = text.split(" ")
        try:
            if not head or head[0] in BLANKS or head[-1] in BLANKS:
                raise Irregular
            return b"".join([self.whole[head], *map(self.spaced.__getitem__, tail)])
        except Irregular:
            return b"".join(map(self.whole.__getitem__, UNITS.findall(text)))

    def values(self, texts: list[str]) -> list[bytes]:
        for cache in (self.whole, self.spaced):
            if len(cache) > CACHE // 2:
                cache.clear()
        special = self.special
        return [b"".join(special[p] if p in special else self.one(p) for p in self.split(t) if p) for t in texts]


def library_units(path: str) -> LibraryUnits:
    return LibraryUnits(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's tokens and the end token, cut if they exceed the capacity.

    Cut documents have a shorter first piece, if any, and full ones after it. A null or empty text is the end token alone.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)
    last = end.to_bytes(4, "little")

    def make():
        units = made(library_units, path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), units.values([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids += last
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.types[0]), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return run

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """By capacity: the highest price of a multiset of lengths (ascending) that fits. A price of minus infinity bars a length."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        n = fits[c]
        best[c] = max(best[c - 1], (best[c - lengths[:n]] + prices[:n]).max()) if n else best[c - 1]
    return best


@dataclass
class Solution:
    """use: how often each configuration, as (index into lengths, times) pairs, longest first; dear: those worth nearly the
    dearest at the prices that give the bound; bound: no packing, fractional or whole, has fewer sequences; value: of this one."""

    use: dict[tuple, float]
    dear: set[tuple]
    bound: float
    value: float


def _round(lengths: np.ndarray, want: np.ndarray, prices: np.ndarray, capacity: int, best: np.ndarray) -> tuple[dict[tuple, float], np.ndarray]:
    """Covers all of ``want`` once: configurations and how often, and the share of want that the dear ones cover.

    The longest length that is not covered opens a configuration, whose room takes what the prices make best of the
    lengths that are not covered either; it is used until the tightest of its lengths is covered. The dynamic program
    runs again when many lengths have been covered since. Of equals the longest piece is taken: short ones fit elsewhere.
    """
    use: dict[tuple, float] = {}
    free, tiny, gain = want.copy(), want * 1e-9, np.zeros(len(want))
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    top, open_, closed = best[capacity], prices.copy(), 0
    limit = max(8, len(want) // 4)
    for k in range(len(lengths) - 1, -1, -1):
        while free[k] > tiny[k]:
            if closed > limit:
                best, closed = knapsack(lengths, open_, capacity), 0
                limit = max(8, int((open_ > -math.inf).sum()) // 4)
            config, c = {k: 1}, capacity - int(lengths[k])
            while c > 0 and (n := fits[c]):
                total = best[c - lengths[:n]] + open_[:n]
                if (most := total.max()) == -math.inf:
                    break
                i = n - 1 - int((total[::-1] >= most - EQUAL * top).argmax())
                config[i] = config.get(i, 0) + 1
                c -= int(lengths[i])
            index, times = np.fromiter(config.keys(), np.int64), np.fromiter(config.values(), np.int64)
            often = float((free[index] / times).min())
            key = tuple(config.items())
            use[key] = use.get(key, 0.0) + often
            free[index] -= often * times
            if (prices[index] * times).sum() >= (1 - NEAR) * top:
                gain[index] += often * times
            done = index[(free[index] <= tiny[index]) & (open_[index] > -math.inf)]
            open_[done] = -math.inf
            closed += len(done)
    return use, gain / want


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Solution:
    """A fractional solution of the configuration program for ascending lengths, each below the capacity.

    Prices start in proportion to size, which is the optimum wherever sequences can be filled. Each round covers the whole
    demand at its prices. Then weights are multiplied: a length that dear configurations (within NEAR of the dearest)
    cover falls in price, one that only others cover rises; and one whose dearest configuration is worth less than the
    dearest of all rises, too. Any prices bound the program from below: demand at these prices, over the dearest
    configuration's. Every round's solution is feasible, so is the mean of the best ones, which is the result.
    """
    want = demand.astype(float)
    prices, bound, at, found = lengths / capacity, 0.0, None, []
    for _ in range(rounds):
        best = knapsack(lengths, prices, capacity)
        top = best[capacity]
        if (proven := float((want * prices).sum() / top)) > bound:
            bound, at = proven, prices / top
        through = prices + best[capacity - lengths]
        use, gain = _round(lengths, want, prices, capacity, best)
        found.append((sum(use.values()), use))
        prices = prices * np.exp(-RATE * (gain - np.average(gain, weights=want * lengths))) * np.sqrt(top / through)
    least = min(v for v, _ in found)
    some = [one for v, one in found if v <= least * (1 + SPREAD)]
    use = {}
    for one in some:
        for config, often in one.items():
            use[config] = use.get(config, 0.0) + often / len(some)
    dear = {c for c in use if sum(at[k] * m for k, m in c) >= 1 - NEAR}
    return Solution(use, dear, bound, sum(use.values()))


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, all pieces of a length and all sequences of one kind at a time: configurations and how often."""
    rooms: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room: [configuration, count]
    for k in np.flatnonzero(left)[::-1].tolist():
        length, n = int(lengths[k]), int(left[k])
        for room in range(length, capacity + 1):
            while n and rooms[room]:
                config, count = rooms[room].pop()
                each = room // length  # the sequence that took a piece is the best fit for the next, if that fits
                full = min(count, n // each)
                if full:
                    rooms[room - each * length].append([config + (length,) * each, full])
                    count, n = count - full, n - full * each
                if count and n:  # fewer pieces than a sequence takes
                    rooms[room - n * length].append([config + (length,) * n, 1])
                    count, n = count - 1, 0
                if count:
                    rooms[room].append([config, count])
        each = capacity // length
        if n // each:
            rooms[capacity - each * length].append([(length,) * each, n // each])
        if n % each:
            rooms[capacity - n % each * length].append([(length,) * (n % each), 1])
    return [(config, n) for room in rooms for config, n in room]


def rounded(solution: Solution, lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """The program's sequences in whole numbers, and the pieces that are left.

    Dear configurations are used as often as the solution has them, rounded down; then, those with the longest piece and
    the greatest fraction first, once more each while the pieces last.
    """
    left, out = demand.copy(), {}

    def take(config: tuple, most: int) -> None:
        index, times = (np.array(x, np.int64) for x in zip(*config, strict=True))
        if (n := min(most, int((left[index] // times).min()))) > 0:
            left[index] -= n * times
            out[config] = out.get(config, 0) + n

    for config in solution.dear:
        take(config, int(solution.use[config] + 1e-6))
    for config in sorted(solution.dear, key=lambda c: (-c[0][0], -(solution.use[c] % 1), c)):
        if solution.use[config] % 1 > 1e-6:
            take(config, 1)
    return [(tuple(int(lengths[k]) for k, m in config for _ in range(m)), n) for config, n in out.items()], left


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for a histogram of lengths: configurations as lengths, and how many sequences have each.

    The configuration program's, rounded; the pieces that are left go best-fit decreasing.
    """
    out = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(x for x, n in histogram.items() if n and x < capacity), np.int64)
    if not len(lengths):
        return out
    demand = np.array([histogram[int(x)] for x in lengths], np.int64)
    planned, left = rounded(solve(lengths, demand, capacity, rounds), lengths, demand, capacity)
    return out + planned + best_fit(lengths, left, capacity)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where pieces go: pieces of one length with ranks from ``rank`` on go to sequences from ``sequence`` on, at ``offset``.

    Sorted by length and rank; the table's size depends on the number of configurations, not of pieces.
    """
    rows, taken, base = [], {}, 0
    for config, n in planned:
        offset = 0
        for length in config:
            rows.append((length, taken.get(length, 0), base, offset))
            taken[length] = taken.get(length, 0) + n
            offset += length
        base += n
    rows.sort()
    return {name: np.array([r[k] for r in rows], np.int64) for k, name in enumerate(("length", "rank", "sequence", "offset"))}


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """cut with sequence_id and offset added (or replaced): pieces(), or any table with their columns and lengths from 1 to capacity.

    The table is read several times, so it should be written one. Ranks within a length are counted by (bucket, length)
    and summed over buckets: no length, however frequent, is numbered in one task. Repeated rows are pieces of their own.
    """
    spark = cut.sparkSession
    cut = cut.drop("sequence_id", "offset")
    bucket, count, base, nth, rank = fresh(cut, "_bucket", "_n", "_base", "_nth", "_rank")
    histogram = {int(r["length"]): r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if bad := [x for x in histogram if not 1 <= x <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:5]}")
    at = slots(plan(histogram, capacity, rounds))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(histogram.values()) // 50_000)
    spread = cut.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("length", bucket).agg(F.count("*").alias(count))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    ranked = spread.withColumn(nth, F.row_number().over(Window.partitionBy("length", bucket).orderBy("doc_id", "piece")) - 1).join(bases, ["length", bucket])
    rows = ranked.select(*cut.columns, (F.col(base) + F.col(nth)).alias(rank))
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    n = len(cut.columns)
    length_at = cut.columns.index("length")

    def make():
        span = int(at["rank"].max(initial=0)) + sum(histogram.values()) + 1
        keys = at["length"] * span + at["rank"]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rank, length = batch.column(n).to_numpy(), batch.column(length_at).to_numpy()
            k = np.searchsorted(keys, length * span + rank, "right") - 1
            return pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(at["sequence"][k] + rank - at["rank"][k]), pa.array(at["offset"][k])], names=schema.names)

        return run

    return map_batches(rows, make, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    return pack(written(pieces(docs, capacity, end, path), "pieces", 8)[0], capacity)


def op7_best_fit_packing(docs: DataFrame) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens: pieces()' rows with sequence_id and offset.

    A null or empty text is one piece, the end token; repeated rows are pieces of their own, whatever their doc_id.
    """
    return pack_documents(docs)
