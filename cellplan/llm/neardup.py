"""Near-duplicates: fast similarity sketches, banding, exact verification of every link, components.

The sketch is that of Dahlgaard, Knudsen and Thorup (2017): in each of the first t rounds every element of a set throws
its value into a hashed bin, in round t + i into bin i; later rounds count as greater values. All bins are full after
about t log t throws in all, and the share of equal coordinates is concentrated about the Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import fresh, map_batches, remove, small_batches, written

#: Coordinates of a sketch; the first BANDS * ROWS are banded: two sets of similarity 0.8 meet in some band but for 3 in a million.
BINS, BANDS, ROWS = 512, 32, 5
#: Pairs whose sketches agree in less than this share aren't verified: 0.8 lies 4 standard deviations above it.
LEAST_AGREEMENT = 0.73
#: Up to so many ids of documents to verify (8 bytes each) are broadcast, so that only their texts are shuffled; with more, all are.
BROADCAST_IDS = 500_000
#: Members of a hub that one group verifies; rows that a group holds, and rows that pass by it, in a mixed bucket.
HUB_GROUP, BLOCK, SLICE = 256, 4096, 16_384
#: Shingles that a group of a cluster holds at most (8 bytes each), but for a document that has more by itself.
HELD = 2_000_000
#: Keys that hold more than this share of all rows, and more rows than a block, are joined by broadcast: at most 1,000 keys.
HOT, HOT_ROWS = 0.001, 4096

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S32, _LOW, _EMPTY = (np.uint64(x) for x in (30, 27, 31, 32, 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF))


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer, a bijection of 64-bit numbers."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space: bytes' own lower() and split() do just that."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, size: int = 2) -> set:
    """The distinct runs of ``size`` words; with fewer words, all of them as one; none without words."""
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


class Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def hashed_shingles(text: str | None, known: Words, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    runs = max(1, len(h) - size + 1)
    out = np.full(runs, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out * _STEP + h[k : k + runs])
    return np.unique(out)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a nonempty set of 64-bit hashes.

    As many rounds are thrown at a time as should fill the bins; rounds that turn out not to be needed change nothing,
    for their values are greater.
    """
    out = np.full(bins, _EMPTY)
    steps = np.arange(1, 2 * bins + 1, dtype=np.uint64) * _STEP
    i, throws = 0, 1.25 * bins * math.log(bins)
    while i < bins:
        rounds = min(bins - i, math.ceil(throws / len(elements)))
        h = mix(elements + steps[i : i + rounds, None])
        value = (np.arange(i, i + rounds, dtype=np.uint64) << _S32)[:, None] | h & _LOW
        np.minimum.at(out, ((h >> _S32) % np.uint64(bins)).ravel(), value.ravel())
        i, throws = i + rounds, bins
        if (out != _EMPTY).all():
            return out
    low = (mix(elements + steps[bins:, None]) & _LOW).min(axis=1)  # a few elements only: round bins + k throws all into bin k
    return np.minimum(out, np.arange(bins, 2 * bins, dtype=np.uint64) << _S32 | low)


def features(docs: DataFrame, size: int = 2) -> DataFrame:
    """Rows (doc_id, n_shingles, set_key, bands, sketch): equal sets have equal keys; empty sets have null instead.

    bands are the buckets' keys; sketch has a byte of each coordinate, enough to tell how many agree."""
    small_batches(docs.sparkSession)

    def make():
        known = Words()

        def one(text):
            s = hashed_shingles(text, known, size)
            if not len(s):
                return 0, None, None, None
            whole = sketch(s)
            bands = whole[: BANDS * ROWS].reshape(BANDS, ROWS)
            key = np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(ROWS):
                key = mix(key * _STEP + bands[:, k])
            return len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), key.astype(np.int64), (mix(whole) >> np.uint64(56)).astype(np.uint8).tobytes()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, keys, bands, sketches = zip(*map(one, batch.column(1).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])

        return run

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary")


def _kept(df: DataFrame, label: str, made: list[str], each: int = 1) -> DataFrame:
    """df written and read again; its folder is noted in ``made``."""
    out, path = written(df, label, each)
    made.append(path)
    return out


def hot_keys(sizes: DataFrame, key: str, size: str) -> list:
    """The keys with more than HOT of all rows and more than HOT_ROWS; sizes has a row a key and in ``size`` how many rows have it."""
    total, top = sizes.agg(F.sum(size), F.max(size)).first()
    least = max(HOT_ROWS, HOT * (total or 0))
    return [r[0] for r in sizes.where(F.col(size) > least).select(key).collect()] if (top or 0) > least else []  # at most 1 / HOT


def hot_join(rows: DataFrame, table: DataFrame, key: str, hot: list) -> DataFrame:
    """rows joined with table, which has one row a key; keys aren't null.

    Rows of the ``hot`` keys are joined by broadcast and stay where they are; only the others are shuffled.
    """
    if not hot:
        return rows.join(table, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(table.where(~is_hot), key).unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key))


def _agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sizes and sketches allow the similarity."""

    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("size")), "a", "size")  # b is in a pair a band at most, a may be in many
    both = hot_join(pairs, side("a"), "a", hot).join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            return batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT))

        return run

    return map_batches(both, make, "a bigint, b bigint")


def _with_texts(need: DataFrame, docs: DataFrame, made: list[str]) -> DataFrame:
    """need, whose ``id`` names documents, with their texts. Up to BROADCAST_IDS ids are broadcast to sift the texts first."""
    need = _kept(need, "need", made)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")
    ids = need.select("id").distinct()
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    return need.join(texts, "id")


def verified(pairs: DataFrame, docs: DataFrame, made: list[str], percent: int = 80, size: int = 2) -> DataFrame:
    """Of the pairs (a, b) those whose full shingle sets have 100 * intersection >= percent * union.

    Each a's set is built once for up to HUB_GROUP of its partners, which pass by one at a time; an a with more partners
    is dealt over several groups. Which of a and b is smaller doesn't matter.
    """
    pairs = _kept(pairs, "pairs", made)
    groups = pairs.groupBy("a").agg(F.count("*").alias("degree")).select("a", "degree", F.ceil(F.col("degree") / HUB_GROUP).alias("parts"))
    dealt = hot_join(pairs, groups, "a", hot_keys(groups, "a", "degree")).select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    need = dealt.select("a", "part", F.lit(1).alias("side"), F.col("b").alias("id")).unionByName(dealt.select("a", "part", F.lit(0).alias("side"), F.col("a").alias("id")).distinct())
    rows = _with_texts(need, docs, made).repartition("a", "part").sortWithinPartitions("a", "part", "side").select("a", "part", "side", "id", "text")

    def make():
        hub: list = [None, []]  # a's texts: one, but for rows that share its id

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for a, part, side, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text, size)
                if hub[0] != (a, part):
                    hub[:] = (a, part), []
                if not side:
                    hub[1].append(s)
                elif any((both := len(h & s)) and 100 * both >= percent * (len(s) + len(h) - both) for h in hub[1]):
                    found.append((a, i))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        return run

    return map_batches(rows, make, "a bigint, b bigint")


def _dealt(rows: DataFrame, group: str, hold: Column, each: int) -> DataFrame:
    """rows (group, comp, ...) dealt so that those outside a group's largest component (the few) meet all of the group.

    Rows (group, part, slice, side, ...): a part holds the few (side 0) up to ``each`` of the sum of ``hold``, a slice of
    about SLICE of the group's rows (side 1) passes by. Rows that move grow with the group's size times its parts, plus
    the few times its slices: in proportion to the group while the few fit one part. Groups of one component are left out.
    """
    sizes = rows.groupBy(group, "comp").agg(F.count("*").alias("c"), F.sum(hold).alias("w"))
    whole = sizes.groupBy(group).agg(F.max(F.struct("c", "comp", "w")).alias("top"), F.sum("c").alias("rows"), F.sum("w").alias("w"))
    plan = whole.where("top.c < rows").select(group, F.col("top.comp").alias("main"), "rows", F.ceil((F.col("w") - F.col("top.w")) / each).alias("parts"), F.ceil(F.col("rows") / SLICE).alias("slices"))
    met = hot_join(rows, plan, group, hot_keys(plan, group, "rows"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep", F.lit(n)), n)
    few = met.where("comp != main").withColumn("part", own("parts")).withColumn("slice", every("slices")).withColumn("side", F.lit(0))
    all_ = met.withColumn("slice", own("slices")).withColumn("part", every("parts")).withColumn("side", F.lit(1))
    return few.unionByName(all_).drop("main", "rows", "parts", "slices")


def _clusters(mixed: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) that span the documents of a bucket whose sketches agree with one of another component.

    mixed: (key, rep, comp, n, sketch). A group of m rows gives m - 1 of them at most, not its pairs.
    """
    rows = _dealt(mixed, "key", F.lit(1), BLOCK).select("key", "part", "slice", "side", "rep", "comp", "n", "sketch").repartition("key", "part", "slice").sortWithinPartitions("key", "part", "slice", "side")

    def run(batches):
        now, few, root = None, [], {}
        held = None

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for batch in batches:
            found = []
            columns = [batch.column(k).to_pylist() for k in range(8)]
            keys = list(zip(*columns[:3], strict=True))
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start] and columns[3][end] == columns[3][start]:
                    end += 1
                rep, comp, n = (np.array(columns[k][start:end], np.int64) for k in (4, 5, 6))
                sketches = np.frombuffer(b"".join(columns[7][start:end]), np.uint8).reshape(end - start, -1)
                if keys[start] != now:
                    now, few, root, held = keys[start], [], {}, None
                if columns[3][start] == 0:
                    few.append((rep, comp, n, sketches))
                else:
                    held = held or ([np.concatenate([x[k] for x in few]) for k in range(4)] if few else [[]] * 4)
                    for a, c, m, s in zip(*held, strict=True):
                        fits = np.flatnonzero((comp != c) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
                        for b in rep[fits[(sketches[fits] == s).mean(axis=1) >= LEAST_AGREEMENT]].tolist() if len(fits) else ():
                            if (x := find(int(a))) != (y := find(b)):
                                root[max(x, y)] = min(x, y)
                                found.append((int(a), b))
                start = end
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


class Held:
    """Sorted shingle sets in which a set's likely partners are found by their prefixes.

    Shingles are ordered by how many held sets have them, rarest first. Two sets with 100 * intersection >= percent * union
    share at least percent of each one's shingles, so also one of the rarest n - ceil(percent * n / 100) + 1 of each.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.values, self.often = np.unique(np.concatenate(sets), return_counts=True)
        owner, value = [], []
        for k, s in enumerate(sets):
            first = self.rarest(s)
            owner.append(np.full(len(first), k))
            value.append(first)
        value, owner = np.concatenate(value), np.concatenate(owner)
        order = np.argsort(value, kind="stable")
        self.value, self.owner = value[order], owner[order]
        self.n = np.array([len(x) for x in sets])

    def rarest(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        often = np.where(self.values[at] == s, self.often[at], 0)
        return s[np.lexsort((s, often))[: len(s) + (-self.percent * len(s)) // 100 + 1]]

    def partners(self, s: np.ndarray) -> list[int]:
        """Numbers of the sets that may be similar enough, most shared prefix shingles first."""
        first = self.rarest(s)
        low, high = np.searchsorted(self.value, first, "left"), np.searchsorted(self.value, first, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        count = np.bincount(np.concatenate([self.owner[a:b] for a, b in zip(low[hit].tolist(), high[hit].tolist(), strict=True)]), minlength=len(self.n))
        some = np.flatnonzero((count > 0) & (100 * np.minimum(self.n, len(s)) >= self.percent * np.maximum(self.n, len(s))))
        return some[np.argsort(-count[some], kind="stable")].tolist()

    def linked(self, k: int, s: np.ndarray) -> bool:
        mine = self.sets[k]
        both = int((mine[np.minimum(np.searchsorted(mine, s), len(mine) - 1)] == s).sum())
        return 100 * both >= self.percent * (len(mine) + len(s) - both)


def _joining(members: DataFrame, docs: DataFrame, made: list[str], percent: int, size: int) -> DataFrame:
    """Links (a, b) between components of a cluster, enough to join all that links join. members: (cluster, rep, comp, n).

    Documents outside a cluster's largest component (the few) are held in groups of up to HELD shingles, and slices of
    the cluster's documents pass by one at a time; whose prefixes share no shingle are no pair. A link whose components
    were joined before is not given, so there are fewer links than components.
    """
    need = _dealt(members, "cluster", F.col("n"), HELD).withColumnRenamed("rep", "id").drop("n")
    rows = _with_texts(need, docs, made).repartition("cluster", "part", "slice").sortWithinPartitions("cluster", "part", "slice", "side", "id").select("cluster", "part", "slice", "side", "id", "comp", "text")

    def run(batches):
        words = Words()
        now, few, held, root = None, [], None, {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for batch in batches:
            found = []
            for cluster, part, slice_, side, i, comp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, part, slice_) != now:
                    now, few, held, root = (cluster, part, slice_), [], None, {}
                s = hashed_shingles(text, words, size)
                if not side:
                    few.append((i, comp, s))
                    continue
                if not few:
                    continue
                held = held or Held([x[2] for x in few], percent)
                for k in held.partners(s):
                    if (x := find(few[k][1])) != (y := find(comp)) and held.linked(k, s):
                        root[x] = y
                        found.append((few[k][0], i))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 2) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept): the components under links of similarity percent / 100 or more.

    1. Documents with equal sets form a class; its smallest doc_id stands for it from here on.
    2. In each band's bucket the smallest id is the hub; hub and member are verified on full sets. This gives nearly all
       components and its rows grow with the buckets' sizes, not with their squares.
    3. Where a bucket still holds several components, documents whose sketches agree across them form clusters, and in
       each the few outside its largest component are compared with all others on full sets: no link between components
       is lost, and links inside one would change nothing.

    Null or blank texts: an empty set, linked with nothing. A null doc_id: its row is returned with a null component and
    kept. Rows that share a doc_id are one document, so that its texts' components are one. Other columns aren't read.
    Hot classes and buckets are pre-aggregated and joined by hot_join(); empty sets take part in no join. All tables that
    are written on the way are deleted but the result.
    """
    spark, made = docs.sparkSession, []
    feats = _kept(features(docs, size), "features", made, 8)
    known = feats.where("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = _kept(classes, "classes", made, 4)
    banded = reps.select(F.explode("bands").alias("key"), "rep")
    hubs = _kept(banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1"), "hubs", made)
    shared = _kept(hot_join(banded, hubs.drop("size"), "key", hot_keys(hubs, "key", "size")), "buckets", made, 4)
    stars = shared.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    keys = feats.where("doc_id is not null").select("doc_id", F.xxhash64("set_key").alias("h"))  # a document with an empty text beside others counts
    repeated = _kept(keys.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select("doc_id"), "repeated", made)
    texts = known.join(repeated, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(reps.select("set_key", "rep"), "set_key")
    same = texts.join(texts.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep != a").select("a", F.col("rep").alias("b")).distinct()
    agreeing = _agreeing(_kept(stars, "stars", made), reps, percent)
    links = _kept(verified(agreeing, docs, made, percent, size).unionByName(same), "links", made)
    first = _kept(connected_components(links), "components", made)
    comp = _kept(shared.select("key", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")), "placed", made)
    several = comp.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows")).where("low != high").select("key", "rows")
    mixed = hot_join(comp, several.select("key"), "key", hot_keys(several, "key", "rows")).join(reps.select("rep", "n", "sketch"), "rep")
    near = _kept(_clusters(_kept(mixed, "mixed", made), percent), "near", made)
    if not near.isEmpty():
        clusters = connected_components(near).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        members = clusters.join(first.withColumnRenamed("node", "rep"), "rep", "left").join(reps.select("rep", "n"), "rep").select("cluster", "rep", F.coalesce("component", "rep").alias("comp"), "n")
        more = _kept(_joining(_kept(members, "members", made), docs, made, percent, size), "more", made)
        if not more.isEmpty():
            links = links.unionByName(verified(more, docs, made, percent, size))
            first = _kept(connected_components(links), "components", made)
    placed = reps.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    named = hot_join(known.select("doc_id", "n_shingles", "set_key"), placed, "set_key", hot_keys(reps, "set_key", "rows")).drop("set_key")
    other = feats.where("set_key is null or doc_id is null").select("doc_id", "n_shingles")
    if not repeated.isEmpty():  # a document with an empty text beside others is in their component
        lowest = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        other = other.join(lowest, "doc_id", "left")
    else:
        other = other.withColumn("component_id", F.lit(None).cast("long"))
    other = other.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out, _ = written(named.unionByName(other).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates", 2)
    for path in made:
        remove(spark, path)
    return out


def keep_one(docs: DataFrame, percent: int = 80, size: int = 2) -> DataFrame:
    """The documents of which each component keeps one, with all their columns, and rows without a doc_id.

    Rows that share a doc_id are one document: all its texts stay, rows that repeat both count once.
    """
    (name,) = fresh(docs, "_kept_id")
    kept = near_duplicates(docs, percent, size).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id").cast("long") == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))


def op8_minhash_near_dedup(docs: DataFrame) -> DataFrame:
    """near_duplicates() of all documents: two-word shingles, similarity 0.8 or more."""
    return near_duplicates(docs)
