"""Toxicity by multiple-instance learning: documents are bags of sentences and only documents have labels.

A sentence with evidence words has the probability sigmoid(bias + sum of its words' weights), one without has 0. A
document's is the noisy-or of its sentences' with a leak that stands for labels without a visible reason:
1 - (1 - leak) * prod(1 - p). Weights, bias and leak are fitted to the documents' labels together, which finds the
offending sentences although no sentence was ever labelled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, small_batches, table
from .neardup import Words, hashed_shingles, mix

#: Labelled documents of each class that are fitted to at most, and the longest of them in characters: bounds the driver's memory.
SAMPLE, SAMPLE_CHARS = 3000, 20_000
#: A word or a word's beginning is evidence if this many sampled documents hold it and its likelihood ratio is this high.
LEAST_DOCS, LEAST_RATIO = 4, 20.0
#: Lengths of beginnings that are looked at besides whole words: slurs are inflected.
STEMS = (4, 5, 6)
#: How strongly weights are drawn to 1.
RIDGE = 0.3
#: Minima of shingles' hashes that tell near copies among the texts that are fitted to, and the share that must agree.
MINIMA, ALIKE = 32, 0.8

SENTENCE = re.compile(r"[^.!?\n。]+[.!?。]*")
WORD = re.compile(r"\w+")


def traits(words: set[str]) -> set[str]:
    """Words and their beginnings, these with a star."""
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


@dataclass
class Model:
    """weights: by trait, a word or (with a star) a word's beginning."""

    leak: float = 0.0
    bias: float = -3.0
    weights: dict[str, float] = field(default_factory=dict)

    @cached_property
    def heads(self) -> frozenset[str]:
        """The first letters of all traits: a word that starts otherwise has none of them."""
        return frozenset(t[:4] for t in self.weights)

    def traits_of(self, text: str) -> set[str]:
        heads = self.heads
        return self.weights.keys() & traits({w for w in WORD.findall(text.lower()) if w[:4] in heads})

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and probability of the sentences that hold evidence."""
        out = []
        for m in SENTENCE.finditer(text):
            if found := self.traits_of(m[0]):
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(self.weights[w] for w in sorted(found))))))))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        if not self.traits_of(text):
            return self.leak, []
        found = self.sentences(text)
        return 1 - (1 - self.leak) * math.exp(sum(math.log1p(-p) for *_, p in found)), found


def _ratio(k: float, n: float, all_k: float, all_n: float) -> float:
    """Likelihood ratio of k positives among n against the rest, where they are more frequent; 0 where they aren't."""
    if all_n <= n or k / n <= all_k / all_n:
        return 0.0
    part = lambda a, b: a * math.log(a / b) if a else 0.0
    side = lambda k, n, p: part(k, n * p) + part(n - k, n * (1 - p))
    p = all_k / all_n
    return 2 * (side(k, n, p) + side(all_k - k, all_n - n, p)) if 0 < p < 1 else 0.0


def apart(texts: list[str], labels: list[int]) -> list[int]:
    """Numbers of the texts to learn from: of near copies with one label only the first, or their chance words would count.

    Copies share a band of their two-word shingles' minima and agree in at least ALIKE of all minima.
    """
    known, seen, out = Words(), {}, []
    steps = np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k, (t, one) in enumerate(zip(texts, labels, strict=True)):
        s = hashed_shingles(t, known)
        least = np.array([mix(s + step).min() for step in steps]) if len(s) else np.zeros(MINIMA, np.uint64)
        bands = [(one, b, least[b : b + 4].tobytes()) for b in range(0, MINIMA, 4)]
        if not any((least == other).mean() >= ALIKE for band in bands for other in seen.get(band, ())):
            out.append(k)
            for band in bands:
                seen.setdefault(band, []).append(least)
    return out


def evidence(texts: list[str], y: np.ndarray, bits: int = 22) -> list[str]:
    """Traits that the labels speak for, sorted. Counted by hash first, so that only likely ones are counted by name."""
    docs, toxic = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
    at = lambda t: zlib.crc32(t.encode()) >> (32 - bits)
    for text, one in zip(texts, y, strict=True):
        places = list({at(t) for t in traits(set(WORD.findall(text.lower())))})
        docs[places] += 1
        if one:
            toxic[places] += 1
    total, share = len(y), float(y.sum())
    likely = np.zeros(1 << bits, bool)
    some = np.flatnonzero(toxic >= LEAST_DOCS)
    likely[some[toxic[some].astype(float) * total > docs[some] * share]] = True
    n, k = Counter(), Counter()
    for text, one in zip(texts, y, strict=True):
        found = [t for t in traits(set(WORD.findall(text.lower()))) if likely[at(t)]]
        n.update(found)
        if one:
            k.update(found)
    return sorted(t for t in n if n[t] >= LEAST_DOCS and _ratio(k[t], n[t], share, total) >= LEAST_RATIO)


def fit(texts: list[str], labels: list[int], prior: float | None = None, steps: int = 400) -> Model:
    """Fits a model to documents and their labels. ``prior``: the share of label 1 that the classes are weighted to."""
    kept = apart(texts, labels)
    texts = [texts[k] for k in kept]
    y = np.array([labels[k] for k in kept], float)
    if not len(y) or y.min() == y.max():
        return Model(leak=float(y.mean()) if len(y) else 0.0)
    prior = prior if prior is not None else float(y.mean())
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    known = evidence(texts, y)
    if not known:
        return Model(leak=prior)
    wanted = set(known)
    bags = [[found for s in SENTENCE.findall(t) if (found := wanted & traits(set(WORD.findall(s.lower()))))] for t in texts]
    at = {w: k for k, w in enumerate(known)}
    rows, columns, owner = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            columns += [at[w] for w in sorted(s)]
            rows += [len(owner)] * len(s)
            owner.append(d)
    rows, columns, owner = np.array(rows), np.array(columns), np.array(owner)
    # Parameters: weights, bias, logit of the leak; Adam on the weighted likelihood. Evidence only adds, so weights stay
    # at 0 or above; and it was screened, so they are drawn to 1: a wrong label must not undo what many say.
    theta = np.concatenate([np.ones(len(known)), [-1.0, math.log(prior / (1 - prior)) - 1]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-2] + np.bincount(rows, theta[columns], len(owner))
        p = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + math.exp(-theta[-1]))
        none = np.bincount(owner, np.logaddexp(0, z), len(y)) - math.log1p(-leak)  # minus log of "no sentence offends"
        slope = weight * np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(none, 50)), 1e-9), 1.0)
        g = slope[owner] * p
        grad = np.concatenate([np.bincount(columns, g[rows], len(known)) + RIDGE * (theta[:-2] - 1), [g.sum(), (slope * leak).sum()]]) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.maximum(theta[:-2], 0, out=theta[:-2])
    return Model(float(1 / (1 + math.exp(-theta[-1]))), float(theta[-2]), dict(zip(known, theta[:-2].tolist(), strict=True)))


def held_out(doc_id="doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, each: int, extra: list | None = None, chars: int = SAMPLE_CHARS) -> tuple[DataFrame, dict[int, int]]:
    """Up to ``each`` learnable documents of each class, chosen by a hash of their id, with ``_label``; and the classes' sizes.

    Documents longer than ``chars`` are not chosen. A document labelled twice has the greater label. Of rows that share an
    id the one with the least hash of its text counts (then the least columns), so there are at most 2 * each rows.
    """
    once = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).alias("_label")).where(~held_out("_id"))
    sizes = {r["_label"]: r["count"] for r in once.groupBy("_label").count().collect()}
    chosen = [once.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(each) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * each rows of 12 bytes
    used = extra or ["text"]
    rows = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chars).select(*used, F.col("doc_id").cast("long").alias("_id"))  # no other column, so no name can clash
    names = [c for c in rows.columns if c != "_id"]
    one = rows.join(ids, "_id").groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("text").alias("_hash"), *names)).alias("_one"))
    return one.select(*(F.col("_one")[c].alias(c) for c in names), "_id", "_label"), sizes


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits to a bounded sample of labelled documents outside the held-out fifth; without any, or with one class, to its share."""
    rows, sizes = labelled_sample(docs, labels, label, sample)
    rows = sorted(rows.collect(), key=lambda r: r["_id"])  # in one order, whatever the partitions
    total = sum(sizes.values())
    return fit([r["text"] or "" for r in rows], [r["_label"] for r in rows], sizes.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """Rows (id_col, score, spans): spans are the sentences of at least ``offending``, as start, end, probability.

    Null and empty texts have the leak as their score and no spans. Each row gives a row, whatever its id, and equal texts
    have equal scores. A text of any length is scored whole, a sentence at a time.
    """
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.score(x or "") for x in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b, "probability": p} for a, b, p in s if p >= offending] for _, s in found]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([min(1.0, max(0.0, x)) for x, _ in found], pa.float64()), pa.array(spans, span)], names=[id_col, "score", "spans"])

        return run

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, spans array<struct<start:bigint,end:bigint,probability:double>>")


def keep_clean(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """docs, with all their columns, without the rows whose text scores ``offending`` or more."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def make():
        return lambda batch: batch.filter(pa.array([model.score(x or "")[0] < offending for x in batch.column(at).to_pylist()]))

    return map_batches(docs, make, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out fifth, and how many sentences offend."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_offending"))
