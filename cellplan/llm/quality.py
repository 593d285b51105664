"""Quality by co-training (Blum and Mitchell 1998): one classifier sees the text, one what the page says about it.

Each is fitted to a bounded sample of labelled documents; over some rounds each gives the other its most confident
guesses, chosen from all unlabelled documents. Then both are calibrated on labelled documents that neither was fitted to,
and a logistic combination of the calibrated views scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, remove, small_batches, table, written
from .toxicity import held_out, labelled_sample

#: Labelled documents of each class that are fitted to at most; rounds, and guesses a view gives in one.
SAMPLE, ROUNDS, GIVEN = 3000, 4, 200
SURE, LIFT = 0.9, 1.5  # how sure a view must be of a guess that it gives, and how far its log odds must lie from the labels' own
BINS, SOURCES, LANGUAGES = 24, 32, 8
#: Buckets of words, and what is added to their counts in either class.
BUCKETS, PRIOR = 1 << 16, 2.0

_KINDS = np.zeros(256, np.int64)
for _k, _chars in enumerate((range(97, 123), range(65, 91), b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-", b"!", b"|", b"%&#$*@^~<>={}[]\\/+_`", range(128, 256))):
    _KINDS[list(_chars)] = _k + 1
#: The content view's numbers, in order.
CONTENT = ("control lower upper digit blank newline point shout bar symbol other words word_length distinct top repeated line_copies line_length marked lexical").split()


def word_buckets(text: str | None) -> list[int]:
    """The buckets of a text's distinct words, in lower case and without punctuation at their ends, sorted."""
    return sorted({zlib.crc32(w) % BUCKETS for x in (text or "").lower().encode().split() if (w := x.strip(b".,;:?!'\"()-"))})


def lexicon(words: list, y: np.ndarray) -> np.ndarray:
    """For each bucket the log odds of quality 1, less those of all documents, by how many of either class have a word in it."""
    count = [np.bincount(np.concatenate([w for w, one in zip(words, y, strict=True) if one == k] or [[]]).astype(np.int64), minlength=BUCKETS) for k in (0, 1)]
    n = [float((y == k).sum()) for k in (0, 1)]
    return (np.log((count[1] + PRIOR) / (n[1] + 2 * PRIOR)) - np.log((count[0] + PRIOR) / (n[0] + 2 * PRIOR))).astype(np.float32)


def lexical(words, weights: np.ndarray | None) -> float:
    return float(weights[words].mean()) if weights is not None and len(words) else 0.0


def content(text: str | None, weights: np.ndarray | None = None) -> list[float]:
    """The content view: shares of kinds of bytes, how words and lines repeat, and the words' mean weight in a lexicon()."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(CONTENT)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, counts, 11) / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    seen = Counter(words)
    repeated = sum(map(bytes.__eq__, words, words[1:])) / n
    marked = sum(seen[w] for w in seen if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?'\")") / n
    return [*kinds.tolist(), np.log1p(n), len(raw) / n, len(seen) / n**0.8, max(seen.values(), default=0) / n, repeated, 1 - len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)), marked, lexical(word_buckets(text), weights) if weights is not None else 0.0]


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """The metadata view: buckets of source and language, and the length that the page states (-1: none)."""
    bucket = lambda x, n: zlib.crc32(x.encode()) % (n - 1) + 1 if x is not None else 0
    return [float(bucket(source, SOURCES)), float(bucket(lang, LANGUAGES)), float(np.log1p(max(0, n_chars))) if n_chars is not None else -1.0]


@dataclass
class Additive:
    """Logistic regression over indicators of each number's bin; cuts are quantiles of the sample it was made from."""

    cuts: list[np.ndarray]
    weights: np.ndarray | None = None

    @classmethod
    def over(cls, x: np.ndarray, whole: tuple[tuple[int, int], ...] = ()) -> Additive:
        fixed = dict(whole)  # columns whose values are numbers of buckets
        return cls([np.arange(1, fixed[k]) - 0.5 if k in fixed else np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])])

    def indicators(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for k, cuts in enumerate(self.cuts):
            parts.append(np.eye(len(cuts) + 1)[np.searchsorted(cuts, x[:, k], "right")])
        return np.hstack(parts)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> Additive:
        self.weights = newton(self.indicators(x), y, ridge)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        # By table look-up: what indicators(x) @ weights gives, without the indicators.
        out, start = np.full(len(x), self.weights[0]), 1
        for k, cuts in enumerate(self.cuts):
            out += self.weights[start + np.searchsorted(cuts, x[:, k], "right")]
            start += len(cuts) + 1
        return out


def newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression; the first column, the constant, is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@dataclass
class Model:
    """Both views, their calibrations (constant and slope) and the combination (constant and two slopes)."""

    views: list[Additive] = field(default_factory=list)
    calibration: list[np.ndarray] = field(default_factory=list)
    combination: np.ndarray | None = None
    constant: float = 1.0  # the score of everything where the labels don't differ
    lexicon: np.ndarray | None = None

    def scores(self, content_: np.ndarray, metadata_: np.ndarray) -> np.ndarray:
        """Columns: content view's, metadata view's and combined probability of quality 1."""
        if self.combination is None:
            return np.full((len(content_), 3), self.constant)
        z = [c[0] + c[1] * v.logit(x) for v, c, x in zip(self.views, self.calibration, (content_, metadata_), strict=True)]
        return np.stack([probability(z[0]), probability(z[1]), probability(self.combination[0] + self.combination[1] * z[0] + self.combination[2] * z[1])], 1)


def confident(view: Additive, x: np.ndarray, base: float, given: tuple[int, int]) -> list[tuple[int, float, list[int]]]:
    """(class, sign, rows) for both classes: the surest guesses first, ``given`` of each at most.

    A guess must be SURE and lie LIFT from ``base``, the labels' own log odds: a view that knows nothing only repeats these.
    """
    logit = view.logit(x)
    p, lift = probability(logit), logit - base
    order = np.argsort(-np.abs(lift), kind="stable")
    good = order[(p[order] >= SURE) & (lift[order] >= LIFT)][: given[1]]
    bad = order[(p[order] <= 1 - SURE) & (lift[order] <= -LIFT)][: given[0]]
    return [(1, lift, good.tolist()), (0, lift, bad.tolist())]


class Pool:
    """Unlabelled documents in memory: keys and the numbers of both views."""

    def __init__(self, content_: np.ndarray, metadata_: np.ndarray, keys: list | None = None):
        self.x, self.keys = (content_, metadata_), keys if keys is not None else list(range(len(content_)))

    def guesses(self, views: list[Additive], base: float, given: tuple[int, int], used: set) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(view, class, key, content, metadata), the surest first, keys once a view and class and not in ``used``."""
        free = np.array([k not in used for k in self.keys], bool)
        first = {k: i for i, k in reversed(list(enumerate(self.keys))) if free[i]}
        rows = sorted(first.values())
        a, b = self.x[0][rows], self.x[1][rows]
        return [(v, one, self.keys[rows[i]], a[i], b[i]) for v in (0, 1) for one, _, some in confident(views[v], (a, b)[v], base, given) for i in some] if rows else []


class Table:
    """Unlabelled documents as a table of features(): all of them are looked at, each round in one job.

    Each task gives its own surest guesses, of which the surest of all are taken: what moves doesn't grow with a task's rows.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def guesses(self, views: list[Additive], base: float, given: tuple[int, int], used: set) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
        def run(batches):
            best: dict[tuple[int, int], dict[int, tuple]] = {(v, one): {} for v in (0, 1) for one in (0, 1)}
            floor = dict.fromkeys(best, 0.0)
            for batch in batches:
                keys = batch.column(0).to_pylist()
                rows = [i for i, k in enumerate(keys) if k not in used]
                x = [_rows(batch.column(c))[rows] for c in (1, 2)]
                for v in (0, 1) if rows else ():
                    for one, lift, some in confident(views[v], x[v], base, (len(rows), len(rows))):
                        mine = best[v, one]
                        for i in some:
                            if (sure := abs(float(lift[i]))) < floor[v, one]:
                                break
                            key = keys[rows[i]]
                            mine[key] = max(mine.get(key, (0.0,)), (sure, x[0][i].tolist(), x[1][i].tolist()))
                        if len(mine) > 4 * given[one]:
                            floor[v, one] = _shrink(mine, given[one])
            for (v, one), mine in best.items():
                _shrink(mine, given[one])
                if mine:
                    sure, a, b = zip(*mine.values(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(mine)), pa.array([one] * len(mine)), pa.array(list(mine), pa.int64()), pa.array(sure), pa.array(a, pa.list_(pa.float64())), pa.array(b, pa.list_(pa.float64()))], names=["view", "class", "key", "sure", "content", "metadata"])

        found = self.rows.select("key", "content", "metadata").mapInArrow(run, "view bigint, class bigint, key bigint, sure double, content array<double>, metadata array<double>")
        once = found.groupBy("view", "class", "key").agg(F.max(F.struct("sure", "content", "metadata")).alias("x")).select("view", "class", "key", "x.*")
        nth = F.row_number().over(Window.partitionBy("view", "class").orderBy(F.desc("sure"), "key"))
        some = once.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("class") == 1, given[1]).otherwise(given[0])).collect()  # at most 2 * sum(given)
        some.sort(key=lambda r: (r["view"], -r["class"], r["nth"]))
        return [(r["view"], r["class"], r["key"], np.array(r["content"]), np.array(r["metadata"])) for r in some]


def _shrink(mine: dict[int, tuple], n: int) -> float:
    """Leaves the n surest, and says how sure the last one is."""
    order = sorted(mine, key=lambda key: (-mine[key][0], key))
    for key in order[n:]:
        del mine[key]
    return mine[order[:n][-1]][0] if order else 0.0


def cotrain(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Pool | Table, rounds: int = ROUNDS, given: int = GIVEN) -> Model:
    """labelled: the numbers of both views, row by row. Bins are quantiles of the labelled rows.

    A document that both views are sure of in one round goes to the view that is not the content's.
    """
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 1.0)
    aside = np.arange(len(y)) % 5 == 4  # for calibration
    if len(set(y[aside])) < 2:
        aside[:] = False
    check = aside if aside.any() else ~aside
    whole = ((), ((0, SOURCES), (1, LANGUAGES)))
    views = [Additive.over(a, w) for a, w in zip(labelled, whole, strict=True)]
    learn = [[x[~aside], y[~aside]] for x in labelled]
    used: set = set()
    share = y.mean()
    each = max(1, round(given * (1 - share))), max(1, round(given * share))
    for k in range(rounds + 1):
        for view, (x, t) in zip(views, learn, strict=True):
            view.fit(x, t)
        if k == rounds:
            break
        told: list[list] = [[], []]
        for me, one, key, *numbers_ in pool.guesses(views, float(np.log(share / (1 - share))), each, used):
            if key not in used:
                used.add(key)
                told[1 - me].append((numbers_[1 - me], float(one)))
        for other, some in enumerate(told):
            if some:
                learn[other] = [np.vstack([learn[other][0], *(x for x, _ in some)]), np.concatenate([learn[other][1], [t for _, t in some]])]
        if not any(told):
            break
    z = [v.logit(x[check]) for v, x in zip(views, labelled, strict=True)]
    one = np.ones(check.sum())
    calibration = [newton(np.stack([one, a], 1), y[check], 0.1) for a in z]
    for c in calibration:
        c[1] = max(c[1], 0.0)
    combination = newton(np.stack([one, *(c[0] + c[1] * a for c, a in zip(calibration, z, strict=True))], 1), y[check], 0.5)
    combination[1:] = np.maximum(combination[1:], 0.0)
    return Model(views, calibration, combination)


_COLUMNS = ("text", "source", "lang", "n_chars")


def _typed(docs: DataFrame) -> list:
    return [F.col(c).cast("long" if c == "n_chars" else "string").alias(c) for c in _COLUMNS]


def _rows(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def numbers(batch: pa.RecordBatch, at: int = 0, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch whose columns from ``at`` on are text, source, lang and n_chars."""
    text, source, lang, n = (batch.column(at + k).to_pylist() for k in range(4))
    return np.array([content(x, weights) for x in text]).reshape(len(text), -1), np.array([metadata(*x) for x in zip(source, lang, n, strict=True)]).reshape(len(text), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def features(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """Rows (doc_id, key, content, metadata) for every row; key is a hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = numbers(batch, 2, weights)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(a), _lists(b)], names=["doc_id", "key", "content", "metadata"])

        return run

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("key"), *_typed(docs)), make, f"doc_id {kind}, key bigint, content array<double>, metadata array<double>")


def _gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Both views, words and labels of the labelled sample (columns: the four, _id, _label), sorted by id."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = numbers(batch)
            words = [np.array(word_buckets(x), np.int32).tobytes() for x in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary()), pa.array(words, pa.binary())], names=["id", "label", "content", "metadata", "words"])

        return run

    found = sorted(map_batches(rows, make, "id bigint, label int, content binary, metadata binary, words binary").collect(), key=lambda r: r.id)
    read = lambda name, kind=np.float64: [np.frombuffer(r[name], kind) for r in found]
    return np.array(read("content")).reshape(len(found), len(CONTENT)), np.array(read("metadata")).reshape(len(found), 3), read("words", np.int32), np.array([r.label for r in found], float)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS, given: int = GIVEN) -> tuple[Model, DataFrame, str]:
    """A model, the features() of all docs that its guesses were chosen from, and the folder that holds them.

    Fitted are a bounded sample of labelled documents outside the held-out fifth, and guesses on unlabelled ones outside
    it, texts that repeat being one. Long texts take part by their numbers. Of equally sure guesses the least key counts.
    """
    small_batches(docs.sparkSession)
    rows, sizes = labelled_sample(docs, labels, label, sample, _typed(docs))
    a, b, words, y = _gathered(rows.withColumn("_label", F.col("_label").cast("int")))
    weights = None
    if len(set(y)) == 2:
        weights = lexicon(words, y)
        # A document's own words must not speak for it: each half is weighed by the other half's lexicon.
        halves = [lexicon(words[k::2], y[k::2]) for k in (0, 1)]
        a[:, CONTENT.index("lexical")] = [lexical(w, halves[1 - k % 2]) for k, w in enumerate(words)]
    feats, kept = written(features(docs, weights), "quality", 4)
    named = feats.where(F.col("doc_id").isNotNull() & ~held_out())
    marked = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id")).distinct()
    free, path = written(named.join(marked, F.col("doc_id").cast("long") == F.col("_id"), "left_anti").select("key", "content", "metadata"), "pool", 4)
    model = cotrain((a, b), y, Table(free), rounds, given)
    remove(docs.sparkSession, path)
    model.lexicon = weights
    total, k = sum(sizes.values()), y.mean() if len(y) else 1
    if model.combination is not None and 0 < sizes.get(1, 0) < total:  # the classes were sampled apart: back to their shares
        share = sizes[1] / total
        shift = np.log(share / (1 - share)) - np.log(k / (1 - k))
        model.combination[0] += shift
        for c in model.calibration:
            c[0] += shift
        model.combination[0] -= shift * model.combination[1:].sum()
    return model, feats, kept


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS, given: int = GIVEN) -> Model:
    """fitted()'s model alone; nothing stays written."""
    model, _, path = fitted(docs, labels, label, sample, rounds, given)
    remove(docs.sparkSession, path)
    return model


def scored(feats: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, content_score, metadata_score, score) of features(): probabilities of quality 1 by each view and by both."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = model.scores(_rows(batch.column(1)), _rows(batch.column(2)))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, k]) for k in range(3))], names=["doc_id", "content_score", "metadata_score", "score"])

        return run

    return map_batches(feats.select("doc_id", "content", "metadata"), make, f"doc_id {feats.schema['doc_id'].dataType.simpleString()}, content_score double, metadata_score double, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """scored() for any documents.

    Null texts count as empty; null source, lang and n_chars have bins of their own. Each row gives a row, equal rows have
    equal scores, and texts of any length are read whole.
    """
    small_batches(docs.sparkSession)
    return scored(features(docs, model.lexicon), model)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs, with all their columns, without the rows that score less than ``least``."""
    small_batches(docs.sparkSession)
    at = [docs.columns.index(c) for c in _COLUMNS]

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(model.scores(*numbers(batch.select(at), 0, model.lexicon))[:, 2] >= least))

        return run

    return map_batches(docs, make, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by both views and by their combination; a document is predicted good from 0.5 on."""
    model, feats, _ = fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(feats, model).select("doc_id", held_out().alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
