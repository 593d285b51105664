import random

import numpy as np

from cellplan.llm import toxicity as tx

BAD = ["vile", "rotten", "filth"]


def corpus(r, n, noise=0.03):
    """Documents of sentences; label 1 where one sentence holds a bad word, some labels being wrong."""
    words = [f"w{k}" for k in range(300)]
    texts, labels, bad_sentence = [], [], []
    for _ in range(n):
        sentences = [" ".join(r.choices(words, k=r.randrange(3, 15))).capitalize() + "." for _ in range(r.randrange(1, 30))]
        at = r.randrange(len(sentences)) if r.random() < 0.25 else None
        if at is not None:
            sentences[at] = "You " + r.choice(BAD) + " " + sentences[at]
        texts.append(" ".join(sentences))
        labels.append(int((at is not None) != (r.random() < noise)))
        bad_sentence.append(at)
    return texts, labels, bad_sentence


def test_finds_documents_and_sentences():
    r = random.Random(4)
    texts, labels, _ = corpus(r, 1500)
    model = tx.fit(texts, labels)
    assert set(BAD) <= model.weights.keys() and len(model.weights) < 12
    texts, _, at = corpus(r, 400, noise=0)
    for text, k in zip(texts, at, strict=True):
        score, found = model.score(text)
        assert (score >= 0.5) == (k is not None)
        if k is not None:
            assert [text[a:b].strip() for a, b, p in found if p >= 0.5] == [tx.SENTENCE.findall(text)[k].strip()]
    assert model.score("")[0] == model.leak < 0.2
    assert model.score("Clean words here. " * 20_000)[0] == model.leak


def test_noisy_or_by_definition():
    model = tx.Model(0.1, -1.0, {"bad": 2.0, "worse": 3.0})
    score, found = model.score("So bad. Fine here. bad WORSE!")
    p = [1 / (1 + np.exp(-x)) for x in (1.0, 4.0)]
    assert np.allclose([x for *_, x in found], p) and np.isclose(score, 1 - 0.9 * (1 - p[0]) * (1 - p[1]))


def test_scores_by_definition(spark):
    """All documents of a small table, sentence by sentence and word by word."""
    docs = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    names = sorted({w for t in docs[:40] for w in tx.WORD.findall(t.lower())})
    model = tx.Model(0.07, -2.0, {**{w: 0.5 for w in names[::17]}, **{w[:4] + "*": 1.5 for w in names[::23] if len(w) > 4}})
    for text in docs:
        none = 1 - model.leak
        for sentence in tx.SENTENCE.findall(text):
            found = tx.traits(set(tx.WORD.findall(sentence.lower()))) & model.weights.keys()
            if found:
                none *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weights[w] for w in found))))
        assert np.isclose(model.score(text)[0], 1 - none)


def test_apart():
    """Of near copies one is learnt from; long texts over one vocabulary are no copies for their common words."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    long = [" ".join(r.choices(words, k=600)) for _ in range(60)]
    assert tx.apart(long, [0] * 60) == list(range(60))
    copies = [long[0], long[0].replace("w7 ", "x "), long[0], "", ""]
    assert tx.apart(copies, [0, 0, 1, 0, 0]) == [0, 2, 3]


def test_sample_is_bounded(spark):
    """Ids that very many rows share give one row each, the same in every run."""
    docs = spark.range(4000).selectExpr("id % 4 + 1 AS doc_id", "concat('text ', id) AS text", "id AS _hash")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id bigint, toxic int")
    one = [sorted(map(tuple, tx.labelled_sample(docs.repartition(n), labels, "toxic", 3)[0].collect())) for n in (2, 7)]
    assert one[0] == one[1] and len(one[0]) == len({x[1] for x in one[0]}) <= 4


def test_degenerate():
    assert tx.fit([], []).score("x")[0] == 0.0
    assert tx.fit(["a", "b"], [1, 1]).score("x")[0] == 1.0
    assert tx.fit(["a b", "c"], [1, 0]).weights == {}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    out = {x.doc_id: x for x in tx.op3_toxicity(spark, d).collect()}
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert out.keys() == docs.keys()
    labels = [x for x in spark.read.parquet(f"{d}/labels.parquet").collect() if out[x.doc_id].held_out]
    right = np.mean([out[x.doc_id].predicted == x.toxic for x in labels])
    assert len(labels) > 50 and right >= 0.9  # some labels are noise
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out.values())
    import zlib

    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out.values())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "bad you.", "a"), (1, "bad you.", "a"), (None, None, None), (2, "", "b")], "doc_id bigint, text string, score string")
    model = tx.Model(0.05, 0.0, {"bad": 3.0})
    got = tx.score(df, model).collect()
    assert sorted((x.doc_id or 0, round(x.score, 2)) for x in got) == [(0, 0.05), (1, 0.95), (1, 0.95), (2, 0.05)]
    kept = tx.keep_clean(df, model)
    assert kept.columns == df.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 2]
    clash = df.withColumnsRenamed({"score": "_label"}).withColumn("_id", tx.F.lit("x"))
    assert tx.train(clash, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")) is not None
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert tx.train(df, empty).leak == 0.0 and tx.score(df.limit(0), model).count() == 0
