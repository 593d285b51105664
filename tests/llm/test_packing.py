import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from cellplan.llm import bpe, packing
from cellplan.llm.common import table


def packed_well(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity; gives the number of sequences."""
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_library_agrees():
    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(8)
    texts = ["", "a  b", "x\n\n y", "<|endoftext|> z", "é🙂 ü", *("".join(r.choice("thena sr.\n,") for _ in range(300)) for _ in range(200))]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.library_units(path).values(texts)] == want
    assert bpe.encoder(path).values(texts) == packing.library_units(path).values(texts)


def test_plan():
    r = random.Random(2)
    for n, top in ((0, 10), (1, 10), (300, 1024), (30_000, 1023), (5000, 500), (40_000, 60)):
        lengths = [min(1024, max(1, int(r.gammavariate(2, top / 4)))) for _ in range(n)]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        planned = packing.plan(histogram)
        used: dict = {}
        for config, k in planned:
            assert sum(config) <= 1024 and k > 0
            for x in config:
                used[x] = used.get(x, 0) + k
        assert used == histogram
        count, least = sum(k for _, k in planned), math.ceil(sum(lengths) / 1024)
        assert count <= least * 1.01 + 3, (n, top, count, least)


def histograms():
    r = random.Random(4)
    draw = {"gamma": lambda: min(1023, max(1, int(r.gammavariate(2, 200)))), "uniform": lambda: r.randrange(1, 1024), "short": lambda: r.randrange(1, 61)}
    for name, one in draw.items():
        yield name, Counter(one() for _ in range(20_000))
    units = packing.library_units(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = [len(x) // 4 + 1 for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0) for x in units.values([t.as_py() or ""])]
    yield "documents", Counter((n - 1) % 1024 + 1 for n in sizes if (n - 1) % 1024 < 1023)


def test_program():
    """The program's solution covers every length, is close to its own bound, and makes up nine sequences in ten."""
    for name, histogram in histograms():
        lengths = np.array(sorted(histogram))
        demand = np.array([histogram[int(x)] for x in lengths])
        began = time.process_time()
        solution = packing.solve(lengths, demand, 1024)
        covered = np.zeros(len(lengths))
        for config, often in solution.use.items():
            assert sum(lengths[k] * m for k, m in config) <= 1024 and often > 0
            for k, m in config:
                covered[k] += often * m
        assert (covered >= 0.99 * demand).all() and math.isclose(solution.value, sum(solution.use.values()))
        assert lengths @ demand / 1024 - 1e-6 <= solution.bound <= solution.value <= 1.01 * solution.bound, name
        whole, left = packing.rounded(solution, lengths, demand, 1024)
        own, rest = sum(n for _, n in whole), sum(n for _, n in packing.best_fit(lengths, left, 1024))
        assert own >= 0.9 * (own + rest), (name, own, rest)
        assert own + rest <= sum(n for _, n in packing.best_fit(lengths, demand, 1024)), name
        assert time.process_time() - began < 10


def test_prices_adapt():
    """Where sequences can't be filled, prices in proportion to size prove little: the bound must rise above the volume."""
    for histogram, least in (({600: 40, 700: 60}, 100), ({600: 1000, 500: 500, 300: 800}, 1250), ({513: 7}, 7), ({342: 30}, 15)):
        lengths, demand = np.array(sorted(histogram)), np.array([histogram[x] for x in sorted(histogram)])
        solution = packing.solve(lengths, demand, 1024)
        assert solution.bound <= least + 1e-6 and lengths @ demand / 1024 < 0.95 * solution.bound
        assert sum(n for _, n in packing.plan(histogram)) == least


def test_best_fit():
    """As one piece at a time would go."""
    r = random.Random(6)
    for _ in range(200):
        capacity = r.randrange(5, 40)
        lengths = sorted(r.sample(range(1, capacity + 1), r.randrange(1, 5)))
        demand = [r.randrange(0, 9) for _ in lengths]
        rooms: list[int] = []
        for x, n in sorted(zip(lengths, demand, strict=True), reverse=True):
            for _ in range(n):
                if fit := min((q for q in rooms if q >= x), default=0):
                    rooms.remove(fit)
                rooms.append((fit or capacity) - x)
        got = packing.best_fit(np.array(lengths), np.array(demand), capacity)
        assert sorted(capacity - sum(c) for c, n in got for _ in range(n)) == sorted(rooms)
        assert Counter(x for c, n in got for _ in range(n) for x in c) == Counter({x: n for x, n in zip(lengths, demand, strict=True) if n})


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = packing.op7_best_fit_packing(docs).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    tokens = 0
    for d in docs.collect():
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 2]
        tokens += len(ids)
        at = 0
        mine = sorted(by.pop(d.doc_id), key=lambda r: r.piece)
        for k, r in enumerate(mine):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024) and (len(mine) > 1 or len(ids) <= 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by
    assert packed_well(rows, 1024) <= math.ceil(tokens / 1024) * 1.01 + 2


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (2, "a b " * 3000, 6), (2, "a b " * 3000, 6), (None, "x", 7)], "doc_id bigint, text string, length int")
    rows = packing.op7_best_fit_packing(df).collect()
    assert packed_well(rows, 1024) == 12 and sum(r.length for r in rows) == 1 + 1 + 2 * (6001 + 1) + 2
    assert packing.op7_best_fit_packing(df.limit(0)).count() == 0
    cut = packing.pieces(df).withColumns({"_rank": packing.F.lit("r"), "_n": packing.F.lit(1), "offset": packing.F.lit("o")}).cache()
    again = packing.pack(cut)
    assert again.columns == [*(c for c in cut.columns if c != "offset"), "sequence_id", "offset"] and packed_well(again.collect(), 1024) == 12
