"""Byte-level BPE: encoding by a prefix-sharing trie, decoding, and token counts by heap-and-list merging.

A token sequence is what BPE makes of a text exactly if each of its neighbouring pairs is, so a prefix has one last
token: the only one that can stand behind the last token of what precedes it. Words in a trie share these states.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable
from itertools import count
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches

#: White space as Unicode has it. Fixed values.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: How byte-level BPE cuts a text into pieces that are merged by themselves. A fixed pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A run of white space with what follows it: no piece reaches out of such a unit.
UNITS = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
BLANKS = frozenset(c for c in map(chr, range(0x3001)) if regex.match(f"[{WHITE}]", c))
#: Entries that a worker's caches of units and of pieces may hold before they start anew. Only speed depends on it.
CACHE = 700_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = count(0x100)
    return {chr(b if b in plain else next(extra)): b for b in range(256)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        vocab = file["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; -1: a byte
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[int, tuple[int, int]] = {}  # a pair's rank and what it becomes
        for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merge[left << 32 | right] = k, made
            self.rank[made], self.parts[made] = k, (left, right)
        self.byte_id = {b: vocab[c] for c, b in letters.items()}
        for i in self.byte_id.values():
            self.rank[i] = -1
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None


class TrieEncoder:
    """Encodes sets of distinct words; what they begin with alike is worked out once."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.size = {i: len(vocab.bytes_of[i]) for i in vocab.rank}
        self.suffixes: dict[bytes, int] = {}  # endings of tokens, and the token's number for a whole one
        for i in vocab.rank:
            token = vocab.bytes_of[i]
            for k in range(1, len(token)):
                self.suffixes.setdefault(token[k:], -1)
            self.suffixes[token] = i
        self.pairs: dict[int, bool] = {}

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side.

        Goes back in time along a's right edge and b's left edge: the two pieces that touched at some time would have
        merged if their pair's turn came before either was merged into what it became. Of equal pairs the left one
        merges first.
        """
        key = a << 32 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        rank, parts, merge = self.vocab.rank, self.vocab.parts, self.vocab.merge
        until_a = until_b = 1 << 60
        apart = True
        while True:
            if (m := merge.get(a << 32 | b)) and m[0] < until_a and m[0] <= until_b:
                apart = False
                break
            if rank[a] > rank[b]:
                until_a, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                until_b, b = rank[b], parts[b][0]
            else:
                break
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        self.pairs[key] = apart
        return apart

    def encode(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """For each word its token numbers, packed as little-endian unsigned 32-bit integers.

        Words go into the trie in sorted order, which is its depth-first order: of the trie only the path to the newest
        word need be kept, with the last token of each prefix on it. A word takes over the states of the path that it
        shares with the one before and adds those of its own branch.
        """
        suffixes, size, apart, known = self.suffixes.get, self.size, self.stay_apart, self.pairs
        out = {}
        path, last = b"", [-1]  # last[depth]: the last token of the prefix of that length
        for word in sorted(words):
            n = min(len(path), len(word))
            shared = 0
            while shared < n and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found = []
                for k in range(end - 1, -1, -1):
                    token = suffixes(word[k:end])
                    if token is None:
                        break
                    if token >= 0:
                        found.append(token)
                while True:  # the longest token that can stand behind its predecessor is the only one that can
                    token = found.pop()
                    before = last[end - size[token]]
                    if before < 0 or (ok := known.get(before << 32 | token)) or ok is None and apart(before, token):
                        last.append(token)
                        break
            ids, k = [], len(word)
            while k:
                ids.append(last[k])
                k -= size[last[k]]
            ids.reverse()
            out[word] = pack(f"<{len(ids)}I", *ids)
            path = word
        return out


def merge_count(word: bytes, vocab: Vocabulary) -> int:
    """Tokens of a word: its bytes less the merges. A heap gives the lowest-rank pair, a linked list its neighbours."""
    n = len(word)
    if n < 2:
        return n
    merge = vocab.merge
    ids: list[int] = [vocab.byte_id[b] for b in word]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if m := merge.get(ids[i] << 32 | ids[i + 1]):
            heap.append((m[0], i, m[1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i, made = heapq.heappop(heap)
        j = after[i]
        # A stale entry: i was merged away or one of the two changed since.
        if ids[i] < 0 or j >= n or (m := merge.get(ids[i] << 32 | ids[j])) is None or m[0] != rank:
            continue
        merges += 1
        ids[i], ids[j] = made, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if m := merge.get(made << 32 | ids[k]):
                heapq.heappush(heap, (m[0], i, m[1]))
        if (h := before[i]) >= 0 and (m := merge.get(ids[h] << 32 | made)):
            heapq.heappush(heap, (m[0], h, m[1]))
    return n - merges


class Units:
    """Looks texts up unit by unit. ``learn`` gives the values of distinct pieces; ``join`` puts values together."""

    def __init__(self, vocab: Vocabulary, learn: Callable[[set[str]], dict], join: Callable, special: dict):
        self.vocab, self.learn, self.join, self.special = vocab, learn, join, special
        self.pieces: dict = {}
        self.units: dict = {}  # with the white space before it
        self.spaced: dict = {}  # without the one space before it; None: an edge is white space, so the text is cut by UNITS

    def _plan(self, text: str):
        """The text's parts between single spaces, or its units where white space comes in runs."""
        parts = text.split(" ")
        if "" in parts or parts[0][0] in BLANKS or parts[0][-1] in BLANKS:
            return UNITS.findall(text), None
        return parts[:1], parts[1:]

    def values(self, texts: list[str]) -> list:
        """The joined value of each text."""
        if len(self.units) + len(self.spaced) > CACHE:
            self.units.clear()
            self.spaced.clear()
        if len(self.pieces) > CACHE // 2:
            self.pieces.clear()
        split = self.vocab.special.split if self.vocab.special else lambda x: [x]
        plans, units, spaced = [], set(), set()
        for text in texts:
            plan = []
            for part in split(text):
                if part in self.special:
                    plan.append(part)
                elif part:
                    head, tail = self._plan(part)
                    if tail and (new := set(tail).difference(self.spaced)):
                        if any(x[0] in BLANKS or x[-1] in BLANKS for x in new):
                            head, tail = UNITS.findall(part), None
                        else:
                            spaced |= new
                    units.update(head)
                    plan.append((head, tail))
            plans.append(plan)
        self._fill(units.difference(self.units), spaced)
        unit, space, join = self.units.__getitem__, self.spaced.__getitem__, self.join
        out = []
        for plan in plans:
            found: list = []
            for x in plan:
                if isinstance(x, str):
                    found.append(self.special[x])
                else:
                    found += map(unit, x[0])
                    if x[1]:
                        found += map(space, x[1])
            out.append(join(found))
        return out

    def _fill(self, units: set[str], spaced: set[str]) -> None:
        cut = PIECES.findall
        plans = [(self.units, u, cut(u)) for u in units] + [(self.spaced, u, cut(" " + u)) for u in spaced]
        new = {p for _, _, pieces in plans for p in pieces}.difference(self.pieces)
        self.pieces |= self.learn(new)
        known, join = self.pieces, self.join
        for at, u, pieces in plans:
            at[u] = known[pieces[0]] if len(pieces) == 1 else join([known[p] for p in pieces])


def encoder(path: str) -> Units:
    vocab = Vocabulary(path)
    trie = TrieEncoder(vocab)

    def learn(pieces: set[str]) -> dict[str, bytes]:
        words = {p: p.encode() for p in pieces}
        ids = trie.encode(words.values())
        return {p: ids[w] for p, w in words.items()}

    return Units(vocab, learn, b"".join, {t: i.to_bytes(4, "little") for t, i in vocab.added.items()})


def counter(path: str) -> Units:
    vocab = Vocabulary(path)
    return Units(vocab, lambda pieces: {p: merge_count(p.encode(), vocab) for p in pieces}, sum, dict.fromkeys(vocab.added, 1))


#: By worker process: what is made from a path once and used by all its tasks.
_MADE: dict = {}


def made(make: Callable, path: str):
    if (key := (make.__name__, path)) not in _MADE:
        _MADE[key] = make(path)
    return _MADE[key]


def decode(ids: bytes, vocab: Vocabulary) -> str:
    """The text of packed token numbers; bytes that are no UTF-8 become U+FFFD."""
    import numpy as np

    return b"".join(map(vocab.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_decoded: bool = False) -> DataFrame:
    """Encodes every text. Rows: id_col, ids (packed little-endian unsigned 32-bit) and, if asked for, decoded (from ids).

    A null text counts as empty and gives no ids. An id may be null or repeated: each row gives a row. Added tokens'
    strings in a text become those tokens. Other columns are not read. An empty table gives an empty result.
    """
    path = path or default_path()
    small_batches(df.sparkSession)

    def make():
        units = made(encoder, path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = units.values([x or "" for x in batch.column(1).to_pylist()])
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if with_decoded:
                columns.append(pa.array([decode(x, units.vocab) for x in ids], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

        return run

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), make, f"`{id_col}` {kind}, ids binary" + ", decoded string" * with_decoded)


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The text of each row's packed token numbers. Null ids give an empty text; a number outside the vocabulary fails."""
    path = path or default_path()
    small_batches(df.sparkSession)

    def make():
        vocab = made(Vocabulary, path)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or b"", vocab) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "decoded"])

    return map_batches(df.select(id_col, ids_col), make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded string")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Counts every text's tokens without making token numbers. Rows: id_col, n_bytes, n_tokens.

    Null and empty texts have 0 of both. Rows are neither joined nor dropped; other columns are not read.
    """
    path = path or default_path()
    small_batches(df.sparkSession)

    def make():
        units = made(counter, path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            import pyarrow.compute as pc

            texts = batch.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(units.values([x or "" for x in texts.to_pylist()]), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

        return run

    return map_batches(df.select(id_col, text_col), make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def op2_bpe_codec(docs: DataFrame) -> DataFrame:
    """Digests of every text's token numbers and of what they decode to."""
    return bpe_encode(docs, with_decoded=True).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_token_counts(docs: DataFrame, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more tokens than the limit."""
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
