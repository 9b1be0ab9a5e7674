"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a whole
vocabulary entry gets its id at once. Tier two merges the bytes of the others by rank,
with a heap over a linked list of parts, in O(n log n) for a pre-token of any length.
The rank file and the pre-token pattern are parameters; both are bounded (one vocabulary)
and go to the workers with the task. Null text counts as empty: no tokens.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from wardlake.llm.common import MEMO_ENTRIES, texts

ENCODED = "id bigint, n_tokens bigint, ids binary"
DECODED = "id bigint, n_tokens bigint, ids binary, decoded binary"


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file (base64 token, rank), as a list by rank."""
    out: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                out[int(rank)] = base64.b64decode(token)
    return [out.get(i, b"") for i in range(max(out) + 1)]


class MinimalPerfectHash:
    """Hash and displace: n keys to exactly n slots. A bucket's seed is the first that sends
    its keys to free slots; buckets of one key store their slot directly (as a negative seed)."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        buckets: list[list[int]] = [[] for _ in range(n)]
        for i, k in enumerate(keys):
            buckets[xxhash.xxh3_64_intdigest(k) % n].append(i)
        self.seed = np.zeros(n, np.int64)
        slots: list[int] = [-1] * n
        order = sorted((b for b in range(n) if buckets[b]), key=lambda b: -len(buckets[b]))
        at = 0
        while at < len(order) and len(buckets[order[at]]) > 1:
            own = buckets[order[at]]
            seed = 0
            while True:
                seed += 1
                tried = {xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in own}
                if len(tried) == len(own) and all(slots[s] < 0 for s in tried):
                    break
            for i in own:
                slots[xxhash.xxh3_64_intdigest(keys[i], seed) % n] = i
            self.seed[order[at]] = seed
            at += 1
        free = (s for s in range(n) if slots[s] < 0)
        for b in order[at:]:
            s = next(free)
            slots[s] = buckets[b][0]
            self.seed[b] = -s - 1
        self.seed = self.seed.tolist()
        self.keys = [keys[i] for i in slots]
        self.values = [values[i] for i in slots]

    def get(self, key: bytes) -> int | None:
        """The key's value; None when the slot holds another key."""
        d = self.seed[xxhash.xxh3_64_intdigest(key) % self.n]
        s = -d - 1 if d < 0 else xxhash.xxh3_64_intdigest(key, d) % self.n
        return self.values[s] if self.keys[s] == key else None


class Bpe:
    """The encoder: whole pre-tokens from the hash, the rest by merges."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        known = [i for i, t in enumerate(vocabulary) if t]
        self.vocabulary, self.pattern = vocabulary, pattern
        self.index = MinimalPerfectHash([vocabulary[i] for i in known], known)
        self.ranks = {vocabulary[i]: i for i in known}  # of parts, while bytes are merged
        self.digest = xxhash.xxh3_128_hexdigest(repr((vocabulary, pattern)).encode("utf-8", "surrogatepass"))

    def piece(self, piece: bytes) -> list[int]:
        rank = self.index.get(piece)
        return [rank] if rank is not None else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent parts, leftmost first, until none is in the vocabulary."""
        n, get, pop, push = len(piece), self.ranks.get, heapq.heappop, heapq.heappush
        bits = n.bit_length()
        mask = (1 << bits) - 1
        stop = list(range(1, n + 1))  # end of the part that begins here, so also the next part; 0: none begins here
        prev = list(range(-1, n))  # start of the part before
        heap = [(r << 2 * bits) | (i << bits) | (i + 2) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            key = pop(heap)
            i, e = (key >> bits) & mask, key & mask
            j = stop[i]
            if not j or j >= n or stop[j] != e:  # one of the two parts has grown or gone since
                continue
            stop[i], stop[j] = e, 0
            if e < n:
                prev[e] = i
                if (r := get(piece[i:stop[e]])) is not None:
                    push(heap, (r << 2 * bits) | (i << bits) | stop[e])
            p = prev[i]
            if p >= 0 and (r := get(piece[p:e])) is not None:
                push(heap, (r << 2 * bits) | (p << bits) | e)
        out, i = [], 0
        while i < n:
            out.append(get(piece[i:stop[i]]))
            i = stop[i]
        return out


# The classes a pre-token pattern names, within U+0000-U+00FF. Fixed values (Unicode).
_LATIN = {"L": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "N": "0-9\xb2\xb3\xb9\xbc-\xbe", "s": "\t-\r \x85\xa0"}


def latin_pattern(pattern: str) -> str:
    """The pattern with its classes written out for texts within U+00FF, which the plain
    ``re`` module searches faster; on such texts both find the same."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        m = re.match(r"\\p\{([LN])\}|\\(s)|\\(S)", pattern[i:])
        if m and m[3]:
            out.append("[^" + _LATIN["s"] + "]")
        elif m:
            members = _LATIN[m[1] or m[2]]
            out.append(members if inside else f"[{members}]")
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
        i += len(m[0]) if m else 1
    return "".join(out)


class Pretokens:
    """Finds the pre-tokens of a text."""

    def __init__(self, pattern: str):
        self.any, self.latin = regex.compile(pattern).findall, re.compile(latin_pattern(pattern)).findall

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any(text)
        return self.latin(text)


_MEMOS: dict[str, dict] = {}  # of this worker, by digest of the vocabulary and pattern


class _Memo(dict):
    """Pre-token -> its ids as little-endian uint32, remembered over the tasks of a worker."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.piece(piece.encode("utf-8", "surrogatepass"))
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    @classmethod
    def of(cls, bpe: Bpe) -> _Memo:
        if bpe.digest not in _MEMOS:
            _MEMOS.clear()
            _MEMOS[bpe.digest] = cls(bpe)
        return _MEMOS[bpe.digest]


def encode(docs: DataFrame, bpe: Bpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (little-endian uint32, back to back).

    Null and empty texts give no tokens and empty ids; repeated rows are encoded each;
    other columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe)  # bounded: one vocabulary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, memo = Pretokens(shared.value.pattern), _Memo.of(shared.value)
        for batch in batches:
            for start, values in texts(batch.column(1)):
                ids = [b"".join(map(memo.__getitem__, find(t))) if t else b"" for t in values]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"`{text_col}` text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, bpe: Bpe) -> DataFrame:
    """The rows of ``encode`` with ``decoded``: the bytes of their ids. An unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.vocabulary.__getitem__
        for batch in batches:
            for start, values in texts(batch.column(2)):
                out = [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in values]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(start, len(out)) for c in range(3)] + [pa.array(out, pa.binary())],
                    ["id", "n_tokens", "ids", "decoded"])

    return encoded.select("id", "n_tokens", "ids").mapInArrow(run, DECODED)
