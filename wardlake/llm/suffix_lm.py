"""Language-model scoring with a probabilistic suffix tree, and word counts of the whole corpus.

The tree spells a text: its words (see ``ascii_lower_words``) byte by byte, one blank behind each
word, and one end symbol. Contexts are the preceding bytes, up to ``depth``. A context is a
candidate when it occurs ``min_count`` times, whatever the size of the corpus; it is kept when its
next-symbol distribution diverges from its parent's (the context without its oldest byte) by at
least ``divergence`` nats in all, count times Kullback-Leibler divergence. Parents of kept contexts
and candidates of up to ``LOW`` bytes are kept too. Distributions are smoothed towards the parent's,
the root's towards all symbols alike. A symbol's probability is that of the longest kept suffix of
its history, so it follows from its (depth + 1)-gram.

No task and no driver holds the tree. Blocks of texts send their distinct (depth + 1)-grams with
their training counts to counting tasks, dealt out by the last ``LOW + 1`` bytes of the context:
all longer contexts with that ending meet there, are counted, tested and smoothed, and the block
gets the probabilities of its own grams back in the same order. An ending with more than the share
``HOT`` of all training symbols is dealt out by one more byte, so that no task gets all of it; its
own counts, which its parts need, go to every counting task. It is split only if its own divergence
keeps it, so that no part has to know of the others: where it is counted changes no result. What
comes to the driver are the counts of all contexts up to ``LOW`` bytes, bounded by the alphabet, and
those of the hot endings, at most 1 / ``HOT`` of them.

A token's probability is a mixture of its share of the training tokens and, with weight
``spell_weight``, its spelling by the tree, so every text has a positive probability.

Word counts cover the corpus too. Blocks of texts send the hashes of their distinct words with
their counts to counting tasks and get the corpus counts back in the same order, so no task and
no driver holds the vocabulary. Words are told apart by 64-bit hashes.

Null and empty texts are the end symbol alone. Rows with a null id are scored but are never
learned from, and their ``held_out`` is true. Repeated rows count each. An empty table gives no
rows; without any training text every count is 0 and all symbols are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import HASH, WordHash, ascii_lower_words, block_count, blocked, fold, from_blobs, hashes, keep, texts

DEPTH = 5
MIN_COUNT = 2  # occurrences of a context
LOW = 2  # bytes of the contexts whose counts every counting task gets
HOT = 1 / 1024  # of all training symbols: an ending of more is counted in parts
DIVERGENCE = 5.0
SMOOTHING = 2.0
END = 10  # the end symbol, also what stands before a text; no word holds it
SYMBOLS = 256
SPELL_WEIGHT = 0.85  # of the spelling in a token's probability
HELD_GRAMS = 4_000_000  # distinct n-grams a map task holds before it passes them on
CHUNK = 4 << 20  # bytes whose n-grams are sorted at once


def spell(text: str | None) -> bytes:
    return b" ".join([*ascii_lower_words(text), bytes([END])])


# --- the tree --------------------------------------------------------------------------------


def numbers(spelled: list[bytes], depth: int) -> np.ndarray:
    """The (depth + 1)-gram that ends at each symbol of the texts, as a number, one text after another."""
    pad = bytes([END]) * depth
    raw = np.frombuffer(pad + pad.join(spelled), np.uint8)
    g = np.zeros(len(raw) - depth, np.int64)
    for j in range(depth + 1):
        g = (g << 8) | raw[j:j + len(g)]
    # places inside the padding between two texts are no symbols of a text
    ends = np.cumsum([len(x) + depth for x in spelled])
    real = np.ones(len(g), bool)
    for j in range(depth):
        real[ends[:-1] - depth + j] = False
    return g[real]


def grams(docs: DataFrame, depth: int) -> DataFrame:
    """(gram, n): the (depth + 1)-grams of all texts of ``docs`` (id, text), as numbers."""

    def count(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = pa.array(numbers(held, depth)).dictionary_encode()
        return found.dictionary.to_numpy(), np.bincount(found.indices.to_numpy())

    def merge(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        g, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(g)
        g, n = g[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        return g[first], np.add.reduceat(n, first)

    def rows(sums: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sums[0]), pa.array(sums[1], pa.int64())], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, sums = 0, None
        for batch in batches:
            for _, values in texts(batch.column(1)):
                for t in values:
                    held.append(spell(t))
                    size += len(held[-1])
                    if size >= CHUNK:
                        sums = merge(sums, count(held)) if sums else count(held)
                        held, size = [], 0
                        if len(sums[0]) >= HELD_GRAMS:
                            yield rows(sums)
                            sums = None
        if held:
            sums = merge(sums, count(held)) if sums else count(held)
        if sums:
            yield rows(sums)

    return docs.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """The candidate contexts of one length, as numbers."""

    cells: np.ndarray  # context and next symbol, ascending
    p: np.ndarray  # the symbol's probability there
    contexts: np.ndarray  # ascending
    back: np.ndarray  # the share a context leaves to its parent's distribution
    kept: np.ndarray


def _ending(g: np.ndarray, n_bytes: int) -> np.ndarray:
    return g & ((1 << 8 * n_bytes) - 1)


def _sums(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells, at = np.unique(cells, return_inverse=True)
    return cells, np.bincount(at, weights=n, minlength=len(cells))


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``x`` lies in ``sorted_`` (not empty), and whether it does."""
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def level(length: int, cells: np.ndarray, n: np.ndarray, parents: Level | None, least: float, divergence: float,
          smoothing: float = SMOOTHING) -> Level:
    """The contexts of ``length`` bytes from the counts of their cells."""
    contexts, total = _sums(cells >> 8, n)
    symbols = np.diff(np.append(np.searchsorted(cells >> 8, contexts), len(cells)))
    enough = total >= (least if length else 1)
    cells, n = cells[np.repeat(enough, symbols)], n[np.repeat(enough, symbols)]
    contexts, total, symbols = contexts[enough], total[enough], symbols[enough]
    if not len(contexts):
        return Level(cells, n, contexts, total, enough[:0])
    flat = np.full(len(cells), 1 / SYMBOLS)
    q = flat if parents is None else parents.p[np.searchsorted(parents.cells, _ending(cells, length))]
    weight = smoothing * symbols
    back = weight / (total + weight)
    p = (n + np.repeat(weight, symbols) * q) / np.repeat(total + weight, symbols)
    first = np.cumsum(symbols) - symbols
    # a symbol that never follows has its parent's probability times ``back``
    apart = np.add.reduceat(p * np.log(p / q), first) + back * np.log(back) * (1 - np.add.reduceat(q, first))
    return Level(cells, p, contexts, back, (total * apart >= divergence) | (length <= LOW))


@dataclass
class Low:
    """What every counting task knows: the contexts of up to ``LOW`` bytes, and the counts of the
    endings that are dealt out in parts."""

    levels: list[Level]
    hot: np.ndarray  # endings of LOW + 1 bytes, ascending
    cells: np.ndarray  # those with their next symbols, ascending
    n: np.ndarray


def log10_grams(values: np.ndarray, n: np.ndarray, low: Low, depth: int, least: float, divergence: float) -> np.ndarray:
    """The log10 probability of the last symbol of each gram of ``values``, which have every gram of
    the corpus (``n`` times in the training) with the same ``LOW + 1`` bytes before the symbol, one
    byte more for the endings in ``low.hot``."""
    levels = list(low.levels)
    for d in range(len(levels), depth + 1):
        cells, times = _sums(_ending(values[n > 0], d + 1), n[n > 0])
        if d == LOW + 1 and len(low.hot):
            whole = ~np.isin(cells >> 8, low.hot)
            cells, times = np.concatenate([cells[whole], low.cells]), np.concatenate([times[whole], low.n])
            order = np.argsort(cells)
            cells, times = cells[order], times[order]
        levels.append(level(d, cells, times, levels[-1], least, divergence))
    for d in range(depth, len(low.levels), -1):
        levels[d - 1].kept |= np.isin(levels[d - 1].contexts, _ending(levels[d].contexts[levels[d].kept], d - 1))
    p = np.full(len(values), 1 / SYMBOLS)
    out = p.copy()
    for d, at in enumerate(levels):
        if not len(at.contexts):
            break
        cells = _ending(values, d + 1)
        context, known = _find(at.contexts, cells >> 8)
        cell, seen = _find(at.cells, cells)
        p = np.where(seen, at.p[cell], np.where(known, at.back[context] * p, p))
        out = np.where(known & at.kept[context], p, out)
    return np.log10(out)


def learn_low(counted: DataFrame, depth: int, least: float, divergence: float) -> Low:
    """From the corpus counts (gram, n) of the (LOW + 2)-grams, or of shorter ones for a lower depth."""
    width = min(LOW, depth) + 1
    t = counted.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * width) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    g, n = (t.column(c).to_numpy() for c in ("gram", "n"))
    levels: list[Level] = []
    for d in range(width):
        levels.append(level(d, *_sums(_ending(g, d + 1), n), levels[-1] if levels else None, least, divergence))
    none = np.zeros(0, np.int64)
    if depth < LOW + 2:  # there is no further byte to split by
        return Low(levels, none, none, none)
    counted = counted.withColumn("ending", F.shiftright("gram", 8))
    hot = counted.groupBy("ending").agg(F.sum("n").alias("times")).where(F.col("times") > float(n.sum()) * HOT)
    t = counted.join(F.broadcast(hot), "ending").select("gram", "n").toArrow()  # at most 1 / HOT endings
    cells, n = _sums(t.column("gram").to_numpy(), t.column("n").to_numpy())
    own = level(LOW + 1, cells, n, levels[-1], least, divergence)
    hot = own.contexts[own.kept]
    stay = np.isin(cells >> 8, hot)
    return Low(levels, hot, cells[stay], n[stay])


def log10_tokens(by_symbol: np.ndarray, spelled: list[bytes], share: np.ndarray, weight: float) -> np.ndarray:
    """The log10 probability of every token: ``by_symbol`` has those of the symbols, ``share`` the
    tokens' shares of the training tokens, ``weight`` is that of the spelling."""
    raw = np.frombuffer(b"".join(spelled), np.uint8)
    last = np.flatnonzero((raw == 32) | (raw == END))
    by_tree = np.add.reduceat(by_symbol, np.concatenate([[0], last[:-1] + 1]))
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log((1 - weight) * share), np.log(weight) + by_tree * np.log(10)) / np.log(10)


# --- word and gram counts over blocks --------------------------------------------------------


def _words(blobs: pa.ChunkedArray) -> tuple[pa.Table, list[np.ndarray], list[bytes]]:
    """The rows of a block, each one's words and its spelling."""
    memo = WordHash()
    t = pa.concat_tables(from_blobs(blobs))
    words, spelled = [], []
    for _, values in texts(t.column("text")):
        for x in values:
            own = ascii_lower_words(x)
            words.append(hashes(memo, own))
            spelled.append(b" ".join([*own, bytes([END])]))
    return t, words, spelled


def _grams(spelled: list[bytes], depth: int, bits: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of a block by counting bucket and value, the buckets' cuts, the order of
    that among the grams as found, and for each symbol the gram as found."""
    found = pa.array(numbers(spelled, depth)).dictionary_encode()
    values = found.dictionary.to_numpy()
    ending = _ending(values >> 8, min(LOW + 1, depth))
    if len(hot):  # the mark tells a longer ending from a short one
        split = _find(hot, ending)[1]
        ending = np.where(split, _ending(values >> 8, LOW + 2) | (1 << 8 * (LOW + 2)), ending)
    bucket = ((ending.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    order = np.lexsort((values, bucket))
    cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1, dtype=np.uint64))
    return values[order], cuts, order, found.indices.to_numpy()


def _pack(values: np.ndarray, depth: int) -> bytes:
    """Grams byte by byte: the oldest bytes of all, then the next ones."""
    return values.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 7 - depth:].T.tobytes()


def _unpack(packed: pa.Buffer, depth: int) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(depth + 1, -1)
    g = np.zeros(planes.shape[1], np.int64)
    for plane in planes:
        g = (g << 8) | plane
    return g


FIGURES = pa.struct([("known", pa.int64()), ("tokens", pa.int64())])


def _cut(values: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(values >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _send(bits: int, depth: int, low):
    """A block's distinct words, and behind them its distinct grams, with their training counts, by
    counting bucket; 0 where one occurs in texts outside the training only."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        data, every, spelled = _words(t.column("blob"))
        learns = data.column("learn").to_pylist()
        learn = [w for w, yes in zip(every, learns) if yes]
        values = np.unique(np.concatenate(every))
        counts = np.zeros(len(values), np.int64)
        if learn:
            own, n = np.unique(np.concatenate(learn), return_counts=True)
            counts[np.searchsorted(values, own)] = n
        cuts = _cut(values, bits)
        full = np.flatnonzero(np.diff(cuts))
        sent = [values[cuts[b]:cuts[b + 1]].tobytes() for b in full]
        times = [counts[cuts[b]:cuts[b + 1]].astype("<i8").tobytes() for b in full]

        g, cuts, order, at = _grams(spelled, depth, bits, low.value.hot)
        counts = np.bincount(at, weights=np.repeat(np.array(learns, float), [len(x) for x in spelled]))[order]
        some = np.flatnonzero(np.diff(cuts))
        sent += [_pack(g[cuts[b]:cuts[b + 1]], depth) for b in some]
        times += [counts[cuts[b]:cuts[b + 1]].astype("<i4").tobytes() for b in some]
        return pa.table({"bucket": pa.array(np.concatenate([full, some + (1 << bits)]), pa.int64()),
                         "blk": pa.array([key[0].as_py()] * len(sent), pa.int64()),
                         "words": pa.array(sent, pa.binary()), "counts": pa.array(times, pa.binary())})

    return run


def _count(key: tuple, t: pa.Table) -> pa.Table:
    """The corpus counts of a bucket's words, to every block for its own words in its own order;
    and how many words of the bucket the training texts have."""
    words = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("words")]
    counts = [np.frombuffer(x.as_buffer(), "<i8") for x in t.column("counts")]
    values, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(values)).astype(np.int64)
    out, start = [], 0
    for w in words:
        out.append(total[at[start:start + len(w)]].astype("<i8").tobytes())
        start += len(w)
    figures = pa.array([{"known": int((total > 0).sum()), "tokens": int(total.sum())}] + [None] * (len(out) - 1),
                       FIGURES)
    return pa.table({"blk": t.column("blk"), "bucket": pa.array([key[0].as_py()] * len(out), pa.int64()),
                     "totals": pa.array(out, pa.binary()), "figures": figures})


def _answer(bits: int, depth: int, low, least: float, divergence: float):
    """``_count`` for buckets of words; for buckets of grams their log10 probabilities, to every block
    for its own grams in its own order."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() < 1 << bits:
            return _count(key, t)
        own = [_unpack(x.as_buffer(), depth) for x in t.column("words")]
        values = np.sort(pa.array(np.concatenate(own)).unique().to_numpy())
        n = np.zeros(len(values), np.int64)
        for g, c in zip(own, t.column("counts")):
            n[np.searchsorted(values, g)] += np.frombuffer(c.as_buffer(), "<i4")
        p = log10_grams(values, n, low.value, depth, least, divergence).astype("<f4")
        return pa.table({"blk": t.column("blk"), "bucket": t.column("bucket"),
                         "totals": pa.array([p[np.searchsorted(values, g)].tobytes() for g in own], pa.binary()),
                         "figures": pa.array([None] * len(own), FIGURES)})

    return run


SCHEMA = ("id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
          "score double")


def score(docs: DataFrame, held_out_fold: int = 1, id_col: str = "doc_id", text_col: str = "text",
          depth: int = DEPTH, spell_weight: float = SPELL_WEIGHT, min_count: int = MIN_COUNT,
          divergence: float = DIVERGENCE) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known (tokens that training has),
    train_tokens, base_score (smoothed unigram words) and score (the model's log10 probability)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learn = F.coalesce(fold("id") != held_out_fold, F.lit(False))
    n_blocks = block_count(base, "text")
    bits = max(1, (n_blocks - 1).bit_length())
    counted = keep(grams(base.where(learn), min(LOW + 1, depth)), "endings")
    low = spark.sparkContext.broadcast(learn_low(counted, depth, min_count, divergence))  # bounded, see the module
    n_ends = base.where(learn).count()

    texts_ = blocked(base.withColumn(HASH, F.xxhash64("id", "text")).withColumn("learn", learn), n_blocks)
    totals = (texts_.groupBy("blk").applyInArrow(_send(bits, depth, low), "bucket bigint, blk bigint, words binary, counts binary")
              .groupBy("bucket").applyInArrow(_answer(bits, depth, low, min_count, divergence), "blk bigint, bucket bigint, totals binary, figures struct<known:bigint,tokens:bigint>"))
    totals = keep(totals, "words")
    seen = totals.agg(F.sum("figures.known"), F.sum("figures.tokens")).first()
    # the end is a word of its own: its count is the number of training texts
    n_all = int(seen[1] or 0) + n_ends
    weight = spell_weight if n_all else 1.0
    floor = np.log10(n_all + 0.5 * (int(seen[0] or 0) + (n_ends > 0) + 1))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        data, words, spelled = _words(left.column("blob"))
        values = np.unique(np.concatenate(words))
        bucket = right.column("bucket").to_numpy()
        order = np.argsort(bucket)
        n_words = int((bucket < 1 << bits).sum())
        c = [np.frombuffer(right.column("totals")[int(i)].as_buffer(), "<i8") for i in order[:n_words]]
        c = np.concatenate(c) if c else np.zeros(0, np.int64)
        answers = [np.frombuffer(right.column("totals")[int(i)].as_buffer(), "<f4") for i in order[n_words:]]
        _, _, found, at_gram = _grams(spelled, depth, bits, low.value.hot)
        by_gram = np.empty(len(found))
        by_gram[found] = np.concatenate(answers)
        gain = np.log10(c + 0.5) - floor
        end = np.log10(n_ends + 0.5) - floor
        n = np.array([len(w) for w in words], np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.searchsorted(values, np.concatenate(words))
        known = np.bincount(doc, weights=c[at] > 0, minlength=len(n)).astype(np.int64) + int(n_ends > 0)
        base_score = np.bincount(doc, weights=gain[at], minlength=len(n)) + end
        # tokens: the words of a text, then its end
        ends = np.cumsum(n + 1) - 1
        share = np.full(len(doc) + len(n), n_ends / max(n_all, 1))
        share[np.delete(np.arange(len(share)), ends)] = c[at] / max(n_all, 1)
        by_token = log10_tokens(by_gram[at_gram], spelled, share, weight)
        return pa.table({
            "id": data.column("id"), "held_out": pa.array([not x for x in data.column("learn").to_pylist()]),
            "n_tokens": pa.array(n + 1), "n_known": pa.array(known), "train_tokens": pa.array([n_all] * len(n), pa.int64()),
            "base_score": pa.array(base_score), "score": pa.array(np.add.reduceat(by_token, ends - n))})

    return texts_.groupBy("blk").cogroup(totals.groupBy("blk")).applyInArrow(run, SCHEMA)
