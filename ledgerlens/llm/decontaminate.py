"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of documents of one task, turned into symbols: words that occur in a
benchmark window keep their number, all others become a separator, and stretches of known
words too short for the shortest window are left out, as no window can lie in them. Each
shard gets a suffix order, its Burrows-Wheeler column, a wavelet matrix for ranks and
sampled suffix positions. Test windows are searched backwards, their occurrences located
from the samples, and the covered words merged into removal spans.

Words are runs of ASCII letters, digits and characters from U+0080, A-Z lower-cased. A
window is 10 consecutive words of an item; an item of fewer words, but not none, is one
window. Null and empty texts have no words and no hits. Repeated documents are searched
each for itself, repeated items count by their distinct ids, items without an id are
searched but not named, and an empty benchmark hits nothing. Input columns named like an
added one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlens.llm.common import lower_ascii, slices, without, words_of

WINDOW = 10
SHARD_WORDS = 400_000           # symbols of a shard, or those of one longer document
SHARD_BYTES = 24_000_000        # and text held for it
SAMPLE_EVERY = 16               # distance of sampled suffix positions
BLOCK_BYTES = 4_000_000         # benchmark text that is sent to the tasks together
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = "array<struct<start:int,end:int,item:string>>"


class FMIndex:
    """Full-text index of integers; 0 separates, so no match crosses it."""

    def __init__(self, symbols: np.ndarray, size: int, every: int = SAMPLE_EVERY):
        """``symbols`` ends with 0; ``size``: one more than the largest symbol."""
        self.n, self.bits = len(symbols), max(1, int(size - 1).bit_length())
        order = suffix_order(symbols, self.bits)
        self.before = symbols[order - 1]            # the Burrows-Wheeler column
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size))))
        # a walk back stops at a sampled position; a start of a stretch always is one
        sampled = np.zeros(self.n, bool)
        sampled[::every] = True
        sampled[1:] |= symbols[:-1] == 0
        self.marked = sampled[order]
        self.mark_rank = np.cumsum(self.marked) - 1
        self.places = order[self.marked]
        self.levels = []
        column = self.before
        for level in range(self.bits - 1, -1, -1):
            bit = (column >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, self.n - int(ones[-1])))
            column = np.concatenate((column[bit == 0], column[bit == 1]))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``row`` rows of the column."""
        start = np.zeros_like(row)
        for level, ones, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            row = np.where(one, zeros + ones[row], row - ones[row])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return row - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (one a line)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, j]
            low[alive] = self.first[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        high[low >= high] = low[low >= high]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one, counting steps."""
        found, open_, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(open_):
            done = self.marked[at]
            found[open_[done]] = self.places[self.mark_rank[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            symbol = self.before[at]
            at = self.first[symbol] + self.rank(symbol, at)
            steps += 1
        return found


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Positions in order of their suffixes; ties up to a separator go by position."""
    n, packed = len(symbols), max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    for step in range(packed):
        shifted = np.zeros(n, np.int64)
        if step < n:
            shifted[:n - step] = symbols[step:]
        ended |= shifted == 0
        key = (key << bits) | np.where(ended, 0, shifted)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    by_key = key[order]
    fresh = np.concatenate(([True], by_key[1:] != by_key[:-1])) | ended[order]
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = group
    alone = fresh & np.concatenate((fresh[1:], [True]))
    open_, depth = order[~alone], packed
    while len(open_):
        second = rank[open_ + depth]
        by = np.lexsort((second, rank[open_]))
        open_, second = open_[by], second[by]
        old = rank[open_]
        index = np.arange(len(open_))
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        new = new_old | np.concatenate(([True], second[1:] != second[:-1]))
        base = np.maximum.accumulate(np.where(new_old, index, 0))
        head = np.maximum.accumulate(np.where(new, index, 0))
        rank[open_] = old + head - base
        alone = new & np.concatenate((new[1:], [True]))
        open_ = open_[~alone]
        depth *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Windows:
    """Distinct windows of some items, by length, over the vocabulary of these windows."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        found: dict[tuple[bytes, ...], set[str | None]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                found.setdefault(tuple(words[i:i + size]), set()).add(item)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for g in found for w in g}))}
        self.shortest = min(map(len, found), default=0)
        self.by_length: list[tuple[np.ndarray, list[list[str | None]]]] = []
        for size in sorted({len(g) for g in found}):
            grams = [g for g in found if len(g) == size]
            self.by_length.append((
                np.array([[self.vocabulary[w] for w in g] for g in grams], np.int64),
                [sorted(found[g], key=lambda x: (x is None, x)) for g in grams]))


class Shard:
    """Known stretches of a run of documents, and what is found in them."""

    def __init__(self, windows: Windows):
        self.windows, self.parts, self.n, self.documents = windows, [], 0, 0
        self.starts, self.where, self.words_at = [], [], []

    def add(self, words: list[list[bytes]]) -> None:
        """Adds documents, each a list of words."""
        get, sizes = self.windows.vocabulary.get, [len(w) for w in words]
        symbols = np.zeros(sum(sizes) + len(words) + 1, np.int64)
        offsets = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1))) + 1
        for at, size, row in zip(offsets, sizes, words):
            symbols[at:at + size] = np.fromiter(map(get, row, repeat(0)), np.int64, size)
        known = (symbols > 0).astype(np.int8)
        edge = np.diff(np.concatenate((known, [0])))
        begin, end = np.nonzero(edge == 1)[0] + 1, np.nonzero(edge == -1)[0] + 1
        long = end - begin >= max(1, self.windows.shortest)
        begin, end = begin[long], end[long]
        if len(begin):
            size = end - begin + 1                       # with the separator behind
            places = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            places += np.arange(size.sum())
            block = symbols[np.minimum(places, len(symbols) - 1)]
            last = np.cumsum(size) - 1
            block[last] = 0
            document = np.searchsorted(offsets, begin, "right") - 1
            self.starts.append(self.n + np.concatenate(([0], last[:-1] + 1)))
            self.where.append(document + self.documents)
            self.words_at.append(begin - offsets[document])
            self.parts.append(block)
            self.n += len(block)
        self.documents += len(words)

    def hits(self) -> list[list[tuple]]:
        """For every document (first word, end, item) of each occurrence of a window."""
        out: list[list[tuple]] = [[] for _ in range(self.documents)]
        if not self.n:
            return out
        index = FMIndex(np.concatenate(self.parts), len(self.windows.vocabulary) + 1)
        starts, where, words_at = map(np.concatenate, (self.starts, self.where, self.words_at))
        for patterns, items in self.windows.by_length:
            low, high = index.search(patterns)
            count = high - low
            which = np.repeat(np.arange(len(patterns)), count)
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            places = index.locate(rows + np.arange(len(rows)))
            run = np.searchsorted(starts, places, "right") - 1
            word = words_at[run] + places - starts[run]
            for d, w, p in zip(where[run].tolist(), word.tolist(), which.tolist()):
                out[d].extend((w, w + patterns.shape[1], item) for item in items[p])
        return out


def compact(hits: list[tuple]) -> list[tuple]:
    """Per item, overlapping and touching places as one, so the list stays short."""
    out: list[tuple] = []
    for start, end, item in sorted(hits, key=lambda h: (h[2] is None, h[2], h[0])):
        if out and out[-1][2] == item and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), item)
        else:
            out.append((start, end, item))
    return out


def search_block(df: DataFrame, text: str, items: list[tuple[str | None, str]],
                 out: str, window: int) -> DataFrame:
    """``df`` with the column ``out``: the places of the windows of ``items``."""
    field = T.StructType.fromDDL(f"`{out}` {HITS}")
    schema = T.StructType(df.schema.fields + field.fields)
    kind = to_arrow_schema(field)[0].type
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(items, window)

        def finish(shard: Shard, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits, row = shard.hits(), 0
            for part in held:
                mine = [[{"start": s, "end": e, "item": i} for s, e, i in compact(h)]
                        for h in hits[row:row + part.num_rows]]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mine, kind)],
                                                 names=schema.names)

        shard, held, size = Shard(windows), [], 0
        for part in slices(batches, 64):
            texts = [x or "" for x in part.column(at).to_pylist()]
            shard.add([words_of(t) for t in texts])
            held.append(part)
            size += sum(map(len, texts))
            if shard.n >= SHARD_WORDS or size >= SHARD_BYTES:
                yield from finish(shard, held)
                shard, held, size = Shard(windows), [], 0
        if held:
            yield from finish(shard, held)

    return df.mapInArrow(run, schema)


def benchmark_blocks(benchmark: DataFrame, item: str, text: str,
                     block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of about ``block_bytes``; each is read, used and let go."""
    items = benchmark.select(F.col(item).cast("string").alias("item"),
                             F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        mine = items if blocks == 1 else items.where(
            F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [(r["item"], r["text"]) for r in mine.collect()]


def find_benchmark(df: DataFrame, benchmark: DataFrame, text: str = "text",
                   item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with n_words, n_hit, items (sorted as strings) and merged word ``spans``.

    The benchmark goes to the tasks in blocks of bounded size, one pass over the rows in
    flight for each; nothing is shuffled.
    """
    added = ("n_words long, n_hit long, items array<string>, "
             "spans array<struct<start:long,end:long>>")
    out = without(df, T.StructType.fromDDL(added).names)
    hits = []
    for k, block in enumerate(benchmark_blocks(benchmark, item, item_text, block_bytes)):
        hits.append(f"__hits_{k}")
        out = search_block(without(out, hits[-1:]), text, block, hits[-1], window)
    return summarise(out, text, hits, added)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def summarise(df: DataFrame, text: str, hits: list[str], added: str) -> DataFrame:
    fields = T.StructType.fromDDL(added)
    kept = [c for c in df.columns if c not in hits]
    schema = T.StructType([df.schema[c] for c in kept] + fields.fields)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lists = [part.column(h).to_pylist() for h in hits]
            rows = []
            for i, t in enumerate(part.column(text).to_pylist()):
                found = [h for column in lists for h in column[i]]
                spans = merged([(h["start"], h["end"]) for h in found])
                rows.append((len(words_of(t or "")), sum(e - s for s, e in spans),
                             sorted({h["item"] for h in found if h["item"] is not None}),
                             [{"start": s, "end": e} for s, e in spans]))
            columns = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in kept]
                + [pa.array(c, f.type) for c, f in zip(columns, arrow)], names=schema.names)

    return df.mapInArrow(run, schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    out, at, words = [], 0, [m.span() for m in WORD.finditer(lower_ascii(text))]
    for start, end in spans:
        out.append(text[at:words[start][0]])
        at = words[end - 1][1]
    return "".join([*out, text[at:]])


def remove_benchmark(df: DataFrame, benchmark: DataFrame, text: str = "text",
                     **options) -> DataFrame:
    """``df`` without benchmark passages: their spans are cut out of the text.

    Documents that are nothing but such passages go; clean ones stay as they are. The
    columns of ``df`` return, null text included.
    """
    names = df.columns
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    column = f"c{names.index(text)}"
    found = find_benchmark(inner, benchmark, column, **options)
    found = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    fields = found.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(column).to_pylist()
            spans = part.column("spans").to_pylist()
            new = [cut_words(t, [(x["start"], x["end"]) for x in s]) if s else t
                   for t, s in zip(texts, spans)]
            arrays = [pa.array(new, pa.string()) if f.name == column else part.column(f.name)
                      for f in fields[:len(names)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields[:len(names)]])

    cut = found.mapInArrow(run, T.StructType(fields[:len(names)]))
    return cut.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
