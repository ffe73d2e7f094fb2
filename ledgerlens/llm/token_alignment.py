"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide link counts.

A document's text is encoded by both tokenizers. Byte offsets at which tokens of both end
cut them into groups; a link is an A token and a B token whose byte ranges overlap, which
is just what lies between two neighbouring ends of either side. How often a pair of ids is
linked is counted over the whole table and brought back to every document.

Most groups are one A token and one B token of the same bytes. ``identity`` names, for each
A id, the B id of its bytes; groups it explains are counted in one vector of the
vocabulary's length a task, and their totals go back to the tasks as such a vector. All
other links are pair keys, counted by key with partial sums in the tasks. The most frequent
pairs, ``hot`` of them at most and the same number whatever the size of the corpus, go to
the tasks as two arrays; so what is left for the join by pair key, and for the sum by
document after it, are rare pairs, none of which is hot. Documents are encoded once: what
the later passes need is written to the shared folder.

Defined cases: null and empty texts, and texts that either side's tokens do not give back
byte by byte, have no tokens: zeros and an empty digest. Special tokens' strings are plain
text. Repeated rows count as often as they occur and get equal results; an empty table
gives an empty table. Where two B ids have the same bytes (a byte and a character), the one
that is not a byte token is the identity; the other is counted as any pair. Input columns
with the names of added ones are replaced, the text is left out, all others stay.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import BLANK, without
from ledgerlens.llm.token_counts import load
from ledgerlens.session import scratch_path

HOT = 1 << 19                # pairs that go to the tasks as arrays: 8 MB
TOGETHER = 2_000_000         # characters whose distinct words are encoded together
AT_ONCE = 2_000              # words that the libraries hold at a time
FACTS = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")
ADDED = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def byte_of_character() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(others)}}


def bytes_a(vocabulary: bytes) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary."""
    names, back = load(vocabulary).get_vocab(), byte_of_character()
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
    return out


def bytes_b(model: bytes) -> tuple[list[bytes], list[bool]]:
    """Bytes of every id of a piece vocabulary, and whether it is a byte token."""
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    out, single = [], []
    for i in range(pieces.get_piece_size()):
        name = pieces.id_to_piece(i)
        single.append(pieces.is_byte(i))
        if single[-1]:
            out.append(bytes([int(name[3:5], 16)]))
        elif pieces.is_control(i) or pieces.is_unknown(i):
            out.append(b"")
        else:
            out.append(name.replace("▁", " ").encode())
    return out, single


class Pair:
    """Two vocabularies: their token bytes and the identity map between them."""

    def __init__(self, vocabulary: bytes, model: bytes):
        self.vocabulary, self.model = vocabulary, model
        self.a, (self.b, single) = bytes_a(vocabulary), bytes_b(model)
        named = {x: i for i, x in enumerate(self.b) if x and single[i]}
        named.update({x: i for i, x in enumerate(self.b) if x and not single[i]})
        # no piece goes on with a blank after something else, so words can be encoded apart
        self.by_word = not any(b" " in x.lstrip(b" ") for x in self.b)
        self.identity = np.array([named.get(x, -1) for x in self.a], np.int64)

    @property
    def width(self) -> int:
        return len(self.b)

    def identity_keys(self) -> np.ndarray:
        """Pair key of each A id that has an identity, -1 for the others."""
        keys = np.arange(len(self.identity)) * self.width + self.identity
        return np.where(self.identity >= 0, keys, -1)


def digit_rows(size: int) -> np.ndarray:
    """Decimal digits of 0 .. size - 1 as bytes, filled up with zero bytes at the end."""
    text = np.arange(size).astype("S")
    return text.view(np.uint8).reshape(size, text.dtype.itemsize)


def gather(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values`` of the ranges that begin at ``starts``, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(sizes))])


class Aligner:
    """The work of a task: encode, cut into groups, find links, for some texts together.

    Neither side has tokens across the place between a visible character and the blank
    after it, so a text is encoded word by word, and each distinct word of the texts at
    hand once. Texts in which a word is empty or ends with white space (which tokens may
    join to a following blank) are one word as a whole.
    """

    def __init__(self, pair: Pair):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # one core a task
        self.pair, self.left = pair, load(pair.vocabulary)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_proto=pair.model)
        self.size_a = np.array([len(x) for x in pair.a])
        self.size_b = np.array([len(x) for x in pair.b])
        self.digits = digit_rows(max(len(pair.a), len(pair.b)))

    def encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both sides in a row, and how many each word has of them, a few words at a time.

        Words whose bytes are not given back have none, and a false flag.
        """
        ids: tuple[list, list] = [], []
        sizes: tuple[list, list] = [], []
        fine = np.ones(len(words), bool)
        of_a, of_b = self.pair.a.__getitem__, self.pair.b.__getitem__
        for at in range(0, len(words), AT_ONCE):
            part = words[at:at + AT_ONCE]
            spaced = [" " + t for t in part]
            left = [x.ids for x in self.left.encode_batch_fast(spaced, add_special_tokens=False)]
            right = self.right.encode(part, num_threads=1)
            for i, word in enumerate(spaced):
                raw = word.encode()
                if b"".join(map(of_a, left[i])) != raw or b"".join(map(of_b, right[i])) != raw:
                    left[i], right[i], fine[at + i] = [], [], False
            for side, found in enumerate((left, right)):
                ids[side].append(np.fromiter((i for x in found for i in x), np.int64))
                sizes[side].append(np.fromiter(map(len, found), np.int64, len(found)))
        none = [np.zeros(0, np.int64)]
        return ([np.concatenate(x or none) for x in ids],
                [np.concatenate(x or none) for x in sizes], fine)

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, the word numbers of all texts in a row, and how many each has."""
        number: dict[str, int] = {}
        at, sizes = [], []
        for text in texts:
            cut = text.split(" ") if self.pair.by_word else [text]
            if "" in cut or any(w[-1] in BLANK for w in cut):
                cut = [text] if text else []
            at.extend([number.setdefault(w, len(number)) for w in cut])
            sizes.append(len(cut))
        return list(number), np.array(at, np.int64), np.array(sizes, np.int64)

    def align(self, texts: list[str]) -> list[pa.Array]:
        """Columns of FACTS, then identity links (A ids) and other links (pair keys)."""
        words, at, sizes = self.words(texts)
        (a, b), (n_a, n_b), fine = self.encode(words)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        mark = np.zeros((end_a[-1] if len(end_a) else 0) + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        places = np.flatnonzero(mark)           # one link ends at each of these
        ends = mark[places]
        is_a, is_b, both = ends & 1, ends >> 1, ends == 3
        token_a = np.cumsum(is_a, dtype=np.int64) - is_a
        token_b = np.cumsum(is_b, dtype=np.int64) - is_b
        group = np.cumsum(both) - both
        link_a, link_b = a[token_a], b[token_b]
        alone = both & np.append(True, both[:-1])[:len(both)]
        regular = alone & (self.pair.identity[link_a] == link_b)
        keys = link_a * self.pair.width + link_b
        # a word ends where both sides end
        stops = np.append(0, np.searchsorted(places, np.append(0, end_a)[np.cumsum(n_a)], "right"))

        def per_word(flags: np.ndarray) -> np.ndarray:
            return np.append(0, np.cumsum(flags))[stops]

        shown = self.group_texts(a, b, group[is_a == 1], group[is_b == 1], both[is_a == 1],
                                 both[is_b == 1], n_a + n_b)
        # texts with a word that does not come back have no tokens
        bad = segment_sums(~fine[at], sizes) > 0
        at, sizes = at[np.repeat(~bad, sizes)], np.where(bad, 0, sizes)
        first = np.append(0, np.cumsum(sizes))

        def of_texts(flags: np.ndarray) -> pa.Array:
            return pa.array(segment_sums(np.diff(per_word(flags))[at], sizes))

        def lists(values: np.ndarray, flags: np.ndarray, kind: pa.DataType) -> pa.Array:
            starts, length = per_word(flags)[:-1], np.diff(per_word(flags))
            offsets = np.append(0, np.cumsum(segment_sums(length[at], sizes)))
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(
                gather(starts[at], length[at], values[flags]), kind))

        digests = [hashlib.sha256(b";".join([shown[w] for w in at[i:j].tolist()])).hexdigest()
                   if j > i else "" for i, j in zip(first, first[1:])]
        return [pa.array(segment_sums(n_a[at], sizes)), pa.array(segment_sums(n_b[at], sizes)),
                of_texts(both), of_texts(np.ones(len(both), bool)), pa.array(digests, pa.string()),
                lists(link_a, regular, pa.int32()), lists(keys, ~regular, pa.int64())]

    def group_texts(self, a, b, group_a, group_b, last_a, last_b, sizes) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every word: ids in decimal, group by group."""
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        width = self.digits.shape[1]
        cells = np.zeros((len(a) + len(b), width + 1), np.uint8)
        cells[place_a, :width], cells[place_b, :width] = self.digits[a], self.digits[b]
        cells[place_a, width] = np.where(last_a, ord("|"), ord(","))
        cells[place_b, width] = np.where(last_b, ord(";"), ord(","))
        text = cells[cells != 0].tobytes()
        length = np.append(0, np.cumsum((cells != 0).sum(axis=1)))
        stops = length[np.append(0, np.cumsum(sizes))]
        return [text[i:j - 1] if j > i else b"" for i, j in zip(stops.tolist(), stops[1:].tolist())]


def aligned(df: DataFrame, text: str, pair: Pair) -> DataFrame:
    """``row`` (all other columns) with FACTS, ``regular`` and ``irregular`` links."""
    rest = [c for c in without(df, ADDED).columns if c != text]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.monotonically_increasing_id()
                                .alias("__row")).alias("row"), F.col(f"`{text}`").alias("text"))
    added = T.StructType.fromDDL(f"{FACTS}, regular array<int>, irregular array<long>")
    schema = T.StructType([packed.schema["row"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Aligner(pair)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            room = np.cumsum([len(t) for t in texts]) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(room)) + 1), len(texts)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), *work.align(texts[i:j])],
                        names=schema.names)

    return packed.mapInArrow(run, schema)


def count_regular(links: DataFrame, size: int) -> np.ndarray:
    """Identity links of every A id: a vector in each task, summed by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["a", "n"])

    found = links.select("regular").mapInArrow(run, "a long, n long").groupBy("a").agg(
        F.sum("n").alias("n")).collect()     # a row for an id of the vocabulary at most
    out = np.zeros(size, np.int64)
    for r in found:
        out[r["a"]] = r["n"]
    return out


def pair_totals(links: DataFrame, pair: Pair, regular: np.ndarray) -> DataFrame:
    """(key, total) of every linked pair, written out."""
    spark, keys = links.sparkSession, pair.identity_keys()
    ids = np.flatnonzero(regular)
    counted = spark.createDataFrame(list(zip(keys[ids].tolist(), regular[ids].tolist())),
                                    "key long, n long")
    path = scratch_path(spark, "link-totals")
    (links.select(F.explode("irregular").alias("key"), F.lit(1).cast("long").alias("n"))
     .unionByName(counted).groupBy("key").agg(F.sum("n").alias("total")).write.parquet(path))
    return spark.read.parquet(path)


def frequent_from(totals: DataFrame, hot: int) -> int:
    """Smallest power of two that at most ``hot`` pairs reach."""
    sizes = totals.groupBy(F.floor(F.log2("total")).alias("e")).count().collect()
    reached, least = 0, 63
    for e, n in sorted(((r["e"], r["count"]) for r in sizes), reverse=True):
        reached += n
        if reached > hot:
            break
        least = e
    return 1 << least if least < 63 else (1 << 63) - 1


def vector(rows: DataFrame, size: int) -> np.ndarray:
    """Numbers by id from (id, n) rows, one for an id of a vocabulary at most."""
    out = np.zeros(size, np.int64)
    for i, n in rows.collect():
        out[i] = n
    return out


def count_in_tasks(links: DataFrame, totals_a: np.ndarray, best: np.ndarray, identity: np.ndarray,
                   keys: np.ndarray, totals: np.ndarray) -> DataFrame:
    """Sums over the links whose totals the tasks have, and the keys of the ``rare`` others."""
    kept = [f for f in links.schema.fields if f.name not in ("regular", "irregular")]
    schema = T.StructType([*kept, *T.StructType.fromDDL(
        "n_best long, count_sum long, rare array<long>").fields])
    width = len(best)
    best_a = (identity >= 0) & (totals_a == best[identity])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regular, irregular = batch.column("regular"), batch.column("irregular")

            def sums(column: pa.ListArray, values: np.ndarray) -> np.ndarray:
                stops = column.offsets.to_numpy() - column.offsets[0].as_py()
                return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[stops])

            a, key = regular.flatten().to_numpy(), irregular.flatten().to_numpy()
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            total = np.where(known, totals[place], 0) if len(keys) else np.zeros(len(key), np.int64)
            counted = sums(regular, totals_a[a]) + sums(irregular, total)
            top = sums(regular, best_a[a]) + sums(irregular, known & (total == best[key % width]))
            rare = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(sums(irregular, ~known))), pa.int32()),
                pa.array(key[~known]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(top), pa.array(counted), rare],
                names=schema.names)

    return links.mapInArrow(run, schema)


def stored(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def align_tokens(df: DataFrame, vocabulary: bytes, model: bytes, text: str = "text",
                 hot: int = HOT) -> DataFrame:
    """``df`` without its text, with the counts of ADDED.

    ``vocabulary``, ``model``: the contents of A's and B's files, so executors need no file.
    """
    spark, pair = df.sparkSession, Pair(vocabulary, model)
    rest = [c for c in without(df, ADDED).columns if c != text]
    links = stored(aligned(df, text, pair), spark, "links")
    regular = count_regular(links, len(pair.a))
    totals = pair_totals(links, pair, regular)

    # vectors of the vocabularies' length: totals of identity pairs, best total of a B id
    same = pair.identity_keys()
    names = spark.createDataFrame([(int(k), i) for i, k in enumerate(same) if k >= 0],
                                  "key long, a long")
    totals_a = vector(totals.join(F.broadcast(names), "key").select("a", "total"), len(pair.a))
    by_b = totals.groupBy((F.col("key") % pair.width).alias("b")).agg(F.max("total").alias("best"))
    best = vector(by_b, pair.width)
    least = frequent_from(totals, hot)
    often = totals.where(F.col("total") >= least).toPandas().sort_values("key")

    partial = stored(count_in_tasks(links, totals_a, best, pair.identity, often["key"].to_numpy(
        np.int64), often["total"].to_numpy(np.int64)), spark, "link-sums")
    tops = spark.createDataFrame(list(enumerate(best.tolist())), "b long, best long")
    seldom = (totals.where(F.col("total") < least).withColumn("b", F.col("key") % pair.width)
              .join(F.broadcast(tops), "b")
              .select("key", "total", (F.col("total") == F.col("best")).cast("long").alias("top")))
    rows = partial.select(F.col("row.__row").alias("at"), F.explode("rare").alias("key"))
    more = rows.join(seldom, "key").groupBy("at").agg(
        F.sum("top").alias("more_best"), F.sum("total").alias("more_sum"))
    zero = F.lit(0).cast("long")
    return partial.join(more, F.col("row.__row") == F.col("at"), "left").select(
        *[F.col("row")[c].alias(c) for c in rest], "n_a", "n_b", "n_groups", "n_links",
        "groups_sha256", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"))
