"""Byte-level BPE encoding and decoding with Spark's own array functions.

Text is cut into pieces by the vocabulary's pattern. A piece is an array of its bytes'
ids; a fold over it (``aggregate``) merges the pair of lowest rank, the leftmost of equal
ones, until none is left. Ranks come from a literal map from pairs of ids to the id of the
joined bytes, kept in hash buckets, as a map's look-up is a scan. Decoding looks each id's
bytes up in a literal array and concatenates them.

Words repeat, so the fold runs over distinct pieces: the most frequent ones of a bounded
sample of documents, ``dictionary`` of them at most. Tasks look every piece of every text
up among their ids. Pieces that are not there are merged by a small Python function, as the
interpreted fold costs too much for millions of pieces that occur once (README, figures).
What the dictionary holds decides where a piece is merged, never the result. No text is
shuffled.

Null text counts as empty: no tokens, and the digests of empty strings. Repeated rows are
encoded each for itself; an empty table gives an empty table; input columns named like an
added one are replaced. Character classes
are those of the ``regex`` module.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import give_back, slices, without

DICTIONARY = 65_536    # frequent pieces that are folded once, at most
LONG = 256             # longer pieces are never folded, as a fold takes quadratic time
SAMPLE_DOCS = 3_000    # documents that pieces are counted in for the dictionary
REMEMBERED = 32 << 20   # bytes of words and ids that a task keeps besides the dictionary
MERGED = 4096          # rare pieces that are merged together
FOLD_TASKS = 12        # tasks that fold the dictionary
PAIR_BUCKETS = 1 << 15
NONE = 2**31 - 1       # rank of a pair that does not merge
EDGE = -1              # id that stands at both ends of a piece
# White space as Unicode has it; the JVM's \s is ASCII only.
SPACE = (r"\t-\r \x85\xa0  -     　")
# Lower bits of a product with this number spread neighbouring ids.
SPREAD = 0x9E3779B1

ADDED = ("n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded binary")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def jvm_pattern(pattern: str) -> str:
    """The splitting pattern with white space spelled out."""
    out = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")
    return out.replace(r"\s", f"[{SPACE}]")


def pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Id of the joined bytes of every two tokens that join to a token."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


class Vocabulary:
    """Literals of a vocabulary, and the expressions that use them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.joins = ranks, pairs(ranks)
        joined: list[dict[int, int]] = [{} for _ in range(PAIR_BUCKETS)]
        for (a, b), rank in self.joins.items():
            joined[(a * SPREAD + b) % PAIR_BUCKETS][(a << 32) | b] = rank
        token_of = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            token_of[rank] = token.decode("latin-1")     # a character a byte
        self.joined = literal(joined, "array<map<string,int>>").cast("array<map<bigint,int>>")
        self.byte_ids = literal([ranks[bytes([b])] for b in range(256)], "array<int>")
        self.token_of = literal(token_of, "array<string>")

    def encode(self, piece: Column) -> Column:
        """Ids of a piece that is no token itself, by the fold.

        Each literal stands in the plan once, bound to a variable.
        """
        return let(self.joined, lambda joined: let(self.byte_ids, lambda byte_ids: let(
            F.hex(piece.cast("binary")), lambda code: fold(code, joined, byte_ids))))

    def decode(self, ids: Column) -> Column:
        """Bytes of ids: the binary pieces, one character a byte, put together."""
        pieces = let(self.token_of, lambda table: F.transform(ids, lambda i: table[i]))
        return F.encode(F.array_join(pieces, ""), "ISO-8859-1")


def literal(value: list, kind: str) -> Column:
    """A nested value as a constant; the optimiser turns it into one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def join_rank(joined: Column, a: Column, b: Column) -> Column:
    bucket = F.pmod(a.cast("long") * F.lit(SPREAD) + b, F.lit(PAIR_BUCKETS)).cast("int")
    found = F.when((a >= 0) & (b >= 0), joined[bucket][F.shiftleft(a.cast("long"), 32) + b])
    return F.coalesce(found, F.lit(NONE))


def fold(code: Column, joined: Column, byte_ids: Column) -> Column:
    """Ids of a piece, given as hexadecimal digits: the ranked merges as a fold over it.

    Both arrays of the state keep their length; what a merge frees at the end is filled
    with ``EDGE`` and ``NONE``. Writing every place anew is several times faster than
    cutting arrays and joining the parts.
    """
    characters = F.split(F.decode(F.unhex(code), "ISO-8859-1"), "")
    ids = F.transform(characters, lambda c: byte_ids[F.ascii(c)])

    def start(ids: Column) -> Column:
        ranks = F.transform(ids, lambda x, i: join_rank(
            joined, x, F.coalesce(F.get(ids, i + 1), F.lit(EDGE))))
        return F.struct(ids.alias("ids"), ranks.alias("ranks"))

    def merge(state: Column, at: Column) -> Column:
        ids, ranks, best, p = state["ids"], state["ranks"], at["best"], at["p"]
        return F.struct(
            F.transform(ids, lambda x, i: F.when(i < p, x).when(i == p, best).otherwise(
                F.coalesce(F.get(ids, i + 1), F.lit(EDGE)))).alias("ids"),
            F.transform(ranks, lambda x, i: F.when(i < p - 1, x)
                        .when(i == p - 1, join_rank(joined, F.get(ids, i), best))
                        .when(i == p, join_rank(joined, best, F.coalesce(
                            F.get(ids, i + 2), F.lit(EDGE))))
                        .otherwise(F.coalesce(F.get(ranks, i + 1), F.lit(NONE)))).alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        least = F.array_min(state["ranks"])
        where = F.struct(least.alias("best"), (F.array_position(
            state["ranks"], least).cast("int") - 1).alias("p"))
        return F.when(least == NONE, state).otherwise(let(where, lambda at: merge(state, at)))

    folded = F.aggregate(ids, let(ids, start), step)["ids"]
    return F.filter(folded, lambda x: x >= 0)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the same merges, with a heap over a linked list if it is long."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) <= 64:
        parts = [piece[i:i + 1] for i in range(len(piece))]
        near = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while near and (best := min(near)) != NONE:
            at = near.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at:
                near[at - 1] = ranks.get(parts[at - 1] + parts[at], NONE)
            if at < len(near):
                near[at] = ranks.get(parts[at] + parts[at + 1], NONE)
        return [ranks[x] for x in parts]
    # part i is piece[i:after[i]]; merged ones have no end
    after = [*range(1, len(piece) + 1), 0]
    before = list(range(-1, len(piece)))

    def joined(i: int) -> int:
        j = after[i]
        return ranks.get(piece[i:after[j]], NONE) if j < len(piece) else NONE

    heap = [(joined(i), i) for i in range(len(piece) - 1)]
    heap = [x for x in heap if x[0] != NONE]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if not after[i] or joined(i) != rank:
            continue
        j = after[i]
        after[i], after[j] = after[j], 0
        before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (found := joined(k)) != NONE:
                heapq.heappush(heap, (found, k))
    out, i = [], 0
    while i < len(piece):
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


def frequent(df: DataFrame, pieces: Column, limit: int, sample_docs: int) -> list[str]:
    """The most frequent pieces of a bounded sample of rows; long ones are left out."""
    rows = df.count()
    share = min(1.0, sample_docs / rows) if rows else 1.0
    drawn = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 20))
    found = (df.where(drawn < int(share * (1 << 20)) + 1).select(F.explode(pieces).alias("piece"))
             .where(F.octet_length("piece") <= LONG).groupBy("piece")
             .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "piece").limit(limit))
    return [r["piece"] for r in found.select("piece").collect()]


def folded_ids(df: DataFrame, words: list[str], vocabulary: Vocabulary) -> dict[str, bytes]:
    """Ids of distinct pieces, packed to 4 bytes each; ``words`` is a bounded list.

    A piece that is a token is that token; all others are folded.
    """
    ranks = vocabulary.ranks
    known = {w: packed([ranks[w.encode()]]) for w in words if w.encode() in ranks}
    others = [w for w in words if w not in known]
    if others:
        # dealt out, as a local table would be folded by the driver while it plans
        table = df.sparkSession.createDataFrame(pd.DataFrame({"piece": others})).repartition(
            FOLD_TASKS)
        folded = table.select("piece", vocabulary.encode(F.col("piece")).alias("ids"))
        known.update((r["piece"], packed(r["ids"])) for r in folded.collect())
    return known


def packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Merges:
    """Ranked merges of many pieces at once, each step one merge in every piece.

    Pairs that join stand in sorted arrays; parts of a piece are a linked list over its row.
    """

    def __init__(self, ranks: dict[bytes, int], joins: dict[tuple[int, int], int]):
        self.ranks = ranks
        keys = np.array([(a << 32) | b for a, b in joins], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.joined = np.array(list(joins.values()), np.int32)[order]
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NONE`` where it does not join or a side is missing."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(fits, self.joined[at], NONE)

    def rows(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of one length or shorter, of two bytes at least."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.bytes[raw.reshape(-1, width)]
        ids = np.hstack([ids, np.full((len(ids), 1), EDGE, np.int64)])     # the edge: a last part
        ids[np.arange(width + 1) >= sizes[:, None]] = EDGE
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (len(ids), 1))
        before = np.tile(np.maximum(np.arange(-1, width), 0), (len(ids), 1))
        near = np.full(ids.shape, NONE, np.int64)
        near[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(ids))
        while True:
            at = near[live].argmin(axis=1)       # the leftmost of equal ranks
            best = near[live, at]
            going = best != NONE
            live, at, best = live[going], at[going], best[going]
            if not len(live):
                break
            gone = after[live, at]
            following = after[live, gone]
            ids[live, at], ids[live, gone] = best, EDGE
            near[live, gone] = NONE
            after[live, at], before[live, following] = following, at
            near[live, at] = self.rank(best, ids[live, following])
            inner = at > 0
            rows, left = live[inner], before[live, at][inner]
            near[rows, left] = self.rank(ids[rows, left], best[inner])
        kept = ids >= 0
        flat, stops = ids[kept].astype(np.int32), np.append(0, np.cumsum(kept.sum(axis=1)))
        return [flat[i:j].tobytes() for i, j in zip(stops, stops[1:])]

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces; long ones go one by one, with a heap."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if piece in self.ranks or len(piece) > LONG:
                out[i] = packed(merge(piece, self.ranks))
            else:
                groups.setdefault(len(piece).bit_length(), []).append(i)
        for group in groups.values():
            for at in range(0, len(group), MERGED):
                part = group[at:at + MERGED]
                for i, ids in zip(part, self.rows([pieces[i] for i in part])):
                    out[i] = ids
        return out


class Assembler:
    """The work of a task: ids of texts from the dictionary, rare pieces merged here.

    Rare pieces are remembered up to ``REMEMBERED`` bytes.
    """

    def __init__(self, pattern: str, known: dict[str, bytes], merges: Merges):
        self.cut, self.merges = regex.compile(pattern), merges
        self.ids = known                # packed ids of a piece; rare pieces come and go
        self.shown = [str(i) for i in range(max(merges.ranks.values()) + 1)]
        self.rare: list[str] = []
        self.room = REMEMBERED

    def make_room(self) -> None:
        if self.room <= 0:
            for piece in self.rare:
                del self.ids[piece]
            self.rare, self.room = [], REMEMBERED

    def texts(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Packed ids of some texts, and the SHA-256 of their decimal, comma-joined form."""
        cut = list(map(self.cut.findall, texts))
        fresh = list(set().union(*cut).difference(self.ids))
        for piece, ids in zip(fresh, self.merges.many([p.encode() for p in fresh])):
            self.ids[piece] = ids
            self.room -= 300 + 4 * len(piece) + 2 * len(ids)
        self.rare += fresh
        ids, shown = self.ids.__getitem__, self.shown.__getitem__
        out = [b"".join(map(ids, pieces)) for pieces in cut]
        digests = [hashlib.sha256(",".join(map(shown, memoryview(x).cast("i"))).encode())
                   .hexdigest() for x in out]
        self.make_room()
        return out, digests


def encode_documents(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
                     dictionary: int = DICTIONARY) -> DataFrame:
    """``df`` with ids, decoded bytes, token count and digests of both."""
    vocabulary, split = Vocabulary(ranks), F.lit(jvm_pattern(pattern))
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), split, F.lit(0))
    base = without(df, T.StructType.fromDDL(ADDED).names)
    words = frequent(base.select(text), pieces, dictionary, SAMPLE_DOCS)
    coded = assemble(base, text, pattern, folded_ids(df, words, vocabulary),
                     Merges(ranks, vocabulary.joins))
    out = coded.withColumn("decoded", vocabulary.decode(F.col("ids")))
    return out.select(
        *[F.col(f"`{c}`") for c in base.columns], F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "ids", "decoded")


def assemble(df: DataFrame, text: str, pattern: str, known: dict[str, bytes],
             merges: Merges) -> DataFrame:
    """``df`` with ids and their digest, a few texts at a time."""
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(
        "ids array<int>, ids_sha256 string").fields)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Assembler(pattern, known, merges)
        for part in slices(batches):
            found, shown = work.texts([x or "" for x in part.column(at).to_pylist()])
            sizes = [len(x) // 4 for x in found]
            ids = np.frombuffer(b"".join(found), np.int32)
            column = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, column, pa.array(shown, pa.string())],
                names=schema.names)
        # the task's own copies, which would stay until the worker's next task
        known.clear()
        vars(merges).clear()
        del work
        give_back()

    return df.mapInArrow(run, schema)
