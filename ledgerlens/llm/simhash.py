"""SimHash near-duplicates, found through tables of distances to reference fingerprints.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the hashes of the
4-word shingles. Fingerprints link if they differ in at most 4 bits.

References are of two kinds. For each block of bits there are the fingerprints with one
bit of that block and the empty one: distances to them, taken within the block, tell the
block's bits, so this part of the table serves as an equality key. Two fingerprints within
d bits leave at least ``blocks - d`` blocks untouched, and therefore share the key of some
choice of that many blocks: no pair is lost. Within a key, 16 spread references give every
fingerprint its coordinates; a pair whose coordinates differ by more than d anywhere cannot
be within d (triangle inequality) and is discarded; survivors are verified bit by bit.

More blocks make more selective keys and more rows: 6 blocks give 15 keys of about 21
bits, 8 blocks 70 keys of 32 bits. Results are the same for every choice.

Only distinct fingerprints take part, so exact copies cost nothing. A key with many
fingerprints is cut into cells of bounded size, and every pair of cells is looked at, so
no task gets an unbounded group and no pair is left out. A group of n linked fingerprints
leaves a task as n - 1 links of a star, not as all its pairs.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share
their fingerprint. Rows without an id take the component of their fingerprint and never
name one (the component is null if no row of it has an id). An empty table gives an empty
table. Input columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER_BYTES, annotate, slices
from ledgerlens.llm.components import components
from ledgerlens.session import cut_lineage

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BLOCKS = 6
CELL = 2048                     # fingerprints of a key that one cell holds
REFERENCES = np.random.default_rng(8).integers(0, 2**64, 16, dtype=np.uint64)


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])]
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        octets = np.array(hashes[at:at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def add_fingerprints(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    return annotate(df, text, f"`{out}` long",
                    lambda: lambda texts: [(fingerprint(t),) for t in texts])


def key_columns(max_bits: int, blocks: int) -> list:
    """Key expressions: number of the choice of blocks, and the bits of these blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = 0
        for b in chosen:
            mask |= ((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("t"),
                             F.col("fp").bitwiseAND(F.lit(signed)).alias("k")))
    return keys


def coordinates(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to the spread references."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int16)


def stars(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one group: for each linked set a star.

    Memory is one row of coordinates a fingerprint; time is a row of comparisons a
    fingerprint, most of which end at the first coordinate.
    """
    table, rest, links = coordinates(fps), np.arange(len(fps)), []
    while len(rest) > 1:
        centre, rest = rest[0], rest[1:]
        queue = [centre]
        while queue and len(rest):
            one = queue.pop()
            near = rest[np.abs(table[rest, 0] - table[one, 0]) <= max_bits]
            if len(near):
                near = near[np.abs(table[near] - table[one]).max(axis=1) <= max_bits]
                near = near[np.bitwise_count(fps[near] ^ fps[one]) <= max_bits]
            if len(near):
                links += [(int(fps[centre]), int(fps[x])) for x in near]
                queue += near.tolist()
                rest = np.setdiff1d(rest, near, assume_unique=True)
    return links


def pair_links(distinct: DataFrame, max_bits: int, blocks: int, cell: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that join all linked ones."""
    keyed = distinct.select("fp", F.explode(F.array(*key_columns(max_bits, blocks))).alias("x"))
    keyed = keyed.select("fp", "x.t", "x.k")
    # keys with more fingerprints than a cell holds; at most rows / cell of them
    large = (keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > cell)
             .withColumn("cells", F.ceil(F.col("n") / cell).cast("int")).drop("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    split = (keyed.join(large, ["t", "k"], "left")
             .withColumn("own", F.when(F.col("cells").isNull(), 0).otherwise(own))
             .withColumn("other", F.explode(F.when(F.col("cells").isNull(), F.array(F.lit(0)))
                                            .otherwise(F.sequence(F.lit(0), F.col("cells") - 1))))
             .select("t", "k", F.least("own", "other").alias("i"),
                     F.greatest("own", "other").alias("j"), "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[np.ndarray]:
            held: list[np.ndarray] = []
            last = None
            for part in slices(batches, 1 << 14):
                if not part.num_rows:
                    continue
                ids = [part.column(c).to_numpy() for c in range(4)]
                fps = part.column(4).to_numpy().view(np.uint64)
                fresh = np.zeros(len(fps), bool)
                for column in ids:
                    fresh[1:] |= column[1:] != column[:-1]
                first = tuple(column[0] for column in ids)
                fresh[0] = last is not None and first != last
                last = tuple(column[-1] for column in ids)
                cuts = np.nonzero(fresh)[0]
                begin = 0
                for cut in cuts:
                    if held or cut - begin > 1:
                        held.append(fps[begin:cut])
                        yield np.concatenate(held)
                        held = []
                    begin = cut
                held.append(fps[begin:])
            if held:
                yield np.concatenate(held)

        links: list[tuple[int, int]] = []
        for group in groups():
            if len(group) > 1:
                links += stars(group, max_bits)
            if len(links) > 50_000:
                yield as_batch(links)
                links = []
        yield as_batch(links)

    def as_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])],
                                          names=["a", "b"])

    dealt = split.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, id_column: str, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
            cell: int = CELL) -> DataFrame:
    """(fp, component_id) of every fingerprint of ``prints`` (columns id, fp)."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(id_column).alias("least_id")))
    joined = components(pair_links(distinct.select("fp"), max_bits, blocks, cell))
    named = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_duplicates(df: DataFrame, text: str = "text", id_column: str = "doc_id",
                    **options) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable by links, for every row."""
    prints = add_fingerprints(df.select(id_column, text), text).select(id_column, "fp")
    prints = cut_lineage(prints)
    return prints.join(classes(prints, id_column, **options), "fp").select(
        id_column, "fp", "component_id")


def keep_one(df: DataFrame, text: str = "text", id_column: str = "doc_id",
             **options) -> DataFrame:
    """``df`` with one document of each group: the one with the smallest id.

    Of several rows with that id one stays, chosen by a hash of the text. Rows without an
    id cannot be told apart from another document by it, so they all stay.
    """
    names = df.columns
    groups = cut_lineage(near_duplicates(df, text, id_column, **options))
    kept = groups.where(F.col(id_column) == F.col("component_id"))
    kept = kept.groupBy(id_column).agg(F.count("*").alias("__rows"))
    chosen = df.join(kept, id_column, "left_semi")
    repeated = kept.where("__rows > 1").select(id_column)
    if repeated.limit(1).count():
        rows = chosen.join(repeated, id_column, "left_semi")
        whole = F.struct(*[F.col(f"`{c}`") for c in names])
        one = rows.groupBy(F.col(id_column).alias("__id")).agg(
            F.min_by(whole, F.xxhash64(F.col(text))).alias("__row")).select("__row.*")
        chosen = chosen.join(repeated, id_column, "left_anti").select(
            *[F.col(f"`{c}`") for c in names]).unionByName(one)
    unnamed = df.where(F.col(id_column).isNull())
    return chosen.select(*[F.col(f"`{c}`") for c in names]).unionByName(unnamed)


