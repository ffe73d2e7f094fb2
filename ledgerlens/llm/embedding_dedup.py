"""Near-duplicate vectors by NN-descent.

Every distinct vector keeps a list of its nearest others. Lists start from random
hyperplane trees (vectors of one leaf are compared in blocks of bounded size) and are
refined by rounds of neighbours-of-neighbours joins: around every vector, those that list
it or are listed by it are compared with each other. A list that is saturated (its last
entry still links) doubles its room for the next round, up to ``ROOM``. After each round,
recall is audited against brute force, and further rounds, each with ``TREES`` fresh trees,
follow until it is reached. The audit draws vectors until ``AUDITED`` with few links are found
or all (at most ``DRAWN``) are drawn. Every audited vector weighs the same, vectors with few
and with many links are averaged apart, and the lower figure counts. If it is not reached in
``ROUNDS`` rounds, an error tells it; if no drawn vector of a larger table has a link, recall
is not known: all rounds are run and a warning says so.

Links are then taken exactly: within every set joined by list entries all vectors are
compared in double precision, cell by cell, so a group of any size gets all its links, no
matter how short its lists were, and no task gets more than two cells.

Vectors that are null, zero, or hold null or non-finite components link with nothing.
Vectors of different lengths are never compared. Exact copies are one vector with a weight:
they count as links of each other without being paired. Rows without an id take part and
count, but never name a component. An empty table gives an empty table.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import slices
from ledgerlens.llm.components import components
from ledgerlens.session import cut_lineage

THRESHOLD = 0.95
MARGIN = 1e-5          # lists compare in single precision
LIST = 10              # room of a list at the start
TREES = 4              # at the start, and more in each further round
LEAF = 256             # vectors of a leaf, about
BLOCK = 512            # vectors that are compared together, about
AROUND = 64            # neighbours around a vector that are compared together, about
OFFERED = 6            # new entries that one comparison offers to a vector at most
ROOM = 160             # of a list at most; lists only have to connect
ROUNDS = 16            # at most
AUDITED = 256          # vectors with few links that recall is audited on
MANY = 32              # vectors with more links that recall is audited on, apart
DRAWN = 16384          # vectors that are drawn for the audit at most
RECALL = 0.98          # mean over audited vectors at which rounds end
CELL = 1024            # vectors of a cell in the exact comparison, about


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first ``keys`` columns; input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for part in slices(batches, 1 << 12):
        columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        fresh = np.zeros(part.num_rows, bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        fresh[0] = last is not None and last != tuple(c[0] for c in columns)
        last = tuple(c[-1] for c in columns)
        at = 0
        for cut in np.nonzero(fresh)[0]:
            held.append(part.slice(at, cut - at))
            yield pa.Table.from_batches([h for h in held if h.num_rows])
            held, at = [], int(cut)
        held.append(part.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Vectors of a binary column as rows."""
    joined = b"".join(x.as_py() for chunk in column.chunks for x in chunk)
    return np.frombuffer(joined, kind).reshape(len(column), -1)


def unit_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Distinct usable vectors: node, least_id, weight, dim, unit (doubles) and near (floats)."""
    values = F.col(vector)
    usable = (values.isNotNull() & (F.size(values) > 0)
              & ~F.exists(values, lambda x: x.isNull() | F.isnan(x.cast("double"))
                          | (F.abs(x.cast("double")) == float("inf")))
              & F.exists(values, lambda x: x != 0))
    distinct = (df.where(usable).groupBy(values.alias("embedding"))
                .agg(F.min(id_column).alias("least_id"), F.count("*").alias("weight")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 12):
            rows = [np.array(v, np.float64) for v in part.column(0).to_pylist()]
            rows = [v / np.abs(v).max() for v in rows]      # no overflow in the norm
            rows = [v / np.sqrt(v @ v) for v in rows]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([len(v) for v in rows], pa.int64()),
                 pa.array([v.tobytes() for v in rows], pa.binary()),
                 pa.array([v.astype("f4").tobytes() for v in rows], pa.binary())],
                names=[*part.schema.names, "dim", "unit", "near"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    made = distinct.mapInArrow(run, f"{kinds}, dim long, unit binary, near binary")
    return cut_lineage(made.withColumn("node", F.monotonically_increasing_id()))


def leaves(nodes: DataFrame, rows: int, trees: int, leaf: int, first: int = 0) -> DataFrame:
    """(tree, dim, leaf, node, near): the side of every hyperplane of a tree names the leaf.

    Trees are numbered from ``first``; other numbers have other hyperplanes.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, rows / leaf)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for part in slices(batches, 1 << 11):
            found = []
            for dim, node, near in zip(*(part.column(i).to_pylist() for i in range(3))):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([dim, first]).standard_normal(
                        (trees, bits, dim))
                side = planes[dim] @ np.frombuffer(near, "f4") > 0
                names = side @ (1 << np.arange(bits, dtype=np.int64)) if bits else [0] * trees
                found += [(first + t, dim, int(n), node, near) for t, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(
                    zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["tree", "dim", "leaf", "node", "near"])

    return nodes.select("dim", "node", "near").mapInArrow(
        run, "tree long, dim long, leaf long, node long, near binary")


def blocks(df: DataFrame, keys: list[str], size: int, salt: Column) -> DataFrame:
    """``df`` with a ``block`` number that cuts each group into parts of about ``size`` rows.

    Other values of ``salt`` cut anew, so that members of two parts meet in another tree or round.
    """
    counted = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("__parts"))
    counted = counted.where("__parts > 1")
    parts = F.coalesce("__parts", F.lit(1))
    return df.join(counted, keys, "left").withColumn(
        "block", F.pmod(F.xxhash64(salt, "node"), parts).cast("long")).drop("__parts")


def compare(df: DataFrame, keys: list[str], offered: int) -> DataFrame:
    """(u, v, sim): for each vector of a group its nearest others there, beyond ``least``."""
    names = [*keys, "node", "near", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for table in groups(batches, n):
            if table.num_rows < 2:
                continue
            node = table.column(n).to_numpy()
            near, least = matrix(table.column(n + 1), "f4"), table.column(n + 2).to_numpy()
            for at in range(0, len(node), BLOCK):
                sims = near[at:at + BLOCK] @ near.T
                sims[np.arange(len(sims)), at + np.arange(len(sims))] = -2
                k = min(offered, len(node) - 1)
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(sims, best, axis=1)
                row, column = np.nonzero(value > least[at:at + BLOCK, None])
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[at + row]), pa.array(node[best[row, column]]),
                         pa.array(value[row, column], pa.float32())], names=["u", "v", "sim"])

    dealt = df.select(*names).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u long, v long, sim float")


def shorten(entries: DataFrame, room: DataFrame | None) -> DataFrame:
    """The best distinct entries of each list, as many as it has room for."""
    best = entries.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = best.withColumn("place", F.row_number().over(
        Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    if room is None:
        return ranked.where(F.col("place") <= LIST).withColumn("room", F.lit(LIST))
    return ranked.join(room, "u", "left").withColumn("room", F.coalesce("room", F.lit(LIST))).where(
        "place <= room")


def refine(lists: DataFrame, nodes: DataFrame, threshold: float, turn: int) -> DataFrame:
    """One round: compares the neighbours around each vector and merges what is nearer."""
    last = lists.groupBy("u").agg(F.min("sim").alias("last"), F.count("*").alias("n"),
                                  F.max("room").alias("old"))
    full = F.col("n") >= F.col("old")
    saturated = full & (F.col("last") >= threshold)
    state = cut_lineage(last.select(
        "u", F.when(saturated, F.least(F.col("old") * 2, F.lit(ROOM))).otherwise(F.col("old")).alias("room"),
        F.when(full & ~saturated, F.col("last")).otherwise(F.lit(-2.0)).cast("float")
        .alias("least")))
    around = (lists.select(F.col("u").alias("w"), F.col("v").alias("node"))
              .unionByName(lists.select(F.col("v").alias("w"), F.col("u").alias("node")))
              .distinct())
    known = nodes.select("node", "near").join(
        state.select(F.col("u").alias("node"), "least"), "node", "left").withColumn(
        "least", F.coalesce("least", F.lit(-2.0)).cast("float"))
    met = blocks(around, ["w"], AROUND, F.lit(turn)).join(known, "node")
    offers = compare(met, ["w", "block"], OFFERED)
    entries = lists.select("u", "v", "sim").unionByName(offers)
    return cut_lineage(shorten(entries, state.select("u", "room")))


def asked_links(nodes: DataFrame, asked: list, threshold: float, count: bool) -> DataFrame:
    """Links of ``asked`` by brute force: (q, x) each, or (q, n) counts if ``count``."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in asked}:
        mine = [r for r in asked if r["dim"] == dim]
        by_dim[dim] = (np.array([r["node"] for r in mine]),
                       np.array([np.frombuffer(r["unit"]) for r in mine]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 11):
            dims = part.column(0).to_numpy()
            for dim, (queries, vectors) in by_dim.items():
                own = part.filter(pa.array(dims == dim))
                if not own.num_rows:
                    continue
                node = own.column(1).to_numpy()
                unit = matrix(pa.chunked_array([own.column(2)]), "f8")
                for at in range(0, len(queries), 1 << 10):
                    some = queries[at:at + (1 << 10)]
                    found = unit @ vectors[at:at + (1 << 10)].T >= threshold
                    found &= node[:, None] != some
                    if count:
                        n = found.sum(axis=0)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some[n > 0]), pa.array(n[n > 0])], names=["q", "x"])
                    else:
                        row, q = np.nonzero(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some[q]), pa.array(node[row])], names=["q", "x"])

    made = nodes.select("dim", "node", "unit").mapInArrow(run, "q long, x long")
    return made.groupBy("q").agg(F.sum("x").alias("n")) if count else made


def audited(nodes: DataFrame, threshold: float, drawn: int = DRAWN) -> tuple[DataFrame | None, bool]:
    """(q, x, many): all links of the audited vectors; None if no drawn vector has one.

    Vectors are drawn until ``AUDITED`` with at most ``LIST`` links are found. The second
    result tells whether every vector was drawn.
    """
    few, many, seen, take, whole = [], [], 0, 2 * AUDITED, False
    order = nodes.select("node", "dim", "unit").orderBy(F.xxhash64("node"), "node")
    while len(few) < AUDITED and seen < drawn and not whole:
        # one more than is taken tells whether anything is left
        size = min(take, drawn)
        asked = order.limit(size + 1).collect()
        whole, asked = len(asked) <= size, asked[seen:size]
        seen, take = size, take * 4
        if asked:
            n = {r["q"]: r["n"] for r in asked_links(nodes, asked, threshold, True).collect()}
            few += [r for r in asked if 0 < n.get(r["node"], 0) <= LIST]
            many += [r for r in asked if n.get(r["node"], 0) > LIST]
        many = many[:MANY]
    chosen = few[:AUDITED] + many
    if not chosen:
        return None, whole
    large = [r["node"] for r in many]
    return cut_lineage(asked_links(nodes, chosen, threshold, False).withColumn(
        "many", F.col("q").isin(large))), whole


def recall_of(links: DataFrame, lists: DataFrame, threshold: float) -> float:
    """Mean share of an audited vector's links that the sets of the lists hold.

    Vectors with few and with many links are averaged apart, and the lower mean counts.
    """
    # both ends in one set of the list links means that the exact comparison will meet them
    sets = components(linked(lists, threshold))
    a = sets.select(F.col("node").alias("q"), F.col("component").alias("cq"))
    b = sets.select(F.col("node").alias("x"), F.col("component").alias("cx"))
    held = F.coalesce(F.col("cq") == F.col("cx"), F.lit(False)).cast("int")
    own = links.join(a, "q", "left").join(b, "x", "left").groupBy("q", "many").agg(
        F.avg(held).alias("r"))
    return min(r["r"] for r in own.groupBy("many").agg(F.avg("r").alias("r")).collect())


def linked(lists: DataFrame, threshold: float) -> DataFrame:
    return lists.where(F.col("sim") >= threshold - MARGIN).select(
        F.col("u").alias("a"), F.col("v").alias("b"))


def exact_links(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, n, star): links of each vector in its set, and a centre that joins linked ones.

    Sets are cut into cells; every two cells of a set are compared, each pair in one place.
    """
    held = sets.join(nodes.select("node", "weight", "unit"), "node")
    sized = sets.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    own = F.pmod(F.xxhash64("node"), F.col("cells")).cast("long")
    dealt = (held.join(sized, "component").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(
                 F.lit(0).cast("long"), F.col("cells").cast("long") - 1)))
             .select("component", F.least("own", "other").alias("i"),
                     F.greatest("own", "other").alias("j"), "own", "node", "weight", "unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            i, j = table.column(1)[0].as_py(), table.column(2)[0].as_py()
            own, node, weight = (table.column(c).to_numpy() for c in (3, 4, 5))
            unit = matrix(table.column(6), "f8")
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            counted = near if i == j else near & (own[:, None] != own[None, :])
            star, open_ = np.full(len(node), -1), np.arange(len(node))
            while len(open_):
                centre, queue = open_[0], [open_[0]]
                star[centre] = centre
                while queue:
                    fresh = np.nonzero(near[queue.pop()] & (star < 0))[0]
                    star[fresh] = centre
                    queue += fresh.tolist()
                open_ = open_[star[open_] < 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(counted.astype(np.int64) @ weight),
                 pa.array(node[star])], names=["node", "n", "star"])

    keys = ["component", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        run, "node long, n long, star long")


def planted(nodes: DataFrame, rows: int, first: int, room: int) -> DataFrame:
    """(u, v, sim): what vectors find in the leaves of ``TREES`` fresh trees."""
    dealt = blocks(leaves(nodes, rows, TREES, LEAF, first), ["tree", "dim", "leaf"], BLOCK,
                   F.col("tree")).withColumn("least", F.lit(-2.0).cast("float"))
    return compare(dealt, ["tree", "dim", "leaf", "block"], room)


def neighbour_lists(nodes: DataFrame, threshold: float = THRESHOLD,
                    rounds: int = ROUNDS) -> tuple[DataFrame, float | None]:
    """Lists (u, v, sim, place, room) after as many rounds as recall asks for, and recall.

    Recall is None if it is not known.
    """
    rows = nodes.count()
    lists = cut_lineage(shorten(planted(nodes, rows, 0, LIST), None))
    links, whole = audited(nodes, threshold)
    recall = 1.0 if links is None and whole else None
    for turn in range(rounds):
        if turn:
            room = lists.groupBy("u").agg(F.max("room").alias("room"))
            grown = lists.select("u", "v", "sim").unionByName(
                planted(nodes, rows, turn * TREES, LIST))
            lists = cut_lineage(shorten(grown, room))
        lists = refine(lists, nodes, threshold, turn)
        if links is not None:
            recall = recall_of(links, lists, threshold)
        if recall is not None and recall >= RECALL:
            break
    return lists, recall


def near_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
                 threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    nodes = unit_vectors(df.select(id_column, vector), id_column, vector)
    lists, recall = neighbour_lists(nodes, threshold, rounds)
    if recall is None:
        warnings.warn("recall of near vectors is not known: no drawn vector has a link")
    elif recall < RECALL:
        raise RuntimeError(f"recall of near vectors is {recall:.4f} after {rounds} rounds, "
                           f"below {RECALL}")
    links = cut_lineage(exact_links(nodes, components(linked(lists, threshold)), threshold))
    joined = components(links.where("node != star").select(
        F.col("node").alias("a"), F.col("star").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    named = (nodes.select("node", "embedding", "least_id", "weight")
             .join(counts, "node", "left").join(joined, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select(
        F.col("embedding").alias("__embedding"), "component_id",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    rows = df.select(id_column, F.col(vector).alias("__vector"))
    found = rows.join(named, F.col("__vector") == F.col("__embedding"), "left")
    return found.select(
        id_column, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("__embedding").isNull(), F.col(id_column)).otherwise(
            F.col("component_id")).cast("long").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))
