"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected at random to eight dimensions, several times ("tables"); every
projection is decoded to its nearest point of the lattice E8. A vector lives in that cell
and also visits the cells around it whose centres are next nearest; two vectors meet where
one lives and the other lives or visits. Pairs that meet are verified by their cosine. The more
vectors a label has, the more projections make up a table's cell and the more tables there are,
so that the share of pairs that meet falls while near pairs meet as surely.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import checkpointed, connected_components, pair_components, whole_groups


@dataclass(frozen=True)
class LatticeParams:
    """With these, simulation gives a pair of cosine 0.93 a chance of 0.99997 to meet
    (0.926 a table), a pair of 0.95 one of 0.9999996."""

    tables: int = 4
    cell: float = 0.6  # lattice scale, against unit vectors' projections of norm about 1
    visits: int = 8  # neighbouring cells that each vector visits, of 240, by each projection
    parts: int = 1  # projections whose lattice points make up a cell; one of them may differ in a visit
    block: int = 1024  # rows of a cell that one task compares with as many others
    seed: int = 20240229


# By the number of a label's different vectors, up to: parameters. Simulated chances for a pair of
# cosine 0.93 to meet, and for random vectors in 64 dimensions: 0.99997 and 0.06; 0.9992 and
# 0.015; 0.9990 and 0.0003; 0.9991 and about 0.00002.
LADDER = (
    (1 << 15, LatticeParams()),
    (1 << 20, LatticeParams(tables=7, cell=0.8, parts=2)),
    (1 << 23, LatticeParams(tables=12, parts=2)),
    (1 << 62, LatticeParams(tables=37, parts=3)),
)
FEW = 10_000  # labels up to which the table of their sizes is broadcast

# The 240 shortest vectors of E8: two of eight places are +-1, or all are +-1/2 with an
# even number of minus signs.
NEIGHBOURS = np.array(
    [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2]
    + [tuple(x / 2 for x in v) for v in itertools.product((-1, 1), repeat=8) if v.count(-1) % 2 == 0],
    dtype=np.float64,
)


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: where the sum is odd, the worst place rounds the other way."""
    point = np.rint(y)
    rest = y - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half: the nearer of the two nearest points."""
    whole, half = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def cells(units: np.ndarray, label: np.ndarray, params: LatticeParams) -> np.ndarray:
    """int64 (vectors, tables, 1 + parts * visits): hashes of the home cell and of the visited
    cells, which differ from it in the point of one part."""
    n, dim = units.shape
    out = np.empty((n, params.tables, 1 + params.parts * params.visits), np.int64)
    for t in range(params.tables):
        homes, visited = [], []  # hashes of the parts' own points, and of those around them
        for part in range(params.parts):
            rng = np.random.default_rng([params.seed, t, dim, part] if part else [params.seed, t, dim])
            basis = np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim] * (np.sqrt(max(dim, 8) / 8) / params.cell)
            y = units @ basis
            home = nearest_e8(y)
            gain = (y - home) @ NEIGHBOURS.T
            order = np.argsort(-gain, axis=1, kind="stable")[:, : params.visits]
            points = np.concatenate([home[:, None], home[:, None] + NEIGHBOURS[order]], axis=1)
            code = np.full(points.shape[:2], np.uint64(t + 1 + part * 1_000_003)) ^ mixed(label)[:, None]
            for place in range(8):
                code = mixed(code * np.uint64(31) + (2 * points[:, :, place]).astype(np.int64).view(np.uint64))
            homes.append(code[:, 0])
            visited.append(code[:, 1:])
        whole = sum(homes[1:], homes[0])  # sums wrap around
        around = [(whole - h)[:, None] + v for h, v in zip(homes, visited, strict=True)]
        out[:, t] = np.concatenate([whole[:, None], *around], axis=1).view(np.int64)
    return out


def meeting_cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one cell that counts a pair: the least of the first table in which the two meet."""
    none = np.iinfo(np.int64).max
    b_home = np.where((a == b[:, :, :1]).any(axis=2), b[:, :, 0], none)
    a_home = np.where((b == a[:, :, :1]).any(axis=2), a[:, :, 0], none)
    least = np.minimum(a_home, b_home)
    first = (least != none).argmax(axis=1)
    return least[np.arange(len(a)), first]


def compare(cell, pair, side, home, label, units, threshold: float, params: LatticeParams):
    """Index pairs (a, b) that are linked and count in their group (a cell and pair of blocks).

    The rows come group by group. ``side`` is 0 where a block meets itself, else 1 and 2 for
    the two blocks.
    """
    starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])])
    found = [np.empty((2, 0), np.int64)]
    for i, j in zip(starts, np.r_[starts[1:], len(cell)], strict=True):
        if j - i < 2 or not home[i:j].any():
            continue
        lives = np.flatnonzero(home[i:j])  # two visitors meet elsewhere, if at all
        a, b = np.nonzero(units[i + lives] @ units[i:j].T >= threshold)
        a = lives[a]
        keep = ((a < b) | ((a > b) & ~home[i + b])) & ((side[i + a] != side[i + b]) | (side[i + a] == 0))
        found.append(np.stack([i + a[keep], i + b[keep]]))
    pairs = np.concatenate(found, axis=1)
    used, local = np.unique(pairs, return_inverse=True)
    local = local.reshape(pairs.shape)
    own = cells(units[used], label[used], params)
    counts = np.zeros(pairs.shape[1], bool)
    for i in range(0, len(counts), 50_000):
        a, b = local[:, i : i + 50_000]
        counts[i : i + 50_000] = meeting_cell(own[a], own[b]) == cell[pairs[0, i : i + 50_000]]
    return pairs[0, counts], pairs[1, counts]


def link_embeddings(
    vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", embedding: str = "embedding", label: str = "label", params: LatticeParams | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Two rows are linked if their labels are equal and the cosine of their embeddings, in
    double precision, is at least ``threshold``. Null, zero or empty vectors, vectors with
    null or non-finite components, vectors of different lengths and rows with a null label
    or key link with nothing: n_links 0, component_id their own key. Equal vectors form one
    class, so copies are neither hashed nor compared again, and count each other as links.
    Several rows with one key count as that many vectors of one component.

    Without ``params``, each label's follow from its number of different vectors (``LADDER``).

    Shuffles: the classes; (cell, key) pairs; and each vector once for every cell that it
    shares with another (4 x 9 at most on the lowest step of the ladder). A crowded cell is cut into blocks of ``block`` rows
    and every pair of blocks is a group of its own, so no task gathers a hot cell. A task
    returns a count per vector and a spanning forest, never the pairs.
    """
    vector = F.col(embedding).cast("array<double>")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("e"), F.col(label).cast("long").alias("label"), F.coalesce(finite, F.lit(False)).alias("ok"))
    valid = rows.where("ok AND label IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "label", "e")
    classes = checkpointed(valid.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    ladder = LADDER if params is None else ((1 << 62, params),)
    tally = checkpointed(classes.groupBy("label").agg(F.count("*").alias("n")))
    level = F.lit(0)
    for most, _ in ladder[:-1]:
        level = level + (F.col("n") > most).cast("int")
    levels = tally.select("label", level.alias("level"))
    classes = classes.join(F.broadcast(levels) if tally.count() <= FEW else levels, "label")
    block = ladder[0][1].block

    def hashed(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            ids, labels, level = (batch.column(i).to_numpy() for i in (0, 2, 3))
            flat, offset = batch.column(1).flatten().to_numpy().astype(np.float64), np.r_[0, np.cumsum(sizes)]
            for size, step in sorted(set(zip(sizes.tolist(), level.tolist(), strict=True))):
                own = np.flatnonzero((sizes == size) & (level == step))
                data = flat[offset[own][:, None] + np.arange(size)]
                code = cells(unit(data), labels[own], ladder[step][1])
                shape = code.shape
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(code.ravel()),
                        pa.array(np.repeat(ids[own], shape[1] * shape[2])),
                        pa.array(np.tile(np.arange(shape[2]) == 0, shape[0] * shape[1])),
                        pa.array(np.repeat(labels[own], shape[1] * shape[2])),
                    ],
                    ["cell", "rep", "home", "label"],
                )

    keys = classes.select("rep", "e", "label", "level").mapInArrow(hashed, "cell long, rep long, home boolean, label long")
    crowd = keys.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("n > 1 AND lived").select("cell", "n")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = (
        keys.join(crowd, "cell")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "cell",
            (F.least("own", "other") * F.lit(1 << 31).cast("long") + F.greatest("own", "other")).alias("pair"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
            "rep",
            "home",
        )
    )

    def verified(batches):
        for table in whole_groups(batches, 2):
            cell, pair, side = (table.column(i).to_numpy() for i in range(3))
            ids, home, labels, copies = (table.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7))
            column, level = table.column(7).combine_chunks(), table.column(8).to_numpy()
            sizes = np.asarray(column.value_lengths())
            flat, offset = column.flatten().to_numpy().astype(np.float64), np.r_[0, np.cumsum(sizes)]
            for size, step in sorted(set(zip(sizes.tolist(), level.tolist(), strict=True))):
                own = np.flatnonzero((sizes == size) & (level == step))
                units = unit(flat[offset[own][:, None] + np.arange(size)])
                a, b = compare(cell[own], pair[own], side[own], home[own], labels[own], units, threshold, ladder[step][1])
                if not len(a):
                    continue
                weight = copies[own]
                links = np.zeros(len(own), np.int64)
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                least = pair_components(len(own), a, b)
                hit = np.flatnonzero(links)
                members = ids[own]
                yield pa.RecordBatch.from_arrays([pa.array(members[hit]), pa.array(members[least[hit]]), pa.array(links[hit])], ["rep", "toward", "links"])

    facts = classes.select("rep", "label", "copies", "e", "level")
    grouped = placed.join(facts, "rep").select("cell", "pair", "side", "rep", "home", "label", "copies", "e", "level")
    found = checkpointed(
        grouped.repartition("cell", "pair").sortWithinPartitions("cell", "pair").mapInArrow(verified, "rep long, toward long, links long")
    )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("u"), F.col("toward").alias("v")))
    summary = (
        classes.join(counts, "rep", "left")
        .join(parts, F.col("rep") == F.col("node"), "left")
        .select("label", "e", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    usable = rows.where("ok AND label IS NOT NULL AND vec_id IS NOT NULL").join(summary, ["label", "e"])
    other = rows.where("NOT (ok AND label IS NOT NULL AND vec_id IS NOT NULL)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.select("vec_id", "n_links", "component_id").union(other).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
