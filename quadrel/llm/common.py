"""Shared helpers: reading tables, checkpoints, connected components, weak hashing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.index import checkpointed


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's reader (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that ``edges`` (u, v; longs) connect to each node.

    Alternating large-star and small-star steps: every step groups edges by a node and
    points the neighbours to the group's minimum, so the work is two shuffles of the edges
    a round and about log2(diameter) rounds. Minima are pre-aggregated; a hub's minimum comes
    to its edges by broadcast, so no hub is gathered in one task. Nodes without edges are not
    in the result; null ends and self loops are ignored.
    """
    pairs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    current = checkpointed(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        facts = current.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes")).first()
        if facts.n == facts.nodes and current.join(current.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break  # every node has one edge, to a node that has none
        # Of nodes with more edges than this there are at most 8,192 a step.
        many = max(64, facts.n // 4096)
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, many).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        current = checkpointed(
            _with_least(large, many)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _with_least(edges: DataFrame, many: int) -> DataFrame:
    """(u, v, m): every edge with the least v of its u. Nodes of more than ``many`` edges are
    few, so their minima are broadcast; the others are joined."""
    tally = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = tally.where(F.col("n") > many).select("u", F.col("m").alias("h"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    plain = marked.where("h IS NULL").select("u", "v").join(tally.where(F.col("n") <= many).select("u", "m"), "u")
    return marked.where("h IS NOT NULL").select("u", "v", F.col("h").alias("m")).unionByName(plain)


PAIR = 1 << 31
BY_BAND = 1 << 62  # bit of ``pair`` that marks a group of one band


def candidate_groups(classes: DataFrame, block: int, block_weight: int) -> DataFrame:
    """(group, pair, side, rep, alone): where each class meets those that share a band.

    ``classes`` is (rep, weight, bands): a unique long, the cost of sending it, and an array
    of band hashes, of which 0 means none. Classes that bands connect form a component. One
    of at most ``block`` classes and ``block_weight`` is a group, in which all pairs meet.
    A larger one is cut into blocks, a group for every pair of blocks, or, where that sends
    less, into a group for every band that two share (cut into blocks likewise): loosely
    connected texts then meet only those they share a band with. Sizes decide alone; either
    way every two classes that share a band meet: in a group of blocks once, in groups of
    bands (``pair`` has the bit BY_BAND, ``group`` is the band) as often as they share bands.
    ``side`` is 0 where a block meets itself, else 1 or 2. ``alone``: one group holds the
    whole component.
    """
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("weight") / block_weight)).cast("int").alias("blocks")
    total = [F.count("*").alias("n"), F.sum("weight").alias("weight")]
    banded = classes.select("rep", "weight", F.explode("bands").alias("band")).where("band <> 0")
    met = checkpointed(banded.groupBy("band").agg(F.min("rep").alias("head"), *total).where("n > 1").select("band", "head", "n", "weight", blocks))
    shared = checkpointed(banded.select("rep", "band").join(met.select("band", "head"), "band"))
    components = connected_components(shared.where("rep <> head").select(F.col("rep").alias("u"), F.col("head").alias("v")).distinct())
    members = checkpointed(classes.join(components, F.col("rep") == F.col("node")).select("component", "rep", "weight"))
    sizes = members.groupBy("component").agg(*total).select("component", "weight", blocks)
    sends = F.col("blocks") * F.col("weight")
    large = sizes.where("blocks > 1").select("component", sends.alias("whole"))
    bands = met.join(components, F.col("head") == F.col("node")).join(large, "component")
    cheaper = bands.groupBy("component").agg(F.sum(sends).alias("split"), F.first("whole").alias("whole")).where("split < whole").select("component")
    together = members.join(sizes.select("component", "blocks"), "component").join(cheaper, "component", "left_anti")
    split = shared.select("rep", "band").join(bands.join(cheaper, "component").select("band", "blocks"), "band")
    dealt = together.select(F.col("component").alias("group"), "rep", "blocks", F.lit(0).cast("long").alias("mark"), (F.col("blocks") == 1).alias("alone")).unionByName(
        split.select(F.col("band").alias("group"), "rep", "blocks", F.lit(BY_BAND).cast("long").alias("mark"), F.lit(False).alias("alone"))
    )
    return (
        dealt.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "group",
            (F.col("mark") + F.least("own", "other") * F.lit(PAIR).cast("long") + F.greatest("own", "other")).alias("pair"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
            "rep",
            "alone",
        )
    )


def least_common(a, b):
    """Least value that two arrays of band hashes (pairs, bands) hold at one place; 0 is none."""
    import numpy as np

    return np.where((a == b) & (a != 0), a, np.iinfo(np.int64).max).min(axis=1)


def held_out(doc_id):
    """Column: is this id in the held-out quarter? Null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def by_size(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of ``texts`` of about ``most`` characters, one text at least."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text) + 16
    if start < len(texts):
        yield start, len(texts)


def where_scored(docs: DataFrame, score, wanted, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose texts' scores are ``wanted``.

    ``score`` gives an array for a list of texts (null is empty), ``wanted`` a mask for that
    array. No shuffle; a row passes through its task once.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for i, j in by_size(texts, 4_000_000):
                yield batch.slice(i, j - i).filter(pa.array(wanted(score(texts[i:j])), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def whole_groups(batches, keys: int):
    """Arrow tables that end where the first ``keys`` columns change.

    The batches come sorted by those columns, so only the last, unfinished group is kept
    back; a table holds one batch and at most one group more.
    """
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table]).combine_chunks()
        changed = np.zeros(max(table.num_rows - 1, 0), bool)
        for i in range(keys):
            column = table.column(i).to_numpy()
            changed |= column[1:] != column[:-1]
        ends = np.flatnonzero(changed)
        if not len(ends):
            rest = table
            continue
        cut = int(ends[-1]) + 1
        yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def pair_components(n: int, a, b):
    """Least index connected to each of 0..n-1 by the index pairs (a, b); numpy only."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of at most ``per_class`` training rows of each class.

    The rows are those of least hash of the key among the labelled documents outside the
    held-out quarter, so the sample is bounded, repeatable and independent of partitioning;
    its ids are few enough to broadcast. A text of a repeated key counts once (the least).
    Labels other than 0 and 1 are ignored.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    wanted = wanted.where("label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out(F.col("doc_id")))
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Twice as many ids as rows: some labelled ids may have no document here.
    ids = [wanted.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class) for c in (0, 1)]
    rows = checkpointed(present.join(F.broadcast(ids[0].union(ids[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    kept = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect() for c in (0, 1)]
    return [r.text for part in kept for r in part], [r.label for part in kept for r in part]
