"""A dataset manifest of Merkle trees: every row's digest with the path that proves it.

Leaves of a group (a language) are dealt to aligned blocks of 2^height; a block's root is a
leaf of the tier above, where blocks are cut alike, until a group has one node, its subroot.
The subroots are the leaves of one more such tree. Within a block one task advances the
authentication path leaf by leaf: a treehash stack for every level works ahead on the next
sibling of its level, and a step of work always goes to the stack whose lowest node is
lowest, so a block needs about three digests a level besides its leaves. The paths above
a block are the same for all its leaves and are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions.index import checkpointed, positions_by

HEIGHT = 10  # levels of a block
FEW = 10_000  # groups up to which their table is broadcast (a row of some 100 bytes each)
PATH = "array<struct<left:string,right:string>>"


def parent(left: str | None, right: str | None) -> str | None:
    """The digest of a run of two nodes, or of one; none of none."""
    if left is None:
        return None
    return hashlib.sha256((left if right is None else left + right).encode()).hexdigest()


def treehash(leaves: list[str], height: int) -> tuple[str, list, list]:
    """(root, the first node of each level, the second one or None) of a block, by one stack."""
    first: list = [None] * (height + 1)
    second: list = [None] * (height + 1)

    def seen(level: int, i: int, node: str) -> None:
        if i < 2:
            (second if i else first)[level] = node

    stack: list[tuple[int, str]] = []
    for i, node in enumerate(leaves):
        level = 0
        seen(0, i, node)
        while i & 1:
            node, level, i = parent(stack.pop()[1], node), level + 1, i >> 1
            seen(level, i, node)
        stack.append((level, node))
    rest = None  # the unfinished right edge
    for level in range(height):
        if stack and stack[-1][0] == level:
            rest = parent(stack.pop()[1], rest)
        elif rest is not None:
            rest = parent(rest, None)
        if rest is not None:
            seen(level + 1, (len(leaves) - 1) >> (level + 1), rest)
    return first[height], first, second


DONE = 1 << 30


class Ahead:
    """The stack of one level, which works out one node of it by single steps."""

    def __init__(self, level: int, node: str | None):
        self.level, self.at, self.nodes = level, 0, [(level, node)]
        self.low = DONE  # level of its lowest node; its own if nothing is begun

    def begin(self, leaf: int, size: int) -> None:
        """Start on the node whose first leaf this is; past the last leaf there is none."""
        self.at = leaf
        if leaf >= size:
            self.nodes, self.low = [(self.level, None)], DONE
        else:
            self.nodes, self.low = [], self.level

    def step(self, leaves: list[str]) -> None:
        nodes = self.nodes
        if len(nodes) > 1 and nodes[-1][0] == nodes[-2][0]:
            level, right = nodes.pop()
            nodes[-1] = (level + 1, parent(nodes[-1][1], right))
        else:
            nodes.append((0, leaves[self.at] if self.at < len(leaves) else None))
            self.at += 1
        self.low = DONE if len(nodes) == 1 and nodes[0][0] == self.level else nodes[-1][0]


def traverse(leaves: list[str], height: int, peak: list | None = None) -> Iterator[list]:
    """For every leaf of a block in turn the sibling at each level, None where there is none.
    The list is reused. ``peak`` gets the most digests that the stacks held."""
    _, first, second = treehash(leaves, height)
    siblings = second[:height]
    stacks = [Ahead(level, first[level]) for level in range(height)]
    low = [DONE] * height
    for i in range(len(leaves)):
        yield siblings
        for level in range(height):
            if (i + 1) & ((1 << level) - 1):
                break
            stack = stacks[level]
            siblings[level] = stack.nodes[0][1]
            stack.begin((i + 1 + (1 << level)) ^ (1 << level), len(leaves))
            low[level] = stack.low
        for _ in range(2 * height - 1):
            least = min(low)
            if least == DONE:
                break
            level = low.index(least)
            stacks[level].step(leaves)
            low[level] = stacks[level].low
            if peak is not None:
                peak[0] = max(peak[0], sum(len(s.nodes) for s in stacks))


def levels(n: int, height: int) -> int:
    """Levels of the blocks of a tree of n leaves."""
    return min(height, (n - 1).bit_length())


def block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, ix, n, digest) of the tier above: a node for each block."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("ix")
        tree, ix, n = (table.column(c)[0].as_py() for c in ("tree", "ix", "n"))
        root = treehash(table.column("digest").to_pylist(), levels(n, height))[0]
        return pa.table({"tree": [tree], "ix": [ix >> height], "n": [-(-n // (1 << height))], "digest": [root]})

    own = nodes.select("tree", "ix", "n", "digest", F.shiftright("ix", height).alias("block"))
    return own.groupBy("tree", "block").applyInArrow(run, "tree long, ix long, n long, digest string")


def climb(nodes: DataFrame, most: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """(tiers from the leaves up, one node a tree), where no tree has over ``most`` leaves."""
    tiers = [nodes]
    while most > 1 << height:
        tiers.append(checkpointed(block_roots(tiers[-1], height)))
        most = -(-most // (1 << height))
    return tiers, checkpointed(block_roots(tiers[-1], height))


def descend(nodes: DataFrame, above: DataFrame, height: int, kept: list[str]) -> DataFrame:
    """``nodes`` with ``path``, their siblings up to the block's root and what ``above`` (tree,
    ix, path, subroot, root) has for the block; and its roots. ``kept`` columns stay."""

    def run(table, top):
        import pyarrow as pa

        if not table.num_rows or not top.num_rows:
            return table.slice(0, 0).select(["tree", "ix", "digest", *kept]).append_column("path", pa.array([], kind)).append_column("subroot", pa.array([], pa.string())).append_column("root", pa.array([], pa.string()))
        table = table.sort_by("ix")
        n, start = table.column("n")[0].as_py(), table.column("ix")[0].as_py()
        upper = top.column("path")[0].as_py()
        up_left, up_right = [s["left"] for s in upper], [s["right"] for s in upper]
        height_ = levels(n, height)
        left, right, ends = [], [], [0]
        for i, siblings in enumerate(traverse(table.column("digest").to_pylist(), height_), start):
            for level in range(height_):
                node, odd = siblings[level], i >> level & 1
                left.append(node if odd else None)
                right.append(None if odd else node)
            left += up_left
            right += up_right
            ends.append(len(left))
        struct = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
        out = table.select(["tree", "ix", "digest", *kept]).append_column("path", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct))
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.array([top.column(name)[0].as_py()] * len(table), pa.string()))
        return out

    import pyarrow as pa

    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = f"tree long, ix long, digest string, {''.join(f'{c} {types[c]}, ' for c in kept)}path {PATH}, subroot string, root string"
    own = nodes.select("tree", "ix", "n", "digest", *kept, F.shiftright("ix", height).alias("block"))
    return own.groupBy("tree", "block").cogroup(above.select("tree", F.col("ix").alias("block"), "path", "subroot", "root").groupBy("tree", "block")).applyInArrow(run, schema)


def prove(tiers: list[DataFrame], above: DataFrame, height: int, kept: list[str]) -> DataFrame:
    """Paths of the leaves (the first tier), from those of the trees' own nodes downwards."""
    for nodes in tiers[:0:-1]:
        above = descend(nodes, above, height, [])
    return descend(tiers[0], above, height, kept)


def row_digest(columns: list[Column]) -> Column:
    """Digest of a row: of each value "-" if null, else its bytes' number, ":" and itself."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def fold(path: Column | str, leaf: Column) -> Column:
    """The root that a leaf and its path give."""
    step = lambda node, s: F.sha2(F.concat(F.coalesce(s["left"], F.lit("")), node, F.coalesce(s["right"], F.lit(""))), 256)
    return F.aggregate(path, leaf, step)


def siblings_digest(path: Column | str) -> Column:
    """Digest of the siblings of a path, from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.coalesce(s["left"], s["right"])), ""), 256)


def build_manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", height: int = HEIGHT) -> DataFrame:
    """``rows`` (key, group, leaf and more) with ``position`` in the group, ``path`` (siblings
    left or right, both null where a node stands alone), ``subroot`` and ``root``.

    Leaves of a group ascend by the key (null first), then by leaf; rows with equal key and
    leaf have neighbouring places in any order. Groups ascend bytewise, the null group first.
    An empty table has an empty manifest. Texts do not travel: give ``leaf`` and what you need.

    Two shuffles of the rows follow the sort, both by block, so no task gets a whole group
    however many rows share it; tables of block roots are 2^height times smaller.
    """
    kept = [f"row_{c}" for c in rows.columns]
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("_group"), *[F.col(c).alias(f"row_{c}") for c in rows.columns])
    # The number tells apart rows that are the same, so that even a third of all may be one row.
    ready = checkpointed(named).withColumn("_tie", F.monotonically_increasing_id())
    placed = positions_by(ready, "_group", f"row_{key}", "row_leaf", "_tie", name="_seq")
    groups = positions_by(placed.groupBy("_group").agg(F.count("*").alias("n"), F.min("_seq").alias("_start")), "_group", name="tree")
    facts = groups.agg(F.count("*").alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    sized = F.broadcast(groups) if facts.groups <= FEW else groups
    nodes = placed.join(sized, "_group").select("tree", (F.col("_seq") - F.col("_start")).alias("ix"), "n", F.col("row_leaf").alias("digest"), *kept)
    tiers, trees = climb(nodes, facts.most, height)
    subroots = trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("ix"), F.lit(facts.groups).cast("long").alias("n"), "digest")
    upper, root = climb(subroots, facts.groups, height)
    nothing, none = F.array().cast(PATH), F.lit(None).cast("string")
    above = prove(upper, root.select("tree", "ix", nothing.alias("path"), none.alias("subroot"), F.col("digest").alias("root")), height, [])
    above = above.select(F.col("ix").alias("tree"), F.lit(0).cast("long").alias("ix"), "path", F.col("digest").alias("subroot"), "root")
    out = prove(tiers, checkpointed(above), height, kept)
    return out.select(*[F.col(f"row_{c}").alias(c) for c in rows.columns], F.col("ix").alias("position"), "path", "subroot", "root")


def document_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of documents, with each row checked after a seventh of them are tampered.

    A leaf is the digest of doc_id, source, lang, n_chars and text; other columns are ignored.
    Where 7 divides the CRC-32 of the id, 1 is added to n_chars before the check; a null
    n_chars or id leaves the row as it is, and it passes.
    """
    long = F.col("n_chars").cast("decimal(20,0)")
    fields = lambda n_chars: [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select(
        "doc_id",
        "lang",
        row_digest(fields(F.col("n_chars"))).alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), row_digest(fields(long + 1))).alias("altered"),
    )
    made = build_manifest(rows, height=height)
    checked = made.withColumn("folded_root", fold("path", F.coalesce("altered", "leaf")))
    return checked.select("doc_id", "leaf", "subroot", "root", siblings_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
