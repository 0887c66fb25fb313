import hashlib
import random
import zlib

import pytest
from quadrel.llm.merkle import build_manifest, document_manifest, levels, traverse, treehash
from quadrel.llm.queries import OP11_SQL, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, add=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + add
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        start = i - i % 2
        out.append(([x for x in level[start:i]], [x for x in level[i + 1 : start + 2]]))
        i //= 2
    return out


def brute(rows):
    """The contract, read literally: whole trees in memory."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = tree_of([leaf_of(r) for r in groups[lang]])
    top = tree_of([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, row in enumerate(groups[lang]):
            path = siblings(trees[lang], i) + siblings(top, k)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf_of(row, 1 if bad else 0)
            for before, after in path:
                node = h(*before, node, *after)
            root = top[-1][0]
            out.append((row[0], leaf_of(row), trees[lang][-1][0], root, h(*[x for p in path for side in p for x in side]), node, node == root))
    return sorted(out, key=repr)


def test_traversal_gives_every_sibling_with_little_memory():
    for size in [*range(1, 34), 100, 128, 1000, 1024]:
        leaves = [h(str(i)) for i in range(size)]
        height = levels(size, 10)
        tree, peak = tree_of(leaves), [0]
        assert treehash(leaves, height)[0] == tree[-1][0]
        for i, found in enumerate(traverse(leaves, height, peak)):
            assert [x for x in found] == [(a + b or [None])[0] for a, b in siblings(tree, i)]
        assert peak[0] <= 3 * height
    # A block at the right edge of a larger tree: single runs are hashed up to the block's root.
    leaves = [h(str(i)) for i in range(3)]
    assert treehash(leaves, 4)[0] == h(h(tree_of(leaves)[-1][0]))


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_equals_brute_force(spark, height):
    rng = random.Random(height)
    rows = [(i, f"text {i} ä日", rng.choice(["en", "de", None, "", "Z", "é"]), rng.choice(["web", None]), rng.choice([None, i])) for i in range(90)]
    rows += [rows[5]] * 7 + [(None, None, None, None, None), (None, "x", "en", "s", 2), (7, "other text", rows[7][2], "web", 1), (2**62, "", "en", "", 2**63 - 1)]
    rng.shuffle(rows)
    got = document_manifest(spark.createDataFrame(rows, SCHEMA), height).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert any(not r.verified for r in got)


def test_one_row_empty_table_and_clashing_columns(spark):
    one = spark.createDataFrame([(3, "t", "en", "s", 1)], SCHEMA)
    extra = one.selectExpr("*", "1 AS leaf", "2 AS path", "'x' AS root", "4 AS ix", "5 AS n")
    row = document_manifest(extra).first()
    assert tuple(row) == brute([(3, "t", "en", "s", 1)])[0] and row.proof_sha256 == h() and row.root == row.leaf
    assert document_manifest(one.limit(0)).collect() == []


def test_many_groups_are_joined(spark, monkeypatch):
    monkeypatch.setattr("quadrel.llm.merkle.FEW", 2)
    rows = [(i, "t", f"lang{i % 21}", "s", 1) for i in range(60)]
    got = document_manifest(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_manifest_keeps_columns_and_paths(spark):
    rows = spark.range(5).selectExpr("id AS doc_id", "'g' AS lang", "sha2(cast(id AS string), 256) AS leaf", "id * 2 AS tree")
    got = sorted(build_manifest(rows).collect(), key=lambda r: r.position)
    assert [r.tree for r in got] == [0, 2, 4, 6, 8] and got[0].path[0].right == got[1].leaf and got[4].path[0] == (None, None)


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, SF).collect()), key=repr) == brute(rows)


def test_query_equals_sql(spark, sf_dir):
    assert same(spark, sf_dir, QUERIES["op11_merkle_manifest"], OP11_SQL)
