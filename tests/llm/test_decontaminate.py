import hashlib
import random
import re

from quadrel.llm.decontaminate import contamination, find_benchmark
from quadrel.llm.queries import OP13_SQL, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.01"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(m[0], m.start(), m.end()) for m in re.finditer(WORDS, lower)]


def brute(text, items, window=10):
    """(words, hit word numbers, ids): every window against every place."""
    words = [w for w, _, _ in words_of(text)]
    hit, ids = set(), set()
    for item, body in items:
        own = [w for w, _, _ in words_of(body)]
        for i in range(max(len(own) - window, 0) + 1 if own else 0):
            part = own[i : i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    ids |= set() if item is None else {str(item)}
    return words, hit, sorted(ids)


def fuzz(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "ab", "ä", "Ä", "1", "x2", "日本", "é", "\U0001f600"]
    glue = [" ", ", ", "\n", "--", ".", "\x00", "`"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 10, 11, 14]))) for i in range(12)] + [(3, "a B ab"), (None, "é é é"), (7, None)]
    docs = []
    for k in range(60):
        body = text(rng.randrange(40))
        if k % 3 == 0:
            body += rng.choice(items)[1] or ""
        docs.append((k, body + text(rng.randrange(5))))
    return docs + [(60, None), (61, ""), (None, items[4][1]), (5, docs[5][1]), (5, docs[5][1])], items


def check(rows, docs, items):
    expected = sorted((repr((d, *[x if i else len(x) for i, x in enumerate(brute(t, items)[:1])], len(brute(t, items)[1]), brute(t, items)[2])) for d, t in docs))
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, list(r["items"]))) for r in rows) == expected
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(t)
    for r in rows:
        for h in r.hits:
            places = [words_of(t) for t in texts[r.doc_id] if t]
            assert any(len(p) >= h.last and (p[h.first][1], p[h.last - 1][2]) == (h.start, h.end) for p in places)


def test_equals_brute_force(spark):
    for seed in range(4):
        docs, items = fuzz(seed)
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        check(find_benchmark(d, b).collect(), docs, items)


def test_many_automata_equal_one(spark):
    docs, items = fuzz(9)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    check(find_benchmark(d, b, automaton_bytes=60).collect(), docs, items)


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr("quadrel.llm.decontaminate.PIECE", 3)
    from quadrel.llm.decontaminate import item_pieces, patterns

    body = " ".join(f"w{i}" for i in range(31))
    pieces = [(r.item_id, bytes(r.words)) for r in item_pieces(spark.createDataFrame([(1, body)], "item_id long, text string"), 10).collect()]
    code, found = patterns(pieces, 10)
    whole = "".join(code[w] for w in body.encode().split())
    assert set(found) == {whole[i : i + 10] for i in range(22)}


def test_long_text_clashing_columns_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(12))
    long = "lorem ipsum, " * 200_000 + item.upper()
    docs = spark.createDataFrame([(1, long, "x", 3)], "doc_id long, text string, item_id string, n_hit int")
    bench = spark.createDataFrame([(8, item, 1)], "item_id long, text string, doc_id int")
    row = contamination(docs, bench).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (400_012, 12, 1, True)
    assert row.items_sha256 == hashlib.sha256(b"8").hexdigest()
    assert contamination(docs.limit(0), bench).count() == 0
    row = contamination(docs, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row.contaminated, row.items_sha256) == (400_012, 0, False, hashlib.sha256(b"").hexdigest())


def test_query_on_whole_table(spark):
    rows = {r.doc_id: r for r in QUERIES["op13_decontaminate"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len(rows) == len(docs)
    windows = {}
    for item, text in items:
        own = [w for w, _, _ in words_of(text)]
        for i in range(max(len(own) - 10, 0) + 1):
            windows.setdefault(tuple(own[i : i + 10]), set()).add(str(item))
    for d in docs:
        words, hit, ids = [w for w, _, _ in words_of(d.text)], set(), set()
        for n in {len(w) for w in windows}:
            for j in range(len(words) - n + 1):
                found = windows.get(tuple(words[j : j + n]))
                if found:
                    hit.update(range(j, j + n))
                    ids |= found
        r = rows[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (len(words), len(hit), len(ids))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_query_equals_sql(spark, sf_dir):
    assert same(spark, sf_dir, QUERIES["op13_decontaminate"], OP13_SQL)
