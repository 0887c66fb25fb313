import hashlib
import math
import random
import re
import zlib
from collections import Counter

from quadrel.llm.queries import OP12_SQL, QUERIES
from tests.oracle import same
from quadrel.llm.resample import Ring, resample, text_buckets

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(docs, target):
    """The contract on plain lists."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    rank = {id(r): k for k, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return sorted(([*r[:4], rank.get(id(r))] for r in out), key=repr)


def rows_of(df):
    return sorted(([r[c] for c in COLUMNS] for r in df.collect()), key=repr)


def test_ring_equals_whole_hashes():
    words = [w.encode() for w in "a bb ä 日本 a bb x".split()]
    for cut in range(len(words) + 1):
        ring, found = Ring(), []
        for part in (words[:cut], words[cut:]):
            for states in ring.extend(part):
                found += states
        assert sorted(found) == sorted(zlib.crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def test_long_text_in_chunks(monkeypatch):
    monkeypatch.setattr("quadrel.llm.resample.CHUNK", 7)
    text = " ".join(random.Random(1).choice("Aa b É 7 \U0001f600 zz".split()) for _ in range(500))
    n, found = text_buckets(text)
    assert n == 500 and Counter(found.tolist()) == Counter(map(bucket, features(text)[1]))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = "the of and x1 é Straße 日本 data model 42".split()
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 2, 19, 20, 21, 60]))) for i in range(300)]
    docs += [docs[7]] * 40 + [(7, text(30)), (None, text(25)), (None, None), (900, None), (901, "")]
    rng.shuffle(docs)
    return docs, [text(15) for _ in range(6)] + [None, ""]


def test_equals_brute_force(spark):
    for seed in range(3):
        docs, target = corpus(seed)
        d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, codes int").repartition(5)
        t = spark.createDataFrame([(x, "1") for x in target], "text string, doc_id string")
        assert rows_of(resample(d, t)) == brute(docs, target)


def test_empty_tables(spark):
    docs, target = corpus(5)
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
    assert resample(d.limit(0), t).collect() == []
    assert rows_of(resample(d, t.limit(0))) == brute(docs, [])


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op12_importance_resampling"](spark, SF)) == brute(docs, target)


def test_query_equals_sql(spark, sf_dir):
    assert same(spark, sf_dir, QUERIES["op12_importance_resampling"], OP12_SQL)
