import hashlib
import random

import numpy as np
import pytest

from quadrel.llm import fingerprint
from quadrel.llm.fingerprint import PERIOD, WalkParams, _bits, _classes, _records, alike, compare_with_next, fingerprints, independent, likeness, near_texts
from quadrel.llm.queries import edit_classes, op10_edit_fingerprint


def slow(text, params=WalkParams()):
    """The same walk, one text and one step at a time."""
    classes = [int(c) for c in _classes(np.frombuffer(text.encode("utf-32-le"), np.uint32))] if text else []
    bits, records, out, i, j = _bits(params), _records(params), [0] * params.slots, 0, 0
    mask = 2**64 - 1
    while i < len(classes):
        if j in records:
            gram, power = 0, 1
            for k in range(params.note):
                power = power * 0x100000001B3 & mask
                gram += (classes[i + k] if i + k < len(classes) else 0) * (0x9E3779B97F4A7C15 * power & mask)
            gram = (gram + (j + 1) * 0xC2B2AE3D27D4EB4F) & mask
            for s in records[j]:
                out[s] = ((gram ^ gram >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 56
        i += bits[j % PERIOD, classes[i]]
        j += 1
    return bytes(out)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_walk_equals_slow_walk():
    rng = random.Random(5)
    texts = ["", "a", "\0é漢字😀", prose(rng, 3), prose(rng, 400), "x" * 3000, "\x00" * 50]
    assert fingerprints(texts) == [slow(t) for t in texts]


def slowest(n, params=WalkParams()):
    """A text that makes the reader stay as long as 200 kinds of characters can."""
    bits, out, j = _bits(params), [], 0
    classes = np.arange(33, 233)
    for _ in range(n):
        moves = bits[(j + np.arange(400)) % PERIOD][:, classes]
        wait = moves.argmax(axis=0)
        out.append(chr(classes[wait.argmax()]))
        j += int(wait.max()) + 1
    return "".join(out), j


def test_slow_walks_are_read_to_the_end():
    text, steps = slowest(3000)
    assert steps > 6 * len(text)
    other = text[:2000] + prose(random.Random(1), 300)[:1000]
    alone = fingerprints([text])[0]
    assert alone == slow(text) and alone == fingerprints([text, "x" * 9000, "y"])[0]
    assert likeness(alone, fingerprints([other])[0]) < 0.9


def test_edits_lower_likeness():
    rng = random.Random(8)
    text = prose(rng, 800)
    near = list(text)
    for _ in range(4):
        near.insert(rng.randrange(len(near)), "q")
    half = text[: len(text) // 2] + prose(rng, 400)
    a, b, c, d = fingerprints([text, "".join(near), half, prose(rng, 800)])
    assert likeness(a, a) == 1 and likeness(a, b) > 0.75
    assert 0.3 < likeness(a, c) < 0.7 and likeness(a, d) < 0.05


def expected(rows):
    rows = sorted(((k if k is not None else -(2**63), t or "") for k, t in rows))
    out = []
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = fingerprints([t, edited, nxt])
        out.append((None if k == -(2**63) else k, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), likeness(a, b), likeness(a, c)))
    return sorted(out, key=repr)


def test_order_of_documents(spark):
    rng = random.Random(2)
    rows = [(i * 3, prose(rng, rng.randint(0, 40))) for i in range(70)] + [(9, "tie"), (9, "tie"), (None, "no key"), (None, None), (300, None), (301, ""), (302, "long " * 30000)]
    rng.shuffle(rows)
    for own in (rows, rows[:1], rows[:2]):
        frame = spark.createDataFrame([(k, t, 0) for k, t in own], "doc_id long, text string, range int")
        assert sorted((tuple(r) for r in compare_with_next(frame).collect()), key=repr) == expected(own)
    assert compare_with_next(frame.limit(0)).collect() == []


def test_near_texts_share_a_class(spark):
    rng = random.Random(4)
    base = prose(rng, 300)
    rows = [(1, base), (2, base), (3, base[:700] + "zz" + base[700:]), (4, prose(rng, 300)), (None, base)]
    got = {r.doc_id: r.class_id for r in near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, None: None}


def test_near_texts_behind_heads_that_fail(spark):
    rng = random.Random(6)
    piece = lambda: prose(rng, 40)[:150]  # noqa: E731 (equal lengths sample equal steps)
    blocks = [piece() for _ in range(10)]
    family = []
    for _ in range(200):  # each shares another 60% of the text; in every band one shares the bucket
        changed = set(rng.sample(range(10), 4))
        family.append(" ".join(piece() if i in changed else x for i, x in enumerate(blocks)))
    text = " ".join(blocks)
    near = text[:900] + "q" + text[901:]
    codes = fingerprints([*family, text, near])
    assert likeness(codes[-2], codes[-1]) > 0.85 and max(likeness(c, d) for c in codes[:-2] for d in codes[-2:]) < 0.7
    frame = spark.createDataFrame([*enumerate(family), (1000, text), (1001, near)], "doc_id long, text string")
    for block in (1000, 7):
        got = {r.doc_id: r.class_id for r in near_texts(frame, block=block).collect()}
        assert (got[1000], got[1001]) == (1000, 1000)


def distance(a, b):
    """Edit distance, a row of the table at a time."""
    y = np.array([ord(c) for c in b])
    places = np.arange(len(b) + 1)
    row = places.copy()
    for i, c in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (y != ord(c)))
        row = np.minimum.accumulate(np.r_[i, step] - places) + places
    return int(row[-1])


def test_classes_against_edit_distances(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = prose(rng, 70)
        texts.append(base)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([1, 2, 3, 5])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "zz"])
            texts.append("".join(copy))
    got = {r.doc_id: r.class_id for r in near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    shares, met = [], []
    for i in range(len(texts)):
        for j in range(i):
            share = distance(texts[i], texts[j]) / len(texts[i])
            shares.append(share)
            met.append(got[i] == got[j])
            if share > 0.5:
                assert got[i] != got[j]
    shares, met = np.array(shares), np.array(met)
    # Texts of some 400 characters: a pair of up to four edits is found.
    for most, least in ((0.005, 0.95), (0.01, 0.92)):
        assert (shares <= most).sum() > 20 and met[shares <= most].mean() >= least


def test_independent_walks_find_what_one_loses():
    """Single pairs of 300 to 600 characters: the share that some walk calls near."""
    rng = random.Random(12)
    found = {1: [], 2: []}
    for percent in found:
        for _ in range(150):
            text = prose(rng, 130)[: rng.randint(300, 600)]
            copy = list(text)
            for _ in range(len(text) * percent // 100):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "zz"])
            pair = [fingerprints([text, "".join(copy)], p) for p in independent(WalkParams(), 2)]
            found[percent].append([likeness(a, b) >= 0.7 for a, b in pair])
    one, any_ = ({k: np.mean([f(x) for x in v]) for k, v in found.items()} for f in (lambda x: x[0], any))
    assert any_[1] >= 0.9 and any_[2] >= 0.6 and all(any_[k] > one[k] for k in found), (one, any_)


def test_edit_classes_on_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in edit_classes(spark, sf_dir).collect()}
    assert got.keys() == texts.keys() and all(c <= k and got[c] == c for k, c in got.items())
    codes = [dict(zip(texts, fingerprints(list(texts.values()), p), strict=True)) for p in independent(WalkParams(), 2)]
    label = {k: k for k in texts}  # brute force: all pairs whose fingerprints of some walk agree enough
    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[:i]:
            if any(likeness(c[a], c[b]) >= 0.7 for c in codes) and len(texts[a]) and len(texts[b]):
                old, new = sorted((label[a], label[b]))
                label = {k: old if v == new else v for k, v in label.items()}
    assert sum(got[k] == label[k] for k in got) >= 0.99 * len(got)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op10_edit_fingerprint(spark, sf_dir).collect()), key=repr)
    assert got == expected(docs)


@pytest.mark.parametrize("slots", [128, 255, 256, 300])
def test_alike_counts_every_slot(slots):
    codes = np.random.default_rng(5).integers(0, 4, (40, 2, slots)).astype(np.uint8)
    codes[7], codes[30, 1] = codes[3], codes[20, 1]
    side = np.r_[np.zeros(20), np.ones(10), np.full(10, 2)].astype(int)
    for need in (slots // 4, slots):
        want = {(a, b) for a in range(40) for b in range(a + 1, 40) if (side[a] != side[b] or side[b] == 0) and max((codes[a] == codes[b]).sum(axis=1)) >= need}
        assert set(zip(*map(list, alike(codes, side, need)), strict=True)) == want
    assert (3, 7) in want and (20, 30) in want


def test_fingerprints_are_kept_as_bytes(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(fingerprint, "checkpointed", lambda df: kept.append(df.schema) or df)
    docs = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, None), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_texts(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, None: None}
    assert [s["code"].dataType.simpleString() for s in kept] == ["binary", "binary"] and not any("fingerprint" in s.names for s in kept)
