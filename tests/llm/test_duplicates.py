"""Operators 6, 7 and 8 against brute force, and on awkward rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from seriesloom.llm import components, simhash, suffix, vectors
from tests.llm.helpers import rows_of


# --- suffix index ------------------------------------------------------------------------------


def _passages(rows):
    """What is removed, from a table of every 50-byte string's smallest id."""
    size, last = suffix.LENGTH, float("inf")
    key = lambda i: last if i is None else i
    smallest = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for at in range(len(data) - size + 1):
            string = data[at : at + size]
            smallest[string] = min(smallest.get(string, last), key(doc_id))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - size + 1):
            if smallest[data[at : at + size]] < key(doc_id):
                gone[at : at + size] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _copies(seed, alphabet, n=24):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([60, 90, 200]))) for _ in range(5)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rnd.randint(0, 4)):
            s = rnd.choice(base)
            a = rnd.randint(0, len(s))
            text += s[a : rnd.randint(a, len(s))] if rnd.random() < 0.6 else s
            text += rnd.choice(alphabet) if rnd.random() < 0.3 else ""
        rows.append((i if rnd.random() < 0.9 else 3, text if rnd.random() < 0.9 else "a" * 130))
    return [*rows, (None, base[0]), (None, base[0]), (77, None), (78, "")]


@pytest.mark.parametrize("seed,alphabet", [(1, "ab"), (2, "abcdé "), (3, "abcdefghijklmnop ")])
def test_removals_equal_brute_force(spark, seed, alphabet):
    rows = _copies(seed, alphabet)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(rows_of(suffix.removals(table)), key=str) == _passages(rows)


def test_removals_of_sample_equal_brute_force(sample):
    table = sample[0].select("doc_id", "text")
    assert sorted(rows_of(suffix.removals(table)), key=str) == _passages(rows_of(table))


def test_run_index_maps_and_locates():
    texts = [b"banana", b"ananas", b"bandana", b"a"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    index = suffix.RunIndex(data, sizes, np.array([4, 2, 3, 1]), 3)
    whole = b"\0".join(texts) + b"\0"
    suffixes = sorted(range(index.n), key=lambda i: (whole[i : whole.index(b"\0", i)], i))
    assert index.order.tolist() == suffixes
    assert [index.locate(r) for r in range(index.n)] == suffixes
    assert len(index.starts) < index.n
    for text, place, owner in zip(*index.owners_along(sizes)):
        string = texts[text][place : place + 3]
        assert owner == min(i for t, i in zip(texts, [4, 2, 3, 1]) if string in t)


def test_passages_awkward(docs, none):
    got = rows_of(suffix.removals(docs))
    assert got and len(got) == docs.count()
    by_id = {r[0]: r for r in got}
    assert by_id[1][2] == 0 and by_id[2][2] == by_id[2][1] and by_id[3][1] == 0
    cut = suffix.without_passages(docs)
    assert cut.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in cut.collect()) == sorted("1 3 4 5 6 7 8 9 None".split())
    assert suffix.removals(none).count() == 0 and suffix.without_passages(none).count() == 0


# --- covering hashes ------------------------------------------------------------------------------


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_xxh64_equals_library():
    rnd = random.Random(1)
    spans = [bytes(rnd.randrange(256) for _ in range(n)) for n in [*range(1, 80), 200, 33, 32]]
    data = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(s) for s in spans])
    got = simhash.xxh64(data, np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [xxhash.xxh64_intdigest(s, 42) for s in spans]


def test_every_close_pair_collides():
    masks = simhash.covering_masks()
    assert len(masks) == 31 and min(int(m).bit_count() for m in masks) >= 32
    rnd = random.Random(3)
    for _ in range(3000):
        flip = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(flip & int(m) == 0 for m in masks)


def _smallest(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_equal_brute_force(spark, docs, sample):
    texts = [r["text"] for r in sample[0].collect()]
    rnd = random.Random(5)
    for t in texts[:60]:  # near copies
        words = t.split(" ")
        words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, "one two", "ONE\ttwo"]
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = [_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    label = _smallest(len(texts), links)
    want = sorted((i, f"{p:016x}", label[i]) for i, p in enumerate(prints))
    assert sorted(rows_of(simhash.components(table))) == want


def test_forest_spans_dense_groups():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = np.unique([c ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(d)) for c in centre for b in range(64) for d in range(b)])
    links = simhash.forest(values)
    assert len(links) == len(values) - 3
    assert all(int(values[a] ^ values[b]).bit_count() <= 4 for a, b in links)


def test_simhash_awkward(docs, none):
    got = rows_of(simhash.components(docs))
    assert len(got) == docs.count()
    by_id = {r[0]: r for r in got}
    assert by_id[2][2] == 1 and by_id[4][1:] == ("0" * 16, 3) and by_id[3][2] == 3
    assert simhash.components(none).count() == 0


def test_stars_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1000)]
    links = spark.createDataFrame(chain, "a bigint, b bigint").repartition(16)
    stars = dict(rows_of(components.stars(links)))
    assert stars == {**{i: 0 for i in range(1, 401)}, 1001: 1000}


# --- vectors -----------------------------------------------------------------------------------


def _vector_rows(n=400, width=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=width)
        if i % 4 == 1:
            v = np.array(rows[-1][1]) + rng.normal(size=width) * 0.02
        if i % 25 == 2:
            v = np.array(rows[-1][1])
        rows.append((i, [float(np.float32(x)) for x in v], i // 4 % 3))
    return rows


def _vector_truth(rows):
    links = []
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if la is not None and la == lb:
                x, y = np.array(a), np.array(b)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((i, j))
    label = _smallest(len(rows), links)
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return [(rows[i][0], count[i], rows[label[i]][0], label[i] == i) for i in range(len(rows))]


def test_vector_links_equal_brute_force(spark):
    rows = _vector_rows()
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    want = _vector_truth(rows)
    got = sorted(rows_of(vectors.near_duplicates(table)))
    assert got == want


def test_links_across_list_borders_count_at_both_ends(spark):
    """Vectors along an arc of one label, which every border between lists cuts."""
    n, size = 900, 64
    rnd = np.random.default_rng(8)
    one, other = np.linalg.qr(rnd.normal(size=(size, 2)))[0].T
    angles = np.linspace(0, np.pi, n)
    arc = np.outer(np.cos(angles), one) + np.outer(np.sin(angles), other)
    arc = arc.astype(np.float32)
    table = spark.createDataFrame(
        [(i, a.tolist(), 1) for i, a in enumerate(arc)], "vec_id bigint, embedding array<float>, label int"
    )
    exact = arc.astype(np.float64)
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.98).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in vectors.near_duplicates(table).collect()}
    assert [got[i]["n_links"] for i in range(n)] == want.tolist()
    assert {r["component_id"] for r in got.values()} == {0}


def test_vectors_awkward(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1),
        (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [1.0, None], 0),
        (9, [float("nan"), 1.0], 0), (10, [float("inf"), 1.0], 0), (None, [1e38, 0.0], 0),
        (11, [1.0, 0.0, 0.0], 0),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    table = table.selectExpr("*", "1 AS n", "2 AS a", "3 AS _key")
    got = sorted(rows_of(vectors.near_duplicates(table)), key=str)
    linked = {(1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, None)}
    alone = {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)}
    assert set(got) == linked | alone and len(got) == len(rows)
    assert vectors.near_duplicates(table.limit(0)).count() == 0
