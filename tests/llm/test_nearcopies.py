"""The pipeline's near-copy stage against the exact similarity of five-word shingles."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import nearcopies, simhash
from tests.llm.helpers import SCHEMA, awkward, rows_of


def _words(rnd, n):
    return [f"w{rnd.randrange(4000)}" for _ in range(n)]


def _edited(rnd, words, edits):
    out = list(words)
    for at in rnd.sample(range(len(out)), edits):
        out[at] = f"e{rnd.randrange(10**6)}"
    return out


def _similarity(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def _bits(a, b):
    one, other = simhash.fingerprints([" ".join(t).encode() for t in (a, b)], 5)
    return int(np.bitwise_count(one ^ other))


def _pairs(seed, edits, wanted, number):
    """Pairs of texts with that many edits for which ``wanted(similarity, differing bits)`` holds."""
    rnd, found = random.Random(seed), []
    while len(found) < number:
        a = _words(rnd, 60)
        b = _edited(rnd, a, edits)
        if wanted(_similarity(a, b), _bits(a, b)):
            found.append((" ".join(a), " ".join(b)))
    return found


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)


def _kept(spark, texts):
    return {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, _docs(spark, texts), "").collect()}


def test_similar_texts_with_far_fingerprints_go(spark):
    pairs = _pairs(1, 1, lambda s, bits: s >= 0.8 and bits > 8, 20)
    assert _kept(spark, [t for p in pairs for t in p]) == set(range(0, 40, 2))


def test_unlike_texts_with_near_fingerprints_stay(spark):
    pairs = _pairs(2, 3, lambda s, bits: s < 0.8 and bits <= 6, 10)
    assert _kept(spark, [t for p in pairs for t in p]) == set(range(20))


def _families(seed):
    """Texts of a few families with similarities on both sides of the limit, and chains."""
    rnd, texts = random.Random(seed), []
    for _ in range(6):
        base = _words(rnd, 80)
        texts += [_edited(rnd, base, rnd.choice([1, 1, 2, 3])) for _ in range(12)]
        for _ in range(6):
            texts.append(base)
            base = _edited(rnd, base, 1)
    rnd.shuffle(texts)
    return texts


def _brute(texts):
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if _similarity(texts[a], texts[b]) >= 0.8 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return list(enumerate(label))


def test_groups_equal_brute_force_in_whole_and_dealt_buckets(spark, monkeypatch):
    texts = _families(3)
    docs, expected = _docs(spark, [" ".join(t) for t in texts]), _brute(texts)
    assert sorted(rows_of(nearcopies.components(docs))) == expected
    monkeypatch.setattr(nearcopies, "BLOCK", 3)
    assert sorted(rows_of(nearcopies.components(docs))) == expected


def test_a_text_unlike_the_first_of_its_bucket_is_tested_with_the_others(spark):
    texts = [" ".join(t) for t in _families(4)[:40]]
    fps = nearcopies.digests([t.encode() for t in texts]).tolist()
    rows = [(0, fp, fp) for fp in fps]
    buckets = spark.createDataFrame(rows, "key bigint, fp bigint, a bigint")
    known = spark.createDataFrame(list(zip(fps, texts)), "fp bigint, text string")
    none = spark.createDataFrame([], "a bigint, b bigint")
    found = rows_of(nearcopies.further_links(buckets, none, known))
    label = list(range(len(texts)))
    for a, b in found:
        low, high = sorted((label[fps.index(a)], label[fps.index(b)]))
        label = [low if x == high else x for x in label]
    assert list(enumerate(label)) == _brute([t.split() for t in texts])


def test_awkward_rows(spark):
    groups = nearcopies.components(awkward(spark))
    assert sorted(rows_of(groups), key=str) == sorted(
        [(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (8, 8), (None, None), (9, 9)], key=str
    )
    assert rows_of(nearcopies.components(awkward(spark).limit(0))) == []


def _fingerprint(words):
    return int(simhash.fingerprints([" ".join(words).encode()])[0])


def _near_families(seed):
    """Long texts with one or two words changed, so that many fingerprints are within the radius."""
    rnd, texts = random.Random(seed), []
    for _ in range(8):
        base = _words(rnd, 300)
        texts += [base, *(_edited(rnd, base, rnd.choice([1, 1, 2, 5])) for _ in range(4))]
    return texts


def test_operator_7_links_are_tested_pairs(spark):
    texts = _near_families(5) + [["a"], ["b"], ["A"]]
    prints = nearcopies._print_table(_docs(spark, [" ".join(t) for t in texts]), 5)
    distinct = prints.dropDuplicates(["fp"]).cache()
    fps = {r["fp"]: texts[r["doc_id"]] for r in distinct.collect()}
    label = {fp: fp for fp in fps}
    for a, _, b, _ in rows_of(nearcopies.fingerprint_pairs(distinct)):
        assert a < b and (_fingerprint(fps[a]) ^ _fingerprint(fps[b])).bit_count() <= simhash.RADIUS
        label = {k: label[a] if x == label[b] else x for k, x in label.items()}
    near = [(a, b) for a in fps for b in fps if a < b and (_fingerprint(fps[a]) ^ _fingerprint(fps[b])).bit_count() <= 4]
    assert len(near) > 8 and all(label[a] == label[b] for a, b in near)


def test_copies_are_found_by_operator_7_without_other_keys(spark, monkeypatch):
    """Links of the operator reach the exact test by themselves; those that fail it link nothing."""
    prints = nearcopies._print_table
    monkeypatch.setattr(
        nearcopies, "_print_table", lambda *a: prints(*a).withColumn("keys", F.array().cast("array<bigint>"))
    )
    rnd, pairs = random.Random(6), []
    while len(pairs) < 16:
        alike = len(pairs) < 10
        a = _words(rnd, 120 if alike else 60)
        b = _edited(rnd, a, 1 if alike else 3)
        near = (_fingerprint(a) ^ _fingerprint(b)).bit_count() <= simhash.RADIUS
        if near and (_similarity(a, b) >= 0.8) == alike:
            pairs.append((" ".join(a), " ".join(b)))
    assert _kept(spark, [t for p in pairs for t in p]) == set(range(32)) - set(range(1, 20, 2))
