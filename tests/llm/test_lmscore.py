"""Operator 13 against a plain model over dictionaries, and on awkward rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import lmscore
from seriesloom.llm.triemodel import MISSING, STEPS, EliasFano, Trie
from tests.llm.helpers import rows_of


@pytest.mark.parametrize("top", [1, 70, 5_000, 1 << 40])
def test_sequence_equals_list(top):
    rnd = np.random.default_rng(5)
    values = np.unique(rnd.integers(0, top, 3_000))
    kept = EliasFano.of(values)
    assert (kept.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, rnd.integers(-3, top + 9, 3_000)])
    place = {int(v): i for i, v in enumerate(values)}
    assert kept.find(asked).tolist() == [place.get(int(v), -1) for v in asked]
    assert EliasFano.of(np.zeros(0, np.int64)).find(asked).max() == -1
    repeated = EliasFano.of(np.array([0, 0, 0, 4, 4, 9]))
    assert repeated.get(np.arange(6)).tolist() == [0, 0, 0, 4, 4, 9]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_trie_equals_dictionary(order):
    rnd = np.random.default_rng(order)
    grams = np.unique(rnd.integers(0, 40, (4_000, order)) ** 3, axis=0)
    codes = rnd.integers(0, MISSING, len(grams))
    trie = Trie.of(grams, codes).mapped()
    known = {tuple(g): c for g, c in zip(grams.tolist(), codes.tolist())}
    asked = np.concatenate([grams, rnd.integers(0, 45, (4_000, order)) ** 3])
    assert trie.lookup(asked).tolist() == [known.get(tuple(g), MISSING) for g in asked.tolist()]
    empty = Trie.of(np.zeros((0, order), np.int64), np.zeros(0)).mapped()
    assert (empty.lookup(asked) == MISSING).all()


def _expected(rows):
    def tokens(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\f\r":
            lowered = lowered.replace(c, " ")
        return [w for w in lowered.split(" ") if w] + [None]

    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2

    singles, pairs = Counter(), Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            t = tokens(text)
            singles.update(t)
            pairs.update(zip([None, *t], t))
    n, v = sum(singles.values()), len(singles)
    want = []
    for doc_id, text in rows:
        t = tokens(text)
        alone = [(singles[w] + 1) / (n + v + 1) for w in t]
        base = sum(map(math.log10, alone))
        score = sum(
            math.log10((pairs[a, b] + lmscore.MASS * p) / (singles[a] + lmscore.MASS))
            for a, b, p in zip([None, *t], t, alone)
        )
        want.append((doc_id, held(doc_id), len(t), sum(singles[w] > 0 for w in t), n, base, score))
    return want


def _same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 3))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        # Each of the tokens is off by half a step at most.
        assert abs(g[6] - w[6]) <= w[2] * 0.5 / STEPS + 1e-9


def test_equals_plain_version(docs, none, sample):
    table = docs.select("doc_id", "text").unionByName(sample[0].select("doc_id", "text"))
    want = _expected([tuple(r) for r in table.collect()])
    _same(rows_of(lmscore.scores(table.repartition(4))), want)
    assert lmscore.scores(none).count() == 0


def test_result_does_not_depend_on_blocks_and_shards(docs, sample, monkeypatch):
    table = docs.select("doc_id", "text").unionByName(sample[0].select("doc_id", "text"))
    want = _expected([tuple(r) for r in table.collect()])
    for name, value in (("BLOCK_BYTES", 30_000), ("WORDS_PER_SHARD", 2_000), ("TOKENS_PER_SHARD", 5_000), ("HOT", 3)):
        monkeypatch.setattr(lmscore, name, value)
    _same(rows_of(lmscore.scores(table.repartition(7))), want)


def test_long_texts_are_split_at_white_space(monkeypatch):
    monkeypatch.setattr(lmscore, "STRETCH", 10)
    text = b"Aa bb  CC aa\tdd " * 40 + b"a" * 100 + b" bb"
    known = {}
    codes = lmscore.word_codes(text, known)
    words = text.lower().split()
    assert [list(known)[c] for c in codes] == words


def test_nothing_to_learn_from(docs):
    got = rows_of(lmscore.scores(docs, F.lit(True)))
    assert len(got) == docs.count()
    assert all(r[3] == 0 and r[4] == 0 and r[5] == r[6] == 0 for r in got)


def test_probabilities_sum_to_one():
    count = {("a", "b"): 3, ("a", "c"): 1}
    n, kinds, single = 10, 4, {"a": 4, "b": 3, "c": 2, "d": 1}
    alone = {w: (c + 1) / (n + kinds + 1) for w, c in single.items()} | {"?": 1 / (n + kinds + 1)}
    total = sum((count.get(("a", w), 0) + lmscore.MASS * p) / (4 + lmscore.MASS) for w, p in alone.items())
    assert total == pytest.approx(1)


def test_held_out_texts_gain(sample):
    got = [r for r in rows_of(lmscore.scores(sample[0])) if r[1]]
    assert sum(r[6] for r in got) > sum(r[5] for r in got)
