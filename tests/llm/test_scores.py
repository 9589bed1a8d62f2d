"""Operators 1, 3 and 5: held-out accuracy, brute-force code lengths, folding, awkward rows."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import langid, quality, toxicity
from seriesloom.llm.common import packed
from tests.llm.helpers import rows_of

GOOD = "the house stands on a hill and people come from far to see the old garden".split()


def _texts(n, junk, seed):
    rnd = random.Random(seed)
    return [
        " ".join(rnd.choice(GOOD) + ("###" if junk and rnd.random() < 0.7 else "") for _ in range(40))
        for _ in range(n)
    ]


def test_quality_learns_held_out_texts():
    train = [(t, 1) for t in _texts(60, False, 1)] + [(t, 0) for t in _texts(60, True, 2)]
    model = quality.fit(train, bits=12, epochs=6)
    for junk, want in ((False, 1), (True, 0)):
        offsets, data = packed(pa.array(_texts(30, junk, 9)))
        p = quality.probabilities(offsets, data, model.folded(), model.bias, 12)[:, 1]
        assert ((p >= 0.5) == want).mean() >= 0.95


def test_quality_score_equals_mean_of_rows():
    """The folded form equals the mean of embedding rows through the layer, text by text."""
    texts = ["ab cde ab ab", "", "x", " leading  and trailing ", "ünï cödé\nline two two"]
    rng = np.random.default_rng(1)
    model = quality.SubwordModel(rng.normal(size=(256, 4)), rng.normal(size=(4, 2)), np.ones(2), 8)
    offsets, data = packed(pa.array(texts))
    got = quality.probabilities(offsets, data, model.folded(), model.bias, 8)
    for text, p in zip(texts, got):
        raw = np.frombuffer(text.encode(), np.uint8)
        found = [b[m] for b, m, _ in quality.features(np.array([0, len(raw)]), raw, 8)]
        buckets = np.concatenate(found) if found else np.zeros(0, int)
        mean = model.table[buckets].mean(0) if len(buckets) else np.zeros(4)
        logits = mean @ model.layer + model.bias
        want = np.exp(logits - logits.max())
        assert np.allclose(p, want / want.sum(), atol=1e-5)


def test_quality_awkward(docs, none, spark):
    model = quality.fit([(t, 1) for t in _texts(5, False, 1)] + [(t, 0) for t in _texts(5, True, 2)], bits=8)
    got = rows_of(quality.score(docs, model))
    assert len(got) == docs.count() and all(0 <= r[2] <= 1 for r in got)
    assert quality.score(none, model).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r[2] for r in rows_of(quality.quality_scores(docs, labels))} == {0.5}


def _brute_bits(samples, order, text):
    """Code length of a text, byte by byte, from counted contexts."""
    data = b"\n" + b"\n".join(samples) + b"\n"
    counts = [{} for _ in range(order + 1)]
    for k in range(order + 1):
        for i in range(k, len(data)):
            counts[k].setdefault(data[i - k : i], {}).setdefault(data[i], 0)
            counts[k][data[i - k : i]][data[i]] += 1
    total, past = 0.0, bytes(order) + b"\n"
    for b in text:
        for k in range(order, -1, -1):
            seen = counts[k].get(past[len(past) - k :] if k else b"")
            if not seen:
                continue
            t, d = sum(seen.values()), len(seen)
            if b in seen:
                total -= math.log2(seen[b] / (t + d))
                break
            total -= math.log2(d / (t + d))
        else:
            total += 8
        past += bytes([b])
    return total


def test_code_lengths_equal_brute_force():
    samples = {"a": [b"banana bandana", b"abab ab"], "b": ["größe für".encode(), b"xyz"]}
    trees = langid.train(samples, order=3)
    texts = ["banana", "", "für xyz", "qqq 9\n\nab", "b"]
    bits = langid.code_lengths(trees, *packed(pa.array(texts)))
    for i, text in enumerate(texts):
        for j, name in enumerate(trees.languages):
            assert bits[i, j] == pytest.approx(_brute_bits(samples[name], 3, text.encode()), abs=1e-3)


def test_language_of_held_out_documents(sample):
    documents, _ = sample
    got = {r["doc_id"]: r for r in langid.language_predictions(documents).collect()}
    held = [r for r in documents.collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 20
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.9


def test_language_awkward(docs, none):
    got = rows_of(langid.language_predictions(docs))
    assert len(got) == docs.count()
    by_id = {r[0]: r for r in got}
    for unknown in (3, 4, 5, 7):
        assert by_id[unknown][2:] == ("und", 0.0)
    assert by_id[8][2] == "de"
    assert langid.language_predictions(none).count() == 0
    kept = langid.keep_known(docs, langid.train(langid.labelled_texts(docs)))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({3, 4, 5, 7})


def test_folding():
    assert toxicity.fold("1d10t") == "idiot"
    assert toxicity.fold("ѕtupіd") == "stupid"
    assert toxicity.fold("ＬＯＳＥＲ") == "loser"
    assert toxicity.fold("in 2020 for 10$") == "in 2020 for 10$"
    assert toxicity.fold("id​iot") == "idiot"


def test_hits_mind_words_stems_and_exceptions():
    lexicon = toxicity.Lexicon({"trash": 2.0, "ass": 1.0}, {"idio": 3.0}, ("trash can",))
    machine = lexicon.automaton()
    total = lambda text: toxicity.measures(text, machine)[0]
    assert total("class assess passed") == 0
    assert total("the trash can is full") == 0
    assert total("trash cans") == 2.0  # the exception ends inside a word
    assert total("idiotic") == 3.0 and total("an ass, trash!") == 3.0


def test_toxicity_learns_words_and_stems():
    rnd = random.Random(4)
    clean = [" ".join(rnd.choice(GOOD) for _ in range(30)) for _ in range(80)]
    toxic = []
    for i in range(60):
        words = [rnd.choice(GOOD) for _ in range(30)]
        words[rnd.randrange(30)] = "blorg" if i % 2 else f"zwick{rnd.choice(['an', 'el', 'os', 'um', 'ir'])}"
        toxic.append(" ".join(words))
    lexicon = toxicity.learn([(t, 1) for t in toxic] + [(t, 0) for t in clean])
    machine = lexicon.automaton()
    flagged = lambda t: toxicity._score(*toxicity.measures(t, machine), lexicon.curve) >= 0.5
    assert flagged("the old blorg comes") and flagged("the old zw1ckus comes")
    assert not flagged("the old garden comes") and not flagged("")


def test_toxicity_awkward(docs, none, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = rows_of(toxicity.toxicity_scores(docs, labels))
    assert len(got) == docs.count() and {r[3] for r in got} == {0}
    assert toxicity.toxicity_scores(none, labels).count() == 0
    kept = toxicity.keep_clean(docs, toxicity.Lexicon({"fox": 9.0}))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def _plain_measure(text, lexicon):
    """Every place of every entry, every exception compared with every hit."""
    folded = toxicity.fold(text)

    def places(entry, whole):
        for start in range(len(folded) - len(entry) + 1):
            end = start + len(entry)
            if not folded.startswith(entry, start) or (start and folded[start - 1].isalnum()):
                continue
            if whole and end < len(folded) and folded[end].isalnum():
                continue
            yield start, end

    spared = [p for phrase in lexicon.exceptions for p in places(phrase, True)]
    best = {}
    for known, whole in ((lexicon.words, True), (lexicon.stems, False)):
        for entry, weight in known.items():
            for start, end in places(entry, whole):
                if not any(s <= start and end <= e for s, e in spared):
                    best[start] = max(best.get(start, 0.0), weight)
    total = sum(best.values())
    return (total, total / (1 + len(folded.split()))) if total else (0.0, 0.0)


def test_lexicon_sums_equal_plain_matching():
    rnd = random.Random(9)
    lexicon = toxicity.Lexicon(
        {"trash": 1.0, "stupid": 2.0, "can": 0.5}, {"stup": 0.75, "idi": 1.5}, ("trash can", "can of", "stupid idea")
    )
    machine = lexicon.automaton()
    parts = ["trash", "can", "of", "stupid", "idea", "idiot", "7rash", "stupidity", ".", "x"]
    for _ in range(200):
        text = rnd.choice([" ", "", "  "]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert toxicity.measures(text, machine) == pytest.approx(_plain_measure(text, lexicon))


def test_long_texts_with_many_exceptions_take_linear_time():
    machine = toxicity.Lexicon({"stupid": 1.0, "trash": 1.0}, {}, ("trash can",)).automaton()
    started = time.perf_counter()
    total, _ = toxicity.measures("trash can stupid " * 200_000, machine)
    assert total == 200_000 and time.perf_counter() - started < 30
