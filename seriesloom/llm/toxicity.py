"""Operator 5: toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters of other scripts, accents kept apart, digits and signs
that stand for letters), then one Aho-Corasick pass finds lexicon entries and exception phrases.
An entry counts if it starts where a word starts and, unless it is a stem, ends where one ends;
an entry inside an exception phrase does not count. The weights of the entries found are summed
and normalised by the number of words; a logistic curve of the sum and the normalised sum
gives the score.

Entries are a fixed list of insults plus words and word beginnings learned from labelled rows
(weight: log ratio of their rates). The labelled sample is bounded.

Defined results: null and empty texts hold no entry and score as such. Repeated rows each get
their row; other columns are not read. Without labelled rows the fixed list and default curve
stand.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm.common import crc_fold, labelled_sample

SAMPLE_PER_CLASS = {0: 2500, 1: 1200}
SAMPLE_CHARS = 30_000
STEM_LENGTHS = range(4, 9)
LEAST_CONTEXTS = 8

# Insults that need no labels.
INSULTS = (
    "asshole bastard bitch bullshit clown creep crap cretin cunt damn dickhead disgusting dumbass "
    "faggot fuck fucker fucking garbage idiot idiotic imbecile jerk loser moron motherfucker "
    "nigger pathetic prick retard scum scumbag shit shithead slut stupid trash vermin whore "
    "worthless arschloch dummkopf miststück idioten schlampe wichser connard salope enculé "
    "abruti cabrón gilipollas imbécil pendejo puta"
).split()
# Phrases in which such a word is no insult.
EXCEPTIONS = (
    "trash can|trash cans|trash bin|trash bag|trash collection|clown fish|class clown costume|"
    "circus clown|garbage collection|garbage collector|garbage truck|damn good|pond scum|"
    "soap scum|jerk chicken|knee jerk|shit happens"
).split("|")
# Characters that stand for a Latin letter.
LOOKALIKES = {
    **dict(zip("аеорсхуіјѕԁһԛԝɡАВЕКМНОРСТХІЈЅ", "aeopcxyijsdhqwgabekmhopctxijs")),
    **dict(zip("αοριντυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aopivtukabezhikmnoptyx")),
}
DIGITS = dict(zip("013457@$", "oieastas"))
_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()}
_FOLD.update({code: chr(code - 0xFEE0).lower() for code in range(0xFF01, 0xFF5F)})
_LEET = {ord(k): v for k, v in DIGITS.items()}
# Digits and signs before a letter, or one or two digits that end a word.
_DISGUISE = re.compile(r"[013457@$]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]{1,2}(?!\w)")
_WORDS = re.compile(r"\w+")
_FOREIGN = re.compile("[" + re.escape("".join(map(chr, [*_FOLD, *_INVISIBLE]))) + "\u0300-\u036f]")


def fold(text: str) -> str:
    """Lower case, look-alikes and full-width forms to Latin, hidden characters out, digit
    substitutions inside words undone. Numbers and signs after a word stay."""
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = unicodedata.normalize("NFC", text).translate(_FOLD).translate(_INVISIBLE)
    return _DISGUISE.sub(lambda m: m.group().translate(_LEET), text)


@dataclass
class Lexicon:
    """Weights of words and stems, exception phrases, and the curve from sums to a score."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = tuple(EXCEPTIONS)
    curve: tuple[float, float, float] = (-3.0, 1.0, 20.0)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for kind, known in (("word", self.words), ("stem", self.stems)):
            for entry, weight in known.items():
                entries.setdefault(entry, []).append((kind, len(entry), weight))
        for phrase in self.exceptions:
            entries.setdefault(phrase, []).append(("not", len(phrase), 0.0))
        for entry, meanings in entries.items():
            machine.add_word(entry, tuple(meanings))
        if entries:
            machine.make_automaton()
        return machine


def hits(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries that count in a folded text."""
    found, spared = [], []
    if not len(machine):
        return []
    size = len(text)
    for last, meanings in machine.iter(text):
        end = last + 1
        for kind, length, weight in meanings:
            start = end - length
            if start and text[start - 1].isalnum():
                continue
            closed = end == size or not text[end].isalnum()
            if kind == "stem" or closed:
                (spared if kind == "not" else found).append((start, end, weight))
    if spared and found:
        spared.sort()
        starts = [s for s, _, _ in spared]
        # The furthest end of the phrases that begin up to each one.
        reach = list(accumulate((e for _, e, _ in spared), max))
        at = (bisect_right(starts, h[0]) for h in found)
        found = [h for h, i in zip(found, at) if not i or reach[i - 1] < h[1]]
    best: dict[int, tuple[int, int, float]] = {}
    for hit in found:  # one entry per place, the heaviest
        if hit[0] not in best or hit[2] > best[hit[0]][2]:
            best[hit[0]] = hit
    return list(best.values())


def measures(text: str, machine: ahocorasick.Automaton) -> tuple[float, float]:
    """Sum of weights and its share per word."""
    folded = fold(text)
    total = sum(h[2] for h in hits(folded, machine))
    return (total, total / (1 + len(folded.split()))) if total else (0.0, 0.0)


def _score(total: float, share: float, curve: tuple[float, float, float]) -> float:
    x = curve[0] + curve[1] * math.log1p(total) + curve[2] * share
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _contexts(texts: list[str], known: set[str] | None = None) -> dict[str, set[str]]:
    """For each word and word beginning (marked ``*``) the distinct pairs of the word before and
    the word itself. Copies of a text give the same pairs, so they count once."""
    found: dict[str, set[str]] = {}
    for text in texts:
        before = ""
        for word in _WORDS.findall(fold(text)):
            pair = f"{before} {word}"
            for piece in (word, *[word[:n] + "*" for n in STEM_LENGTHS if len(word) > n]):
                if known is None or piece in known:
                    found.setdefault(piece, set()).add(pair)
            before = word
    return found


def learn(sample: list[tuple[str, int]]) -> Lexicon:
    """Lexicon from labelled texts.

    A word or word beginning enters if it stands in at least ``LEAST_CONTEXTS`` different contexts
    (and one per hundred toxic texts) and its odds there are 50 times those in clean texts. A
    beginning enters only if no single word makes up half of it, and as the longest of those
    that are as frequent.
    """
    toxic = sorted({t for t, y in sample if y == 1})
    clean = sorted({t for t, y in sample if y == 0})
    lexicon = Lexicon({w: 3.0 for w in INSULTS})
    if not toxic or not clean:
        return lexicon
    least = max(LEAST_CONTEXTS, len(toxic) / 100)
    mine = {p: c for p, c in _contexts(toxic).items() if len(c) >= least}
    other = _contexts(clean, set(mine))
    weights = {}
    for piece, contexts in mine.items():
        n, m = len(contexts) / len(toxic), len(other.get(piece, ())) / len(clean)
        if n >= 50 * m:
            weights[piece] = math.log((n + 0.5 / len(toxic)) / (m + 0.5 / len(clean)))
    for piece, weight in weights.items():
        if not piece.endswith("*"):
            lexicon.words[piece] = weight
            continue
        words = Counter(c.partition(" ")[2] for c in mine[piece])
        size, top = sum(words.values()), words.most_common(1)[0][1]
        longer = [p for p in weights if p.endswith("*") and len(p) == len(piece) + 1 and p.startswith(piece[:-1])]
        if top <= size / 2 and not any(len(mine[p]) >= 0.95 * size for p in longer):
            lexicon.stems[piece[:-1]] = weight
    machine = lexicon.automaton()
    x = np.array([measures(t, machine) for t, _ in sample])
    lexicon.curve = _fit_curve(np.log1p(x[:, 0]), x[:, 1], np.array([y for _, y in sample]))
    return lexicon


def _fit_curve(total: np.ndarray, share: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    x = np.stack([np.ones(len(y)), total, share], 1)
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        beta -= np.linalg.solve(hess, grad)
    return tuple(float(b) for b in (beta[0], max(0.0, beta[1]), max(0.0, beta[2])))


def score(docs: DataFrame, lexicon: Lexicon, held_folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, curve = lexicon.automaton(), lexicon.curve
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p = np.array([_score(*measures(text or "", machine), curve) for text in texts])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(p, pa.float64()),
                    pa.array((p >= 0.5).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", "text", (crc_fold(held_folds) == 0).alias("held_out"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {id_type}, held_out boolean, score double, predicted int"
    )


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents with a score under 0.5, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, curve = lexicon.automaton(), lexicon.curve
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(
                pa.array([_score(*measures(t or "", machine), curve) < 0.5 for t in texts], pa.bool_())
            )

    return docs.mapInArrow(run, docs.schema)


def learned_lexicon(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon from the labelled rows outside fold 0."""
    return learn(labelled_sample(docs, labels, "toxic", 5, 0, SAMPLE_PER_CLASS, SAMPLE_CHARS))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside fold 0 and score all documents."""
    return score(docs, learned_lexicon(docs, labels))
