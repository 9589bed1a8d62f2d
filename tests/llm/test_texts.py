"""Operators 2, 4 and 10 against plain versions, and on awkward rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from seriesloom.llm import bpe, packing, quality_rules
from seriesloom.llm.oracle import ORACLE_SQL
from tests.llm.helpers import rows_of
from tests.support import same_values


def test_rules_equal_sql(docs, spark):
    extra = spark.createDataFrame(
        [(200, "a b c d e f g h i j a b c d e a b c d e x y z\n\n x \n x \n x"), (201, "# $ % a")],
        "doc_id bigint, text string",
    )
    table = docs.select("doc_id", "text").union(extra).distinct()
    database = duckdb.connect()
    frame = table.toPandas()
    database.register("documents", frame)
    want = database.sql(ORACLE_SQL["op2_quality_rules"]).df()
    assert same_values(quality_rules.verdicts(table).toPandas(), want) == ""


def test_rules_awkward_and_native(docs, none):
    result = quality_rules.verdicts(docs)
    got = rows_of(result)
    assert len(got) == docs.count()
    assert {r[0]: r[1] for r in got}[3] == 0 and all(r[6] for r in got if r[0] in (3, 4, 5))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert quality_rules.verdicts(none).count() == 0


@pytest.fixture(scope="module")
def reference_encoding():
    with open(bpe.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_encoding_equals_library(docs, none, sample, reference_encoding):
    table = docs.select("doc_id", "text").unionByName(sample[0].select("doc_id", "text"))
    texts = Counter((r["doc_id"], r["text"]) for r in table.collect())
    want = Counter()
    for (doc_id, text), n in texts.items():
        ids = reference_encoding.encode_ordinary(text or "")
        ids_hash = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[doc_id, len(ids), ids_hash, hashlib.sha256((text or "").encode()).hexdigest()] += n
    assert Counter(rows_of(bpe.encoded(table))) == want
    assert bpe.encoded(none).count() == 0


def test_merges_are_leftmost_and_lowest(reference_encoding):
    rnd = random.Random(2)
    pieces = {"".join(rnd.choice("aabnth e") for _ in range(rnd.randint(1, 40))) for _ in range(300)}
    pieces = sorted(p.encode() for p in pieces)
    n_ids, ids, n_bytes, decoded = bpe.encode_pieces(pieces)
    at = np.cumsum(n_ids) - n_ids
    for piece, a, n in zip(pieces, at, n_ids):
        want = reference_encoding._core_bpe.encode_single_piece(piece)
        assert ids[a : a + n].tolist() == want
    assert decoded.tobytes() == b"".join(pieces) and n_bytes.sum() == len(decoded)


def test_fast_ids_equal_the_tokenizer_file(docs, sample):
    own = Tokenizer.from_file(packing.VOCABULARY)
    encode = packing._encoder(packing.VOCABULARY)
    texts = [r["text"] or "" for r in docs.select("text").union(sample[0].select("text")).collect()]
    texts += ["a <|endoftext|> b", "'s 's'll  \n\t x", "  é"]
    for text in texts:
        assert encode(text) == own.encode(text, add_special_tokens=False).ids


def _check_packing(table, result):
    encode = packing._encoder(packing.VOCABULARY)
    pieces = {}
    for r in result.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    texts = {}
    for r in table.collect():
        texts.setdefault(r["doc_id"], []).append([*encode(r["text"] or ""), 0])
    assert set(pieces) == set(texts)
    for doc_id, found in texts.items():
        want = Counter()
        for ids in found:
            assert all(len(ids) == p["doc_tokens"] for p in pieces[doc_id]) or len(found) > 1
            want[len(ids)] += len(ids)
        got = Counter()
        for p in pieces[doc_id]:
            got[p["doc_tokens"]] += p["length"]
            same = [i for i in found if len(i) == p["doc_tokens"]]
            crcs = {zlib.crc32(np.array(i[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for i in same}
            assert p["ids_crc32"] in crcs
        assert got == want
    sequences = {}
    for rows in pieces.values():
        for p in rows:
            sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(n for parts in sequences.values() for _, n in parts) / len(sequences) / packing.CAPACITY


def test_packing_is_exact_and_full(docs, none, sample):
    table = sample[0].select("doc_id", "text")
    assert _check_packing(table, packing.pack(table)) > 0.99
    _check_packing(docs, packing.pack(docs))
    assert packing.pack(none).count() == 0


def test_knapsack_and_plan_against_brute_force():
    rnd = random.Random(7)
    for _ in range(20):
        lengths = np.array(sorted(rnd.sample(range(2, 20), 4)))
        prices = np.array([rnd.random() for _ in lengths])
        best = [0.0] * 31
        for room in range(1, 31):
            best[room] = max([best[room - 1]] + [best[room - x] + p for x, p in zip(lengths, prices) if x <= room])
        value, chosen = packing.knapsack(prices, lengths, 30)
        assert value == pytest.approx(best[30])
        assert sum(lengths[i] * n for i, n in chosen.items()) <= 30
    histogram = {x: rnd.randint(1, 500) for x in range(1, 65)}
    plan = packing.plan(histogram, 64)
    taken, fill = set(), Counter()
    for length, n in histogram.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            for k in range(o, o + length):
                assert (s, k) not in taken
                taken.add((s, k))
            fill[s] += length
    assert max(fill.values()) <= 64 and len(fill) == plan.sequences
    assert plan.sequences <= 1.05 * sum(k * n for k, n in histogram.items()) / 64 + 1
