"""Operator 12 against SQL and plain versions, and on awkward rows."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import infilling
from seriesloom.llm.oracle import ORACLE_SQL
from tests.llm.helpers import rows_of
from tests.support import same_values


@pytest.mark.parametrize("kind", ["sparse", "dense", "runs", "mixed", "empty"])
def test_select_equals_sorted_list(kind):
    rnd = np.random.default_rng(3)
    members = {
        "sparse": np.unique(rnd.integers(0, 1 << 24, 5_000)),
        "dense": np.unique(rnd.integers(0, 1 << 18, 120_000)),
        "runs": np.arange(70_000, 300_000),
        "empty": np.zeros(0, np.int64),
    }.get(kind)
    if kind == "mixed":
        members = np.unique(np.concatenate([
            rnd.integers(0, 1 << 16, 200),
            rnd.integers(1 << 16, 1 << 17, 40_000),
            np.arange(1 << 17, (1 << 17) + 30_000),
            rnd.integers(1 << 22, 1 << 23, 500),
        ]))
    found = infilling.BoundarySet.of(members.astype(np.int64))
    assert len(found) == len(members)
    for k in [*range(min(50, len(members))), *rnd.integers(0, max(1, len(members)), 500)]:
        if k < len(members):
            assert found.select(int(k)) == members[k]
    with pytest.raises(IndexError):
        found.select(len(members))
    if kind == "mixed":
        assert {c[0] for c in found.containers} == {0, 1, 2}


def test_cuts_are_at_units():
    rnd = random.Random(4)
    for number in range(300):
        text = "".join(rnd.choice(["a", "\n", "\r", "ü", "語", "👩", " "]) for _ in range(rnd.randint(0, 60)))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        raw = np.frombuffer(text.encode(), np.uint8)
        n, form, prefix, middle, output = infilling.transform(raw, number)
        h1, h2, _, h4 = infilling.choices(number, 7)
        assert n == len(units)
        if not text:
            assert form == "plain" and output == b""
            continue
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        parts = ["".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])]
        assert (prefix, middle) == (len(parts[0]), len(parts[1]))
        want = f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}" if h4 % 100 < 50 else f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"
        assert output.decode() == want and form == ("spm" if h4 % 100 < 50 else "psm")


def test_query_equals_sql(docs, none, spark):
    tricky = ["<P", "<S>x", "a\n<\nS>\n<M\n>", "\n\n\n", "x\n" * 70_000, "é\n<P\n" * 9, "<<P>>"]
    more = spark.createDataFrame(
        [(300 + i, t * (1 + i % 2)) for i, t in enumerate(tricky * 6)], "doc_id bigint, text string"
    )
    table = docs.select("doc_id", "text").union(more)
    database = duckdb.connect()
    frame = table.toArrow()
    database.register("documents", frame)
    want = database.sql(f"SELECT COLUMNS(*)::VARCHAR FROM ({ORACLE_SQL['op12_fill_in_middle']})").df()
    got = infilling.digests(table)
    got = got.select(*[F.col(c).cast("string") for c in got.columns])
    assert same_values(got.toPandas(), want) == ""
    assert infilling.digests(none).count() == 0


def test_restores_every_text(docs):
    got = infilling.transformed(docs).withColumn("back", infilling.restored(F.col("output"), F.col("form")))
    back = sorted(map(str, (r["back"] for r in got.collect())))
    assert back == sorted((r["text"] or "") for r in docs.collect())
    assert infilling.digests(docs).where("form = 'plain' and prefix_chars is not null").count() == 0


def test_share_of_plain_documents(docs):
    none_changed = infilling.Settings(transformed=0)
    assert {r[2] for r in rows_of(infilling.transformed(docs, none_changed))} == {"plain"}
    assert len(rows_of(infilling.transformed(docs))) == docs.count()
