"""The pipeline: each stage's decisions on planted documents, and its columns."""

import random

import corpus_pipeline
from seriesloom.llm import queries
from tests.llm.helpers import rows_of

WORDS = (
    "river stone garden window market letter bridge summer winter forest mountain village "
    "teacher morning evening doctor number people water bread horse church school street"
).split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _text(seed, n=120):
    rnd = random.Random(seed)
    return " ".join(["the", *[rnd.choice(WORDS) + rnd.choice(["", "s", "ly", "er"]) for _ in range(n)]])


def test_stages_are_five_and_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "passages", "packing"]
    assert {k.split("_")[0] for k in queries.REGISTRY} == {f"op{n}" for n in range(1, 14)}


def test_planted_documents(spark, tmp_path):
    passage = _text(1, 60)
    texts = {i: _text(100 + i) for i in range(30)}
    texts[40] = texts[3]  # exact copy
    texts[41] = texts[4].replace("the ", "The ", 1)  # copy but for case
    texts[42] = _text(200) + " you stupid worthless idiot " + _text(201, 10)
    texts[43] = "12345 67890"
    texts[44] = _text(300) + " " + passage
    texts[45] = passage + " " + _text(301)
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = out.collect()
        seen[name] = {r["doc_id"]: r["text"] for r in found}
        docs = spark.createDataFrame(found, SCHEMA)
    assert set(texts) - set(seen["toxicity"]) == {42}
    assert set(seen["toxicity"]) - set(seen["language"]) == {43}
    assert set(seen["language"]) - set(seen["near_copies"]) == {40, 41}
    kept = seen["passages"]
    assert passage in kept[44] and passage not in kept[45] and len(kept[45]) > 300
    assert all(kept[i] == texts[i] for i in range(30))
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    assert {r[0] for r in rows_of(packed.select("doc_id"))} == set(kept)


def test_run_over_the_smallest_tables(spark):
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = result.collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(result.columns)


def test_rows_are_decided_one_by_one(spark, tmp_path):
    """Ids that repeat with other texts, equal rows and null ids, through each stage and all."""
    u, v, w, x = (_text(700 + i) for i in range(4))
    given = [(3, w), (5, v), (5, w), (7, u), (7, u), (None, x), (None, x), (None, v)]
    rows = [(i, t, "en", None, len(t)) for i, t in given]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted([(3, w), (5, v), (7, u), (None, x)], key=str)
    shown = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    near = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, str(tmp_path))
    assert near.columns == docs.columns and shown(near) == want
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, str(tmp_path)).cache()
    assert shown(docs) == want
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    assert {r[0] for r in rows_of(packed.select("doc_id"))} == {3, 5, 7, None}
