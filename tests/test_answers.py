import pytest
from pyspark.sql import functions as F

from seriesloom.operators import answers

SCHEMA = "study string, prompt string"


def frame(spark, *prompts):
    return spark.createDataFrame([(f"s{i}", p) for i, p in enumerate(prompts)], SCHEMA)


def responder(log, bad):
    """Writes down what it is asked; refuses a list that holds a bad text."""

    def answer(texts):
        with open(log, "a") as out:
            out.write("".join(f"{t}\n" for t in texts) if len(texts) == 1 else f"{len(texts)} texts\n")
        if bad & set(texts):
            raise ValueError("refused")
        return [None if t == "mute" else t + "!" for t in texts]

    return lambda: answer


def outcome(df, store):
    rows = answers.with_answers(df, store).collect()
    return {r["prompt"]: (r["attempts"], r["answer"], r["error"]) for r in rows}, len(rows)


def test_only_what_is_unanswered_is_asked(spark, tmp_path):
    store, log = str(tmp_path / "store"), tmp_path / "log"
    first = frame(spark, *[f"p{i}" for i in range(20)], "bad", "mute", "p1", "", None)

    def ask(df, bad):
        log.write_text("")
        answers.ask_missing(df, store, responder(str(log), bad), tasks=1)
        return log.read_text().splitlines()

    ask(first, {"bad"})
    found, n = outcome(first, store)
    assert n == 25
    assert found["p1"] == (1, "p1!", None) and found[""] == (1, "!", None)
    assert found["bad"] == (1, None, "ValueError: refused")
    assert found["mute"] == (1, None, "no answer")
    assert found[None] == (None, None, None)
    # Failed prompts alone are asked again, and new ones; the bad one is well by now.
    assert ask(first.unionByName(frame(spark, "new")), set()) == ["3 texts"]
    found, _ = outcome(first, store)
    assert found["bad"] == (2, "bad!", None) and found["mute"] == (2, None, "no answer")
    # Nothing is left to ask.
    assert ask(first, set()) == []
    assert outcome(first, store)[0] == found


def test_short_answers_are_halved(spark, tmp_path):
    store = str(tmp_path / "store")
    df = frame(spark, *[f"p{i}" for i in range(9)])
    answers.ask_missing(df, store, lambda: lambda texts: [t for t in texts][:2], tasks=2)
    found, _ = outcome(df, store)
    assert found == {f"p{i}": (1, f"p{i}", None) for i in range(9)}


@pytest.mark.parametrize("rows", [[], [(None,)]])
def test_nothing_to_ask(spark, tmp_path, rows):
    store = str(tmp_path / "store")
    df = spark.createDataFrame(rows, "prompt string")

    def load():
        raise AssertionError("no model is needed")

    answers.ask_missing(df, store, load, tasks=3)
    assert answers.stored_answers(spark, store).count() == 0
    assert answers.with_answers(df, store).where(F.col("attempts").isNotNull()).count() == 0
