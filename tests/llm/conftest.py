import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rid int, fp string, component_id int, size long"


def prose(rng, n, words=("the", "of", "and", "house", "river", "green", "walks", "over", "stone", "under", "seven", "birds")):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


def table():
    """Small documents with every awkward case: nulls, empties, repeats, copies, near copies, shared passages, long ones."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(60, 160)) for _ in range(30)]
    passage = prose(rng, 70)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 30)}" for _ in range(5)]
    texts += [texts[3], texts[3], texts[4], texts[5].replace("river", "rivet", 1), texts[6] + " end"]
    texts += [None, None, "", " \n\t ", "One", "Ünë çà", "x" * 3000, "ab " * 2000, "line one is here and long\n" * 4]
    texts += ["first line of some length\nsecond line of some length\nshort", "first line of some lenght\nsecond lines of some length\nshort"]
    texts += [prose(rng, 9000) + "\n" + passage, "★" * 90 + "é" * 150, "★" * 90 + "é" * 151]
    rows = [(k, t, ["en", "de", None, "fr-FR"][k % 4], f"s{k % 3}", len(t or ""), "no", 7, "f", 1, 2) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[31], (None, texts[1], "en", None, None, None, None, None, None, None), (None, None) + (None,) * 8]
    return rows


@pytest.fixture(scope="session")
def rows():
    return table()


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
