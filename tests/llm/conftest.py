import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample_texts():
    """Short, blank, null, repeated, near-equal, very long and odd texts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)] + ["the", "of", "é", "日本", "It's", "x1", "don't"]
    passage = [f"p{i}" for i in range(30)]
    texts = [None, "", " \n\t ", "one", "one two three", "a\x1cb c d", "﻿bom 😀"]
    for i in range(120):
        t = [rng.choice(words) for _ in range(rng.randint(1, 160))]
        if i % 4 == 0:
            t[len(t) // 2 : len(t) // 2] = passage[rng.randint(0, 10) :]
        if i % 9 == 0:
            t += ["same", "line", "again\n"] * 12
        texts.append(" ".join(t))
    texts += [texts[10], texts[10], texts[20] + " tail", texts[30].replace("the", "The"), "z" * 3000, "1 " * 3000, "a. " * 4000]
    return texts


@pytest.fixture(scope="session")
def texts():
    return sample_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, None if i % 11 == 0 else "en" if i % 3 else "de", None if i % 13 == 0 else f"src{i % 5}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named like those that operators add."""
    from pyspark.sql import functions as F

    names = "id key size shard slot pii kept ratio n_words tokens copies domain fp component_id starts bounds route anchor first words whole rest _whole _rest _end _left _lang _source _draw _bucket _sum _words _lines _hashes _windows _sorted _twice _placed _again _good _own _judged _buckets _spans"
    return docs.withColumns({n: F.lit("x") for n in names.split()})


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
