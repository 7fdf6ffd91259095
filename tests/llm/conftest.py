import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, rep long, size string, sig string"


def corpus(seed=1, n=60):
    """Random prose with copies, near copies, a shared passage, repeated lines, and the odd cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, texts = prose(60), []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 and texts:
            texts.append(rng.choice(texts))
        elif kind == 1 and texts:
            w = (rng.choice(texts) or "x").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(prose(rng.randrange(5, 60)) + "\n" + passage + "\n" + prose(rng.randrange(5, 60)))
        else:
            texts.append(prose(rng.randrange(1, 150)))
    line = prose(12)
    texts += [None, "", " \n\t", "One", "one two", "ONE TWO", "\n".join([line] * 9), "ab" * 400, "é ü 日本 " * 60, prose(4000), "a\x00b c " * 40, prose(30) + "  double  spaces ", "<|endoftext|> it's fine. 12,5"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, (None, "en", "de")[i % 3], (None, "a", "b", "é")[i % 4], len(t or ""), "x", 7, "y", "z") for i, t in docs_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_ids(spark, docs_rows):
    """A null id, and rows that are there twice."""
    rows = [(i, t, "en", "a", 1, "x", 7, "y", "z") for i, t in docs_rows[:25]]
    return spark.createDataFrame([(None, docs_rows[3][1], None, None, None, None, None, None, None), *rows, rows[0], rows[5]], SCHEMA)
