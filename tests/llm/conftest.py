import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, fp long, number long, row long"


@pytest.fixture(scope="session")
def texts():
    """Odd texts: null, empty, white space, punctuation, repeats, a long one, other scripts, markup of tokenizers."""
    rng = random.Random(7)
    words = ["the", "of", "Reason", "and", "licence", "thing", "ñandú", "École", "x", "42", "日本", "end."]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    copy = line(60)
    return [None, "", " \t\n\x0b\x0c\r ", "...!!", "one", "two words", "Three little words", copy, copy, copy + " tail", line(300), line(4000), "A b c İI K", "a <|endoftext|> b", "\x00 nul \x7f", "same " * 700]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The odd texts, a repeated row, a null id, and extra columns whose names operators use themselves."""
    rows = [(k * 3, x) for k, x in enumerate(texts)]
    rows += [rows[7], (None, "no id"), (None, None)]
    return spark.createDataFrame([(k, x, None, "s", None, 0.5, 1, 2, 3, 4) for k, x in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
