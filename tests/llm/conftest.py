import random

import pytest

from loomspace.llm.queries import tokenizer_path

#: Names that the operators use inside; a table may have columns of these names.
CLASHES = ["h", "digest", "fp", "score", "n_words", "spans", "start", "row", "base", "kept", "copies", "text_h", "n", "quality"]


def words(rnd, n, letters="abcdefghijé"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def tokenizer():
    return tokenizer_path()


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, very short, very long, repeated and near-equal texts."""
    rnd = random.Random(7)
    long = words(rnd, 30_000)
    plain = [words(rnd, rnd.randint(5, 120)) for _ in range(25)]
    shared = words(rnd, 60)
    return [
        None, "", " \n\t ", "a", "A", "Ä b", long, long[:-1] + "x", *plain, plain[0], plain[0], plain[1] + " tail", plain[2].upper(),
        *(words(rnd, 20) + " " + shared + " " + words(rnd, 20) for _ in range(6)), "aaaa " * 200, "x" * 5000, "it's  <|endoftext|> done", "é ​ 　 ퟿ 😀", "\x00 \x1f \x85 z",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """The texts as documents, with null ids, an id used twice, repeated rows, nulls elsewhere, and clashing column names."""
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "src", k, *([k] * len(CLASHES))) for k, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None, *([None] * len(CLASHES)))] * 2 + [(3, "the same id again", "en", "src", 1, *([0] * len(CLASHES))), rows[10], rows[10]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def odd_rows(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0), "extra") for k in range(len(texts))] + [(None, 1, 1, None), (4, None, None, None)], "doc_id long, quality int, toxic int, score string")
