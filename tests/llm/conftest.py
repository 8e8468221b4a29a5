import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, n long, score double"


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), "clash", 1, 0.5)


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empties, one very long text, repeats and clashing columns."""
    r = random.Random(5)
    words = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(300)] for k, a in (("en", "etaoinshr"), ("fr", "éàeltuqpv"), ("de", "äöünchsgk"))}

    def prose(lang, n):
        return " ".join(r.choice(words[lang]) for _ in range(n))

    passage = prose("en", 40)
    rows = [row(i, prose(k := ("en", "en", "fr", "de")[i % 4], r.randint(5, 120)), k, f"s{i % 3}" if i % 2 else "big") for i in range(80)]
    base = prose("en", 150)
    rows += [row(100 + i, base, "en", "big") for i in range(6)]
    rows += [row(110 + i, base.upper() if i % 2 else base.replace(" ", "\n", 3), "en", "big") for i in range(4)]
    rows += [row(120 + i, f"{prose('en', 10)} {passage} {prose('en', 10)}", "en") for i in range(8)]
    rows += [row(130, None), row(131, ""), row(132, "   \n"), row(133, "12 34 !!"), row(134, prose("en", 6000)), row(135, "x" * 3000), row(None, base), row(100, base, "en", "big"), row(136, prose("fr", 30), None), row(137, "tail", "en", None)]
    rows += [row(140, "mail ab.c1@x1.example.com or 10.2.33.4 card 4111 1111 1111 1111 call +1 (386) 555-3733 password=e3b3ed3cc8548923d6 <|endoftext|> ok")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def vectors(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.1) for _ in range(16)], i % 3) for i in range(300)]
    rows += [(400 + i, rows[i][1], 0) for i in range(20)] + [(500, None, 0), (501, [None] * 16, 0), (502, [float("nan")] * 16, 0), (503, [float("inf")] * 16, 0), (None, [0.1] * 16, 0), (504, [0.5] * 8, 0), (505, [], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
