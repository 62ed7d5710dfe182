import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, fp string, key string, words string"


def tricky() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, long texts, near and exact copies, all sorts of letters; columns named as the operators' own."""
    r = random.Random(5)
    words = ["the", "of", "and", "Étage", "ÉTAGE", "naïve", "straße", "año", "日本", "𝒳y", "a1", "x-y", "İz", "don't", "…", "end."] + ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7))) for _ in range(120)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, long_ = text(45), text(4000)
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, text(19)), (7, text(20)), (8, passage), (9, text(30) + " " + passage + "\n" + text(30)), (10, passage + " " + passage)]
    out += [(11, long_), (12, long_ + " tail"), (13, long_.replace(" ", "\n")), (14, "same " * 60), (15, "same " * 61), (16, "12345 67 !!"), (17, "*** --- …")]
    base = text(60)
    for k in range(8):
        w = base.split()
        w[(7 * k) % 60] = r.choice(words)
        out.append((20 + k, " ".join(w)))
    out += [(40 + k, base) for k in range(6)] + [(-3, base), (50, text(80)), (51, passage.upper())]
    rows = [(d, t, ["en", "fr", None][i % 3], ["s1", "s2", "é", None, ""][i % 5], None if t is None else len(t), 0.5, "r", "f", "k", "w") for i, (d, t) in enumerate(out)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return tricky()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """As docs, with null and repeated ids besides."""
    more = [(None, "no id here", "en", "s1", 3, 0.1, "", "", "", ""), (None, None, None, None, None, None, None, None, None, None), rows[7], rows[7], (9, "another text under an id", "fr", "s2", 1, 0.0, "", "", "", "")]
    return spark.createDataFrame(rows + more, SCHEMA).repartition(2).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
