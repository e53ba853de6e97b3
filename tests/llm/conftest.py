"""Small tables with what operators must bear: nulls in any column, empty and very long texts, ties, repeated rows,
no rows, and extra columns whose names operators use themselves."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size int, rep string, text_key string, host string, rank int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{rng.choice('abcdefgh')}" for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(60, 160)) for _ in range(30)]
    passage = prose(rng, 60)
    out = list(base)
    for i in range(8):  # near copies: a word changed
        words = base[i].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [base[3], base[3], base[4]]  # exact copies
    out += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(3)]
    out += [None, "", "   ", "one", "one", "a b c d", "Ünï cödé déjà\tvu\n\nlines\r\nhere  ", "x" * 3000, "lala " * 300]
    out += [prose(rng, 30_000, 50_000)]  # very long
    out += ["\n".join(["same line here"] * 5 + [prose(rng, 12)]) for _ in range(3)]
    return out


@pytest.fixture(scope="session")
def rows():
    found = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", None if i % 5 else 1) for i, t in enumerate(texts())]
    found += [found[2], (found[2][0], "the same id with another text of a few words more", "en", "s1", 2), (None, "a row without an id", None, None, None)]
    return found


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, "r", "t", "h", 9) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
