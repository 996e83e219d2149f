import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, label int, pos int, ck1 string, node string, kept string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and long texts, repeats, ties; extra columns with clashing names."""
    rng = random.Random(5)
    base = words(rng, 120)
    long = "\n".join(words(rng, 40) for _ in range(150))
    texts = {
        1: None, 2: "", 3: " \n\t\n ", 4: "one two", 5: base, 6: base, 7: base + " tail", 8: "x" * 5000, 9: long, 10: long + "\nlast line here",
        11: "Mail a.b@c.example.org, +1 (555) 010-9999, 10.0.0.255, 4111 1111 1111 1111", 12: "a\nb\na\n\nb\nc", 13: "ĳ😀 𝒳 naïve text　end", 14: (words(rng, 30) + "\n") * 2 + words(rng, 60), 15: "the same words the same words the same words " * 20,
    }
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, len(t) if t else None, "t", 1, 2, "k", "n", "z") for i, t in texts.items()]
    rows += [rows[4], rows[8], (None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture()
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
