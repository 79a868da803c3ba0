import random

import pytest
from helpers import make

@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, blanks, long ones, exact and near copies, repeated rows, and a null id."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + ". "
    base = ["".join(sentence(r.randint(4, 14)) for _ in range(r.randint(1, 30))) for _ in range(40)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "s0") for i in range(6)]
    for i in range(8):  # near copies: one word changed
        w = base[i].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w), "s1"))
    passage = "".join(sentence(11) for _ in range(6))
    rows += [(300 + i, base[20 + i] + passage + base[30 - i], None) for i in range(5)]
    rows += [(400, None, "s0"), (401, "", "s1"), (402, " \n\t ", None), (403, "One", "s2"), (404, "one two", "s2"), (405, "One  two\n", "s2")]
    rows += [(500, "Ünïcode ÀÉ 漢字 🙂 <|endoftext|> tab\there  double space \x1c odd ", "s3"), (501, "a" * 30_000, "s3"), (502, "word " * 20_000, "s3")]
    rows += [(0, base[0], "s0"), (None, base[1], "s1"), (None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make(spark, corpus).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])
