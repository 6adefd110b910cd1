import random

import pytest


def prose(rng, n, words=400):
    vocabulary = [f"{a}{b}{c}" for a in ("th", "an", "er", "Ô", "ñu") for b in ("on", "est", "al", "ing") for c in ("", "ly", "ou", "re", "sh")]
    return " ".join(rng.choice(vocabulary[:words]) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty, blank and very long texts, copies, near copies, repeated rows."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(3, 300)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5]) for i in range(12)]
    for i in range(12):
        words = prose(rng, 200).split() if i < 2 else rows[10 + i][1].split()
        words[len(words) // 2 : len(words) // 2 + 1] = ["changed"]
        rows.append((200 + i, " ".join(words)))
    passage = prose(rng, 60)
    rows += [(300 + i, f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20)}") for i in range(6)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "1234 !!"), (405, prose(rng, 40_000)), (406, "aaaa " * 3000), (None, base[0]), (None, None)]
    rows += [rows[0], rows[0], (401, "")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With extra columns whose names the operators use themselves."""
    wide = [(i, t, "de" if i and i % 2 else None, "x", i, 1.0, None) for i, t in odd_rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, folder string, n_words long, score double, label string")
