import random

import pytest

#: Rows every operator on documents must take: null id, null, empty and blank texts, repeated rows, an id with two texts.
ODD = [(None, "lost and found again here today"), (900, None), (901, ""), (902, " \n\t "), (903, "one"), (903, "one"), (904, "two texts of one id"), (904, "another text of one id"), (905, "ONE"), (906, "x\x00y \u3000 ß 😀")]
SCHEMA = "doc_id long, text string, id string, row string, th string, n string, score string, k string"


def documents(spark, rows):
    """A table whose other columns have names that operators use inside."""
    return spark.createDataFrame([(i, x, "a", "b", "c", "d", "e", "f") for i, x in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, repeats, very long and odd texts."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 7))) for _ in range(400)] + ["é", "中", "!", "a\x0b", "\u2028"]
    base = [" ".join(rnd.choice(words) for _ in range(n)) for n in (60, 150, 300, 12, 5, 4)]
    passage = " ".join(rnd.choice(words) for _ in range(70))
    rows = []
    for i in range(80):
        kind = rnd.random()
        if kind < 0.25:
            text = rnd.choice(base)
        elif kind < 0.5:
            own = rnd.choice(base).split(" ")
            for _ in range(rnd.randrange(1, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            text = " ".join(own)
        elif kind < 0.7:
            text = " ".join([*(rnd.choice(words) for _ in range(rnd.randrange(40))), passage, *(rnd.choice(words) for _ in range(rnd.randrange(40)))])
        elif kind < 0.8:
            text = rnd.choice(words) * rnd.randrange(1, 3) + " " + (rnd.choice(words) + " ") * rnd.randrange(1, 200)
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 200)))
        rows.append((i, text.upper() if rnd.random() < 0.1 else text))
    rows.append((80, " ".join(rnd.choice(words) for _ in range(60_000))))
    return rows
