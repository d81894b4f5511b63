import random

import pytest

#: Columns that the operators use names of, to be left alone.
EXTRA = "n long, part long, tkey string, size string, copies double, carried string, hits string, v double"


def word(r: random.Random) -> str:
    return "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))


def texts(seed: int = 3) -> list[tuple[int, str | None]]:
    """Ids and texts with nulls, empty and white texts, copies, near copies, shared passages, repeats within, repeated ids, a very long one."""
    r = random.Random(seed)
    prose = lambda n: " ".join(word(r) for _ in range(n))
    shared, base = prose(70), prose(200)
    out: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, base), (8, base), (9, base.upper())]
    words = base.split()
    for i in range(8):
        changed = list(words)
        for _ in range(i * 2):
            changed[r.randrange(len(changed))] = word(r)
        out.append((20 - i, " ".join(changed)))
    out += [(30 + i, f"{prose(r.randint(0, 60))} {shared} {prose(r.randint(0, 60))}") for i in range(6)]
    out += [(40, shared), (41, f"{shared}\n\n{shared}"), (42, prose(60) + " same" * 80), (43, "x" * 3000), (44, "ab" * 400)]
    out += [(50, prose(30_000)), (51, prose(50)), (51, prose(50)), (52, shared), (52, shared), (60, "😀 " * 120)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    r = random.Random(1)
    made = [(i, t, r.choice(["en", None]), r.choice(["a", "b", "c", None, "hot", "hot", "hot"]), len(t or ""), 1, 2, "k", "s", 0.5, "c", "h", 1.0) for i, t in rows]
    return spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
