"""The learned operators against plain Python: a slow n-gram scorer and a slow expectation-maximisation."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np

from vaultsieve.llm import quality, toxicity

ODD = "n long, label string, score string, predicted string, held_out string, text_ string, slots string"


def fold(text):
    return "".join(" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in text or "")


def grams(text):
    t = fold(text)
    return {t[i : i + n] for n in toxicity.LENGTHS for i in range(len(t) - n + 1)}


def test_toxicity_equals_a_slow_scorer_of_characters(spark):
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("ñß中Ab") for _ in range(r.randint(1, 2))) for _ in range(n))
    rows = [(i, say(r.randint(0, 8)) + (" ÑÑß" if i % 4 == 0 else ""), i % 4 == 0) for i in range(160)]
    rows.append((500, None, False))
    docs = spark.createDataFrame([(i, t, 1, "a", "b", "c", "d", "e", "f") for i, t, _ in rows], f"doc_id long, text string, {ODD}").repartition(3)
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i < 500], "doc_id long, toxic int")
    found = {x.doc_id: x for x in toxicity.score(docs, labels, features=100_000).collect()}

    known = [(grams(t), int(y)) for i, t, y in rows if i < 500 and crc32(str(i).encode()) % 5]
    by = [Counter(g for s, y in known if y == kind for g in s) for kind in (0, 1)]
    n, p = (sum(y == kind for _, y in known) for kind in (0, 1))
    names = [g for g in set(by[0]) | set(by[1]) if by[0][g] + by[1][g] >= toxicity.LEAST and by[0][g] + by[1][g] < n + p]
    scale = np.array([math.log((by[1][g] + 1) / (p + 2)) - math.log((by[0][g] + 1) / (n + 2)) for g in names])
    x = lambda s: np.array([g in s for g in names], float) * scale
    features, label = np.stack([np.append(x(s), 1) for s, _ in known]), np.array([y for _, y in known], float)
    ridge = np.append(np.full(len(names), 0.1), 1e-6)
    weight = np.zeros(len(names) + 1)
    for _ in range(60):
        chance = 1 / (1 + np.exp(-features @ weight))
        weight -= 0.7 * np.linalg.solve((features.T * (chance * (1 - chance))) @ features + np.diag(ridge), features.T @ (chance - label) + ridge * weight)
    for i, t, _ in rows:
        want = 1 / (1 + math.exp(-float(np.append(x(grams(t)), 1) @ weight)))
        assert abs(found[i].score - want) < 0.02, (i, found[i].score, want)
        assert found[i].held_out == (crc32(str(i).encode()) % 5 == 0)


def test_toxicity_of_odd_rows(spark):
    long = "word " * 300_000 + "zkorx"
    rows = [(i, f"some plain words {i}" + (" zkorx" if i % 3 == 0 else "")) for i in range(200)]
    odd = [(1000, long), (1001, long[:-6]), (1002, ""), (1003, None), (3, "zkorx"), (3, "zkorx"), (None, "zkorx zkorx")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] * 2 + [(4, 0), (None, 1), (7777, 1)], "doc_id long, toxic int")
    found = {}
    for x in toxicity.score(docs, labels, sample=500).collect():
        found.setdefault(x.doc_id, []).append(x)
    assert found[1000][0].predicted == 1 and found[1001][0].predicted == 0  # the whole text counts
    assert found[1002][0].score == found[1003][0].score
    assert len(found[3]) == 3 and len({x.score for x in found[3]}) == 2
    assert not found[None][0].held_out
    assert toxicity.labelled_sample(docs, labels, 50).count() <= 50


def plain_em(seen, count, rounds, prior):
    belief = [[0.4, 0.2, 0.4], [0.01, 0.6, 0.39]]
    m, strength = len(seen[0]), sum(count) / 5 + 1
    chance = [[list(b) for _ in range(m)] for b in belief]

    def good(votes):
        odds = [math.log(w) + sum(math.log(chance[k][j][v]) for j, v in enumerate(votes)) for k, w in ((0, 1 - prior), (1, prior))]
        return 1 / (1 + math.exp(max(-50, min(50, odds[0] - odds[1]))))

    for _ in range(rounds):
        g = [good(v) for v in seen]
        weight = [[c * (1 - x) for c, x in zip(count, g, strict=True)], [c * x for c, x in zip(count, g, strict=True)]]
        prior = (sum(weight[1]) + 1) / (sum(count) + 2)
        chance = [[[(sum(w for w, v in zip(weight[k], seen, strict=True) if v[j] == o) + strength * belief[k][o]) / (sum(weight[k]) + strength) for o in (0, 1, 2)] for j in range(m)] for k in (0, 1)]
    return prior, chance, [good(v) for v in seen]


def test_expectation_maximisation_equals_plain_python():
    r = random.Random(6)
    seen = [[r.choice([0, 1, 1, 2]) for _ in range(5)] for _ in range(30)]
    count = [r.randint(1, 50) for _ in seen]
    prior, chance = quality.estimate(np.array(seen), np.array(count, float), rounds=12)
    want = plain_em(seen, count, 12, quality.PRIOR)
    assert abs(prior - want[0]) < 1e-9 and np.allclose(chance, want[1], atol=1e-9)
    assert np.allclose(quality.posterior(np.array(seen), prior, chance), want[2], atol=1e-9)


def test_quality_of_odd_rows(spark):
    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choice("aeiounrst") for _ in range(r.randint(2, 8))) + ("." if r.random() < 0.1 else "") for _ in range(n))
    rows = [(i, prose(80)) for i in range(60)]
    rows += [(0, rows[0][1])] * 50 + [(100, prose(60_000)), (101, "$$$ " * 60_000), (None, rows[1][1]), (102, None), (103, "")]
    docs = spark.createDataFrame([(*x, "a", "b", "c", "d", "e", "f") for x in rows], f"doc_id long, text string, {ODD.replace('n long, ', '')}").repartition(3)
    found = {}
    for x in quality.score(docs, sample=20).collect():
        found.setdefault(x.doc_id, []).append(x)
    assert len(found[0]) == 51 and len({x.score for x in found[0]}) == 1
    assert abs(found[None][0].score - found[1][0].score) < 1e-12
    assert not found[101][0].keep and found[100][0].keep and found[102][0].score == found[103][0].score
