import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vaultsieve.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def grams(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return len(w), [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target, buckets=importance.BUCKETS):
    """(doc_id, words, n_features, weight, score) of each row, n-gram by n-gram."""
    of = lambda f: zlib.crc32(f) % buckets
    s, t = Counter(), Counter()
    each = [(i, *grams(x)) for i, x in rows]
    for _, _, f in each:
        s.update(map(of, f))
    for x in target:
        t.update(map(of, grams(x)[1]))
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (whole_s + buckets) / ((s[b] + 1) * (whole_t + buckets)))) for b in s}
    out = []
    for i, n, f in each:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(x)] for x in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def drawn(want, draw=5, least=20):
    able = sorted((x for x in want if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return {k + 1: (x[0], x[4]) for k, x in enumerate(able[: draw * len(able) // 100])}


def held(found, want, draw=5):
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in found) == Counter((x[0], *x[2:]) for x in want)
    assert {r.rank: (r.doc_id, r.score) for r in found if r["rank"] is not None} == drawn(want, draw)


@pytest.mark.parametrize(("chunk", "part", "parts"), [(importance.CHUNK, importance.PART, 5), (300, 2000, 3), (1, 50_000, 1)])
def test_weights_scores_and_ranks_against_plain_python(spark, docs, rows, chunk, part, parts):
    r = random.Random(1)
    more = [(100 + i, " ".join(r.choice(["Ab", "cd", "éf", "x1", "中"]) for _ in range(r.randint(15, 60)))) for i in range(60)]
    more += [(None, "null ids " * 15), (None, "null ids " * 15), (7, more[0][1]), (8, "under_score-and.dots " * 12), (9, "w" * 5000 + " tail")]
    small = [x for x in rows if len(x[1] or "") < 4000] if chunk == 1 else rows
    extra = "size long, chunk long, uid string, part long, rank string"
    made = spark.createDataFrame([(*x, 1, 2, "u", 3, "r") for x in small + more], f"doc_id long, text string, {extra}").repartition(parts)
    target = ["ab cd ab", None, "", rows[3][1], "x1 中 éf null ids", "ab cd ab"]
    aim = spark.createDataFrame([(x, 1) for x in target], "text string, uid long")
    held(importance.resample(made, aim, chunk=chunk, part=part, draw=30).collect(), plain(small + more, target), 30)


def test_no_documents_and_no_target(spark, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).count() == 0
    rows = [(1, "one two three"), (2, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    held(importance.resample(made, none).collect(), plain(rows, []))


def test_equal_scores_go_to_smaller_ids(spark):
    scores = spark.createDataFrame([(i, 100 - i, 30, 7 + (i < 3)) for i in range(100)], "uid long, doc_id long, n_words long, score long").repartition(3)
    found = {r.rank: r.doc_id for r in importance.ranked(scores, 10).collect() if r["rank"]}
    assert [found[i] for i in range(1, 11)] == [98, 99, 100, 1, 2, 3, 4, 5, 6, 7]


def test_a_word_of_every_text_reaches_the_dictionary_once_a_chunk(spark):
    made = spark.range(4000).selectExpr("id as doc_id", "repeat('the same words ', 20) as text").repartition(4)
    packed = importance.tries(importance.chunk_rows(made), [b"same words", b"words the"], 0, 3).toPandas()
    assert len(packed) <= 3 * 4 * 2 and (packed["nodes"] - packed["skip"]).groupby(packed["chunk"]).sum().tolist() == [9] * packed["chunk"].nunique()


def test_tries_merge_to_strings():
    r = random.Random(9)
    texts = [" ".join(r.choice(["a", "ab", "b", "ba", "é"]) for _ in range(40)) for _ in range(6)]
    whole, raws, nodes, skips, want = Counter(), [], [], [], []
    for t in texts:
        counts = Counter(grams(t)[1])
        whole += counts
        names = sorted(counts, key=lambda x: x.split(b" "))
        names = names[len(names) // 3 :]  # from the middle of a path on
        words = [x.split(b" ") for x in names]
        path = words[0][:-1]
        raws.append(bytes([*range(1, len(path) + 1), *(len(w) for w in words)]) + np.array([0] * len(path) + [counts[x] for x in names], "<i4").tobytes() + b"".join(w + b" " for w in path) + b"".join(w[-1] + b" " for w in words))
        nodes.append(len(path) + len(names))
        skips.append(len(path))
        want.append(names)
    merged = importance.Merged(raws, nodes)
    at = np.cumsum([0, *nodes])
    seen = Counter()
    for k, names in enumerate(want):
        of = merged.of[at[k] + skips[k] : at[k + 1]]
        assert merged.crc[of].tolist() == [zlib.crc32(x) for x in names]
        seen.update({int(i): Counter(grams(texts[k])[1])[x] for i, x in zip(of, names, strict=True)})
    assert all(merged.count[i] == n for i, n in seen.items()) and merged.count.sum() == sum(seen.values())


def test_checksums():
    r = random.Random(5)
    heads = [bytes(r.randrange(256) for _ in range(r.choice([0, 3, 50]))) for _ in range(300)]
    strings = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 5, 40, 127, 128, 129, 3000]))) for _ in range(300)]
    size = np.array([len(x) for x in strings])
    state = np.array([zlib.crc32(x) ^ 0xFFFFFFFF for x in heads], np.uint32)
    found = ~importance.crc32s(state, np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size)
    assert found.tolist() == [zlib.crc32(x + y) for x, y in zip(heads, strings, strict=True)]
    assert importance.crc32s(state[:0], np.zeros(0, np.uint8), size[:0], size[:0]).tolist() == []
