import hashlib

import pytest

from vaultsieve.llm import minhash, substrings, suffixes

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().split()


def test_word_windows_against_brute_force(docs, rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    assert sum(x[2] for x in want) > 500
    assert sorted(map(tuple, substrings.dedup_substrings(docs).collect())) == sorted(want)


def test_kept_texts_match_their_digests(docs):
    for r in substrings.dedup_substrings(docs, texts=True).where("n_removed > 0").collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_paths_compact_to_their_first_kmer(spark):
    links = [(1, 11, None, 0), (2, 12, 11, 4), (3, 13, 12, 5), (4, None, 13, 6), (9, None, None, 0)]
    made = spark.createDataFrame(links, "kmer long, next long, prev long, gap int")
    assert {r.kmer: (r.path, r.place) for r in substrings.compacted(made).collect()} == {1: (1, 0), 2: (1, 4), 3: (1, 9), 4: (1, 15), 9: (9, 0)}


def test_byte_strings_against_brute_force(docs, rows):
    first: dict[bytes, tuple[int, int]] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            key = b[p : p + 100]
            first[key] = min(first.get(key, (i, p)), (i, p))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert sorted(map(tuple, suffixes.dedup_bytes(docs).collect())) == sorted(want)


def test_loser_tree_merges_and_knows_shared_prefixes():
    import random

    r = random.Random(5)
    runs = [sorted("".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode() for _ in range(r.randint(0, 40))) for _ in range(7)]
    coded = [suffixes.front_coded(x) for x in runs]
    assert [suffixes.restored(*c) for c in coded] == runs
    out, last = [], b""
    for run, at, shared in suffixes.merged([(x, c[0].tolist()) for x, c in zip(runs, coded, strict=True)]):
        now = runs[run][at]
        assert not out or shared == next((k for k, (p, q) in enumerate(zip(last, now)) if p != q), min(len(last), len(now)))
        out.append(now)
        last = now
    assert out == sorted(x for run in runs for x in run)


def shingles(text, width):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def check_components(found, sets, percent):
    ids = [i for i, _ in sets]
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[top(a)] = top(b)
    least: dict[int, int] = {}
    for i, name in enumerate(ids):
        least[top(i)] = min(name, least.get(top(i), name))
    want = sorted((name, len(sets[i][1]), least[top(i)], name == least[top(i)]) for i, name in enumerate(ids))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == want


def test_near_duplicates_against_all_pairs(docs, rows):
    for width in (2, 5):
        check_components(minhash.near_duplicates(docs, width=width).collect(), [(i, shingles(t, width)) for i, t in rows], 80)


def test_a_group_larger_than_small_buckets_goes_through_blocks(spark, monkeypatch):
    import random

    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in r.sample(range(120), r.choice([1, 4, 8, 12])):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_components(minhash.near_duplicates(docs, width=2).collect(), [(i, shingles(t, 2)) for i, t in rows], 80)


def test_no_rows(empty):
    assert substrings.dedup_substrings(empty).count() == suffixes.dedup_bytes(empty).count() == minhash.near_duplicates(empty).count() == 0


def test_a_null_id_keeps_its_words(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup_substrings(docs).collect()) == [(0, 0), (1, 0), (2, 60)]
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in suffixes.dedup_bytes(docs).collect()) == [(0, False), (1, False), (2, True)]


def removed_bytes(rows, length):
    first: dict[bytes, tuple[int, int]] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            key = b[p : p + length]
            first[key] = min(first.get(key, (i, p)), (i, p))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (i, p):
                gone[p : p + length] = b"\1" * length
        want.append((i, len(b), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))))
    return sorted(want)


@pytest.mark.parametrize(("length", "k", "hot"), [(100, 40, 2), (100, 20, 20_000), (300, 40, 20_000), (40, 40, 3)])
def test_byte_strings_of_other_lengths_and_hot_grams(spark, monkeypatch, length, k, hot):
    import random

    from vaultsieve.llm import common

    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(suffixes, "GROUP", 40)
    r = random.Random(length + hot)
    say = lambda n: "".join(r.choice("abé ") for _ in range(n))
    shared = [say(n) for n in (110, 130, 350, 700)]
    rows = [(i, "".join(r.choice([say(r.randint(0, 90)), r.choice(shared), r.choice(shared)[20:]]) for _ in range(r.randint(0, 5)))) for i in range(60)]
    rows += [(70, "a" * 900), (71, "ab" * 300), (72, rows[3][1]), (73, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.dedup_bytes(docs, length=length, k=k, hot=hot).collect()
    assert sorted(tuple(x)[:4] for x in got) == removed_bytes(rows, length)


def test_strings_shorter_than_a_gram_are_refused(empty):
    with pytest.raises(ValueError, match="bytes"):
        suffixes.dedup_bytes(empty, length=30)


def test_hot_keys_join_like_others(spark, monkeypatch):
    from vaultsieve.llm import common

    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(common, "MOST", 2)
    rows = spark.createDataFrame([(k, i) for k in range(6) for i in range(k)], "k long, i long")
    keyed = spark.createDataFrame([(k, k, f"v{k}") for k in (0, 1, 3, 4, 5, 9)], "k long, n long, v string")
    for how in ("inner", "left"):
        got = sorted((r.k, r.i, r.v or "") for r in common.hot_join(rows, keyed, ["k"], how).collect())
        assert got == sorted((k, i, "" if k == 2 else f"v{k}") for k in range(6) for i in range(k) if how == "left" or k != 2)


@pytest.mark.parametrize("length", [100, 300])
def test_parts_of_short_texts_only(spark, length):
    long = "".join(chr(97 + (i * i) % 23) for i in range(400))
    short = [(i, "a title of a few words " * (i % 4)) for i in range(40)]
    for rows in (short, [(i, t) for i, t in short if not t], [*short, (50, long), (51, long)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 if rows is short else 3)
        assert sorted(tuple(x)[:4] for x in suffixes.dedup_bytes(docs, length=length).collect()) == removed_bytes(rows, length)
