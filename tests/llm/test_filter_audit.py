import re
from itertools import permutations

from vaultsieve.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def walked(rows, labels):
    """Every order walked document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails, own = [], {}
    for i, t, _ in rows:
        if i is not None:
            own[t or ""] = min(own.get(t or "", i), i)
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        first = own.get(t)
        fails.append((part or "", {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), first is not None and (i is None or i > first)), strict=True) if bad}, i in good, i in toxic))
    want = {}
    for part in {f[0] for f in fails}:
        here, shares = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                stay = [d for d in left if f not in d[1]]
                shares[f] += len(gone)
                want[part, "".join(order), k] = [len(stay), len(gone), sum(f in d[1] for d in here) - len(gone), sum(d[1] == {f} for d in here), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = stay
        for (p, order, k), row in want.items():
            if p == part:
                row.append(shares[order[k - 1]])
    return want


def test_every_order_against_documents_one_by_one(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rows += [(100 + i, f"{'Abc' * (i % 3)} word {'#' * (i % 2)} " * (i * 2), "hot" if i % 3 else "") for i in range(40)]
    rows += [(None, "two words", "a"), (None, "two words", None), (None, "null only", "b"), (None, "null only", "b"), (3, "two words", "a"), (4, "ids come twice", "a"), (4, "ids come twice", "c"), (4, "ids come twice", "c"), (9, "ids come twice", "c")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(3, 130)] + [(6, 0, 1), (6, 1, None), (None, 1, 1), (9999, 1, 1), (7, None, None)]
    made = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], "doc_id long, text string, source string, n long, mask long, part string, good string").repartition(5)
    found = filter_audit.audit(made, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = walked(rows, labels)
    assert len(found) == len(want) and len(found) % 600 == 0
    for r in found:
        assert want[r.part, r.filter_order, r.step] == list(r)[3:], r


def test_a_part_of_one_text_and_no_rows(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    copies = spark.range(3000).selectExpr("id as doc_id", "'same text' as text", "cast(null as string) as source")
    rows = {(r.filter_order, r.step): r for r in filter_audit.audit(copies, labels).collect()}
    assert len(rows) == 600 and {r.part for r in rows.values()} == {""}
    assert rows["EABCD", 1].removed == 2999 and rows["EABCD", 2].removed == 1 and rows["ABCDE", 5].redundant == 2999
    assert rows["ABCDE", 5].shapley == 60 * 2999 and rows["ABCDE", 1].shapley == 60 * 3000 + 60


def test_zeta_arrays_count_supersets(spark):
    counts = spark.createDataFrame([("p", m, m + 1, 1, 0) for m in range(32)], "part string, mask int, n long, good long, toxic long")
    row = filter_audit.survivors(counts).first()
    assert row.n == [sum(m + 1 for m in range(32) if not m & s) for s in range(32)] and row.exact == list(range(1, 33))
    assert row.good == [2 ** (5 - bin(s).count("1")) for s in range(32)]
