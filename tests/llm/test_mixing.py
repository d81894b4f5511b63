import re
from collections import defaultdict

import pytest

from vaultsieve.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes: list[int], weights: list[int], share: float, most: float) -> list[float]:
    """Targets by repeated sharing."""
    left, full = share * sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        rest = left - sum(most * sizes[i] for i in full)
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / total > most * sizes[i]} if open_ else set()
        if not over:
            return [most * sizes[i] if i in full else rest * weights[i] / total for i in range(len(sizes))]
        full |= over


def test_targets_sizes_and_copies(docs):
    found = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(names, filled([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True))
    taken = defaultdict(int)
    assert len(found) == docs.count()
    for r in found:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
    for name in names:
        assert abs(taken[name] - want[name]) <= max([r.size for r in found if r.source == name])


def test_reruns_and_partitions_agree(docs):
    a, b = (mixing.mix_sources(d).drop("source") for d in (docs, docs.repartition(2)))
    assert a.exceptAll(b).count() == 0


def test_carried_rows_and_no_rows(docs, empty):
    out = mixing.mix_sources(docs, carry=docs.columns).select("carried.*")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert mixing.mix_sources(empty).count() == 0


def test_no_python_in_the_plan(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_source_is_spread_over_windows(spark):
    hot = spark.range(3000).selectExpr("id as doc_id", "'w x' as text", "'one' as source")
    out = mixing.mix_sources(hot)
    assert out.selectExpr("sum(taken)").first()[0] == 9000
