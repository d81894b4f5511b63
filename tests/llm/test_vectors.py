import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultsieve.llm import embedding_dedup, neighbours


@pytest.fixture(scope="module")
def matrix():
    r = np.random.default_rng(4)
    points = r.normal(size=(260, 12))
    for i in range(60):
        points[i] = points[i % 4] + r.normal(size=12) * 0.15
    points[61] = points[60] * 3
    points[62] = points[60]
    return points


@pytest.fixture(scope="module")
def table(spark, matrix):
    odd = [(900, None), (901, [0.0] * 12), (902, [1.0, None] + [0.0] * 10), (903, [float("nan")] * 12), (904, [float("inf")] + [1.0] * 11), (905, []), (None, [1.0] * 12)]
    rows = [(i, v.tolist()) for i, v in enumerate(matrix)] + odd
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v int, cls int").repartition(3)


def test_links_and_components_against_all_pairs(table, matrix):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(matrix))
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    found = {r.vec_id: r for r in embedding_dedup.duplicate_vectors(table, shard=40).collect()}
    assert len(found) == table.count()
    for i in range(len(matrix)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (linked[i].sum(), label[i], label[i] == i)
    for i in range(900, 906):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)


def test_pruned_graph_reaches_what_is_in_range(matrix):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    edges = embedding_dedup.pruned(unit)
    padded = np.full((len(edges), max(map(len, edges))), -1)
    for i, e in enumerate(edges):
        padded[i, : len(e)] = e
    for q in range(0, 60, 7):
        hit = embedding_dedup.reach(unit, padded, np.array([200]), unit[q], 0.9)
        assert set(hit) == set(np.flatnonzero(unit @ unit[q] >= 0.9))


def test_neighbours_have_recall_order_and_scores(table, matrix):
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=20, block=100).collect()
    hits, by = 0, {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 260, 20))
    for q, got in by.items():
        got.sort(key=lambda r: r.rank)
        scores = matrix @ matrix[q]
        assert [r.rank for r in got] == list(range(1, 21)) and q not in [r.vec_id for r in got]
        assert np.allclose([r.score for r in got], scores[[r.vec_id for r in got]], rtol=0, atol=1e-12)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores, kind="stable")[:20]) & {r.vec_id for r in got})
    assert hits / (20 * len(by)) >= 0.9


def test_few_candidates_and_no_rows(spark, table):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 20), (0, 2, 21), (20, 1, 0), (20, 2, 21)]
    assert neighbours.nearest(table.where("false"), F.lit(True)).count() == 0
    assert embedding_dedup.duplicate_vectors(table.where("false")).count() == 0
    assert embedding_dedup.duplicate_vectors(table.where("vec_id > 899")).count() == 6


def _against_all_pairs(spark, points, **options):
    """Counts and components of duplicate_vectors, held against the full product."""
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(unit))
    while (new := np.array([min([label[i], *label[x]]) for i, x in enumerate(linked)])).tolist() != label.tolist():
        label = new
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(3)
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.duplicate_vectors(table, **options).collect())
    assert linked.any() and found == list(zip(range(len(unit)), linked.sum(axis=1).tolist(), label.tolist(), strict=True))


@pytest.mark.parametrize("bundle", [2**20, 64 * 1500])
def test_pairs_at_the_bound_are_found_among_many_shards(spark, monkeypatch, bundle):
    monkeypatch.setattr(embedding_dedup, "BUNDLE", bundle, raising=False)
    r = np.random.default_rng(5)
    points = r.normal(size=(6000, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    for i in range(0, 6000, 2):
        aside = points[i + 1] - (points[i + 1] @ points[i]) * points[i]
        points[i + 1] = 0.901 * points[i] + np.sqrt(1 - 0.901**2) * aside / np.linalg.norm(aside)
    _against_all_pairs(spark, points, shard=60)


def test_shards_out_of_the_angle_hold_no_links():
    r = np.random.default_rng(6)
    points = r.normal(size=(1500, 4))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    middle = embedding_dedup.centres(points[:200], 40)
    home = np.argmax(points @ middle.T, axis=1)
    can = embedding_dedup.in_angle(points, middle, home, 0.9)
    a, b = np.nonzero(points @ points.T >= 0.9)
    assert can[a, home[b]].all() and can.mean() < 0.7


def test_links_between_tight_groups_larger_than_the_degree(spark):
    r = np.random.default_rng(8)
    heads = np.linalg.qr(r.normal(size=(32, 2)))[0].T
    heads[1] = 0.92 * heads[0] + np.sqrt(1 - 0.92**2) * heads[1]
    points = np.repeat(heads, 300, axis=0) + r.normal(size=(600, 32)) * 0.004
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    edges, entries = embedding_dedup.joined(unit, embedding_dedup.pruned(unit))
    assert any((edges[i] >= 300).any() for i in range(300))
    padded = np.full((600, max(map(len, edges))), -1)
    for i, e in enumerate(edges):
        padded[i, : len(e)] = e
    for q in range(0, 600, 37):
        assert set(embedding_dedup.reach(unit, padded, entries, unit[q], 0.9)) == set(np.flatnonzero(unit @ unit[q] >= 0.9))
    _against_all_pairs(spark, points)


def test_searches_that_miss_links_are_repeated():
    # Two far groups, joined by nothing but the entry: a beam of one does not get across.
    near = np.array([[0.1, 0.95, 0.2, 0.96]])
    padded = np.array([[1, 4], [0, 2], [1, 3], [2, 4]])
    assert embedding_dedup.searched(near, padded, np.array([0]), 0.9, 1).tolist() == [[False, True, False, False]]
    r = np.random.default_rng(3)
    points = r.normal(size=(300, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    edges = [np.array([(i - 1) % 300, (i + 1) % 300]) for i in range(300)]
    near = points @ points.T
    hit, first = embedding_dedup.links_in(near, np.array(edges), np.array([0]), 0.9)
    assert (hit == (near >= 0.9)).all() and first < hit.sum()


def test_odd_rows_of_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (40, [1.0, 0.01]), (None, [1.0, 0.0])]
    table = spark.createDataFrame([(*x, "a", "b") for x in rows], "vec_id long, embedding array<double>, score string, home string")
    found = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.duplicate_vectors(table).collect())
    assert found == [("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("3", 0, "3", True), ("40", 3, "1", False), ("None", 0, "None", True)]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == [(40, 1, 2, 2.0), (40, 2, 1, 1.0), (40, 3, 1, 1.0)]


@pytest.mark.parametrize("by", [1e-300, 1e200])
def test_very_large_and_very_small_components(spark, matrix, by):
    some = matrix[:80] / np.abs(matrix[:80]).max()
    plain = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(some)], "vec_id long, embedding array<double>")
    links = lambda rows: [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.duplicate_vectors(rows).orderBy("vec_id").collect()]
    want = links(plain)
    assert any(n for _, n, _ in want)
    # Every other vector alone: cosines between small and large ones are the same.
    assert links(spark.createDataFrame([(i, (v * (by if i % 2 else 1)).tolist()) for i, v in enumerate(some)], plain.schema)) == want


@pytest.mark.parametrize("by", [1e-150, 1e153])
def test_neighbours_whose_squares_leave_the_range_of_the_bounds(spark, matrix, by):
    some = matrix[:80] / np.abs(matrix[:80]).max()
    rows = spark.createDataFrame([(i, (v * by).tolist()) for i, v in enumerate(some)], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest(rows, F.col("vec_id") % 20 == 0, k=5).collect()}
    exact = some @ some.T
    np.fill_diagonal(exact, -np.inf)
    true = {(q, int(x)) for q in range(0, 80, 20) for x in np.argsort(-exact[q])[:5]}
    assert len(found) == 20 and len(found & true) >= 18


def test_parts_of_queries_visit_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 16)
    r = np.random.default_rng(8)
    middle = r.normal(size=(30, 16)) * 4
    points = middle[np.arange(1500) % 30] + r.normal(size=(1500, 16)) * 0.1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    found = {}
    for row in neighbours.nearest(rows, F.col("vec_id") % 7 == 0, k=10, pivots=32, probed=16, block=64).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    exact = points @ points.T
    np.fill_diagonal(exact, -np.inf)
    true = {q: set(np.argsort(-exact[q])[:10].tolist()) for q in range(0, 1500, 7)}
    assert set(found) == set(true) and all(len(x) == 10 for x in found.values())
    assert sum(len(found[q] & true[q]) for q in true) >= 0.9 * 10 * len(true)
