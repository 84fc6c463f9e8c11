import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.vector_dedup import link_vectors
from lodestone.llm.vector_search import search, tree

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, part long, component_id long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 16))
    near = base[:150] + rng.normal(0, 0.03, (150, 16)) * np.linalg.norm(base[:150], axis=1)[:, None]
    chain = np.cumsum(rng.normal(0, 0.04, (40, 16)), 0) + 1
    v = np.concatenate([base, near, chain, np.repeat(base[3:4], 60, 0)]).astype(np.float32)
    label = [i % 3 for i in range(900)] + [i % 3 for i in range(150)] + [1] * 40 + [0] * 60
    found = [(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label, strict=True))]
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [None] + [1.0] * 15, 1), (5003, [float("nan")] + [1.0] * 15, 1), (5004, [1.0] * 3, 1), (5005, v[4].tolist(), None), (None, v[4].tolist(), 1), (5006, [float("inf")] * 16, 1)]
    return [(*r, 1, 2, 3) for r in [*found, found[7], *odd]]


def sound(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_links_equal_brute_force(spark, rows):
    found = link_vectors(spark.createDataFrame(rows, SCHEMA), z=99, lists=10).collect()
    assert len(found) == len(rows)
    good = [r for r in rows if sound(r[1]) and r[2] is not None and r[0] is not None]
    v = np.array([r[1] for r in good])
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in good])
    link = (v @ v.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    part = np.array([r[0] for r in good])
    while True:
        new = np.minimum(part, np.where(link, part[None], 1 << 40).min(1))
        if (new == part).all():
            break
        part = new
    want = sorted((r[0], int(n), int(p), r[0] == p) for r, n, p in zip(good, link.sum(1), part, strict=True))
    got = sorted(tuple(r) for r in found if r.vec_id is not None and r.vec_id < 5000)
    assert got == want and sum(w[1] for w in want) > 3000
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        elif r.vec_id >= 5000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)


def test_few_probes_still_find_the_links(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    few = sum(r.n_links for r in link_vectors(df, lists=10).collect())
    assert few >= 0.98 * sum(r.n_links for r in link_vectors(df, z=99, lists=10).collect())


def test_all_links_where_few_of_many_dimensions_vary(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2400, 4))
    near = base + rng.normal(0, 0.07, base.shape) * np.linalg.norm(base, axis=1)[:, None]
    v = (np.concatenate([base, near]) @ rng.normal(size=(4, 64))).astype(np.float32)
    got = {r.vec_id: r.n_links for r in link_vectors(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int"), lists=96).collect()}
    units = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    want = (units @ units.T >= 0.98).sum(1) - 1
    assert sum(want) > 10000
    assert got == dict(enumerate(want.tolist()))


def nearest_rows(rows, i, k=10):
    """(score, vec_id) of the k nearest other rows of the same length, by definition."""
    v = np.array(rows[i][1], dtype=float)
    far = [(np.sqrt(((np.array(w, dtype=float) - v) ** 2).sum()), d) for j, (d, w) in enumerate(rows) if j != i and len(w) == len(v)]
    return sorted(far)[:k]


def answers(rows, found, step, k=10):
    """Hits and all, after checking ranks, order, scores and that no query finds its own row."""
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for i, (d, v) in enumerate(rows):
        if d % step or sum(e == d for e, _ in rows) > 1:
            continue
        want, mine = nearest_rows(rows, i, k), sorted(by.get(d, []), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(want) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        last = want[-1][0] if want else 0
        hits += sum(r.score <= last + 1e-12 for r in mine)
        total += len(want)
        exact = {(round(s, 9), e) for s, e in nearest_rows(rows, i, len(rows))}
        assert all((round(r.score, 9), r.vec_id) in exact for r in mine)
    return hits, total


def usable_rows(rows):
    return [(r[0], r[1]) for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]


def test_search_recall_and_order(spark, rows):
    rng = np.random.default_rng(9)
    more = [(*r, 1, 2, 3) for r in [(6000 + i, rng.normal(size=5).astype(np.float32).tolist(), 1) for i in range(31)]]
    rows = [*rows, *more]
    df = spark.createDataFrame(rows, SCHEMA)
    found = search(df, F.col("vec_id") % 10 == 0, part_rows=100, row_block=70, query_block=9).collect()
    hits, total = answers(usable_rows(rows), found, 10)
    assert total > 1000 and hits >= 0.9 * total


def test_another_row_with_the_id_of_a_query_is_a_candidate(spark):
    rows = [(10, [0.0, 1.0]), (10, [0.0, 2.0]), (10, [0.0, 2.0]), (7, [0.0, 1.5]), (3, [0.0, 2.0])]
    found = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 10, k=2).collect()
    got = sorted((r.rank, r.vec_id, r.score) for r in found)
    assert got == sorted([(1, 7, 0.5), (2, 3, 1.0), (1, 3, 0.0), (2, 10, 0.0), (1, 3, 0.0), (2, 10, 0.0)])


def test_a_tree_of_several_levels_and_a_common_vector(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 3
    v = [*(centres[i % 40] + rng.normal(size=8) for i in range(1600)), *([centres[0]] * 700)]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = df.select(F.col("vec_id").alias("cls"), F.col("vec_id").alias("first"), F.col("embedding").alias("v"), (F.col("vec_id") % 20 == 0).alias("asks")).where("vec_id < 1600")
    leaves, models = tree(index, part_rows=60, most_parts=4, sample_rows=1000)
    assert len(models) > 1 and all(r.parts > 1 for m in models for r in m.collect())
    assert leaves.where("not asks").count() == 1600 == leaves.where("not asks").select("cls").distinct().count()
    assert leaves.groupBy("node").agg(F.count_if(~F.col("asks")).alias("n")).agg(F.max("n")).first()[0] < 800
    found = search(df, F.col("vec_id") % 20 == 0, part_rows=60, most_parts=4, sample_rows=1000).collect()
    hits, total = answers(rows, found, 20)
    assert total == 1150 and hits >= 0.9 * total


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert link_vectors(none).count() == 0 and search(none, F.col("vec_id") % 10 == 0).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(1000, 1100)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(1000, 1100)}, 5: 5}
