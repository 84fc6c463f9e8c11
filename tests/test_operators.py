"""Operators against plain programs on small fixtures, and their invariants."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.scalars import PRIME, guarded_ratio, linear_hashes, sigmoid, step, text_number, trailing_zeros
from lodestone.operators import baskets as B
from lodestone.operators import cluster as C
from lodestone.operators import graph as G
from lodestone.operators import recommend as P
from lodestone.operators import relational as R
from lodestone.operators import similarity as S
from lodestone.operators import streams as M
from lodestone.plans import graph, mining


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges_of(spark, pairs):
    return spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src long, dst long")


def test_itemsets(spark):
    pick = random.Random(1)
    held = [(g, i) for g in range(30) for i in pick.sample(range(7), pick.randint(1, 5))] + [(99, 1)]
    df = spark.createDataFrame(held + held[:9], "g long, i long")
    by = defaultdict(set)
    for g, i in held:
        by[g].add(i)
    want = Counter(c for own in by.values() for k in (1, 2, 3) for c in itertools.combinations(sorted(own), k))
    want = {c: n for c, n in want.items() if n >= 6}
    assert {tuple(r["items"]): r.freq for r in B.frequent_itemsets(df, "g", "i", 6).collect()} == want
    grown = {tuple(r["items"]): r.freq for r in B.fp_growth(df, "g", "i", 6).collect()}
    assert {c: n for c, n in grown.items() if len(c) <= 3} == want
    assert B.frequent_itemsets(df, "g", "i", 1000).count() == 0
    assert {r.g for r in B.baskets(df, "g", "i", 2).collect()} == {g for g, own in by.items() if len(own) > 2}
    got = {tuple(r.candidate): r.n for r in B.containment(spark.createDataFrame([([0, 1],), ([55],)], "candidate array<long>"), df, "g", "i").collect()}
    assert got == {(0, 1): sum({0, 1} <= own for own in by.values()), (55,): 0}


def test_itemsets_of_all_sizes(spark, tmp_path):
    pick = random.Random(6)
    held = {g: sorted(pick.sample(range(9), pick.randint(3, 8))) for g in range(150)}
    want = Counter(c for own in held.values() for k in range(1, 10) for c in itertools.combinations(own, k))
    want = {c: n for c, n in want.items() if n >= mining.SUPPORT // 4}
    assert max(map(len, want)) > 3
    df = spark.createDataFrame([(g, i) for g, own in held.items() for i in own], "g long, i long")
    for made in (B.frequent_itemsets(df, "g", "i", mining.SUPPORT // 4), B.fp_growth(df, "g", "i", mining.SUPPORT // 4)):
        assert {tuple(r["items"]): r.freq for r in made.collect()} == want
    four = [(g, i) for g in range(mining.SUPPORT) for i in range(4)]
    spark.createDataFrame(four, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"b{i}") for i in range(4)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert Counter(r["size"] for r in mining.fpgrowth_itemsets(spark, str(tmp_path)).collect()) == {1: 4, 2: 6, 3: 4, 4: 1}


def test_jaccard_and_lsh(spark):
    pick = random.Random(2)
    sets = {g: set(pick.sample(range(40), pick.randint(1, 12))) for g in range(40)}
    sets |= {100: {1, 2}, 101: {1, 2, 3, 4}, 102: {50, 51}, 103: {50, 51}}
    df = spark.createDataFrame([(g, i) for g, own in sets.items() for i in own], "g long, i long")
    want = sorted((a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]))
    assert rows(S.jaccard_exact(df, "g", "i")) == want and (100, 101, 0.5) in want
    found = rows(S.lsh_jaccard(df, "g", "i"))
    assert set(found) <= set(want) and len(found) >= 0.95 * len(want)


def scratch_bytes(spark):
    """Size of what Spark has shuffled and spilled so far."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(top, f)) for d in dirs for top, _, files in os.walk(str(d)) for f in files)


def near_copies(seed, copies=120, size=300):
    """Sets that share 280 items each with the others, the first twice."""
    pick = random.Random(seed)
    common = pick.sample(range(1 << 30), size - 20)
    sets = {g: {*common, *pick.sample(range(1 << 30, (1 << 31) - 1), 20)} for g in range(copies)}
    return sets | {copies: sets[0]}


def test_lsh_sends_a_set_once_not_once_for_each_pair(spark):
    sets = near_copies(5)
    df = spark.createDataFrame([(g, i) for g, own in sets.items() for i in own], "g long, i long").cache()
    df.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = scratch_bytes(spark)
        found = rows(S.lsh_jaccard(df, "g", "i"))
        assert scratch_bytes(spark) - before < 1 << 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == [(a, b, 1.0 if (a, b) == (0, 120) else 0.875) for a, b in itertools.combinations(sorted(sets), 2)]


def test_exact_jaccard_sends_sets_to_blocks_not_to_pairs(spark):
    sets = near_copies(6)
    df = spark.createDataFrame([(g, i) for g, own in sets.items() for i in own], "g long, i long").cache()
    df.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = scratch_bytes(spark)
        found = rows(S.jaccard_exact(df, "g", "i"))
        assert scratch_bytes(spark) - before < 1 << 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == [(a, b, 1.0 if (a, b) == (0, 120) else 0.875) for a, b in itertools.combinations(sorted(sets), 2)]
    assert rows(S.jaccard_exact(df.where("g < 40"), "g", "i", block=2000)) == [p for p in found if p[1] < 40]


def plain_cf(train, user, item):
    by_item, by_user = defaultdict(dict), defaultdict(dict)
    for u, i, r in train:
        by_item[i][u] = by_user[u][i] = r
    if user not in by_user:
        return 3.5
    mean = lambda d: sum(d.values()) / len(d)
    if item not in by_item:
        return mean(by_user[user])
    found = []
    for other, r in by_user[user].items():
        a, b = by_item[item], by_item[other]
        both = [(a[u], b[u]) for u in a if u in b]
        if other == item:
            w = 1.0
        elif len(both) <= 1:
            w = (5 - abs(mean(a) - mean(b))) / 5
        elif len(both) == 2:
            w = sum((5 - abs(x - y)) / 5 for x, y in both) / 2
        else:
            mx, my = (sum(v) / len(both) for v in zip(*both, strict=True))
            norm = math.sqrt(sum((x - mx) ** 2 for x, _ in both) * sum((y - my) ** 2 for _, y in both))
            w = sum((x - mx) * (y - my) for x, y in both) / norm if norm > 1e-9 else 0.0
        found.append((-round(w, 6), other, r))
    best = sorted(found)[:15]
    total = sum(abs(w) for w, _, _ in best)
    return sum(-w * r for w, _, r in best) / total if total else 3.5


def test_item_based_prediction(spark):
    pick = random.Random(3)
    train = [(u, i, float(pick.randint(1, 5))) for u in range(12) for i in pick.sample(range(20), 9)]
    targets = [(u, i) for u in (0, 3, 7, 99) for i in (1, 5, 9, 77)]
    got = {(r.user, r.item): r.prediction for r in P.predict_by_items(spark.createDataFrame(train, "user long, item long, r double"), spark.createDataFrame(targets, "user long, item long")).collect()}
    assert set(got) == set(targets)
    for key in targets:
        assert got[key] == pytest.approx(plain_cf(train, *key), abs=1e-4), key


def test_routes_cover_every_row(spark):
    pairs = spark.createDataFrame(list(itertools.product(range(8), range(8))), "user long, item long")
    embedded = spark.createDataFrame([("user", 0), ("user", 1), ("user", 4), ("item", 0), ("item", 2), ("item", 4)], "kind string, id long")
    users = spark.createDataFrame([(0,), (2,), (3,)], "user long")
    items = spark.createDataFrame([(0,), (1,), (3,), (3,)], "item long")
    got = {(r.user, r.item): r.route for r in P.routes(pairs, embedded, users, items).collect()}
    assert len(got) == 64
    assert [got[k] for k in ((0, 2), (0, 1), (2, 0), (2, 3), (7, 3), (3, 7), (7, 7), (4, 7))] == ["comb", "users", "businesses", "nulls", "business_null", "user_null", "null", "null"]


def test_graph(spark):
    bridge = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4), (7, 8)]
    e = edges_of(spark, bridge)
    assert rows(G.connected_components(e)) == [(i, 1) for i in range(1, 7)] + [(7, 7), (8, 7)]
    found = {(a, b): v for a, b, v in rows(G.edge_betweenness(e))}
    assert found[3, 4] == 9 and found[1, 2] == 1 and found[1, 3] == 4 and found[7, 8] == 1
    square = {v for _, _, v in rows(G.edge_betweenness(edges_of(spark, [(1, 2), (2, 3), (3, 4), (1, 4)])))}
    assert square == {2.0}
    parts = defaultdict(set)
    for node, label in rows(G.girvan_newman(e)):
        parts[label].add(node)
    assert sorted(map(sorted, parts.values())) == [[1, 2, 3], [4, 5, 6], [7, 8]]
    tiny = edges_of(spark, [(1, 2), (2, 3)])
    assert rows(G.girvan_newman(tiny, small=0)) == rows(G.girvan_newman(tiny))
    assert {n for n, _ in rows(G.label_propagation(e))} == set(range(1, 9))
    walks = G.weighted_walks(e.withColumn("weight", F.lit(1.0)), 5)
    steps = {(a, b): c for a, b, c in rows(walks)}
    assert all((steps[a, b - 1], c) in {p for x in bridge for p in (x, x[::-1])} for (a, b), c in steps.items() if b)


def test_ends_are_drawn_from_all_vectors(spark, tmp_path):
    held = [(i, [0.5, -1.0], i % 10) for i in range(1200)]
    spark.createDataFrame(held, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = graph.negative_samples(spark, str(tmp_path)).collect()
    assert len(found) == 6 * 1200
    want = sorted((i, i * 7 % 1200 if c == 0 else (i * 31 + i * 7 % 1200 * 17 + c * 7919) % 1200, c) for i in range(1200) for c in range(6))
    assert sorted((r.start_node, r.end_node, r["copy"]) for r in found) == want
    assert {r.end_node for r in found if r.label} == set(range(1200))
    assert {(r.start_node, r.end_node) for r in graph.metapath_score(spark, str(tmp_path)).collect()} == {(i, i * 7 % 1200) for i in range(1200)}


def test_streams_against_sequential_programs(spark):
    pick = random.Random(4)
    users = [pick.randrange(120) for _ in range(400)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(users)], "t long, user long")
    seq = M.numbered(df.repartition(5), "t")
    assert [(r.t, r.seq) for r in seq.orderBy("t").collect()] == [(i, i + 1) for i in range(400)]
    hashes, bits = linear_hashes(5, 311), 311
    field, seen, want = set(), set(), defaultdict(lambda: [0, 0])
    for i, u in enumerate(users):
        own = {(a * u + b) % PRIME % bits for a, b in hashes}
        if u not in seen:
            want[i // 100][0] += 1
            want[i // 100][1] += own <= field
        field |= own
        seen.add(u)
    got = {r.window: [r.unseen, r.false_positives] for r in M.bloom_by_window(seq, "user", 100, 5, bits).collect()}
    assert got == {w: want[w] for w in range(4)}
    held, shots = [None] * 100, {}
    for n, u in enumerate(users, 1):
        if n <= 100:
            held[n - 1] = u
        elif (n * 48271 + 11) % 1000003 / 1000003.0 < 100 / n:
            held[(n * 69621 + 7) % 100] = u
        if n % 100 == 0:
            shots.update({(n, s): held[s] for s in (0, 20, 40, 60, 80)})
    assert {(r.n, r.slot): r.user for r in M.reservoir_snapshots(seq, "user").collect()} == shots
    for r in M.distinct_by_window(seq, "user", 100).collect():
        assert r.truth == len(set(users[100 * r.window : 100 * r.window + 100])) and 0.2 * r.truth <= r.estimate <= 5 * r.truth


def test_clusters(spark):
    pick = random.Random(5)
    points = [(i, [pick.gauss(c * 20, 1), pick.gauss(-c * 15, 1), 7.0]) for i, c in enumerate([0, 1, 2] * 60)] + [(900 + i, [500.0 * (i + 1), 900.0, 7.0]) for i in range(3)]
    df = spark.createDataFrame(points, "id long, features array<double>")
    rounds, found = C.bfr(df, 3)
    for r in rounds.collect():
        assert r.n_ds + r.n_cs + r.n_rs <= len(points)
    last = rounds.orderBy(F.desc("round")).first()
    assert last.n_ds + last.n_cs + last.n_rs == len(points)
    by = {r.id: r.cluster for r in found.collect()}
    assert len(by) == len(points) and sum(by[i] >= 0 for i in range(180)) > 90


def test_relational_odd_rows(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, None, 2.0), (3, "a", 2.0)], "k long, s string, x double")
    assert {(r.k, r.code) for r in R.label_encode(df, "s", "code").collect()} == {(1, 1), (2, None), (3, 0)}
    assert {r.x for r in R.minmax_scale(df, ["x"]).collect()} == {0.0}
    assert rows(R.undirected(spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a long, b long"), "a", "b")) == [(1, 2), (2, 1)]
    assert sum(r.n_items for r in R.partition_profile(df, 4).collect()) == 3 and R.partition_profile(df, 4).count() == 4


def test_scalars(spark):
    c = F.col("x")
    df = spark.createDataFrame([(12,), (0,), (7,)], "x long").select("x", trailing_zeros(c).alias("z"), guarded_ratio(F.lit(6), c).alias("r"), sigmoid(c - c).alias("s"), step(c - 7).alias("t"), text_number(F.lit("word")).alias("w"))
    assert rows(df) == [(0, 1, 0.0, 0.5, 0.0, 3296532592), (7, 0, 6 / 7, 0.5, 1.0, 3296532592), (12, 2, 0.5, 0.5, 1.0, 3296532592)]


def test_tuned_and_routed_trees(spark):
    from lodestone.plans import recommend as Q

    sf = "/root/testdata/sf0.001"
    tuned = Q.gbt_tuning(spark, sf).collect()
    assert [(r.depth, r.trees) for r in tuned] == [(2, 2), (2, 4), (3, 2), (3, 4)]
    assert [r.best for r in tuned].count(True) == 1 and min(tuned, key=lambda r: r.rmse).best
    held = {(r.user, r.item) for r in Q._split(spark, sf)[1].collect()}
    for rows in (Q.gbt_folds(spark, sf).collect(), routed := Q.routed_predict(spark, sf).collect()):
        assert len(rows) == len(held) and {(r.user, r.item) for r in rows} == held
        assert all(r.prediction is None or 1 <= r.prediction <= 5 for r in rows)
    known = {(r.user, r.item): (r.route, r.prediction) for r in Q.cold_start_predict_fallback(spark, sf).collect()}
    for r in routed:
        route, p = known[r.user, r.item]
        assert r.route == route and (r.prediction is not None if route in Q.ROUTE_FEATURES else r.prediction == p)


def test_stored_models_local_tables_and_missing_words(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from lodestone.functions.scalars import absent
    from lodestone.operators.recommend import train_trees, with_missing
    from lodestone.operators.relational import draw, draw_again
    from lodestone.sources.tables import load_model, local_table, save_model

    rows = local_table(spark, [(i, float(i % 3), None if i % 4 else 1.0, float(i % 3)) for i in range(40)], "user int, x double, y double, r double")
    model = train_trees(rows, ["x", "y"], "r", depth=2, trees=2)
    save_model(model, str(tmp_path / "model"))
    given = with_missing(rows, ["x", "y"])
    again = load_model(PipelineModel, str(tmp_path / "model")).transform(given)
    assert again.select("user", "prediction").orderBy("user").collect() == model.transform(given).select("user", "prediction").orderBy("user").collect()
    words = local_table(spark, [("None",), ("a",), (None,)], "w string").select(absent(F.col("w")).alias("w"))
    assert sorted(str(r.w) for r in words.collect()) == ["None", "None", "a"]
    assert draw(rows, 5, "user").count() == 5 and draw_again(rows, 90, "user").count() == 90 and draw_again(rows.limit(0), 3, "user").count() == 0


def test_draw_has_no_open_ties(spark):
    many = spark.range(400).select(F.lit(1).alias("key"), F.col("id").alias("value"))
    want = [(1, i) for i in range(5)]
    for parts in (1, 7):
        for rows_of in (many.repartition(parts, "value"), many.orderBy(F.desc("value")).coalesce(parts)):
            assert rows(R.draw(rows_of, 5, "key")) == want


def test_means_are_rounded_as_sql_does(spark):
    values = [28.266949999999998, 0.04625, 2.96435, -0.00005, 0.0, 48227.05874999999, None]
    found = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(P.half_away(F.col("v")).alias("x")).collect()]
    db = pytest.importorskip("duckdb").connect()
    assert found == [db.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0] for v in values]
    assert found[0] == 28.267 != 28.2669


@pytest.mark.parametrize("kind", ["long", "string"])
def test_item_pairs_in_many_blocks_shuffle_lists_alone(spark, monkeypatch, kind):
    monkeypatch.setattr(P, "BLOCK_PAIRS", 40)
    pick = random.Random(5)
    name = (lambda i: i) if kind == "long" else (lambda i: f"i{i:02}")
    train = [(u, name(i), float(pick.randint(1, 5))) for u in range(30) for i in pick.sample(range(25), 8)]
    df = spark.createDataFrame([*train, (None, name(3), 2.0), (4, None, 1.0)], f"user long, item {kind}, r double")
    pairs = P.item_pairs(df)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(a" not in plan
    by_item, means = defaultdict(dict), defaultdict(list)
    for u, i, r in train:
        by_item[i][u] = r
        means[i].append(r)
    means[name(3)].append(2.0)
    mean = {i: sum(v) / len(v) for i, v in means.items()}
    want = {}
    for a, b in itertools.combinations(sorted(by_item), 2):
        both = [(by_item[a][u], by_item[b][u]) for u in by_item[a] if u in by_item[b]]
        if len(both) == 1:
            want[a, b] = (1, (5 - abs(mean[a] - mean[b])) / 5)
        elif len(both) == 2:
            want[a, b] = (2, sum((5 - abs(x - y)) / 5 for x, y in both) / 2)
        elif both:
            mx, my = (sum(v) / len(both) for v in zip(*both, strict=True))
            norm = math.sqrt(sum((x - mx) ** 2 for x, _ in both) * sum((y - my) ** 2 for _, y in both))
            want[a, b] = (len(both), sum((x - mx) * (y - my) for x, y in both) / norm if norm > 1e-9 else 0.0)
    got = {(r.a, r.b): (r.n, r.weight) for r in pairs.collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    targets = [(u, name(i)) for u in (0, 3, 7, 99) for i in (1, 5, 9, 77)]
    asked = spark.createDataFrame([*targets, targets[0], (None, name(1)), (2, None)], f"user long, item {kind}")
    found = P.predict_by_items(df, asked).collect()
    said = {(r.user, r.item): r.prediction for r in found}
    assert len(found) == len(targets) + 2 and said[None, name(1)] == 3.5
    monkeypatch.setattr(P, "BLOCK_PAIRS", 1 << 23)
    assert {(r.user, r.item): pytest.approx(r.prediction, abs=1e-12) for r in P.predict_by_items(df, asked).collect()} == said


def test_an_item_of_very_many_pairs_is_taken_in_parts(monkeypatch):
    import pyarrow as pa

    pick = random.Random(6)
    rows_of = [sorted(pick.sample(range(12), 6)) for _ in range(40)]
    rs = [[float(pick.randint(1, 5)) for _ in x] for x in rows_of]
    table = {"block": [0] * 40, "user": list(range(40)), "lo": [0] * 40, "k": [6] * 40, "items": rows_of, "rs": rs, "means": [[3.0] * 6] * 40}

    def weighed():
        block = P._Block([pa.RecordBatch.from_pydict(table)])
        count, out = block.ends[block.row[block.own]] - 1 - block.own, {}
        for cut in block.chunks(block.own, count):
            for i, j in block.parts(block.own[cut], block.own[cut] + 1, count[cut]):
                key, n, weight = block.weights(i, j)
                assert not set(out) & set(key.tolist())
                out.update(zip(key.tolist(), zip(n.tolist(), weight.tolist(), strict=True), strict=True))
        return out

    whole = weighed()
    monkeypatch.setattr(P, "AT_ONCE", 5)
    assert weighed() == whole


def test_predictions_pack_lists_that_are_spread_over_all_blocks(spark, monkeypatch):
    pick = random.Random(9)
    rows = [(u, i, float(pick.randint(1, 5)), pick.random() < 0.1) for u in range(400) for i in pick.sample(range(3000), 40)]
    df = spark.createDataFrame(rows, "user long, item long, r double, held boolean")
    want = {(r.user, r.item): r.prediction for r in P.predict_held(df).collect()}
    assert len(want) == sum(x[3] for x in rows)
    monkeypatch.setattr(P, "BLOCK_ASKED", 8000)
    lists = P._own_lists(P._marked(df))
    sent, dealt = [], P._packed
    size = lambda *x: sent.append((len(x), len(out := dealt(*x)))) or out
    users, items = np.arange(400), np.sort(np.array([x[1] for x in rows]).reshape(400, 40)).reshape(-1)
    size(users, np.full(400, 3.0), np.full(400, 40), np.zeros(400, np.int64), items, np.array([x[2] for x in rows]))
    assert sent[0][1] < 4 * len(rows)  # 24 bytes and more for an entry before
    for part in (np.array([5, -(1 << 62), 3]), np.array([2, 1], np.int32), np.array([1.5, np.nan]), np.array(["b", "a"], object)):
        assert all(np.array_equal(x, y, equal_nan=x.dtype.kind == "f") and x.dtype.kind == y.dtype.kind for x, y in zip(P._unpacked(P._packed(part, part)), (part, part), strict=True))
    plan = P._near(lists, 15)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "data#" in plan and "array<double>" not in plan.split("hashpartitioning(block")[0]
    got = {(r.user, r.item): r.prediction for r in P.predict_held(df).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    # in one place: passes of few pairs, and parts of one item's
    own = [(r.user, r.user_mean, r["items"], r.rs) for r in lists.collect()]
    flat = [(k, i, r) for k, x in enumerate(own) for i, r in zip(x[2], x[3], strict=True)]
    flat.sort(key=lambda x: (x[2] is None, x[0]))
    count = lambda none: np.bincount([x[0] for x in flat if (x[2] is None) == none], minlength=len(own))
    data = P._packed(np.array([x[0] for x in own]), np.array([x[1] for x in own]), count(False), count(True), np.array([x[1] for x in flat]), np.array([np.nan if x[2] is None else x[2] for x in flat]))
    mean = defaultdict(list)
    for _, i, r in flat:
        if r is not None:
            mean[i].append(r)
    means = P._packed(np.array(sorted(mean)), np.array([sum(mean[i]) / len(mean[i]) for i in sorted(mean)]))
    monkeypatch.setattr(P, "PASS_ASKED", 50)
    monkeypatch.setattr(P, "PASS_FOUND", 3)
    few = list(P._Asked([data], [means], 15).run())
    assert len(few) > 100
    assert {(u, i): p for x in few for u, i, p in zip(*x[:3], strict=True)} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_blend_of_packed_lists_equals_both_models(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ASKED", 500)
    pick = random.Random(3)
    rows = [(u, i, float(pick.randint(1, 5)), pick.random() < 0.2) for u in range(60) for i in pick.sample(range(200), 10)]
    df = spark.createDataFrame([*rows, (77, 5, 2.0, True), (3, 999, 4.0, True)], "user long, item long, r double, held boolean")
    train, held = df.where("not held"), df.where("held")
    want = {(r.user, r.item): r.prediction for r in P.blend(P.predict_by_items(train, held), P.bias_model(train, held)).collect()}
    blended = P.blend_held(df)
    assert "array<double>" not in blended._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(block")[0]
    assert {(r.user, r.item): r.prediction for r in blended.collect()} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    sent = blended._jdf.queryExecution().optimizedPlan().toString()
    assert "data#" in sent and (77, 5) in want and (3, 999) in want


def test_exact_jaccard_compares_once_where_its_pairs_are_sorted(spark):
    rows = [(g, f"w{i}") for g in range(40) for i in range(g % 5, g % 5 + 12)]
    found = S.jaccard_exact(spark.createDataFrame(rows, "g long, i string"), "g", "i").orderBy("a", "b")
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()  # sets are compared already
    assert len(found.collect()) == sum(abs(x % 5 - y % 5) <= 4 for x in range(40) for y in range(x))
