import random
from collections import defaultdict

import numpy as np

from lodestone.llm.jaccard_join import forest, join_documents, keep_one, levels_for, runs_for, walk


def sets(rows, n=5):
    out = []
    for _, t in rows:
        w = (t or "").split(" ")
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(rows):
    s = sets(rows)
    links = [[j for j in range(len(s)) if j != i and s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])] for i in range(len(s))]
    part = list(range(len(s)))
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(links):
            low = min([part[i], *(part[j] for j in own)])
            if low != part[i]:
                part[i], changed = low, True
    least = defaultdict(list)
    for i, p in enumerate(part):
        least[p].append(rows[i][0])
    ids = [min((x for x in least[p] if x is not None), default=None) for p in part]
    same = defaultdict(list)
    for i, x in enumerate(s):
        same[frozenset(x) if x else i].append(rows[i][0])
    classes = [min((v for v in same[frozenset(x) if x else i] if v is not None), default=None) for i, x in enumerate(s)]
    return [(r[0], c, len(k), p) for r, c, k, p in zip(rows, classes, links, ids, strict=True)]


def agree(found, rows):
    order = lambda r: (r[0] is None, str(r))
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.component_id) for r in found), key=order) == sorted(brute(rows), key=order)


def test_equals_brute_force(spark):
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 5)))
    line = [word() for _ in range(12)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(pick.randint(1, 120))] + (line if i % 3 == 0 else [])
        rows.append((10 * i, " ".join(words)))
        for c in range(pick.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(pick.choice([0, 1, 1, 2, 4])):
                copy[pick.randrange(len(copy))] = word()
            rows.append((10 * i + c + 1, " ".join(copy)))
    base = [word() for _ in range(150)]
    for i in range(70):  # a group of near copies that no token splits
        copy = list(base)
        copy[pick.randrange(150)] = word()
        rows.append((5000 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = join_documents(docs, bucket=20, block=16).collect()
    agree(found, rows)
    kept = defaultdict(int)
    for r in found:
        kept[r.component_id] += r.kept
    assert set(kept.values()) == {1}


def test_odd_rows_and_empty(odd, odd_rows, empty):
    found = join_documents(odd).collect()
    agree([r for r in found], [r[:2] for r in odd_rows])
    assert sum(r.kept for r in found) == len(odd_rows) - 2  # a copy of 4, and 5
    assert join_documents(empty).count() == 0


def test_of_equal_rows_with_other_columns_the_least_stays(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "fr"), (1, text, "de"), (1, text, "en"), (2, text, "aa"), (3, "other words stand here in this row", "x")]
    for order in (rows, rows[::-1]):
        assert sorted(tuple(r) for r in keep_one(spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)).collect()) == [rows[1], rows[4]]


def test_levels_grow_with_the_rows():
    assert [levels_for(n, 2048) for n in (0, 256_000, 10**8, 10**11)] == [3, 3, 4, 6]


def test_blocks_bounded_by_bytes_give_the_same_links(spark):
    pick = random.Random(16)
    base = [f"w{pick.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(pick.randint(0, 8)):
            copy[pick.randrange(400)] = f"x{pick.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    agree(join_documents(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=20_000).collect(), rows)


def test_runs_follow_the_recall():
    assert runs_for(0.5, 0.8, 1.6, 3) < runs_for(0.999, 0.8, 1.6, 3) < runs_for(0.999, 0.5, 1.6, 3)


def test_walk_reaches_what_all_pairs_link():
    pick = np.random.default_rng(9)
    base = pick.integers(0, 256, (6, 64), dtype=np.uint8)
    sketch = base[pick.integers(0, 6, 300)].copy()
    for row in sketch:  # chains: some copies are near one another only by way of a third
        row[pick.choice(64, pick.integers(0, 16), replace=False)] = pick.integers(0, 256)
    size = pick.integers(90, 125, 300)

    def parts(a, b):
        a, b = forest(np.asarray(a, np.int64), np.asarray(b, np.int64))
        return set(zip(a.tolist(), b.tolist(), strict=True))

    def pairs(left, right):
        same = [(x, y) for x in left for y in right if x != y and (sketch[x] == sketch[y]).sum() >= 45 and min(size[x], size[y]) >= 0.8 * max(size[x], size[y])]
        return parts(*zip(*same, strict=True))

    everything, left = np.arange(300), np.nonzero(pick.random(300) < 0.4)[0]
    right = np.setdiff1d(everything, left)
    assert parts(*walk(sketch, size, everything, None, 0.8, 45)) == pairs(everything, everything)
    assert parts(*walk(sketch, size, left, right, 0.8, 45)) == pairs(left, right)
    assert len(walk(sketch, size, left[:0], right, 0.8, 45)[0]) == 0
    assert len(walk(sketch, size, everything, None, 0.8, 45)[0]) < 300


def test_a_level_is_split_once(spark, monkeypatch):
    from lodestone.llm import jaccard_join

    made, real = [], jaccard_join.save
    monkeypatch.setattr(jaccard_join, "save", lambda df, name: made.append(name) or real(df, name))
    docs = spark.createDataFrame([(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z " + str(i)) for i in range(8)], "doc_id long, text string")
    found = jaccard_join.join_documents(docs, levels=2, bucket=4).collect()
    assert "join-paths-1" in made
    assert [r.n_links for r in found] == [7] * 8 and {r.component_id for r in found} == {0}
