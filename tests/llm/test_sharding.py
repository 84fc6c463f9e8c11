import zlib
from collections import defaultdict

from lodestone.llm.sharding import shard_documents


def check(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for s, own in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in own) == list(range(len(own)))
    want = sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} <= {"bytes"} and all(r.grown_shard is None for r in rows)
    return {s: sum(r.size for r in own) for s, own in by.items()}


def test_odd_rows_and_empty(odd, odd_rows, empty):
    check(shard_documents(odd, shards=3).collect(), [r[:2] for r in odd_rows], 3)
    assert shard_documents(empty).count() == 0


def test_near_equal_and_groups_whole(spark):
    rows = [(i, "text %d " % (i % 700) * (i % 700 % 40 + 1), "en", f"s{i % 3}") for i in range(2100)] + [(5000 + i, "hot " * 50, "en", "s0") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = shard_documents(docs, shards=8).collect()
    held = check(found, [r[:2] for r in rows], 8)
    assert max(held.values()) < 1.03 * min(held.values())
    where = defaultdict(set)
    for r in found:
        where[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 1  # only the group that is larger than a shard
