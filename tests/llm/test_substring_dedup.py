import random
import re
from collections import Counter

import numpy as np

from lodestone.llm.substring_dedup import ALONE, Chunk, dedup_substrings, hot_minimisers, span_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in texts for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def same(found, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in found), key=order) == sorted(want, key=order)


def test_equals_brute_force(spark):
    pick = random.Random(2)
    word = lambda: "".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 3)))
    shared = [[word() for _ in range(pick.randint(8, 60))] for _ in range(6)]
    rows = []
    for i in range(300):
        words = [word() for _ in range(pick.randint(0, 60))]
        if i % 3 == 0:
            at = pick.randint(0, len(words))
            words[at:at] = pick.choice(shared)
        if i % 11 == 0:
            words += ["x", "y"] * pick.randint(1, 40)
        rows.append((i, pick.choice([" ", "\n", "  \t", "\x0b"]).join(words)))
    rows += [(900 + i, rows[5 * i][1]) for i in range(20)] + [(7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, m in ((6, 3), (35, 8), (5, 5)):
        same(dedup_substrings(docs, k=k, m=m, chunk_bytes=2000, bucket_bytes=3000).collect(), brute(rows, k))


def test_odd_rows_and_empty(odd, odd_rows, empty):
    same(dedup_substrings(odd).collect(), brute([r[:2] for r in odd_rows], 35))
    assert dedup_substrings(empty).count() == 0


def test_a_common_line_in_changing_surroundings(spark):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 6)))
    line, passage = [word() for _ in range(12)], [word() for _ in range(60)]
    rows = []
    for i in range(1200):
        words = [word() for _ in range(pick.randint(40, 90))]
        if i % 3 == 0:
            words[20:20] = line
        elif i % 9 == 1:
            words[15:15] = passage
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, rows[0][1]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    most = 40
    hot = hot_minimisers(docs, 35, 5, most)
    assert len(hot) > 2
    same(dedup_substrings(docs, hot_strings=most, chunk_bytes=20000, bucket_bytes=30000).collect(), brute(rows, 35))

    def largest(hot):
        """The most distinct strings of a minimiser over all chunks; windows that travel alone meet only their equals."""
        found = set()
        for a in range(20):
            chunk = Chunk([t.encode() for _, t in rows[a::20]], 35, 5, hot)
            strings = list(chunk.strings)
            found |= {(key, strings[o]) for key, o in zip(chunk.keys.tolist(), chunk.ordinals.tolist(), strict=True) if key < int(ALONE)}
        return max(Counter(key for key, _ in found).values())

    assert largest(np.zeros(0, np.uint32)) > 150 and largest(hot) <= 2 * most


def test_equal_spans_have_equal_hashes():
    h = np.random.default_rng(3).integers(0, 2**63, 400, dtype=np.uint64)
    h[300:350] = h[20:70]
    a, b = span_hashes(h, np.array([20, 300, 21]), np.array([70, 350, 70])), span_hashes(h[20:70], np.array([0]), np.array([50]))
    assert a[0] == a[1] == b[0] != a[2]
