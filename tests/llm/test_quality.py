import random

import numpy as np

from lodestone.llm.quality import score_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def test_held_out_accuracy(spark):
    pick = random.Random(9)
    word = lambda: "".join(pick.choice("abdeilnorst") for _ in range(pick.randint(2, 9)))
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        words = [word() + pick.choice(["***", "$$$", "%%%"]) if bad else word() for _ in range(pick.randint(5, 80))]
        text = " ".join(words)
        rows.append((i, text, "en", f"s{pick.randrange(5)}" if not bad else "s9", len(text), 0.0))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not bad), 0))
    seen = {x[0] for x in labels}
    found = score_documents(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), carry=("source",)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.accepted == (r.score >= 0.5) for r in found)
    assert np.mean([r.accepted == (r.doc_id % 6 != 0) for r in found if r.doc_id not in seen]) > 0.98
    assert {r.source for r in found} == {r[3] for r in rows}


def test_odd_rows_empty_and_no_labels(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (4, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    assert len(score_documents(odd, labels).collect()) == len(odd_rows)
    assert {r.score for r in score_documents(odd, labels.limit(0)).collect()} == {1.0}
    assert score_documents(empty, labels).count() == 0
