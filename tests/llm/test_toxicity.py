import random
import zlib

import numpy as np

from lodestone.llm.boosting import Boosted, Isotonic, Logistic, sigmoid
from lodestone.llm.toxicity import Features, score_documents


def corpus(n=1500):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abdeilnorst") for _ in range(pick.randint(2, 9)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(pick.randint(3, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(pick.randint(1, 3)):
                words.insert(pick.randint(0, len(words)), pick.choice(["zlugg", "Vramp!", "krozz" + word()[:3]]))
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 3 != 1:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    found = score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97


def test_odd_rows_empty_and_no_labels(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert odd.count() == len([r for r in score_documents(odd, labels).collect() if 0 <= r.score <= 1])
    assert score_documents(empty, labels).count() == 0
    assert {r.score for r in score_documents(odd, labels.limit(0)).collect()} == {0.0}


def test_features_tell_disguises_and_persons():
    f = Features({"idiot": 1.0, "lowe*": 1.0})
    x = f.of("you 1d10t and LOWEN are an idiot")
    assert x[0] > 0 and x[1] > 0 and x[2] > 0 and x[6] > 0 and f.of("")[0] == 0


def test_models_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((Boosted(x, y, depth=3).raw(x) > 0) == y).mean() > 0.95
    p = sigmoid(2 * x[:, 0])
    z = (rng.random(2000) < p).astype(float)
    assert abs(Logistic(x, z).w[1] - 2) < 0.3
    iso = Isotonic(x[:, 0], z)
    assert (np.diff(iso.y) >= 0).all() and abs(iso(np.array([1.0]))[0] - sigmoid(np.array([2.0]))[0]) < 0.1
