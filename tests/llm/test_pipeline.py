import random
import zlib

import public_tokenizers as P
from test_jaccard_join import brute as brute_links
from test_substring_dedup import brute as brute_windows
from tokenizers import Tokenizer

import corpus_pipeline as C
from lodestone.llm.personal_data import base_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(pick, n):
    return ["".join(pick.choice("abdeilnorst") for _ in range(pick.randint(2, 9))) for _ in range(n)]


def corpus():
    pick = random.Random(12)
    passage = words(pick, 60)
    rows, labels = [], []
    for i in range(400):
        w = words(pick, pick.randint(20, 150))
        bad = i % 8 == 0
        if bad:
            w = [x + "$$$" for x in w]
        elif i % 9 == 1:
            w[5:5] = passage
        elif i % 9 == 2:
            w.insert(4, f"u{i}@mail.example.com")
        rows.append([i, " ".join(w), "en", f"s{i % 4}"])
        labels.append((i, int(not bad), 0))
    for i in range(40):
        w = rows[10 * i + 3][1].split(" ")
        if len(w) > 60 and not w[0].endswith("$$$"):
            w[7] = "changed"
            rows.append([1000 + i, " ".join(w), "en", "s1"])
    return [(*r, len(r[1])) for r in rows], labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(C.STAGES):
        out = f"{tmp_path}/stage{i}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        seen.append(docs)
        if i < 4:
            assert docs.columns == C.COLUMNS
    text = [{r.doc_id: r.text for r in d.collect()} for d in seen[:4]]
    whole = {r[0]: r[1] for r in rows}
    assert sorted(text[0]) == sorted(d for d, t in whole.items() if "$$$" not in t) and all(text[0][d] == whole[d] for d in text[0])
    links = brute_links(sorted(text[0].items()))
    assert sorted(text[1]) == sorted(d for d, _, _, part in links if d == part)
    gone = {d: (n, lost, kept) for d, n, lost, kept in brute_windows(sorted(text[1].items()), 35)}
    assert text[2] == {d: text[1][d] if not lost else kept for d, (n, lost, kept) in gone.items() if lost < n or not n}
    assert any(lost for _, lost, _ in gone.values())
    assert sorted(text[3]) == sorted(text[2])
    for d, t in text[2].items():
        assert (text[3][d] == t) == (not base_spans(t)) and not base_spans(text[3][d])
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {(d, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 2]))) for d, t in text[3].items()}
    assert {(r.doc_id, r.ids_crc32) for r in seen[4].collect()} == want
    assert C.run(spark, str(tmp_path)).count() == seen[4].count()


def test_odd_rows_and_empty(spark, tmp_path, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs, least in ((odd, 1), (empty, 0)):
        for _, stage in C.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() >= least


def test_rows_without_words_all_stay(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    alone = [(None, None, "en", "a", 0), (None, None, "de", "b", 0), (3, None, "en", "a", 0), (3, None, "en", "b", 0), (4, "", None, "a", 0), (4, "", None, "b", 0), (5, " \n\t\x0b\f\r", "en", "a", 6), (5, " \n\t\x0b\f\r", "en", "a", 6)]
    rest = [(6, "\u00a0", "en", "a", 1), (7, "\u2003", "en", "a", 1), (8, text, "en", "a", 1), (8, text, "en", "b", 1), (9, text, "en", "a", 1)]
    got = C.near_duplicates_stage(spark, spark.createDataFrame(alone + rest, SCHEMA), str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got if r.doc_id is None or r.doc_id < 6), key=repr) == sorted(alone, key=repr)
    assert sorted(r.doc_id for r in got if r.doc_id and r.doc_id > 5) == [6, 7, 8]
