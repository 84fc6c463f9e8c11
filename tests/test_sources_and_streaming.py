"""Readers, writers, reports and the streaming operators."""

import json

from pyspark.sql import functions as F

from lodestone.sources import tables as T
from lodestone.streaming import processors as X


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"user_id": "u", "stars": 4.0, "date": "2018-01-02"}\n{"user_id": "v"}\n')
    assert [tuple(r) for r in T.read_json_lines(spark, str(tmp_path / "a.json"), "user_id string, stars double").orderBy("user_id").collect()] == [("u", 4.0), ("v", None)]
    (tmp_path / "p.csv").write_text("1,0,2.5,3\n2,1,-1,0\n")
    assert [tuple(r) for r in T.read_points(spark, str(tmp_path / "p.csv"), 2).orderBy("id").collect()] == [(1, 0.0, [2.5, 3.0]), (2, 1.0, [-1.0, 0.0])]
    (tmp_path / "t.csv").write_text('"d","c","a","b","x","p"\n"11/1/2000","00012","","","","0047"\n"1/3/01","7","","","","5"\n"01/03/2001","07","","","","6"\n')
    assert [tuple(r) for r in T.read_transactions(spark, str(tmp_path / "t.csv")).orderBy("product_id").collect()] == [("1/3/01-7", 5), ("01/03/01-7", 6), ("11/1/00-12", 47)]
    (tmp_path / "c.csv").write_text('city,stars\n"O\'Fallon, MO",3.5\n')
    assert T.read_csv(spark, str(tmp_path / "c.csv"), "city string, stars double").first().city == "O'Fallon, MO"


def test_reports(spark, tmp_path):
    sets = spark.createDataFrame([(1, ["b"]), (1, ["a"]), (2, ["a", "b"])], "size int, items array<string>")
    assert [r.value for r in T.itemset_report(sets).collect()] == ["('a'),('b')", "('a', 'b')"]
    whole = [r.value for r in T.candidate_report(sets, sets.where("size = 1")).collect()]
    assert whole == ["Candidates:", "('a'),('b')", "", "('a', 'b')", "", "Frequent Itemsets:", "('a'),('b')", ""]
    assert [r.value for r in T.candidate_report(sets.limit(0), sets.limit(0)).collect()] == ["Candidates:", "Frequent Itemsets:"]
    groups = spark.createDataFrame([(2, [3, 4]), (1, [9])], "size int, members array<long>")
    assert [r.value for r in T.community_report(groups).collect()] == ["'9'", "'3', '4'"]
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.5)], "src long, dst long, betweenness double")
    assert [r.value for r in T.betweenness_report(edges).collect()] == ["('2', '3'),2.5", "('1', '2'),1.0"]
    assert json.loads(T.answers(spark.sql("SELECT 3 AS n")).first().value) == {"n": 3}
    T.write_csv(groups.select("size"), str(tmp_path / "out"), one_file=True)
    T.write_text(T.community_report(groups), str(tmp_path / "text"))
    assert T.read_csv(spark, str(tmp_path / "out"), "size int").count() == 2 and spark.read.text(str(tmp_path / "text")).count() == 2


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streaming_keeps_state_across_batches(spark, tmp_path):
    df = spark.range(600).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    df.orderBy("ts").repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: X.read_files(spark, str(tmp_path / "in"), "ts timestamp, user_id long, event_type string, value double")
    run(X.bloom(read(), bits=4999), "bloomed")
    assert spark.sql("SELECT sum(unseen) FROM bloomed").first()[0] == 50
    run(X.reservoir(read(), size=20), "kept")
    last = spark.sql("SELECT max(seen) AS seen, max(size(sample)) AS n FROM kept").first()
    assert (last.seen, last.n) == (600, 20)
    from lodestone.operators.streams import distinct_by_window

    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("seq", F.unix_timestamp("ts") / 60 + 1)  # 60 rows an hour
    wanted = {(r.window * 3600, r.estimate) for r in distinct_by_window(batch, "user_id", 60).collect()}
    at_once = X.read_files(spark, str(tmp_path / "in"), "ts timestamp, user_id long", files=100)  # nothing comes late
    run(X.distinct_estimate(at_once, late="0 seconds"), "estimates")
    found = {(r.at, r.estimate) for r in spark.sql("SELECT unix_timestamp(start) AS at, estimate FROM estimates").collect()}
    assert found and found <= wanted
    run(X.tumbling_count(read(), late="0 seconds"), "hours")
    assert 0 < spark.sql("SELECT sum(n) FROM hours").first()[0] <= 600
