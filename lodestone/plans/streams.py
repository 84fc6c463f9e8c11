"""Queries on stream summaries and clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.scalars import PRIME, linear_hashes
from lodestone.operators import cluster as C
from lodestone.operators import streams as S
from lodestone.sources.tables import table

WINDOW, HASHES = 1000, 50


def _events(spark, sf_dir):
    return S.numbered(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), "ts", "event_id")


def bloom_fpr_by_window(spark, sf_dir):
    return S.bloom_by_window(_events(spark, sf_dir), "user_id", WINDOW, HASHES, 4999).withColumn("fpr", F.round("fpr", 6))


def fm_distinct_by_window(spark, sf_dir):
    return S.distinct_by_window(_events(spark, sf_dir), "user_id", WINDOW, HASHES)


def fm_ratio(spark, sf_dir):
    return fm_distinct_by_window(spark, sf_dir).agg(F.round(F.sum("estimate") / F.sum("truth"), 6).alias("ratio"))


def running_distinct_users(spark, sf_dir):
    return S.running_distinct(_events(spark, sf_dir), "user_id", WINDOW)


def reservoir_snapshots(spark, sf_dir):
    return S.reservoir_snapshots(_events(spark, sf_dir), "user_id")


def events_tumbling_count(spark, sf_dir):
    start = F.window("ts", "1 hour")["start"]
    rows = table(spark, sf_dir, "events").groupBy(start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("features"))


def cluster_summaries(spark, sf_dir):
    return C.summaries(_points(spark, sf_dir)).select("cluster", "place", "n", F.round("sum", 4).alias("sum"), F.round("sumsq", 4).alias("sumsq"))


def nearest_centroid_mahalanobis(spark, sf_dir):
    points = _points(spark, sf_dir)
    return C.nearest(points, C.packed(C.summaries(points))).withColumn("distance", F.round("distance", 4))


def kmeans_assign(spark, sf_dir):
    return C.k_means(_points(spark, sf_dir).select("id", "features"), 10).select("id", "cluster")


def bfr_rounds(spark, sf_dir):
    return C.bfr(_points(spark, sf_dir).withColumn("features", F.transform("features", lambda x: x.cast("double"))), 5)[0]


def bfr_assignments(spark, sf_dir):
    return C.bfr(_points(spark, sf_dir).withColumn("features", F.transform("features", lambda x: x.cast("double"))), 5)[1]


_SEQ = "e AS (SELECT user_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events)"


def _arrays(modulus: int) -> str:
    return "[" + ", ".join(f"(user_id * {a} + {b}) % {PRIME} % {modulus}" for a, b in linear_hashes(HASHES, modulus)) + "]"


_FM = f"""{_SEQ}, u AS (SELECT DISTINCT (seq - 1) // {WINDOW} AS w, user_id FROM e),
    h AS (SELECT w, unnest(range({HASHES})) AS j, unnest({_arrays(997)}) AS h FROM u),
    r AS (SELECT w, j, max(CASE WHEN h = 0 THEN 1 ELSE length(bin(h)) - length(rtrim(bin(h), '0')) END) AS r FROM h GROUP BY 1, 2),
    x AS (SELECT w, CAST(floor(sum(power(2, r)) / {HASHES}) AS BIGINT) AS estimate FROM r GROUP BY 1),
    t AS (SELECT w, count(*) AS truth FROM u GROUP BY 1)"""

SQL = {
    "bloom_fpr_by_window": f"""WITH {_SEQ}, f AS (SELECT user_id, min(seq) AS seq FROM e GROUP BY 1), b AS (SELECT DISTINCT seq, unnest({_arrays(4999)}) AS bit FROM f),
        s AS (SELECT bit, min(seq) AS set_at FROM b GROUP BY 1), v AS (SELECT seq, max(set_at) < seq AS fp FROM b JOIN s USING (bit) GROUP BY seq),
        c AS (SELECT (seq - 1) // {WINDOW} AS w, count(*) AS unseen, count(*) FILTER (fp) AS fp FROM v GROUP BY 1)
        SELECT w AS "window", coalesce(unseen, 0) AS unseen, coalesce(fp, 0) AS false_positives, round(fp / nullif(unseen, 0), 6) AS fpr
        FROM (SELECT DISTINCT (seq - 1) // {WINDOW} AS w FROM e) LEFT JOIN c USING (w)""",
    "fm_distinct_by_window": f'WITH {_FM} SELECT w AS "window", truth, estimate FROM t JOIN x USING (w)',
    "fm_ratio": f"WITH {_FM} SELECT round(sum(estimate) / sum(truth), 6) AS ratio FROM t JOIN x USING (w)",
    "running_distinct_users": f"""WITH {_SEQ}, f AS (SELECT (min(seq) - 1) // {WINDOW} AS w FROM e GROUP BY user_id), n AS (SELECT w, count(*) AS n FROM f GROUP BY 1)
        SELECT w AS "window", coalesce(n, 0) AS new, CAST(sum(coalesce(n, 0)) OVER (ORDER BY w) AS BIGINT) AS seen FROM (SELECT DISTINCT (seq - 1) // {WINDOW} AS w FROM e) LEFT JOIN n USING (w)""",
    "reservoir_snapshots": f"""WITH {_SEQ}, a AS (SELECT seq, user_id, CASE WHEN seq <= 100 THEN seq - 1 WHEN (seq * 48271 + 11) % 1000003 / 1000003.0::DOUBLE < 100 / seq THEN (seq * 69621 + 7) % 100 END AS slot FROM e),
        m AS (SELECT seq AS n, unnest([0, 20, 40, 60, 80]) AS slot FROM e WHERE seq % 100 = 0)
        SELECT n, CAST(m.slot AS INT) AS slot, max_by(user_id, seq) AS "user" FROM m JOIN a ON a.slot = m.slot AND seq <= n GROUP BY 1, 2""",
    "events_tumbling_count": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""",
    "cluster_summaries": """WITH x AS (SELECT label AS cluster, unnest(range(len(embedding))) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT cluster, CAST(place AS INT) AS place, count(*) AS n, round(sum(x), 4) AS sum, round(sum(x * x), 4) AS sumsq FROM x GROUP BY 1, 2""",
    "nearest_centroid_mahalanobis": """WITH x AS (SELECT vec_id AS id, label AS c, unnest(range(len(embedding))) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings),
        s AS (SELECT c, place, avg(x) AS m, sqrt(greatest(sum(x * x) / count(*) - power(sum(x) / count(*), 2), 0)) AS s FROM x GROUP BY 1, 2),
        d AS (SELECT id, s.c AS cluster, round(sqrt(sum(CASE WHEN s >= 1e-9 THEN power((x - m) / s, 2) ELSE 0 END)), 9) AS d FROM x JOIN s USING (place) GROUP BY 1, 2)
        SELECT id, cluster, round(d, 4) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1""",
}

QUERIES = {f.__name__: f for f in (bloom_fpr_by_window, fm_distinct_by_window, fm_ratio, running_distinct_users, reservoir_snapshots, events_tumbling_count, cluster_summaries, nearest_centroid_mahalanobis, kmeans_assign, bfr_rounds, bfr_assignments)}
