"""Queries on rating prediction, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import recommend as P
from lodestone.sources.tables import checkpoint, table


def _ratings(spark, sf_dir, by="item"):
    """user, item, r, held: the mean stars of a customer for a part; held out by the last order. Dealt by ``by``."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), (1 + F.expr("CAST(l_quantity AS INT) % 5")).alias("stars"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"))
    dealt = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).repartition(by)  # serves what groups by it besides
    mean = dealt.groupBy("user", "item").agg(F.avg("stars").alias("r"), (F.max("l_orderkey") % 10 == 0).alias("held"))
    return mean


def _split(spark, sf_dir):
    rows = _ratings(spark, sf_dir)
    return rows.where("not held").select("user", "item", "r"), rows.where("held").select("user", "item", "r")


def _rounded(df):
    """To six digits, where means of few values don't fall on ties."""
    return df.withColumn("prediction", F.round("prediction", 6))


def item_similarity(spark, sf_dir):
    """Weights of six digits, without noise in ties."""
    train, _ = _split(spark, sf_dir)
    return P.item_pairs(train).select("a", "b", "n", P.six_digits(F.col("weight")).alias("weight"))


def cf_predict(spark, sf_dir):
    return _rounded(P.predict_held(_ratings(spark, sf_dir, "user")))


def hybrid_blend(spark, sf_dir):
    return _rounded(P.blend_held(_ratings(spark, sf_dir, "user")))


def ensemble_mean(spark, sf_dir):
    train, held = _split(spark, sf_dir)
    parts = [P.bias_model(train.where(F.pmod(F.col("item"), F.lit(3)) != k), held) for k in range(3)]
    return _rounded(P.ensemble_mean(parts))


def rmse(spark, sf_dir):
    train, held = _split(spark, sf_dir)
    return P.rmse(P.bias_model(train, held), held).select(F.round("rmse", 6).alias("rmse"))


def error_histogram(spark, sf_dir):
    train, held = _split(spark, sf_dir)
    return P.error_histogram(P.bias_model(train, held), held)


def _routed(spark, sf_dir):
    train, held = _split(spark, sf_dir)
    embedded = train.where("user % 4 <> 0").select(F.lit("user").alias("kind"), F.col("user").alias("id")).unionByName(train.where("item % 4 <> 0").select(F.lit("item").alias("kind"), F.col("item").alias("id")))
    users = table(spark, sf_dir, "customer").where("c_custkey % 8 <> 0").select(F.col("c_custkey").alias("user"))
    businesses = table(spark, sf_dir, "part").where("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("item"))
    return P.routes(held.select("user", "item"), embedded, users, businesses)


def cold_start_route_counts(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"))


def cold_start_predict_fallback(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    users = train.groupBy("user").agg(F.avg("r").alias("user_mean"))
    stars = train.groupBy("item").agg(F.avg("r").alias("business_stars"))
    return _rounded(P.route_fallback(_routed(spark, sf_dir), users, stars))


FEATURES = ["discount", "tax", "price", "user_mean", "user_n", "balance", "item_mean", "item_n"]


def _features(spark, sf_dir):
    """Eight features of a rating (M19): three measures of the item, three of the user, two of the item's profile; unknown stays null."""
    train, _ = _split(spark, sf_dir)
    measures = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_extendedprice").alias("price"))
    user = train.groupBy("user").agg(F.avg("r").alias("user_mean"), F.count("*").cast("double").alias("user_n"))
    item = train.groupBy("item").agg(F.avg("r").alias("item_mean"), F.count("*").cast("double").alias("item_n"))
    profile = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user"), F.col("c_acctbal").alias("balance"))
    rows = _ratings(spark, sf_dir).join(measures, "item", "left").join(user, "user", "left").join(item, "item", "left").join(profile, "user", "left")
    return rows.select("user", "item", "r", "held", *FEATURES)


#: Features that are means, to four digits in the query; its counts and balances are as they are.
MEANS = ["discount", "tax", "price", "user_mean", "item_mean"]


def gbt_features(spark, sf_dir):
    return _features(spark, sf_dir).select("user", "item", *((P.half_away(F.col(c)) if c in MEANS else F.col(c)).alias(c) for c in FEATURES))


def gbt_predict(spark, sf_dir):
    rows = P.with_missing(_features(spark, sf_dir), FEATURES)
    model = P.train_trees(rows.where("not held"), FEATURES, "r")
    return model.transform(rows.where("held")).select("user", "item", "prediction")


def gbt_tuning(spark, sf_dir):
    """Errors of four settings over three folds."""
    train = _features(spark, sf_dir).where("not held")
    return P.tune_trees(train, FEATURES, "r", [2, 3], [2, 4])


def gbt_folds(spark, sf_dir):
    """The mean of models that each leave out one of five folds."""
    rows = _features(spark, sf_dir)
    return P.fold_ensemble(rows.where("not held"), FEATURES, "r", rows.where("held"), folds=5, depth=3, trees=3)


#: The features that a route's model may use: those of what is known there.
ROUTE_FEATURES = {"comb": FEATURES, "users": ["user_mean", "user_n", "balance"], "businesses": ["discount", "tax", "price", "item_mean", "item_n"], "nulls": ["balance", "price"]}


def routed_predict(spark, sf_dir):
    """Each held-out pair by the model of its route, or by what is known without one."""
    rows = checkpoint(_features(spark, sf_dir))
    train = rows.where("not held")
    models = {route: (P.train_trees(train, columns, "r", depth=3, trees=3), columns) for route, columns in ROUTE_FEATURES.items()}
    return P.dispatch(_routed(spark, sf_dir), rows.drop("r", "held"), models, cold_start_predict_fallback(spark, sf_dir))


_R = f"""r AS MATERIALIZED (SELECT o_custkey AS "user", l_partkey AS item, avg(1 + CAST(l_quantity AS INT) % 5) AS r, max(l_orderkey) % 10 = 0 AS held
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    t AS MATERIALIZED (SELECT "user", item, r FROM r WHERE NOT held), v AS MATERIALIZED (SELECT "user", item, r FROM r WHERE held),
    im AS MATERIALIZED (SELECT item, avg(r) AS m FROM t GROUP BY 1), um AS MATERIALIZED (SELECT "user", avg(r) AS m FROM t GROUP BY 1)"""
_SIM = """s AS MATERIALIZED (SELECT a.item AS a, b.item AS b, count(*) AS n, avg((5 - abs(a.r - b.r)) / 5) AS near, covar_pop(a.r, b.r) AS c, sqrt(var_pop(a.r) * var_pop(b.r)) AS norm
    FROM t a JOIN t b ON a."user" = b."user" AND a.item < b.item GROUP BY 1, 2),
    sim AS MATERIALIZED (SELECT a, b, n, CASE WHEN n = 1 THEN (5 - abs(x.m - y.m)) / 5 WHEN n = 2 THEN near WHEN norm > 1e-12 THEN c / norm ELSE 0 END AS weight
    FROM s JOIN im x ON x.item = a JOIN im y ON y.item = b)"""
_CF = """w AS (SELECT v."user", v.item, q.item AS b, q.r, floor(round(coalesce(z.weight, CASE WHEN v.item = q.item THEN 1.0 END, (5 - abs(x.m - y.m)) / 5), 9) * 1e6 + 0.5) / 1e6 AS w
    FROM v JOIN im x ON x.item = v.item JOIN t q ON q."user" = v."user" JOIN im y ON y.item = q.item
    LEFT JOIN sim z ON z.a = least(v.item, q.item) AND z.b = greatest(v.item, q.item)),
    k AS (SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY w DESC, b) AS k FROM w),
    p AS (SELECT "user", item, sum(w * r) / nullif(sum(abs(w)), 0) AS p FROM k WHERE k <= 15 GROUP BY 1, 2),
    cf AS MATERIALIZED (SELECT v."user", v.item, CASE WHEN um.m IS NULL THEN 3.5 WHEN p."user" IS NULL THEN um.m ELSE coalesce(p.p, 3.5) END AS prediction
    FROM v LEFT JOIN p ON p."user" = v."user" AND p.item = v.item LEFT JOIN um ON um."user" = v."user")"""


def _bias(name: str, condition: str = "true") -> str:
    return f"""{name} AS MATERIALIZED (SELECT v."user", v.item, g.m + coalesce(u.m - g.m, 0) + coalesce(i.m - g.m, 0) AS prediction FROM v CROSS JOIN (SELECT avg(r) AS m FROM t WHERE {condition}) g
    LEFT JOIN (SELECT "user", avg(r) AS m FROM t WHERE {condition} GROUP BY 1) u ON u."user" = v."user" LEFT JOIN (SELECT item, avg(r) AS m FROM t WHERE {condition} GROUP BY 1) i ON i.item = v.item)"""


_ROUTED = """f AS (SELECT v."user", v.item, v."user" IN (SELECT "user" FROM t WHERE "user" % 4 <> 0) AS ue, v.item IN (SELECT item FROM t WHERE item % 4 <> 0) AS ie,
    v."user" IN (SELECT c_custkey FROM customer WHERE c_custkey % 8 <> 0) AS u, v.item IN (SELECT p_partkey FROM part WHERE p_partkey % 8 <> 0) AS b FROM v),
    routed AS (SELECT "user", item, CASE WHEN ue AND ie THEN 'comb' WHEN ue AND NOT ie AND b THEN 'users' WHEN NOT ue AND ie AND u THEN 'businesses'
    WHEN NOT ue AND NOT ie AND u AND b THEN 'nulls' WHEN NOT ue AND NOT ie AND NOT u AND b THEN 'business_null' WHEN NOT ue AND NOT ie AND u AND NOT b THEN 'user_null' ELSE 'null' END AS route FROM f)"""

SQL = {
    "item_similarity": f"WITH {_R}, {_SIM} SELECT a, b, n, floor(round(weight, 9) * 1e6 + 0.5) / 1e6 AS weight FROM sim",
    "cf_predict": f'WITH {_R}, {_SIM}, {_CF} SELECT "user", item, round(prediction, 6) AS prediction FROM cf',
    "hybrid_blend": f'WITH {_R}, {_SIM}, {_CF}, {_bias("m")} SELECT "user", item, round(0.1 * cf.prediction + 0.9 * m.prediction, 6) AS prediction FROM cf JOIN m USING ("user", item)',
    "ensemble_mean": f"""WITH {_R}, {', '.join(_bias(f'm{k}', f'item % 3 <> {k}') for k in range(3))}
        SELECT "user", item, round(avg(prediction), 6) AS prediction FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2) GROUP BY 1, 2""",
    "rmse": f'WITH {_R}, {_bias("m")} SELECT round(sqrt(avg(power(prediction - r, 2))), 6) AS rmse FROM m JOIN v USING ("user", item)',
    "error_histogram": f'WITH {_R}, {_bias("m")} SELECT CAST(least(floor(abs(prediction - r)), 4) AS INT) AS low, count(*) AS n FROM m JOIN v USING ("user", item) GROUP BY 1',
    "cold_start_route_counts": f"WITH {_R}, {_ROUTED} SELECT route, count(*) AS n FROM routed GROUP BY 1",
    "cold_start_predict_fallback": f"""WITH {_R}, {_ROUTED} SELECT d."user", d.item, route, round(CASE route WHEN 'business_null' THEN im.m WHEN 'user_null' THEN um.m WHEN 'null' THEN 3.75 END, 6) AS prediction
        FROM routed d LEFT JOIN um ON um."user" = d."user" LEFT JOIN im ON im.item = d.item""",
    "gbt_features": f"""WITH {_R}, p AS (SELECT l_partkey AS item, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1),
        u AS (SELECT "user", avg(r) AS m, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY 1), i AS (SELECT item, avg(r) AS m, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY 1)
        SELECT r."user", r.item, round(discount, 4) AS discount, round(tax, 4) AS tax, round(price, 4) AS price, round(u.m, 4) AS user_mean, u.n AS user_n, c_acctbal AS balance,
        round(i.m, 4) AS item_mean, i.n AS item_n FROM r LEFT JOIN p ON p.item = r.item LEFT JOIN u ON u."user" = r."user" LEFT JOIN i ON i.item = r.item
        LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = r."user" """,
}

QUERIES = {f.__name__: f for f in (item_similarity, cf_predict, hybrid_blend, ensemble_mean, rmse, error_histogram, cold_start_route_counts, cold_start_predict_fallback, gbt_features, gbt_predict, gbt_tuning, gbt_folds, routed_predict)}
