"""Queries of the relational group and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import short_year
from lodestone.operators import relational as R
from lodestone.sources.tables import table

#: Stars of an order line: 1 to 5 from its quantity.
STARS = "1 + CAST(l_quantity AS INT) % 5"
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _reviews(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Order lines with the customer of their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *columns)
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def review_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_review"))


def review_count_year(spark, sf_dir):
    """A half-open range, so that it reaches the scan."""
    day = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").where((day >= F.lit("1995-01-01").cast("timestamp_ntz")) & (day < F.lit("1996-01-01").cast("timestamp_ntz"))).agg(F.count("*").alias("n_review"))


def distinct_users(spark, sf_dir):
    return _reviews(spark, sf_dir).agg(F.countDistinct("o_custkey").alias("n_user"))


def distinct_items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_partkey").alias("n_item"))


def top10_users(spark, sf_dir):
    return R.top_k(_reviews(spark, sf_dir), "o_custkey")


def top10_items(spark, sf_dir):
    return R.top_k(table(spark, sf_dir, "lineitem"), "l_partkey")


def avg_rating_by_city(spark, sf_dir):
    """Mean stars by the city (nation) of the supplier, best first."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr(STARS).alias("stars"))
    place = (
        table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("city"))
    )
    return R.grouped_mean(lines.join(place, lines.l_suppkey == place.s_suppkey), "city", F.col("stars"), "stars").orderBy(F.desc("stars"), "city")


def top10_cities(spark, sf_dir):
    return avg_rating_by_city(spark, sf_dir).limit(10)


def multi_measure_avg(spark, sf_dir):
    return R.grouped_means(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_discount", "l_tax", "l_extendedprice"])


def partition_profile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    way = lambda name, by: R.partition_profile(lines, 8, by).withColumn("way", F.lit(name))
    return way("default", None).unionByName(way("customized", F.col("l_partkey")))


def lookup_left_join(spark, sf_dir):
    """Ratings with the measures of item and user; what is unknown stays null."""
    part = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    user = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return _reviews(spark, sf_dir, "l_linenumber", "l_partkey", "l_quantity").join(part, "l_partkey", "left").join(user, "o_custkey", "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "o_custkey", "p_size", "p_retailprice", "c_acctbal"
    )


def roleplay_left_join(spark, sf_dir):
    """One dimension joined in two roles (J3): orders by the nation of customer and supplier."""
    nation = table(spark, sf_dir, "nation")
    of = lambda name: nation.select(F.col("n_nationkey").alias(f"{name}_key"), F.col("n_name").alias(f"{name}_nation"))
    user = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("user_key"))
    shop = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("shop_key"))
    rows = _reviews(spark, sf_dir, "l_suppkey").join(user, F.col("o_custkey") == F.col("c_custkey"), "left").join(shop, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    counted = rows.groupBy("user_key", "shop_key").agg(F.count("*").alias("n"))
    return counted.join(of("user"), "user_key", "left").join(of("shop"), "shop_key", "left").select("user_nation", "shop_nation", "n")


def membership_semi_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    found = R.membership(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey", "o_custkey")
    return found.groupBy("c_mktsegment", "present").agg(F.count("*").alias("n"))


def union_distinct_reverse_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    edges = rows.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 97).alias("b"))
    return R.undirected(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "a", "b")


def describe_numeric(spark, sf_dir):
    return R.describe(table(spark, sf_dir, "lineitem"), MEASURES)


def json_props(spark, sf_dir):
    """A field of a JSON string, by event type."""
    value = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(value).alias("n"), F.sum(value).alias("total"))


def string_date_scalars(spark, sf_dir):
    """F1 to F8: slices, splits, joins, trims, dates; P9's composite key."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", F.substring("o_orderpriority", 1, 4).alias("head"), F.element_at(F.split("o_orderpriority", "-"), -1).alias("tail"),
        F.array_join(F.reverse(F.split("o_orderpriority", "-")), "-").alias("turned"), F.year("o_orderdate").alias("year"), F.length("o_orderpriority").alias("size"),
        F.concat_ws("-", F.date_format("o_orderdate", "M/d/yy"), F.col("o_custkey").cast("string")).alias("day_customer"),
        F.concat_ws("-", short_year(F.date_format("o_orderdate", "MM/dd/yyyy")), F.col("o_custkey").cast("string")).alias("padded_day_customer"),
        F.trim(F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("trimmed"), F.replace("o_orderpriority", F.lit("-"), F.lit("_")).alias("replaced"),
    )


def array_scalars(spark, sf_dir):
    """F12, F16, F17, F19 to F24 on the words of part names."""
    words = F.split("p_name", " ")
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(F.array_sort(words), ",").alias("ordered"), F.element_at(words, 1).alias("first_word"), F.size(words).alias("n_words"),
        (F.size(F.array_except(words, F.array(F.element_at(words, 1), F.element_at(words, -1)))) == 0).alias("holds"), key.bitwiseXOR(F.lit(37)).alias("mixed"),
        F.pmod(F.pmod(key * 48271 + 11, F.lit(1000000007)), F.lit(997)).alias("hashed"),
        (F.length(F.bin(key)) - F.length(F.expr("rtrim('0', bin(p_partkey))"))).alias("zeros"),
        F.array_join(F.flatten(F.transform(words, lambda w: F.array(w, F.reverse(w)))), ",").alias("flat"),
        F.array_join(F.flatten(F.transform(words, lambda x: F.transform(words, lambda y: F.concat(x, F.lit("-"), y)))), ",").alias("product"),
        F.aggregate(F.transform(words, F.length), F.lit(0), lambda a, x: a + x).alias("letters"),
    )


def upper_median(spark, sf_dir):
    return R.upper_median(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity")


def group_to_map(spark, sf_dir):
    """Orders of a customer by priority, as a map, and what is looked up in it."""
    made = R.group_map(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
    urgent = F.lit("1-URGENT")
    return made.select("o_custkey", F.size("counts").alias("n"), F.map_contains_key("counts", urgent).alias("has"), F.try_element_at("counts", urgent).alias("urgent"))


def sample_without_replacement(spark, sf_dir):
    return R.draw(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), 50, "l_orderkey", "l_linenumber")


def sample_with_replacement(spark, sf_dir):
    return R.draw_again(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 200, "o_orderkey")


def label_encode(spark, sf_dir):
    return R.label_encode(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_brand", "brand_code")


def minmax_scale(spark, sf_dir):
    return R.minmax_scale(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"])


def category_explode_mean_embedding(spark, sf_dir):
    """Mean embedding of the words of a part's name: a word's id comes from its digest."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    ids = words.select("p_partkey", (F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % 1000).alias("vec_id"))
    return R.mean_vectors(ids, table(spark, sf_dir, "embeddings"), "p_partkey", "vec_id", "embedding")


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_CITY = f"""SELECT n_name AS city, round(avg({STARS}), 4) AS stars
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY stars DESC, city"""

SQL = {
    "review_count": "SELECT count(*) AS n_review FROM lineitem",
    "review_count_year": "SELECT count(*) AS n_review FROM lineitem WHERE year(l_shipdate) = 1995",
    "distinct_users": f"SELECT count(DISTINCT o_custkey) AS n_user FROM {_LINES}",
    "distinct_items": "SELECT count(DISTINCT l_partkey) AS n_item FROM lineitem",
    "top10_users": f"SELECT o_custkey, count(*) AS n FROM {_LINES} GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10",
    "top10_items": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10",
    "avg_rating_by_city": _CITY,
    "top10_cities": _CITY + " LIMIT 10",
    "multi_measure_avg": """SELECT l_partkey, round(avg(l_discount), 4) AS mean_l_discount, round(avg(l_tax), 4) AS mean_l_tax,
        round(avg(l_extendedprice), 4) AS mean_l_extendedprice FROM lineitem GROUP BY 1""",
    "lookup_left_join": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey, p_size, p_retailprice, c_acctbal FROM {_LINES}
        LEFT JOIN (SELECT * FROM part WHERE p_size < 40) ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""",
    "roleplay_left_join": f"""SELECT u.n_name AS user_nation, s.n_name AS shop_nation, count(*) AS n FROM {_LINES}
        LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = l_suppkey
        LEFT JOIN nation u ON u.n_nationkey = c_nationkey LEFT JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY 1, 2""",
    "membership_semi_anti": """SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS present, count(*) AS n
        FROM customer GROUP BY 1, 2""",
    "union_distinct_reverse_edges": """WITH e AS (SELECT l_suppkey AS a, l_partkey % 97 AS b FROM lineitem)
        SELECT a AS src, b AS dst FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b""",
    "describe_numeric": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most FROM lineitem" for c in MEASURES),
    "json_props": """SELECT event_type, count(json_extract(props, '$.k')) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total
        FROM events GROUP BY 1""",
    "string_date_scalars": """SELECT o_orderkey, substr(o_orderpriority, 1, 4) AS head, split_part(o_orderpriority, '-', -1) AS tail,
        array_to_string(list_reverse(string_split(o_orderpriority, '-')), '-') AS turned, CAST(year(o_orderdate) AS INT) AS year, CAST(length(o_orderpriority) AS INT) AS size,
        strftime(o_orderdate, '%-m/%-d/%y') || '-' || o_custkey AS day_customer, strftime(o_orderdate, '%m/%d/%y') || '-' || o_custkey AS padded_day_customer,
        trim('  ' || o_orderpriority || ' ') AS trimmed, replace(o_orderpriority, '-', '_') AS replaced FROM orders""",
    "array_scalars": """SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ',') AS ordered, split_part(p_name, ' ', 1) AS first_word,
        CAST(len(string_split(p_name, ' ')) AS INT) AS n_words, len(list_filter(string_split(p_name, ' '), lambda x: x <> split_part(p_name, ' ', 1) AND x <> split_part(p_name, ' ', -1))) = 0 AS holds,
        array_to_string(flatten([[w, reverse(w)] for w in string_split(p_name, ' ')]), ',') AS flat,
        array_to_string(flatten([[x || '-' || y for y in string_split(p_name, ' ')] for x in string_split(p_name, ' ')]), ',') AS product, xor(p_partkey, 37) AS mixed, (p_partkey * 48271 + 11) % 1000000007 % 997 AS hashed,
        CAST(length(bin(p_partkey)) - length(rtrim(bin(p_partkey), '0')) AS INT) AS zeros, CAST(length(replace(p_name, ' ', '')) AS INT) AS letters FROM part""",
    "upper_median": "SELECT l_partkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS median FROM lineitem GROUP BY 1",
    "group_to_map": """SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS INT) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') > 0 AS has,
        nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) AS urgent FROM orders GROUP BY 1""",
    "sample_without_replacement": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY md5(l_orderkey || '-' || l_linenumber || '-7') LIMIT 50",
    "sample_with_replacement": """WITH p AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS place, count(*) OVER () AS n FROM orders)
        SELECT i AS draw, o_orderkey, o_custkey FROM range(200) r(i) JOIN p ON place = (i * 48271 + 7 * 69621) % 1000003 % n + 1""",
    "label_encode": "SELECT p_partkey, p_brand, p_type, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS brand_code FROM part",
    "minmax_scale": """SELECT p_partkey, round((p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE), 6) AS p_size,
        round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part""",
    "category_explode_mean_embedding": """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part),
        v AS (SELECT p_partkey, embedding FROM w JOIN embeddings ON vec_id = CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 1000),
        x AS (SELECT p_partkey, unnest(range(len(embedding))) AS place, unnest(embedding) AS x FROM v)
        SELECT p_partkey, CAST(place AS INT) AS place, round(avg(CAST(x AS DOUBLE)), 4) AS mean FROM x GROUP BY 1, 2""",
}

QUERIES = {
    f.__name__: f
    for f in (
        review_count, review_count_year, distinct_users, distinct_items, top10_users, top10_items, avg_rating_by_city, top10_cities, multi_measure_avg, partition_profile,
        lookup_left_join, roleplay_left_join, membership_semi_anti, union_distinct_reverse_edges, describe_numeric, json_props, string_date_scalars, array_scalars,
        upper_median, group_to_map, sample_without_replacement, sample_with_replacement, label_encode, minmax_scale, category_explode_mean_embedding,
    )
}
