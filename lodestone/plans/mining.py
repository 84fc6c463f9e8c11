"""Queries on baskets and set similarity, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import baskets as B
from lodestone.operators import similarity as S
from lodestone.sources.tables import table

SUPPORT = 60
HASHES = 60


def _brands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


def _words(spark, sf_dir):
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+")))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("word")).where("word <> ''")


def _codes(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", F.expr("cast(conv(substring(md5(word), 1, 8), 16, 10) as bigint) % 2147483647").alias("code"))


def _listed(sets):
    return sets.select("size", F.array_join("items", ",").alias("items"), "freq")


def baskets_min_size(spark, sf_dir):
    return B.baskets(_brands(spark, sf_dir), "l_orderkey", "p_brand", 3).select("l_orderkey", F.array_join("items", ",").alias("items"))


def frequent_itemsets_k123(spark, sf_dir):
    return _listed(B.frequent_itemsets(_brands(spark, sf_dir), "l_orderkey", "p_brand", SUPPORT, 3)).orderBy("size", "items")


def fpgrowth_itemsets(spark, sf_dir):
    return _listed(B.fp_growth(_brands(spark, sf_dir), "l_orderkey", "p_brand", SUPPORT))


def pcy_bucket_profile(spark, sf_dir):
    return B.pair_buckets(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def candidate_containment(spark, sf_dir):
    rows = _brands(spark, sf_dir)
    pairs = B.frequent_itemsets(rows, "l_orderkey", "p_brand", SUPPORT, 2).where("size = 2").select(F.col("items").alias("candidate"))
    return B.containment(pairs, rows, "l_orderkey", "p_brand").select(F.array_join("candidate", ",").alias("candidate"), "n")


def jaccard_exact(spark, sf_dir):
    return S.jaccard_exact(_words(spark, sf_dir), "doc_id", "word").orderBy("a", "b")


def minhash_signatures(spark, sf_dir):
    return S.minhash(_codes(spark, sf_dir), "doc_id", "code", HASHES).select("doc_id", F.array_join("signature", ",").alias("signature"))


def lsh_jaccard(spark, sf_dir):
    return S.lsh_jaccard(_codes(spark, sf_dir), "doc_id", "code").orderBy("a", "b")


_PAIRS = "SELECT DISTINCT l_orderkey AS g, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey"
_LEVELS = f"""p AS ({_PAIRS}), one AS (SELECT i AS items, count(*) AS freq FROM p GROUP BY 1),
    two AS (SELECT a.i || ',' || b.i AS items, count(*) AS freq FROM p a JOIN p b ON a.g = b.g AND a.i < b.i GROUP BY 1),
    three AS (SELECT a.i || ',' || b.i || ',' || c.i AS items, count(*) AS freq FROM p a JOIN p b ON a.g = b.g AND a.i < b.i JOIN p c ON b.g = c.g AND b.i < c.i GROUP BY 1)"""
_SETS = f"""WITH {_LEVELS} SELECT CAST(1 AS INT) AS size, items, freq FROM one WHERE freq >= {SUPPORT} UNION ALL SELECT CAST(2 AS INT), * FROM two WHERE freq >= {SUPPORT}
    UNION ALL SELECT CAST(3 AS INT), * FROM three WHERE freq >= {SUPPORT}"""
_W = r"""SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents"""
_C = f"SELECT DISTINCT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 2147483647 AS code FROM ({_W}) WHERE word <> ''"
_LOWS = [f"min(({a} * code + {b}) % {S.PRIME})" for a, b in S.coefficients(HASHES)]
_BANDS = " UNION ALL ".join(f"SELECT doc_id, {k} AS band, h{2 * k} AS x, h{2 * k + 1} AS y FROM s" for k in range(HASHES // 2))


def _jaccard(source: str, item: str, candidates: str = "") -> str:
    return f"""w AS MATERIALIZED ({source}), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM w a JOIN w b ON a.{item} = b.{item} AND a.doc_id < b.doc_id {candidates} GROUP BY 1, 2)
        SELECT a, b, round(k / (x.n + y.n - k), 6) AS similarity FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.5"""


SQL = {
    "baskets_min_size": f"SELECT g AS l_orderkey, string_agg(i, ',' ORDER BY i) AS items FROM ({_PAIRS}) GROUP BY 1 HAVING count(*) > 3",
    "frequent_itemsets_k123": _SETS,
    "fpgrowth_itemsets": _SETS,
    "pcy_bucket_profile": """WITH p AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem)
        SELECT xor(a.i, b.i) % 1000 AS bucket, count(*) AS n FROM p a JOIN p b ON a.g = b.g AND a.i < b.i GROUP BY 1""",
    "candidate_containment": f"WITH {_LEVELS} SELECT items AS candidate, freq AS n FROM two WHERE freq >= {SUPPORT}",
    "jaccard_exact": "WITH " + _jaccard(f"SELECT * FROM ({_W}) WHERE word <> ''", "word"),
    "minhash_signatures": f"SELECT doc_id, concat_ws(',', {', '.join(_LOWS)}) AS signature FROM ({_C}) GROUP BY 1",
    "lsh_jaccard": f"""WITH s AS (SELECT doc_id, {', '.join(f'{x} AS h{j}' for j, x in enumerate(_LOWS))} FROM ({_C}) GROUP BY 1), bands AS ({_BANDS}),
        met AS (SELECT DISTINCT a.doc_id AS g, b.doc_id AS h FROM bands a JOIN bands b USING (band, x, y) WHERE a.doc_id < b.doc_id),
        """ + _jaccard(_C, "code", "JOIN met ON g = a.doc_id AND h = b.doc_id"),
}

QUERIES = {f.__name__: f for f in (baskets_min_size, frequent_itemsets_k123, fpgrowth_itemsets, pcy_bucket_profile, candidate_containment, jaccard_exact, minhash_signatures, lsh_jaccard)}
