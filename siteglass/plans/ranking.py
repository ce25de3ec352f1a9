"""Full text, vectors, fusion, the flagship search, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import parse, search
from ..operators.relaxation import hard_filter
from ..query import ListingQuery
from .register import query
from .surrogates import LISTING_SQL, listings, table


def _bm25(corpus: str, terms: list[str]) -> str:
    """CTEs words, stats, scored (id, score) over ``corpus`` (id, body)."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""words AS (SELECT id, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM ({corpus})),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM words),
tf AS (SELECT id, len(ws) AS dl, t.term, len(list_filter(ws, lambda w: w = t.term)) AS f FROM words, (VALUES {values}) t(term)),
df AS (SELECT term, count(*) FILTER (WHERE f > 0) AS d FROM tf GROUP BY term),
scored AS (SELECT id, -sum(CASE WHEN ln((n - d + 0.5) / (d + 0.5)) > 0 THEN ln((n - d + 0.5) / (d + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), stats GROUP BY id HAVING sum(f) > 0)"""


PARTS = 64  # parts of an order over a whole table
DOC_TERMS = ["the", "ontion", "rented"]
LISTING_TERMS = ["ring", "economy", "42"]
_CORPUS = "SELECT id, concat_ws(' ', address, our_description, neighborhood) AS body FROM listing"


@query("WITH " + _bm25("SELECT doc_id AS id, text AS body FROM documents", DOC_TERMS) + " SELECT id, round(score, 6) AS score FROM scored")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return search.bm25(docs, "doc_id", ["text"], DOC_TERMS, stemmed=False).select("id", F.round("score", 6).alias("score"))


@query(
    f"WITH listing AS ({LISTING_SQL}), " + _bm25(_CORPUS, LISTING_TERMS) + " SELECT id, CAST(row_number() OVER (ORDER BY round(score, 9), id) AS BIGINT) AS rank FROM scored WHERE id IN (SELECT id FROM listing WHERE status = 'available' AND metro = 'la')"
)
def bm25_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf)
    scored = search.bm25(rows, "id", ["address", "our_description", "neighborhood"], LISTING_TERMS, rows.where("status = 'available' and metro = 'la'").select("id"), stemmed=False)
    return search.ranks(scored.withColumn("score", F.round("score", 9)), "score", False, PARTS).select("id", F.col("rank").cast("bigint").alias("rank"))


#: Words of the listings under the stems that the query's terms have, as an English stemmer groups them.
STEMS = {"ring": ("ring", "rings", "ringing", "ringed"), "space": ("space", "spaces", "spacing", "spaced"), "polish": ("polish", "polished", "polishing", "polishes"), "econom": ("economy", "economies")}
_STEMMED = "list_transform(ws, lambda w: CASE " + " ".join(f"WHEN list_contains([{', '.join(repr(w) for w in ws)}], w) THEN '{s}'" for s, ws in STEMS.items()) + " ELSE w END)"


@query(f"WITH listing AS ({LISTING_SQL}), " + _bm25(_CORPUS, list(STEMS)).replace("tf AS (", f"folded AS (SELECT id, {_STEMMED} AS ws FROM words),\ntf AS (").replace("FROM words, (VALUES", "FROM folded, (VALUES") + " SELECT id, round(score, 6) AS score FROM scored")
def porter_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """With stems: "rings" finds "ring", "polishing" finds "polished"."""
    got = search.bm25(listings(spark, sf), "id", ["address", "our_description", "neighborhood"], ["rings", "spaces", "polishing", "economy"])
    return got.select("id", F.round("score", 6).alias("score"))


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return table(spark, sf, "embeddings").where("vec_id = 0").first().embedding  # one row


_COS = "SELECT e.vec_id AS id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT id, round(similarity, 6) AS similarity FROM ({_COS}) ORDER BY round(similarity, 9) DESC, id LIMIT 50")
def cosine_rank(spark: SparkSession, sf: str) -> DataFrame:
    """A top-k report."""
    got = search.cosine(table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf))
    return got.orderBy(F.round("similarity", 9).desc(), "id").limit(50).select("id", F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, 1.0e0 AS unit FROM embeddings")
def vector_norm(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", search.normalized("embedding").alias("u"))
    return v.select("id", F.round(F.sqrt(search.dot("embedding", "embedding")), 5).alias("norm"), F.round(F.sqrt(search.dot("u", "u")), 5).alias("unit"))


@query(
    """WITH a AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier WHERE s_suppkey % 3 <> 0),
b AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_name, s_suppkey) AS r FROM supplier WHERE s_suppkey % 2 = 0)
SELECT id, round(sum(1.0e0 / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id"""
)
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "id")
    a, b = search.ranks(s.where("id % 3 <> 0"), "s_acctbal", True, PARTS), search.ranks(s.where("id % 2 = 0").withColumn("s_key", F.col("id").cast("double")), "s_key", False, PARTS)
    return search.rrf([a, b]).select("id", F.round("score", 9).alias("score"))


@query(
    """WITH c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS f FROM supplier), p AS (SELECT id, row_number() OVER (ORDER BY f DESC NULLS LAST, id) - 1 AS i, count(*) OVER () AS n FROM c)
SELECT id, i AS position, round(1 - i / CAST(n AS DOUBLE), 3) AS semantic_score, round(round(1 - i / CAST(n AS DOUBLE), 3) * 100, 1) AS score FROM p"""
)
def semantic_scale(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return search.semantic_scores(s, s.where("id % 4 <> 0"), PARTS)


SEARCH = ListingQuery(property_types=("retail", "office"), transaction_type="lease", max_rent_per_sf_yr=600.0, keywords=("ring", "economy"))
_CAND = f"SELECT id FROM listing WHERE status = 'available' AND metro = 'mia' AND property_type IN ('retail','office') AND transaction_type = 'lease' AND (asking_rent IS NULL OR CASE rent_unit WHEN 'sf_yr' THEN asking_rent WHEN 'sf_mo' THEN asking_rent * 12 WHEN 'mo' THEN CASE WHEN size_sf > 0 THEN asking_rent * 12.0 / size_sf END END <= 600.0) ORDER BY id LIMIT 200"
_SAY = """coalesce(nullif(concat_ws(' ', CASE WHEN size_sf <> 0 THEN format('{:,}', size_sf) || ' SF' END, nullif(property_type, ''), CASE WHEN neighborhood <> '' THEN 'in ' || neighborhood END,
CASE WHEN asking_rent <> 0 AND rent_unit = 'sf_yr' THEN 'at $' || format('{:,}', CAST(round_even(asking_rent, 0) AS BIGINT)) || '/SF/yr%s' WHEN sale_price <> 0 THEN 'asking $' || format('{:,}', sale_price) END), ''), address, '')"""


@query(
    f"WITH listing AS ({LISTING_SQL}), cand AS ({_CAND}), " + _bm25(_CORPUS, list(SEARCH.keywords)) + f""", ranked AS (SELECT id, 1.0e0 / (60 + row_number() OVER (ORDER BY score, id)) AS fused FROM scored WHERE id IN (SELECT id FROM cand)),
placed AS (SELECT id, row_number() OVER (ORDER BY fused DESC NULLS LAST, id) - 1 AS i, count(*) OVER () AS n FROM cand LEFT JOIN ranked USING (id))
SELECT id, i AS position, CASE WHEN n > 1 THEN round(1 - i / CAST(n AS DOUBLE), 3) ELSE 1.0 END AS semantic_score, {_SAY % " (under your $600 cap)"} AS rationale FROM placed JOIN listing USING (id)"""
)
def search_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, rank and explain."""
    rows = listings(spark, sf)
    found = hard_filter(rows, SEARCH, "mia")
    ranked = search.rank_listings(rows, found.select("id"), list(SEARCH.keywords), stemmed=False)
    return ranked.join(found, "id").select("id", "position", "semantic_score", text.rationale(SEARCH.max_rent_per_sf_yr).alias("rationale"))


_NEAR = f"SELECT id, row_number() OVER (ORDER BY round(similarity, 9) DESC, id) AS r FROM ({_COS}) WHERE id IN (SELECT id FROM cand)"


@query(
    f"WITH listing AS ({LISTING_SQL}), cand AS ({_CAND}), " + _bm25(_CORPUS, list(SEARCH.keywords)) + f""", lists AS (SELECT id, row_number() OVER (ORDER BY round(score, 9), id) AS r FROM scored WHERE id IN (SELECT id FROM cand) UNION ALL {_NEAR}),
fused AS (SELECT id, round(sum(1.0e0 / (60 + r)), 12) AS f FROM lists GROUP BY id), placed AS (SELECT id, row_number() OVER (ORDER BY f DESC NULLS LAST, id) - 1 AS i, count(*) OVER () AS n FROM cand LEFT JOIN fused USING (id))
SELECT id, i AS position, CASE WHEN n > 1 THEN round(1 - i / CAST(n AS DOUBLE), 3) ELSE 1.0 END AS semantic_score FROM placed"""
)
def search_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, then full text and vectors fused by reciprocal rank."""
    rows = listings(spark, sf)
    found = hard_filter(rows, SEARCH, "mia")
    stored = table(spark, sf, "embeddings").select(F.col("vec_id").alias("listing_id"), F.col("embedding").alias("vector"))
    return search.rank_listings(rows, found.select("id"), list(SEARCH.keywords), _query_vector(spark, sf), stored, stemmed=False).select("id", "position", "semantic_score")


MESSAGE = {
    "session": "o_custkey", "turn": "o_orderkey",
    "message": "concat(CASE o_orderkey % 4 WHEN 0 THEN 'Retail or office ' WHEN 1 THEN 'industrial for sale ' WHEN 2 THEN 'I want to buy land ' ELSE 'need space ' END, CASE o_orderkey % 5 WHEN 0 THEN concat('under ', CAST(1000 + o_orderkey % 900 AS VARCHAR(20)), ' sf') WHEN 1 THEN concat('at least ', CAST(500 + o_orderkey % 300 AS VARCHAR(20)), ' sq ft') WHEN 2 THEN concat('around 1,', CAST(100 + o_orderkey % 800 AS VARCHAR(20)), ' SF') WHEN 3 THEN 'in Brooklyn' ELSE '' END, CASE o_orderkey % 3 WHEN 0 THEN ' under $8k/mo' WHEN 1 THEN ' max $45.5/sf' ELSE ' near the loading dock' END)",
    "metro": "CASE o_orderkey % 2 WHEN 0 THEN 'nyc' ELSE 'mia' END",
}
_MSG = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in MESSAGE.items()) + " FROM orders"
_PARSED = f"""m AS (SELECT *, lower(message) AS q FROM ({_MSG})),
n AS (SELECT *, TRY_CAST(replace(regexp_extract(q, '(?:under|below|less than|max|up to)\\s*([0-9,]+)\\s*(?:sf|sq|square)', 1), ',', '') AS BIGINT) AS hi, TRY_CAST(replace(regexp_extract(q, '(?:over|above|at least|min|minimum)\\s*([0-9,]+)\\s*(?:sf|sq|square)', 1), ',', '') AS BIGINT) AS lo,
 TRY_CAST(replace(regexp_extract(q, '([0-9,]{{3,}})\\s*(?:sf|sq ?ft|square feet)', 1), ',', '') AS BIGINT) AS near,
 TRY_CAST(replace(regexp_extract(q, '\\$\\s*([0-9,.]+)\\s*(k)?\\s*(?:/|per |a )\\s*mo', 1), ',', '') AS DOUBLE) * CASE WHEN regexp_extract(q, '\\$\\s*([0-9,.]+)\\s*(k)?\\s*(?:/|per |a )\\s*mo', 2) = 'k' THEN 1000 ELSE 1 END AS mo,
 TRY_CAST(replace(regexp_extract(q, '\\$\\s*([0-9,.]+)\\s*(?:/|per )\\s*(?:sf|psf)', 1), ',', '') AS DOUBLE) AS sf FROM m),
parsed AS (SELECT session, turn, message, CASE WHEN contains(q, 'for sale') OR contains(q, 'buy') OR contains(q, 'purchase') THEN 'sale' ELSE '%s' END AS transaction_type,
 coalesce(CASE WHEN coalesce(hi, 0) + coalesce(lo, 0) = 0 THEN CAST(floor(near * 0.75) AS BIGINT) ELSE lo END, 0) AS min_size_sf, coalesce(CASE WHEN coalesce(hi, 0) + coalesce(lo, 0) = 0 THEN CAST(floor(near * 1.25) AS BIGINT) ELSE hi END, 0) AS max_size_sf,
 coalesce(CASE WHEN mo IS NOT NULL THEN CASE WHEN coalesce(nullif(hi, 0), nullif(lo, 0), near, 0) > 0 THEN round(mo * 12 / coalesce(nullif(hi, 0), nullif(lo, 0), near, 0), 2) END ELSE sf END, 0.0) AS max_rent_per_sf_yr,
 array_to_string(list_filter(['retail','office','industrial','flex','land'], lambda t: contains(q, t)), ',') AS types,
 CASE WHEN metro = 'nyc' AND contains(q, 'brooklyn') THEN 'Brooklyn' ELSE '' END AS borough,
 array_to_string(list_filter(regexp_extract_all(q, '[a-z][a-z-]{{2,}}'), lambda w: NOT list_contains([{", ".join(repr(w) for w in text.STOP_WORDS)}], w))[1:8], ' ') AS words FROM n)"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*(f"{e} AS {c}" for c, e in MESSAGE.items()))


@query("WITH " + _PARSED.replace("%s", "lease") + " SELECT turn, transaction_type, min_size_sf, max_size_sf, max_rent_per_sf_yr, types, borough, words FROM parsed")
def rules_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = parse.parse_messages(messages(spark, sf))
    return p.select("turn", "transaction_type", "min_size_sf", "max_size_sf", "max_rent_per_sf_yr", F.array_join("property_types", ",").alias("types"), F.array_join("boroughs", ",").alias("borough"), F.array_join("keywords", " ").alias("words"))


_IN_FORCE = "last_value({c} IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING)"


@query(
    "WITH " + _PARSED.replace("%s", "") + ", s AS (SELECT session, turn, nullif(transaction_type, '') AS t, nullif(max_size_sf, 0) AS hi, nullif(max_rent_per_sf_yr, 0) AS cap, nullif(types, '') AS k FROM parsed) SELECT turn, "
    + ", ".join(f"coalesce({_IN_FORCE.format(c=c)}, {d}) AS {n}" for c, d, n in (("t", "''", "transaction_type"), ("hi", "0", "max_size_sf"), ("cap", "0.0", "max_rent_per_sf_yr"), ("k", "''", "types")))
    + " FROM s"
)
def turn_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = parse.merge_turns(parse.parse_messages(messages(spark, sf), unstated=""), "session", "turn")
    return m.select("turn", "transaction_type", "max_size_sf", "max_rent_per_sf_yr", F.array_join("property_types", ",").alias("types"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Nothing matched exactly — I relaxed the rent cap. ' WHEN o_orderkey % 3 = 1 THEN 'Nothing matched exactly, so here are the closest misses. ' ELSE '' END || (o_orderkey % 4 + 1) || CASE WHEN o_orderkey % 4 = 0 THEN ' match' ELSE ' matches' END || '. The closest is ' || o_orderpriority || ' — ' || o_orderstatus || '.' AS reply FROM orders")
def keyless_reply(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    said = parse.reply(F.col("o_orderkey") % 4 + 1, F.col("o_orderkey") % 3 < 2, F.when(F.col("o_orderkey") % 3 == 0, "the rent cap").otherwise(""), F.col("o_orderpriority"), F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("id"), said.alias("reply"))
