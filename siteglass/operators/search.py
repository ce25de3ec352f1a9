"""Full-text and vector ranking, fused by reciprocal rank."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.porter import stem

# The ranking constants.
K1, B, FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60


def tokens(text: Column, stemmed: bool = True) -> Column:
    """Lower-case letter-and-digit runs without diacritics, stemmed on request."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return stem(words) if stemmed else words


def postings(docs: DataFrame, id_col: str, text_cols: list[str], stemmed: bool = True) -> DataFrame:
    """(id, term, tf, len) of every document; a derived index that is always what its source says."""
    text = F.concat_ws(" ", *text_cols)
    words = docs.select(F.col(id_col).alias("id"), tokens(text, stemmed).alias("words"))
    rows = words.select("id", F.size("words").alias("len"), F.explode("words").alias("term"))
    return rows.groupBy("id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def _occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term)))


def bm25(docs: DataFrame, id_col: str, text_cols: list[str], terms: list[str], candidates: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """(id, score) of documents that hold any term; lower is better.

    Statistics cover the whole corpus, candidates only restrict the result. Only postings of the query's terms are
    shuffled: lengths and matches are counted in the scan, so the corpus itself never moves.
    """
    query = docs.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "w string").select(F.explode(tokens(F.col("w"), stemmed)).alias("term")).distinct()
    wanted = [r.term for r in query.collect()] if terms else []  # the terms of one query
    words = docs.select(F.col(id_col).alias("id"), tokens(F.concat_ws(" ", *text_cols), stemmed).alias("words"))
    counted = words.select("id", F.size("words").alias("len"), *(_occurrences("words", t).alias(f"f{i}") for i, t in enumerate(wanted)))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(wanted))))
    hits = counted.where(F.greatest(F.lit(0), F.lit(0), *(F.col(f"f{i}") for i in range(len(wanted)))) > 0)
    if candidates is not None:
        hits = hits.join(candidates.select(F.col(candidates.columns[0]).alias("id")), "id", "left_semi")

    def part(i: int) -> Column:
        idf = F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(FLOOR))
        f = F.col(f"f{i}")
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))

    total = sum((part(i) for i in range(len(wanted))), F.lit(0.0))
    return hits.crossJoin(F.broadcast(stats)).select("id", (-total).alias("score"))


def normalized(vector) -> Column:
    """A vector of unit length; a zero vector as it is."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], candidates: DataFrame | None = None) -> DataFrame:
    """(id, similarity) of stored unit vectors to a query, which is brought to unit length."""
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    q = F.array(*(F.lit(float(x) / norm) for x in query))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    if candidates is not None:
        rows = rows.join(candidates.select(F.col(candidates.columns[0]).alias("id")), "id", "left_semi")
    return rows.select("id", dot("v", q).alias("similarity"))


def _placed(scored: DataFrame, score: str, descending: bool, parts: int) -> DataFrame:
    """``scored`` with its place ``i`` from 0 and the number of rows ``n``; null scores come last, ties go by id.

    With one part a single global order is taken, for candidate sets that a filter has bounded. With more, rows are
    cut by approximate quantiles of the score (equal scores fall into one part), ordered within parts, and moved on by
    the rows of the parts before, so no task orders a whole table. Only one row per part is broadcast.
    """
    key = -F.col(score) if descending else F.col(score)
    order = [F.col("_key").asc_nulls_last(), F.col("id").asc()]
    rows = scored.withColumn("_key", key)
    if parts == 1:
        return rows.withColumns({"i": F.row_number().over(Window.orderBy(*order)) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())}).drop("_key")
    cuts = rows.agg(F.percentile_approx("_key", F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(100 * parts)).alias("_cuts"))
    part = F.when(F.col("_key").isNull(), parts).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col("_key"))))
    cut = rows.withColumn("_key", F.col("_key").cast("double")).crossJoin(F.broadcast(cuts)).withColumn("_part", part).drop("_cuts")
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"), F.sum("_n").over(Window.partitionBy()).alias("n"))  # a row a part
    placed = cut.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(ahead), "_part")
    return placed.withColumn("i", F.col("_ahead") + F.col("_at") - 1).drop("_key", "_part", "_at", "_ahead")


def ranks(scored: DataFrame, score: str, descending: bool, parts: int = 1) -> DataFrame:
    """(id, rank) from 1, ties by id; ``parts`` over one for tables that no filter has bounded."""
    return _placed(scored, score, descending, parts).select("id", (F.col("i") + 1).alias("rank"))


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score): the sum of 1 / (k + rank) over the lists that hold an id."""
    both = lists[0]
    for more in lists[1:]:
        both = both.unionByName(more)
    return both.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def _to_digits(c: Column, digits: int) -> Column:
    """Rounded as databases do: the product with a power of ten, half away from zero. Spark's round goes by the number as printed, which decides ties otherwise."""
    return F.round(c * float(10**digits), 0) / float(10**digits)


def semantic_scores(candidates: DataFrame, fused: DataFrame | None, parts: int = 1) -> DataFrame:
    """Every candidate with position, semantic_score and score: ranked ones first, the others by id."""
    base = candidates.select("id")
    got = base.join(fused.select("id", F.col("score").alias("fused")), "id", "left") if fused is not None else base.withColumn("fused", F.lit(None).cast("double"))
    sem = F.when(F.col("n") > 1, _to_digits(1 - F.col("i") / F.col("n"), 3)).otherwise(1.0)
    return _placed(got, "fused", True, parts).select("id", F.col("i").cast("long").alias("position"), sem.alias("semantic_score"), _to_digits(sem * 100, 1).alias("score"))


def _rounded(scored: DataFrame, score: str, digits: int) -> DataFrame:
    """Sums of doubles depend on their order; rounded, equal scores are ties and go by id."""
    return scored.withColumn(score, F.round(score, digits))


def rank_listings(listings: DataFrame, candidates: DataFrame, keywords: list[str], query_vector: list[float] | None = None, vectors: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """Candidates ordered by full text and vectors fused; without vectors the order is that of the text alone."""
    lists = []
    if keywords:
        lists.append(ranks(_rounded(bm25(listings, "id", ["address", "our_description", "neighborhood"], keywords, candidates, stemmed), "score", 9), "score", False))
    if query_vector and vectors is not None:
        lists.append(ranks(_rounded(cosine(vectors, "listing_id", "vector", query_vector, candidates), "similarity", 9), "similarity", True))
    return semantic_scores(candidates, _rounded(rrf(lists), "score", 12) if lists else None)
