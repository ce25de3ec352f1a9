"""Text of pages, slugs, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, text
from .register import query
from .surrogates import dealt, table

_FIVE = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_BARE = "regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>', ' ', 'g')"


@query("SELECT page_id, trim(regexp_replace(" + _FIVE.format(x=f"regexp_replace({_BARE}, '<[^>]+>', ' ', 'g')") + ", '[\\s\\x{0B}\\x{85}\\p{Z}]+', ' ', 'g')) AS body FROM pages")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.page_text("html").alias("body"))


@query("SELECT page_id, substr(trim(regexp_split_to_array(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '\\s+[|\u2013\u2014\\-\u00b7\u2022]\\s+')[1]), 1, 120) AS head, trim(" + _FIVE.format(x="regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')") + ") AS raw FROM pages WHERE regexp_matches(html, '(?is)<h1[^>]*>(.*?)</h1>')")
def headline(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.headline("html").alias("head"), text.raw_headline("html").alias("raw"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, len(string_split(host, '.')) AS labels FROM pages")
def domain_of(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", text.domain("url").alias("host"))
    return p.withColumn("labels", F.size(F.split("host", "\\.")).cast("bigint"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("link"))


_SLUG = "concat(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CONCAT(CAST(p_partkey AS VARCHAR(20)), '-') END, replace(p_name, ' ', '-'), CASE p_partkey % 3 WHEN 0 THEN '-new-york-ny' WHEN 1 THEN '-miami-fl-2' ELSE '-somewhere' END, CASE WHEN p_partkey % 8 = 0 THEN '-3' ELSE '' END)"
_ST = ", ".join(repr(s) for s in text.STATES)


@query(
    f"""WITH s AS (SELECT p_partkey AS id, string_split(regexp_replace({_SLUG}, '(-[0-9]+)+$', ''), '-') AS p FROM part)
SELECT id, CASE WHEN len(p) >= 3 AND p[-1] IN ({_ST}) THEN p[-1] END AS state, CASE WHEN len(p) >= 3 AND p[-1] IN ({_ST}) AND regexp_matches(p[1], '^[0-9]') THEN array_to_string(p, ' ') END AS address FROM s"""
)
def slug_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{_SLUG} AS slug")
    return rows.select("id", text.slug_state("slug").alias("state"), text.slug_address("slug").alias("address"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 1 THEN 'NW' ELSE '' || (p_partkey % 90) || 'nd' END || ' ' || upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS title FROM part")
def slug_title(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "concat(CASE WHEN p_partkey % 5 = 1 THEN 'nw' ELSE concat(p_partkey % 90, 'nd') END, '-', replace(p_name, ' ', '-')) AS slug")
    return rows.select("id", text.slug_title("slug").alias("title"))


@query(
    """WITH a AS (SELECT o_orderkey AS id, o_orderkey % 3000 AS x, o_orderkey % 3000 + o_orderkey % 7 * 4 - 8 AS y FROM orders)
SELECT id, CASE WHEN y >= 0 AND len(CAST(x AS VARCHAR)) = len(CAST(y AS VARCHAR)) AND y > x THEN x || ' N Gilbert Street' END AS one FROM a"""
)
def range_collapse(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "concat(o_orderkey % 3000, ' ', o_orderkey % 3000 + o_orderkey % 7 * 4 - 8, ' N Gilbert Street') AS address")
    return rows.select("id", text.collapse_range("address").alias("one"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'Venice' WHEN p_partkey % 4 = 2 THEN 'Santa Monica' ELSE 'Oxnard' END AS city, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 3 THEN 'AZ' ELSE 'CA' END AS state FROM part")
def city_of(spark: SparkSession, sf: str) -> DataFrame:
    said = "concat(p_partkey, ' Rose Avenue ', CASE p_partkey % 4 WHEN 0 THEN 'nowhere, XX' WHEN 1 THEN 'Venice, CA 90291' WHEN 2 THEN 'Santa Monica, CA' ELSE 'NNN Oxnard, AZ.' END)"
    rows = dealt(spark, sf, "part", "p_partkey").selectExpr("p_partkey AS id", f"{said} AS body", "concat(p_partkey, ' Rose Avenue') AS address")
    c = rows.select("id", text.city_of("body", "address").alias("c"))
    return c.select("id", "c.city", "c.state")


@query("SELECT p_partkey AS id, p_partkey % 5 = 1 AS ok FROM part")
def address_match(spark: SparkSession, sf: str) -> DataFrame:
    """The same place in other words, a wrong house, a wrong direction, a wrong street, one that cannot be told."""
    asked = "CASE WHEN p_partkey % 5 = 0 THEN concat(p_partkey, ' South Drive, Town, TX') ELSE concat(p_partkey, ' West 38th Street, New York, NY') END"
    got = "CASE p_partkey % 5 WHEN 0 THEN concat(p_partkey, ' S DR') WHEN 1 THEN concat(p_partkey, ' W 38 ST, MANHATTAN') WHEN 2 THEN concat(p_partkey + 1, ' W 38 ST') WHEN 3 THEN concat(p_partkey, ' E 38 ST') ELSE concat(p_partkey, ' W 410 ST, NEW YORK') END"
    rows = dealt(spark, sf, "part", "p_partkey").selectExpr("p_partkey AS id", f"{asked} AS asked", f"{got} AS got")
    return rows.select("id", text.address_matches("asked", "got").alias("ok"))


@query("SELECT p_partkey AS id, p_partkey || ' N 2 ' || upper(split_part(p_name, ' ', 2)) || ' AVE' AS situs, p_partkey || ' NW 2 AVE' AS bare FROM part")
def assessor_address(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "concat(p_partkey, ' North 2-', split(p_name, ' ')[1], ' Avenue, Los Angeles') AS a", "concat(p_partkey, ' NW 2ND AVE') AS b")
    return rows.select("id", text.assessor_street("a").alias("situs"), text.without_ordinals("b").alias("bare"))


@query("SELECT p_partkey AS id, '\"' || split_part(p_name, ' ', 1) || '\" OR \"s\" OR \"' || split_part(p_name, ' ', 2) || '\"' AS expression FROM part")
def match_expression(spark: SparkSession, sf: str) -> DataFrame:
    p = F.split("p_name", " ")
    words = F.array(F.concat(p[0], F.lit("'s")), F.concat(p[1], F.lit("-"), p[0]))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.match_expression(words).alias("expression"))


_FACT = "concat('Suite ', p_partkey, '. Size: ', format_number(p_partkey % 9000 + 200, 0), ' SF Rent/SF: $ ', 20 + p_partkey % 60, ' Monthly Rent: $ 16,525 ', CASE WHEN p_partkey % 3 = 0 THEN concat('in a ', format_number(90000 + p_partkey % 1000, 0), ' RSF Class A office tower') ELSE 'office with Filter by price $1,000' END)"


@query(
    """SELECT p_partkey AS id, CAST(p_partkey % 9000 + 200 AS INTEGER) AS size_sf, CASE WHEN p_partkey % 3 = 0 THEN CAST(90000 + p_partkey % 1000 AS INTEGER) END AS building, CAST(20 + p_partkey % 60 AS DOUBLE) AS asking_rent, CASE WHEN p_partkey % 2 = 0 THEN 'sf_yr' ELSE 'sf_mo' END AS rent_unit, 'office' AS kind FROM part"""
)
def html_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = dealt(spark, sf, "part", "p_partkey").selectExpr("p_partkey AS id", f"{_FACT} AS body", "CASE WHEN p_partkey % 2 = 0 THEN 'nyc' ELSE 'la' END AS metro").withColumn("f", facts.page_facts("body", "metro"))
    return rows.select("id", "f.size_sf", F.col("f.total_building_sf").alias("building"), "f.asking_rent", "f.rent_unit", F.col("f.property_type").alias("kind"))


_K = "(p_partkey % 5000 + 1000)"
_TOLD = (
    f"concat('Typical floor 20,000 SF. Suite offers ', format_number({_K}, 0), ' SF of office.')", f"concat('A rebuilt port with public open space and over 275,000 SF of homes. Retail unit of ', format_number({_K}, 0), ' SF.')",
    f"concat('Spaces available 1,200 - ', format_number({_K} + 2000, 0), ' SF. Flex.')", f"concat('Industrial. Proposed divisions: ', format_number({_K}, 0), ' SF, 9,100 SF and 12,000 SF.')",
    f"concat('Land for sale. Asking price: $6,500,000. ', format_number({_K}, 0), ' SF.')", f"concat('For sale or lease: office of ', format_number({_K}, 0), ' SF at $45/SF.')",
    f"concat('Office of ', format_number({_K}, 0), ' SF. Monthly rent: $ 8,000')", f"concat('Market rent $30/SF nearby. Retail of ', format_number({_K}, 0), ' SF.')",
)


@query(
    f"""SELECT p_partkey AS id, CAST(CASE p_partkey % 8 WHEN 2 THEN {_K} + 2000 WHEN 3 THEN 12000 ELSE {_K} END AS INTEGER) AS size_sf, CAST(CASE p_partkey % 8 WHEN 2 THEN 1200 WHEN 3 THEN {_K} END AS INTEGER) AS low,
CAST(CASE p_partkey % 8 WHEN 4 THEN 6500000 END AS BIGINT) AS sale_price, CASE p_partkey % 8 WHEN 4 THEN 'sale' END AS transaction_type, CASE p_partkey % 8 WHEN 5 THEN 45.0e0 WHEN 6 THEN 8000.0e0 END AS asking_rent,
CASE p_partkey % 8 WHEN 5 THEN 'sf_yr' WHEN 6 THEN 'mo' END AS rent_unit, CASE p_partkey % 8 WHEN 1 THEN 'retail' WHEN 7 THEN 'retail' WHEN 2 THEN 'flex' WHEN 3 THEN 'industrial' WHEN 4 THEN 'land' ELSE 'office' END AS kind FROM part"""
)
def told_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Eight ways to state a fact: decoys of size and rent, the district's figures, ranges, divisions, sales, both offers."""
    body = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_TOLD)) + " END"
    rows = dealt(spark, sf, "part", "p_partkey").selectExpr("p_partkey AS id", f"{body} AS body").withColumn("f", facts.page_facts("body", F.lit("nyc")))
    return rows.select("id", "f.size_sf", F.col("f.divisible_min_sf").alias("low"), "f.sale_price", "f.transaction_type", "f.asking_rent", "f.rent_unit", F.col("f.property_type").alias("kind"))


@query()
def html_facts_udf(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the stored pages, which state none in figures."""
    p = table(spark, sf, "pages").select("page_id", facts.page_facts(text.page_text("html"), F.lit("nyc")).alias("f"))
    return p.select("page_id", "f.*")


@query("SELECT text AS body, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def distinct_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy(F.col("text").alias("body")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return d.where("copies > 1")


@query("SELECT event_id AS id, lower(trim(v)) IN ('1','true','yes','on') AS flag, TRY_CAST(CASE WHEN regexp_matches(trim(v), '^[0-9]+$') THEN trim(v) END AS INTEGER) AS number FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN '12 ' WHEN 2 THEN 'off' WHEN 3 THEN '1' ELSE 'x9' END AS v FROM events)")
def setting_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").selectExpr("event_id AS id", "CASE event_id % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN '12 ' WHEN 2 THEN 'off' WHEN 3 THEN '1' ELSE 'x9' END AS v")
    return rows.select("id", text.setting_bool("v").alias("flag"), text.setting_int("v").alias("number"))
