"""Queries over sequences in context: events and orders give the years and kinds, nations the countries."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import classify as C
from canopy.functions import text as T
from canopy.operators import context
from canopy.plans.registry import query, table

AS_OF = 2000


@query(
    "WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'n/a' END AS s, year(o_orderdate)::INT AS y FROM orders) "
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN y END AS year FROM d"
)
def year_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 5 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 3, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("n/a")
    return o.select("o_orderkey", T.year_of(form).alias("year"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_type || ')')), '[\\W_]+', '_', 'g'), '^_|_$', '', 'g') AS k FROM part")
def organism_norm(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.organism_key(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("k"))


@query(
    "SELECT p_partkey, array_to_string(list_concat(CASE WHEN contains(lower(p_name), 'virus') THEN ['viral_disease', 'infectious_disease', 'epidemiology'] ELSE [] END, list_filter(regexp_extract_all(lower(p_name || ' virus'), '\\w+'), lambda w: length(w) > 3 AND w NOT IN ('virus', 'bacteria', 'disease'))), ',') AS terms FROM part".replace("contains(lower(p_name), 'virus')", "true")
)
def search_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.search_terms(F.concat("p_name", F.lit(" virus"))), ",").alias("terms"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.8 THEN 'high' WHEN l_discount * 10 >= 0.6 THEN 'moderate' WHEN l_discount * 10 >= 0.4 THEN 'low' ELSE 'very_low' END AS level FROM lineitem")
def classify_support(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.support_level(F.col("l_discount") * 10).alias("level"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) - 40 >= 1955 THEN 'recent' WHEN year(o_orderdate) - 40 >= 1940 THEN CASE WHEN year(o_orderdate) - 40 >= 1955 THEN 'recent' ELSE 'modern' END WHEN year(o_orderdate) - 40 >= 1950 THEN 'historical_late' ELSE 'historical_early' END AS period FROM orders")
def classify_period(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.period(F.year("o_orderdate") - 40, 1960).alias("period"))


@query("SELECT DISTINCT event_type, CASE WHEN regexp_matches(lower(event_type), 'homo sapiens|human|man') THEN 'human_clinical' WHEN regexp_matches(lower(event_type), 'aedes|mosquito|vector') THEN 'vector' WHEN regexp_matches(lower(event_type), 'animal|mammal|bird') THEN 'animal' ELSE 'environmental_or_unknown' END AS kind FROM (SELECT event_type FROM events UNION ALL SELECT unnest(['Homo sapiens', 'Aedes sp.', 'wild bird', 'soil']))")
def classify_sample(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ("Homo sapiens", "Aedes sp.", "wild bird", "soil")))).alias("event_type"))
    return kinds.union(more).distinct().select("event_type", C.sample_type(F.col("event_type")).alias("kind"))


@query("SELECT s_suppkey, n_name, CASE WHEN n IN ('Brazil', 'Colombia', 'Mexico', 'India', 'China') THEN 'outbreak_region' WHEN n IN ('Uganda', 'Senegal', 'Ivory Coast', 'Gabon') THEN 'endemic_region' ELSE 'other_region' END AS region FROM (SELECT s_suppkey, n_name, upper(n_name[1]) || lower(n_name[2:]) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def classify_geo(spark, sf_dir):
    nations = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"))
    return table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select("s_suppkey", "n_name", C.geography(F.initcap(F.lower("n_name"))).alias("region"))


def sequences(spark, sf_dir):
    """Orders as sequences: the customer's nation is the country, a support comes from the key."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    support = (F.col("o_orderkey") % 11) / 10
    return o.select(F.col("o_orderkey").alias("id"), F.col("n_name").alias("country"), F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("host"), support.alias("support"))


def indicators(spark, sf_dir, by_line=False):
    """A wide table of nations and years in long form: sums over the suppliers' line items that were returned; by_line, a row for each line number, the last one first."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_linenumber")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    keys = [F.lower("n_name").alias("Country"), F.year("l_shipdate").alias("Year"), *[-F.col("l_linenumber").cast("int")] * by_line]
    wide = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases_confirmed"), F.sum("l_quantity").alias("death_rate"), F.max("l_extendedprice").alias("other"))
    if by_line:
        wide = wide.orderBy(*wide.columns[:3]).drop(wide.columns[2])
    return context.long_indicators(wide, "lines")


CTX = (
    "s AS (SELECT o_orderkey AS id, n_name AS country, year(o_orderdate)::INT AS year, c_mktsegment AS host, (o_orderkey % 11) / 10 AS support FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), "
    "w AS (SELECT lower(n_name) AS country, year(l_shipdate)::INT AS year, count(*)::DOUBLE AS cases_confirmed, sum(l_quantity) AS death_rate, max(l_extendedprice) AS other FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY ALL), "
    "i AS (SELECT country, year, unnest(['cases_confirmed', 'death_rate', 'other']) AS metric, unnest([cases_confirmed, death_rate, other]) AS value FROM w), "
    "j AS (SELECT s.*, i.metric, i.value FROM s LEFT JOIN i ON lower(s.country) = i.country AND s.year = i.year)"
)
INS = (
    ", n AS (SELECT id, country, year, support, value, c || '_' || metric AS metric FROM (SELECT *, unnest(CASE metric WHEN 'cases_confirmed' THEN ['cases'] WHEN 'death_rate' THEN ['rate'] ELSE [] END) AS c FROM j WHERE value IS NOT NULL AND support > 0)), "
    "r AS (SELECT *, CASE WHEN value = 0 THEN 'no_data' WHEN regexp_matches(metric, 'cases|incidence|prevalence') AND value > 1000 THEN CASE WHEN support > 0.7 THEN 'positive_correlation' ELSE 'unexpected_low_support' END WHEN value < 100 AND support > 0.8 THEN 'unexpected_high_support' ELSE 'neutral' END AS rel FROM n)"
)


@query(f"WITH {CTX} SELECT id, metric, round(value, 4) AS value FROM j")
def context_join(spark, sf_dir):
    return context.with_indicators(sequences(spark, sf_dir), indicators(spark, sf_dir)).select("id", "metric", F.round("value", 4).alias("value"))


@query(f"WITH {CTX}{INS} SELECT id, metric, round(value, 4) AS value, rel AS support_correlation FROM r")
def metric_extract(spark, sf_dir):
    found = context.insights(context.with_indicators(sequences(spark, sf_dir), indicators(spark, sf_dir)))
    return found.select("id", "metric", F.round("value", 4).alias("value"), "support_correlation")


@query(f"WITH {CTX}{INS} SELECT country, count(DISTINCT id)::BIGINT AS total_sequences, round(avg(support), 9) AS avg_support, round(avg(value), 4) AS avg_epi_value, count(*)::BIGINT AS n_insights, count(*) FILTER (rel = 'neutral')::BIGINT AS n_neutral FROM r GROUP BY country")
def country_rollup(spark, sf_dir):
    out = context.country_rollup(context.insights(context.with_indicators(sequences(spark, sf_dir), indicators(spark, sf_dir))))
    return out.withColumns({"avg_support": F.round("avg_support", 9), "avg_epi_value": F.round("avg_epi_value", 4)}).drop("correlations")


def _flagged(spark, sf_dir):
    joined = context.with_indicators(sequences(spark, sf_dir), indicators(spark, sf_dir))
    return joined.groupBy("id", "country", "year", "host", "support").agg(F.bool_or(F.col("metric").isNotNull()).alias("has_data"))


@query(
    f"WITH {CTX}, a AS (SELECT id, country, year, bool_or(metric IS NOT NULL) AS hit FROM j GROUP BY ALL) SELECT count(*)::BIGINT AS total_sequences, count(*) FILTER (hit)::BIGINT AS sequences_with_data, "
    "format('{:.1f}%', 100.0 * count(*) FILTER (hit) / count(*)) AS success_rate, count(DISTINCT country)::BIGINT AS unique_countries, count(DISTINCT year)::BIGINT AS unique_years, min(year) AS min_year, max(year) AS max_year FROM a"
)
def summary_stats(spark, sf_dir):
    return context.summary(_flagged(spark, sf_dir))


@query(
    f"WITH {CTX}, a AS (SELECT id, country, year, host, support, bool_or(metric IS NOT NULL) AS hit FROM j GROUP BY ALL) SELECT id, CASE WHEN year >= 1995 THEN 'recent' WHEN year >= 1980 THEN 'modern' WHEN year >= 1950 THEN 'historical_late' ELSE 'historical_early' END AS temporal_context, "
    "CASE WHEN support >= 0.8 THEN 'high' WHEN support >= 0.6 THEN 'moderate' WHEN support >= 0.4 THEN 'low' ELSE 'very_low' END AS support_level, CASE WHEN NOT hit THEN 'Tentar busca com termos alternativos ou países vizinhos' END AS recommendations FROM a"
)
def recommend(spark, sf_dir):
    return context.analyse(_flagged(spark, sf_dir), AS_OF).select("id", "temporal_context", "support_level", F.array_join("recommendations", ";").alias("recommendations"))


@query(f"WITH {CTX}, a AS (SELECT count(DISTINCT country) AS c, max(year) - min(year) AS y FROM j) SELECT CASE WHEN c > 10 THEN 'Dataset com ampla distribuição geográfica - considerar análise por região' ELSE '' END AS recommendations FROM a")
def recommend_global(spark, sf_dir):
    return context.global_recommendations(context.summary(_flagged(spark, sf_dir))).select(F.array_join("recommendations", ";").alias("recommendations"))


@query("SELECT o_custkey::VARCHAR AS id, count(*)::BIGINT AS n_subtrees, round(avg((o_orderkey % 11) / 10), 9) AS support FROM orders GROUP BY o_custkey")
def sequence_support(spark, sf_dir):
    """Orders as subtrees of one leaf, their customer."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tree"), F.col("o_orderkey").cast("string").alias("subtree"), F.array(F.col("o_custkey").cast("string")).alias("terminals"), F.array((F.col("o_orderkey") % 11) / 10).alias("supports"))
    return context.sequence_supports(rows).select("id", "n_subtrees", F.round("support", 9).alias("support"))
