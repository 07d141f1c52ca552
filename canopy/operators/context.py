"""Sequences in context: features, supports and country/year indicators, and the report over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import classify as C
from canopy.functions.text import country_key, country_of, year_of
from canopy.operators.steps import cut


def first_qualifier(features: Column, *names: str) -> Column:
    """The first value of the first of these qualifiers, in the first source feature that has it."""

    def value(name: str) -> Column:
        having = F.filter(features, lambda f: (f["type"] == "source") & f["qualifiers"][name].isNotNull())
        return F.get(F.get(having, F.lit(0))["qualifiers"][name], F.lit(0))

    found = [value(n) for n in names]
    return F.coalesce(*found)


def sequence_info(records: DataFrame) -> DataFrame:
    """id, country, host, isolation_source, organism, description and year of annotated records."""
    return records.select(
        "id",
        country_of(first_qualifier(F.col("features"), "country", "geo_loc_name")).alias("country"),
        first_qualifier(F.col("features"), "host").alias("host"),
        first_qualifier(F.col("features"), "isolation_source").alias("isolation_source"),
        "organism",
        "description",
        year_of(first_qualifier(F.col("features"), "collection_date")).alias("year"),
    )


def sequence_supports(subtrees: DataFrame) -> DataFrame:
    """Per sequence (leaf): the last record's tree by order, n_subtrees, and the mean of its subtrees' mean supports (0 without any)."""
    each = subtrees.select("tree", "subtree", F.explode("terminals").alias("id"), "supports")
    mean = F.aggregate("supports", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("supports"), F.lit(0))
    return each.groupBy("id").agg(
        F.max_by("tree", F.struct("tree", "subtree")).alias("last_tree"), F.count(F.lit(1)).alias("n_subtrees"), F.coalesce(F.avg(mean), F.lit(0.0)).alias("support")
    )


def long_indicators(table: DataFrame, dataset: str) -> DataFrame:
    """dataset, country, year, row (the wide row's place), metric and value of a wide table; the columns of country and year are found by name."""
    country, year = C.first_column(table.columns, C.COUNTRY_COLUMNS), C.first_column(table.columns, C.YEAR_COLUMNS)
    if not country or not year:
        raise ValueError("no column of countries or of years")
    numbers = [n for n, t in table.dtypes if n not in (country, year) and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    wide = table.select(F.col(country).alias("country"), F.col(year).cast("int").alias("year"), F.monotonically_increasing_id().alias("row"), *[F.col(n).cast("double").alias(n) for n in numbers])
    return wide.unpivot(["country", "year", "row"], numbers, "metric", "value").withColumn("dataset", F.lit(dataset))


def categories(metric: Column) -> Column:
    """The categories whose patterns a metric's name holds."""
    low = F.lower(metric)
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(p)), F.lit(c)) for c, p in C.METRIC_PATTERNS.items()]))


def extract_metrics(rows: DataFrame) -> DataFrame:
    """rows (metric, value, ...) with one row per category; metric becomes category_metric."""
    return rows.withColumn("_c", F.explode(categories(F.col("metric")))).withColumn("metric", F.concat_ws("_", "_c", "metric")).drop("_c")


def with_indicators(info: DataFrame, indicators: DataFrame) -> DataFrame:
    """info left-joined to indicator rows on country and year."""
    side = indicators.select(F.lower("country").alias("_country"), F.col("year").alias("_year"), *[c for c in ("dataset", "row", "metric", "value") if c in indicators.columns])
    return info.join(side, (country_key(F.col("country")) == F.col("_country")) & (F.col("year") == F.col("_year")), "left").drop("_country", "_year")


def analyse(info: DataFrame, as_of_year: int) -> DataFrame:
    """info (with support and has_data) and its context: period, sample type, geography, support level, recommendations."""
    return info.withColumns(
        {
            "temporal_context": C.period(F.col("year"), as_of_year),
            "sample_type": C.sample_type(F.col("host")),
            "geographic_significance": C.geography(F.col("country")),
            "support_level": C.support_level(F.col("support")),
            "recommendations": F.when(~F.col("has_data"), C.recommendations(F.col("country"), F.col("year"))),
        }
    )


def insights(joined: DataFrame, fixed: bool = True, first_only: bool = False) -> DataFrame:
    """joined (with metric, value, support) as insights: only with data and a support above 0.

    With first_only, of the rows that a sequence matches in one dataset the first (by row, the order of the indicator table) alone counts; without it all do.
    """
    matched = joined.filter("value is not null and support > 0")
    if first_only:
        first = matched.groupBy("id", "dataset").agg(F.min("row").alias("row"))
        matched = matched.join(first, ["id", "dataset", "row"])
    rows = extract_metrics(matched)
    relation = C.support_relation(F.col("metric"), F.col("value"), F.col("support"), fixed)
    rows = rows.withColumn("support_correlation", relation)
    return rows.withColumn("interpretation", C.interpretation(F.col("support_correlation"), F.col("value"), F.col("support")))


def country_rollup(found: DataFrame) -> DataFrame:
    """Per country: total_sequences, avg_support and avg_epi_value over insights, and the insights by kind.

    correlations lists the kinds with their numbers, by kind: a list of all would grow with the country.
    """
    kinds = found.groupBy("country", F.col("support_correlation").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    listed = kinds.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("correlations"))
    own = found.groupBy("country").agg(
        F.count_distinct("id").alias("total_sequences"),
        F.avg("support").alias("avg_support"),
        F.avg("value").alias("avg_epi_value"),
        F.count(F.lit(1)).alias("n_insights"),
        F.count_if(F.col("support_correlation") == "neutral").alias("n_neutral"),
    )
    return own.join(listed, own["country"].eqNullSafe(listed["country"])).drop(listed["country"])


def summary(info: DataFrame) -> DataFrame:
    """One row: totals, success_rate, and the span of countries and years."""
    known = F.nullif("country", F.lit(""))
    year = F.nullif("year", F.lit(0))
    total, hits = F.count(F.lit(1)), F.count_if("has_data")
    return info.agg(
        total.alias("total_sequences"),
        hits.alias("sequences_with_data"),
        F.when(total > 0, F.format_string("%.1f%%", hits / F.nullif(total, F.lit(0)) * 100.0)).otherwise("0%").alias("success_rate"),
        F.count_distinct(known).alias("unique_countries"),
        F.count_distinct(year).alias("unique_years"),
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
    )


def global_recommendations(stats: DataFrame) -> DataFrame:
    """recommendations over summary rows."""
    none = F.col("sequences_with_data") == 0
    listed = F.array_compact(
        F.array(
            *[F.when(none, F.lit(t)) for t in C.NOTHING_FOUND],
            F.when(F.col("unique_countries") > 10, F.lit(C.MANY_COUNTRIES)),
            F.when(F.col("max_year") - F.col("min_year") > 50, F.lit(C.LONG_PERIOD)),
        )
    )
    return stats.withColumn("recommendations", listed)


def report(info: DataFrame, indicators: DataFrame, as_of_year: int) -> dict[str, DataFrame]:
    """The whole report as tables: sequences, insights, countries, summary. info has id, country, year, host and support.

    Indicators and the two large tables are saved: countries and the summary read what is there. Whether a sequence has data is told by the
    indicators' countries and years, before any row meets its metrics.
    """
    indicators = cut(indicators)
    places = with_indicators(info.select("id", "country", "year"), indicators.filter("dataset is not null").select("country", "year", "dataset").dropDuplicates(["country", "year"]))
    has = places.groupBy("id").agg(F.bool_or(F.col("dataset").isNotNull()).alias("has_data"))
    sequences = cut(analyse(info.join(has, "id", "left").fillna(False, ["has_data"]), as_of_year))
    found = cut(insights(with_indicators(info, indicators)))
    return {"sequences": sequences, "insights": found, "countries": country_rollup(found), "summary": global_recommendations(summary(sequences))}
