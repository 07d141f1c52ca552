from pyspark.sql import functions as F

from canopy.functions import classify as C
from canopy.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_hashes(spark):
    assert one(spark, T.item_hash(F.array(F.lit(1), F.lit(2), F.lit(3)))) == 18853
    assert one(spark, T.hash16(F.lit("KY288905.1"))) == 61105


def test_item_ignores_child_order(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("x"))
    assert one(spark, T.item_key(a)) == one(spark, T.item_key(b))


def test_years(spark):
    cases = {"07-Jan-2016": 2016, "2007": 2007, "Nov-1962": 1962, "2016-01-07": 2016, "1/6/2007": 2007, "": None, None: None, "soon": None}
    rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", T.year_of(F.col("d")).alias("y")).collect()
    assert {r.d: r.y for r in rows} == cases


def test_names(spark):
    assert one(spark, T.organism_key(F.lit("  Zika virus (Asian) -- "))) == "zika_virus_asian"
    assert one(spark, T.country_key(F.lit("Ivory Coast"))) == "côte d'ivoire"
    assert one(spark, T.search_terms(F.lit("Zika virus"))) == ["viral_disease", "infectious_disease", "epidemiology", "zika"]
    assert one(spark, T.base_name(F.lit("tree_a_clustalo_nj"))) == "tree_a"
    assert one(spark, T.wrapped(F.lit("A" * 130))) == "\n".join(["A" * 60, "A" * 60, "A" * 10])


def test_classifiers(spark):
    assert [one(spark, C.period(F.lit(y), 2020)) for y in (0, 2016, 2001, 1960, 1900)] == ["unknown_period", "recent", "modern", "historical_late", "historical_early"]
    assert one(spark, C.sample_type(F.lit("Homo sapiens"))) == "human_clinical"
    relation = lambda v, s, fixed=True: one(spark, C.support_relation(F.lit("cases_total"), F.lit(float(v)), F.lit(s), fixed))
    assert [relation(0, 0.9), relation(5000, 0.9), relation(5000, 0.1), relation(50, 0.9), relation(500, 0.5)] == ["no_data", "positive_correlation", "unexpected_low_support", "unexpected_high_support", "neutral"]
    assert relation(5000, 0.9, fixed=False) == "neutral"
    assert one(spark, C.recommendations(F.lit(None).cast("string"), F.lit(1980))) == [C.NO_COUNTRY, *C.OLD]
    assert one(spark, C.recommendations(F.lit("Brazil"), F.lit(2010))) == [C.OTHERWISE]
