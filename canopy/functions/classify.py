"""Classifiers of supports, years, samples and places. Clocks are passed in. Word lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HUMAN = ("homo sapiens", "human", "man")
VECTOR = ("aedes", "mosquito", "vector")
ANIMAL = ("animal", "mammal", "bird")
OUTBREAK = ("Brazil", "Colombia", "Mexico", "India", "China")
ENDEMIC = ("Uganda", "Senegal", "Ivory Coast", "Gabon")
HIGH_INCIDENCE = ("cases", "incidence", "prevalence")
METRIC_PATTERNS = {
    "cases": ("cases", "confirmed", "incidence", "prevalence"),
    "deaths": ("deaths", "mortality", "fatality"),
    "dalys": ("dalys", "disability"),
    "rate": ("rate", "ratio", "percentage"),
    "r_number": ("r0", "r_", "reproduction"),
    "vaccination": ("vaccine", "immunization", "coverage"),
}
COUNTRY_COLUMNS = ("country", "entity", "location", "geo", "nation")
YEAR_COLUMNS = ("year", "date", "time", "period")
INTERPRETATIONS = {
    "positive_correlation": "Alta incidência (%s) correlacionada com alto suporte filogenético (%.2f) - sugere transmissão sustentada",
    "unexpected_low_support": "Alta incidência (%s) mas baixo suporte (%.2f) - possíveis múltiplas introduções independentes",
    "unexpected_high_support": "Baixa incidência (%s) mas alto suporte (%.2f) - possível transmissão local sustentada em pequena escala",
    "neutral": "Relação neutra entre incidência (%s) e suporte filogenético (%.2f)",
}
UNDETERMINED = "Relação não determinada"
NO_YEAR = "Ano de coleta não disponível - verificar metadados originais"
NO_COUNTRY = "País de origem não disponível - verificar metadados de localização"
OLD = ("Dados históricos podem ser limitados no OWID", "Consultar bases de dados históricas especializadas")
OTHERWISE = "Tentar busca com termos alternativos ou países vizinhos"
NOTHING_FOUND = ("Nenhum dado OWID encontrado - considerar fontes de dados alternativas", "Verificar se o organismo está presente no catálogo OWID")
MANY_COUNTRIES = "Dataset com ampla distribuição geográfica - considerar análise por região"
LONG_PERIOD = "Dataset abrange longo período temporal - considerar análise de tendências"


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text, F.lit("")).rlike("|".join(words))


def support_level(v: Column) -> Column:
    return F.when(v >= 0.8, "high").when(v >= 0.6, "moderate").when(v >= 0.4, "low").otherwise("very_low")


def period(year: Column, as_of_year: int) -> Column:
    return (
        F.when(F.coalesce(year, F.lit(0)) == 0, "unknown_period")
        .when(year >= as_of_year - 5, "recent")
        .when(year >= as_of_year - 20, "modern")
        .when(year >= 1950, "historical_late")
        .otherwise("historical_early")
    )


def sample_type(host: Column) -> Column:
    low = F.lower(host)
    return F.when(_holds(low, HUMAN), "human_clinical").when(_holds(low, VECTOR), "vector").when(_holds(low, ANIMAL), "animal").otherwise("environmental_or_unknown")


def geography(country: Column) -> Column:
    return F.when(country.isin(*OUTBREAK), "outbreak_region").when(country.isin(*ENDEMIC), "endemic_region").otherwise("other_region")


def support_relation(metric: Column, value: Column, support: Column, fixed: bool = True) -> Column:
    """How a metric and a support go together. fixed=False never finds high incidence, as a substring test the wrong way round would."""
    high = _holds(F.lower(metric), HIGH_INCIDENCE) if fixed else metric.isin(*HIGH_INCIDENCE)
    return (
        F.when(value == 0, "no_data")
        .when(high & (value > 1000), F.when(support > 0.7, "positive_correlation").otherwise("unexpected_low_support"))
        .when((value < 100) & (support > 0.8), "unexpected_high_support")
        .otherwise("neutral")
    )


def interpretation(relation: Column, value: Column, support: Column) -> Column:
    out = F.lit(UNDETERMINED)
    for name, text in INTERPRETATIONS.items():
        out = F.when(relation == name, F.format_string(text, value.cast("string"), support)).otherwise(out)
    return out


def recommendations(country: Column, year: Column) -> Column:
    """What to do about a sequence without indicator rows."""
    no_year, no_country = F.coalesce(year, F.lit(0)) == 0, F.coalesce(country, F.lit("")) == ""
    listed = F.array_compact(
        F.array(
            F.when(no_year, F.lit(NO_YEAR)),
            F.when(no_country, F.lit(NO_COUNTRY)),
            F.when(~no_year & (year < 1990), F.lit(OLD[0])),
            F.when(~no_year & (year < 1990), F.lit(OLD[1])),
        )
    )
    return F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(OTHERWISE)))


def first_column(names: list[str], indicators: tuple[str, ...]) -> str | None:
    """The first column whose name holds an indicator."""
    return next((n for n in names if any(i in n.lower() for i in indicators)), None)
