"""Scalar functions over names, dates and hashes, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(tree: Column) -> Column:
    """The mining group of a tree name: its first two tokens."""
    return F.substring_index(tree, "_", 2)


def stem(path: Column) -> Column:
    """A name without its last extension."""
    return F.regexp_replace(path, r"\.[^.]*$", "")


def without_version(accession: Column) -> Column:
    return F.substring_index(accession, ".", 1)


def organism_key(name: Column) -> Column:
    """Lower case, runs of other than word characters (of any script) as one underscore, none at the ends; unknown where nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"(?U)[\W_]+", "_"), r"^_|_$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown"))


def country_of(location: Column) -> Column:
    """The text before the first colon."""
    return F.trim(F.substring_index(location, ":", 1))


#: Names that the indicator tables spell otherwise, fixed values.
COUNTRY_SYNONYMS = {
    "Cote d'Ivoire": "Côte d'Ivoire",
    "Ivory Coast": "Côte d'Ivoire",
    "Micronesia, Federated States of": "Micronesia (country)",
}


def country_key(country: Column) -> Column:
    """The lower-case name under which indicator tables hold a country."""
    out = country
    for own, other in COUNTRY_SYNONYMS.items():
        out = F.when(country == own, F.lit(other)).otherwise(out)
    return F.lower(out)


def year_of(date: Column) -> Column:
    """The first part of four digits between hyphens, else the last four characters if they are digits; else null."""
    parts = F.filter(F.split(date, "-"), lambda p: p.rlike(r"^\d{4}$"))
    return F.coalesce(F.get(parts, F.lit(0)), F.regexp_extract(date, r"(\d{4})$", 1)).try_cast("int")


def hash16(value: Column) -> Column:
    """The first 16 bits of the md5 of a string, as an int."""
    return F.conv(F.substring(F.md5(value), 1, 4), 16, 10).cast("int")


def item_hash(hashes: Column) -> Column:
    """hash16 of an array of ints as text in brackets; the order counts."""
    return hash16(F.concat(F.lit("["), F.array_join(hashes.cast("array<string>"), ", "), F.lit("]")))


def item_key(names: Column) -> Column:
    """A clade's item: the md5 of its taxon names in order, so that neither child order nor 16 bits make items collide."""
    return F.md5(F.array_join(F.array_sort(names), "\u001f"))


def search_terms(organism: Column) -> Column:
    """Terms for indicator catalogues: general ones for viruses and bacteria, then the name's own longer words."""
    low = F.lower(organism)
    virus = F.when(F.contains(low, F.lit("virus")), F.array(*map(F.lit, ("viral_disease", "infectious_disease", "epidemiology"))))
    bacteria = F.when(F.contains(low, F.lit("bacteria")), F.array(*map(F.lit, ("bacterial_disease", "antimicrobial_resistance"))))
    none = F.array().cast("array<string>")
    words = F.filter(F.regexp_extract_all(low, F.lit(r"(\w+)"), F.lit(1)), lambda w: (F.length(w) > 3) & ~w.isin("virus", "bacteria", "disease"))
    return F.concat(F.coalesce(virus, none), F.coalesce(bacteria, none), words)


def wrapped(sequence: Column, width: int = 60) -> Column:
    """A sequence in lines of width."""
    return F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), r"\n$", "")


def json_escaped(value: Column) -> Column:
    """A text for single quotes in a graph statement: backslashes are escaped first, so that no text ends the quotes, then quotes and line ends."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def padded(row: Column, size: int, fill: Column) -> Column:
    """An array with fill at its end up to size."""
    return F.concat(row, F.array_repeat(fill, F.greatest(F.lit(size) - F.size(row), F.lit(0)).cast("int")))


def is_item_hash(item: Column, hashes: Column) -> Column:
    """Whether an item is the hash of this list."""
    return item == item_hash(hashes)


def is_terminal_hash(value: Column, name: Column) -> Column:
    """Whether a leaf's hash is that of this name, with its version."""
    return value == hash16(name)
