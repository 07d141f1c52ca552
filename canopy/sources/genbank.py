"""GenBank flat files as annotated records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "file string, id string, name string, description string, accessions array<string>, molecule_type string, topology string, date string, source string, "
    "organism string, taxonomy array<string>, features array<struct<type:string,location:string,strand:int,qualifiers:map<string,array<string>>>>, seq string"
)


class _Part(NamedTuple):
    """One stretch of a location, from 0, with the marks of open ends and the other record that it may stand in."""

    start: int
    end: int
    strand: int = 1
    before: str = ""
    after: str = ""
    other: str = ""

    def text(self) -> str:
        return f"{self.other}[{self.before}{self.start}:{self.after}{self.end}]({'-' if self.strand < 0 else '+'})"


_RANGE = re.compile(r"(?:([\w.]+):)?(<?)(\d+)(?:(\.\.|\.|\^)(>?)(\d+))?")


def _listed(text: str) -> list[str]:
    """text at its commas outside brackets."""
    out, depth = [""], 0
    for letter in text:
        depth += (letter == "(") - (letter == ")")
        if letter == "," and not depth:
            out.append("")
        else:
            out[-1] += letter
    return out


def location_parts(text: str) -> tuple[str, list[_Part]]:
    """How a location's parts belong together (join or order, empty for a single one), and the parts in the order of reading.

    The complement of several parts reads them from the last to the first. A location that is none raises ValueError.
    """
    text = re.sub(r"\s", "", text)
    if inner := re.fullmatch(r"complement\((.*)\)", text):
        how, parts = location_parts(inner[1])
        return how, [p._replace(strand=-p.strand) for p in reversed(parts)]
    if inner := re.fullmatch(r"(join|order|bond)\((.*)\)", text):
        return inner[1], [p for t in _listed(inner[2]) for p in location_parts(t)[1]]
    m = _RANGE.fullmatch(text)
    if not m:
        raise ValueError(f"no location: {text}")
    other, before, first, kind, after, last = m.groups("")
    if kind == "^":  # between two letters
        return "", [_Part(int(first), int(first), 1, before, after, other)]
    return "", [_Part(int(first) - 1, int(last or first), 1, before, after, other)]


def _location(text: str) -> tuple[str, int]:
    """A location's text, ``[a:b](+)`` from 0 or several of them in ``join{...}``, and its strand (0 of mixed ones); what is no location stays as it stands."""
    try:
        how, parts = location_parts(text)
    except ValueError:
        return text, -1 if text.startswith("complement") else 1
    strands = {p.strand for p in parts}
    written = [p.text() for p in parts]
    return written[0] if len(parts) == 1 else f"{how}{{{', '.join(written)}}}", strands.pop() if len(strands) == 1 else 0


def _open(qualifier: str) -> bool:
    """Whether a qualifier's value has a quote that is not closed; quotes inside are doubled."""
    value = qualifier.partition("=")[2]
    return value.startswith('"') and value.count('"') % 2 == 1


def _unquoted(value: str) -> str:
    return value[1:-1].replace('""', '"') if len(value) > 1 and value[0] == value[-1] == '"' else value.strip('"')


def parse_record(text: str) -> dict | None:
    """The fields of one record; None for a text without a LOCUS line."""
    if not re.search(r"^LOCUS", text, re.M):
        return None
    head, _, rest = text.partition("\nFEATURES")
    table, _, origin = rest.partition("\nORIGIN")
    parts: dict[str, str] = {}
    key = ""
    for line in head.split("\n"):
        if line[:12].strip():
            key = line[:12].strip()
            parts[key] = line[12:].strip()
        elif key:
            parts[key] += ("\n" if key == "ORGANISM" else " ") + line.strip()
    locus = parts.get("LOCUS", "").split()
    # a name may take several lines; the lineage has semicolons, or is one word with a full stop at the end
    lines = parts.get("ORGANISM", "").strip().split("\n")
    ends = next((i for i, t in enumerate(lines) if i and (";" in t or i == len(lines) - 1 and t.endswith("."))), len(lines))
    organism, lineage = " ".join(lines[:ends]), " ".join(lines[ends:])
    accessions = parts.get("ACCESSION", "").split()
    features: list[dict] = []
    for line in table.split("\n")[1:]:
        unfinished = bool(features and features[-1]["_q"] and _open(features[-1]["_q"][-1]))
        if line[5:21].strip() and not line[:5].strip() and not unfinished:
            features.append({"type": line[5:21].strip(), "_loc": line[21:].strip(), "_q": []})
        elif features and line.strip().startswith("/") and not unfinished:
            features[-1]["_q"].append(line.strip()[1:])
        elif features and line.strip():
            f = features[-1]
            if f["_q"]:
                joint = "" if f["_q"][-1].startswith("translation=") else " "
                f["_q"][-1] += joint + line.strip()
            else:
                f["_loc"] += line.strip()
    for f in features:
        f["location"], f["strand"] = _location(f.pop("_loc"))
        found: dict[str, list[str]] = {}
        for q in f.pop("_q"):
            name, _, value = q.partition("=")
            found.setdefault(name, []).append(_unquoted(value))
        f["qualifiers"] = {k: v for k, v in found.items() if k != "translation"}
    return {
        "id": parts.get("VERSION", "").split(" ")[0] or (accessions[0] if accessions else locus[0] if locus else None),
        "name": locus[0] if locus else None,
        "description": parts.get("DEFINITION", "").rstrip("."),
        "accessions": accessions,
        "molecule_type": next((t for unit, t in zip(locus[1:], locus[2:]) if unit in ("bp", "aa", "rc") and "NA" in t), None),
        "topology": next((t for t in locus if t in ("linear", "circular")), None),
        "date": locus[-1] if locus and re.fullmatch(r"\d\d-\w{3}-\d{4}", locus[-1]) else None,
        "source": parts.get("SOURCE"),
        "organism": organism or None,
        "taxonomy": [t.strip() for t in lineage.rstrip(".").split(";") if t.strip()],
        "features": features,
        "seq": re.sub(r"[^A-Za-z]", "", origin.partition("\n")[2].split("//")[0]).upper(),
    }


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of every file under path; the reader splits at the lines that end records."""
    texts = spark.read.option("lineSep", "\n//").text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    columns = [p.split(" ")[0] for p in re.sub(r"<[^ ]*>", "", RECORD).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, parse_record(t)) for f, t in zip(batch["file"], batch["value"])]
            yield pd.DataFrame([{"file": f} | r for f, r in rows if r], columns=columns)

    return texts.mapInPandas(run, RECORD)


def as_sequences(records: DataFrame) -> DataFrame:
    """Records as sequence rows, for FASTA."""
    return records.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("dataset"), F.monotonically_increasing_id().alias("pos"), "id", F.concat_ws(" ", "id", "description").alias("description"), "seq")
