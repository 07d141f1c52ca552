"""The property graph of trees, subtrees, supports, metadata, features and qualifiers: edges as rows, statements as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.text import json_escaped

UID = "<<USER_UID>>"


def _plain(text: str) -> str:
    """A driver's text for single quotes in a statement."""
    return text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")


PROPERTIES = ("molecule_type", "topology", "date", "source", "organism", "taxonomy", "description", "newick_id", "terminal_hash")


def edges(subtrees: DataFrame, uid: str = UID) -> DataFrame:
    """src, rel and dst of subtrees (tree, subtree, supports): users own trees, trees have subtrees, subtrees have supports."""
    owns = subtrees.select(F.lit(f"User:{uid}").alias("src"), F.lit("OWNS").alias("rel"), F.concat(F.lit("Tree:"), "tree").alias("dst")).distinct()
    has = subtrees.select(F.concat(F.lit("Tree:"), "tree").alias("src"), F.lit("HAS_SUBTREE").alias("rel"), F.concat(F.lit("Subtree:"), "subtree").alias("dst")).distinct()
    support = subtrees.select(F.concat(F.lit("Subtree:"), "subtree").alias("src"), F.lit("HAS_SUPPORT").alias("rel"), F.explode("supports").alias("_s"))
    support = support.select("src", "rel", F.concat(F.lit("Support:"), F.format_string("%.1f", "_s")).alias("dst")).distinct()
    return owns.union(has).union(support)


def properties(terminal: Column, record: Column) -> Column:
    """The nine properties of a metadata node that are not null, as JSON texts."""
    own = {"newick_id": terminal["newick"], "terminal_hash": terminal["terminal_hash"]}
    pairs = [x for p in PROPERTIES for x in (F.lit(p), F.to_json(F.struct((own.get(p) if p in own else record[p]).alias("v"))))]
    value = lambda k, v: F.regexp_extract(v, r'^\{"v":(.*)\}$', 1)
    return F.transform_values(F.map_filter(F.create_map(*pairs), lambda k, v: v != "{}"), value)


def metadata_edges(records: DataFrame) -> DataFrame:
    """subtree, rel, key and value rows of records (subtree, record with features): metadata, features, qualifiers."""
    base = records.select("subtree", "record")
    meta = base.select("subtree", F.lit("HAS_METADATA").alias("rel"), F.col("record.id").alias("key"), F.col("record.description").alias("value"))
    features = base.select("subtree", F.posexplode("record.features").alias("at", "f"))
    has = features.select("subtree", F.lit("HAS_FEATURE").alias("rel"), F.concat("f.type", F.lit("#"), F.col("at").cast("string")).alias("key"), F.col("f.location").alias("value"))
    inner = features.select("subtree", F.concat("f.type", F.lit("#"), F.col("at").cast("string")).alias("_f"), F.explode("f.qualifiers").alias("k", "v"))
    own = inner.select("subtree", F.lit("HAS_QUALIFIER").alias("rel"), F.concat_ws(".", "_f", "k").alias("key"), F.to_json("v").alias("value"))
    return meta.union(has).union(own)


def statements(subtrees: DataFrame, uid: str = UID) -> DataFrame:
    """value: the graph as Cypher text, trees before their subtrees before their supports. Names are escaped."""
    uid = _plain(uid)
    name = lambda c: json_escaped(F.col(c))
    tree = subtrees.select("tree").distinct().select(
        F.col("tree").alias("_t"), F.lit("").alias("_s"), F.lit(0).alias("_o"),
        F.concat(F.lit(f"MERGE (u:User {{uid: '{uid}'}}) CREATE (t:Tree {{name: '"), name("tree"), F.lit(f"', uid: '{uid}'}}) MERGE (u)-[:OWNS]->(t);")).alias("value"),
    )
    sub = subtrees.select(
        F.col("tree").alias("_t"), F.col("subtree").alias("_s"), F.lit(1).alias("_o"),
        F.concat(F.lit("MATCH (p:Tree {name: '"), name("tree"), F.lit(f"', uid: '{uid}'}}) CREATE (c:Subtree {{name: '"), name("subtree"), F.lit(f"', uid: '{uid}'}}) CREATE (p)-[:HAS_SUBTREE]->(c);")).alias("value"),
    )
    support = subtrees.select("tree", "subtree", F.explode("supports").alias("v")).select(
        F.col("tree").alias("_t"), F.col("subtree").alias("_s"), F.lit(2).alias("_o"),
        F.concat(F.lit("MATCH (c:Subtree {name: '"), name("subtree"), F.lit(f"', uid: '{uid}'}}) MERGE (s:Support {{value: "), F.col("v").cast("string"), F.lit("}) CREATE (c)-[:HAS_SUPPORT]->(s);")).alias("value"),
    )
    return tree.union(sub).union(support).orderBy("_t", "_s", "_o", "value").select("value")


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def metadata_statements(records: DataFrame, uid: str = UID) -> DataFrame:
    """subtree and value: one statement per row of records (subtree, terminal, record) that creates metadata, features and qualifiers.

    terminal: newick and terminal_hash; record: the fields of an annotated record. Null properties are left out.
    """
    uid = _plain(uid)

    def feature(f: Column, i: Column) -> Column:
        n = F.concat(F.lit("f_"), i.cast("string"))
        own = F.array_compact(
            F.array(
                F.concat(F.lit("type: "), quoted(f["type"])),
                F.concat(F.lit("location: "), quoted(f["location"])),
                F.concat(F.lit("strand: "), f["strand"].cast("string")),
            )
        )
        made = F.concat(F.lit("CREATE (m)-[:HAS_FEATURE]->("), n, F.lit(":Feature {"), F.array_join(own, ", "), F.lit("})"))

        def qualifier(q: Column, j: Column) -> Column:
            name = F.concat(F.lit("q_"), i.cast("string"), F.lit("_"), j.cast("string"))
            return F.concat(F.lit("\nCREATE ("), n, F.lit(")-[:HAS_QUALIFIER]->("), name, F.lit(":Qualifier {key: "), quoted(q["key"]), F.lit(", value: "), F.to_json(q["value"]), F.lit("})"))

        return F.concat(made, F.array_join(F.transform(F.map_entries(f["qualifiers"]), qualifier), ""))

    props = F.transform(F.map_entries(properties(F.col("terminal"), F.col("record"))), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    lines = F.transform(F.coalesce(F.col("record.features"), F.array().cast(records.schema["record"].dataType["features"].dataType)), feature)
    start = F.concat(F.lit("MATCH (child:Subtree {name: '"), json_escaped(F.col("subtree")), F.lit(f"', uid: '{uid}'}})\nCREATE (m:Metadata {{"), F.array_join(props, ", "), F.lit("})\nCREATE (child)-[:HAS_METADATA]->(m)"))
    return records.select("subtree", F.concat_ws("\n", start, F.array_join(lines, "\n"), F.lit(";")).alias("value"))


def write_statements(subtrees: DataFrame, path: str, uid: str = UID) -> None:
    statements(subtrees, uid).write.mode("overwrite").text(path)


def modern_metadata(text: Column) -> Column:
    """Old statements that merge metadata as a JSON text, as calls that parse it."""
    old = r"MERGE \(m:Metadata \{value:\s*'((?:[^'\\]|\\.)*)'\}\)\s*;?"
    return F.regexp_replace(text, old, "WITH '$1' AS json\nCALL apoc.convert.fromJsonMap(json) YIELD value AS data\nMERGE (m:Metadata {value: data})")
