import pytest
from pyspark.sql import functions as F

from canopy.operators import cleaning, context, graph, joins
from canopy.sources import fasta, genbank, newick, sinks, tables
from canopy.streaming import ingest

GENBANK = """LOCUS       KY288905               12 bp    RNA     linear   VRL 07-JAN-2016
DEFINITION  Zika virus isolate,
            complete genome.
ACCESSION   KY288905 XX1
VERSION     KY288905.1
SOURCE      Zika virus
  ORGANISM  Zika virus
            Viruses; Riboviria;
            Flaviviridae.
FEATURES             Location/Qualifiers
     source          1..12
                     /organism="Zika virus"
                     /host="Homo sapiens"
                     /country="Brazil: Rio"
                     /collection_date="07-Jan-2016"
     CDS             complement(2..7)
                     /product="poly
                     protein"
                     /translation="MKN"
ORIGIN
        1 acgtacgtac gt
//
LOCUS       B2    3 bp    DNA     linear   VRL 01-JAN-2000
ACCESSION   B2
VERSION     B2.1
ORIGIN
        1 acg
//
"""


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "one.fasta").write_text(">a first\nACGT\nAC\n>b|x second > third\nGG\n")
    (tmp_path / "skip.dnd").write_text(">no\nA\n")
    rows = fasta.read_fasta(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.dataset, r.id, r.description, r.seq) for r in rows] == [("one", "a", "a first", "ACGTAC"), ("one", "b|x", "b|x second > third", "GG")]
    out = tmp_path / "out"
    fasta.write_chunks(fasta.read_fasta(spark, str(tmp_path / "one.fasta")), str(out), size=1)
    assert len(list(out.glob("dataset=one/chunk=*"))) == 2


def _read(text, at):
    """A location read by hand: the letters that it names."""
    text = text.replace(" ", "")
    if text.startswith("complement("):
        return _read(text[11:-1], at)[::-1].translate(str.maketrans("ACGTRY", "TGCAYR"))
    if text.startswith(("join(", "order(")):
        inner, out, depth, part = text[text.index("(") + 1 : -1], "", 0, ""
        for letter in inner + ",":
            depth += (letter == "(") - (letter == ")")
            if letter == "," and not depth:
                out, part = out + _read(part, at), ""
            else:
                part += letter
        return out
    ends = [int(x.strip("<>")) for x in text.split("..")]
    return at[ends[0] - 1 : ends[-1]]


LOCATIONS = ("join(1..3,5..9)", "complement(join(1..3,5..9))", "join(complement(5..9),complement(1..3))", "order(2..4,complement(join(6..7,9..11)),1)", "complement(<2..>8)", "7", "join(1..2,complement(order(3..4,complement(8..10))))")


def test_compound_locations(spark):
    seq = "ACGTRYACGTTACA"
    rows = [(i, seq, [("gene", "[0:1](+)"), ("CDS", genbank._location(text)[0]), ("CDS", "[0:1](+)")]) for i, text in enumerate(LOCATIONS)]
    rows += [(100, seq, [("CDS", genbank._location("join(1..2,J00194.1:100..202)")[0])]), (101, seq, [("gene", "[0:1](+)")]), (102, seq, [("CDS", "join{nothing}")]), (103, None, [("CDS", "[0:1](+)")]), (104, seq, [("CDS", genbank._location("4^5")[0])])]
    got = {r.id: r.seq for r in cleaning.first_cds(spark.createDataFrame(rows, "id int, seq string, features array<struct<type:string,location:string>>")).collect()}
    assert got == {i: _read(text, seq) for i, text in enumerate(LOCATIONS)} | {100: None, 101: seq, 102: None, 103: None, 104: ""}
    assert genbank._location("complement(join(1..3,<5..9))") == ("join{[<4:9](-), [0:3](-)}", -1) and genbank._location("join(1..3,complement(5..9))")[1] == 0
    assert genbank._location("what") == ("what", 1)


def test_records_that_are_not_regular():
    record = genbank.parse_record(
        'LOCUS       DNAK1    9 bp    mRNA    linear   VRL 01-JAN-2000\nDEFINITION  d.\nSOURCE      a virus\n  ORGANISM  A very long name\n            of a virus\n            Viruses; Riboviria;\n            Other.\n'
        'FEATURES             Location/Qualifiers\n     CDS             join(1..2,\n                     4..5)\n                     /note="see\n                     /country here"\n                     /product="a ""good"" one"\n                     /pseudo\nORIGIN\n        1 acgtacgta\n'
    )
    assert record["molecule_type"] == "mRNA" and record["organism"] == "A very long name of a virus" and record["taxonomy"] == ["Viruses", "Riboviria", "Other"]
    assert record["features"] == [{"type": "CDS", "location": "join{[0:2](+), [3:5](+)}", "strand": 1, "qualifiers": {"note": ["see /country here"], "product": ['a "good" one'], "pseudo": [""]}}]
    assert genbank.parse_record("LOCUS       X  3 bp\n  ORGANISM  Zika virus\n            Viruses.\n")["taxonomy"] == ["Viruses"]


def test_quoted_labels_and_null_trees(spark):
    assert newick.nexus_newick("#NEXUS\ntranslate 1 'it''s', 2 B;\ntree t = (1,2);") == "('it''s',B);"
    nodes = newick.to_nodes(spark.createDataFrame([("a", None), ("b", "(x,y);")], "tree string, text string"))
    assert {r.tree for r in nodes.collect()} == {"b"}


def test_ids_end_at_white_space(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">id1\tdesc one\nAC\n> id2  two \nGG\n")
    assert [(r.id, r.description, r.seq) for r in fasta.read_fasta(spark, str(tmp_path)).orderBy("pos").collect()] == [("id1", "id1\tdesc one", "AC"), ("id2", "id2  two", "GG")]


def test_clustal(spark, tmp_path):
    (tmp_path / "a.aln").write_text("CLUSTAL W (1.83)\n\ns1   AC-G 4\ns2   A--G 3\n     *  *\n\ns1   TT\ns2   T-\n")
    assert [(r.dataset, r.id, r.seq) for r in fasta.read_clustal(spark, str(tmp_path)).orderBy("pos").collect()] == [("a", "s1", "AC-GTT"), ("a", "s2", "A--GT-")]


def test_catalog(spark, tmp_path):
    for name, rows in (("none", []), ("some", [("Peru", 2001, 1.5)])):
        spark.createDataFrame(rows, "Country string, Year int, cases double").write.parquet(str(tmp_path / name))
    catalog = spark.createDataFrame([("Zika virus", str(tmp_path / "none")), ("Infectious disease", str(tmp_path / "missing")), ("Infectious disease, all", str(tmp_path / "some"))], "title string, path string")
    found = tables.load_from_catalog(spark, catalog, ["zika", "infectious_disease"])
    assert found is not None and found.count() == 1 and tables.load_from_catalog(spark, catalog, ["other"]) is None
    sinks.write_settings(spark, {"a": "é"}, str(tmp_path / "copy"))
    assert tables.settings("\n".join(r.value for r in spark.read.text(str(tmp_path / "copy")).collect())) == {"a": "é"}


def test_first_match_only(spark):
    info = spark.createDataFrame([("a", "Peru", 2001, 0.9)], "id string, country string, year int, support double")
    wide = spark.createDataFrame([("Peru", 2001, 5000.0), ("Peru", 2001, 10.0)], "Country string, Year int, cases double").coalesce(1)
    joined = context.with_indicators(info, context.long_indicators(wide, "w"))
    assert context.insights(joined).count() == 2 and [r.value for r in context.insights(joined, first_only=True).collect()] == [5000.0]


def test_genbank(spark, tmp_path):
    (tmp_path / "x.gb").write_text(GENBANK)
    rows = {r.id: r for r in genbank.read_genbank(spark, str(tmp_path)).collect()}
    assert set(rows) == {"KY288905.1", "B2.1"}
    r = rows["KY288905.1"]
    assert (r.organism, r.taxonomy, r.accessions, r.seq, r.date, r.topology) == ("Zika virus", ["Viruses", "Riboviria", "Flaviviridae"], ["KY288905", "XX1"], "ACGTACGTACGT", "07-JAN-2016", "linear")
    assert r.features[1].location == "[1:7](-)" and r.features[1].qualifiers == {"product": ["poly protein"]}
    info = context.sequence_info(genbank.read_genbank(spark, str(tmp_path))).filter("country is not null").first()
    assert (info.country, info.host, info.year) == ("Brazil", "Homo sapiens", 2016)


def test_accessions_and_settings(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",Accession,Location\n0,K1,x\n1,,y\n")
    assert [r.accession for r in tables.read_accession_csv(spark, str(tmp_path / "a.csv")).collect()] == ["K1"]
    (tmp_path / "l.txt").write_text("# c\n\nA1\n A2 \n")
    assert [r.accession for r in tables.read_accession_list(spark, str(tmp_path / "l.txt")).collect()] == ["A1", "A2"]
    assert tables.settings('{"project_name": "p", "path": "out/#", "n": [1, "#x"]}') == {"project_name": "p", "path": "out/p", "n": [1, "px"]}
    with pytest.raises(ValueError):
        tables.settings('{"initial_min_length": 3, "refined_min_length": 2}')


def test_report(spark):
    info = spark.createDataFrame([("a", "Brazil", 2016, "human", 0.9), ("b", "Peru", 1980, None, 0.0), ("c", None, None, None, 0.5)], "id string, country string, year int, host string, support double")
    wide = spark.createDataFrame([("Brazil", 2016, 5000.0, 7), ("Chile", 2016, 1.0, 1)], "Entity string, Year int, cases double, other int")
    out = context.report(info, context.long_indicators(wide, "w"), 2020)
    assert [(r.id, r.metric, r.support_correlation) for r in out["insights"].collect()] == [("a", "cases_cases", "positive_correlation")]
    s = out["summary"].first()
    assert (s.total_sequences, s.sequences_with_data, s.success_rate, s.unique_countries) == (3, 1, "33.3%", 2)
    assert {r.id: r.has_data for r in out["sequences"].collect()} == {"a": True, "b": False, "c": False}


def test_report_reads_what_it_has_saved(spark):
    """Countries and the summary take no join of sequences and indicators again; an id of two rows has data if one has, whatever the indicators' case."""
    info = spark.createDataFrame([("a", "Brazil", 2016, "human", 0.9), ("a", "Peru", 1980, None, 0.5), ("b", "Peru", 1980, None, 0.5)], "id string, country string, year int, host string, support double")
    wide = spark.createDataFrame([("Brazil", 2016, 5000.0, 7), ("BRAZIL", 2016, 1.0, 1)], "Entity string, Year int, cases double, other int")
    out = context.report(info, context.long_indicators(wide, "w"), 2020)
    for part in ("summary", "sequences", "insights"):
        assert "Join" not in out[part]._jdf.queryExecution().toString()
    assert sorted((r.id, r.country, r.has_data) for r in out["sequences"].collect()) == [("a", "Brazil", True), ("a", "Peru", True), ("b", "Peru", False)]
    assert [(r.country, r.total_sequences, r.n_insights) for r in out["countries"].collect()] == [("Brazil", 1, 2)]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "seq string, t int").withColumn("ts", F.timestamp_seconds(F.col("t").cast("long")))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.write_stream(ingest.dedup_stream(stream, "seq", "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_metadata_statements(spark, tmp_path):
    (tmp_path / "x.gb").write_text(GENBANK)
    records = genbank.read_genbank(spark, str(tmp_path)).select(F.lit("t_Inner1").alias("subtree"), F.struct(F.col("name").alias("newick"), F.lit(7).alias("terminal_hash")).alias("terminal"), F.struct("*").alias("record"))
    out = {r.value.split("newick_id: ")[1].split(",")[0]: r.value for r in graph.metadata_statements(records).collect()}
    text = out['"KY288905"']
    assert 'organism: "Zika virus"' in text and 'taxonomy: ["Viruses","Riboviria","Flaviviridae"]' in text and "terminal_hash: 7" in text
    assert '(f_1:Feature {type: "CDS", location: "[1:7](-)", strand: -1})' in text and 'CREATE (f_1)-[:HAS_QUALIFIER]->(q_1_0:Qualifier {key: "product", value: ["poly protein"]})' in text
    assert "HAS_FEATURE" not in out['"B2"'] and "organism" not in out['"B2"']
    edges = graph.metadata_edges(records)
    assert edges.filter("rel = 'HAS_QUALIFIER'").count() == 5


def test_sinks(spark, tmp_path):
    nodes = newick.to_nodes(spark.createDataFrame([("t1", "(A,B);"), ("t2", "(C,D);")], "tree string, text string"))
    sinks.write_trees(nodes.filter("tree = 't1'"), str(tmp_path / "trees"))
    sinks.write_trees(nodes, str(tmp_path / "trees"))
    back = spark.read.text(str(tmp_path / "trees"))
    assert sorted(map(tuple, back.select("tree", "value").collect())) == [("t1", "(A,B);"), ("t2", "(C,D);")]
    sinks.write_csv(spark.createDataFrame([("g", [1, 2])], "base string, items array<int>"), str(tmp_path / "csv"), "base")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["items"] == "[1,2]"
    found = joins.verify_accessions(spark.createDataFrame([("A",), ("B",)], "accession string"), spark.createDataFrame([("B",)], "accession string"))
    assert [r.value for r in sinks.accession_report(found).orderBy("at").collect()] == ["missing: 1", "A"]
