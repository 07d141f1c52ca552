"""Queries that write tables with the sinks and read them back with the sources, and queries over texts of the graph and of reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopy.functions import classify as C
from canopy.functions import text as T
from canopy.operators import cleaning, context, graph, joins, mining, stats, trees
from canopy.operators.steps import new_folder
from canopy.plans.context_queries import CTX, INS, indicators, sequences
from canopy.plans.registry import query, table
from canopy.plans.sequence_queries import documents
from canopy.plans.tree_queries import TREES, nation_subtrees, nation_trees, regional
from canopy.sources import blocks, fasta, genbank, named, nested, newick, sinks, tables


def part_sequences(spark, sf_dir):
    """Parts as sequences: the key is the id, the type without spaces the sequence."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("id"),
        F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit("\t")).otherwise(F.lit(" ")), "p_name").alias("description"), F.replace("p_type", F.lit(" "), F.lit("")).alias("seq"),
    )


@query("SELECT p_partkey::VARCHAR AS id, p_partkey || CASE WHEN p_partkey % 2 = 0 THEN chr(9) ELSE ' ' END || p_name AS description, replace(p_type, ' ', '') AS seq FROM part")
def fasta_round_trip(spark, sf_dir):
    """FASTA with short lines, written and read; an id ends at any white space."""
    path = new_folder(spark)
    fasta.write_fasta(part_sequences(spark, sf_dir), path, width=7)
    return fasta.read_fasta(spark, path).select("id", "description", "seq")


@query("SELECT dataset, chunk, count(*)::BIGINT AS n FROM (SELECT p_brand AS dataset, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 7 + 1)::BIGINT AS chunk FROM part) GROUP BY ALL")
def fasta_chunks(spark, sf_dir):
    path = new_folder(spark)
    fasta.write_chunks(part_sequences(spark, sf_dir), path, 7)
    return blocks.read_blocks(spark, path, "chunks").groupBy("dataset", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 's' || lpad(s_suppkey::VARCHAR, 6, '0') AS id, substr(translate(md5(s_name), '0123456789', '-ghijklmno'), 1, 30) AS seq FROM supplier")
def clustal_read(spark, sf_dir):
    """Alignments in three blocks of ten columns, a file per nation."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("id"), F.translate(F.md5("s_name"), "0123456789", "-ghijklmno").alias("seq"))
    block = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("block")
    lines = rows.select("s_nationkey", block, "id", "seq").select("s_nationkey", "block", "id", F.concat("id", F.lit("   "), F.substr("seq", F.col("block") * 10 + 1, F.lit(10)), F.lit(" 10")).alias("value"))
    heads = rows.select("s_nationkey").distinct().select("s_nationkey", F.lit(-1).alias("block"), F.lit("").alias("id"), F.lit("CLUSTAL O(1.2.4) multiple sequence alignment").alias("value"))
    path = new_folder(spark)
    lines.union(heads).repartition("s_nationkey").sortWithinPartitions("s_nationkey", "block", "id").select("s_nationkey", "value").write.partitionBy("s_nationkey").text(path)
    return fasta.read_clustal(spark, path).select("id", "seq")


_NODES = (
    "l AS (SELECT tree, g, leaf AS name, row_number() OVER (PARTITION BY tree ORDER BY g, leaf) AS w, dense_rank() OVER (PARTITION BY tree ORDER BY g) AS d FROM t), "
    "n AS (SELECT tree, name, (w + d)::INT AS pre, (w + d - 2)::INT AS post, 2 AS depth, true AS is_terminal FROM l "
    "UNION ALL SELECT tree, NULL, (min(w + d) - 1)::INT, (max(w + d) - 1)::INT, 1, false FROM l GROUP BY tree, g UNION ALL SELECT tree, 'root', 0, max(w + d)::INT, 0, false FROM l GROUP BY tree)"
)


@query(f"WITH {TREES}, {_NODES} SELECT tree, name, pre, post, depth, is_terminal FROM n")
def newick_round_trip(spark, sf_dir):
    """Trees written as newick text, twice into one folder, and read as node tables."""
    path, nodes = new_folder(spark), nation_trees(spark, sf_dir)
    sinks.write_trees(nodes, path)
    sinks.write_trees(nodes, path)
    texts = spark.read.text(path).withColumnRenamed("value", "text")
    return newick.to_nodes(texts).select("tree", "name", "pre", "post", "depth", "is_terminal")


@query(f"WITH {TREES}, {_NODES} SELECT tree, name, pre, post, depth, is_terminal FROM n")
def nested_round_trip(spark, sf_dir):
    """Trees as nested values and back."""
    return nested.from_nested(nested.to_nested(nation_trees(spark, sf_dir))).select("tree", "name", "pre", "post", "depth", "is_terminal")


@query(f"WITH {TREES} SELECT tree || '_root' AS tree, count(*)::BIGINT AS n_leaves, min(leaf) AS first FROM t GROUP BY tree HAVING count(*) > 1")
def clade_files(spark, sf_dir):
    """Each clade as a newick text of its own; the whole trees' own are looked at."""
    path = new_folder(spark)
    sinks.write_clades(nation_trees(spark, sf_dir), path)
    texts = spark.read.text(path).withColumnRenamed("value", "text").filter("tree like '%_root'")
    return newick.to_nodes(texts).filter("is_terminal").groupBy("tree").agg(F.count(F.lit(1)).alias("n_leaves"), F.min("name").alias("first"))


@query("SELECT 'c' || c_custkey AS tree, unnest([c_name || '_a', c_name || ' b', 'third']) AS name, unnest([2, 3, 4])::INT AS pre FROM customer")
def nexus_clean(spark, sf_dir):
    """Consensus trees in nexus text, with a translate block, comments and lengths."""
    text = F.concat(
        F.lit("#NEXUS\nbegin trees;\n translate\n 1 "), F.concat("c_name", F.lit("_a")), F.lit(",\n 2 '"), F.concat("c_name", F.lit(" b")), F.lit("',\n 3 third\n ;\n tree con = [&U] ((1[&prob=1.0]:0.1,2:0.2):0.3,3:0.5);\nend;\n")
    )
    # a small file is one partition, of much work for each row
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(4 * spark.sparkContext.defaultParallelism)
    texts = own.select(F.concat(F.lit("c"), "c_custkey").alias("tree"), text.alias("text"))
    return newick.to_nodes(texts).filter("is_terminal").select("tree", "name", "pre")


@query("SELECT 'AC' || s_suppkey || '.1' AS accession, 'csv' AS source FROM supplier UNION ALL SELECT 'AC' || s_suppkey || '.1', 'list' FROM supplier WHERE s_suppkey % 3 <> 0")
def accession_tables(spark, sf_dir):
    """Accessions from a CSV, and from a list in which some lines are comments or blank."""
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("AC"), "s_suppkey", F.lit(".1")).alias("Accession"))
    csv, listed = new_folder(spark), new_folder(spark)
    own.select("Accession", F.lit("x").alias("Other")).union(spark.range(1).select(F.lit(None).cast("string"), F.lit("empty"))).write.option("header", True).csv(csv)
    own.select(F.when(F.col("s_suppkey") % 6 == 0, F.concat(F.lit("# "), "Accession")).when(F.col("s_suppkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "Accession"))).write.text(listed)
    return tables.read_accession_csv(spark, csv).withColumn("source", F.lit("csv")).union(tables.read_accession_list(spark, listed).withColumn("source", F.lit("list")))


@query(f"WITH {TREES} SELECT tree, md5(array_to_string(list_sort(t), chr(31))) AS item, len(t)::BIGINT AS n_terminals, split_part(tree, '_', 1) AS base FROM c WHERE len(t) > 1")
def metadata_round_trip(spark, sf_dir):
    """Subtrees' metadata as JSON lines by mining group, and back."""
    path = new_folder(spark)
    sinks.write_metadata(nation_subtrees(spark, sf_dir), path)
    return tables.read_mined_json(spark, path, "tree string, item string, n_terminals long, terminals array<string>, base string", lines=True).filter(F.size("terminals") == F.col("n_terminals")).select("tree", "item", "n_terminals", "base")


@query(f"WITH {TREES} SELECT tree, md5(array_to_string(list_sort(t), chr(31))) AS item, len(t)::BIGINT AS n_terminals, t[1] AS first, split_part(tree, '_', 1) AS base FROM c WHERE len(t) > 1")
def metadata_variant(spark, sf_dir):
    """Subtrees' metadata read back without a schema."""
    path = new_folder(spark)
    sinks.write_metadata(nation_subtrees(spark, sf_dir), path)
    get = lambda p, kind: F.variant_get("value", f"$.{p}", kind)
    return nested.read_mined_variant(spark, path).select(get("tree", "string").alias("tree"), get("item", "string").alias("item"), get("n_terminals", "long").alias("n_terminals"), get("terminals[0]", "string").alias("first"), "base")


_REG = "b AS (SELECT DISTINCT 'r' || n_regionkey AS base, 'n' || lpad(c_nationkey::VARCHAR, 2, '0') AS tree, c_mktsegment || '/' || floor(c_acctbal / 1000)::BIGINT AS item FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(
    f"WITH {_REG}, n AS (SELECT base, count(DISTINCT tree) AS rws FROM b GROUP BY base), k AS (SELECT base, item, count(*) AS n FROM b GROUP BY ALL) "
    "SELECT k.base, item, k.n::BIGINT AS n, '[' || array_to_string(list_transform(list_filter(range(1, 11), lambda t: k.n * 10 >= t * rws), lambda t: format('{:.1f}', t / 10)), ',') || ']' AS supports FROM k JOIN n ON k.base = n.base WHERE k.n * 10 >= rws"
)
def itemset_csv(spark, sf_dir):
    """Items with their supports as CSV by mining group; arrays are JSON text there."""
    path = new_folder(spark)
    found = mining.grid_supports(mining.item_counts(regional(spark, sf_dir), "base", "tree", "item"))
    sinks.write_csv(found.select("base", "item", "n", "supports"), path, by="base")
    return spark.read.csv(path, header=True, schema="item string, n long, supports string, base string").select("base", "item", "n", "supports")


@query("SELECT p_brand AS dataset, p_partkey::VARCHAR AS id, p_partkey || ' ' || p_name AS description, translate(md5(p_name), '0123456789', 'ghijklmnop') AS seq FROM part")
def fasta_blocks(spark, sf_dir):
    """A file of each brand's sequences, read in blocks that cut records anywhere."""
    path, p = new_folder(spark), table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_partkey", "p_name").alias("description"), F.translate(F.md5("p_name"), "0123456789", "ghijklmnop").alias("seq"))
    named.write_named(fasta.fasta_text(rows, 20), path, "dataset", ("pos",))
    return blocks.read_blocks(spark, path, block_bytes=5000).select("dataset", "id", "description", "seq")


def genbank_texts(spark, sf_dir):
    """A flat-file record per supplier: a source feature with country, host and date, and a coding sequence on either strand."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    seq = F.translate(F.concat(F.md5("s_name"), F.md5(F.concat("s_name", F.lit("x")))), "0123456789abcdef", "acgtacgtacgtacgt")
    where = F.when(F.col("s_suppkey") % 2 == 0, F.lit("complement(5..16)")).otherwise(F.lit("5..16"))
    lines = [
        F.concat(F.lit("LOCUS       "), key, F.lit("                 64 bp    DNA     linear   VRL 01-JAN-2001")),
        F.concat(F.lit("DEFINITION  "), "s_name", F.lit(",\n            complete sequence.")),
        F.concat(F.lit("ACCESSION   "), key, F.lit(" X"), key),
        F.concat(F.lit("VERSION     "), key, F.lit(".2")),
        F.lit("SOURCE      some virus\n  ORGANISM  Some virus\n            Viruses; Riboviria."),
        F.lit("FEATURES             Location/Qualifiers\n     source          1..64"),
        F.concat(F.lit("                     /country=\""), "n_name", F.lit(": region "), F.col("s_suppkey").cast("string"), F.lit("\"\n                     /host=\"Homo sapiens\"")),
        F.concat(F.lit("                     /collection_date=\"12-Mar-"), (F.lit(1990) + F.col("s_suppkey") % 30).cast("string"), F.lit("\"")),
        F.concat(F.lit("     CDS             "), where, F.lit("\n                     /product=\"a protein\n                     of two lines\"")),
        F.concat(F.lit("ORIGIN\n        1 "), F.substring(seq, 1, 32), F.lit("\n       33 "), F.substring(seq, 33, 32)),
        F.lit("//"),
    ]
    return s.select(F.concat_ws("\n", *lines).alias("value"))


def records(spark, sf_dir):
    path = new_folder(spark)
    genbank_texts(spark, sf_dir).write.text(path)
    return genbank.read_genbank(spark, path)


_GB = (
    "g AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') AS k, s_suppkey, s_name, n_name, upper(translate(md5(s_name) || md5(s_name || 'x'), '0123456789abcdef', 'acgtacgtacgtacgt')) AS seq FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
)


@query(f"WITH {_GB} SELECT k || '.2' AS id, s_name || ', complete sequence' AS description, k || ',X' || k AS accessions, 'Some virus' AS organism, 'Viruses,Riboviria' AS taxonomy, 2 AS n_features, 'DNA' AS molecule_type, 'linear' AS topology, '01-JAN-2001' AS date, seq FROM g")
def genbank_read(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("id", "description", F.array_join("accessions", ",").alias("accessions"), "organism", F.array_join("taxonomy", ",").alias("taxonomy"), F.size("features").alias("n_features"), "molecule_type", "topology", "date", "seq")


@query(f"WITH {_GB} SELECT k || '.2' AS id, n_name AS country, seq FROM g")
def genbank_blocks(spark, sf_dir):
    """The records by blocks of their files."""
    path = new_folder(spark)
    genbank_texts(spark, sf_dir).write.text(path)
    found = blocks.read_blocks(spark, path, "genbank", block_bytes=3000)
    source = F.get(F.filter("features", lambda f: f["type"] == "source"), F.lit(0))
    return found.select("id", F.substring_index(source["qualifiers"]["country"][0], ":", 1).alias("country"), "seq")


@query(f"WITH {_GB} SELECT k || '.2' AS id, CASE WHEN s_suppkey % 2 = 0 THEN reverse(translate(substr(seq, 5, 12), 'ACGT', 'TGCA')) ELSE substr(seq, 5, 12) END AS seq FROM g")
def genbank_cds(spark, sf_dir):
    return cleaning.first_cds(records(spark, sf_dir)).select("id", "seq")


@query(
    f"WITH {_GB}, t AS (SELECT *, substr(seq, 3, 8) AS a, substr(seq, 21, 10) AS b, substr(seq, 41, 1) AS c FROM g) "
    "SELECT k || '.2' AS id, CASE s_suppkey % 4 WHEN 0 THEN a || b || c WHEN 1 THEN reverse(translate(a || b || c, 'ACGT', 'TGCA')) WHEN 2 THEN a || reverse(translate(b, 'ACGT', 'TGCA')) || c WHEN 3 THEN c || b || a END AS seq FROM t"
)
def genbank_spliced(spark, sf_dir):
    """Coding sequences of several parts: joined, complemented as a whole or in part, and in another order."""
    whole = ["join(3..10,21..30,41)", "complement(join(3..10,21..30,41))", "join(<3..10,complement(21..30),41)", "order(41,21..30,3..>10)"]
    where = F.element_at(F.array(*map(F.lit, whole)), (F.regexp_extract("value", r"VERSION     S(\d+)", 1).cast("long") % 4 + 1).cast("int"))
    path = new_folder(spark)
    genbank_texts(spark, sf_dir).select(F.regexp_replace("value", F.lit(r"( {5}CDS {13})\S+"), F.concat(F.lit("$1"), where)).alias("value")).write.text(path)
    return cleaning.first_cds(genbank.read_genbank(spark, path)).select("id", "seq")


@query(f"WITH {_GB} SELECT k || '.2' AS id, k || '.2 ' || s_name || ', complete sequence' AS description, seq FROM g")
def genbank_to_fasta(spark, sf_dir):
    path = new_folder(spark)
    fasta.write_fasta(genbank.as_sequences(records(spark, sf_dir)).withColumn("dataset", F.lit("all")), path, width=50)
    return fasta.read_fasta(spark, path).select("id", "description", "seq")


@query(f"WITH {_GB} SELECT k || '.2' AS id, n_name AS country, 'Homo sapiens' AS host, 'Some virus' AS organism, (1990 + s_suppkey % 30)::INT AS year FROM g")
def sequence_records(spark, sf_dir):
    """What context needs of annotated records: the country before the colon, the host, the year of the collection."""
    return context.sequence_info(records(spark, sf_dir)).select("id", "country", "host", "organism", "year")


@query(
    f"WITH {_GB}, p AS (SELECT k, s_name, unnest(['molecule_type', 'topology', 'date', 'source', 'organism', 'taxonomy', 'description', 'newick_id', 'terminal_hash']) AS key, "
    "unnest(['\"DNA\"', '\"linear\"', '\"01-JAN-2001\"', '\"some virus\"', '\"Some virus\"', '[\"Viruses\",\"Riboviria\"]', '\"' || s_name || ', complete sequence\"', '\"' || k || '\"', cast('0x' || substr(md5(k), 1, 4) AS INT)::VARCHAR]) AS value FROM g) SELECT k AS id, key, value FROM p"
)
def graph_properties(spark, sf_dir):
    """The nine properties of each record's metadata node."""
    terminal = F.struct(T.without_version(F.col("id")).alias("newick"), T.hash16(T.without_version(F.col("id"))).alias("terminal_hash"))
    r = records(spark, sf_dir)
    own = graph.properties(terminal, F.struct(*[F.col(c) for c in r.columns]))
    return r.select(T.without_version(F.col("id")).alias("id"), F.explode(own).alias("key", "value"))


@query(
    f"WITH {_GB}, f AS (SELECT k, unnest(['HAS_METADATA', 'HAS_FEATURE', 'HAS_FEATURE', 'HAS_QUALIFIER', 'HAS_QUALIFIER', 'HAS_QUALIFIER', 'HAS_QUALIFIER']) AS rel, "
    "unnest([k || '.2', 'source#0', 'CDS#1', 'source#0.country', 'source#0.host', 'source#0.collection_date', 'CDS#1.product']) AS key, "
    "unnest([s_name || ', complete sequence', '[0:64](+)', CASE WHEN s_suppkey % 2 = 0 THEN '[4:16](-)' ELSE '[4:16](+)' END, '[\"' || n_name || ': region ' || s_suppkey || '\"]', '[\"Homo sapiens\"]', '[\"12-Mar-' || (1990 + s_suppkey % 30) || '\"]', '[\"a protein of two lines\"]']) AS value FROM g) "
    "SELECT k AS subtree, rel, key, value FROM f"
)
def graph_metadata(spark, sf_dir):
    """Metadata, features and qualifiers of each record as rows of the graph."""
    r = records(spark, sf_dir)
    return graph.metadata_edges(r.select(T.without_version(F.col("id")).alias("subtree"), F.struct(*[F.col(c) for c in r.columns]).alias("record")))


@query(
    f"WITH {_GB} SELECT k AS subtree, 'MATCH (child:Subtree {{name: ''' || k || '''' || ', uid: ''u\\''1''}})' || chr(10) || 'CREATE (m:Metadata' AS head, 2::INT AS n_features, 4::INT AS n_qualifiers FROM g".replace("{{", "{").replace("}}", "}")
)
def graph_statements(spark, sf_dir):
    """Metadata statements: how each begins, with an escaped user, and what it creates."""
    r = records(spark, sf_dir)
    rows = r.select(
        T.without_version(F.col("id")).alias("subtree"), F.struct(T.without_version(F.col("id")).alias("newick"), T.hash16(F.col("id")).alias("terminal_hash")).alias("terminal"), F.struct(*[F.col(c) for c in r.columns]).alias("record")
    )
    made = graph.metadata_statements(rows, "u'1")
    return made.select("subtree", F.regexp_extract("value", r"(?s)^(.*?CREATE \(m:Metadata)", 1).alias("head"), F.regexp_count("value", F.lit("HAS_FEATURE")).alias("n_features"), F.regexp_count("value", F.lit("HAS_QUALIFIER")).alias("n_qualifiers"))


@query(
    f"WITH {TREES}, s AS (SELECT tree, name, n FROM (SELECT tree, tree || '_' || CASE WHEN g IS NULL THEN 'root' ELSE 'Inner' || dense_rank() OVER (PARTITION BY tree, g IS NULL ORDER BY g) END AS name, len(t) AS n FROM c) WHERE n > 1) "
    "SELECT 'MERGE (u:User {uid: ''me''}) CREATE (t:Tree {name: ''' || tree || ''', uid: ''me''}) MERGE (u)-[:OWNS]->(t);' AS value FROM (SELECT DISTINCT tree FROM s) "
    "UNION ALL SELECT 'MATCH (p:Tree {name: ''' || tree || ''', uid: ''me''}) CREATE (c:Subtree {name: ''' || name || ''', uid: ''me''}) CREATE (p)-[:HAS_SUBTREE]->(c);' FROM s "
    "UNION ALL SELECT 'MATCH (c:Subtree {name: ''' || name || ''', uid: ''me''}) MERGE (s:Support {value: 0.5}) CREATE (c)-[:HAS_SUPPORT]->(s);' FROM s"
)
def cypher_file(spark, sf_dir):
    """The graph of trees, subtrees and supports as a file of statements, read back."""
    path = new_folder(spark)
    graph.write_statements(nation_subtrees(spark, sf_dir).withColumn("supports", F.array(F.lit(0.5))), path, "me")
    return spark.read.text(path)


@query("SELECT o_orderkey, 'a\\\\' || o_orderstatus || '\\''' || o_orderpriority || '\\n' AS value, 'WITH ''{\"k\": ' || o_orderkey || '}'' AS json' || chr(10) || 'CALL apoc.convert.fromJsonMap(json) YIELD value AS data' || chr(10) || 'MERGE (m:Metadata {value: data})' AS modern FROM orders")
def graph_escape(spark, sf_dir):
    """Texts with backslashes, quotes and line ends inside quotes, and old statements in their new form."""
    o = table(spark, sf_dir, "orders")
    raw = F.concat(F.lit("a\\"), "o_orderstatus", F.lit("'"), "o_orderpriority", F.lit("\n"))
    old = F.concat(F.lit("MERGE (m:Metadata {value: '{\"k\": "), F.col("o_orderkey").cast("string"), F.lit("}'});"))
    return o.select("o_orderkey", T.json_escaped(raw).alias("value"), graph.modern_metadata(old).alias("modern"))


@query(
    "WITH e AS (SELECT DISTINCT user_id::VARCHAR AS a FROM events), f AS (SELECT c_custkey::VARCHAR AS a FROM customer), "
    "p AS (SELECT a, 'missing' AS problem FROM e WHERE a NOT IN (SELECT a FROM f) UNION ALL SELECT a, 'unexpected' FROM f WHERE a NOT IN (SELECT a FROM e)) "
    "SELECT problem, \"at\", value, \"at\" <= 10 AS in_head FROM (SELECT problem, row_number() OVER (PARTITION BY problem ORDER BY a) AS \"at\", a AS value FROM p) UNION ALL SELECT problem, 0, problem || ': ' || count(*), true FROM p GROUP BY problem"
)
def accession_report(spark, sf_dir):
    expected = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("accession"))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("accession"))
    return sinks.accession_report(joins.verify_accessions(expected, found))


@query("SELECT source AS dataset, count(*)::BIGINT AS n, round(avg(length(text)), 6) AS avg_length FROM documents WHERE length(text) > 0 GROUP BY source")
def seq_stats_filled(spark, sf_dir):
    out = stats.sequence_stats(documents(spark, sf_dir), skip_empty=True)
    return out.select("dataset", "n", F.round("avg_length", 6).alias("avg_length"))


@query("SELECT p_partkey, p_name || '.v1' AS stem, trim(p_name) AS country, p_type || ',0,0' AS padded FROM part")
def name_parts(spark, sf_dir):
    """Names without their last extension, before the first colon, and rows filled up."""
    p = table(spark, sf_dir, "part")
    filled = F.array_join(T.padded(F.array("p_type"), 3, F.lit("0")), ",")
    return p.select("p_partkey", T.stem(F.concat("p_name", F.lit(".v1.gb"))).alias("stem"), T.country_of(F.concat(F.lit(" "), "p_name", F.lit(" : x : y"))).alias("country"), filled.alias("padded"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'virus_' || lower(c_mktsegment) WHEN 2 THEN 'côte_d_ivoire_' || c_custkey ELSE 'ærø' END AS k FROM customer")
def organism_unicode(spark, sf_dir):
    """Names in other scripts keep their letters; names of which nothing is left are unknown."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 4 == 0, F.lit(" (-) ")).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("Virus ("), "c_mktsegment", F.lit(")"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("Côte d'Ivoire "), F.col("c_custkey").cast("string"))).otherwise(F.lit("Ærø"))
    return c.select("c_custkey", T.organism_key(name).alias("k"))


@query(
    "WITH t AS (SELECT p_partkey, p_name, unnest(['red', 'small']) AS term, unnest([0, 1]) AS place FROM part) SELECT place::INT AS place, term, p_name AS title, p_partkey::VARCHAR AS path FROM t WHERE contains(replace(lower(p_name), ' ', '_'), term)"
)
def catalog_search(spark, sf_dir):
    catalog = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("path"))
    return tables.search_catalog(catalog, ["red", "small"])


#: A row for each line number, of which the last one of a nation and year comes first.
_FIRST = CTX.replace("AS year, count(*)", "AS year, l_linenumber, count(*)").replace("GROUP BY ALL), i AS", "GROUP BY lower(n_name), year(l_shipdate), l_linenumber QUALIFY row_number() OVER (PARTITION BY lower(n_name), year(l_shipdate) ORDER BY l_linenumber DESC) = 1), i AS")


@query(f"WITH {_FIRST}{INS} SELECT id, metric, round(value, 4) AS value, rel AS support_correlation FROM r")
def insights_first(spark, sf_dir):
    """Insights of the first matched row of each dataset alone, of several rows that a nation and year have."""
    found = context.insights(context.with_indicators(sequences(spark, sf_dir), indicators(spark, sf_dir, by_line=True)), first_only=True)
    return found.select("id", "metric", F.round("value", 4).alias("value"), "support_correlation")


@query(
    f"WITH {CTX}{INS}, k AS (SELECT country, rel, count(*) AS n FROM r GROUP BY ALL) SELECT country, string_agg(rel || ':' || n, ',' ORDER BY rel) AS correlations FROM k GROUP BY country"
)
def country_correlations(spark, sf_dir):
    """Each country's correlations, as how often each kind comes."""
    rows = context.country_rollup(context.insights(context.with_indicators(sequences(spark, sf_dir), indicators(spark, sf_dir))))
    return rows.select("country", F.array_join(F.transform("correlations", lambda c: F.concat_ws(":", c["kind"], c["n"].cast("string"))), ",").alias("correlations"))


@query(f"WITH {CTX}{INS} SELECT id, metric, rel AS support_correlation, " + " ".join(["CASE rel", *[f"WHEN '{k}' THEN '" + v.split("%")[0].replace("'", "''") + "'" for k, v in C.INTERPRETATIONS.items()], f"ELSE '{C.UNDETERMINED}' END"]) + " AS begins FROM r")
def interpretations(spark, sf_dir):
    """How each insight's sentence begins, up to its first number."""
    found = context.insights(context.with_indicators(sequences(spark, sf_dir), indicators(spark, sf_dir)))
    lengths = [x for k, v in C.INTERPRETATIONS.items() for x in (F.lit(k), F.lit(len(v.split("%")[0])))]
    n = F.coalesce(F.element_at(F.create_map(*lengths), F.col("support_correlation")), F.length("interpretation"))
    return found.select("id", "metric", "support_correlation", F.substr("interpretation", F.lit(1), n).alias("begins"))


@query(
    f"WITH {CTX}{INS}, a AS (SELECT DISTINCT id, bool_or(metric IS NOT NULL) OVER (PARTITION BY id) AS has_data FROM j) "
    "SELECT 'sequences' AS part, count(*)::BIGINT AS n, count_if(has_data)::BIGINT AS hits FROM a UNION ALL SELECT 'insights', count(*), count(DISTINCT id) FROM r UNION ALL SELECT 'countries', count(DISTINCT country), count(DISTINCT country) FROM r UNION ALL SELECT 'summary', 1, (SELECT count_if(has_data) FROM a)"
)
def report_files(spark, sf_dir):
    """The whole report written as JSON and read back: rows of each part, and how many have data."""
    path = new_folder(spark)
    sinks.write_report(context.report(sequences(spark, sf_dir), indicators(spark, sf_dir), 2000), path)
    read = lambda part, schema: spark.read.schema(schema).json(f"{path}/{part}")
    count = F.count(F.lit(1)).alias("n")
    parts = [
        read("sequences", "id long, has_data boolean").agg(count, F.count_if("has_data").alias("hits")),
        read("insights", "id long").agg(count, F.count_distinct("id").alias("hits")),
        read("countries", "country string").agg(count, F.count_distinct("country").alias("hits")),
        read("summary", "sequences_with_data long").agg(count, F.max("sequences_with_data").alias("hits")),
    ]
    out = None
    for name, df in zip(("sequences", "insights", "countries", "summary"), parts):
        own = df.select(F.lit(name).alias("part"), "n", "hits")
        out = own if out is None else out.union(own)
    return out


@query(
    "SELECT 'c' || c_custkey AS tree, unnest(['Inner1', 'root', 'x', 'y ' || c_name, 'z''z']) AS name, unnest([1, 0, 2, 3, 4])::INT AS pre, unnest([0.25, NULL, 1.5, 0.1, 2.0])::DOUBLE AS branch_length FROM customer"
)
def newick_lengths(spark, sf_dir):
    """Node tables to text and back: lengths, missing lengths, names with spaces and quotes, inner labels."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("tree"), F.concat(F.lit("((x:1.5,'y "), "c_name", F.lit("':0.1):0.25,'z''z':2.0)root;")).alias("text"))
    nodes = trees.label_internals(newick.to_nodes(newick.to_newick(newick.to_nodes(rows))))
    return nodes.select("tree", "name", "pre", "branch_length")
