"""Queries over sequence sets: documents are the sequences, their source the dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import text as T
from canopy.operators import align, build, cleaning, joins, stats
from canopy.plans.registry import query, table

ALPHABET = "A-Z .,"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("description"), F.col("text").alias("seq"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("id"), F.lit("").alias("description"), F.col("p_type").alias("seq"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of one length: what the customers' names hash to, by nation and segment."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey", F.lit("-"), "c_mktsegment").alias("dataset"), F.col("c_custkey").alias("pos"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("id"), F.md5("c_name").alias("seq"))


@query(
    "SELECT source AS dataset, count(*)::BIGINT AS n, round(avg(length(text)), 6) AS avg_length, max(length(text))::BIGINT AS max_length, "
    "round(count(*) * count(*) * avg(length(text)) * 4 / 1073741824, 9) AS est_memory_gb FROM documents GROUP BY source"
)
def seq_stats(spark, sf_dir):
    out = stats.sequence_stats(documents(spark, sf_dir))
    return out.select("dataset", "n", F.round("avg_length", 6).alias("avg_length"), F.col("max_length").cast("long").alias("max_length"), F.round("est_memory_gb", 9).alias("est_memory_gb"))


@query(
    "WITH s AS (SELECT source AS dataset, text, count(*) AS n FROM documents GROUP BY ALL), i AS (SELECT source AS dataset, doc_id, count(*) AS n FROM documents GROUP BY ALL) "
    "SELECT a.dataset, valid_alphabet, duplicate_ids, duplicate_seqs, valid_alphabet AND NOT duplicate_ids AND NOT duplicate_seqs AS clean FROM "
    "(SELECT dataset, bool_and(coalesce(regexp_full_match(upper(text), '[A-Z .,]+'), false)) AS valid_alphabet, bool_or(n > 1) AS duplicate_seqs FROM s GROUP BY dataset) a "
    "JOIN (SELECT dataset, bool_or(n > 1) AS duplicate_ids FROM i GROUP BY dataset) b ON a.dataset = b.dataset"
)
def seq_valid(spark, sf_dir):
    return cleaning.dataset_flags(documents(spark, sf_dir), ALPHABET).select("dataset", "valid_alphabet", "duplicate_ids", "duplicate_seqs", "clean")


@query("SELECT p_brand AS dataset, p_name AS id, count(*)::BIGINT AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def seq_dup_names(spark, sf_dir):
    return parts(spark, sf_dir).groupBy("dataset", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS k FROM documents) "
    "SELECT source AS dataset, arg_min(doc_id, doc_id)::VARCHAR AS id, min(doc_id) AS pos FROM r WHERE k > 1 GROUP BY source"
)
def seq_dup_seq(spark, sf_dir):
    return cleaning.first_repeats(documents(spark, sf_dir))


@query("SELECT source AS dataset, min(doc_id) AS pos FROM documents GROUP BY source, md5(text)")
def seq_dedup_first(spark, sf_dir):
    return cleaning.dedup_sequences(documents(spark, sf_dir)).select("dataset", "pos")


@query(
    "WITH c AS (SELECT source, max(n) = 1 AND bool_and(ok) AS clean FROM (SELECT source, text, count(*) AS n, bool_and(coalesce(regexp_full_match(upper(text), '[A-Z .,]+'), false)) AS ok FROM documents GROUP BY ALL) GROUP BY source) "
    "SELECT dataset, count(*)::BIGINT AS n, sum(pos)::BIGINT AS pos_sum FROM (SELECT source AS dataset, min(doc_id) AS pos FROM documents JOIN c USING (source) WHERE NOT clean GROUP BY source, text "
    "UNION ALL SELECT source, doc_id FROM documents JOIN c USING (source) WHERE clean) GROUP BY dataset"
)
def seq_gate(spark, sf_dir):
    return cleaning.gate(documents(spark, sf_dir)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


@query("SELECT source AS dataset, min(doc_id) AS pos FROM documents WHERE length(text) >= 200 GROUP BY source, upper(text)")
def seq_filter_refine(spark, sf_dir):
    return cleaning.refine(documents(spark, sf_dir), 200, ignore_case=True).select("dataset", "pos")


@query(
    "SELECT doc_id AS pos, CASE WHEN length(text) > 1200 THEN doc_id || '_core' ELSE doc_id::VARCHAR END AS id, length(text) > 1200 AS trimmed, "
    "md5(CASE WHEN length(text) > 1200 THEN substr(text, 101, length(text) - 200) ELSE text END) AS seq FROM documents"
)
def seq_trim(spark, sf_dir):
    return cleaning.trim_terminals(documents(spark, sf_dir), 100, 100, 1000).select("pos", "id", "trimmed", F.md5("seq").alias("seq"))


@query("SELECT source AS dataset, CASE WHEN bool_or(length(text) > 20000) THEN 'mafft' ELSE 'clustalo' END AS aligner FROM documents GROUP BY source")
def seq_longest_route(spark, sf_dir):
    return cleaning.longest_route(documents(spark, sf_dir))


@query("SELECT dataset, pos FROM (SELECT source AS dataset, doc_id AS pos, row_number() OVER (PARTITION BY source ORDER BY md5('0/' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5")
def seq_subsample(spark, sf_dir):
    return cleaning.subsample(documents(spark, sf_dir), 5).select("dataset", "pos")


@query("SELECT source AS dataset, doc_id AS pos, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 + 1)::BIGINT AS chunk FROM documents")
def seq_chunk(spark, sf_dir):
    return cleaning.chunks(documents(spark, sf_dir), 10).select("dataset", "pos", "chunk")


@query(
    "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT max(event_type) FROM events)) "
    "SELECT coalesce(a.user_id, b.user_id) AS id, CASE WHEN a.user_id IS NULL THEN 'only_second' WHEN b.user_id IS NULL THEN 'only_first' ELSE 'both' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id"
)
def fasta_compare(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.join(F.broadcast(ends))
    return joins.compare_ids(e.filter("event_type = lo"), e.filter("event_type = hi"))


@query(
    "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT max(event_type) FROM events)), "
    "c AS (SELECT CASE WHEN a.user_id IS NULL THEN 'only_second' WHEN b.user_id IS NULL THEN 'only_first' ELSE 'both' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id) "
    "SELECT status, count(*)::BIGINT AS n FROM c GROUP BY status UNION ALL SELECT 'total', count(*) FROM c"
)
def status_counts(spark, sf_dir):
    return joins.status_counts(fasta_compare(spark, sf_dir))


@query(
    "WITH e AS (SELECT DISTINCT user_id::VARCHAR AS a FROM events), f AS (SELECT c_custkey::VARCHAR AS a FROM customer) "
    "SELECT a AS accession, 'missing' AS problem FROM e WHERE a NOT IN (SELECT a FROM f) UNION ALL SELECT a, 'unexpected' FROM f WHERE a NOT IN (SELECT a FROM e)"
)
def accession_verify(spark, sf_dir):
    expected = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("accession"))
    found = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".1")).alias("accession"))
    return joins.verify_accessions(expected, found, ignore_version=True)


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def outgroup_union(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return joins.with_outgroup(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("SELECT DISTINCT o_custkey::VARCHAR AS accession FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def unseen_accessions(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("accession"))
    return joins.unseen(wanted, table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("accession")))


@query(
    "WITH k AS (SELECT o_orderkey, 'O' || o_orderkey AS accession FROM orders UNION SELECT o_orderkey, 'C' || o_custkey FROM orders), "
    "f AS (SELECT accession, min(o_orderkey) AS ord FROM k GROUP BY accession) SELECT t.accession, f.ord FROM (SELECT 'C' || c_custkey AS accession FROM customer) t LEFT JOIN f USING (accession)"
)
def genbank_lookup(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.array(F.concat(F.lit("C"), "o_custkey")).alias("accessions"), F.col("o_orderkey").alias("ord"))
    terminals = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("accession"))
    return joins.lookup_records(terminals, records).select("accession", F.col("record.ord").alias("ord"))


@query(
    "WITH s AS (SELECT source AS dataset, count(*) AS n, avg(length(text)) AS a FROM documents GROUP BY source) SELECT dataset, "
    "CASE WHEN n < 100 AND a < 1000 THEN 'localpair' WHEN n < 10000 THEN 'auto' ELSE 'parttree' END AS mafft_strategy, n > 500 OR n * n * a * 4 / 1073741824 > 4 AS clustalo_subsample, n > 5000 AS clustalo_one_iteration FROM s"
)
def align_strategy(spark, sf_dir):
    return stats.align_strategy(stats.sequence_stats(documents(spark, sf_dir))).select("dataset", "mafft_strategy", "clustalo_subsample", "clustalo_one_iteration")


@query(
    "WITH d AS (SELECT source AS dataset, doc_id AS pos, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('0/' || doc_id), doc_id) AS k FROM documents), "
    "s AS (SELECT dataset, count(*) AS m, avg(n) AS a FROM d GROUP BY dataset) "
    "SELECT d.dataset, pos, CASE WHEN m > 5000 THEN '--max-guidetree-iterations 1 --max-hmm-iterations 1' ELSE '' END AS flags FROM d JOIN s ON s.dataset = d.dataset WHERE NOT (m > 25 OR m * m * a * 4 / 1073741824 > 0.005) OR k <= 25"
)
def align_prepared(spark, sf_dir):
    """Data sets as clustalo takes them: those of more than 25 texts, or too much memory, subsampled."""
    return align.prepared(documents(spark, sf_dir), 25, 0.005).select("dataset", "pos", F.array_join("flags", " ").alias("flags"))


@query(
    "WITH c AS (SELECT 'n' || c_nationkey || '-' || c_mktsegment AS dataset, lpad(c_custkey::VARCHAR, 6, '0') AS id, md5(c_name) AS s FROM customer) "
    "SELECT a.dataset, a.id AS id_a, b.id AS id_b, round(hamming(a.s, b.s) / 32, 9) AS dist FROM c a JOIN c b ON a.dataset = b.dataset AND a.id < b.id"
)
def pairwise_identity(spark, sf_dir):
    return build.identity_distances(codes(spark, sf_dir), digits=9)


@query("SELECT source AS name, count(*)::BIGINT AS n FROM documents GROUP BY source ORDER BY n DESC, name LIMIT 1")
def dominant_source(spark, sf_dir):
    return stats.dominant(documents(spark, sf_dir), "dataset").select(F.col("dataset").alias("name"), "n")


@query(
    "WITH c AS (SELECT p_brand AS dataset, p_partkey AS pos, lpad(p_partkey::VARCHAR, 9, '0') AS id, p_type AS s FROM part) "
    "SELECT a.dataset, a.id AS id_a, b.id AS id_b, round(1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)), 9) AS similarity FROM c a JOIN c b ON a.dataset = b.dataset AND a.pos < b.pos "
    "WHERE 1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) >= 0.8"
)
def near_similar(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("pos"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), F.col("p_type").alias("seq"))
    return joins.near_similar(rows, 0.8, digits=9)


def strands(spark, sf_dir):
    """64 letters of DNA for each customer: those of four customers differ by a letter that is A and one that may lack."""
    seed = F.floor(F.col("c_custkey") / 4).cast("long").cast("string")
    letters = F.translate(F.concat(F.md5(F.concat(seed, F.lit("a"))), F.md5(F.concat(seed, F.lit("b")))), "0123456789abcdef", "ACGT" * 4)
    at, gone = F.col("c_custkey") * 7 % 64, F.col("c_custkey") % 3
    seq = F.overlay(letters, F.lit("A"), (at + 1).cast("int"))
    seq = F.when(gone == 0, F.concat(F.substring(seq, 1, 20), F.substring(seq, 22, 64))).otherwise(seq)
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_custkey") % 3).alias("dataset"), F.col("c_custkey").alias("pos"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), seq.alias("seq"))


_STRANDS = (
    "l AS (SELECT c_custkey AS k, translate(md5((c_custkey // 4) || 'a') || md5((c_custkey // 4) || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS t FROM customer), "
    "m AS (SELECT k, substr(t, 1, k * 7 % 64) || 'A' || substr(t, k * 7 % 64 + 2) AS t FROM l), "
    "d AS (SELECT 's' || (k % 3) AS dataset, k AS pos, lpad(k::VARCHAR, 9, '0') AS id, CASE WHEN k % 3 = 0 THEN substr(t, 1, 20) || substr(t, 22) ELSE t END AS seq FROM m)"
)


@query(
    f"WITH {_STRANDS} SELECT a.dataset, a.id AS id_a, b.id AS id_b, round(1 - levenshtein(a.seq, b.seq) / greatest(length(a.seq), length(b.seq)), 9) AS similarity FROM d a JOIN d b ON a.dataset = b.dataset AND a.pos < b.pos "
    "WHERE 1 - levenshtein(a.seq, b.seq) / greatest(length(a.seq), length(b.seq)) >= 0.9"
)
def near_strands(spark, sf_dir):
    """Near copies among strings of four letters, all of about one length."""
    return joins.near_similar(strands(spark, sf_dir), 0.9, digits=9)


@query()
def near_aligned(spark, sf_dir):
    """The same by the letters that an alignment pairs; DuckDB has no longest common subsequence."""
    return joins.near_similar(strands(spark, sf_dir), 0.95, score="alignment", digits=9)


@query("SELECT c_custkey, cast('0x' || substr(md5(c_name), 1, 4) AS INT) AS h FROM customer")
def hash16(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.hash16(F.col("c_name")).alias("h"))


@query(
    "WITH g AS (SELECT c_nationkey, '[' || string_agg(cast('0x' || substr(md5(c_name), 1, 4) AS INT)::VARCHAR, ', ' ORDER BY c_custkey) || ']' AS t FROM customer GROUP BY c_nationkey) "
    "SELECT c_nationkey, cast('0x' || substr(md5(t), 1, 4) AS INT) AS item FROM g"
)
def item_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", T.hash16(F.col("c_name")).alias("h")))).alias("l"))
    return rows.select("c_nationkey", T.item_hash(F.transform("l", lambda x: x["h"])).alias("item"))


@query("SELECT s_suppkey, regexp_replace(regexp_replace(s_name, '(.{6})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS lines FROM supplier")
def fasta_wrap(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.wrapped(F.col("s_name"), 6).alias("lines"))


@query()
def align_centre_star(spark, sf_dir):
    """Alignments of the distinct part types of each brand; the rows of a dataset come out equally long."""
    return align.align(cleaning.dedup_sequences(parts(spark, sf_dir)))


@query("SELECT dataset, count(*)::BIGINT AS n, true AS same_length, true AS restored FROM (SELECT DISTINCT p_brand AS dataset, p_type FROM part) GROUP BY dataset")
def align_shape(spark, sf_dir):
    """Alignments of each brand's distinct types: all of them, equally long, and without their gaps as they were."""
    own = cleaning.dedup_sequences(parts(spark, sf_dir)).select("dataset", F.col("id"), F.col("seq").alias("_seq"))
    made = align_centre_star(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(F.length("seq")) == 1).alias("same_length"), F.sort_array(F.collect_set(F.replace("seq", F.lit("-"), F.lit("")))).alias("_a"))
    before = own.groupBy("dataset").agg(F.sort_array(F.collect_set("_seq")).alias("_b"))
    return made.join(before, "dataset").select("dataset", "n", "same_length", (F.col("_a") == F.col("_b")).alias("restored"))


@query(
    "WITH c AS (SELECT p_brand || '/' || p_size AS dataset, p_partkey::VARCHAR AS id, p_type AS seq, p_size % 2 = 0 AS done FROM part), m AS (SELECT dataset, max(length(seq)) AS n FROM c GROUP BY dataset) "
    "SELECT dataset, id, CASE WHEN done THEN lower(seq) WHEN n <= 20 THEN rpad(seq, n::INT, '-') ELSE lpad(seq, n::INT, '.') END AS seq FROM c JOIN m USING (dataset)"
)
def align_remembered(spark, sf_dir):
    """Alignments that are there (in lower case) are used as they are; other data sets go to one of two aligners by their longest sequence."""
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("dataset"), F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("seq"), (F.col("p_size") % 2 == 0).alias("_done"))
    done = rows.filter("_done").select("dataset", "id", F.lower("seq").alias("seq"))

    def padded(pad, mark):
        def aligner(own):
            longest = own.groupBy("dataset").agg(F.max(F.length("seq")).alias("n"))
            return own.join(longest, "dataset").select("dataset", "id", pad("seq", F.col("n"), F.lit(mark)).alias("seq"))

        return aligner

    return align.remembered(rows.drop("_done"), done, (padded(F.rpad, "-"), padded(F.lpad, ".")), limit=20)
