"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import ball_tree, bitplane, bpe, codebooks, lexical, license_scan, mixing, packing, quality, sentence_spans, simhash, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Where the tokenizer files lie; a parameter of every operator that takes their content.
TOKENIZERS = os.environ.get("CANOPY_TOKENIZERS", "")


def tokenizer_file(name: str) -> str:
    """The content of a public tokenizer's file, read by the driver."""
    path = f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(ls) AS n_lines,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(regexp_extract_all(t, '[A-Za-z\x{80}-\x{10FFFF}]')) AS n_letters,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(?:[-*+]|\x{2022}|\x{2023})[\x20\x09-\x0D]'))) AS n_bullets,
        len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS n_ellipses
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, [n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > 3 * n_words, n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines,
        word_chars < 2 * n_words, word_chars > 20 * n_words, 2 * n_letters < word_chars, n_lines >= 4 AND 10 * n_bullets > 9 * n_lines,
        n_lines >= 4 AND 10 * n_ellipses > 3 * n_lines] AS fails FROM m)
"""
POLICY = "full-2"


@query("op6_quality_rules", _LEDGER + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails[1] OR fails[2] AS base_failed, NOT list_contains(fails, true) AS kept FROM b")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.evaluate(table(spark, sf_dir, "documents"))
    return quality.apply_policy(ledger, POLICY).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes("base-1")).alias("base_failed"), "kept"
    )


@query(
    "quality_ablations",
    _LEDGER
    + """, n AS (SELECT unnest(range(1, 10)) AS i, unnest(['few_words', 'repeated_windows', 'symbols_per_word', 'duplicate_lines', 'short_words', 'long_words', 'few_letters', 'bullet_lines', 'ellipsis_lines']) AS rule),
f AS (SELECT fails, len(list_filter(fails, lambda x: x)) AS k FROM b)
SELECT rule, count(*) FILTER (fails[i])::BIGINT AS n_failed, count(*) FILTER (fails[i] AND k = 1)::BIGINT AS n_failed_alone,
  count(*) FILTER (k = 0 OR (k = 1 AND fails[i]))::BIGINT AS n_kept_without FROM n, f GROUP BY rule
""",
)
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy decides alone, from the ledger's bits."""
    return quality.ablations(quality.evaluate(table(spark, sf_dir, "documents")), POLICY)


#: Fixed values of the contract.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@query(
    "op9_url_filter",
    r"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT *, regexp_replace(host, ':\d*$', '') AS nm FROM p),
x AS (SELECT page_id, host, path,
        CASE WHEN regexp_matches(nm, '^[\d.]+$') THEN nm ELSE regexp_extract(nm, '((?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*))$', 1) END AS suffix,
        CASE WHEN regexp_matches(nm, '^[\d.]+$') OR regexp_extract(nm, '([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*))$', 1) = '' THEN nm
             ELSE regexp_extract(nm, '([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*))$', 1) END AS domain FROM q),
r(action, rule, rhost, prefix) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, prefix) GROUP BY page_id),
l AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT host, domain, suffix, l.bad FROM x JOIN l ON l.doc_id = TRY_CAST(nullif(regexp_extract(path, '/(\d{1,18})', 1), '') AS BIGINT)),
h AS (SELECT host, domain, suffix, count(*) AS n, sum(bad) AS k FROM o GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
m AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 10) AS mu FROM s),
v AS (SELECT 'h' AS lv, count(*) AS g, sum(n) AS n, sum(n * (k / n - mu) * (k / n - mu)) AS ss FROM h, m
      UNION ALL SELECT 'd', count(*), sum(n), sum(n * (k / n - mu) * (k / n - mu)) FROM d, m
      UNION ALL SELECT 's', count(*), sum(n), sum(n * (k / n - mu) * (k / n - mu)) FROM s, m),
st AS (SELECT lv, CASE WHEN n IS NULL OR g < 2 OR ss / n - mu * (1 - mu) / (n / g) <= 0 THEN 100.0
         ELSE least(100.0, greatest(1.0, (mu * (1 - mu) - ss / n) / (ss / n - mu * (1 - mu) / (n / g)))) END AS w FROM v, m),
w AS (SELECT max(w) FILTER (lv = 's') AS ws, max(w) FILTER (lv = 'd') AS wd, max(w) FILTER (lv = 'h') AS wh FROM st),
dr AS (SELECT d.domain, d.suffix, d.n, d.k, (s.k - d.k + ws * mu) / (s.n - d.n + ws) AS pr FROM d JOIN s USING (suffix), m, w),
ps AS (SELECT 'h' AS lv, h.host AS nm, (h.k + wh * (dr.k - h.k + wd * pr) / (dr.n - h.n + wd)) / (h.n + wh) AS rate, h.n + wh AS t FROM h JOIN dr USING (domain, suffix), w
       UNION ALL SELECT 'd', domain, (k + wd * pr) / (n + wd), wh FROM dr, w
       UNION ALL SELECT 's', suffix, (k + ws * mu) / (n + ws), wh FROM s, m, w
       UNION ALL SELECT 'a', '', mu, wh FROM m, w),
lo AS (SELECT lv, nm, rate - 1.645 * sqrt(rate * (1 - rate) / (t + 1)) AS low FROM ps),
li AS (SELECT least(0.5, mu + 0.05) AS li FROM m)
SELECT x.page_id, x.host, x.path, b.rule,
  coalesce(b.action, CASE WHEN coalesce(lh.low, ld.low, ls.low, la.low) > li THEN 'block' ELSE 'allow' END) AS verdict
FROM x LEFT JOIN b USING (page_id) LEFT JOIN lo lh ON lh.lv = 'h' AND lh.nm = x.host LEFT JOIN lo ld ON ld.lv = 'd' AND ld.nm = x.domain
  LEFT JOIN lo ls ON ls.lv = 's' AND ls.nm = x.suffix, (SELECT low FROM lo WHERE lv = 'a') la, li
""",
)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document whose number its path holds: bad if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.split_url(F.col("url"))
    number = F.regexp_extract(path, r"/(\d{1,18})", 1)
    numbered = pages.select(host.alias("host"), number.alias("_number")).filter("_number <> ''").withColumn("doc_id", F.col("_number").cast("long"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    outcomes = numbered.join(labels, "doc_id").select("host", "bad")
    return url_filter.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _license_sql() -> str:
    """The same votes, diagonals and spans over (doc_id, word, template) rows."""
    templates = (*license_scan.BASE, *license_scan.NOTICES, *license_scan.TEXTS)
    k, slack, heads, grams = license_scan.K, license_scan.SLACK, [], []
    for i, t in enumerate(templates):
        w = t.words.split(" ")
        n = len(w)
        extra = n if t.coverage == 1 else n + max(slack, n // 4)
        heads.append(f"({i}, '{t.label}', {t.base}, {n - k + 1}, {extra}, {t.coverage})")
        grams += [f"({i}, {p}, '{' '.join(w[p : p + k])}')" for p in range(n - k + 1)]
    return rf"""
WITH tp(t_id, label, base, n_grams, max_words, coverage) AS (VALUES {", ".join(heads)}),
tg(t_id, t_pos, g) AS (VALUES {", ".join(grams)}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {k - 1})) AS pos FROM d WHERE len(ws) >= {k}),
v AS (SELECT doc_id, t_id, t_pos, pos, pos - t_pos AS dg FROM p JOIN tg ON tg.g = array_to_string(ws[pos + 1:pos + {k}], ' ')),
dd AS (SELECT doc_id, t_id, dg, count(*) AS votes, list(t_pos) AS ps, min(pos) AS lo, max(pos) AS hi FROM v GROUP BY ALL),
nw AS (SELECT *, CASE WHEN dg - lag(dg) OVER (PARTITION BY doc_id, t_id ORDER BY dg) <= {slack} THEN 0 ELSE 1 END AS nw FROM dd),
sp AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, t_id ORDER BY dg) AS sp FROM nw),
mg AS (SELECT doc_id, t_id, label, base, n_grams, max_words, coverage, max(hi) - min(lo) + {k} AS nwords, len(list_distinct(flatten(list(ps)))) AS got,
         count(*) FILTER (votes = n_grams) AS n_exact, min(dg) FILTER (votes = n_grams) AS f, max(dg) FILTER (votes = n_grams) AS l
       FROM sp JOIN tp USING (t_id) GROUP BY doc_id, t_id, sp.sp, label, base, n_grams, max_words, coverage),
ok AS (SELECT *, CASE WHEN base THEN n_exact > 0 ELSE (nwords <= max_words AND got / n_grams >= coverage) OR n_exact > 0 END AS ok, got / n_grams AS share FROM mg),
ag AS (SELECT doc_id, sum(n_exact) FILTER (base AND ok) AS n_base, min(f) FILTER (base AND ok) AS first_word, max(l) FILTER (base AND ok) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base AND ok))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label) FILTER (ok))), ',') AS labels, max(share) FILTER (ok) AS score FROM ok GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN ag USING (doc_id)
"""


@query("op5_license_scan", _license_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_token_binary")
def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query(
    "op7_topk",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
)
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query(
    "op3_sentence_spans",
    r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)),
        lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
w AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_split_to_array(x, '[\x20\x09-\x0D]+'))) AS n FROM s WHERE len(s) >= 2),
p AS (SELECT doc_id, s, n, unnest(range(1, len(s))) AS a FROM w),
f AS (SELECT doc_id, s, a, list_filter(range(a + 1, len(s) + 1), lambda j: list_sum(n[a:j]) >= 10)[1] AS b FROM p),
t AS (SELECT doc_id, s, list_filter(range(len(s) - 1, 0, -1), lambda i: list_sum(n[i:]) >= 10)[1] AS a, len(s) AS b FROM w),
r AS (SELECT DISTINCT doc_id, a, b, array_to_string(s[a:b], chr(10)) AS k FROM (SELECT doc_id, s, a, b FROM f WHERE b IS NOT NULL UNION ALL SELECT doc_id, s, a, b FROM t WHERE a IS NOT NULL)),
n AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) AS nth FROM r),
m AS (SELECT DISTINCT doc_id, unnest(range(a - 1, b)) AS pos FROM n WHERE nth > 1),
g AS (SELECT doc_id, list(pos) AS gone FROM m GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(0, len(s)), lambda i: NOT coalesce(list_contains(gone, i), false)), lambda i: s[i + 1]), chr(10))) AS kept_sha256
FROM s LEFT JOIN g USING (doc_id)
""",
)
def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_spans.remove_repeated_sentences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op11_lexical_search",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT count(*) AS nd, sum(len(ws))::BIGINT AS nt FROM d WHERE len(ws) > 0),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
b AS (SELECT row_number() OVER () AS k, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (SELECT k, item_id, t, count(*) AS q FROM (SELECT k, item_id, unnest(ws) AS t FROM b) GROUP BY ALL),
s AS (SELECT k, item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))::BIGINT AS score
      FROM i JOIN p USING (t) JOIN w USING (t), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
""",
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def _codes_sql(rounds: int = codebooks.ROUNDS) -> str:
    """Lloyd's rounds as full scans of all entries, a CTE each; m is a part's squared distance and entry in one number."""
    scans = []
    for k in range(rounds + 1):
        scans.append(
            f"a{k} AS MATERIALIZED (SELECT r, p, min((list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x))::BIGINT * 256 + e) AS m FROM p JOIN b{k} b USING (p) GROUP BY r, p)"
        )
        if k < rounds:
            scans.append(
                f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(v) / count(*)) AS v "
                f"FROM (SELECT p, m % 256 AS e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k} JOIN p USING (r, p)) GROUP BY p, e, i) GROUP BY p, e) n USING (p, e))"
            )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, p, x[len(x) * p // 4 + 1 : len(x) * (p + 1) // 4] AS x FROM v, range(4) AS t(p)),
b0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v) JOIN p USING (r) WHERE e < 256),
{", ".join(scans)},
c AS (SELECT r, string_agg(printf('%02x', (m % 256)::INT), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: v::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h
"""


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings")).drop("label")


@query(
    "op13_source_mix",
    r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat_ws('/', '0', doc_id::VARCHAR)) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1 AS w, 3 * s / (place % 3 + 1) AS ratio FROM s),
c AS (SELECT *, ((sum(s) OVER ()) - (sum(3 * s) OVER o - 3 * s))::DOUBLE AS rest, ((sum(w) OVER ()) - (sum(w) OVER o - w))::DOUBLE AS weighed FROM w WINDOW o AS (ORDER BY ratio, place ROWS UNBOUNDED PRECEDING)),
l AS (SELECT rest, weighed FROM c WHERE rest / weighed <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, s, CASE WHEN 3 * s * l.weighed <= w * l.rest THEN (3 * s)::DOUBLE ELSE w * l.rest / l.weighed END AS target FROM w, l),
o AS (SELECT doc_id, size, s, target, floor(target + 0.5)::BIGINT AS wanted, (sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target,
  greatest(0, least(size, wanted - off)) + greatest(0, least(size, wanted - s - off)) + greatest(0, least(size, wanted - 2 * s - off)) AS taken FROM o
""",
)
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))
