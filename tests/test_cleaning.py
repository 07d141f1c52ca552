import random

from pyspark.sql import functions as F

from canopy.operators import cleaning, joins, stats

ROWS = [("d", 0, "a", "a", "ACDE"), ("d", 1, "b", "b", "ACDE"), ("d", 2, "a", "a", "ACXE"), ("d", 3, "c", "c", "acde"), ("e", 0, "x", "x", "ACDF"), ("e", 1, "y", "y", "ACDG"), ("f", 0, "z", "z", None)]


def seqs(spark):
    return spark.createDataFrame(ROWS, "dataset string, pos long, id string, description string, seq string")


def test_flags_and_gate(spark):
    flags = {r.dataset: (r.valid_alphabet, r.duplicate_ids, r.duplicate_seqs, r.clean) for r in cleaning.dataset_flags(seqs(spark)).collect()}
    assert flags == {"d": (False, True, True, False), "e": (True, False, False, True), "f": (False, False, False, False)}
    assert sorted((r.dataset, r.pos) for r in cleaning.gate(seqs(spark)).collect()) == [("d", 0), ("d", 2), ("d", 3), ("e", 0), ("e", 1), ("f", 0)]
    assert [(r.dataset, r.id, r.pos) for r in cleaning.first_repeats(seqs(spark)).collect()] == [("d", "b", 1)]


def test_refine_and_trim(spark):
    assert sorted((r.dataset, r.pos) for r in cleaning.refine(seqs(spark), 4, ignore_case=True).collect()) == [("d", 0), ("d", 2), ("e", 0), ("e", 1)]
    trimmed = {r.pos: (r.id, r.seq) for r in cleaning.trim_terminals(seqs(spark).filter("dataset = 'e'"), 1, 1, 1).collect()}
    assert trimmed == {0: ("x_core", "CD"), 1: ("y_core", "CD")}


def test_subsample_is_stable(spark):
    pick = lambda df: {r.pos for r in cleaning.subsample(df, 2, seed=3).filter("dataset = 'd'").collect()}
    assert len(pick(seqs(spark))) == 2 and pick(seqs(spark)) == pick(seqs(spark).repartition(3))


def test_ignored_methods(spark):
    grid = spark.createDataFrame([("nj",), ("MrBayes",)], "method string")
    assert [r.method for r in cleaning.without_ignored(grid, " mrbayes, none,").collect()] == ["nj"]
    assert cleaning.without_ignored(grid, None).count() == 2


def test_cds(spark):
    schema = "id string, seq string, features array<struct<type:string,location:string>>"
    rows = [("a", "AACCGGTT", [("gene", "[0:8](+)"), ("CDS", "[2:6](+)")]), ("b", "AACCGGTT", [("CDS", "[0:3](-)")]), ("c", "AA", [])]
    assert {r.id: r.seq for r in cleaning.first_cds(spark.createDataFrame(rows, schema)).collect()} == {"a": "CCGG", "b": "GTT", "c": "AA"}


def test_joins(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in ("ab", "bc"))
    found = joins.compare_ids(a, b)
    assert sorted(map(tuple, found.collect())) == [("a", "only_first"), ("b", "both"), ("c", "only_second")]
    assert {r.status: r.n for r in joins.status_counts(found).collect()} == {"both": 1, "only_first": 1, "only_second": 1, "total": 3}
    e, f = spark.createDataFrame([("A1",), ("A2",)], "accession string"), spark.createDataFrame([("A1.1",), ("A3.2",)], "accession string")
    assert sorted(map(tuple, joins.verify_accessions(e, f, True).collect())) == [("A2", "missing"), ("A3", "unexpected")]
    assert joins.verify_accessions(e, f).count() == 4


def test_near_similar_against_brute_force(spark):
    rng = random.Random(1)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    base = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(25)]
    texts = base + base[:3]
    for b in base:
        t = list(b)
        for _ in range(rng.randint(1, 5)):
            t[rng.randrange(len(t)) :][:1] = rng.choice(["", "x", "ab"])
            t.insert(rng.randint(0, len(t)), rng.choice("abx"))
        texts.append("".join(t))
    rows = [(f"d{i % 2}", i, f"id{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "dataset string, pos long, id string, seq string").repartition(3)
    for threshold in (0.6, 0.8, 1.0):
        want = {(a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and 1 - edits(a[3], b[3]) / max(len(a[3]), len(b[3])) >= threshold}
        assert {(r.dataset, r.id_a, r.id_b) for r in joins.near_similar(df, threshold).collect()} == want


def test_aligned_letters_against_brute_force(spark):
    rng = random.Random(2)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b, 1):
                row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
        return row[-1]

    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(30)]
    texts += [t[:5] + "b" + t[6:] for t in texts] + [t[1:] for t in texts[:20]] + [None, ""]
    rows = [(f"d{i % 2}", i, f"id{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "dataset string, pos long, id string, seq string").repartition(3)
    for threshold in (0.55, 0.85, 1.0):
        want = {(a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] and b[3] and common(a[3], b[3]) / max(len(a[3]), len(b[3])) >= threshold}
        assert {(r.dataset, r.id_a, r.id_b) for r in joins.near_similar(df, threshold, score="alignment").collect()} == want


def test_near_similar_on_strands(spark):
    """5,000 sequences of 300 letters of four: candidates are few, and planted copies are found."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("ACGT", k=300)) for _ in range(4800)]
    for t in texts[:200]:
        copy = list(t)
        for _ in range(20):
            i = rng.randrange(len(copy))
            copy[i : i + 1] = rng.choice(["", "A", "CG"])
        texts.append("".join(copy))
    df = spark.createDataFrame([("d", i, str(i), t) for i, t in enumerate(texts)], "dataset string, pos long, id string, seq string").repartition(4)
    found = {(int(r.id_a), int(r.id_b)) for r in joins.near_similar(df, 0.9).collect()}
    assert found >= {(i, 4800 + i) for i in range(200)} and len(found) == 200
    ids = df.select("dataset", F.col("pos").alias("id"), "seq", F.length("seq").alias("n"))
    assert joins.near_candidates(ids, 0.9).count() < 5000 * 20


def test_near_similar_rows_of_a_text_meet_by_lots(spark, monkeypatch):
    """Many copies, rows of one place, null places and null data sets; similarities may come rounded."""
    monkeypatch.setattr(joins, "LOT_ROWS", 3)
    rows = [("d" if i % 9 else None, None if i % 11 == 0 else i // 2, f"id{i}", ("abcdefg", "abcdefx", "zzz")[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "dataset string, pos long, id string, seq string").repartition(3)
    want = sorted((a[2], b[2], 1.0 if a[3] == b[3] else 0.86) for a in rows for b in rows if a[0] and a[0] == b[0] and None not in (a[1], b[1]) and a[1] < b[1] and (a[3] == b[3] or "zzz" not in (a[3], b[3])))
    assert sorted((r.id_a, r.id_b, r.similarity) for r in joins.near_similar(df, 0.8, digits=2).collect()) == want


def test_pairs_of_too_many_edits_are_not_aligned(spark, monkeypatch):
    def refused(a, b):
        raise RuntimeError("aligned")

    monkeypatch.setattr(joins, "aligned_letters", F.pandas_udf(refused, "int"))
    df = spark.createDataFrame([("d", 1, "a", "ACGTTGCAA" + "C" * 55), ("d", 2, "b", "ACGTTGCAA" + "G" * 55)], "dataset string, pos long, id string, seq string")
    ids = df.select("dataset", F.col("pos").alias("id"), "seq", F.length("seq").alias("n"))
    assert joins.near_candidates(ids, 0.95, "alignment").count() == 1
    assert joins.near_similar(df, 0.95, score="alignment").count() == 0


def test_chunks(spark):
    rows = [(d, i * 7 % 101, str(i)) for d, n in (("a", 90), ("b", 1), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, pos long, id string").repartition(5)
    got = {(r.dataset, r.pos): r.chunk for r in cleaning.chunks(df, 10, ranges=8).collect()}
    for d in ("a", "b", None):
        own = sorted(p for x, p, _ in rows if x == d)
        assert [got[d, p] for p in own] == [i // 10 + 1 for i in range(len(own))]
    assert cleaning.chunks(df.limit(0)).count() == 0


def test_stats(spark):
    out = {r.dataset: r for r in stats.align_strategy(stats.sequence_stats(seqs(spark))).collect()}
    assert out["d"].n == 4 and out["d"].avg_length == 4.0 and out["d"].mafft_strategy == "localpair" and not out["d"].clustalo_subsample


def test_near_similar_makes_few_pairs_at_once(spark, monkeypatch):
    """Spark held all pairs that two lots of 2,048 rows make, half a gigabyte a task, before it passed them on; and lists are not broadcast."""
    lists = []
    kept = joins.cut

    def cut(df):
        out = kept(df)
        if "rows" in out.columns:
            lists.append(out)
        return out

    monkeypatch.setattr(joins, "cut", cut)
    df = spark.createDataFrame([("d", i, str(i), "same") for i in range(2000)], "dataset string, pos long, id string, seq string")
    out = joins.near_similar(df, 0.8)
    assert out.count() == 2000 * 1999 // 2
    sizes = [r.n for r in lists[0].selectExpr("size(rows) as n").collect()]
    assert sum(sizes) == 2000 and max(sizes) ** 2 <= 65_536
    assert all("rows" not in line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in line or "BroadcastHashJoin" in line)
