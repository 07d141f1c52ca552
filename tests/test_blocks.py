import io
import os

import pytest
from pyspark.sql import functions as F

from canopy.sources import blocks, fasta, genbank, named

TEXT = b">a one\nACGT\nAC\n>b|x > two\nGG\n>c\n\n>\nskipped\n>last\nAAAA"
RECORDS = "LOCUS       {0}    3 bp    DNA     linear   VRL 01-JAN-2000\nVERSION     {0}.1\nFEATURES             Location/Qualifiers\n     source          1..3\n                     /host=\"a // b\"\nORIGIN\n        1 acg\n//\n"


@pytest.mark.parametrize("mark", [b"\n>", b"\n//"])
def test_each_record_once_in_blocks_of_any_size(mark):
    text = TEXT if mark == b"\n>" else b"one\n//\n//\ntwo // not\n //no\n//\nthree"
    whole = list(blocks.records(io.BytesIO(text), 0, len(text), mark))
    assert b"\n".join(r for _, r in whole) == text and len(whole) > 3
    for size in range(1, len(text) + 2):
        for chunk in (1, 2, 7, 1000):
            got = [r for a in range(0, len(text), size) for r in blocks.records(io.BytesIO(text), a, min(len(text), a + size), mark, chunk)]
            assert got == whole, (size, chunk)
    assert list(blocks.records(io.BytesIO(b""), 0, 0, mark)) == [(0, b"")]


def test_fasta_as_lines_read_it(spark, tmp_path):
    (tmp_path / "one.fasta").write_bytes(TEXT)
    (tmp_path / "two.fa").write_bytes(b">z\r\nAC GT\r\nTT\r\n")
    (tmp_path / "no.dnd").write_bytes(b">x\nA\n")
    (tmp_path / "_hidden").write_bytes(b">x\nA\n")
    (tmp_path / "empty.fasta").write_bytes(b"")
    want = {tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "[ot]*")).select("dataset", "id", "description", "seq").collect()}
    got = blocks.read_blocks(spark, f"file:{tmp_path}", block_bytes=9)
    assert {tuple(r) for r in got.select("dataset", "id", "description", "seq").collect()} == want
    places = [r.pos for r in got.filter("dataset = 'one'").orderBy("pos").collect()]
    assert places == [TEXT.index(b">" + x) for x in (b"a", b"b", b"c", b"last")]
    assert [r.id for r in blocks.read_blocks(spark, str(tmp_path / "two.fa")).collect()] == ["z"]


def test_filters_leave_files_closed(spark, tmp_path):
    for name in "abcd":
        (tmp_path / f"{name}.fasta").write_text(f">{name}1\nAC\n>{name}2\nGG\n")
    rows = blocks.read_blocks(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4
    few = rows.filter("dataset in ('a', 'c') and dataset = 'c' and seq = 'GG'")
    assert few.rdd.getNumPartitions() == 1 and [r.id for r in few.collect()] == ["c2"]
    assert rows.filter("dataset = 'none'").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        blocks.read_blocks(spark, str(tmp_path / "nowhere")).count()


def test_genbank_as_texts_read_it(spark, tmp_path):
    (tmp_path / "x.gb").write_text("".join(RECORDS.format(f"R{i}") for i in range(9)))
    want = sorted(genbank.read_genbank(spark, str(tmp_path)).collect())
    assert len(want) == 9
    for size in (50, 333, 1 << 20):
        assert sorted(blocks.read_blocks(spark, str(tmp_path), "genbank", size).collect()) == want


def test_small_blocks_share_tasks(spark, tmp_path):
    """Each record once where a task has many small blocks, of one file and of many."""
    text = "".join(f">r{i} x\n{'ACGT' * (i % 50)}\n" for i in range(20_000))
    (tmp_path / "one.fasta").write_text(text)
    for i in range(300):
        (tmp_path / f"s{i}.fasta").write_text(f">s{i}\nAC\n>t{i}\nGG\n")
    rows = blocks.read_blocks(spark, str(tmp_path), block_bytes=500)
    assert rows.rdd.getNumPartitions() < 10  # before: one for each of over 4,000 blocks
    got = rows.select("id", F.length("seq").alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted([(f"r{i}", 4 * (i % 50)) for i in range(20_000)] + [(f"{k}{i}", 2) for i in range(300) for k in "st"])


def test_chunks_are_written_whole_and_read_by_their_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(d, i, f"{d}{i}", "", "ACGT") for d in ("a/b", "c") for i in range(25)], "dataset string, pos long, id string, description string, seq string")
    for _ in range(2):
        fasta.write_chunks(rows.withColumn("description", F.col("id")), path, 10)
        assert files(path) == {f"dataset={d}/chunk={c}/part-0.txt" for d in ("a%2Fb", "c") for c in (1, 2, 3)}
    got = blocks.read_blocks(spark, path, "chunks")
    assert {tuple(r) for r in got.select("dataset", "chunk", "id").collect()} == {(d, i // 10 + 1, f"{d}{i}") for d in ("a/b", "c") for i in range(25)}


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names}


def test_named_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("b/1", 2, "second"), ("b/1", 1, "first"), ("a", 1, "é"), (None, 1, "none"), ("q", 1, None)], "name string, at int, value string")
    named.write_named(rows, path, "name", ("at",))
    got = {(r.name, r.value) for r in spark.read.text(path).collect()}
    assert got == {("b/1", "first"), ("b/1", "second"), ("a", "é"), (None, "none")}
    assert files(path) == {f"name={n}/part-0.txt" for n in ("b%2F1", "a", "q", "__HIVE_DEFAULT_PARTITION__")}
    assert (tmp_path / "out" / "name=b%2F1" / "part-0.txt").read_text() == "first\nsecond\n"
    # again: kept, replaced, and the folder emptied first
    other = spark.createDataFrame([("a", 1, "new"), ("c", 1, "c")], "name string, at int, value string")
    named.write_named(other, path, "name", keep=True)
    assert (tmp_path / "out" / "name=a" / "part-0.txt").read_text() == "é\n" and len(files(path)) == 5
    named.write_named(other, path, "name")
    assert (tmp_path / "out" / "name=a" / "part-0.txt").read_text() == "new\n" and len(files(path)) == 5
    named.write_named(other, path, "name", overwrite=True)
    assert files(path) == {"name=a/part-0.txt", "name=c/part-0.txt"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(0, 200, 1, 4).select("id", F.concat(F.lit("t"), "id").alias("name"), F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise("x").alias("value"))
    spark.dataSource.register(named.NamedFiles)
    writer = rows.select("name", "value").write.format("named_files").mode("append").option("path", path).option("column", "name")
    with pytest.raises(Exception, match="lost"):
        writer.save()
    assert files(path) == set() and (not os.path.exists(path) or not os.listdir(path))
    named.write_named(rows.filter("id <> 150"), path, "name")
    assert len(files(path)) == 199
    # names in several tasks, or not side by side, are refused as a whole
    twice = spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "3")], "name string, value string")
    for parts in (1, 3):
        with pytest.raises(Exception, match="lines of"):
            twice.repartition(parts).write.format("named_files").mode("append").option("path", path).option("column", "name").save()
    assert len(files(path)) == 199
