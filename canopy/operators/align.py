"""A native multiple alignment: the centre star over global pairwise alignments.

It stands in for external aligners, whose exact output cannot be had without their binaries; ``external`` runs one where it is installed.
Pairs of a dataset are scored in pairs of blocks, and each sequence is laid against the centre on its own, so that a large dataset spreads.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.cleaning import CLUSTAL_LIMIT, subsample
from canopy.operators.stats import align_strategy, sequence_stats
from canopy.operators.steps import cut

MATCH, MISMATCH, GAP = 1, -1, -2
ALIGNED = "dataset string, id string, seq string"


def _path(a: str, b: str) -> tuple[int, list[tuple[int, int]]]:
    """Score and columns of a best global alignment: the places in a and b, -1 for a gap."""
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    n, m = len(x), len(y)
    table = np.empty((n + 1, m + 1), np.int64)
    table[0] = np.arange(m + 1) * GAP
    steps = np.arange(m + 1) * GAP
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int64)
        best[0] = i * GAP
        best[1:] = np.maximum(table[i - 1, :-1] + np.where(y == x[i - 1], MATCH, MISMATCH), table[i - 1, 1:] + GAP)
        # gaps along the row: a running maximum
        table[i] = np.maximum.accumulate(best - steps) + steps
    i, j, columns = n, m, []
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (MATCH if x[i - 1] == y[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            columns.append((i, j))
        elif i and table[i, j] == table[i - 1, j] + GAP:
            i -= 1
            columns.append((i, -1))
        else:
            j -= 1
            columns.append((-1, j))
    return int(table[n, m]), columns[::-1]


def pairwise(a: str, b: str) -> tuple[int, str, str]:
    """Score and rows of a best global alignment."""
    score, columns = _path(a, b)
    return score, "".join(a[i] if i >= 0 else "-" for i, _ in columns), "".join(b[j] if j >= 0 else "-" for _, j in columns)


def against(centre: str, seq: str) -> tuple[list[str], str]:
    """What an alignment inserts before each letter of the centre and after the last, and what stands at its letters."""
    inserted, own, at = [""] * (len(centre) + 1), [], 0
    for i, j in _path(centre, seq)[1]:
        if i < 0:
            inserted[at] += seq[j]
        else:
            own.append(seq[j] if j >= 0 else "-")
            at = i + 1
    return inserted, "".join(own)


def centre_star(ids: list[str], seqs: list[str]) -> list[tuple[str, str]]:
    """Rows of equal length: every sequence aligned to the one that scores best with all others; one after the other, for a few sequences."""
    if len(seqs) < 2:
        return list(zip(ids, seqs))
    score = np.zeros((len(seqs), len(seqs)))
    for i in range(len(seqs)):
        for j in range(i):
            score[i, j] = score[j, i] = pairwise(seqs[i], seqs[j])[0]
    centre = int(score.sum(axis=1).argmax())
    star, rows = seqs[centre], {centre: seqs[centre]}
    for i, seq in enumerate(seqs):
        if i == centre:
            continue
        _, a, b = pairwise(seqs[centre], seq)
        # merge the gaps of this pair's centre row with those of the rows so far
        merged, old, new = [], [], []
        p = q = 0
        while p < len(star) or q < len(a):
            if p < len(star) and star[p] == "-" and not (q < len(a) and a[q] == "-"):
                merged.append("-"), old.append(p), new.append("-")
                p += 1
            elif q < len(a) and a[q] == "-" and not (p < len(star) and star[p] == "-"):
                merged.append("-"), old.append(None), new.append(b[q])
                q += 1
            else:
                merged.append(star[p]), old.append(p), new.append(b[q])
                p, q = p + 1, q + 1
        rows = {k: "".join("-" if o is None else r[o] for o in old) for k, r in rows.items()}
        rows[i] = "".join(new)
        star = "".join(merged)
    return [(ids[i], rows[i]) for i in range(len(seqs))]


#: Sequences of a block; the pairs of two blocks are scored in one task.
BLOCK_ROWS = 32


def _pair_scores(rows: DataFrame) -> DataFrame:
    """dataset, row and score: the sum of each row's alignment scores with all others of its dataset, by pairs of blocks."""
    blocks = rows.groupBy(F.col("dataset").alias("_set")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_n"))
    own = rows.join(blocks, F.col("dataset").eqNullSafe(F.col("_set"))).withColumn("_own", F.pmod(F.xxhash64("row"), F.col("_n")).cast("int"))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    own = own.select("dataset", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") <= F.col("_other")).alias("_first"), "row", "seq")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        inside = part["_i"].iloc[0] == part["_j"].iloc[0]
        first = list(zip(part["row"][part["_first"]], part["seq"][part["_first"]]))
        second = first if inside else list(zip(part["row"][~part["_first"]], part["seq"][~part["_first"]]))
        sums = dict.fromkeys(part["row"], 0)
        for k, (a, x) in enumerate(first):
            for c, y in second[:k] if inside else second:
                score = _path(x, y)[0]
                sums[a] += score
                sums[c] += score
        return pd.DataFrame([(part["dataset"].iloc[0], r, s) for r, s in sums.items()], columns=["dataset", "row", "score"])

    return own.groupBy("dataset", "_i", "_j").applyInPandas(run, "dataset string, row long, score long").groupBy("dataset", "row").agg(F.sum("score").alias("score"))


def align(seqs: DataFrame) -> DataFrame:
    """dataset, id and aligned seq; rows of a dataset are equally long. A null sequence is an empty one, all gaps.

    The centre, the sequence that scores best with all others (the first of equals by pos), is found by pairs of blocks, each sequence is aligned to it on its own, and
    the most letters that any inserts before a letter of the centre are the gaps that all have there. So the alignment is that of ``centre_star``.
    """
    rows = cut(seqs.select("dataset", "pos", "id", F.coalesce("seq", F.lit("")).alias("seq"), F.monotonically_increasing_id().alias("row")))
    scored = rows.join(_pair_scores(rows.select("dataset", "row", "seq")).select("row", "score"), "row")
    centre = scored.groupBy(F.col("dataset").alias("_set")).agg(F.max_by("seq", F.struct("score", -F.col("pos"), -F.col("row"))).alias("centre"), F.max_by("row", F.struct("score", -F.col("pos"), -F.col("row"))).alias("_row"))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = [against(c, c if r == at else s) for c, s, r, at in zip(part["centre"], part["seq"], part["row"], part["_row"])]
            yield part[["dataset", "id"]].assign(inserted=[m[0] for m in made], own=[m[1] for m in made])

    laid = cut(rows.join(centre, F.col("dataset").eqNullSafe(F.col("_set"))).drop("_set").mapInPandas(lay, "dataset string, id string, inserted array<string>, own string"))
    gaps = laid.select("dataset", F.posexplode("inserted").alias("at", "t")).filter("t <> ''").groupBy("dataset", "at").agg(F.max(F.length("t")).alias("n"))
    # no more rows than the centre has letters
    wide = gaps.groupBy(F.col("dataset").alias("_set")).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("gaps"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = []
            for inserted, own, gaps in zip(part["inserted"], part["own"], part["gaps"]):
                gaps = dict(gaps) if gaps is not None else {}
                made.append("".join(t.ljust(gaps.get(i, 0), "-") + own[i : i + 1] for i, t in enumerate(inserted)))
            yield part[["dataset", "id"]].assign(seq=made)

    return laid.join(wide, F.col("dataset").eqNullSafe(F.col("_set")), "left").drop("_set").mapInPandas(spread, ALIGNED)


COMMANDS = {
    "clustalo": ["clustalo", "-i", "-", "--outfmt=fasta"],
    "localpair": ["mafft", "--localpair", "--maxiterate", "1000", "-"],
    "auto": ["mafft", "--auto", "-"],
    "parttree": ["mafft", "--parttree", "--retree", "1", "--partsize", "1000", "-"],
}


#: What a run of clustalo gets for a data set of very many sequences, and the size from which it does (fixed values).
ONE_ITERATION = ("--max-guidetree-iterations", "1", "--max-hmm-iterations", "1")


def prepared(seqs: DataFrame, max_sequences: int = 500, max_memory_gb: float = 4.0, force_subsample: bool = False, seed: int = 0) -> DataFrame:
    """seqs as clustalo takes them, with flags (array of arguments): data sets of more than max_sequences sequences, or of more estimated memory, are
    subsampled to max_sequences; those that had more than 5,000 sequences get one iteration."""
    known = align_strategy(sequence_stats(seqs), max_sequences, max_memory_gb).select(F.col("dataset").alias("_set"), (F.lit(force_subsample) | F.col("clustalo_subsample")).alias("_cut"), F.col("clustalo_one_iteration").alias("_one"))
    own = F.col("dataset").eqNullSafe(F.col("_set"))
    cut_sets = known.filter("_cut").select("_set")
    chosen = subsample(seqs.join(cut_sets, own, "left_semi"), max_sequences, seed).unionByName(seqs.join(cut_sets, own, "left_anti"))
    flags = F.when(F.col("_one"), F.array(*map(F.lit, ONE_ITERATION))).otherwise(F.array().cast("array<string>"))
    return chosen.join(known, own).select(*seqs.columns, flags.alias("flags"))


def external(seqs: DataFrame, strategy: str, timeout: int = 3600, threads: int = 1) -> DataFrame:
    """Alignment by an installed program, with the flags of each data set (``prepared``) if there are any; raises in the task where it is missing."""
    command = [*COMMANDS[strategy], *(["--threads", str(threads)] if strategy == "clustalo" else ["--thread", str(threads)])]
    command = command if strategy == "clustalo" else [command[0], *command[-2:], *command[1:-2]]
    columns = [c for c in ("dataset", "id", "seq", "flags") if c in seqs.columns]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if not shutil.which(command[0]):
            raise RuntimeError(f"{command[0]} is not installed on this worker")
        own = [*command, *(rows["flags"].iloc[0] if "flags" in columns else ())]
        text = "".join(f">{i}\n{s}\n" for i, s in zip(rows["id"], rows["seq"]))
        made = subprocess.run(own, input=text, capture_output=True, text=True, timeout=timeout, check=True).stdout
        parts = [r.partition("\n") for r in made.split(">")[1:]]
        return pd.DataFrame([(rows["dataset"].iloc[0], h.split()[0], b.replace("\n", "")) for h, _, b in parts], columns=["dataset", "id", "seq"])

    return seqs.select(*columns).groupBy("dataset").applyInPandas(run, ALIGNED)


def remembered(seqs: DataFrame, done: DataFrame, chain: Sequence[Callable[[DataFrame], DataFrame]] = (), limit: int = CLUSTAL_LIMIT) -> DataFrame:
    """Alignments of seqs: those that are done (dataset, id, seq) as they are, the others anew.

    chain has two aligners: datasets whose longest sequence is within limit go to the first, others to the second; without it, all go to
    the centre star.
    """
    first, second = chain or (align, align)
    wanted = seqs.select("dataset").distinct()
    todo = seqs.join(done.select("dataset").distinct(), "dataset", "left_anti")
    over = todo.groupBy("dataset").agg(F.max(F.length("seq")).alias("_longest"))
    short, long = (todo.join(over.filter(c).select("dataset"), "dataset", "left_semi") for c in (F.coalesce("_longest", F.lit(0)) <= limit, F.col("_longest") > limit))
    kept = done.join(wanted, "dataset", "left_semi").select("dataset", "id", "seq")
    return kept.unionByName(first(short)).unionByName(second(long))
