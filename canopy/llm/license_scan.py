"""License scans by diagonal voting.

Templates are word sequences with a label. All their rolling word k-grams, hashed, form one small table with the place of
each k-gram in its template. Every rolling k-gram of every text is hashed and joined to that table (the table's size
depends on the templates alone; it is broadcast only below a fixed size). A match at text word p and template word q votes for
diagonal p - q of its document and template. Votes are summed by diagonal, diagonals within ``slack`` are merged
(words inserted or missing move a match to a neighbouring diagonal), and a merged span is accepted by the share of the
template's k-grams that it holds. Matches compare the words themselves, so that no hash collision counts.

A *base* template counts only where all of its k-grams stand on one diagonal, that is where its words stand consecutively.

Only DataFrame functions; one scan. Texts never move: only matches and one row per document are shuffled, once, by row.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned each on its own; an
empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.scratch import values

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
SLACK = 3
BROADCAST_GRAMS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """words: lower-case, space-separated, K words at least; coverage: share that accepts."""

    label: str
    words: str
    base: bool = False
    coverage: float = 0.8


#: Fixed values of the contract.
BASE = (
    Template("mit", "under the mit license", base=True, coverage=1.0),
    Template("apache-2", "apache license version 2", base=True, coverage=1.0),
    Template("cc-by-nc", "cc by nc", base=True, coverage=1.0),
)
#: Names and notices of public licenses, and opening clauses.
NOTICES = (
    Template("gpl", "under the gnu general public license", coverage=1.0),
    Template("gpl-3", "gnu general public license version 3", coverage=1.0),
    Template("gpl-2", "gnu general public license version 2", coverage=1.0),
    Template("lgpl", "gnu lesser general public license", coverage=1.0),
    Template("agpl", "gnu affero general public license", coverage=1.0),
    Template("mpl-2", "mozilla public license version 2", coverage=1.0),
    Template("cc-by-sa", "cc by sa", coverage=1.0),
    Template("cc-by-nd", "cc by nd", coverage=1.0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


#: Whole texts of public licenses, as their words: fixed values.
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and
this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software
including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages
or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in
connection with the use or performance of this software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form
must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the
implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for
any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use
data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the
use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it
freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if
you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be
plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"""
TEXTS = tuple(Template(label, " ".join(text.split())) for label, text in (("mit", _MIT), ("isc", _ISC), ("bsd", _BSD), ("zlib", _ZLIB)))


def words_of(text: Column) -> Column:
    """A-Z lower-cased, split at every ASCII character that is neither letter nor digit."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def template_grams(spark, templates: Sequence[Template], k: int = K) -> DataFrame:
    """t_id, t_pos, g (the hash), w0.. (the words): one row per template and place."""
    rows = []
    for i, t in enumerate(templates):
        words = t.words.split(" ")
        if len(words) < k:
            raise ValueError(f"a template has {k} words or more: {t.words[:40]}")
        rows += [(i, p, *words[p : p + k]) for p in range(len(words) - k + 1)]
    names = [f"w{j}" for j in range(k)]
    df = values(spark, rows, "t_id int, t_pos int, " + ", ".join(f"{n} string" for n in names))
    df = df.withColumn("g", F.xxhash64(*names))
    return F.broadcast(df) if len(rows) <= BROADCAST_GRAMS else df


#: Columns of spans and of scan; a kept column of such a name gives way.
SPAN = ("n_words", "t_id", "votes", "first", "words", "grams", "exact_at")
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
#: Keeps the struct of kept columns from being empty.
_NONE = "__none"


def spans(docs: DataFrame, templates: Sequence[Template], keep: Sequence[str] = ("doc_id",), text: str = "text", k: int = K, slack: int = SLACK) -> DataFrame:
    """Per row of docs and merged span: _row, keep, n_words, t_id, first (word), words (its length), votes, grams (distinct).

    Every row of docs has at least one row here, with null t_id where it has no match. exact_at lists the words at which
    all of the template stands consecutively.
    """
    return _spans(docs, templates, keep, text, k, slack).select("_row", "_keep.*", *SPAN).drop(_NONE)


def _spans(docs: DataFrame, templates: Sequence[Template], keep: Sequence[str], text: str, k: int, slack: int) -> DataFrame:
    """The spans; as one column, _keep, what is kept clashes with no name used here."""
    sizes = [len(t.words.split(" ")) - k + 1 for t in templates]
    grams = template_grams(docs.sparkSession, templates, k)
    own = [F.col(f"`{c}`") for c in keep if c not in (*SPAN, "_row")]
    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*own, F.lit(None).cast("string").alias(_NONE)).alias("_keep"), words_of(F.col(text)).alias("_w"))
    at = base.select("_row", "_keep", "_w", F.size("_w").cast("long").alias("n_words"), F.posexplode_outer("_w").alias("pos", "w"))
    at = at.withColumn("g", F.xxhash64("w", *[F.get("_w", F.col("pos") + F.lit(j)) for j in range(1, k)]))
    hit = (at["g"] == grams["g"]) & (at["w"] == grams["w0"])
    joined = at.join(grams, hit, "left")
    same = F.lit(True)
    for j in range(1, k):
        same = same & F.coalesce(F.get("_w", F.col("pos") + F.lit(j)) == F.col(f"w{j}"), F.lit(False))
    votes = joined.filter((F.col("t_id").isNotNull() & same) | (F.coalesce("pos", F.lit(0)) == 0)).select(
        "_row", "_keep", "n_words", F.when(same, F.col("t_id")).alias("t_id"), F.when(same, F.col("t_pos")).alias("t_pos"), "pos"
    )
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("t_id") + F.lit(1))
    heads = [F.first(c).alias(c) for c in ("_keep", "n_words")]
    diagonals = (
        votes.withColumn("diagonal", F.col("pos") - F.col("t_pos"))
        .repartition("_row")
        .groupBy("_row", "t_id", "diagonal")
        .agg(
            *heads,
            F.count("t_id").alias("votes"),
            F.collect_list("t_pos").alias("places"),  # a template's places at most
            F.min("pos").alias("low"),
            F.max("pos").alias("high"),
        )
    )
    near = Window.partitionBy("_row", "t_id").orderBy("diagonal")
    merged = diagonals.withColumn("_new", F.when(F.col("diagonal") - F.lag("diagonal").over(near) <= slack, 0).otherwise(1))
    merged = merged.withColumn("_span", F.sum("_new").over(near))
    return merged.groupBy("_row", "t_id", "_span").agg(
        *heads,
        F.sum("votes").alias("votes"),
        F.min("low").alias("first"),
        (F.max("high") - F.min("low") + F.lit(k)).alias("words"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("grams"),
        F.sort_array(F.collect_list(F.when(F.col("votes") == size, F.col("diagonal")))).alias("exact_at"),
    )


def scan(docs: DataFrame, own: Sequence[Template] = (*NOTICES, *TEXTS), keep: Sequence[str] = ("doc_id",), text: str = "text", k: int = K, slack: int = SLACK) -> DataFrame:
    """Per row of docs: keep, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a template's k-grams among accepted spans, 0 without one. A span is accepted where it
    holds its template's coverage within a quarter more words than the template has.
    """
    templates = (*BASE, *own)
    found = _spans(docs, templates, tuple(c for c in keep if c not in RESULT), text, k, slack)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("t_id") + F.lit(1))
    counts = [len(t.words.split(" ")) for t in templates]
    share = F.col("grams") / pick([n - k + 1 for n in counts])
    fits = F.col("words") <= pick([n + max(0 if t.coverage == 1 else slack, n // 4 if t.coverage < 1 else 0) for n, t in zip(counts, templates)])
    is_base = pick([t.base for t in templates])
    ok = F.when(is_base, F.size("exact_at") > 0).otherwise(fits & (share >= pick([t.coverage for t in templates])) | (F.size("exact_at") > 0))
    rows = found.withColumns({"_label": pick([t.label for t in templates]), "_base": is_base, "_ok": F.coalesce(ok, F.lit(False)), "_share": F.least(share, F.lit(1.0))})
    base_ok = F.col("_base") & F.col("_ok")
    listed = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    return rows.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in ("_keep", "n_words")],
        F.coalesce(F.sum(F.when(base_ok, F.size("exact_at"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base_ok, F.array_min("exact_at"))).cast("long").alias("first_word"),
        F.max(F.when(base_ok, F.array_max("exact_at"))).cast("long").alias("last_word"),
        listed(F.when(base_ok, F.col("_label"))).alias("base_labels"),
        listed(F.when(F.col("_ok"), F.col("_label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("_ok"), F.col("_share"))), F.lit(0.0)).alias("score"),
    ).select("_keep.*", *RESULT).drop(_NONE)
