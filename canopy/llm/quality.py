"""Quality rules as a bitmask ledger.

``evaluate`` looks at each text once and keeps, per document, the measurements and one long whose bit r says that rule r
failed. Policies are versioned bit masks over that ledger: applying another policy, comparing two, or asking what a rule
alone decides never reads a text again. Everything is built-in DataFrame functions in one pass without a shuffle;
``ablations`` first counts the few distinct bit patterns (map-side combined) and works on those counts.

Defined results: a null or empty text has no words and every measurement 0; repeated rows are judged each on its own;
an empty table gives an empty ledger; other columns of the input are kept only where asked for (``keep``), and a column
named like a ledger column gives way to the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
#: ASCII letters, and all characters beyond ASCII.
LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"
BULLET = r"^[\x20\x09-\x0D]*(?:[-*+]|\x{2022}|\x{2023})[\x20\x09-\x0D]"
ELLIPSIS = r"(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*$"
MEASURES = ("n_words", "word_chars", "n_lines", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_bullet_lines", "n_ellipsis_lines")


@dataclass(frozen=True)
class Rule:
    """A named predicate that is true where a document fails; ``bit`` is its place in the ledger and never reused."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols_per_word", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 and 10 * n_dup_lines > 4 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "few_letters", "2 * n_letters < word_chars"),
    Rule(7, "bullet_lines", "n_lines >= 4 and 10 * n_bullet_lines > 9 * n_lines"),
    Rule(8, "ellipsis_lines", "n_lines >= 4 and 10 * n_ellipsis_lines > 3 * n_lines"),
)
BASE = 0b000011
POLICIES = {"base-1": BASE, "full-1": 0b111111, "full-2": 0b111111111}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeat_words(hashes: Column, ordered: Column) -> Column:
    """Words covered by windows that occur twice or more, from the (hash, start) pairs in order.

    A window of equal hash stands next to it in that order. With the starts ascending, each one adds the words up to the
    next start, WINDOW of them at most.
    """
    repeated = F.filter(
        ordered,
        lambda x, j: (x["h"] == F.get(ordered, j - F.lit(1))["h"]) | (x["h"] == F.get(ordered, j + F.lit(1))["h"]),
    )
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


#: Keeps the struct of kept columns from being empty.
_NONE = "__none"


def _measured(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """_keep (a struct of keep), _at and the MEASURES (long) of every row.

    _at numbers the rows. A filter that looks at it stays above the measurements, which otherwise it would hold many times over.
    """
    kept = [c for c in keep if c not in MEASURES]
    t = F.coalesce(F.col(text), F.lit(""))
    # as one column, what is kept clashes with no name used here
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("string").alias(_NONE)).alias("_keep"), t.alias("_t"), words_of(t).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("_l"))
    hashed = base.withColumn(
        "_h",
        F.when(
            F.size("_w") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - F.lit(WINDOW)),
                lambda i: F.xxhash64(*[F.get(F.col("_w"), i + F.lit(k)) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # only rows with a repeated hash are sorted at all
    paired = hashed.withColumn(
        "_o",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    n = F.size("_w").cast("long")
    return paired.select(
        "_keep",
        F.monotonically_increasing_id().alias("_at"),
        n.alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_o").isNull(), F.lit(0)).otherwise(_repeat_words(F.col("_h"), F.col("_o"))).cast("long").alias("n_repeat_words"),
        F.regexp_count("_t", F.lit(LETTER)).cast("long").alias("n_letters"),
        F.size(F.filter("_l", lambda x: x.rlike(BULLET))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(ELLIPSIS))).cast("long").alias("n_ellipsis_lines"),
    )


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the MEASURES (long) of every row."""
    return _measured(docs, text, keep).select("_keep.*", *MEASURES).drop(_NONE)


def evaluate(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger: keep, the MEASURES and fail_bits (long)."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    rows = _measured(docs, text, tuple(c for c in keep if c != "fail_bits")).withColumn("fail_bits", F.when(F.col("_at") >= 0, bits))
    return rows.select("_keep.*", *MEASURES, "fail_bits").drop(_NONE)


def passes(policy: str) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with the policy's name and its verdict."""
    return ledger.withColumns({"policy": F.lit(policy), "kept": passes(policy)})


def ablations(ledger: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy would keep without it."""
    mask = POLICIES[policy]
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    inside = [r for r in rules if mask >> r.bit & 1]
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in inside]))
    each = patterns.select("bits", "n", rows.alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    zero = F.lit(0).cast("long")
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(zero)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(zero)).alias("n_kept_without"),
    )


def filter_documents(docs: DataFrame, policy: str = "full-2") -> DataFrame:
    """The documents that pass the policy, with the columns that they came with."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    return evaluate(row, "_text", ("_row",)).filter(passes(policy)).select("_row.*")
