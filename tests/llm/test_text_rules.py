import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canopy.llm import license_scan, quality, sentence_spans, simhash

from .conftest import ROWS


def measured(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    letters = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in t)
    bullets = sum(bool(re.match(r"[\x20\x09-\x0d]*[-*+•‣][\x20\x09-\x0d]", x)) for x in lines)
    ellipses = sum(x.rstrip("\x20\x09\x0a\x0b\x0c\x0d").endswith(("...", "…")) for x in lines)
    return len(words), sum(map(len, words)), len(lines), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), letters, bullets, ellipses


def test_measurements(docs, none):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_lines, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_letters, r.n_bullet_lines, r.n_ellipsis_lines) for r in quality.evaluate(docs).collect()]
    assert Counter(got) == Counter((r[0], *measured(r[1])) for r in ROWS)
    assert quality.evaluate(none).count() == 0


def test_policies_and_ablations(docs):
    ledger = quality.evaluate(docs).cache()
    rows = quality.apply_policy(ledger, "full-1").collect()
    mask = quality.POLICIES["full-1"]
    assert all(r.kept == (r.fail_bits & mask == 0) for r in rows)
    for r in quality.ablations(ledger, "full-1").collect():
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r.rule)
        assert r.n_failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.n_failed_alone == sum(x.fail_bits & mask == bit for x in rows)
        assert r.n_kept_without == sum(x.fail_bits & mask & ~bit == 0 for x in rows)


def test_marks_of_lists(spark):
    text = "- one two three\n* four five six\n • seven eight\n+ nine ten\n" + "plain words end here...\nand here… \n12 34 56 78\n"
    r = quality.evaluate(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_bullet_lines, r.n_ellipsis_lines, r.n_lines) == measured(text)[7:] + (7,) == (4, 2, 7) and r.n_letters == measured(text)[6]
    rows = [(1, "- a list of words\n" * 2 + "- another list of words\n" + "- and one more list of words\n"), (2, "1234 5678 9012 " * 3 + "a b c d e"), (3, "it goes on\nand goes on...\nand on and on...\nto the end of it")]
    got = {r.doc_id: r.fail_bits >> 6 for r in quality.evaluate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 2, 2: 1, 3: 4}


def test_filter_keeps_columns(docs, none):
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    want = [r[0] for r in ROWS if not fails(r[1])]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)
    assert quality.filter_documents(none).columns == none.columns


def fails(text):
    words, chars, lines, symbols, dup, repeat, letters, bullets, ellipses = measured(text)
    first = words < 10 or 100 * repeat > 20 * words or 10 * symbols > 3 * words or (lines >= 4 and 10 * dup > 4 * lines) or chars < 2 * words or chars > 20 * words
    return first or 2 * letters < chars or (lines >= 4 and (10 * bullets > 9 * lines or 10 * ellipses > 3 * lines))


def test_license_base(docs, none):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(docs).collect())
    want = Counter()
    for r in ROWS:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for t in license_scan.BASE:
            p = t.words.split()
            own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += own
            labels |= {t.label} if own else set()
        want[(r[0], len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))] += 1
    assert got == want
    assert license_scan.scan(none).count() == 0


def test_license_notices(spark):
    mit = next(t.words for t in license_scan.NOTICES if t.label == "mit")
    words = mit.split()
    rows = [
        (0, mit.upper()), (1, " ".join([*words[:12], "very", *words[12:]])), (2, " ".join(words[:6])), (3, "licensed under the GNU General Public License, version 3"),
        (4, "mit license"), (5, "x " * 500 + mit + " y" * 500), (6, " ".join(words[::-1])),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == ("mit", 1.0) and got[1][0] == "mit" and 0.8 <= got[1][1] < 1 and got[5][0] == "mit"
    assert got[2] == ("", 0.0) and got[4] == ("", 0.0) and got[6] == ("", 0.0) and got[3] == ("gpl,gpl-3", 1.0)
    assert all(0 <= s <= 1 for _, s in got.values())


def test_whole_license_texts(spark):
    rows = []
    for i, t in enumerate(license_scan.TEXTS):
        words = t.words.split()
        assert len(words) > 100
        # the body alone, without its opening, and with a word in twenty changed
        rows += [(10 * i, " ".join(words[len(words) // 8 :])), (10 * i + 1, "x y " + " ".join("other" if j % 25 == 24 else w for j, w in enumerate(words)) + " z"), (10 * i + 2, " ".join(words[: len(words) // 3][::-1]))]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(license_scan.TEXTS):
        assert got[10 * i] == got[10 * i + 1] == t.label and got[10 * i + 2] == ""


def test_template_lengths():
    with pytest.raises(ValueError):
        license_scan.template_grams(None, [license_scan.Template("x", "too short")])


def cut(text):
    broken = re.sub(r"([.!?])[\x20\x09-\x0D]+", "\\1\n", text or "")
    return [s for s in (re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x) for x in broken.split("\n")) if s]


def runs_of(sentences, least=sentence_spans.MIN_WORDS):
    """The hashed runs: from each sentence two or more until they have the words, and the last ones that have them."""
    n = [len(re.split(r"[\x20\x09-\x0D]+", x)) for x in sentences]
    out = set()
    for a in range(len(n) - 1):
        b = a + 2
        while b < len(n) and sum(n[a:b]) < least:
            b += 1
        if sum(n[a:b]) >= least:
            out.add((a, b))
    last = next((a for a in range(len(n) - 2, -1, -1) if sum(n[a:]) >= least), None)
    return out if last is None else out | {(last, len(n))}


def test_short_sentences_stand_in_runs(spark):
    verse = "Go on.\nCome in.\nSo it is.\nNo more.\nThen rest."  # no two of them have ten words
    texts = [verse, "Something else was said before all that was heard.\n" + verse, "Go on.\nCome in.", "Go on.\nCome in.", "Never.\n" + verse + "\nAt all."]
    assert {i for a, b in runs_of(verse.split("\n")) for i in range(a, b)} == set(range(5))
    got = {r.doc_id: r.text for r in sentence_spans.remove_repeated_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: verse, 1: "Something else was said before all that was heard.", 2: texts[2], 3: texts[3], 4: "Never.\nAt all."}


def test_sentence_spans(docs, none):
    unique = docs.dropDuplicates(["doc_id", "text"]).filter("doc_id is not null and text <> 'another text of the same id'")
    rows = sorted((r.doc_id, cut(r.text)) for r in unique.select("doc_id", "text").collect())
    seen, want = set(), {}
    for doc_id, s in rows:
        gone, own = set(), sorted(runs_of(s))
        first = {tuple(s[a:b]): a for a, b in reversed(own)}  # within a text, later places come after earlier ones
        for a, b in own:
            if tuple(s[a:b]) in seen or first[tuple(s[a:b])] < a:
                gone |= set(range(a, b))
        seen |= first.keys()
        want[doc_id] = (len(s), len(gone), "\n".join(x for i, x in enumerate(s) if i not in gone))
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentence_spans.remove_repeated_sentences(unique).collect()}
    assert got == want and any(n for _, n, _ in got.values())
    assert sentence_spans.remove_repeated_sentences(docs).count() == len(ROWS)
    assert sentence_spans.remove_repeated_sentences(none).count() == 0


def test_repeated_rows_keep_one(spark):
    rows = spark.createDataFrame([(1, "One two three four five six. Seven eight nine ten eleven.")] * 3, "doc_id long, text string")
    assert sorted(r.n_removed for r in sentence_spans.remove_repeated_sentences(rows).collect()) == [0, 2, 2]


def test_plans_are_native(docs):
    for df in (quality.evaluate(docs), license_scan.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)


def test_clashing_keep(docs):
    ledger = quality.evaluate(docs.select("doc_id", "text", F.lit(1).alias("n_lines")), keep=("doc_id", "n_lines", "fail_bits"))
    assert ledger.columns.count("n_lines") == 1


def test_any_name_may_be_kept(docs):
    """Columns named like those that the operators use inside, or like their results, which win."""
    names = ["_t", "_w", "_l", "_h", "_o", "_keep", "_at", "_row", "_text", "pos", "g", "w", "w0", "t_id", "votes", "n_words", "fp", "c0"]
    odd = docs.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    first = odd.filter("doc_id = 3").first()
    for found in (quality.evaluate(odd, keep=("doc_id", *names)), quality.measure(odd, keep=("doc_id", *names)), license_scan.scan(odd, keep=("doc_id", *names)), license_scan.spans(odd, license_scan.NOTICES, keep=("doc_id", *names)), simhash.fingerprints(odd, keep=("doc_id", *names))):
        own = found.filter("doc_id = 3").first().asDict()
        assert len(found.columns) == len(set(found.columns))
        assert all(own[n] == first[n] for n in names if n in own and n not in ("n_words", "fp", "t_id", "votes", "_row"))
    assert quality.evaluate(odd, keep=("doc_id", *names)).filter("doc_id = 3").first()["n_words"] > 20
