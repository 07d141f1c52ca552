import random
import re

import corpus_pipeline as pipeline
from canopy.llm import scratch, simhash, suffix_dedup

from .conftest import ROWS
from .test_suffix import passages_cut
from .test_text_rules import fails
from .test_tokens import check_pieces


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "simhash", "suffix_dedup", "packing"] and pipeline.ORACLE_SQL is None


def alike(texts, words=5, similarity=0.8):
    """A number for each text: that of its group, by the five-word shingles of every pair."""
    parts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(p[i : i + words]) for i in range(max(len(p) - words + 1, 1))} if p else set() for p in parts]
    group = list(range(len(texts)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if parts[i] == parts[j] or (a and b and len(a & b) >= similarity * len(a | b)):
                group = [group[i] if g == group[j] else g for g in group]
    return group


def test_run_against_brute_force(spark, docs, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r for r in ROWS if not fails(r[1])]
    first = {}
    for r, c in zip(rows, alike([r[1] for r in rows])):
        if c not in first or (r[0] is not None and (first[c][0] is None or r[0] < first[c][0])):
            first[c] = r
    rows = list(first.values())
    assert len(rows) > 10
    tok = Tokenizer.from_str(pipeline.tokenizer_file(pipeline.TOKENIZER))
    want = [(doc_id, np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")) for doc_id, _, text in passages_cut(rows, pipeline.PASSAGE_WORDS)]
    got = [tuple(r) for r in pipeline.run(spark, str(tmp_path)).collect()]
    check_pieces(got, want, 4096)


def test_stages_on_nothing(spark, none):
    docs = none
    for name, stage in pipeline.STAGES:
        docs = scratch.saved(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_stages_keep_columns(spark, docs):
    for _, stage in pipeline.STAGES[:3]:
        assert stage(spark, docs, "").columns == docs.columns
    assert suffix_dedup.LEAST == 400


def test_passages_below_400_bytes_go(spark):
    rng = random.Random(8)
    prose = lambda n: ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 6))) for _ in range(n)]
    passage, shorter, own = prose(51), prose(50), [prose(40) for _ in range(8)]
    assert len(" ".join(passage)) < 400 and len(" ".join(shorter)) < 400
    texts = [(own[0], passage, own[1]), (own[2], passage, []), (own[3], shorter, own[4]), (own[5], shorter, own[6])]
    rows = [(i, " ".join([*a, *b, *c])) for i, (a, b, c) in enumerate(texts)] + [(4, " ".join(own[7]) + "\n" + "\n".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in pipeline.repeated_strings(spark, docs, "").collect()}
    want = {0: [*own[0], *own[1]], 1: own[2], 2: rows[2][1].split(), 3: rows[3][1].split(), 4: own[7]}
    assert {k: v.split() for k, v in got.items()} == want


def test_near_copies_at_0_8_go(spark):
    rng = random.Random(9)
    prose = lambda n: ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    likeness = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    texts = []
    for changed in (1, 2, 3, 4, 4, 5, 7, 9):
        base = prose(184)  # 180 shingles; each changed word alters five
        copy = list(base)
        for k in range(changed):
            copy[10 + 15 * k] = "Z"
        texts += [base, copy]
    head = prose(244)  # a chain: each links to the next, not to all
    for k in range(4):
        head = [*head[:60 * k + 5], "Y", "Y", *head[60 * k + 7 :]]
        texts.append(head)
    tail = prose(404)  # 400 shingles, of which 320 and 319 are in the second text
    texts += [tail, tail[:324], prose(10) * 2, tail[85:404]]
    parent = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if likeness(texts[i], texts[j]) >= 0.8:
                parent = [parent[i] if p == parent[j] else p for p in parent]
    assert any(0.8 <= likeness(texts[i], texts[i + 1]) < 0.81 for i in range(len(texts) - 1))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted({min(i for i, p in enumerate(parent) if p == q) for q in parent})


def test_unlike_texts_of_near_fingerprints_stay(spark):
    # a common half and other words: no link without a true similarity of 0.8
    common = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*common, *(f"v{k}x{i}" for i in range(60))])) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert pipeline.near_duplicates(spark, docs, "").count() == 6


def test_prefixes_lose_no_pair(spark):
    """Texts that one bucket leaves in different groups are found by their prefixes: groups of near copies, passages that many hold, parts of texts."""
    rng = random.Random(12)
    rows, sets = [], []
    passage = [rng.getrandbits(40) for _ in range(60)]
    for g in range(8):
        base = [rng.getrandbits(40) for _ in range(rng.randint(5, 120))]
        for _ in range(14):
            kept = [x for x in base if rng.random() > rng.choice([0, 0.05, 0.1, 0.3])] or base[:1]
            own = {*kept, *(rng.getrandbits(40) for _ in range(rng.choice([0, 0, 3, 12]))), *(passage if rng.random() < 0.3 else [])}
            sets.append(own)
    rows = [(i, i, sorted(s)) for i, s in enumerate(sets)]
    pairs = simhash.prefix_pairs(spark.createDataFrame(rows, "fp long, root long, s array<long>").repartition(3), 0.8).collect()
    got = {frozenset((r.u, r.v)) for r in pairs}
    want = {frozenset((i, j)) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 50 and want <= got and len(got) < 3 * len(want)
