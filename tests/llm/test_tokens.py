import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from canopy.llm import bitplane, bpe, lexicon, packing, token_stream
from canopy.llm.queries import tokenizer_file

from .conftest import ROWS

PIECES = [" ", "  ", "\n", "\t", " \n", "\n ", "a", "the", "Word", "'s", "'re", "é", "ß", "12", "３", ".", "!?", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "中文", "K", "İ", "ΑΣ", "e\u0301", "\u200b", "😀", "<|", "|>", "\r\n", "ſ", "ﬁ"]


def fuzz(n=3000):
    rng = random.Random(3)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [r[1] or "" for r in ROWS]


@pytest.fixture(scope="module")
def byte_file():
    return tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_file():
    return tokenizer_file("word_bpe_49k.json")


@pytest.mark.parametrize("memory", [50, 100_000])
def test_streams_give_the_library_s_ids(byte_file, word_file, memory):
    texts = fuzz()
    for kind, source in ((token_stream.ByteLevelIds, byte_file), (packing.SentenceIds, word_file)):
        tok = Tokenizer.from_str(source)
        ids = kind(source, memory)
        for again in range(2):
            for i in range(0, len(texts), 500):
                part = texts[i : i + 500]
                assert [x.tolist() for x in ids.run(part)] == [tok.encode(t, add_special_tokens=False).ids for t in part]


def test_merges_and_decoding(byte_file):
    tok, ids = Tokenizer.from_str(byte_file), bpe.BpeIds(byte_file)
    for text, x in zip(fuzz(), ids.stream(fuzz())):
        assert x.tolist() == tok.encode(text, add_special_tokens=False).ids
        assert ids.merges.decode(x.tolist()) == tok.decode(x.tolist(), skip_special_tokens=False)


def test_lexicon(tmp_path):
    rng = random.Random(1)
    words = {"".join(rng.choice("abé ") for _ in range(rng.randint(1, 6))).encode(): [rng.randint(0, 9) for _ in range(rng.randint(0, 3))] for _ in range(800)}
    (tmp_path / "l").write_bytes(lexicon.compile_lexicon(words))
    found = lexicon.Lexicon(str(tmp_path / "l"))
    assert [list(found.ids_of(n)) for n in found.find(list(words)).tolist()] == list(words.values())
    assert (found.find([w + b"x" for w in words] + [b"", b"z" * 200]) == -1).all()
    assert len(found.final) < len({w[:i] for w in words for i in range(len(w) + 1)})  # suffixes are shared
    (tmp_path / "e").write_bytes(lexicon.compile_lexicon({}))
    assert (lexicon.Lexicon(str(tmp_path / "e")).find([b"a", b""]) == -1).all()


def test_bpe_operator(docs, none, byte_file):
    tok = Tokenizer.from_str(byte_file)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in ROWS:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.encode_digests(docs, byte_file, most=50).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode_digests(none, byte_file).count() == 0


def test_word_counts(docs, byte_file):
    tok = Tokenizer.from_str(byte_file)
    want: dict = {}
    back = {c: b for b, c in token_stream.byte_alphabet().items()}
    for r in ROWS:
        for part in (r[1] or "").split("<|endoftext|>"):
            for w, _ in tok.pre_tokenizer.pre_tokenize_str(part):
                w = bytes(back[c] for c in w)
                want[w] = want.get(w, 0) + 1
    assert {bytes(r.word): r.n for r in bpe.word_counts(docs, byte_file).collect()} == want
    top = bpe.frequent_words(bpe.word_counts(docs, byte_file), 20)
    assert 0 < len(top) <= 20 and min(want[w] for w in top) >= max([n for w, n in want.items() if w not in top], default=0)


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, m, n, dtype=np.uint32) for n, m in ((0, 5), (1, 1 << 32), (40_000, 50_000), (16_384, 200), (5, 1 << 17))]
    got = list(bitplane.unpack_chunk(bitplane.pack_chunk([3, None, -1, 4, 4], docs)))
    assert [i for i, _ in got] == [3, None, -1, 4, 4] and all((a == b).all() for (_, a), b in zip(got, docs))
    assert list(bitplane.unpack_chunk(bitplane.pack_chunk([], []))) == []
    with pytest.raises(ValueError):
        list(bitplane.unpack_chunk(b"nothing"))


def test_binary_operator(docs, none, byte_file, monkeypatch):
    tok = Tokenizer.from_str(byte_file)
    out = bitplane.round_trip(docs, byte_file)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in out.collect())
    assert [d for _, d, _, _ in got] == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d))
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted(((d, c) for _, d, _, c in got), key=str) == sorted(((r[0], crc(r[1])) for r in ROWS), key=str)
    assert bitplane.round_trip(none, byte_file).count() == 0


def test_small_chunks(spark, docs, byte_file, tmp_path, monkeypatch):
    whole = sorted(map(tuple, bitplane.round_trip(docs, byte_file).collect()), key=str)
    monkeypatch.setattr(bitplane, "CHUNK_IDS", 64)
    bitplane.write(docs, byte_file, str(tmp_path / "ids"), partitions=5)
    assert sorted(map(tuple, bitplane.digests(spark, str(tmp_path / "ids")).collect()), key=str) == whole
    index = spark.read.parquet(str(tmp_path / "ids/index")).orderBy("start").collect()
    assert all(a.start + a.ids == b.start for a, b in zip(index, index[1:]))


def brute_cost(at, penalty, size):
    best, places = {0: 0}, [0, *at]
    for j in range(1, len(places)):
        best[places[j]] = penalty[j - 1] + min(best[p] + packing.padding(places[j] - p, size) for p in places[:j] if places[j] - p <= size)
    return best[places[-1]]


def test_cuts_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(300):
        size, n = rng.choice([8, 16, 32]), rng.randint(1, 25)
        at = np.cumsum([rng.randint(1, size) for _ in range(n)]).tolist()
        penalty = [rng.choice([0, 1, 5]) for _ in range(n)]
        cost = last = 0
        for j in packing.choose_cuts(at, penalty, size):
            cost += packing.padding(at[j] - last, size) + penalty[j]
            last = at[j]
        assert last == at[-1] and cost == brute_cost(at, penalty, size)


def check_pieces(pieces, want, limit):
    """want: documents as (id, ids), in any order."""
    sequences: dict = {}
    for doc_id, start, length, crc, total, seq, offset in pieces:
        sequences.setdefault(seq, []).append((offset, length))
        assert length > 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    left = sorted(((d, s, n, c, t) for d, s, n, c, t, _, _ in pieces), key=str)
    for doc_id, ids in want:
        at = 0
        while at < len(ids):
            own = next(p for p in left if p[0] == doc_id and p[1] == at and p[4] == len(ids) and p[3] == zlib.crc32(ids[at : at + p[2]].tobytes()))
            left.remove(own)
            at += own[2]
    assert not left
    return sum(packing.padding(sum(n for _, n in own), limit) for own in sequences.values())


def test_packer_in_segments():
    rng = np.random.default_rng(2)
    docs = [(i, rng.integers(0, 99, n).astype("<u4")) for i, n in enumerate([1, 5000, 3, 700, 64, 1, 9000, 2, 300])]
    for segment in (100, 5000, 1 << 20):
        packer, rows = packing.Packer(7 << 40, 256, segment), []
        for d, ids in docs:
            rows += packer.add(d, ids, np.arange(10, len(ids), 37))
        rows += packer.close()
        assert check_pieces(rows, docs, 256) < 37 * (len({r[5] for r in rows}) + 1)


def test_packing_operator(docs, none, word_file):
    tok = Tokenizer.from_str(word_file)
    want = [(r[0], np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in ROWS]
    padded = check_pieces([tuple(r) for r in packing.pack(docs, word_file).collect()], want, 4096)
    assert padded < 0.05 * sum(len(x) for _, x in want)
    assert packing.pack(none, word_file).count() == 0


def test_other_files_are_refused():
    files = {kind: tokenizer_file(name) for kind, name in ((token_stream.ByteLevelIds, "byte_bpe_50k.json"), (token_stream.SpacelessIds, "word_bpe_49k.json"))}
    for kind, own in files.items():
        kind(own)
        for other in files.values():
            if other is not own:
                with pytest.raises(ValueError):
                    kind(other)
