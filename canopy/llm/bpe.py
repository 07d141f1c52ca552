"""BPE encoding and decoding through a lexicon of frequent words.

One pass counts the words (pre-tokens) of all texts; words are combined in each task before they are shuffled. The most frequent ones,
LEXICON_WORDS at most, are merged once on the driver and compiled, with their ids, into a minimal acyclic transducer. Its file
goes to the shared folder, Spark hands it to every executor, and the workers map it into memory. The second pass finds
words there; words that it lacks are merged exactly, pair of lowest rank first. So ids never depend on what the lexicon
holds, and a lost executor only maps the file again.

Decoding concatenates the bytes of the ids and reads them as UTF-8.

Defined results: null is the empty text, which has no ids; special tokens written in a text are those ids; repeated rows are
encoded each on its own; an empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.lexicon import Lexicon, compile_lexicon
from canopy.llm.scratch import new_path, saved, write_bytes
from canopy.llm.token_stream import PLAIN, ByteLevelIds, of_worker, runs

LEXICON_WORDS = 1 << 17
COUNTED = 1 << 20
#: A space that its piece does not start a word with: texts with one are split by the library.
UNSAFE = re.compile(r" (?:\s|\Z)")


class Merges:
    """The ranks of a tokenizers file of byte-level BPE, and exact merging of one word."""

    def __init__(self, source: str, alphabet: dict[int, str]):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.byte_id = [self.vocab.get(alphabet[b], -1) for b in range(256)]
        back = {c: b for b, c in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in self.vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.width = 1 << size.bit_length()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        vocab, w = self.vocab, self.width
        # rank and result of each pair, in one number
        self.rank = {vocab[a] * w + vocab[b]: r * w + vocab[a + b] for r, (a, b) in enumerate(pairs)}
        self.none = len(self.rank) * w * 2

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word: of all neighbouring pairs that of lowest rank becomes one id, the leftmost first."""
        ids = [self.byte_id[b] for b in word]
        get, w, none = self.rank.get, self.width, self.none
        pair = [get(a * w + b, none) for a, b in zip(ids, ids[1:])]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            ids[i] = low % w
            del ids[i + 1], pair[i]
            if i:
                pair[i - 1] = get(ids[i - 1] * w + ids[i], none)
            if i < len(pair):
                pair[i] = get(ids[i] * w + ids[i + 1], none)
        return tuple(ids)

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class BpeIds(ByteLevelIds):
    """Encodes texts by lexicon and merges; the library only splits what is not plain."""

    def __init__(self, source: str, lexicon: Lexicon | None = None):
        super().__init__(source)
        self.merges, self.lexicon = Merges(source, self.alphabet), lexicon
        self.back = {c: b for b, c in self.alphabet.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def bytes_ids(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """The ids of words: the lexicon's, or merged."""
        found = self.lexicon.find(words).tolist() if self.lexicon and words else [-1] * len(words)
        return [self.lexicon.ids_of(n) if n >= 0 else self.merges.merge(w) for n, w in zip(found, words)]

    def prepare(self, parts: list) -> None:
        words = list({w for own in parts if own is not None and not isinstance(own, str) for w in own if w not in self.words})
        self.words.update(zip(words, self.bytes_ids([w.encode() for w in words])))

    def pre_tokens(self, text: str) -> list[bytes | int]:
        """The words of any text by the library's own split; special tokens are their ids."""
        out: list[bytes | int] = []
        for part in self.special_pattern.split(text) if self.special_pattern else [text]:
            if part in self.merges.special:
                out.append(self.merges.special[part])
            elif part:
                out += [bytes(self.back[c] for c in w) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def other(self, text: str) -> list[int]:
        parts = self.pre_tokens(text)
        ids = iter(self.bytes_ids([p for p in parts if not isinstance(p, int)]))
        return [i for p in parts for i in ([p] if isinstance(p, int) else next(ids))]


def _counting(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = BpeIds(source)
        pieces: Counter = Counter()
        words: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for own, n in zip(ids.parts(list(pieces)), pieces.values()):
                for w in own:
                    words[w] += n
            pieces.clear()
            names = list(words)
            for i in range(0, len(names), 100_000):
                own = names[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogateescape") for w in own], pa.binary()), pa.array([words[w] for w in own], pa.int64())], names=["word", "n"])
            words.clear()

        for batch in batches:
            for texts in runs(t.as_py() for t in batch.column(0)):
                plain = []
                for t in texts:
                    if any(s in t for s in ids.special) or UNSAFE.search(t) or not PLAIN.fullmatch(t):
                        words.update(w.decode("utf-8", "surrogateescape") for w in ids.pre_tokens(t) if not isinstance(w, int))
                    else:
                        plain.append(t)
                keys, at, _ = ids.cut_all(plain)
                pieces.update({k: n for k, n in zip(keys.to_pylist(), np.bincount(at, minlength=len(keys)).tolist()) if n})
                if len(pieces) + len(words) > COUNTED:
                    yield from flush()
        yield from flush()

    return run


def word_counts(docs: DataFrame, source: str, text: str = "text") -> DataFrame:
    """word (UTF-8) and n of every pre-token of all texts."""
    made = docs.select(text).mapInArrow(_counting(source), "word binary, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS) -> list[bytes]:
    """The words above the lowest count that at most this many words reach. Only they come to the driver."""
    top = 100_000
    steps = counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, least = 0, top + 1
    for row in sorted(steps, key=lambda r: -r["n"]):
        if total + row["words"] > most:
            break
        total, least = total + row["words"], row["n"]
    return [bytes(r["word"]) for r in counts.filter(F.col("n") >= least).select("word").toLocalIterator()]


def build_lexicon(docs: DataFrame, source: str, most: int = LEXICON_WORDS) -> str:
    """Counts, compiles and hands out the lexicon of docs; returns the name by which workers find it."""
    spark = docs.sparkSession
    words = frequent_words(saved(word_counts(docs, source), "words"), most)
    merge = BpeIds(source).merges.merge
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = write_bytes(spark, new_path(spark, name), compile_lexicon({w: merge(w) for w in words}))
    spark.sparkContext.addFile(path)
    return name


def encode_digests(docs: DataFrame, source: str, most: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    name = build_lexicon(docs, source, most)
    shared = docs.sparkSession.sparkContext.broadcast(source)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = of_worker(BpeIds, shared.value)
        if getattr(ids, "lexicon_name", None) != name:
            ids.lexicon, ids.lexicon_name = Lexicon(SparkFiles.get(name)), name
        decimal = list(map(str, range(len(ids.merges.bytes_of))))
        for batch in batches:
            found, at = [], 0
            for texts in runs(t.as_py() for t in batch.column(1)):
                for x in ids.run(texts):
                    own = x.tolist()
                    joined = ",".join(map(decimal.__getitem__, own))
                    found.append((len(own), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(ids.merges.decode(own).encode("utf-8", "surrogatepass")).hexdigest()))
                at += len(texts)
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*found), kinds[1:]))] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
