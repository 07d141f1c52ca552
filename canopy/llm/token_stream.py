"""Ids of whole texts from a tokenizers file, with each distinct piece of text encoded once.

A text is cut at places that no token and no pattern of the tokenizer crosses. A piece is split into pre-tokens and the
library's model encodes each distinct pre-token; the ids of a text are those of its pieces one after the other. That
gives the library's ids for the whole text and spares it the repetition. Only pieces of characters whose classes no
version of Unicode changed are split here; the library encodes other pieces, and whole texts in which a place for cutting
could be unsafe. Pieces are remembered up to a fixed number, for as long as the worker process lives; beyond it, those seen
least are forgotten.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

MEMORY = 600_000
WORDS = 200_000
RUN_BYTES = 1 << 23
#: ASCII that is printed, line breaks, and Latin letters.
PLAIN = regex.compile("[\\t\\n\\r\\x20-\\x7e\u00c0-\u017f]*")


#: Marks that often follow a word; most pieces are a word, or a word and one of them, and need no pattern.
_STOPS = frozenset(",.;:!?")


def load(source: str) -> Tokenizer:
    """A tokenizer from the text of its file, without truncation or padding."""
    tok = Tokenizer.from_str(source)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_alphabet() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies: itself, or the next one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class Ids:
    """Encodes texts piece by piece; the subclasses say where texts may be cut and how a plain piece splits."""

    #: The parts of a file that the way of cutting and splitting rests on, with the values that they must have.
    EXPECTS: dict = {}

    def __init__(self, source: str, memory: int = MEMORY):
        spec = json.loads(source)
        found = {k: spec.get(k) for k in self.EXPECTS}
        found["model"] = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
        odd = [k for k, v in self.EXPECTS.items() if found[k] != v and k != "model"] + [k for k, v in self.EXPECTS.get("model", {}).items() if found["model"].get(k) != v]
        if odd or any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError(f"this tokenizer file works otherwise than {type(self).__name__} does: {odd or 'added tokens'}")
        self.tok, self.memory = load(source), memory
        self.tokenize = self.tok.model.tokenize
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self._forget()

    def _forget(self) -> None:
        self.keys = pa.array([], pa.string())
        self.words: dict[str, tuple[int, ...]] = {}
        self.seen = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.bad = np.zeros(0, bool)
        self.flat = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        """Keeps the quarter of the memory that was seen most."""
        kept = np.sort(np.argsort(-self.seen, kind="stable")[: self.memory // 4])
        flat = self.of(kept)
        self.keys = self.keys.take(pa.array(kept))
        self.size, self.bad, self.seen = self.size[kept], self.bad[kept], self.seen[kept] // 2
        self.start, self.flat = np.cumsum(self.size) - self.size, flat
        self._kept(kept)

    def _kept(self, kept: np.ndarray) -> None:
        """Called with the places of the pieces that are kept."""

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """The keys of the pieces of each text."""
        raise NotImplementedError

    def first(self, key: str) -> str | None:
        """The key of a text's first piece, if it differs from that of other pieces; no other piece has it."""
        return None

    def piece(self, key) -> str | None:
        """The piece that a key stands for; None where a text that holds it must go to the library whole."""
        raise NotImplementedError

    def split(self, piece: str) -> Sequence[str]:
        """The pre-tokens of a plain piece."""
        raise NotImplementedError

    def parts(self, keys: list) -> list[Sequence[str] | str | None]:
        """Each piece's pre-tokens; the piece itself if it is not plain; None where the key has no piece."""
        piece, split, full = self.piece, self.split, PLAIN.fullmatch
        return [p if p is None else split(p) if full(p) else p for p in map(piece, keys)]

    def prepare(self, parts: list[Sequence[str] | str | None]) -> None:
        """Called before the ids of parts are looked up in words."""

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        if word.isascii() and word.isprintable():
            spelt = word.replace(" ", self.alphabet[0x20])
        else:
            spelt = word.encode().decode("latin-1").translate(self.alphabet)
        return tuple([t.id for t in self.tokenize(spelt)])

    def _learn(self, keys: list) -> None:
        if len(self.words) > WORDS:
            self.words.clear()
        parts = self.parts(keys)
        self.prepare(parts)
        flat, ends, words, word = [], [], self.words, self.word
        get = words.get
        for own in parts:
            if own is None:
                pass
            elif isinstance(own, str):
                flat += self.other(own)
            else:
                for w in own:
                    ids = get(w)
                    if ids is None:
                        ids = words[w] = word(w)
                    flat += ids
            ends.append(len(flat))
        bad = [own is None for own in parts]
        sizes = np.diff(ends, prepend=0)
        size = np.array(sizes, np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.bad = np.concatenate([self.bad, np.array(bad, bool)])
        self.seen = np.concatenate([self.seen, np.zeros(len(size), np.int64)])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])

    def other(self, text: str) -> Sequence[int]:
        """The ids of a text or piece that is not split here."""
        return self.tok.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.other(text), np.int32)

    def codes(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        """The numbers of each text's pieces; None for a text that must go to the library whole."""
        if len(self.keys) > self.memory:
            self._shrink()
        live = [i for i, t in enumerate(texts) if not any(s in t for s in self.special)]
        keys, at, ends = self.cut_all([texts[i] for i in live])
        numbers = self.numbers(keys)
        at = numbers[at]
        self.seen += np.bincount(at, minlength=len(self.seen))
        bad = self.bad[at]
        bad = bad if bad.any() else None
        out: list[np.ndarray | None] = [None] * len(texts)
        start = 0
        for i, end in zip(live, ends.tolist()):
            if bad is None or not bad[start:end].any():
                out[i] = at[start:end]
            start = end
        return out

    def cut_all(self, texts: Sequence[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct keys of the pieces of texts, the key of each piece as a place among them, and where each text's pieces end."""
        lists = self.cut(pa.array(texts, pa.string()))
        encoded = lists.flatten().dictionary_encode()
        keys, at = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = lists.offsets.to_numpy().astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        heads = offsets[:-1][np.diff(offsets) > 0]
        more: dict[str, int] = {}
        for head, key in zip(heads.tolist(), keys.take(pa.array(at[heads])).to_pylist()):
            own = self.first(key)
            if own is None:
                break
            at[head] = more.setdefault(own, len(keys) + len(more))
        return pa.concat_arrays([keys, pa.array(list(more), pa.string())]), at, offsets[1:]

    def numbers(self, keys: pa.Array) -> np.ndarray:
        """The number of each of some distinct keys; new ones are learnt."""
        found = pc.index_in(keys, value_set=self.keys)
        out = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = np.flatnonzero(out < 0)
        if len(unknown):
            new = keys.take(pa.array(unknown))
            out[unknown] = len(self.keys) + np.arange(len(unknown))
            self.keys = pa.concat_arrays([self.keys, new])
            self._learn(new.to_pylist())
        return out

    def of(self, at: np.ndarray) -> np.ndarray:
        """The ids of the pieces at, one after the other."""
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(total)]

    def run(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text (int32)."""
        return [self.whole(t) if at is None else self.of(at) for t, at in zip(texts, self.codes(texts))]

    def stream(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null counts as empty. Texts are taken in runs of about RUN_BYTES."""
        for run in runs(texts):
            yield from self.run(run)


def runs(texts: Iterable[str | None], size: int = RUN_BYTES) -> Iterator[list[str]]:
    """The texts in lists of about size characters; null becomes empty."""
    held: list[str] = []
    total = 0
    for t in texts:
        held.append(t or "")
        total += len(held[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


_OF_WORKER: dict[tuple[type, str], Ids] = {}


def of_worker(kind: type[Ids], source: str) -> Ids:
    """The worker process's own encoder for a file; tasks that follow each other in one process share its memory."""
    key = (kind, hashlib.md5(source.encode()).hexdigest())
    if key not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[key] = kind(source)
        gc.collect()
        gc.freeze()  # what the file holds stays as long as the worker: later collections need not look at it
    return _OF_WORKER[key]


class ByteLevelIds(Ids):
    """For byte-level files whose pre-tokenizer joins a space to the word after it: a text is cut before its spaces.

    The key of a text's first piece starts with a space; all others stand for a space and the key. A space before other
    white space is no safe place, so that such texts are left to the library.
    """

    EXPECTS = {
        "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "post_processor": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    }
    #: The pattern of the files' pre-tokenizer, a fixed value.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def cut(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(texts, " ")

    def first(self, key: str) -> str:
        return " " + key

    def piece(self, key: str) -> str | None:
        if key[:1] == " ":
            return key[1:]
        return None if not key or key[0].isspace() else " " + key

    def split(self, piece: str) -> list[str]:
        return self.PATTERN.findall(piece)

    def parts(self, keys: list[str]) -> list[Sequence[str] | str | None]:
        if not PLAIN.fullmatch("".join(keys)):
            return super().parts(keys)
        piece, find, stops = self.piece, self.PATTERN.findall, _STOPS
        # most pieces are a word, or a word and a mark
        return [
            (" " + k,) if k.isalpha()
            else (" " + k[:-1], k[-1]) if k[-1:] in stops and k[:-1].isalpha()
            else p if (p := piece(k)) is None
            else find(p)
            for k in keys
        ]


class SpacelessIds(Ids):
    """For files whose normalizer lower-cases and whose pre-tokenizer drops white space: a text is cut at ASCII white space."""

    #: The pattern of the files' pre-tokenizer, a fixed value.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    EXPECTS = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": PATTERN.pattern}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "post_processor": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    }

    def cut(self, texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(texts)

    def piece(self, key: str) -> str | None:
        return key

    def split(self, piece: str) -> list[str]:
        return self.PATTERN.findall(piece.lower())

    def parts(self, keys: list[str]) -> list[Sequence[str] | str | None]:
        pieces = " ".join(keys)
        if not PLAIN.fullmatch(pieces):
            return super().parts(keys)
        find, stops = self.PATTERN.findall, _STOPS
        return [
            (k,) if k.isalpha()
            else (k[:-1], k[-1]) if k[-1:] in stops and k[:-1].isalpha()
            else find(k)
            for k in pieces.lower().split(" ")
        ]
