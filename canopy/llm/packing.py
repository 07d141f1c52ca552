"""Packing by order-preserving dynamic programming.

Documents, in the order in which they come, form one stream of ids per task, each with an end id. The stream is cut into
sequences of at most SEQUENCE ids. Places to cut are the ends of documents (free), the ends of sentences inside them (a
small penalty) and, in stretches of more than STRETCH ids without either, every STRETCH ids (a larger one). With
best(j) the least cost of all that lies before place j,

    best(j) = penalty(j) + min over i of best(i) + padding(at j - at i),   at j - at i <= SEQUENCE

where padding is SEQUENCE less the length, except that a length that is a power of two is not padded. The padded part of
the minimum is that of best(i) + at i over a sliding window, which a monotone queue of places gives in constant time per place;
the lengths that are powers of two are looked up, thirteen per place. A last stretch that would be padded by more than its
cuts cost is split into powers of two.

The stream is packed in segments: after SEGMENT_IDS, the cuts but the last are final and the ids after them open the next
segment. So memory is bounded by a segment and one document, whatever a task reads. No rows move between tasks.

Defined results: a null or empty text is its end id alone; repeated rows are packed each on its own; an empty table gives
no pieces; columns besides id and text are not read. sequence_id is the task's partition, shifted left by 40 bits, plus a count.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.token_stream import SpacelessIds, of_worker, runs

SEQUENCE = 4096
SENTENCE_PENALTY = 8
STRETCH_PENALTY = 32
STRETCH = 256
SEGMENT_IDS = 1 << 20
END = 2
_STOPS = (".", "!", "?")


def padding(length: int, sequence: int = SEQUENCE) -> int:
    """Ids that a sequence of this length is padded by: none at a power of two."""
    return 0 if length & (length - 1) == 0 else sequence - length


def choose_cuts(at: Sequence[int], penalty: Sequence[int], sequence: int = SEQUENCE) -> list[int]:
    """The cheapest cuts of a stream from 0: indices into the places (ascending positions at, the last of them its end).

    No two places next to each other, nor 0 and the first, are further apart than sequence.
    """
    place = {0: -1}
    powers = [1 << k for k in range(sequence.bit_length()) if 1 << k <= sequence]
    best: list[int] = []
    back: list[int] = []
    window: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # best + at ascending, with at and index
    get = place.get
    for j, pos in enumerate(at):
        low = pos - sequence
        while window[0][1] < low:
            window.popleft()
        value, _, source = window[0]
        cost = value + sequence - pos
        for p in powers:
            i = get(pos - p)
            if i is not None:
                own = best[i] if i >= 0 else 0
                if own < cost:
                    cost, source = own, i
        cost += penalty[j]
        best.append(cost)
        back.append(source)
        place[pos] = j
        value = cost + pos
        while window and window[-1][0] >= value:
            window.pop()
        window.append((value, pos, j))
    out, j = [], len(at) - 1
    while j >= 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def tail_lengths(length: int, sequence: int = SEQUENCE, penalty: int = STRETCH_PENALTY) -> list[int]:
    """A last stretch as one sequence, or as powers of two where padding would cost more than the cuts."""
    pieces = [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]
    return pieces if padding(length, sequence) > penalty * (len(pieces) - 1) else [length]


class Packer:
    """Takes documents (id, ids, places of sentence ends) in turn; yields pieces (doc_id, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, sequence: int = SEQUENCE, segment: int = SEGMENT_IDS):
        self.next, self.sequence, self.segment = first_sequence, sequence, segment
        self.docs: deque[list] = deque()  # doc_id, ids, doc_tokens, first id not packed yet, places not packed yet
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, sentence_ends: np.ndarray) -> Iterator[tuple]:
        ends = sentence_ends[(sentence_ends > 0) & (sentence_ends < len(ids))]
        marks = np.r_[ends, len(ids)]
        penalty = np.full(len(marks), SENTENCE_PENALTY)
        penalty[-1] = 0
        gaps = np.diff(marks, prepend=0)
        if (gaps > STRETCH).any():
            more = np.concatenate([np.arange(m - g + STRETCH, m, STRETCH) for m, g in zip(marks[gaps > STRETCH], gaps[gaps > STRETCH])])
            marks = np.r_[marks, more]
            penalty = np.r_[penalty, np.full(len(more), STRETCH_PENALTY)]
            order = np.argsort(marks, kind="stable")
            marks, penalty = marks[order], penalty[order]
        self.docs.append([doc_id, ids, 0, marks, penalty])
        self.held += len(ids)
        if self.held >= self.segment:
            yield from self._pack(False)

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield from self._pack(True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        at, penalty, base = [], [], 0
        for _, ids, done, marks, cost in self.docs:
            keep = marks > done
            at.append(marks[keep] - done + base)
            penalty.append(cost[keep])
            base += len(ids) - done
        at = np.concatenate(at)
        cuts = [0, *at[choose_cuts(at.tolist(), np.concatenate(penalty).tolist(), self.sequence)].tolist()]
        lengths = np.diff(cuts).tolist()
        if last:
            lengths[-1:] = tail_lengths(lengths[-1], self.sequence)
        else:
            lengths.pop()
        for length in lengths:
            yield from self._emit(length)

    def _emit(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            doc = self.docs[0]
            doc_id, ids, done = doc[:3]
            n = min(length - offset, len(ids) - done)
            yield doc_id, done, n, zlib.crc32(ids[done : done + n].tobytes()), len(ids), self.next, offset
            offset += n
            if done + n == len(ids):
                self.docs.popleft()
            else:
                doc[2] = done + n
        self.held -= length
        self.next += 1


_PIECES = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])


class SentenceIds(SpacelessIds):
    """Remembers of each piece whether a sentence ends with it."""

    def _forget(self) -> None:
        super()._forget()
        self.stops = np.zeros(0, bool)

    def _kept(self, kept: np.ndarray) -> None:
        self.stops = self.stops[kept]

    def _learn(self, keys: list) -> None:
        super()._learn(keys)
        self.stops = np.r_[self.stops, np.fromiter((k.rstrip("\"')]").endswith(_STOPS) for k in keys), bool, len(keys))]

    def documents(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """ids and the places after which a sentence ends; a text that the library takes whole has no such places."""
        for t, at in zip(texts, self.codes(texts)):
            if at is None:
                yield self.whole(t), np.zeros(0, np.int64)
            else:
                yield self.of(at), np.cumsum(self.size[at])[self.stops[at]] if len(at) else np.zeros(0, np.int64)


def pack(docs: DataFrame, source: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = of_worker(SentenceIds, shared.value)
        packer = Packer(TaskContext.get().partitionId() << 40, sequence)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

        rows: list[tuple] = []
        for batch in batches:
            at = 0
            for texts in runs(t.as_py() for t in batch.column(1)):
                doc_ids = batch.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                for doc_id, (x, ends) in zip(doc_ids, ids.documents(texts)):
                    rows += packer.add(doc_id, np.append(x, end).astype("<u4"), ends)
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
        rows += packer.close()
        if rows:
            yield batch_of(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
