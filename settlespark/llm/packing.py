"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from settlespark.llm.common import column_chunks, text_of

WINDOW = 2048
#: What a document leaves beside its full windows is cut into pieces of at most this many tokens, so that windows can be balanced.
PIECE = 512
#: Windows that are balanced together.
GROUP = 32
#: Per cent of a group that is filled before it is balanced: a little room lets differencing succeed without one more window.
FILL = 99
#: Distinct words whose ids a worker remembers, in two halves: those met since the halves last changed, and those met before that.
REMEMBERED = 500_000
#: Words tokenized at once.
AT_ONCE = 200
#: Marks that often end a word.
MARKS = {b".", b",", b";", b":", b"!", b"?"}

PACKED = (
    "doc_id bigint, start bigint, length bigint, token_ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def _parts(word: bytes) -> tuple[bytes, ...]:
    """Parts that are tokenized apart with the same ids, and are shared by more words.

    A mark behind an ASCII letter is a pre-token of its own, and ASCII words are lower-cased by the tokenizer anyway.
    """
    if len(word) > 1 and word[-1:] in MARKS and word[-2:-1].isalpha():
        return (*_parts(word[:-1]), word[-1:])
    return (word.lower() if word.isascii() else word,)


class WordTokenizer:
    """Ids of a text by a tokenizer whose pre-tokens never hold white space.

    Then the ids of a text are those of its words in turn, and each distinct word is tokenized once per worker.  When the newer half of the
    memory is full it becomes the older one, and what was not met since is forgotten; that costs time, never a different result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), AT_ONCE):
            part = words[at:at + AT_ONCE]
            # One text with single spaces: the offsets say which word an id belongs to.
            texts = [w.decode() for w in part]
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            got = self.own.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4")
            owner = np.searchsorted(starts, np.array([o[0] for o in got.offsets], dtype=np.int64), side="right") - 1
            ends = (4 * np.searchsorted(owner, np.arange(len(part) + 1))).tolist()
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[a:b] for a, b in zip(ends, ends[1:])]))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.encode().split() for t in texts]
        known, older = self.known, self.older
        missing = set().union(*split).difference(known)
        known.update((w, older[w]) for w in missing if w in older)
        new = missing.difference(known)
        if new:
            parts = {w: _parts(w) for w in new}
            stems = {p for found in parts.values() for p in found}.difference(known)
            known.update((w, older[w]) for w in stems if w in older)
            self._learn(list(stems.difference(known)))
            known.update((w, b"".join([known[p] for p in found])) for w, found in parts.items())
        get = known.__getitem__
        found = [b"".join(map(get, words)) for words in split]
        if len(known) > REMEMBERED // 2:  # only between the texts at hand, all of whose words have just been looked up
            self.older, self.known = known, {}
        return found


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: ``ways`` lists of positions with nearly equal sums of ``sizes``.

    Every item begins as a partial partition of its own.  The two with the widest spread are merged, the largest part of one with
    the smallest of the other, until one is left.
    """
    if ways == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(ways - 1)]
    heap = [(-s, i, [0] * (ways - 1) + [s], [()] * (ways - 1) + [((i,),)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, loads, parts = heapq.heappop(heap)
        _, _, others, theirs = heapq.heappop(heap)
        merged = sorted(
            ((a + b, p + q) for a, b, p, q in zip(loads, reversed(others), parts, reversed(theirs))), key=lambda x: x[0]
        )
        loads, parts = [x[0] for x in merged], [x[1] for x in merged]
        heapq.heappush(heap, (loads[0] - loads[-1], serial, loads, parts))
        serial += 1
    return [[i for piece in part for i in piece] for part in heap[0][3]]


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """The fewest windows, counted up from the least possible number, for which differencing keeps every window within capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = [w for w in differencing(sizes, ways) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        ways += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, token_ids, doc_tokens, sequence_id, offset.

    Every row of ``docs`` (doc_id, text) is tokenized by the tokenizer file and followed by ``end_id``, so an empty or null text is one
    token.  Full windows are cut from the front; the rest is cut into pieces of at most 512 tokens, and the pieces of
    some 32 windows at a time are balanced by differencing.  A piece lies in one window, windows keep their pieces from offset 0
    without gaps, and a sequence id is (partition, number in the partition).  Repeated rows are packed each on their own.

    Nothing is shuffled: rows are packed in the partition they are read in, at most one group of windows is held beside the
    batch at hand, and a task that is redone on the same rows gives the same ids.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 40
        tail = np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def settle() -> None:
            nonlocal serial, held
            for found in windows([p[2] for p in waiting], window):
                at = 0
                for i in found:
                    rows.append((*waiting[i], serial, at))
                    at += waiting[i][2]
                serial += 1
            waiting.clear()
            held = 0

        def ready() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            rows.clear()
            return out

        for batch in column_chunks(batches):
            every = word_tokenizer(tokenizer).ids(batch.column(1).to_pylist())
            for doc_id, raw in zip(batch.column(0).to_pylist(), every):
                raw += tail
                total = len(raw) // 4
                full = total // window * window
                for start in range(0, full, window):
                    rows.append((doc_id, start, window, raw[4 * start:4 * (start + window)], total, serial, 0))
                    serial += 1
                for start in range(full, total, PIECE):
                    end = min(total, start + PIECE)
                    if held + end - start > GROUP * window * FILL // 100:
                        settle()
                    waiting.append((doc_id, start, end - start, raw[4 * start:4 * end], total))
                    held += end - start
            yield ready()
        if waiting:
            settle()
        yield ready()

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(work, PACKED)
