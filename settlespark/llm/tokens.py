"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from settlespark.llm.common import column_chunks, text_of

#: Texts are cut at safe boundaries into parts of about this many characters.
PART_CHARS = 1 << 16
#: A single match of the pattern with more bytes than this is merged with a heap instead of by the library's repeated scan.
LONG_MATCH_BYTES = 4096


@functools.cache
def encoding(path: str, pattern: str):
    """The encoding of a rank file of lines "base64 rank", made once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


# A space between two characters that are not white space begins a match of every pattern of the form " ?letters| ?digits| ?others|spaces",
# and no match runs over it.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text cut only before safe boundaries; a stretch without one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one match with a heap of (rank, position): the lowest rank first, the leftmost among equals."""
    n = len(piece)
    end, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n + 1)
    rank_at = lambda i: ranks.get(piece[i:end[end[i]]]) if end[i] < n else None
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank_at(i)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, length = heapq.heappop(heap)
        if gone[i] or end[i] >= n or end[end[i]] - i != length or rank_at(i) != rank:
            continue
        after = end[i]
        gone[after] = 1
        end[i] = end[after]
        if end[i] < n:
            before[end[i]] = i
        for j in (before[i], i):
            if j >= 0 and (r := rank_at(j)) is not None:
                heapq.heappush(heap, (r, j, end[end[j]] - j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    codec, ranks = encoding(path, pattern)
    ids: list[int] = []
    for part in parts(text):
        if not _LONG_STRETCH.search(part):
            ids += codec.encode_ordinary(part)
            continue
        for match in regex.finditer(pattern, part):
            raw = match.group().encode()
            ids += merge_long(raw, ranks) if len(raw) > LONG_MATCH_BYTES else codec.encode_ordinary(match.group())
    return ids


# Only a stretch without a safe boundary can hold a match this long.
_LONG_STRETCH = regex.compile(r"\S{1024}|\s{1024}")

ENCODED = "doc_id bigint, token_ids binary, n_tokens bigint"
DECODED = "doc_id bigint, text_bytes binary"


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, token_ids (little-endian unsigned 32-bit integers) and n_tokens of every row of ``docs`` (doc_id, text).

    Each match of ``pattern`` is merged on its own by rank; special tokens do not exist.  A null or empty text has no ids; repeated rows
    give repeated results; a null doc_id stays null.  Rows never leave their partition: no shuffle, and a lost task is redone alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_chunks(batches):
            ids = [np.array(encode_text(t, path, pattern), dtype="<u4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64())],
                ["doc_id", "token_ids", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(work, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text_bytes: the raw bytes that the ids of each row stand for (they need not be whole characters)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = encoding(path, pattern)
        for batch in column_chunks(batches):
            raw = [codec.decode_bytes(np.frombuffer(i or b"", dtype="<u4").tolist()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "text_bytes"])

    return encoded.select("doc_id", "token_ids").mapInArrow(work, DECODED)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and text_bytes, the way there and back in one pass over the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = encoding(path, pattern)
        for batch in batches:
            raw = [codec.decode_bytes(np.frombuffer(i, dtype="<u4").tolist()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["doc_id", "token_ids", "n_tokens", "text_bytes"])

    return encode(docs, path, pattern).mapInArrow(work, ENCODED + ", text_bytes binary")
