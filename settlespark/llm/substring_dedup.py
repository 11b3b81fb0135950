"""Removal of passages that occur in an earlier document, by suffix automata of reference shards.

Every window of 50 words names one of its 8-word grams, the one with the least hash (the last among equals), so equal windows name equal grams
at equal places.  Windows side by side that name the same gram form a passage, and passages of one gram, whatever their document, make
up that gram's references.  Grams met in one document only are dropped at this point: their windows occur nowhere else.  What
is left is sorted into shards of bounded size; each shard's different passages become one suffix automaton that knows the least document of
every state, and the passages are streamed through it for their matching statistics.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from settlespark.llm.common import column_chunks, joined_where_present, partitions_of, text_of
from settlespark.session import written

LENGTH, GRAM = 50, 8
#: Words hashed at once, bytes of text split at once, words of one shard's automaton, and different passages of a gram beyond which its
#: windows are told apart by a hash of all their words instead, so that no shard outgrows a task.
STRETCH, SPLIT, SHARD_WORDS, WIDE = 1 << 18, 1 << 22, 100_000, 2_000
#: A passage with more than one of so many of all occurrences is hot; there are fewer hot ones than this.
HOT_SHARE = 4096

_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))


class _Memory(dict):
    """64-bit hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Memory()


def split_words(text: str) -> Iterator[list[bytes]]:
    """The words of a text in turn, split at ASCII white space, some megabytes at a time."""
    data = text.encode()
    at = 0
    while at < len(data):
        end = min(len(data), at + SPLIT)
        if end < len(data):
            # Up to the end of the word that the cut would fall into.
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
        yield data[at:end].split()
        at = end


def word_ids(text: str) -> np.ndarray:
    if len(_words) > 1_000_000:
        _words.clear()
    parts = [np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)) for words in split_words(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


_up, _down = _powers(_B, STRETCH + LENGTH + 1), _powers(_INV, STRETCH + LENGTH + 1)


def _hashes(ids: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(ids * _up[: len(ids)], out=sums[1:])
    return sums


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values side by side."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span:]) if width > span else values


def _named(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place of the gram) that every window of a stretch names, and the prefix sums."""
    sums = _hashes(ids)
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * _down[: len(ids) - GRAM + 1])
    bits = np.uint64(19)  # for a place; a stretch is shorter
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = _least((grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64)), LENGTH - GRAM + 1)
    place = (low - (least & low)).astype(np.int64)
    return grams[place], place, sums


def passages(ids: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, gram, content) of the passages of valid window starts; content is a hash of all words and of the gram's place."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(ids) < LENGTH:
        return none
    gram, place, sums = _named(ids)
    starts = np.flatnonzero(valid[: len(gram)])
    if not len(starts):
        return none
    at = place[starts]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    a = starts[first]
    n = np.diff(np.append(first, len(starts)))
    end = a + n - 1 + LENGTH
    content = _mix((sums[end] - sums[a]) * _down[a] + _mix((n * 128 + at[first] - a).astype(np.uint64)))
    return a, n, gram[a], content


def _stretches(every: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, valid starts, number of the text, place in the text): many short texts or a part of a long one at a time."""

    def ready(parts: list[tuple[int, int, np.ndarray]]):
        ids = np.concatenate([p[2] for p in parts])
        lengths = np.array([len(p[2]) for p in parts])
        owner = np.repeat(np.arange(len(parts)), lengths)
        inside = np.arange(len(ids)) - (np.cumsum(lengths) - lengths)[owner]
        return ids, inside + LENGTH <= lengths[owner], np.array([p[0] for p in parts])[owner], inside + np.array([p[1] for p in parts])[owner]

    parts: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for i, ids in enumerate(every):
        for at in range(0, max(0, len(ids) - LENGTH + 1), STRETCH // 2):
            part = ids[at:at + STRETCH // 2 + LENGTH - 1]
            if held + len(part) > STRETCH:
                yield ready(parts)
                parts, held = [], 0
            parts.append((i, at, part))
            held += len(part)
    if parts:
        yield ready(parts)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to the passages of each: gram, content, doc_id, body, start, n."""
    for batch in column_chunks(batches):
        ids = [word_ids(t) for t in batch.column(2).to_pylist()]
        doc_id, body = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        for words, valid, owner, place in _stretches(ids):
            a, n, gram, content = passages(words, valid)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [_signed(gram), _signed(content), pa.array(doc_id[owner[a]]), pa.array(body[owner[a]]), pa.array(place[a]), pa.array(n.astype(np.int32))],
                    ["gram", "content", "doc_id", "body", "start", "n"])


class SuffixAutomaton:
    """The suffix automaton of several word sequences, each with a number; ``lowest`` is the least number of the sequences a state occurs in."""

    def __init__(self) -> None:
        self.link, self.size, self.next, self.lowest = [-1], [0], [{}], [None]

    def add(self, words: Iterable[int], number: int) -> None:
        link, size, after, lowest = self.link, self.size, self.next, self.lowest
        last = 0
        for w in words:
            known = after[last].get(w)
            if known is not None and size[known] == size[last] + 1:
                last = known  # met before at the same depth
            else:
                if known is None:
                    new = len(size)
                    size.append(size[last] + 1)
                    after.append({})
                    link.append(0)
                    lowest.append(None)
                    p = last
                    while p >= 0 and w not in after[p]:
                        after[p][w] = new
                        p = link[p]
                    if p >= 0:
                        q = after[p][w]
                        link[new] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
                    last = new
                else:
                    last = self._clone(last, w, known)
            if lowest[last] is None or number < lowest[last]:
                lowest[last] = number

    def _clone(self, p: int, w: int, q: int) -> int:
        link, size, after = self.link, self.size, self.next
        made = len(size)
        size.append(size[p] + 1)
        after.append(dict(after[q]))
        link.append(link[q])
        self.lowest.append(self.lowest[q])
        link[q] = made
        while p >= 0 and after[p].get(w) == q:
            after[p][w] = made
            p = link[p]
        return made

    def finish(self) -> None:
        """Carry the least numbers up the suffix links, longest states first."""
        link, lowest = self.link, self.lowest
        for v in sorted(range(1, len(link)), key=self.size.__getitem__, reverse=True):
            up, own = link[v], lowest[v]
            if up > 0 and own is not None and (lowest[up] is None or own < lowest[up]):
                lowest[up] = own

    def first_documents(self, words: Iterable[int], length: int = LENGTH) -> list[int | None]:
        """Stream the words: for every window of ``length`` words the least number it occurs in, null where the matching statistic is shorter."""
        link, size, after, lowest = self.link, self.size, self.next, self.lowest
        state = matched = 0
        found: list[int | None] = []
        for w in words:
            while state and w not in after[state]:
                state = link[state]
                matched = size[state]
            step = after[state].get(w)
            if step is None:
                state = matched = 0
            else:
                state, matched = step, matched + 1
            if matched >= length:
                # The state whose strings end here and have the window's length: longer matches say nothing about the window alone.
                while size[link[state]] >= length:
                    state = link[state]
                matched = min(matched, size[state])
                found.append(lowest[state])
            else:
                found.append(None)
        return found[length - 1:]


def _runs(found: list[int | None]) -> Iterator[tuple[int, int, int]]:
    """(first window, windows, document) of the runs of one document."""
    at = 0
    for i in range(1, len(found) + 1):
        if i == len(found) or found[i] != found[at]:
            if found[at] is not None:
                yield at, i - at, found[at]
            at = i


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different passages (key, gram, content, skip, lowest, ids), sorted by key, to runs of windows with the first document of each."""
    shard: list[tuple] = []
    held, last = 0, None

    def told() -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        words = [np.frombuffer(row[5], np.uint64).tolist() for row in shard]
        for row, ids in zip(shard, words):
            automaton.add(ids, row[4])
        automaton.finish()
        out = [(row[1], row[2], row[3] + a, n, doc) for row, ids in zip(shard, words) for a, n, doc in _runs(automaton.first_documents(ids))]
        cols = list(zip(*out)) if out else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["gram", "content", "at", "windows", "first_doc"])

    for batch in column_chunks(batches):
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            # A shard ends between two keys: windows of different keys are never equal.
            if held > SHARD_WORDS and row[0] != last:
                yield told()
                shard.clear()
                held = 0
            shard.append(row)
            held += len(row[5]) // 8
            last = row[0]
    if shard:
        yield told()


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the passages that stand for all equal ones; of a wide gram's passages the hash of each window instead."""
    names = ["key", "gram", "content", "skip", "lowest", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in column_chunks(batches, 64):
        out: list[tuple] = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = word_ids(text)
            for p in wanted:
                own = ids[p["start"]:p["start"] + p["n"] - 1 + LENGTH]
                if not p["wide"]:
                    out.append((p["gram"], p["gram"], p["content"], 0, p["lowest"], own.tobytes()))
                    continue
                sums = _hashes(own)
                every = _mix((sums[LENGTH:] - sums[:-LENGTH]) * _down[: p["n"]]).view(np.int64).tolist()
                out += [(h, p["gram"], p["content"], at, p["lowest"], None) for at, h in enumerate(every)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, body (a hash of the text: rows that share an id are told apart by it), text of the rows with an id."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).where("doc_id is not null")
    return rows.select("doc_id", F.xxhash64("text").alias("body"), "text")


def first_windows(docs: DataFrame) -> DataFrame:
    """doc_id, body, start, n: runs of window starts whose word sequence also starts in a document with a smaller doc_id."""
    texts = _identified(docs)
    seen = written(texts.mapInArrow(_note, "gram bigint, content bigint, doc_id bigint, body bigint, start bigint, n int"), "substring-passages")
    # Sums per passage and per gram are combined before the shuffle: a passage in a third of all documents is one row per task.
    least = F.min(F.struct("doc_id", "body", "start", "n")).alias("least")
    known = written(seen.groupBy("gram", "content").agg(least, F.max("doc_id").alias("greatest"), F.count(F.lit(1)).alias("copies")), "substring-contents")
    grams = known.groupBy("gram").agg(F.min("least.doc_id").alias("a"), F.max("greatest").alias("z"), F.count(F.lit(1)).alias("contents"))
    grams = written(grams.where("a < z").select("gram", (F.col("contents") > WIDE).alias("wide"), "contents"), "substring-grams")

    total = known.agg(F.count(F.lit(1))).first()[0]
    some = _spread(known, grams, ["gram"], F.col("contents") * HOT_SHARE > total)
    wanted = some.select(
        F.col("least.doc_id").alias("doc_id"), F.col("least.body").alias("body"),
        F.struct("gram", "content", F.col("least.start").alias("start"), F.col("least.n").alias("n"), F.col("least.doc_id").alias("lowest"), "wide").alias("p"))
    # All passages of one document: no more than it has windows.
    per_doc = wanted.groupBy("doc_id", "body").agg(F.collect_list("p").alias("wanted"))
    of = ["doc_id", "body"]
    sent = joined_where_present(texts, of, per_doc, of, "found").where("found is not null").select("text", "found.wanted")
    sent = written(sent.mapInArrow(_send, "key bigint, gram bigint, content bigint, skip int, lowest bigint, ids binary"), "substring-sent")
    shards = sent.where("ids is not null").repartition(partitions_of(docs.sparkSession), "key").sortWithinPartitions("key")
    runs = shards.mapInArrow(_match, "gram bigint, content bigint, at int, windows int, first_doc bigint")
    single = sent.where("ids is null").select("gram", "key", "content", F.col("skip").alias("at"), "lowest")
    n_single = single.agg(F.count(F.lit(1))).first()[0]
    lowest = single.groupBy("gram", "key").agg(F.min("lowest").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    alone = _spread(single, lowest, ["gram", "key"], F.col("n") * HOT_SHARE > n_single)
    runs = written(runs.unionByName(alone.select("gram", "content", "at", F.lit(1).alias("windows"), "first_doc")), "substring-runs")

    occurrences = seen.agg(F.count(F.lit(1))).first()[0]
    hot = known.where(F.col("copies") * HOT_SHARE > occurrences).select("gram", "content", F.lit(True).alias("hot"))
    facts = runs.join(F.broadcast(hot), ["gram", "content"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    found = _spread(seen, facts, ["gram", "content"], F.col("hot"))
    return found.where("first_doc < doc_id").select("doc_id", "body", (F.col("start") + F.col("at")).alias("start"), F.col("windows").alias("n"))


def _spread(rows: DataFrame, facts: DataFrame, keys: list[str], hot) -> DataFrame:
    """Rows joined with facts; the facts of hot keys, of which there are fewer than ``HOT_SHARE``, are broadcast, so that no key fills a task."""
    few = facts.where(hot)
    names = F.broadcast(few.select(*keys).distinct())
    return rows.join(F.broadcast(few), keys).unionByName(rows.join(names, keys, "left_anti").join(facts.where(~hot), keys))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans of window starts to what is left of each text."""
    names = ["doc_id", "n_words", "n_removed", "kept_text"]
    for batch in column_chunks(batches, 64):
        out = []
        for doc_id, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
            words = [w for part in split_words(text) for w in part]
            total = len(words)
            edge = np.zeros(total + 1, dtype=np.int64)
            for s in spans or ():
                edge[s["start"]] += 1
                edge[s["start"] + s["n"] - 1 + LENGTH] -= 1
            left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            kept = b" ".join(words if len(left) == total else [words[i] for i in left.tolist()])
            out.append((doc_id, total, total - len(left), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def remove_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (binary: the words left, joined by one space) for every row of ``docs`` (doc_id, text).

    A word goes if a window of 50 words that covers it also starts in a document with a smaller doc_id; windows never cross documents
    and are judged on the input.  Null texts have no words.  Rows without doc_id lose nothing and take nothing from others.  Rows with one
    doc_id are one document to each other: they take nothing from one another.  Words are compared by 64-bit hashes.

    Texts are read three times: to note their passages, for those of them that stand for all equal ones, and for the cut.
    """
    of = ["doc_id", "body"]
    spans = written(first_windows(docs).groupBy(*of).agg(F.collect_list(F.struct("start", "n")).alias("spans")), "substring-spans")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("body", F.xxhash64("text"))
    found = joined_where_present(texts, of, spans, of, "found").select("doc_id", "text", "found.spans")
    return found.mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text binary")
