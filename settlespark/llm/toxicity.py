"""Toxicity by class-conditional Kneser-Ney models of word pairs over a shared continuation distribution.

Each class has discounted counts of words after the word before them, which back off to its discounted counts of words, and these to one
continuation distribution that the classes share: in how many different contexts a word was met in either class.  A word or pair has
counts of its own in a class only if the documents of the classes differ in it beyond chance; every other one is left to the backoff,
so a rare expression speaks for neither class.  A text is scored by the mean over all its words of the difference of log-likelihoods.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from settlespark.llm.common import column_chunks, maybe_in, partitions_of, text_of
from settlespark.session import release, remove, written

#: Log-likelihood ratio statistic (chi-square, one degree of freedom) of the documents with a word or pair in either class from which on the
#: classes have counts of their own: by chance, 4 in 100 million words and pairs reach it.
DISTINCT = 30.0
#: Words and pairs with counts of their own that are broadcast at once (16 MB); a larger model is gone through in pieces.
PIECE = 1_000_000
#: Words and pairs that a task adds up before it sends them.
HELD = 800_000
#: Contexts that are no words: none (the count of a word alone), the start of a text; and the word at its end.
NONE, START, END = np.arange(3, dtype=np.uint64)
_BLANK = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))


class Words:
    """Hashes of words, remembered by a worker up to a bound."""

    LIMIT = 300_000

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.word = array("Q")

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts one after the other, and the number of words of each."""
        split = [t.lower().encode().translate(_BLANK).split() for t in texts]
        if len(self.at) > self.LIMIT:
            self.at.clear()
            self.word = array("Q")
        at = self.at
        for words in split:
            for w in words:
                if w not in at:
                    at[w] = len(self.word)
                    self.word.append(xxhash.xxh3_64_intdigest(w))
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        ids = np.fromiter((at[w] for words in split for w in words), dtype=np.int64, count=int(lengths.sum()))
        return np.frombuffer(self.word, np.uint64)[ids] if len(ids) else np.zeros(0, np.uint64), lengths


_words: list[Words] = []


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before each word, the words with the end of each text, and their number for each text."""
    if not _words:
        _words.append(Words())
    words, lengths = _words[0].hashes(texts)
    words = np.insert(words, np.cumsum(lengths), END)
    before = np.roll(words, 1)
    before[before == END] = START
    return before, words, lengths + 1


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    mixed = before * np.uint64(0x9E3779B97F4A7C15) + words
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


_COUNTS = ["n0", "n1", "d0", "d1"]


def _added(before: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (context, word) once, with the sums of its counts."""
    keys = _pair(before, words)
    order = np.argsort(keys)
    first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1]))
    return before[order][first], words[order][first], np.add.reduceat(counts[order], first, dtype=np.int32)


def _of_texts(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (context, word) of the texts, with its occurrences and its documents in the ordinary and the toxic class."""
    before, words, lengths = _tokens(texts)
    doc = np.tile(np.repeat(np.arange(len(texts)), lengths), 2)
    before, words = np.concatenate([before, np.full(len(words), NONE)]), np.tile(words, 2)
    keys = _pair(before, words)
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    in_doc = np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(doc, prepend=-1) != 0))
    n, y = np.diff(in_doc, append=len(keys)), toxic[doc[in_doc]]
    counts = np.stack([n * (1 - y), n * y, 1 - y, y], axis=1).astype(np.int32)
    return _added(before[order][in_doc], words[order][in_doc], counts)


def count(labelled: DataFrame) -> DataFrame:
    """before, word (hashes) and counts of all words and pairs in the rows of ``labelled`` (text, toxic): n0, n1 occurrences and d0, d1
    documents in the ordinary and the toxic class, exactly.  A task adds up what it has read before it sends it, so a pair that comes very often is
    a few rows a task.  The rows of a word lie in one partition.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def added() -> Iterator[pa.RecordBatch]:
            before, words, counts = _added(*[np.concatenate(c) for c in zip(*held)])
            held.clear()
            for at in range(0, len(words), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(before[part].view(np.int64)), pa.array(words[part].view(np.int64)), *[pa.array(counts[part, i]) for i in range(4)]],
                    ["before", "word", *_COUNTS])

        for batch in column_chunks(batches):
            held.append(_of_texts(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
            if sum(len(words) for _, words, _ in held) > HELD:
                yield from added()
        if held:
            yield from added()

    parts = labelled.select(text_of().alias("text"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        gather, "before bigint, word bigint, n0 int, n1 int, d0 int, d1 int")
    return parts.repartition(partitions_of(labelled.sparkSession), "word").groupBy("word", "before").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _statistic(docs: tuple[int, int]) -> Column:
    """Twice the log-likelihood ratio of d0 and d1 of ``docs`` documents having one share each against having the same share."""
    share = (F.col("d0") + F.col("d1")) / float(max(1, sum(docs)))
    total = F.lit(0.0)
    for c, n in zip(("d0", "d1"), docs):
        for seen, expected in ((F.col(c), share * n), (n - F.col(c), (1 - share) * n)):
            total = total + F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return 2 * total


def discount(ones: float, twos: float) -> float:
    """The absolute discount, estimated from how many kinds were met once and twice."""
    return ones / (ones + 2 * twos) if ones and twos else 0.75


class Model:
    """Logarithms of ratios by (context, word), added up for each word of a text: a piece of what ``learn`` estimates, or all of it.

    Each word has ``rest``, what the value of its word alone adds to that, and what the value of its pair adds.  Values of different words
    and pairs are independent of each other, so pieces with other entries (``rest`` in one of them only) give differences that add up to the whole.
    """

    def __init__(self, before: np.ndarray, words: np.ndarray, values: np.ndarray, rest: float):
        def table(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys = _pair(before[own], words[own])
            order = np.argsort(keys)
            return keys[order], values[own][order]

        self.rest = rest
        self.words, self.word_value = table(before == NONE)
        self.pairs, self.pair_value = table(before != NONE)

    def evidence(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """For every word, its log-likelihood under the toxic model less that under the ordinary one, as far as the entries tell."""

        def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray | float:
            if not len(keys):
                return 0.0
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], 0.0)

        alone = found(self.words, self.word_value, _pair(np.full(len(words), NONE), words))
        return np.broadcast_to(self.rest + alone + found(self.pairs, self.pair_value, _pair(before, words)), words.shape)

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text, the length-normalised difference of its log-likelihoods, as far as the entries tell."""
        before, words, lengths = _tokens(texts)
        ends = np.cumsum(lengths)
        sums = np.concatenate([[0], np.cumsum(self.evidence(before, words), dtype=np.float64)])
        return (sums[ends] - sums[ends - lengths]) / lengths


class Learned:
    """All words and pairs with counts of their own: entries (before, word, value), a stored table of ``size`` rows, and the value of any other word."""

    def __init__(self, entries: DataFrame, size: int, rest: float):
        self.entries, self.size, self.rest = entries, size, rest
        self.pieces = max(1, -(-size // PIECE))

    def models(self) -> Iterator[Model]:
        """The pieces one after the other, so that no more than one is held; a pair goes by its own hash, so none is large for a frequent word."""
        for i in range(self.pieces):
            mine = self.entries.where(F.pmod(F.xxhash64("before", "word"), F.lit(self.pieces)) == i).toPandas()
            as_hash = lambda c: mine[c].to_numpy(np.int64).view(np.uint64)
            yield Model(as_hash("before"), as_hash("word"), mine["value"].to_numpy(float), 0.0 if i else self.rest)

    @property
    def pairs(self) -> np.ndarray:
        """The hashes of all pairs."""
        return np.concatenate([m.pairs for m in self.models()])

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text, the length-normalised difference of its log-likelihoods."""
        return np.sum([m.features(texts) for m in self.models()], axis=0)


def learn(labelled: DataFrame, docs: tuple[int, int]) -> Learned:
    """The models of ``labelled`` (text, toxic), which has ``docs`` ordinary and toxic rows: every word and pair with counts of its own, however many.

    For class k, with discounts D estimated from the kinds met once and twice:

    - q(w) = (contexts(w) - D + D * kinds / (kinds + 1)) / all different pairs: in both classes together; the kind over is unknown words.
    - p_k(w) = max(n_k(w) - D, 0) / n_k + D * kinds_k / n_k * q(w) for a word with counts of its own; all others share what is left by q.
    - p_k(w|c) = max(n_k(c, w) - D, 0) / n_k(c) + b(c) * p_k(w); the first part only for a pair with counts of its own, and b(c) is what these
      parts leave of 1 after c in both classes together.

    q and p_k sum to 1.  b(c) is shared by the classes: with one for each, every other word after a context of few occurrences would speak
    against the class with the pair.  p_k(w|c) thus sums to 1 only over both classes.  A word without counts of its own has the same share of
    what is left in both classes, and a pair without is left to its word.  The ratios of the classes are worked out where the counts lie.
    """
    spark = labelled.sparkSession
    own = F.when(F.col("statistic") >= DISTINCT, F.struct("before", "n0", "n1"))
    alone, pair = F.col("before") == int(NONE), F.col("before") != int(NONE)
    of_word = [F.max(F.when(alone, F.col(c))).alias(c) for c in ("n0", "n1", "statistic")]
    times = [F.count_if(pair & (F.col(f"n{k}") == t)).alias(f"pair_{name}{k}") for k in (0, 1) for t, name in ((1, "ones"), (2, "twos"))]
    by_word = written(
        count(labelled).withColumn("statistic", _statistic(docs)).groupBy("word").agg(
            *of_word, F.count_if(pair).alias("contexts"), *times, F.collect_list(F.when(pair, own)).alias("pairs")), "toxicity-words")
    release(spark)
    kinds = lambda c, t: F.count_if(F.col(c) == t)
    totals = by_word.agg(
        *[F.sum(c).alias(c) for c in ("n0", "n1", "contexts", "pair_ones0", "pair_twos0", "pair_ones1", "pair_twos1")], F.count(F.lit(1)).alias("kinds"),
        kinds("contexts", 1).alias("cont_ones"), kinds("contexts", 2).alias("cont_twos"),
        *[f for k in (0, 1) for f in (F.count_if(F.col(f"n{k}") > 0).alias(f"kinds{k}"), kinds(f"n{k}", 1).alias(f"ones{k}"), kinds(f"n{k}", 2).alias(f"twos{k}"))],
    ).first().asDict()
    if not (totals["n0"] and totals["n1"]):  # one class was never met: nothing can be compared
        remove(by_word)
        return Learned(spark.createDataFrame([], "before bigint, word bigint, value double"), 0, 0.0)

    d, n_kinds = discount(totals["cont_ones"], totals["cont_twos"]), totals["kinds"]
    shared = (F.col("contexts") - d + d * n_kinds / (n_kinds + 1)) / float(totals["contexts"])
    chances = by_word.withColumn("q", shared)
    for k in (0, 1):
        n, dk = float(totals[f"n{k}"]), discount(totals[f"ones{k}"], totals[f"twos{k}"])
        chances = chances.withColumn(f"p{k}", F.greatest(F.col(f"n{k}") - dk, F.lit(0.0)) / n + F.col("q") * (dk * totals[f"kinds{k}"] / n))
    owned = F.col("statistic") >= DISTINCT
    taken = chances.where(owned).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("q", "p0", "p1")]).first()
    rest = [max(1 - taken[f"p{k}"], 1e-12) / max(1 - taken["q"], 1e-12) for k in (0, 1)]
    other = float(np.log(rest[1] / rest[0]))
    chances = chances.withColumns({f"p{k}": F.when(owned, F.col(f"p{k}")).otherwise(F.col("q") * rest[k]) for k in (0, 1)})

    dk = [discount(totals[f"pair_ones{k}"], totals[f"pair_twos{k}"]) for k in (0, 1)]
    found = [F.greatest(F.col(f"p.n{k}") - dk[k], F.lit(0.0)).alias(f"found{k}") for k in (0, 1)]
    pairs = chances.select("word", "p0", "p1", F.explode("pairs").alias("p")).select("p.before", "word", "p0", "p1", *found)
    # Every word has one behind it, if only the end of the text; the start of a text comes as often as there are texts.
    start = spark.createDataFrame([(int(START), *docs)], "word bigint, n0 bigint, n1 bigint")
    after = by_word.select("word", "n0", "n1").unionByName(start).withColumnRenamed("word", "after")
    left = pairs.groupBy("before").agg(F.sum(F.col("found0") + F.col("found1")).alias("found")).join(after, F.col("before") == F.col("after")).select(
        "after", F.col("n0").cast("double"), F.col("n1").cast("double"), (1 - F.col("found") / (F.col("n0") + F.col("n1"))).alias("left"))
    seen = lambda k: F.when(F.col(f"n{k}") > 0, F.col(f"found{k}") / F.col(f"n{k}")).otherwise(0.0) + F.col("left") * F.col(f"p{k}")
    of_pairs = pairs.join(left, F.col("before") == F.col("after")).select("before", "word", (F.log(seen(1) / seen(0)) - F.log(F.col("p1") / F.col("p0"))).alias("value"))
    of_words = chances.where(owned).select(F.lit(int(NONE)).cast("bigint").alias("before"), "word", (F.log(F.col("p1") / F.col("p0")) - other).alias("value"))
    entries = written(of_words.unionByName(of_pairs), "toxicity-model")
    remove(by_word)
    return Learned(entries, entries.count(), other)


def differences(rows: DataFrame, learned: Learned) -> DataFrame:
    """id, difference for every row of ``rows`` (id, text).

    A model larger than one broadcast takes one reading of the texts for each piece of it; what the pieces tell is stored by id and hash of the
    text, and added up.  Rows that are equal in both have equal differences.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()

    def told(model: Model) -> DataFrame:
        shared = spark.sparkContext.broadcast(model)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in column_chunks(batches):
                features = pa.array(shared.value.features(batch.column(batch.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], features], [*batch.schema.names[:-1], "difference"])

        if learned.pieces == 1:
            return rows.select("id", "text").mapInArrow(measured, f"id {kind}, difference double")
        one = written(rows.select("id", F.xxhash64("text").alias("hash"), "text").mapInArrow(measured, f"id {kind}, hash bigint, difference double"), "toxicity-piece")
        shared.unpersist()
        return one

    parts = [told(model).withColumn("piece", F.lit(i)) for i, model in enumerate(learned.models())]
    if len(parts) == 1:
        return parts[0].select("id", "difference")
    times = F.count_if(F.col("piece") == 0)
    whole = reduce(DataFrame.unionByName, parts).groupBy("id", "hash").agg((F.sum("difference") / times).alias("difference"), times.alias("n"))
    return whole.select("id", "difference", F.explode(F.sequence(F.lit(1), F.col("n")))).select("id", "difference")


def _design(features: np.ndarray) -> np.ndarray:
    """Constant, and differences of very different size brought to one scale, in their order."""
    return np.stack([np.ones(len(features)), np.arcsinh(np.asarray(features, dtype=float) * 100)], axis=1)


def calibrate(known: DataFrame) -> np.ndarray:
    """Coefficients of a logistic curve in the difference, by Newton steps with a slight pull to zero; known: difference, toxic.

    A step needs five sums over all rows, so any number of them may teach.
    """
    rows, beta = known.select(F.asinh(F.col("difference") * 100).alias("x"), F.col("toxic").cast("double").alias("y")), np.zeros(2)
    for _ in range(50):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("x") * float(beta[1]) + float(beta[0])))
        at = rows.withColumn("p", 1 / (1 + F.exp(-z))).select("x", (F.col("y") - F.col("p")).alias("off"), (F.col("p") * (1 - F.col("p"))).alias("w"))
        total = [F.sum(c) for c in (F.col("w"), F.col("w") * F.col("x"), F.col("w") * F.col("x") * F.col("x"), F.col("off"), F.col("off") * F.col("x"))]
        w, wx, wxx, off, offx = at.agg(*[F.coalesce(t, F.lit(0.0)) for t in total]).first()
        step = np.linalg.solve(np.array([[w, wx], [wx, wxx]]) + np.eye(2) * 1e-2, np.array([off, offx]) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) teaches only where crc32(doc_id) mod 5 is not 0: remainders 2 to 4 give the counts (all such rows), remainder
    1 the calibration, which only sets where the curve of the scores has its middle and how steep it is.  A doc_id labelled twice counts as toxic if
    one label does; null labels teach nothing.  Only the text is scored: a null, empty or wordless text is its end alone; repeated rows have
    equal scores.  Without labels every score is 0.5 and everything is predicted 1, as the rule score >= 0.5 says.

    Texts of labelled rows and the counts of their words and pairs are shuffled.  The model is broadcast in pieces of about ``PIECE`` entries.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    known = (
        labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("_fold", F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(5)))
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))

    def with_text(some: DataFrame) -> DataFrame:
        # Labels grow with the corpus, so they are never broadcast, however few they are.
        return maybe_in(texts, "doc_id", some, "_id").join(some.hint("merge"), F.col("doc_id") == F.col("_id")).select("text", "toxic")

    taught = known.where("_fold > 1")
    rows = texts.select("doc_id").join(taught.hint("merge"), F.col("doc_id") == F.col("_id")).groupBy("toxic").count().collect()
    numbers = {r["toxic"]: r["count"] for r in rows}
    learned = learn(with_text(taught), (numbers.get(0, 0), numbers.get(1, 0)))

    fitting = with_text(known.where("_fold = 1")).select(F.col("toxic").alias("id"), "text")
    fitted = written(differences(fitting, learned).withColumnRenamed("id", "toxic"), "toxicity-fitted")
    release(spark)
    beta = calibrate(fitted)
    remove(fitted)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _design(batch.column(1).to_numpy(zero_copy_only=False)) @ beta
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], ["doc_id", "score"])

    out = differences(texts.withColumnRenamed("doc_id", "id"), learned).mapInArrow(scored, "doc_id bigint, score double")
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
