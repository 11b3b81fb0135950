"""Secret scans: base formats, and probabilistic automata inferred from the credentials that these find."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from settlespark.llm.common import column_chunks, text_of
from settlespark.session import written

# The base formats and their least lengths.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# Candidates lie in long runs of the characters credentials are made of.  One begins at the start of its run or after a separator, ends before
# one or with the run, and has letters and digits; shorter ones cannot be told from ordinary names.
LEAST_CANDIDATE = 16
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CANDIDATE)
SEPARATORS = "=/.-"
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

#: Credentials of each kind that an automaton is fitted on and, as many again, judged on: those with the least hashes.
FITTED = 1500
#: Confidence of the tests that forbid a merge, and the share of judged credentials that a candidate must not fall below.
ALPHA, LEAST_SHARE = 0.05, 0.05

SCANNED = (
    "doc_id bigint, base array<struct<kind:string,start:int,end:int,value:string>>, candidates array<struct<start:int,end:int,value:string>>"
)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Base matches (kind, start, end, credential), each kind leftmost and non-overlapping; failing ones are used up and dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LEAST]
    return found


def scan_text(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base matches, and the runs in which candidates may lie: those with letters and digits that no base match covers whole."""
    base, runs = base_spans(text), []
    for run in RUN.finditer(text):
        # A hexadecimal match of 24 characters lies inside one run.
        base += [("hex", run.start() + m.start(), run.start() + m.end(), m.group()) for m in HEX.finditer(run.group()) if len(m.group()) >= HEX_LEAST]
        if _DIGIT.search(run.group()) and _LETTER.search(run.group()):
            runs.append((run.start(), run.end(), run.group()))
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return base, [r for r, inside in zip(runs, _covered(runs, base)) if not inside]


def _covered(spans: list[tuple], base: list[tuple]) -> list[bool]:
    """Whether one base match covers each of the spans (in order of their start); both lists are gone through once."""
    out, at, end = [], 0, 0
    for start, stop, *_ in spans:
        while at < len(base) and base[at][1] <= start:
            end = max(end, base[at][2])
            at += 1
        out.append(stop <= end)
    return out


def shape(value: str) -> str:
    """Symbols of the automata: upper case, lower case up to f and beyond, digits, and every other character itself."""
    return "".join("A" if "A" <= c <= "Z" else "f" if "a" <= c <= "f" else "z" if "g" <= c <= "z" else "0" if "0" <= c <= "9" else c for c in value)


class Automaton:
    """A deterministic probabilistic automaton, inferred by merging compatible states of a prefix tree."""

    def __init__(self, samples: list[str]):
        self.ends: list[int] = [0]
        self.next: list[dict[str, list[int]]] = [{}]  # symbol -> [state, count]
        for sample in samples:
            at = 0
            for symbol in sample:
                edge = self.next[at].get(symbol)
                if edge is None:
                    self.ends.append(0)
                    self.next.append({})
                    edge = self.next[at][symbol] = [len(self.ends) - 1, 0]
                edge[1] += 1
                at = edge[0]
            self.ends[at] += 1
        self._merge()

    def total(self, state: int) -> int:
        return self.ends[state] + sum(e[1] for e in self.next[state].values())

    def _compatible(self, a: int, b: int) -> bool:
        scale = math.sqrt(0.5 * math.log(2 / ALPHA))
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            bound = scale * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:
                continue  # no frequencies can differ by more, here or below
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            one, other = self.next[a], self.next[b]
            for symbol in sorted(one.keys() | other.keys()):
                p, q = one.get(symbol), other.get(symbol)
                if abs((p[1] if p else 0) / n - (q[1] if q else 0) / m) > bound:
                    return False
                if p and q and p[0] != q[0]:
                    stack.append((p[0], q[0]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        stack = [(into, tree)]
        while stack:
            into, tree = stack.pop()
            self.ends[into] += self.ends[tree]
            for symbol, (child, count) in self.next[tree].items():
                edge = self.next[into].get(symbol)
                if edge is None:
                    self.next[into][symbol] = [child, count]
                else:
                    edge[1] += count
                    stack.append((edge[0], child))

    def _merge(self) -> None:
        kept = [0]
        while True:
            inside = set(kept)
            fringe = [(-edge[1], state, symbol) for state in kept for symbol, edge in self.next[state].items() if edge[0] not in inside]
            if not fringe:
                break
            _, state, symbol = min(fringe)
            edge = self.next[state][symbol]
            target = next((k for k in kept if self._compatible(k, edge[0])), None)
            if target is None:
                kept.append(edge[0])
            else:
                tree, edge[0] = edge[0], target
                self._fold(target, tree)
        place = {s: i for i, s in enumerate(kept)}
        self.ends, self.next = [self.ends[s] for s in kept], [{c: [place[e[0]], e[1]] for c, e in self.next[s].items()} for s in kept]
        self.totals = [self.total(s) for s in range(len(kept))]

    def likelihood(self, sample: str, symbols: int = 12, little: float = 0.05) -> float:
        """Mean log-likelihood of a symbol of ``sample``, its end included; what was never seen gets a little."""
        at, sum_ = 0, 0.0
        for symbol in sample:
            n = self.total(at) if at >= 0 else 0
            edge = self.next[at].get(symbol) if at >= 0 else None
            sum_ += math.log(((edge[1] if edge else 0) + little) / (n + little * symbols))
            at = edge[0] if edge else -1
        sum_ += math.log(((self.ends[at] if at >= 0 else 0) + little) / ((self.total(at) if at >= 0 else 0) + little * symbols))
        return sum_ / (len(sample) + 1)


    def furthest(self, sample: str, start: int, ends: list[int], least: float, symbols: int = 12, little: float = 0.05) -> int | None:
        """The last of the ends (rising) up to which ``sample`` from ``start`` on has at least the likelihood, or none.

        One walk, with the sums of ``likelihood``.  It stops where nothing can become likely again: outside all states every further symbol
        costs the same, so a mean below the least that is no better than that cost stays below.
        """
        lost = math.log(little / (little * symbols))
        at, sum_, found, nth = 0, 0.0, None, 0
        for place in range(start, len(sample) + 1):
            while nth < len(ends) and ends[nth] < place:
                nth += 1
            if nth == len(ends):
                break
            if ends[nth] == place:
                last = math.log(((self.ends[at] if at >= 0 else 0) + little) / ((self.totals[at] if at >= 0 else 0) + little * symbols))
                if sum_ + last >= least * (place - start + 1):
                    found = place
            if place == len(sample):
                break
            edge = self.next[at].get(sample[place]) if at >= 0 else None
            sum_ += math.log(((edge[1] if edge else 0) + little) / ((self.totals[at] if at >= 0 else 0) + little * symbols))
            at = edge[0] if edge else -1
            if at < 0 and lost <= least and sum_ < least * (place - start + 1):
                break
        return found


class Formats:
    """One automaton for each kind of credential, with the least likelihood that counts as its format."""

    def __init__(self, credentials: list[tuple[str, str]]):
        self.known = []
        for kind in KINDS[:-1]:
            values = [shape(v) for k, v in credentials if k == kind]
            fit, judge = values[0::2], values[1::2]
            if len(judge) >= 10:
                automaton = Automaton(fit)
                likely = sorted(automaton.likelihood(v) for v in judge)
                self.known.append((automaton, likely[int(len(likely) * LEAST_SHARE)]))

    def accepted(self, run: str) -> list[tuple[int, int]]:
        """The candidates of a run that some automaton accepts: from the left, at each start the longest, none overlapping another."""
        cuts = [i for i, c in enumerate(run) if c in SEPARATORS]
        ends, shaped, out, at = [*cuts, len(run)], shape(run), [], 0
        for start in (0, *[i + 1 for i in cuts]):
            if start < at or len(run) - start < LEAST_CANDIDATE:
                continue
            # The first end of a long enough candidate with a letter and a digit; what begins there and goes on has them too.
            digit, letter = _DIGIT.search(run, start), _LETTER.search(run, start)
            if not digit or not letter:
                break
            least = max(start + LEAST_CANDIDATE, digit.end(), letter.end())
            long_enough = ends[bisect_left(ends, least):]
            best = max((e for a, likely in self.known if (e := a.furthest(shaped, start, long_enough, likely)) is not None), default=None)
            if best is not None:
                out.append((start, best))
                at = best
        return out

    def spans(self, base: list[tuple], runs: list[tuple]) -> list[tuple[str, int, int]]:
        """The format spans of a text: accepted candidates that no base match covers whole."""
        found = [(start + a, start + b) for start, _, run in runs for a, b in self.accepted(run)]
        return [("format", a, b) for (a, b), inside in zip(found, _covered(found, base)) if not inside]


def _scan(docs: DataFrame) -> DataFrame:
    """Base matches and candidates of every row, from one pass over the texts, written to the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        for batch in column_chunks(batches):
            found = [scan_text(t) for t in batch.column(1).to_pylist()]
            base = [[dict(zip(("kind", "start", "end", "value"), s)) for s in f[0]] for f in found]
            runs = [[dict(zip(("start", "end", "value"), c)) for c in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(runs, run_type)], ["doc_id", "base", "candidates"])

    return written(docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(work, SCANNED), "secret-scan")


def _infer(scanned: DataFrame) -> Formats:
    """Automata of the base credentials of all documents, up to 3,000 distinct ones per kind, those with the least hashes."""
    credentials = scanned.select(F.explode("base").alias("b")).select("b.kind", "b.value").distinct()
    sample = None
    for kind in KINDS[:-1]:
        part = credentials.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(2 * FITTED)
        sample = part if sample is None else sample.unionByName(part)
    return Formats([(r["kind"], r["value"]) for r in sample.collect()])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points, by start and then kind) for every row of ``docs`` (doc_id, text).

    ``base`` has the base formats; ``spans`` has these and, as kind "format", the candidates that are as likely under the automaton of some kind
    as nineteen in twenty of that kind's own credentials.  Candidates are all parts of at least 16 characters of a run of credential characters, between
    its ends and inner separators, with a letter and a digit; of overlapping ones the leftmost and there the longest counts, and one that a base
    match covers whole adds nothing.  A null or empty text has no spans; repeated rows have equal
    spans; with fewer than 20 credentials of a kind there is no automaton for it.

    Texts are read once; the few spans and candidates are written to the shared folder and the rest runs on them.
    """
    scanned = _scan(docs)
    formats = docs.sparkSession.sparkContext.broadcast(_infer(scanned))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans, known = [], []
            for base, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [{k: s[k] for k in ("kind", "start", "end")} for s in base]
                more = formats.value.spans([(s["kind"], s["start"], s["end"]) for s in base], [(r["start"], r["end"], r["value"]) for r in runs])
                known.append(own)
                spans.append(sorted(own + [dict(zip(("kind", "start", "end"), s)) for s in more], key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, span_type), pa.array(spans, span_type)], ["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return scanned.mapInArrow(judge, f"doc_id bigint, base {spans}, spans {spans}")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span in ``text`` replaced by a mark; other columns and null texts unchanged.

    The automata are inferred in a first pass; the second finds and replaces where the text is, without a shuffle.
    """
    formats = docs.sparkSession.sparkContext.broadcast(_infer(_scan(docs)))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_chunks(batches):
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    base, runs = scan_text(text)
                    spans = [s[:3] for s in base] + formats.value.spans(base, runs)
                    text = redact_text(text, [dict(zip(("kind", "start", "end"), s)) for s in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))])
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(work, docs.schema)


def redact_text(text: str, spans: list[dict]) -> str:
    """The text with every span, overlapping ones as one, replaced by a mark of the first kind in it."""
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at:s["start"]], f"<{s['kind']} removed>"]
        at = s["end"]
    return "".join(out) + text[at:]


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest and all spans as one string."""
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS[:-1]], F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
