"""Duplicate operators against brute force on small tables."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from llm_cases import sentence
from settlespark.llm import jaccard, line_dedup, suffix_dedup, vectors
from settlespark.llm.common import components, joined_where_present
from settlespark.llm.suffix_array import common_prefixes, suffix_array


def _roots(nodes, links):
    up = {n: n for n in nodes}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_paths_stars_and_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(250)] + [(5, 5)]
    nodes = {n for e in edges for n in e}
    plain = {n: r for n, r in _roots(nodes, edges).items() if n != r}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == plain and len(found) == len(plain)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_join_where_present(spark):
    rows = spark.createDataFrame([(i % 50 if i % 9 else None, i) for i in range(200)], "id long, n long")
    facts = spark.createDataFrame([(i, str(i)) for i in range(0, 60, 7)], "k long, fact string")
    found = sorted((r.n, r.id, r.found.fact if r.found else None) for r in joined_where_present(rows, "id", facts, "k", "found").collect())
    assert found == sorted((i, v, str(v) if v is not None and v % 7 == 0 else None) for i in range(200) for v in [i % 50 if i % 9 else None])


# n-gram join


def _shingles(text, n):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def _brute_join(cases, n, percent):
    sets = {i: _shingles(t, n) for i, t in cases.items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(s), r) for (i, s), r in zip(sets.items(), _roots(sets, links).values())}


@pytest.mark.parametrize("n, percent, block", [(4, 85, 1_000_000), (5, 80, 300)])
def test_join_equals_brute_force(docs, cases, n, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", block)
    found = jaccard.join(docs, n, percent).collect()
    assert len(found) == len(cases)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == _brute_join(cases, n, percent)


def test_join_of_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 4000)
    rnd = random.Random(8)
    base = sentence(rnd, 60).split()
    rows = {i: sentence(rnd, rnd.randint(1, 80)) for i in range(120)}
    for i in range(500, 680):
        words = list(base)
        words[rnd.randrange(60)] = f"w{rnd.randint(0, 5)}"
        rows[i] = " ".join(words) if i % 3 else " ".join(base)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    found = jaccard.join(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == _brute_join(rows, 4, 85)
    kept = jaccard.keep_one(docs, 4, 85)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.doc_id == r.component_id}


def test_parts_of_similar_sets_always_meet():
    rnd = random.Random(6)
    for _ in range(400):
        size = rnd.choice([1, 3, 6, 7, 12, 40, 150, 600])
        a = {rnd.getrandbits(64) for _ in range(size)}
        b = set(rnd.sample(sorted(a), len(a) - rnd.randint(0, len(a) // 8))) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, size // 10))}
        if 100 * len(a & b) >= 85 * len(a | b):
            x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
            assert np.intersect1d(jaccard.signatures(x, 85), jaccard.signatures(y, 85)).size


def test_tree_links_equal_all_pairs():
    rnd = random.Random(3)
    for _ in range(80):
        bases = [rnd.sample(range(200), rnd.randint(1, 60)) for _ in range(3)]
        sets = []
        for _ in range(rnd.randint(2, 40)):
            s = set(rnd.choice(bases))
            s = set(rnd.sample(sorted(s), max(1, len(s) - rnd.randint(0, 6)))) | {rnd.randint(0, 400) for _ in range(rnd.randint(0, 6))}
            sets.append(s)
        ids = rnd.sample(range(1000), len(sets))
        a, b = jaccard.similar_within(ids, [np.array(sorted(s), dtype=np.uint64) for s in sets], 85)
        links = [(ids[i], ids[j]) for i, j in combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        plain = _roots(sorted(ids), links)
        assert {i: dict(zip(a.tolist(), b.tolist())).get(i, i) for i in ids} == plain


def test_join_empty_table(no_docs):
    assert jaccard.join(no_docs).collect() == [] and jaccard.keep_one(no_docs).collect() == []


# repeated strings


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(5)
    for _ in range(150):
        k = rnd.choice([1, 2, 3, 20])
        s = [rnd.randint(1, k) for _ in range(rnd.randint(1, 300))] * rnd.choice([1, 1, 5]) + [0]
        x = np.array(s)
        sa = suffix_array(x, k + 1)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared = common_prefixes(x, sa, 10)
        for a, b in zip(sa[1:].tolist(), sa[:-1].tolist()):
            n = 0
            while n < 10 and a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert shared[a] == n


def _brute_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        t = (texts[i] or "").encode()
        gone = bytearray(len(t))
        for at in range(len(t) - 99):
            if t[at:at + 100] in seen:
                gone[at:at + 100] = b"\1" * 100
            seen.add(t[at:at + 100])
        runs = sum(1 for at in range(len(t)) if gone[at] and (at == 0 or not gone[at - 1]))
        out[i] = (len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g))
    return out


def _found_repeats(docs):
    return {r.doc_id: (r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends)), len(r.starts), bytes(r.kept_bytes)) for r in suffix_dedup.remove_repeats(docs).collect()}


@pytest.mark.parametrize("wide", [20_000, 3])
def test_repeats_equal_brute_force(spark, docs, cases, wide, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    assert _found_repeats(docs) == _brute_repeats(cases)
    rnd = random.Random(2)
    stuff = lambda n: "".join(rnd.choice("abcd") for _ in range(n))
    parts = [stuff(rnd.randint(90, 400)) for _ in range(12)] + ["a" * 300, "ab" * 200]
    texts = {i * 7 - 50: "".join(rnd.choice(parts) if rnd.random() < 0.6 else stuff(rnd.randint(1, 150)) for _ in range(rnd.randint(0, 8))) for i in range(120)}
    assert _found_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)) == _brute_repeats(texts)


def test_repeats_in_texts_longer_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    suffix_dedup._powers.cache_clear()
    rnd = random.Random(12)
    long = "".join(rnd.choice("abcdef") for _ in range(5000))
    texts = {1: long, 2: "x" + long[1200:4100] + "y", 3: long[300:600] + long[300:600]}
    try:
        assert _found_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == _brute_repeats(texts)
    finally:
        suffix_dedup._powers.cache_clear()


def test_repeated_rows_and_rows_without_id_stay_whole(spark, no_docs):
    text = " ".join(f"word{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    found = [(r.doc_id, len(r.starts)) for r in suffix_dedup.remove_repeats(rows).collect()]
    assert sorted(found, key=str) == [(1, 0), (1, 0), (2, 1), (None, 0)]
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


# lines


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_keep_one_occurrence_of_each_group(spark, docs, cases):
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(found) == len(cases)
    norm = lambda s: re.sub(r"[\W_]+", " ", s).lower().strip()
    lines = [(i, p, norm(s)) for i, t in cases.items() for p, s in enumerate((t or "").split("\n"))]
    long = [x for x in lines if len(x[2].split()) >= line_dedup.LEAST_WORDS]
    first = {}
    for x in sorted(long):
        first.setdefault(x[2], x)
    gone = {(r.doc_id, r.pos) for r in line_dedup.removals(docs).collect()}
    # Every exact repetition goes; what goes beside it is near to a line that stays or to another that goes.
    assert {x[:2] for x in long if first[x[2]] != x} <= gone
    for i, p, s in long:
        if (i, p) in gone and first[s] == (i, p, s):
            a = s.split()
            assert any(_edits(a, t.split()) <= 0.2 * max(len(a), len(t.split())) for t in first if t != s)
    for i, t in cases.items():
        kept = "\n".join(s for p, s in enumerate((t or "").split("\n")) if (i, p) not in gone)
        assert (found[i].text or "") == kept and (found[i].text is None) == (t is None)


def test_fuzzy_lines_are_found_and_other_lines_stay(spark):
    rnd = random.Random(4)
    prose = [sentence(rnd, 40) for _ in range(60)]
    rows = [(i, f"{s}\nshort one") for i, s in enumerate(prose)] + [(100 + i, s.upper().replace(" ", ",  ", 3)) for i, s in enumerate(prose[:20])]
    rows += [(200 + i, s[:50] + "x" + s[50:]) for i, s in enumerate(prose[20:40])]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i].n_removed == 0 for i in range(60))
    assert all(found[100 + i].text == "" for i in range(20))
    assert sum(found[200 + i].text == "" for i in range(20)) >= 14


def test_lines_empty_table(no_docs):
    assert line_dedup.dedup_lines(no_docs).collect() == []


# embeddings


def _check_vectors(frame):
    rows, found = frame.collect(), {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
    assert len(found) == len(rows)
    fine = [r for r in rows if r.embedding and r.label is not None and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    links = []
    for a, b in combinations(fine, 2):
        if a.label == b.label and len(a.embedding) == len(b.embedding):
            x, y = np.array(a.embedding, float), np.array(b.embedding, float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= vectors.LEAST_COSINE:
                links.append((a.vec_id, b.vec_id))
    roots = _roots([r.vec_id for r in rows], links)
    degree = {r.vec_id: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert all(r.n_links <= degree[i] for i, r in found.items())
    assert sum(r.n_links for r in found.values()) >= 0.95 * sum(degree.values())
    assert sum(r.component_id == roots[i] and r.kept == (roots[i] == i) for i, r in found.items()) >= 0.99 * len(rows)
    return found


def _vectors(spark):
    rng = np.random.default_rng(1)
    unit = rng.normal(size=8)
    rows = [(i, [float(v) for v in rng.normal(size=8)], int(i % 3) if i % 50 else None) for i in range(400)]
    rows += [(i, [float(v) for v in unit + rng.normal(size=8) * 0.05], 1) for i in range(400, 560)]
    rows += [(i, [float(v) for v in unit], 1) for i in range(560, 590)]
    rows += [(950, None, 1), (951, [0.0] * 8, 1), (952, [float("nan")] * 8, 1), (953, [None] + [1.0] * 7, 1), (954, [1.0, 2.0], 1), (955, [2.0, 4.0], 1), (956, [], 1), (957, [float("inf")] * 8, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [1500, 60])
def test_vectors_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "PER_PIVOT", 60)
    found = _check_vectors(_vectors(spark))
    assert found[955].component_id == 954 and found[951].n_links == 0


def test_vector_recall_is_audited(spark):
    frame = _vectors(spark)
    r = vectors.audit(frame, vectors.near_duplicates(frame)).first()
    assert r.true_links and r.found_links >= 0.9 * r.true_links
    assert vectors.near_duplicates(frame.limit(0)).collect() == []


def test_graph_reaches_everything():
    x = np.random.default_rng(3).normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = vectors.graph_lists(x)
    reached, todo = set(), [vectors.medoid(x)]
    while todo:
        i = todo.pop()
        if i not in reached:
            reached.add(i)
            todo += lists[i].tolist()
    assert len(reached) == 300
