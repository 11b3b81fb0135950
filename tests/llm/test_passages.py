"""Passages that occur in an earlier document, against plain windows."""

import random

import pytest

from settlespark.llm import substring_dedup as sd

from llm_cases import sentence


def _split(text):
    return (text or "").encode().split()


def _brute(rows, length):
    """rows: (doc_id, text) in any order, ids may repeat."""
    first = {}
    for i, text in rows:
        words = _split(text)
        for a in range(len(words) - length + 1) if i is not None else ():
            w = tuple(words[a:a + length])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        words = _split(text)
        gone = set()
        for a in range(len(words) - length + 1) if i is not None else ():
            if first[tuple(words[a:a + length])] < i:
                gone.update(range(a, a + length))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def _found(spark, rows, parts=3):
    table = spark.createDataFrame([(i, t, "s", "b", "w", 1) for i, t in rows], "doc_id long, text string, spans string, body string, found string, n int")
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in sd.remove_passages(table.repartition(parts)).collect()), key=str)


def _documents():
    rnd = random.Random(8)
    shared = [sentence(rnd, n) for n in (50, 49, 51, 120, 400)]
    texts = {0: None, 1: "", 2: " \t\n\x0b ", 3: "one", 4: "ß€😀 x\x85y z " * 30, 5: "a " * 300, 6: "a " * 200, 7: "b " + "a " * 49 + "c", 8: "x" * 5000}
    for i in range(10, 80):
        parts = [sentence(rnd, rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 3)):
            words = rnd.choice(shared).split(" ")
            if rnd.random() < 0.5:
                words[rnd.randrange(len(words))] = "edited"
            parts += [" ".join(words), sentence(rnd, rnd.randint(0, 60))]
        texts[i] = "\n".join(parts)
    texts[80] = " ".join(sentence(rnd, 500) for _ in range(20))
    texts[81] = " ".join(texts[80].split(" ")[777:5000])
    rows = list(texts.items()) + [(20, texts[20]), (20, texts[21]), (None, texts[22]), (None, texts[80])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("changes", [{}, {"WIDE": 0}, {"WIDE": 3, "SHARD_WORDS": 100, "HOT_SHARE": 4}, {"STRETCH": 256, "SPLIT": 40}])
def test_passages_equal_brute_force(spark, monkeypatch, changes):
    for name, value in changes.items():
        monkeypatch.setattr(sd, name, value)
    rows = _documents()
    expected = _brute(rows, sd.LENGTH)
    assert sum(r[2] for r in expected) > 3000
    # Workers import the module anew: what is changed here holds in the plan and in the functions called below.
    assert _found(spark, rows) == expected


@pytest.mark.parametrize("changes", [{}, {"STRETCH": 256, "SPLIT": 40}])
def test_words_and_passages_in_small_stretches(monkeypatch, changes):
    for name, value in changes.items():
        monkeypatch.setattr(sd, name, value)
    for _, text in _documents():
        assert [w for part in sd.split_words(text or "") for w in part] == _split(text)
    ids = [sd.word_ids(text or "") for _, text in _documents()]
    seen = [set() for _ in ids]
    for words, valid, owner, place in sd._stretches(ids):
        for a, n in zip(*(c.tolist() for c in sd.passages(words, valid)[:2])):
            for start in range(int(place[a]), int(place[a]) + n):
                assert start not in seen[owner[a]]
                seen[owner[a]].add(start)
                assert (words[a + start - place[a]:][: sd.LENGTH] == ids[owner[a]][start:start + sd.LENGTH]).all()
    assert [len(s) for s in seen] == [max(0, len(i) - sd.LENGTH + 1) for i in ids]


def test_no_documents(spark):
    assert _found(spark, []) == []


def test_automaton_tells_the_first_document_of_every_window():
    rnd = random.Random(9)
    for length in (1, 2, 5):
        texts = [[rnd.randint(0, 2) for _ in range(rnd.randint(0, 40))] for _ in range(12)]
        automaton = sd.SuffixAutomaton()
        for number, words in enumerate(texts[:9]):
            automaton.add(words, 100 - number)
        automaton.finish()
        for words in texts:
            expected = []
            for a in range(len(words) - length + 1):
                met = [100 - k for k, other in enumerate(texts[:9]) for b in range(len(other) - length + 1) if other[b:b + length] == words[a:a + length]]
                expected.append(min(met) if met else None)
            assert automaton.first_documents(words, length) == expected
