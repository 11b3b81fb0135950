"""The language models behind the toxicity score: equal to plain counting, and pairs of ordinary words speak."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from settlespark.llm import toxicity

WORDS = [f"w{c}" for c in "abcdefghijklmnopqrst"]


def _texts(n: int) -> list[tuple[str, int]]:
    """Both classes use "wa" and "wb" alike, but only toxic texts have them one after the other."""
    rnd, rows = random.Random(23), []
    for i in range(n):
        toxic = int(i % 3 == 0)
        words = [rnd.choice(WORDS[2:]) for _ in range(rnd.randint(10, 40))]
        for x in (["wa wb"] if toxic else ["wa", "wb"]):
            words.insert(rnd.randrange(1, len(words)), x)
        text = " ".join(words)
        if not toxic:
            text = text.replace("wa wb", "wa wc wb")
        rows.append((text, toxic))
    return rows


def _plain(rows: list[tuple[str, int]]):
    """The evidence of (word before, word) by dictionaries of words."""
    n, docs, size = (Counter(), Counter()), (Counter(), Counter()), Counter(y for _, y in rows)
    for text, y in rows:
        words = [*text.split(), "</s>"]
        met = [(None, w) for w in words] + list(zip(["<s>", *words], words))
        n[y].update(met)
        docs[y].update(set(met))

    def own(x):
        a, b, total = docs[0][x], docs[1][x], 0.0
        share = (a + b) / (size[0] + size[1])
        for o, e in ((a, share * size[0]), (size[0] - a, (1 - share) * size[0]), (b, share * size[1]), (size[1] - b, (1 - share) * size[1])):
            total += o * math.log(o / e) if o else 0
        return 2 * total >= toxicity.DISTINCT

    def off(values):
        ones, twos = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return ones / (ones + 2 * twos) if ones and twos else 0.75

    kinds = {x for k in (0, 1) for x in n[k]}
    words, pairs = {w for c, w in kinds if c is None}, {x for x in kinds if x[0] is not None}
    contexts = Counter(w for _, w in pairs)
    d = off(contexts.values())
    q = {w: (contexts[w] - d + d * len(words) / (len(words) + 1)) / len(pairs) for w in words}
    owned, paired = {w for w in words if own((None, w))}, {x for x in pairs if own(x)}
    p = []
    for k in (0, 1):
        mine = {w: n[k][None, w] for w in words if n[k][None, w]}
        total, dk = sum(mine.values()), off(mine.values())
        chance = {w: max(mine.get(w, 0) - dk, 0) / total + dk * len(mine) / total * q[w] for w in owned}
        rest = (1 - sum(chance.values())) / (1 - sum(q[w] for w in owned))
        p.append({w: chance.get(w, rest * q[w]) for w in words})
        assert abs(sum(p[k].values()) + rest * (1 - sum(q.values())) - 1) < 1e-9
    dk = [off([v for x, v in n[k].items() if x[0] is not None]) for k in (0, 1)]
    follow = [defaultdict(int), defaultdict(int)]
    for k in (0, 1):
        for (c, _), v in n[k].items():
            follow[k][c] += v
    left = {c: 1 - sum(max(n[k][x] - dk[k], 0) for x in paired if x[0] == c for k in (0, 1)) / (follow[0][c] + follow[1][c]) for c, _ in paired}

    def evidence(c, w):
        if (c, w) not in paired:
            return math.log(p[1][w] / p[0][w])
        one, zero = ((max(n[k][c, w] - dk[k], 0) / follow[k][c] if follow[k][c] else 0) + left[c] * p[k][w] for k in (1, 0))
        return math.log(one / zero)

    return evidence, paired


def test_evidence_equals_plain_counting(spark):
    rows = _texts(300)
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int").repartition(5), (200, 100))
    evidence, paired = _plain(rows)
    assert ("wa", "wb") in paired and len(model.pairs) == len(paired)
    wanted = []
    for text, _ in rows:
        words = [*text.split(), "</s>"]
        wanted.append(np.mean([evidence(c, w) for c, w in zip(["<s>", *words], words)]))
    assert np.allclose(model.features([t for t, _ in rows]), wanted, rtol=0, atol=1e-9)


def test_pairs_of_ordinary_words_are_enough(spark):
    rows = _texts(1500)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out for i in held) and sum(found[i].predicted == rows[i][1] for i in held) >= 0.97 * len(held)


def test_a_model_larger_than_one_broadcast_is_whole(spark, monkeypatch):
    """Nothing of it is left out: scores are those of a model in one piece, also of rows that are there twice or have no text."""
    rows = _texts(600)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(3, rows[3][0]), (3, "wa wb"), (9000, None), (None, "wa wb")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    told = lambda: sorted((-1 if r.doc_id is None else r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, labels).collect())
    whole = told()
    learned = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"), (400, 200))
    monkeypatch.setattr(toxicity, "PIECE", -(-learned.size // 3))
    learned = toxicity.Learned(learned.entries, learned.size, learned.rest)
    assert learned.pieces > 1 and learned.size == sum(len(m.words) + len(m.pairs) for m in learned.models())
    pieces = told()
    assert len(pieces) == len(rows) + 4
    assert [(i, p) for i, _, p in pieces] == [(i, p) for i, _, p in whole] and np.allclose([s for _, s, _ in pieces], [s for _, s, _ in whole], rtol=0, atol=1e-9)


def test_all_rows_of_the_fold_calibrate(spark):
    """The sums of a step are those of all rows: equal to the steps in one process."""
    rnd = random.Random(3)
    y = [int(rnd.random() < 0.3) for _ in range(30_000)]
    x = [rnd.gauss(0.02 if t else -0.02, 0.03) for t in y]
    a, beta = np.stack([np.ones(len(x)), np.arcsinh(np.array(x) * 100)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        beta += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-2, a.T @ (np.array(y) - p) - 1e-2 * beta)
    assert np.allclose(toxicity.calibrate(spark.createDataFrame(list(zip(x, y)), "difference double, toxic int")), beta, rtol=0, atol=1e-8)
