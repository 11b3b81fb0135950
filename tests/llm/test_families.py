"""Which sets the n-gram join compares: all similar ones, and not those that merely quote the same passage."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from llm_cases import sentence
from settlespark.llm import jaccard
from settlespark.llm.common import Forest


@pytest.mark.parametrize("hot", [2, 4, 32])
def test_counted_parts_link_all_similar_sets(hot, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "FLUSH", 50)
    rnd = random.Random(hot)
    for percent in (80, 85):
        common, sets = [rnd.getrandbits(64) for _ in range(40)], []
        for size in (1, 2, 5, 9, 20, 60, 200):
            for _ in range(4):
                base = {rnd.getrandbits(64) for _ in range(size)} | set(rnd.sample(common, rnd.randint(0, 40)))
                for _ in range(rnd.choice([1, 3, 9])):
                    left = rnd.sample(sorted(base), len(base) - rnd.randint(0, len(base) // 9))
                    sets.append(set(left) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, len(base) // 12))})
        marks, run = [], []
        for i, s in enumerate(sets):
            for level, slack, found in jaccard.named_parts(np.array(sorted(s), dtype=np.uint64), percent):
                marks.append(jaccard._long(jaccard._short(found)))
                run.append((i, level, slack, len(found)))
        run = np.array(run, dtype=jaccard.RUN)
        assert (jaccard._runs(jaccard._soa(run)) == run).all()
        shared, hot_parts, over = {}, {}, []
        for batch in jaccard.meetings(np.concatenate(marks), run):
            for r in batch.to_pylist():
                if r["kind"] == "pair":
                    key = (min(r["a"], r["b"]), max(r["a"], r["b"]), r["level"])
                    n, need = shared.get(key, (0, 1 << 60))
                    shared[key] = n + r["n"], min(need, r["need"])
                else:
                    over.append(((r["a"], r["level"]), r["b"]))
                    n, _ = hot_parts.get(over[-1][0], (0, 0))
                    hot_parts[over[-1][0]] = n + r["n"], r["need"]
        forest = Forest(len(sets))
        for (a, b, _), (n, need) in shared.items():
            if n >= need:
                forest.join(a, b)
        for node, b in over:
            if hot_parts[node][0] > hot_parts[node][1]:
                forest.join(node[0], b)
        for a, b in combinations(range(len(sets)), 2):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                assert forest.root(a) == forest.root(b)


def test_documents_with_a_common_passage_are_not_one_family(spark, monkeypatch):
    sent, apply = [], GroupedData.applyInArrow

    def watched(self, *args):
        sent.append(self._df.agg(F.count("elements")).first()[0])
        return apply(self, *args)

    monkeypatch.setattr(GroupedData, "applyInArrow", watched)
    rnd = random.Random(4)
    passages = [sentence(rnd, 30) for _ in range(6)]
    texts = [" ".join([*(f"w{rnd.getrandbits(40)}" for _ in range(150)), rnd.choice(passages), *(f"w{rnd.getrandbits(40)}" for _ in range(90))]) for _ in range(300)]
    rows = [*enumerate(texts), (300, texts[7] + " more"), (301, "more " + texts[8])]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80)
    assert {r.doc_id: r.component_id for r in found.collect()} == {**{i: i for i in range(300)}, 300: 7, 301: 8}
    assert sum(sent) < 30
