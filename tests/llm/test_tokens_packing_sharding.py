"""Token operators against their libraries, shards against a plain search."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from settlespark.llm import packing, sharding, tokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


def test_encoding_equals_the_library_and_decodes_to_the_same_bytes(docs, cases):
    codec, _ = tokens.encoding(RANKS, public_tokenizers.PATTERN)
    rows = tokens.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(cases)
    for r in rows:
        text = cases[r.doc_id] or ""
        ids = np.frombuffer(bytes(r.token_ids), "<u4").tolist()
        assert ids == codec.encode_ordinary(text) and r.n_tokens == len(ids) and bytes(r.text_bytes) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 3000, "x" * 5000, "1234567890" * 600, "!?" * 2500, " " * 6000 + "z", "é" * 3000])
def test_long_matches_are_merged_as_the_library_does(text):
    codec, ranks = tokens.encoding(RANKS, public_tokenizers.PATTERN)
    assert tokens.encode_text(text, RANKS, public_tokenizers.PATTERN) == codec.encode_ordinary(text)
    assert tokens.merge_long(text.encode(), ranks) == codec._encode_single_piece(text.encode())


def test_parts_are_cut_only_at_safe_boundaries():
    codec, _ = tokens.encoding(RANKS, public_tokenizers.PATTERN)
    rnd = random.Random(4)
    text = "".join(rnd.choice(["word", " ", "  ", "\n", "'s", "12", "!?", " x", "\t "]) for _ in range(4000))
    found = list(tokens.parts(text, 50))
    assert "".join(found) == text and len(found) > 50
    assert [i for p in found for i in codec.encode_ordinary(p)] == codec.encode_ordinary(text)


def test_empty_table(no_docs):
    assert tokens.decode(tokens.encode(no_docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect() == []
    assert packing.pack(no_docs, WORD).collect() == []
    assert sharding.shard(no_docs).collect() == []


def test_packing_keeps_every_id_once_in_gapless_windows(docs, cases):
    own = Tokenizer.from_file(WORD)
    own.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, WORD).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in cases.items():
        ids, at = own.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert bytes(r.token_ids) == np.array(ids[at:at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW


def test_differencing_is_near_equal_and_windows_rise_only_when_needed():
    rnd = random.Random(2)
    for _ in range(50):
        sizes = [rnd.randint(1, 512) for _ in range(rnd.randint(1, 150))]
        found = packing.windows(sizes, 2048)
        assert sorted(i for w in found for i in w) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in w) for w in found) <= 2048
        assert len(found) <= -(-sum(sizes) // 2048) + 1
    sizes = [rnd.randint(1, 100) for _ in range(400)]
    loads = [sum(sizes[i] for i in part) for part in packing.differencing(sizes, 8)]
    assert max(loads) - min(loads) <= 5


def _least_capacity(texts, shards):
    groups = defaultdict(int)
    for t in texts:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    sizes = [groups[k] for k in sorted(groups)]

    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards_have_the_least_possible_capacity(docs, cases, shards):
    _check_shards(sharding.shard(docs, shards).collect(), list(cases.items()), shards)


def test_shards_with_one_text_in_a_third_of_the_rows(spark):
    rows = [(i, "the same text " * 20 if i % 3 == 0 else f"text {i % 500} " * (i % 11)) for i in range(1500)] + [(7, "twice"), (7, "twice")]
    _check_shards(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, 16)


def _check_shards(found, rows, shards):
    assert len(found) == len(rows)
    loads, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in found:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text_crc32, r["size"]].add(r.shard)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in found) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert max(loads.values()) == _least_capacity([t for _, t in rows], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(w) == 1 for w in where.values())


def test_words_met_again_and_other_spellings_are_not_tokenized_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    own, asked, plain = packing.WordTokenizer(WORD), [], Tokenizer.from_file(WORD)
    plain.encode_special_tokens = True
    learn = own._learn
    own._learn = lambda words: (asked.extend(words), learn(words))
    rnd = random.Random(2)
    odd = ["J\u030c.", "I\u0307!", "E\u0301,", "don't.", "it's.", "A.B.", "a..", "x1.", "1.", ".", "\u00c9t\u00e9.", "\u212aelvin?", "e\u0301.", "Z."]
    for _ in range(30):
        texts = [f"Common common. COMMON, {rnd.choice(odd)} " + " ".join(f"w{rnd.getrandbits(30)}" for _ in range(6)) for _ in range(2)]
        assert own.ids(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert asked.count(b"common") == 1 and not {b"Common", b"common.", b"COMMON,"} & set(asked)
