import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowloom.llm import packing as K
from flowloom.llm.frames import pick
from tests.llm.helpers import awkward, documents, empty

ODD = "abCDéßÀµªº. ,'s!?<|>*123\n漢ﬁ“”’İΣ\t́"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(K.MODEL))


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_the_librarys(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["<|endoftext|>. <|ENDOFTEXT|>", "it's. dogs' I'LL!!", "x<|endoftext|>,", "Ünïcode wörds. WORDS!!"]
    encoder = K.ChunkEncoder(K.model_text())
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text)[:-1], text


def check(rows, docs, library, capacity):
    want = []
    for d in pick(docs, "doc_id", "text").collect():
        ids = ids_of(library, d.text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((d.doc_id is None, d.doc_id, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda t: tuple(-1 if x is None else x for x in t)
    got = [(r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_round_trip(spark, library):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["one", "two", "three", "Größe"]) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    docs = documents(spark, texts)
    n = check(K.pack(docs, capacity=64).collect(), docs, library, 64)
    volume = sum(len(ids_of(library, t)) for t in texts)
    assert n <= -(-volume // 64) * 1.02 + 1


def test_awkward_and_equal_lengths(spark, library):
    docs = awkward(spark, ["same length text"] * 500)
    check(K.pack(docs, capacity=32).collect(), docs, library, 32)
    assert K.pack(empty(spark)).collect() == []


def optimum(lengths, capacity):
    @lru_cache(None)
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = [len(left)]

        def fill(room, k, kept):
            if k == len(rest):
                best[0] = min(best[0], 1 + least(kept))
                return
            if rest[k] <= room:
                fill(room - rest[k], k + 1, kept)
            fill(room, k + 1, (*kept, rest[k]))

        fill(capacity - first, 0, ())
        return best[0]

    return least(tuple(sorted(lengths, reverse=True)))


def test_bin_completion_finds_the_optimum():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 20, 31])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        solver = K.BinCompletion(counts, capacity)
        packing = solver.solve()
        used = sorted(x for pattern, n in packing.patterns for x in pattern * n)
        assert used == sorted(lengths) and all(sum(p) <= capacity for p, _ in packing.patterns)
        best = optimum(lengths, capacity)
        assert solver.bound <= best and packing.sequences == best, (capacity, lengths)


def test_the_histogram_stands_for_any_number_of_pieces():
    rng = random.Random(4)
    lengths = [rng.randint(1, 4096) for _ in range(300)]
    one = K.BinCompletion(np.bincount(lengths, minlength=4097), 4096).solve()
    many = K.BinCompletion(np.bincount(lengths, minlength=4097) * 1_000_000, 4096).solve()
    assert many.sequences <= one.sequences * 1_000_000
    assert len(many.patterns) < 3 * 4096
