import random

import public_tokenizers
import pytest
import sentencepiece

from flowloom.llm import tokencount as T
from tests.llm.helpers import awkward, documents, empty

PIECES = "abcdeéß 漢字\n\t  ▁🙂'the.,ingABC12\r{}();\x00"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(T.MODEL))


@pytest.fixture(scope="module")
def counter():
    return T.PieceCounter(T.model_bytes())


def samples(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_count_is_the_librarys(library, counter):
    for text in [*samples(3000), "<s> </s> <unk> <0x0A>", "x" * 3000, "a" + " " * 70 + "b"]:
        assert counter.count(text) == len(library.encode(text)), text


def test_every_prefix(library, counter):
    for text in samples(60, seed=2):
        table = counter.prefixes(text)
        got = [counter.at(table, k) for k in range(len(text) + 1)]
        assert got == [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        for budget in (0, 1, 3, 10, 1000):
            assert counter.within(table, budget) == max(k for k, n in enumerate(got) if n <= budget)


def test_frame(spark, library):
    rows = T.token_counts(awkward(spark), limit=10).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.over_limit == (r.n_tokens > 10)
    by_id = {r.doc_id: r for r in rows if r.doc_id in (1, 2, 4)}
    assert (by_id[1].n_bytes, by_id[1].n_tokens, by_id[1].fit_chars) == (0, 0, 0)
    assert by_id[2].n_tokens == 0 and by_id[4].over_limit
    assert T.token_counts(empty(spark)).collect() == []


def test_stored_table_answers_budgets(spark, counter):
    text = "the quick brown fox jumps over the lazy dog again and again"
    table = T.prefix_table(documents(spark, [text, None]))
    for budget in (0, 1, 5, 9, 100):
        first, second = T.cut_at(table, budget).orderBy("doc_id").collect()
        whole = counter.prefixes(text)
        best = max([(0, 0)] + [(e, n) for e, n in zip(whole.ends, whole.counts) if n <= budget])
        assert (max(first.cut_chars, 0), first.cut_tokens) == best
        assert (second.cut_chars, second.cut_tokens) == (0, 0)
