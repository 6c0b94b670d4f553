import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowloom.llm import alignment as A
from flowloom.llm.frames import pick
from tests.llm.helpers import awkward, documents, empty, prose

PIECES = "abcdeéß 漢字\n\t  ▁🙂'the.,ingABC12\r{}();\x00  \x1f"


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path(A.BYTE_MODEL))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.PIECE_MODEL))


def spans(tokens):
    out, begin = [], 0
    for k, raw in tokens:
        out.append((k, begin, begin + len(raw)))
        begin += len(raw)
    return out


def tokens_of(text, plain, alphabet=A.byte_alphabet()):
    """Tokens (id, begin, end) of both sides by the libraries over the whole text; none where bytes differ."""
    a, b = plain
    if not text:
        return [], []
    one = [(k, bytes(alphabet[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for k in b.encode(text):
        hexed = re.fullmatch("<0x(..)>", b.id_to_piece(k))
        two.append((k, bytes.fromhex(hexed[1]) if hexed else b.id_to_piece(k).replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(r for _, r in one) != whole or b"".join(r for _, r in two) != whole:
        return [], []
    return spans(one), spans(two)


def brute(texts, plain):
    """The result columns of every text from all overlapping pairs."""
    parts, held = [], defaultdict(set)
    for d, text in enumerate(texts):
        a, b = tokens_of(text, plain)
        links = Counter((x, y) for x, s, e in a for y, t, f in b if s < f and t < e)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        ids = lambda side, s, e: ",".join(str(k) for k, t, f in side if s <= t and f <= e)
        groups = [f"{ids(a, s, e)}|{ids(b, s, e)}" for s, e in zip([0, *cuts], cuts)]
        parts.append((len(a), len(b), groups, links))
        for pair in links:
            held[pair].add(d)
    top = Counter()
    for (x, _), docs in held.items():
        top[x] = max(top[x], len(docs))
    return [
        (
            na, nb, len(groups), links.total(),
            sum(n for p, n in links.items() if len(held[p]) == top[p[0]]),
            sum(n * len(held[p]) for p, n in links.items()),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for na, nb, groups, links in parts
    ]


def check(frame, plain, **how):
    rows = [(r["doc_id"], r["text"]) for r in pick(frame, "doc_id", "text").collect()]
    expected = [(d, *b) for (d, _), b in zip(rows, brute([t for _, t in rows], plain))]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = [tuple(r[n] for n in names) for r in A.align_documents(frame, **how).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def samples(rng, n):
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_awkward_rows(spark, plain, monkeypatch):
    monkeypatch.setattr("tests.llm.helpers.LONG", " ".join(f"word{i % 77}" for i in range(400)))
    texts = ["<|endoftext|> <s> </s> <unk> <0x0A>", "a ▁ b", "x" * 300, "naïve café", " lead", "trail ", "two  blanks", "漢字 漢"]
    check(awkward(spark, texts), plain)
    assert A.align_documents(empty(spark)).collect() == []


@pytest.mark.parametrize("how", [{}, {"block_docs": 7, "broadcast_pairs": 0}, {"block_links": 60}])
def test_frames(spark, plain, how):
    rng = random.Random(8)
    texts = samples(rng, 120) + [" ".join(prose(rng, 12)) for _ in range(60)] + ["the same text"] * 40
    check(documents(spark, texts).repartition(3), plain, **how)


def test_words_give_the_whole_texts_tokens(plain):
    aligner = A.Aligner(A._file(None, A.BYTE_MODEL).decode(), A._file(None, A.PIECE_MODEL))
    assert aligner.by_words
    rng = random.Random(9)
    for text in samples(rng, 1500):
        (numbers,) = aligner.numbers_of([text])
        a, b = tokens_of(text, plain)
        assert aligner.totals([numbers])[0, :2].tolist() == [len(a), len(b)], text
        held = [p for k in numbers or [] for p in aligner.groups[k].split(";")]
        assert ",".join(p.split("|")[0] for p in held) == ",".join(str(k) for k, _, _ in a)
        assert ",".join(p.split("|")[1] for p in held) == ",".join(str(k) for k, _, _ in b)


@pytest.mark.parametrize("width", [1, 40, 300])
def test_planes_hold_the_numbers_of_links(width):
    rng = np.random.default_rng(width)
    key = np.unique((30 * rng.random(8 * width) ** 4).astype(int) * width + rng.integers(0, width, 8 * width))
    pair, doc = np.divmod(key, width)
    times = rng.integers(1, 40, len(key))
    block, codes, plane, dense, n_docs, docs = A.posting_rows(5, pair, doc, times, width)
    assert set(block) == {5}
    counted = Counter()
    for p, n in zip(codes, n_docs):
        counted[p] += n
    assert counted == Counter(pair.tolist())
    weight = np.array(codes) + 1
    values = np.stack([weight << np.array(plane), np.ones_like(weight)], axis=1)
    sums = A.add_planes(pa.array(docs, type=pa.binary()), np.array(dense), values, width)
    assert sums[:, 0].tolist() == np.bincount(doc, times * (pair + 1), width).astype(int).tolist()
    assert width < 300 or (any(dense) and not all(dense))


def test_no_vocabulary_that_crosses_words_is_cut():
    model = A._file(None, A.BYTE_MODEL).decode()
    crossing = model.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true')
    assert not A.Aligner(crossing, A._file(None, A.PIECE_MODEL)).by_words
