import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import lexsearch as L
from flowloom.llm.frames import pick
from tests.llm.helpers import awkward, documents, empty, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    """(item, rank, doc, score) from plain term counts."""
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    full = [c for _, c in counts if c]
    n_docs, n_all = len(full), sum(c.total() for c in full)
    df = Counter(t for c in full for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, held in wanted.items():
        scored = []
        for doc, c in counts:
            m = 50 + (50 * c.total() * n_docs) // n_all if c else 50
            score = 0
            for t in held:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def check(docs, items, **how):
    found = sorted((tuple(r) for r in L.search(docs, items, **how).collect()), key=repr)
    read = lambda df, *names: [tuple(r) for r in pick(df, *names).collect()]
    expected = brute(read(docs, "doc_id", "text"), read(items, "item_id", "text"), how.get("top", 50))
    assert found == expected
    return found


def test_awkward_rows(spark):
    rows = [("a", "Plain  WORDS plain"), (None, "text of no id"), ("b", None), ("c", ""), ("a", "word5"), ("d", "é漢 zz-top"), ("e", "here")]
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id string, text string, doc_id long, TEXT string")
    docs = awkward(spark, ["é漢 zz", "top;zz TOP", "a b word5", "Éa", "plain"] * 2)
    assert check(docs, items) and check(docs, items, top=2) and check(docs, items, block_bytes=100)
    assert L.search(empty(spark), items).collect() == []
    assert L.search(docs, items.limit(0)).collect() == []
    with pytest.raises(ValueError, match="whole number"):
        L.search(documents(spark, ["x"]).selectExpr("'k' as doc_id", "text"), items)


def test_ties_and_many_documents(spark):
    rng = random.Random(3)
    texts = [" ".join(prose(rng, rng.choice([0, 1, 5, 60]), 60)) for _ in range(500)] + ["w3 w4"] * 120
    rng.shuffle(texts)
    items = documents(spark, [" ".join(prose(rng, 8, 90)) for _ in range(12)]).withColumnRenamed("doc_id", "item_id")
    docs = documents(spark, texts).repartition(7)
    check(docs, items)
    check(docs, items, top=3)


def test_small_tables_of_candidates_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(L, "PENDING", 10)
    best = L.Best(3, 4)
    seen = []
    for _ in range(40):
        part = rng.integers(0, [[3], [6], [50], [2]], (4, 20))
        seen.append(part)
        best.add(*part)
    rows = np.concatenate(seen, axis=1).T.tolist()
    for item in range(3):
        ranked = sorted((r for r in rows if r[0] == item and r[1] > 0), key=lambda r: (-r[1], r[3], r[2]))[:4]
        assert [r for r in best.settle().T.tolist() if r[0] == item] == ranked


def test_sums_stay_exact():
    cells, values = np.array([0, 1, 0, 0]), np.array([2**55 + 1, 3, 2**56 + 5, 7])
    assert L._add_up(cells, values, 2).tolist() == [2**55 + 2**56 + 13, 3]
