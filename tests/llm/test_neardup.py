import random

import numpy as np
import pytest

from flowloom.llm import components as C
from flowloom.llm import neardup as N
from tests.llm.helpers import awkward, documents, empty, prose


def grams(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}


def brute(rows):
    """Per row: class id, links to other texts, copies."""
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets = [grams(t) for t in texts]
    leader, links = list(range(len(texts))), [0] * len(texts)

    def find(k):
        while leader[k] != k:
            k = leader[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                leader[find(i)] = find(j)
    place = {t: k for k, t in enumerate(texts)}
    ids = {}
    for i, t in rows:
        root = find(place[t or ""])
        known = [x for x in (ids.get(root), i) if x is not None]
        ids[root] = min(known) if known else None
    return [(i, ids[find(place[t or ""])], links[place[t or ""]], sum((u or "") == (t or "") for _, u in rows)) for i, t in rows]


def cases(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(30):
        base = prose(rng, rng.choice([3, 5, 12, 80, 200]), 3000)
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 999)}"
            texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    return texts


def key(row):
    return tuple((x is not None, x) for x in row)


def test_against_brute_force(spark):
    docs = awkward(spark, cases())
    rows = [tuple(r) for r in N.pick(docs, "doc_id", "text").collect()]
    got = [(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in N.near_classes(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert N.near_classes(empty(spark)).collect() == []


def test_blocks_give_the_same_links(spark):
    rng = random.Random(3)
    base = prose(rng, 120, 5000)
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"e{i}"
        texts.append(" ".join(words))
    docs = documents(spark, texts)
    want = {i: n for i, _, n, _ in brute(list(enumerate(texts)))}
    slim = N.pick(docs, "doc_id", "text")
    candidates = N.stored(N.candidate_components(slim, N.Join()), "test-candidates")
    ids = dict(docs.select("doc_id", N._text_id().alias("id")).collect())
    for block in (7, 40, 1000):
        links = dict(N.verified_links(slim, candidates, N.Join(), block).groupBy("id").sum("links").collect())
        assert {i: links.get(t, 0) for i, t in ids.items()} == want


def test_recall_of_the_forest():
    """Pairs just above the threshold share a label in nearly every case."""
    join = N.Join()
    assert 1 - (1 - 0.8 ** join.depth()) ** join.trees >= join.recall
    shingler, rng = N.Shingler(join), np.random.default_rng(0)
    met = 0
    for _ in range(400):
        shared = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        a, b = np.unique(np.concatenate([shared, own[:10]])), np.unique(np.concatenate([shared, own[10:]]))
        met += bool((shingler.labels(a) == shingler.labels(b)).any())
    assert met >= 398


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = awkward(spark, cases(2)).where("doc_id is null or doc_id <> 6")
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = [tuple(r) for r in N.pick(docs, "doc_id", "text").collect()]
    # an id that two texts share may stand for two classes
    told = {(c, t) if c == 5 else (c, None) for (_, t), (_, c, _, _) in zip(rows, brute(rows))}
    got = [r.doc_id for r in N.pick(kept, "doc_id").collect()]
    assert sorted(got, key=str) == sorted((c for c, _ in told), key=str)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(9, 1), (9, 2), (7, 2), (30, 31), (31, 32), (5, 30)]])
def test_components(spark, edges):
    frame = N.stored(spark.createDataFrame(edges, "a long, b long"), "test-edges")
    roots = dict(C.components(frame).collect())
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert roots == want
