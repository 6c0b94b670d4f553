import random
import re

import numpy as np

from flowloom.llm import boosting as B
from flowloom.llm import quality as Q
from tests.llm.helpers import awkward, documents, empty


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit)


def test_base_statistics():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a ", "b ", "é", "#", "\n", " ", "\t", "$ ", "|", "a b c "]) for _ in range(rng.randint(0, 60)))
        base = Q.base_statistics(text)
        assert (len(base.words), *base[1:5]) == brute(text), text


def grown(monotone=(1, -1, 0), n=2000, seed=0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, 3))
    labels = (rows[:, 0] - rows[:, 1] + np.sin(3 * rows[:, 2]) + rng.normal(scale=0.5, size=n) > 0).astype(float)
    return B.train(rows, labels, B.Recipe(monotone=monotone)), rows, labels


def test_trees_learn_and_keep_constraints():
    model, rows, labels = grown()
    assert ((model.scores(rows) > 0) == labels).mean() > 0.85
    rng = np.random.default_rng(9)
    base = rng.normal(size=(200, 3))
    for feature, sign in ((0, 1), (1, -1)):
        higher = base.copy()
        higher[:, feature] += rng.uniform(0, 2, size=200)
        assert (sign * (model.scores(higher) - model.scores(base)) >= -1e-9).all()


def test_flat_arrays_score_like_walking_the_trees():
    model, rows, _ = grown(n=500)
    for row in rows[:50]:
        total = model.prior
        for t in range(len(model.feature)):
            at = 0
            while model.left[t, at] != at:
                at = model.left[t, at] if row[model.feature[t, at]] <= model.threshold[t, at] else model.right[t, at]
            total += model.value[t, at]
        assert abs(total - model.scores(row[None, :])[0]) < 1e-9


def junk(rng, n):
    return " ".join(rng.choice(["x***", "y$$$", "z###"]) + str(rng.randint(0, 99)) for _ in range(n))


def test_frame(spark):
    rng = random.Random(3)
    good = [" ".join(f"word{rng.randint(0, 500)}" for _ in range(80)) + "." for _ in range(60)]
    bad = [junk(rng, 80) for _ in range(60)]
    docs = awkward(spark, good + bad)
    labels = spark.createDataFrame(
        [(100 + i, int(i < 60), None) for i in range(0, 120, 2)] + [(None, 1, None), (7, None, None), (100, 1, None)],
        "doc_id long, quality int, text string",
    )
    rows = {r.doc_id: r for r in Q.judge(docs, Q.fit(docs, labels)).collect()}
    assert all(rows[100 + i].kept == (i < 60) for i in range(1, 120, 2))
    assert not rows[1].kept and rows[1].base_failed and rows[2].n_words == 0
    assert rows[4].n_words == 30_000 and rows[4].base_failed
    nothing = Q.fit(docs, labels.limit(0))
    assert all(r.kept == (not r.base_failed) for r in Q.judge(documents(spark, good), nothing).collect())
    assert Q.judge(empty(spark), nothing).collect() == []
