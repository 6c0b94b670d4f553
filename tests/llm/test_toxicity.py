import random

import numpy as np
import pytest

from flowloom.llm import restore as R
from flowloom.llm import toxicity as T
from tests.llm.helpers import awkward, documents, empty

INSULTS = ["stupid", "idiot", "worthless", "scum", "loser", "pathetic"]
PLAIN = "the of and that with this from every morning people walk along the river to their work in town".split()


def corpus(n=600, seed=0):
    """Texts with their labels; one in five is toxic and holds a few insults."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(15, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append((" ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def trained(spark):
    texts = corpus()
    docs = awkward(spark, [t for t, _ in texts])
    rows = [(100 + i, y, "x") for i, (_, y) in enumerate(texts)] + [(None, 1, "x"), (999_999, 1, "x"), (100, None, "x")]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    return docs, labels, T.fit(docs, labels), texts


@pytest.mark.parametrize(
    "written, word",
    [
        ("5tup1d", "stupid"), ("st*pid", "stupid"), ("stuuupid", "stupid"), ("s.c.u.m", "scum"), ("1d10t", "idiot"), ("$cum", "scum"),
        ("l0s3r,", "loser"), ("stupid$$$", "stupid"), ("p4th3t1c!!", "pathetic"), ("the", "the"), ("town.", "town"), ("***", ""), ("12:30", ""),
        ("métro", "métro"),
    ],
)
def test_restoration(trained, written, word):
    assert R.Restorer(trained[2].counts).word(written) == word


def test_spaced_letters_are_joined():
    assert "stupid" in R.joined_tokens("you s t u p i d thing") and "stupid" in R.joined_tokens("a s t u p i d")
    assert R.joined_tokens("a b to c") == ["a", "b", "to", "c"]


def test_held_out_accuracy(spark, trained):
    docs, _, model, texts = trained
    rows = {r.doc_id: r for r in T.score(docs, model).collect() if r.doc_id is not None and r.doc_id >= 100}
    held = [i for i in range(len(texts)) if rows[100 + i].held_out]
    assert 60 < len(held) < 200
    assert sum(rows[100 + i].predicted == texts[i][1] for i in held) >= 0.98 * len(held)
    disguised = documents(spark, ["we walk along the s t u p i d river with that 1d10t and sc*m", "we walk along the river"])
    first, second = sorted(T.score(disguised, model).collect())
    assert first.predicted == 1 and second.predicted == 0 and {"stupid", "idiot", "scum"} <= set(first.toxic_words.split(","))


def test_labels_of_held_out_documents_are_never_read(spark, trained):
    docs, labels, model, _ = trained
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = T.fit(docs, flipped)
    assert again.lexicon == model.lexicon and (again.weights == model.weights).all()


def test_awkward_rows_and_missing_labels(spark, trained):
    docs, labels, model, texts = trained
    rows = T.score(awkward(spark), model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    empties = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(empties) == 1 and all(r.predicted == int(r.score >= 0.5) for r in rows)
    unlabelled = T.fit(docs, labels.limit(0))
    assert unlabelled.lexicon == {} and len({r.score for r in T.score(docs, unlabelled).collect()}) == 1
    assert T.score(empty(spark), T.fit(empty(spark), labels)).collect() == []


def test_language_counts_cover_all_texts(spark):
    whole = R.language_counts(documents(spark, ["abc abc", "xyz", None, ""] * 50))
    assert whole[R.TRIGRAMS + (ord("a") << 8) + ord("b")] == 100
    assert whole[R.TRIGRAMS + (ord("y") << 8) + ord("z")] == 50
    assert whole[: R.TRIGRAMS].sum() > 0


def test_weights_settle_where_classes_are_far_apart():
    """Whole Newton steps overshot here, to an intercept of minus three billion and one score for all."""
    rng = np.random.default_rng(0)
    toxic = (np.arange(4000) % 10 == 0).astype(float)
    rows = np.zeros((len(toxic), T.FINDINGS))
    for i in range(len(toxic)):
        if toxic[i] or rng.random() < 0.5:
            finds = rng.integers(3, 15) if toxic[i] else rng.integers(1, 6)
            weight = 8.5 if toxic[i] else 2.0 + rng.random()
            rows[i] = [1, np.log1p(finds), weight, weight * min(finds, 8) / 8, np.sqrt(finds / 100)]
    weights = T._logistic(rows, toxic)
    margins = weights[0] + rows @ weights[1:]
    assert margins[toxic == 1].min() > 0 > margins[toxic == 0].max() and np.isfinite(weights).all()
