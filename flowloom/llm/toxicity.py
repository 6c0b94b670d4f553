"""Toxicity of texts: words are restored under a noisy-channel model, then scored.

What is learnt: the corpus language model over all texts; from a bounded sample of
labelled documents a lexicon of words and stems that mark toxic ones, and the
weights that turn a document's finds into a probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.frames import map_texts, pick
from flowloom.llm.restore import Restorer, joined_tokens, language_counts
from flowloom.session import checkpoint

# One in FOLDS documents is held out of training, by the checksum of its id.
FOLDS = 5
# Labelled documents that training looks at, chosen by the hash of their id.
TRAIN_ROWS = 20_000
# Entries of the lexicon at most; the strongest come first.
LEXICON = 20_000
STEMS = (4, 5, 6)
MEMO_ENTRIES = 400_000
THRESHOLD = 0.5
# Features of a document's finds.
FINDINGS = 5


def held_out(doc_id) -> object:
    """Column: whether an id is held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass(frozen=True)
class Model:
    counts: np.ndarray
    lexicon: dict[str, float]
    weights: np.ndarray


def features_of(word: str) -> list[str]:
    """A word and its stems; the end mark tells the whole word from a stem."""
    return [word + "$", *(word[:k] for k in STEMS if len(word) > k)]


class Scorer:
    """Finds of toxic words in a text, and the probability they make."""

    def __init__(self, counts: np.ndarray, lexicon: dict[str, float], weights: np.ndarray) -> None:
        self.restorer = Restorer(counts)
        self.lexicon = lexicon
        self.weights = weights
        self.memo: dict[str, tuple[str, float]] = {}

    def judge(self, token: str) -> tuple[str, float]:
        """The restored word of a token and its weight."""
        found = self.memo.get(token)
        if found is None:
            word = self.restorer.word(token)
            found = (word, max(self.lexicon.get(f, 0.0) for f in features_of(word)) if word else 0.0)
            if len(token) < 40:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[token] = found
        return found

    def finds(self, text: str) -> tuple[list[str], list[float]]:
        """Toxic words of a text and document features: any, distinct finds, strongest and mean weight, share of words."""
        tokens = joined_tokens(text)
        known = self.memo.get
        judged = [known(t) or self.judge(t) for t in tokens]
        hits = [j for j in judged if j[1] > 0.0]
        if not hits:
            return [], [0.0] * FINDINGS
        distinct = dict(hits)
        weights = sorted(distinct.values(), reverse=True)
        return sorted(distinct), [
            1.0,
            math.log1p(len(distinct)),
            weights[0],
            sum(weights[:8]) / 8,
            math.sqrt(len(hits) / len(tokens)),
        ]

    def score(self, features: list[float]) -> float:
        margin = float(self.weights[0] + np.dot(self.weights[1:], features))
        return 1 / (1 + math.exp(-max(min(margin, 500.0), -500.0)))


def _logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps that never raise the loss; weights of finds are never negative."""
    design = np.hstack([np.ones((len(rows), 1)), rows])
    weights = np.zeros(design.shape[1])
    share = (labels.sum() + 0.5) / (len(labels) + 2)
    weights[0] = math.log(share / (1 - share))
    if len(labels) == 0 or labels.min() == labels.max():
        return weights
    penalty = np.array([1e-6] + [ridge] * rows.shape[1])

    def loss(at: np.ndarray) -> float:
        margin = design @ at
        return float((np.logaddexp(0.0, margin) - labels * margin).sum() + 0.5 * (penalty * at * at).sum())

    now = loss(weights)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -500, 500)))
        slope = design.T @ (p - labels) + penalty * weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        # a weight at zero that would fall below it stays there, and the others move without it
        free = (weights > 0.0) | (slope < 0.0)
        free[0] = True
        move = np.zeros_like(weights)
        move[free] = -np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        # a whole step may overshoot where classes are nearly apart
        for rate in 0.5 ** np.arange(40):
            tried = weights + rate * move
            tried[1:] = np.maximum(tried[1:], 0.0)
            then = loss(tried)
            if then <= now:
                break
        else:
            break
        settled = now - then <= 1e-12 * abs(now)
        weights, now = tried, then
        if settled:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn the model; labels of held-out documents are never read.

    An id labelled twice counts as toxic if any label says so.  Without labels
    all texts score 0.25, and with one class only about the share of toxic ones.
    """
    counts = language_counts(docs)
    chosen = (
        pick(labels, "doc_id", "toxic")
        .where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # at most ``rows`` pairs of numbers
    labelled = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def prepare():
        scorer = Scorer(shared.value, {}, np.zeros(1))
        return lambda texts: [[sorted({scorer.judge(t)[0] for t in joined_tokens(x)} - {""}) for x in texts]]

    words = checkpoint(map_texts(labelled, "text", "words array<string>", prepare).where("size(words) > 0"))
    # three quarters teach the lexicon, the rest how finds add up
    teaches_words = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != FOLDS - 1
    stems = F.array(*[F.when(F.length("w") > k, F.substring("w", 1, k)) for k in STEMS], F.concat("w", F.lit("$")))
    seen = (
        words.where(teaches_words)
        .withColumn("w", F.explode("words"))
        .select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.explode(stems).alias("feature"))
        .where("feature is not null")
        .groupBy("doc_id", "feature")
        .agg(F.max("toxic").alias("toxic"))
        .groupBy("feature")
        .agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    )
    totals = words.where(teaches_words).agg(
        F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))
    ).head()
    lexicon = _lexicon(seen, *totals)
    scorer = Scorer(counts, lexicon, np.zeros(1))
    sample = words.where(~teaches_words).select((F.col("toxic") > 0).alias("toxic"), "words").limit(rows).toLocalIterator()
    rows_seen, marks = [], []
    for r in sample:
        rows_seen.append(scorer.finds(" ".join(r["words"]))[1])
        marks.append(float(r["toxic"]))
    weights = _logistic(np.array(rows_seen).reshape(len(rows_seen), FINDINGS), np.array(marks))
    return Model(counts, lexicon, weights)


def _lexicon(seen: DataFrame, documents: int, bad_documents: int) -> dict[str, float]:
    """Features that lean to toxic documents beyond chance among as many candidates."""
    if not documents or not bad_documents or bad_documents == documents:
        return {}
    rate = bad_documents / documents
    expected = F.col("n") * F.lit(rate)
    excess = F.log(F.greatest("bad", F.lit(1)) / expected) * F.col("bad")
    rest = F.col("n") - F.col("bad")
    deficit = F.when(rest > 0, F.log(rest / (F.col("n") * F.lit(1 - rate))) * rest).otherwise(0.0)
    found = seen.where(F.col("bad") > F.lit(2) * expected).withColumn("evidence", 2 * (excess + deficit))
    bar = 2 * math.log(max(seen.count(), 2))
    taken = found.where(F.col("evidence") >= bar).orderBy(F.desc("evidence"), "feature").limit(LEXICON)
    lean = {}
    for r in taken.select("feature", "bad", "n").collect():
        lean[r["feature"]] = max(0.0, math.log((r["bad"] + 0.5) / (r["n"] - r["bad"] + 0.5) / (rate / (1 - rate))))
    return lean


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted`` and the toxic words found.

    Takes ``doc_id`` and ``text``; of other columns those named in ``carry`` come
    through, with the text, in front.  Null and empty texts have no finds and get the score of a text without any.  Repeated rows and null
    ids are scored one by one (a null id counts as the empty text for the fold).
    Only the text is an input of the score.  A map over rows: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        scorer = Scorer(shared.value.counts, shared.value.lexicon, shared.value.weights)

        def work(texts):
            found = [scorer.finds(t) for t in texts]
            scores = [scorer.score(f) for _, f in found]
            return scores, [int(s >= THRESHOLD) for s in scores], [",".join(w) for w, _ in found]

        return work

    added = "score double, predicted int, toxic_words string"
    scored = map_texts(pick(docs, "doc_id", *carry, "text"), "text", added, prepare, keep_text=bool(carry))
    kept = (*carry, "text") if carry else ()
    return scored.select("doc_id", *kept, held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_words")
