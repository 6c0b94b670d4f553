"""Document quality: fixed base rules, then boosted trees over document statistics."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.boosting import FlatTrees, Recipe, train
from flowloom.llm.frames import map_texts, pick

LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
# Labelled rows the model is fitted on, chosen by the hash of their id.
TRAIN_ROWS = 20_000
# Score from which a document is kept.
KEEP_AT = 0.5

# Fixed values of the base rules.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Statistic and the direction in which quality may only fall (-1), rise (+1) or move freely (0).
FEATURES = (
    ("symbols_per_word", -1),
    ("duplicate_lines", -1),
    ("repeat_words", -1),
    ("capital_share", -1),
    ("exclamations_per_word", -1),
    ("odd_marks_per_word", -1),
    ("digit_share", 0),
    ("letter_share", 0),
    ("chars_per_word", 0),
    ("distinct_share", 0),
    ("words_per_line", 0),
    ("stops_per_word", 0),
    ("log_words", 0),
)
RECIPE = Recipe(monotone=tuple(direction for _, direction in FEATURES))

# Byte classes of UTF-8 text; a lead byte above ASCII stands for one letter.
_BYTES = np.arange(256)
_CLASSES = {
    "capitals": (_BYTES >= 65) & (_BYTES <= 90),
    "letters": ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES >= 0xC0),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "symbols": np.isin(_BYTES, list(b"#*$%&|<>")),
    "exclamations": _BYTES == ord("!"),
    "stops": np.isin(_BYTES, list(b".?")),
    "odd_marks": np.isin(_BYTES, list(b"@\\^_`{}~=+/[]")),
    "lines": _BYTES == 10,
}
_CLASS_TABLE = np.array([mask for mask in _CLASSES.values()], dtype=np.int64)


def byte_classes(text: str) -> dict[str, int]:
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    return dict(zip(_CLASSES, (_CLASS_TABLE @ seen).tolist()))


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 3 - max(at, covered)
            covered = at + 3
    return total


class Base(NamedTuple):
    """What the base rules count, and the classes of bytes met on the way."""

    words: list[str]
    word_chars: int
    symbols: int
    dup_lines: int
    repeats: int
    classes: dict[str, int]


def base_statistics(text: str) -> Base:
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    classes = byte_classes(text)
    return Base(
        words, sum(map(len, words)), classes["symbols"], len(lines) - len(set(lines)), repeat_words(words), classes
    )


def statistics(base: Base) -> list[float]:
    """The values of FEATURES; all zero for a text without words."""
    n, seen = len(base.words), base.classes
    if not n:
        return [0.0] * len(FEATURES)
    lines = seen["lines"] + 1
    return [
        base.symbols / n,
        base.dup_lines / lines,
        base.repeats / n,
        seen["capitals"] / max(seen["letters"], 1),
        seen["exclamations"] / n,
        seen["odd_marks"] / n,
        seen["digits"] / base.word_chars,
        seen["letters"] / base.word_chars,
        base.word_chars / n,
        len(set(base.words)) / n,
        n / lines,
        seen["stops"] / n,
        float(np.log1p(n)),
    ]


def fails_base(n_words: int, repeats: int) -> bool:
    return n_words < LEAST_WORDS or 100 * repeats > MOST_REPEAT_PERCENT * n_words


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` labelled documents, the same ones each time.

    Labelled ids are ordered by hash; an id labelled twice counts as bad if any
    label says so, and one that several documents share gives a row for each, up
    to ``rows`` in all.
    """
    chosen = (
        pick(labels, "doc_id", "quality")
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # at most ``rows`` pairs of numbers
    labelled = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def prepare():
        return lambda texts: [[statistics(base_statistics(t)) for t in texts]]

    found = map_texts(labelled, "text", "stats array<double>", prepare).orderBy(F.xxhash64("doc_id"), "stats").limit(rows)
    taken = found.select("quality", "stats").collect()
    stats = np.array([r["stats"] for r in taken], dtype=float).reshape(len(taken), len(FEATURES))
    return stats, np.array([r["quality"] > 0 for r in taken], dtype=float)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FlatTrees:
    return train(*training_rows(docs, labels, rows), RECIPE)


def judge(docs: DataFrame, model: FlatTrees, keep_at: float = KEEP_AT) -> DataFrame:
    """Per document: base statistics, base verdict, the model's score and the final verdict.

    Takes ``doc_id`` and ``text``; other columns are left out.  Null and empty
    texts have no words, fail the base rules and are not kept.  Repeated rows and
    null ids are judged one by one.  A map over rows: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        trees = shared.value

        def work(texts):
            base = [base_statistics(t) for t in texts]
            stats = np.array([statistics(b) for b in base]).reshape(len(texts), len(FEATURES))
            scores = 1 / (1 + np.exp(-trees.scores(stats)))
            n_words = [len(b.words) for b in base]
            failed = [fails_base(n, b.repeats) for n, b in zip(n_words, base)]
            kept = [bool(s >= keep_at and not f) for s, f in zip(scores, failed)]
            counts = [list(c) for c in zip(*((b.word_chars, b.symbols, b.dup_lines, b.repeats) for b in base))]
            return [n_words, *counts, failed, kept, scores.tolist()]

        return work

    added = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, quality_score double"
    )
    return map_texts(pick(docs, "doc_id", "text"), "text", added, prepare)
