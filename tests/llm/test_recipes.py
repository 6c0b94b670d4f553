import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowloom.llm import recipes as R
from flowloom.llm.frames import pick
from tests.llm.helpers import CLASHING, awkward, documents, empty, prose

BLANK = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    """(doc_id, keep_id, group_size, sha) of every row, and how many rows of each group are kept."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for doc, text in rows:
        bare = BLANK.sub("", text or "")
        first = min(groups[bare], key=lambda g: g[:3])
        out.append((doc, first[3], len(groups[bare]), hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


def check(frame, **how):
    rows = [(r["doc_id"], r["text"]) for r in pick(frame, "doc_id", "text").collect()]
    found = R.exact_groups(frame, **how).collect()
    expected, groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected
    kept = [r for r in found if r.kept]
    assert len(kept) == groups and len({r.text_sha256 for r in kept}) == groups
    assert all(r.doc_id == r.keep_id for r in kept)


def test_awkward_rows(spark):
    rows = [(7, "ab c"), (8, "a b c"), (9, "a\tb\rc"), (3, "abc"), (10, "a bc"), (11, "ÄÖ 漢字🙂"), (12, "ÄÖ漢字🙂 "), (None, "abc  ")]
    more = spark.createDataFrame([(i, t, "x", None, None, 7, None, None, None) for i, t in rows], CLASHING)
    check(awkward(spark).unionAll(more))
    assert R.exact_groups(empty(spark)).collect() == []


def test_many_copies_and_long_texts(spark):
    rng = random.Random(4)
    base = [" ".join(prose(rng, rng.choice([0, 3, 400, 4000]))) for _ in range(40)] + ["x" * 30_000, "0" * 30_001]
    texts = [t.replace(" ", rng.choice([" ", "\n", "  "])) for t in rng.choices(base, k=200)]
    texts += [t[:-1] + "!" for t in base if t] + ["hot text"] * 100
    rng.shuffle(texts)
    check(documents(spark, texts))
    check(documents(spark, texts), least=8, most=40)


def test_chunks_are_the_text_and_follow_its_content(spark):
    rng = random.Random(5)
    body = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz.,ABC", k=20_000))
    df = documents(spark, [body, "unlike head" + body, "é" * 3000, ""]).select(R.chunks_of(F.col("text")).alias("c"))
    plain, moved, accents, none = [r.c for r in df.collect()]
    assert "".join(plain) == body and "".join(accents).encode("latin-1").decode() == "é" * 3000 and none == []
    assert all(R.LEAST <= len(c) <= R.MOST for c in plain[:-1])
    assert len(plain) > 8 and len(set(plain) & set(moved)) >= len(plain) - 3


def test_shared_identifiers_are_found_and_numbered_anew(spark):
    """Under the first salts every chunk of one length has one identifier."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(12)) for _ in range(60)] * 2

    def weak(chunk, salt):
        return F.octet_length(chunk).cast("long") if salt < 2 else F.xxhash64(chunk)

    check(documents(spark, texts), identify=weak)
    with pytest.raises(ValueError, match="share an identifier"):
        R.recipes(documents(spark, texts), identify=lambda c, salt: F.lit(1), salts=2)
