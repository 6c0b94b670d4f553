import hashlib
import random
import re

from flowloom.llm import decontaminate as D
from flowloom.llm.frames import pick
from tests.llm.helpers import awkward, documents, empty, prose


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items, size=10):
    words, hit, found = tokens(text), set(), set()
    for item, passage in items:
        own = tokens(passage)
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[i : i + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(11)
    items = [(k, " ".join(prose(rng, rng.choice([1, 2, 9, 10, 14, 30]), 3000))) for k in range(25)]
    items += [(90, items[4][1]), (91, None), (92, ""), (93, "Été, ÉTÉ x-Y_z 9")]
    texts = []
    for _ in range(60):
        words = prose(rng, 60, 3000)
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1] or ""
            at = rng.randint(0, 60)
            words[at:at] = own.upper().split()[rng.randint(0, 3) :]
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    return texts + ["Été! ÉTÉ x y z 9"], items


def test_against_brute_force(spark):
    texts, items = cases()
    docs = awkward(spark, texts)
    benchmark = spark.createDataFrame([(k, t, "more", 1) for k, t in items], "item_id long, text string, TEXT string, id int")
    want = sorted((d.doc_id is not None, d.doc_id, *brute(d.text, items)) for d in pick(docs, "doc_id", "text").where("doc_id is not null").collect())
    for block_bytes in (D.BLOCK_BYTES, 600):
        rows = D.contamination(docs, benchmark, block_bytes=block_bytes).collect()
        assert len(rows) == docs.count()
        got = sorted((True, r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows if r.doc_id is not None)
        assert got == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


def test_empty_sides(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    rows = D.contamination(documents(spark, ["some text"]), nothing).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows] == [(2, 0, 0, False)]
    assert D.contamination(empty(spark), nothing).collect() == []


def test_shifts_never_jump_over_an_occurrence():
    rng = random.Random(3)
    for length in (1, 2, 3, 5):
        patterns = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(length)) for _ in range(6)}
        searcher = D.WordSearcher(length, patterns)
        for _ in range(100):
            words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 30))]
            want = [(i, tuple(words[i : i + length])) for i in range(len(words) - length + 1) if tuple(words[i : i + length]) in patterns]
            assert searcher.find(words) == want
