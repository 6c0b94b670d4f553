import random

from flowloom.llm import linededup as L
from tests.llm.helpers import awkward, documents, empty, prose


def brute(texts, over=4, under=5):
    seen, out = [], []
    for text in texts:
        kept = []
        for line in (text or "").split("\n"):
            words = {w for w in line.split(" ") if w}
            again = any(under * len(words & s) >= over * len(words | s) for s in seen) if words else False
            if words:
                seen.append(words)
            if not again:
                kept.append(line)
        out.append(None if text is None else "\n".join(kept))
    return out


def cases(seed):
    rng = random.Random(seed)
    pool = [" ".join(prose(rng, rng.choice([1, 3, 5, 8, 20, 60]), 300)) for _ in range(30)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = rng.choice(pool).split() if rng.random() < 0.6 else prose(rng, rng.randint(1, 30), 300)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(["new", "w1", "w2", words[0]])
            lines.append(rng.choice([" ", "  "]).join(words))
        texts.append("\n".join(lines))
    return texts + [None, "", " \n ", texts[3], pool[0], pool[0] + " more"]


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = cases(seed)
        rows = sorted(L.drop_later_lines(documents(spark, texts)).collect())
        assert [r.text for r in rows] == brute(texts)
        for r, text in zip(rows, texts):
            assert r.n_lines == (0 if text is None else text.count("\n") + 1)
            assert r.n_removed == (0 if text is None else r.n_lines - (0 if r.text == "" and r.n_lines == r.n_removed else r.text.count("\n") + 1))


def test_awkward_rows(spark):
    rows = L.drop_later_lines(awkward(spark)).collect()
    assert len(rows) == 10
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].text is None and by_id[2][0].text == "" and by_id[3][0].text == " \n\t "
    # equal rows are one document; a later id with the same text loses it
    assert sorted(r.text for r in by_id[5]) == ["a plain text of seven words here"] * 2 + ["the same id but another text"]
    assert by_id[6][0].text == "" and by_id[6][0].n_removed == 1
    assert L.drop_later_lines(empty(spark)).collect() == []


def test_a_hot_line_and_its_near_copies(spark):
    base = [f"w{i}" for i in range(20)]
    texts = ["\n".join([" ".join(base), f"own words of document {i} here"]) for i in range(200)]
    texts += [" ".join([*base[:19], f"other{i}"]) for i in range(50)]
    rows = sorted(L.drop_later_lines(documents(spark, texts)).collect())
    assert [r.text for r in rows] == brute(texts)


def test_short_lines_that_differ_all_stay(spark):
    texts = ["\n".join(f"word{i}" for i in range(k, k + 500)) for k in range(0, 40_000, 500)]
    rows = sorted(L.drop_later_lines(documents(spark, texts)).collect())
    assert [r.n_removed for r in rows] == [0] * len(texts)
    assert [r.text for r in rows] == texts


def test_a_text_of_very_many_lines(spark):
    """Its rows carry one hash of the text each; nothing is done per line over the whole text."""
    lines = [f"line n{i} of one very long text a{i % 1000} b{i // 1000}" for i in range(100_000)]
    (row,) = L.drop_later_lines(documents(spark, ["\n".join([*lines, lines[5], lines[77]])])).collect()
    assert (row.n_lines, row.n_removed) == (100_002, 2)
    assert row.text == "\n".join(lines)


def test_every_word_gives_a_whole_hash_of_its_own(spark):
    lines = spark.createDataFrame([(1, 1, 0, f"only{i}") for i in range(40_000)], "doc_id long, rk long, pos int, line string")
    keys = L.word_keys(lines, spark.sql(f"SELECT array_repeat(0Y, {L.CELLS}) AS levels"))
    assert keys.select("word_xor").distinct().count() == keys.select("keys").distinct().count() == 40_000


def test_lines_that_stand_alone_are_not_grouped(spark, monkeypatch):
    texts = [f"line n{i} has words a{i} b{i} of its own" for i in range(300)]
    docs = documents(spark, [*texts, texts[7], "own its of b9 a9 words has n9 line"])
    lines = L.stored(L.line_sets(docs, L.rarity_classes(docs), L.Similarity()), "lines")
    written, stored = {}, L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: written.setdefault(name, stored(df, name)))
    sets = L.distinct_sets(lines)
    assert sets.select("id").distinct().count() == sets.count() == 300
    assert sorted(r.times for r in written["repeated-sets"].collect()) == [2, 2]
    assert {r.first.doc_id for r in written["repeated-sets"].collect()} == {r.doc_id for r in docs.where("text in ('%s', '%s')" % (texts[7], texts[9])).groupBy("text").min("doc_id").withColumnRenamed("min(doc_id)", "doc_id").collect()}
