"""Every stage on its own input against brute force, over real rows with planted cases."""

import pytest

import corpus_pipeline as P
from flowloom.llm import toxicity
from tests.llm.test_decontaminate import brute as passages
from tests.llm.test_linededup import brute as without_lines
from tests.llm.test_neardup import brute as classes
from tests.llm.test_packing import check
from tests.llm.test_toxicity import corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with awkward rows, and labelled texts of which some are toxic."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.where("text is not null").orderBy("doc_id").limit(1).head()
    texts = corpus(300, seed=5)
    more = [
        (900_001, base.text, "en", "src0", 1),
        (900_001, base.text, "en", "src0", 1),
        (900_002, None, None, None, None),
        (900_003, "", "en", None, 0),
        (None, "a text without an id", "en", "src1", 20),
        *[(10_000 + i, t, "en", "src2", len(t)) for i, (t, _) in enumerate(texts)],
    ]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    own = [(10_000 + i, 1, y) for i, (_, y) in enumerate(texts)]
    labels.unionByName(spark.createDataFrame(own, labels.schema)).write.parquet(f"{path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def inputs(spark, folder):
    """What each stage gets, and what the last one gives."""
    seen = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in P.STAGES:
        seen.append(P.stored(stage(spark, seen[-1], folder), f"test-{name}"))
    return seen


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0], r[1] or ""))


def test_names_and_columns(inputs):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    for df in inputs[:-1]:
        assert df.columns == inputs[0].columns and df.dtypes == inputs[0].dtypes


def test_toxicity_stage(spark, folder, inputs):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(inputs[0], toxicity.fit(inputs[0], labels)).collect()
    kept = sorted((r.doc_id is not None, r.doc_id) for r in scored if r.predicted == 0)
    assert [(i is not None, i) for i, _ in rows_of(inputs[1])] == kept
    toxic = {10_000 + i for i, (_, y) in enumerate(corpus(300, seed=5)) if y}
    gone = {r.doc_id for r in scored if r.predicted == 1}
    assert len(toxic & gone) > 0.95 * len(toxic) and len(gone - toxic) < 12


def test_line_stage(inputs):
    before = rows_of(inputs[1])
    # rows that repeat id and text are one document to the operator
    distinct = list(dict.fromkeys(before))
    cut = dict(zip(distinct, without_lines([t for _, t in distinct])))
    want = [(i, cut[i, t]) for i, t in before if not (t and t.strip() and not (cut[i, t] or "").strip())]
    assert rows_of(inputs[2]) == sorted(want, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    assert all(r.n_chars == len(r.text) for r in inputs[2].collect() if r.text and r.n_chars is not None and r.doc_id != 900_001)


def test_ngram_stage(inputs):
    told = classes(rows_of(inputs[2]))
    assert sorted(i if i is not None else -1 for i, _ in rows_of(inputs[3])) == sorted({c if c is not None else -1 for _, c, _, _ in told})


def test_decontamination_stage(spark, inputs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [(i, t) for i, t in rows_of(inputs[3]) if not passages(t, items)[-1]]
    assert rows_of(inputs[4]) == clean
    assert len(clean) < inputs[3].count()


def test_packing_stage(spark, inputs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert check(inputs[5].collect(), inputs[4], library, 4096) > 0


def test_run_gives_the_last_stage(spark, folder):
    assert P.run(spark, folder).columns[:2] == ["doc_id", "piece"]
    assert P.ORACLE_SQL is None


def test_an_empty_table_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).selectExpr("*", "1 as rk", "'x' as score", "true as keep", "2 as _rest")
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() == 0
    few = spark.createDataFrame([(1, "one two three four five six", 9, "s", True, 2)], "doc_id long, text string, rk int, score string, keep boolean, _rest int")
    for _, stage in P.STAGES[:-1]:
        assert [tuple(r) for r in stage(spark, few, SF).collect()] == [tuple(r) for r in few.collect()]
