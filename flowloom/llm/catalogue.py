"""Queries that apply each operator to the test tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import (
    alignment,
    decontaminate,
    lexsearch,
    linededup,
    mainline,
    neardup,
    packing,
    privacy,
    quality,
    recipes,
    sharding,
    tokencount,
    toxicity,
)
from flowloom.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def op1_privacy(spark, sf):
    return privacy.find_private(table(spark, sf, "documents"), masked=False)


def op2_quality(spark, sf):
    documents = table(spark, sf, "documents")
    return quality.judge(documents, quality.fit(documents, table(spark, sf, "labels")))


def op3_sharding(spark, sf):
    return sharding.shard(table(spark, sf, "documents"), scratch(spark, "slot-map"))


def op4_decontaminate(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_token_counts(spark, sf):
    return tokencount.token_counts(table(spark, sf, "documents"))


def op6_line_dedup(spark, sf):
    return linededup.drop_later_lines(table(spark, sf, "documents"))


def op7_main_text(spark, sf):
    return mainline.extract(table(spark, sf, "pages"))


def op8_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


def op9_toxicity(spark, sf):
    documents = table(spark, sf, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf, "labels")))


def op10_ngram_join(spark, sf):
    classes = neardup.near_classes(table(spark, sf, "documents"))
    return classes.select("doc_id", "class_id", "n_links", "n_copies")


def op11_lexical_search(spark, sf):
    return lexsearch.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_exact_dedup(spark, sf):
    return recipes.exact_groups(table(spark, sf, "documents"))


def op13_token_alignment(spark, sf):
    return alignment.align_documents(table(spark, sf, "documents"))


QUERIES = {
    "op1_privacy": op1_privacy,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_main_text": op7_main_text,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_lexical_search": op11_lexical_search,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_token_alignment": op13_token_alignment,
}

# op4: the windows of all items, joined with the windows of all documents
_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT rid, size, i, item_id FROM dw JOIN bw USING (size, win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit
            FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""

# op6: equal word sets grouped, rare-word prefixes joined, Jaccard verified
_OP6 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT * FROM (SELECT doc_id, pos, list_sort(list_distinct(list_filter(string_split(lines[pos + 1], ' '), lambda x: x <> ''))) AS s
      FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS pos FROM d)) WHERE len(s) > 0),
sets AS (SELECT row_number() OVER () AS id, s, len(s) AS n, begun FROM
         (SELECT s, min(struct_pack(doc_id := doc_id, pos := pos)) AS begun FROM l GROUP BY s)),
w AS (SELECT id, n, unnest(s) AS word FROM sets),
freq AS (SELECT word, count(*) AS f FROM w GROUP BY word),
p AS (SELECT id, n, word FROM (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY f, word) AS r FROM w JOIN freq USING (word))
      WHERE r <= n - CAST(ceil(n * 4 / 5.0) AS BIGINT) + 1),
c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.word = y.word AND x.id < y.id AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
v AS (SELECT a, b FROM (SELECT a, b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS o FROM c JOIN sets x ON x.id = a JOIN sets y ON y.id = b)
      WHERE 5 * o >= 4 * (total - o)),
ways AS (SELECT a AS id, b AS other FROM v UNION ALL SELECT b, a FROM v),
early AS (SELECT ways.id, min(sets.begun) AS theirs FROM ways JOIN sets ON sets.id = ways.other GROUP BY ways.id),
upto AS (SELECT s, CASE WHEN theirs < begun THEN theirs ELSE begun END AS upto FROM sets LEFT JOIN early USING (id)),
gone AS (SELECT doc_id, list(pos) AS later FROM l JOIN upto USING (s) WHERE struct_pack(doc_id := doc_id, pos := pos) > upto GROUP BY doc_id)
SELECT doc_id,
       CASE WHEN later IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(later, i - 1)), chr(10)) END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(later), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN gone USING (doc_id)
"""

# op10: all pairs of texts that share a 5-gram, then the closure of the similar ones
_OP10 = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS id, * FROM
    (SELECT coalesce(text, '') AS t, min(doc_id) AS least, count(*) AS n_copies FROM documents GROUP BY 1)),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '') AS ws FROM t),
s AS (SELECT DISTINCT id, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM s x JOIN s y ON x.gram = y.gram AND x.id < y.id GROUP BY 1, 2),
v AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 5 * o >= 4 * (x.n + y.n - o)),
ways AS (SELECT a, b FROM v UNION SELECT b, a FROM v),
reach AS (SELECT id AS a, id AS b FROM t UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
class AS (SELECT reach.a AS id, min(t.least) AS class_id FROM reach JOIN t ON t.id = reach.b GROUP BY 1),
deg AS (SELECT a AS id, count(*) AS n_links FROM ways GROUP BY 1)
SELECT d.doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, n_copies
FROM documents d JOIN t ON t.t = coalesce(d.text, '') JOIN class USING (id) LEFT JOIN deg USING (id)
"""

# op11: all terms of all documents, joined with those of the items
_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM d WHERE len(w) > 0),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, corpus GROUP BY term, n_docs),
s AS (SELECT item_id, rid, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(w) * n_docs) // n_all)))) AS BIGINT) AS score
      FROM i JOIN t USING (term) JOIN weight USING (term) JOIN d USING (rid), corpus GROUP BY item_id, rid),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM s JOIN d USING (rid) WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""

# op12: rows of one text without blanks, in the order in which they would stay
_OP12 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER stays AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER stays = 1 AS kept, sha256(bare) AS text_sha256
FROM d WINDOW stays AS (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST)
"""

ORACLES = {
    "op4_decontaminate": _OP4,
    "op6_line_dedup": _OP6,
    "op10_ngram_join": _OP10,
    "op11_lexical_search": _OP11,
    "op12_exact_dedup": _OP12,
}
