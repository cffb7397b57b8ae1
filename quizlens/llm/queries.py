"""Registered queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quizlens.llm import bpe, distinct, formatting, near, nested, packing, quota, spans, visual
from quizlens.session import table

Query = Callable[[SparkSession, str], DataFrame]

CONTAINER = 2048  # tokens a container of problem 9 holds
DIVISOR = 10  # problem 2 draws a tenth of the rows
SHARE = 0.1  # problem 3 chooses about a tenth of the ids


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.parsed_records(table(spark, sf_dir, "item_lines"), "line_id", "record")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keep_id, copy_id): records of item_lines that differ in their writing only."""
    return formatting.formatting_copies(_lines(spark, sf_dir), "line_id")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keep_id, copies, question, choices, answer_index): each record of item_lines once."""
    return formatting.collapsed_records(_lines(spark, sf_dir), "line_id")


def _quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.quota_table(table(spark, sf_dir, "items"), "subject", table(spark, sf_dir, "subject_targets"), DIVISOR)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject): targets for which items has too few rows."""
    return _quotas(spark, sf_dir).filter("short").select("subject")


def p2_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per target: what is wanted, available and drawn."""
    return _quotas(spark, sf_dir)


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, subject): the rows drawn."""
    return quota.quota_sample(table(spark, sf_dir, "items"), "pos", "subject", _quotas(spark, sf_dir))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, id, batch): the rows of items whose id is chosen."""
    return nested.stable_sample(table(spark, sf_dir, "items").select("pos", "id", "batch"), "id", SHARE)


def p3_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, ids, chosen): ids first delivered in each batch, and how many of them are chosen."""
    return nested.growth_report(table(spark, sf_dir, "items"), "id", "batch", SHARE)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_a, rec_b): rows of arc_items that look the same but differ in a character."""
    return visual.look_alike_pairs(table(spark, sf_dir, "arc_items"), "rec_id", "question", "choices.text")


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, question, choices): the texts of arc_items in one form."""
    return visual.text_forms(table(spark, sf_dir, "arc_items"), "rec_id", "question", "choices.text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, term): terms that are frequent in a row and rare, but not unique, over all rows."""
    return distinct.term_scores(table(spark, sf_dir, "items"), "pos", "choices", 2, 2, 6).select("pos", "term")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, term, tf, df, score): every term of the choices of every row of items."""
    return distinct.term_scores(table(spark, sf_dir, "items"), "pos", "choices")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos_a, pos_b): rows of items of which 7/10 of the three-token runs are common."""
    return near.near_duplicate_pairs(table(spark, sf_dir, "items"), "pos", near.token_text("question", "choices"), 3, 7, 10)


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, group_id, n_links): one row per row of items."""
    return near.near_duplicate_groups(table(spark, sf_dir, "items"), "pos", near.token_text("question", "choices"), 3, 7, 10)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): each text of documents as the ids of byte_bpe_50k."""
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the texts that the ids of all documents stand for."""
    return bpe.decode_column(p8_ids(spark, sf_dir), "doc_id", "ids")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", CONTAINER, bpe.count_column)


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part, n_tokens, container_id): the texts of documents in containers of 2,048 tokens."""
    return _packed(spark, sf_dir)


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how full the containers are."""
    return packing.packing_report(_packed(spark, sf_dir), CONTAINER)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_a, doc_b): documents with a verbatim span of 160 characters in common."""
    return spans.shared_span_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", 160)


def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each document another one has too."""
    return spans.shared_coverage(table(spark, sf_dir, "documents"), "doc_id", "text", 160)


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_records": p1_records,
        "p2_found": p2_found,
        "p2_quotas": p2_quotas,
        "p2_sample": p2_sample,
        "p3_sample": p3_sample,
        "p3_growth": p3_growth,
        "p5_found": p5_found,
        "p5_forms": p5_forms,
        "p6_found": p6_found,
        "p6_scores": p6_scores,
        "p7_found": p7_found,
        "p7_groups": p7_groups,
        "p8_ids": p8_ids,
        "p8_decoded": p8_decoded,
        "p9_packing": p9_packing,
        "p9_report": p9_report,
        "p10_found": p10_found,
        "p10_coverage": p10_coverage,
    }


_CANONICAL = r"lower(trim(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"

_P1 = f"""
WITH r AS (
  SELECT line_id, record->>'question' AS q, from_json(record->'choices', '["VARCHAR"]') AS c, (record->>'answer_index')::BIGINT AS a FROM item_lines
), k AS (
  SELECT line_id, {_CANONICAL.format("q")} AS q, list_transform(c, lambda x: {_CANONICAL.format("x")}) AS c, a FROM r
), g AS (SELECT *, min(line_id) OVER (PARTITION BY q, c, a) AS keep_id, count(*) OVER (PARTITION BY q, c, a) AS copies FROM k)
"""

_BUCKET = f"('0x' || substr(md5('{nested.SALT}|' || id), 1, 8))::UBIGINT::BIGINT % {nested.BUCKETS}"
_CHOSEN = f"""
WITH o AS (
  SELECT b, row_number() OVER (ORDER BY md5('{nested.SALT}-order|' || b), b) AS place FROM (SELECT unnest(range({nested.BUCKETS})) AS b)
), chosen AS (SELECT b FROM o WHERE place <= {round(SHARE * nested.BUCKETS)})
"""

_TERMS = f"""
WITH t AS (
  SELECT pos, lower(unnest(flatten(list_transform(choices, lambda c: regexp_extract_all(c, '\\p{{L}}+'))))) AS term FROM items
), j AS (SELECT pos, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT pos, sum(tf)::DOUBLE AS n FROM j GROUP BY pos),
s AS (SELECT term, count(*) AS df, sum(tf)::DOUBLE AS total FROM j GROUP BY term),
z AS (SELECT sum(pow(n, {distinct.ALPHA})) AS z FROM n)
"""

_NEAR = r"""
WITH t AS (
  SELECT pos, list_concat(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+(?:[-''][a-z0-9]+)*'),
    flatten(list_transform(choices, lambda x: regexp_extract_all(lower(x), '[a-z0-9]+(?:[-''][a-z0-9]+)*')))) AS t FROM items
), s AS (SELECT pos, list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' '))) AS s FROM t WHERE len(t) >= 3),
p AS (SELECT pos, len(s) AS n, unnest(s) AS shingle FROM s),
i AS (
  SELECT a.pos AS pos_a, b.pos AS pos_b FROM p a JOIN p b ON a.shingle = b.shingle AND a.pos < b.pos GROUP BY a.pos, b.pos, a.n, b.n
  HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))
)"""

_SPANS = """
WITH g AS (SELECT doc_id, i, md5(substring(text, i, 160)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS i FROM documents WHERE length(text) >= 160)),
m AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)), k AS (SELECT g.* FROM g JOIN m USING (h))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT keep_id, line_id AS copy_id FROM g WHERE line_id <> keep_id",
        "p1_records": _P1
        + "SELECT keep_id, copies, r.q AS question, r.c AS choices, r.a AS answer_index FROM g JOIN r USING (line_id) WHERE line_id = keep_id",
        "p2_found": f"""
            WITH n AS (SELECT count(*) // {DIVISOR} AS n FROM items)
            SELECT t.subject FROM subject_targets t CROSS JOIN n
            WHERE (SELECT count(*) FROM items i WHERE i.subject = t.subject) < greatest(t.min_rows, (t.target_bp * n.n + 9999) // 10000)""",
        "p3_sample": _CHOSEN + f"SELECT pos, id, batch FROM items WHERE {_BUCKET} IN (SELECT b FROM chosen)",
        "p3_growth": _CHOSEN
        + f""", f AS (SELECT id, min(batch) AS batch FROM items WHERE id IS NOT NULL GROUP BY id)
            SELECT batch, count(*) AS ids, count(*) FILTER ({_BUCKET} IN (SELECT b FROM chosen)) AS chosen FROM f GROUP BY batch""",
        "p6_found": _TERMS + "SELECT pos, term FROM j JOIN s USING (term) WHERE tf >= 2 AND df BETWEEN 2 AND 6",
        "p6_scores": _TERMS
        + f"""SELECT pos, term, tf, df, round(CASE WHEN df > 1 THEN greatest(log2(tf * z / (total * pow(n, {distinct.ALPHA}))), 0.0) ELSE 0.0 END, 6) AS score
            FROM j JOIN s USING (term) JOIN n USING (pos) CROSS JOIN z""",
        "p7_found": _NEAR + "SELECT pos_a, pos_b FROM i",
        # classes of equal sets, and what can be reached from each row over similar rows
        "p7_groups": "WITH RECURSIVE" + _NEAR.lstrip().removeprefix("WITH") + """,
            e AS (SELECT pos_a AS a, pos_b AS b FROM i UNION ALL SELECT pos_b, pos_a FROM i),
            r AS (SELECT pos, min(pos) OVER (PARTITION BY list_sort(s)) AS rep FROM s),
            l AS (SELECT e.a AS pos, count(DISTINCT y.rep) FILTER (y.rep <> x.rep) AS n FROM e JOIN r x ON x.pos = e.a JOIN r y ON y.pos = e.b GROUP BY e.a),
            w(pos, root) AS (SELECT pos, pos FROM items UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.pos)
            SELECT pos, min(root) AS group_id, coalesce(any_value(l.n), 0) AS n_links FROM w LEFT JOIN l USING (pos) GROUP BY pos""",
        "p10_found": _SPANS
        + """, h AS (SELECT DISTINCT doc_id, h FROM k) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM h a JOIN h b ON a.h = b.h AND a.doc_id < b.doc_id""",
        "p10_coverage": _SPANS
        + """, c AS (SELECT doc_id, least(160, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 160)) AS n FROM k),
            t AS (SELECT doc_id, sum(n)::BIGINT AS n FROM c GROUP BY doc_id)
            SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n, 0) AS shared_chars, round(coalesce(coalesce(n, 0)::DOUBLE / nullif(length(text), 0), 0), 6) AS share
            FROM documents LEFT JOIN t USING (doc_id)""",
        # the round trip through the ids gives the text back; null and empty give an empty text
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
