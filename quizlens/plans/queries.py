"""Registered queries of the core, with their SQL. Keys begin with the operator's number in the inventory.

The corpus of most queries is ``items``: its valid rows, the first of each id. Each query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlens import resampling as rs
from quizlens.functions import statistics as st
from quizlens.functions import text as tx
from quizlens.judgement import JUDGED, Rule
from quizlens.operators import detectors as dt
from quizlens.operators import duplicates as du
from quizlens.operators import interventions as iv
from quizlens.operators import rejects, sampling, scoring
from quizlens.plans import audit as au
from quizlens.plans import report as rp
from quizlens.plans import sqltext as q
from quizlens.session import materialise, table
from quizlens.sources import benchmarks, synthetic

Query = Callable[[SparkSession, str], DataFrame]

SEED = 7
SAMPLE = 500
SIMULATED = scoring.SimulatedScorer({"skill": 0.4, "memory": 0.25, "distractors": 0.2, "options": 0.05}, position=0.1, favoured=1, seed=11)
_SIM_SQL = (11, 0.4, 0.25, 0.2, 0.1, 1, 0.05)
_DEFECTS = {"position": 0.3, "longest": 0.2, "marker": 0.1, "repeat": 0.05}
_SYNTHETIC_SEED, _SYNTHETIC_CHOICES = 3, 4

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows of items, the first of each id, as canonical items (FLT1 and the uniqueness of ids)."""
    rows = table(spark, sf_dir, "items")
    valid = rows.filter(
        (F.coalesce("id", F.lit("")) != "")
        & (F.size("choices") >= 2)
        & ~F.exists("choices", lambda c: c.isNull())
        & (F.col("answer_index") >= 0)
        & (F.col("answer_index") < F.size("choices"))
    )
    # one shuffle of whole rows, those of one id reduced to their first before it
    kept = F.struct("pos", F.coalesce("question", F.lit("")).alias("question"), "choices", "answer_index", F.coalesce("subject", F.lit("")).alias("subject"))
    first = valid.groupBy(F.col("id").alias("item_id")).agg(F.min_by(kept, "pos").alias("r"))
    return first.select("r.pos", "item_id", "r.question", "r.choices", "r.answer_index", "r.subject")


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.with_normal(corpus(spark, sf_dir))


def digested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, item_id, stem, digest, nc, answer_index) of the corpus; nothing is written."""
    return du.with_digests(corpus(spark, sf_dir)).select("pos", "item_id", "stem", "digest", "nc", "answer_index")


def shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(du.shingle_sets(corpus(spark, sf_dir)), "shingles")


def _r(column: str | Column, alias: str, places: int = 9) -> Column:
    return F.round(column, places).alias(alias)


# -- sources, projections, predicates --------------------------------------------------------------


@query(q.CORPUS + "SELECT pos, item_id, question, choices, answer_index, subject FROM c")
def flt1_valid_items(spark, sf_dir):
    return corpus(spark, sf_dir)


@query(
    """SELECT rec_id, CASE
         WHEN list_position(choices.label, trim(answer_key)) > 0 THEN list_position(choices.label, trim(answer_key)) - 1
         WHEN regexp_full_match(upper(trim(answer_key)), '[A-H]') AND ascii(upper(trim(answer_key))) - 65 < len(choices.text) THEN ascii(upper(trim(answer_key))) - 65
         WHEN regexp_full_match(trim(answer_key), '[0-9]{1,9}') AND trim(answer_key)::INT BETWEEN 1 AND len(choices.text) THEN trim(answer_key)::INT - 1 END AS answer_index
       FROM arc_items"""
)
def src10_answer_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "arc_items")
    return rows.select("rec_id", benchmarks.key_index(F.col("answer_key"), F.col("choices.label"), F.size("choices.text")).alias("answer_index"))


_VOCABULARY = "[" + ", ".join(f"'{w}'" for w in synthetic.vocabulary()) + "]"


def _sql_words(name: str, n: int) -> str:
    digest = f"sha256('{_SYNTHETIC_SEED}|{name}|' || src)"
    return f"array_to_string(list_transform(range({n}), lambda k: v.words[(('0x' || substr({digest}, (k * 4 + 1)::INT, 4))::BIGINT % {synthetic.VOCABULARY} + 1)::INT]), ' ')"


_HIT = lambda name: f"{q.uniform(_SYNTHETIC_SEED, name, 'src', 0)} < {_DEFECTS[name]}"
_OPTIONS = []
for _j in range(_SYNTHETIC_CHOICES):
    _plain = _sql_words(f"option-{_j}", synthetic.OPTION_WORDS)
    _marked = f"CASE WHEN a = {_j} AND {_HIT('marker')} THEN '{synthetic.MARKER}' || substr({_plain}, 8) ELSE {_plain} END"
    _OPTIONS.append(f"CASE WHEN a = {_j} AND {_HIT('longest')} THEN ({_marked}) || ' ' || {_sql_words('padding', synthetic.PADDING_WORDS)} ELSE {_marked} END")


@query(
    f"""WITH v AS (SELECT {_VOCABULARY} AS words), t AS (SELECT count(*) AS n FROM items),
        g AS (SELECT pos, pos % n AS src FROM (SELECT n, unnest(range(n + floor(n * {_DEFECTS['repeat']}::DOUBLE)::BIGINT)) AS pos FROM t)),
        h AS (SELECT *, CASE WHEN {_HIT('position')} THEN 0 ELSE floor({q.uniform(_SYNTHETIC_SEED, 'key', 'src', 0)} * {_SYNTHETIC_CHOICES})::INT END AS a, FROM g)
        SELECT pos, 'syn-' || lpad(pos::VARCHAR, 7, '0') AS item_id, a AS answer_index, [{', '.join(_OPTIONS)}] AS choices,
          {list(synthetic.SUBJECTS)}[(src % {len(synthetic.SUBJECTS)} + 1)::INT] AS subject, upper(left(w, 1)) || substr(w, 2) || '?' AS question
        FROM (SELECT *, {_sql_words('question', synthetic.QUESTION_WORDS)} AS w FROM h CROSS JOIN v) AS v"""
)
def src12_synthetic(spark, sf_dir):
    """A synthetic corpus of as many items as ``items`` has, with all defects planted."""
    return synthetic.generate(spark, table(spark, sf_dir, "items").count(), _SYNTHETIC_SEED, _SYNTHETIC_CHOICES, **_DEFECTS)


@query(q.CORPUS + "SELECT pos, choices[answer_index + 1] AS answer FROM c")
def prj1_answer_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("pos", F.element_at("choices", F.col("answer_index") + 1).alias("answer"))


@query(q.CORPUS + "SELECT pos, len(choices) AS n_choices FROM c")
def prj2_choice_count(spark, sf_dir):
    return corpus(spark, sf_dir).select("pos", F.size("choices").alias("n_choices"))


@query(q.CORPUS + "SELECT answer_index, choices, item_id AS id, question, nullif(subject, '') AS subject FROM c")
def prj3_canonical_record(spark, sf_dir):
    return corpus(spark, sf_dir).select("answer_index", "choices", F.col("item_id").alias("id"), "question", F.nullif("subject", F.lit("")).alias("subject"))


@query(
    q.CORPUS
    + f"SELECT pos, i - 1 AS option, (i - 1 = answer_index)::INT AS is_key, {q.tokens('choices[i]')} AS words FROM (SELECT *, unnest(range(1, len(choices) + 1)) AS i FROM c)"
)
def prj4_option_rows(spark, sf_dir):
    return dt.option_rows(corpus(spark, sf_dir), SEED).select("pos", "option", "is_key", "words")


_UNIFORM = ", modal AS (SELECT len(choices) AS k FROM c GROUP BY k ORDER BY count(*) DESC, k DESC LIMIT 1), u AS (SELECT c.* FROM c JOIN modal ON len(choices) = k)"


@query(q.CORPUS + _UNIFORM + "SELECT pos, len(choices) AS k FROM u")
def flt2_largest_uniform(spark, sf_dir):
    return dt.largest_uniform(corpus(spark, sf_dir)).select("pos", "k")


@query(q.NORMAL + ", p AS (SELECT *, choices[answer_index + 1] AS answer FROM n) SELECT a.pos, count(*) AS usable FROM p a JOIN p b ON a.subject = b.subject WHERE NOT list_contains(a.nc, "
       + q.norm("b.answer") + ") GROUP BY a.pos")
def flt3_usable_distractors(spark, sf_dir):
    """How many entries of its subject's pool each item could take, without pairing items: the pool's size less the
    entries that are equal to one of the item's options."""
    rows = normal(spark, sf_dir)
    pool = rows.select("subject", F.get("nc", F.col("answer_index")).alias("nanswer")).groupBy("subject", "nanswer").agg(F.count(F.lit(1)).alias("n"))
    sizes = pool.groupBy("subject").agg(F.sum("n").alias("size"))
    own = rows.select("pos", "subject", F.explode(F.array_distinct("nc")).alias("nanswer")).join(pool, ["subject", "nanswer"]).groupBy("pos").agg(F.sum("n").alias("taken"))
    counted = rows.select("pos", "subject").join(sizes, "subject").join(own, "pos", "left")
    return counted.select("pos", (F.col("size") - F.coalesce("taken", F.lit(0))).alias("usable")).filter("usable > 0")


@query(q.CORPUS + "SELECT pos, subject, choices[answer_index + 1] AS answer FROM c WHERE pos <> 1")
def flt4_pool_without(spark, sf_dir):
    return iv.pool_without(iv.distractor_pool(corpus(spark, sf_dir)), 1)


@query(q.CORPUS + "SELECT pos, pos % 2 = 0 AS ok FROM c")
def flt6_digest_shape(spark, sf_dir):
    rows = digested(spark, sf_dir)
    return rows.select("pos", tx.is_digest(F.when(F.col("pos") % 2 == 0, F.col("digest")).otherwise(F.upper("digest"))).alias("ok"))


@query(q.CORPUS + "SELECT count(*) >= 10 AS near_duplicate, count(*) >= 20 AS longest_answer, count(*) >= 50 AS choices_only FROM c")
def flt7_applicability(spark, sf_dir):
    n = F.count(F.lit(1))
    return corpus(spark, sf_dir).agg(*((n >= dt.MIN_ITEMS[x]).alias(x) for x in ("near_duplicate", "longest_answer", "choices_only")))


# -- scalar functions ------------------------------------------------------------------------------


@query(q.NORMAL + "SELECT pos, nq, nc FROM n")
def sc1_normalise_text(spark, sf_dir):
    return normal(spark, sf_dir).select("pos", "nq", "nc")


@query(f"SELECT doc_id, {q.tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL")
def sc2_tokenise(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    return rows.select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


@query(q.NORMAL + "SELECT pos, min(pos) OVER (PARTITION BY nq, nc, answer_index) AS item_class, min(pos) OVER (PARTITION BY nq, nc) AS stem_class FROM n")
def sc4_digest_classes(spark, sf_dir):
    """Digests are checked as identities: which items have the same ones."""
    rows = materialise(digested(spark, sf_dir).select("pos", "digest", "stem"), "digests")
    items = rows.groupBy("digest").agg(F.min("pos").alias("item_class"))
    stems = rows.groupBy("stem").agg(F.min("pos").alias("stem_class"))
    return rows.join(items, "digest").join(stems, "stem").select("pos", "item_class", "stem_class")


@query(q.SHINGLES + "SELECT pos, list_sort(shingles) AS shingles FROM s")
def sc8_shingles(spark, sf_dir):
    return du.shingle_sets(corpus(spark, sf_dir)).select("pos", F.array_sort("shingles").alias("shingles"))


@query(
    q.CORPUS
    + f""", t AS (SELECT item_id, {q.tokens('question')} AS q, list_distinct(flatten(list_transform(choices, lambda x: {q.tokens('x')}))) AS c, pos FROM c), d AS (SELECT pos, list_distinct(q) AS q, c FROM t)
      SELECT pos, round(CASE WHEN len(q) + len(c) = 0 THEN 0 ELSE len(list_intersect(q, c))::DOUBLE / (len(q) + len(c) - len(list_intersect(q, c))) END, 9) AS jaccard FROM d"""
)
def sc9_jaccard(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    words = F.array_distinct(F.flatten(F.transform("choices", tx.tokens)))
    return rows.select("pos", F.array_distinct(tx.tokens(F.col("question"))).alias("q"), words.alias("c")).select("pos", _r(tx.jaccard(F.col("q"), F.col("c")), "jaccard"))


_LONGEST = ", l AS (SELECT *, list_max(list_transform(choices, lambda x: length(x))) AS m FROM c), lw AS (SELECT *, len(list_filter(choices, lambda x: length(x) = m)) AS w, length(choices[answer_index + 1]) = m AS hit FROM l)"


@query(q.CORPUS + _LONGEST + "SELECT pos, round(CASE WHEN hit THEN 1.0::DOUBLE / w ELSE 0 END, 9) AS credit, w AS winners FROM lw")
def sc10_longest_credit(spark, sf_dir):
    return corpus(spark, sf_dir).select("pos", _r(tx.longest_credit(F.col("choices"), F.col("answer_index")), "credit"), tx.longest_count(F.col("choices")).alias("winners"))


@query(q.CORPUS + f"SELECT pos, round({q.uniform(SEED, 'probe', 'pos', 0)}, 12) AS u0, round({q.uniform(SEED, 'probe', 'pos', 5)}, 12) AS u5 FROM c")
def sc13_uniforms(spark, sf_dir):
    u = lambda slot: tx.uniform(SEED, "probe", F.col("pos"), slot)
    return corpus(spark, sf_dir).select("pos", _r(u(0), "u0", 12), _r(u(5), "u5", 12))


_REPLY = "CASE pos % 6 WHEN 0 THEN chr((65 + answer_index)::INT) WHEN 1 THEN '(' || lower(chr((65 + answer_index)::INT)) || ').' WHEN 2 THEN 'Answer: ' || chr((65 + answer_index)::INT) || ') ' || choices[1] WHEN 3 THEN 'I would pick H, no, option ' || chr((65 + answer_index)::INT) || ' here' WHEN 4 THEN 'Cannot tell.' ELSE '' END"


@query(
    q.CORPUS
    + f""", y AS (SELECT pos, len(choices) AS k, upper(trim({_REPLY})) AS t FROM c),
      e AS (SELECT pos, k, regexp_replace(t, '^[^A-Z0-9]+|[^A-Z0-9]+$', '', 'g') AS bare,
        list_filter(list_transform(regexp_extract_all(t, '\\b([A-H])[).:\\]]', 1), lambda x: ascii(x) - 65), lambda i: i < k) AS marked,
        list_filter(list_transform(regexp_extract_all(t, '\\b([A-H])\\b', 1), lambda x: ascii(x) - 65), lambda i: i < k) AS worded FROM y)
      SELECT pos, coalesce(CASE WHEN regexp_full_match(bare, '[A-H]') AND ascii(bare) - 65 < k THEN ascii(bare) - 65 END, marked[1], worded[1]) AS choice FROM e"""
)
def sc16_parsed_reply(spark, sf_dir):
    letter = F.chr(F.lit(65) + F.col("answer_index"))
    reply = (
        F.when(F.col("pos") % 6 == 0, letter)
        .when(F.col("pos") % 6 == 1, F.concat(F.lit("("), F.lower(letter), F.lit(").")))
        .when(F.col("pos") % 6 == 2, F.concat(F.lit("Answer: "), letter, F.lit(") "), F.get("choices", 0)))
        .when(F.col("pos") % 6 == 3, F.concat(F.lit("I would pick H, no, option "), letter, F.lit(" here")))
        .when(F.col("pos") % 6 == 4, F.lit("Cannot tell."))
        .otherwise("")
    )
    return corpus(spark, sf_dir).select("pos", tx.parsed_reply(reply, F.size("choices")).alias("choice"))


@query(
    q.CORPUS
    + """SELECT pos, CASE WHEN trim(question) = '' THEN l ELSE question || chr(10) || l END AS labelled, CASE WHEN trim(question) = '' THEN 'Complete with the right option:' || chr(10) || '->' ELSE 'Complete with the right option:' || chr(10) || question || chr(10) || '->' END AS cloze
         FROM (SELECT *, array_to_string(list_transform(choices, lambda x, i: chr((64 + i)::INT) || '. ' || x), chr(10)) AS l FROM c)"""
)
def sc17_prompts(spark, sf_dir):
    return corpus(spark, sf_dir).select("pos", tx.labelled_prompt(F.col("question"), F.col("choices")).alias("labelled"), tx.cloze_prompt(F.col("question")).alias("cloze"))


_Z = st.quantile(0.995)
_ZP = st.quantile(0.8)


@query(
    q.CORPUS
    + f""", g AS (SELECT subject, count(*) AS n, sum((answer_index = 0)::INT) AS hits FROM c GROUP BY subject), h AS (SELECT *, hits::DOUBLE / n AS p, {_Z * _Z}::DOUBLE AS z2 FROM g),
      i AS (SELECT *, (p + z2 / (2 * n)) / (1 + z2 / n) AS mid, sqrt(z2) * sqrt(p * (1 - p) / n + z2 / (4.0::DOUBLE * n * n)) / (1 + z2 / n) AS half FROM h)
      SELECT subject, round(greatest(0, mid - half), 9) AS low, round(least(1, mid + half), 9) AS high FROM i"""
)
def sc19_wilson(spark, sf_dir):
    rows = corpus(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer_index") == 0).alias("hits"))
    low, high = st.wilson(F.col("hits"), F.col("n"), 0.01)
    return rows.select("subject", _r(low, "low"), _r(high, "high"))


@query(
    q.CORPUS
    + f""", g AS (SELECT subject, count(*) AS n, avg((answer_index = 0)::INT)::DOUBLE AS p FROM c GROUP BY subject)
      SELECT subject, round(({_Z} + {_ZP}) * sqrt(p * (1 - p) / n), 9) AS from_se, round(({_Z} + {_ZP}) * sqrt(p / n), 9) AS from_discordance, round(({_Z} + {_ZP}) * (p / 2) / {_Z}, 9) AS from_width FROM g"""
)
def sc20_minimum_effects(spark, sf_dir):
    rows = corpus(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer_index") == 0).alias("hits"))
    p = F.col("hits") / F.col("n")
    return rows.select(
        "subject",
        _r(st.mde_from_se(F.sqrt(p * (1 - p) / F.col("n")), 0.01, 0.8), "from_se"),
        _r(st.mde_from_discordance(p, F.col("n"), 0.01, 0.8), "from_discordance"),
        _r(st.mde_from_interval(F.lit(0.0), p, 0.01, 0.8), "from_width"),
    )


@query(
    q.CORPUS
    + """, g AS (SELECT subject, sum((answer_index = 0)::INT) AS b, sum((answer_index = 1)::INT) AS c2 FROM c GROUP BY subject), h AS (SELECT subject, b + c2 AS d, least(b, c2) AS m FROM g)
      SELECT subject, round(CASE WHEN d = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range((m + 1)::BIGINT), lambda i: exp(lgamma(d + 1) - lgamma(i + 1) - lgamma(d - i + 1) - d * ln(2))))) END, 6) AS p_value FROM h"""
)
def sc23_mcnemar_p(spark, sf_dir):
    rows = corpus(spark, sf_dir).groupBy("subject").agg(F.count_if(F.col("answer_index") == 0).alias("b"), F.count_if(F.col("answer_index") == 1).alias("c"))
    return rows.select("subject", _r(st.mcnemar_p(F.col("b"), F.col("c")), "p_value", 6))


@query(q.CORPUS + "SELECT subject, round(quantile_cont(length(question)::DOUBLE, 0.005), 9) AS low, round(quantile_cont(length(question)::DOUBLE, 0.995), 9) AS high FROM c GROUP BY subject")
def sc25_percentile_interval(spark, sf_dir):
    low, high = st.percentile_interval(F.length("question").cast("double"), 0.01)
    return corpus(spark, sf_dir).groupBy("subject").agg(_r(low, "low"), _r(high, "high"))


_FAMILY = """, g AS (SELECT subject, count(*) AS n, count(DISTINCT answer_index) AS k, sum((answer_index = 0)::INT) AS x FROM c GROUP BY subject),
      f AS (SELECT subject, n, x::DOUBLE / n - 0.25 AS point, 1.0 / (1 + (x * 7 + n) % 997) AS p FROM g)"""


def _family(spark, sf_dir) -> DataFrame:
    rows = corpus(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer_index") == 0).alias("x"))
    return rows.select("subject", "n", (F.col("x") / F.col("n") - 0.25).alias("point"), (1.0 / (1 + (F.col("x") * 7 + F.col("n")) % 997)).alias("p"))


@query(
    q.CORPUS
    + _FAMILY
    + """, r AS (SELECT subject, p, row_number() OVER (ORDER BY p, subject) AS i, count(*) OVER () AS m FROM f)
      SELECT subject, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i), 9) AS adjusted FROM r"""
)
def wn3_holm(spark, sf_dir):
    return st.holm(_family(spark, sf_dir), "p", ["subject"]).select("subject", _r("adjusted", "adjusted"))


@query(
    q.CORPUS
    + _FAMILY
    + f"""SELECT subject, CASE WHEN p > 0.01 THEN 'p' WHEN NOT (point - 0.05 > 0 OR point + 0.05 < 0) THEN 'zero' WHEN abs(point) < 0.005 THEN 'small' WHEN point <= 0 THEN 'sign' ELSE 'established' END AS decision FROM f"""
)
def sc27_gate(spark, sf_dir):
    rows = _family(spark, sf_dir)
    return rows.select("subject", st.gate(F.col("point"), F.col("point") - 0.05, F.col("point") + 0.05, F.col("p"), 0.01, 0.005).alias("decision"))


@query(q.CORPUS + _FAMILY + "SELECT subject, round(least(0.0, point), 9) AS low, round(greatest(0.01, point), 9) AS high FROM f")
def sc28_widening(spark, sf_dir):
    low, high = st.covering(F.lit(0.0), F.lit(0.01), F.col("point"))
    return _family(spark, sf_dir).select("subject", _r(low, "low"), _r(high, "high"))


# -- joins, groups, windows ------------------------------------------------------------------------


@query(q.NORMAL + ", h AS (SELECT nq, nc, answer_index, min(pos) AS first_pos, count(*) AS n FROM n GROUP BY ALL) SELECT first_pos, n FROM h WHERE n > 1")
def ag1_exact_groups(spark, sf_dir):
    return du.exact_groups(digested(spark, sf_dir)).select("first_pos", "n")


_CONTRADICTIONS = ", h AS (SELECT nq, nc, min(pos) AS first_pos, count(*) AS n, count(DISTINCT nc[answer_index + 1]) AS answers FROM n GROUP BY nq, nc)"


@query(q.NORMAL + _CONTRADICTIONS + "SELECT first_pos, n, answers FROM h WHERE n > 1 AND answers > 1")
def ag2_contradictions(spark, sf_dir):
    return du.contradiction_groups(digested(spark, sf_dir)).select("first_pos", "n", "answers")


@query(q.NORMAL + ", h AS (SELECT count(*) AS n FROM n GROUP BY nq, nc, answer_index) SELECT coalesce(sum(n - 1), 0)::BIGINT AS redundant FROM h WHERE n > 1")
def ag3_redundant_copies(spark, sf_dir):
    return du.redundant_copies(du.exact_groups(digested(spark, sf_dir)))


_NEAR = ", i AS (SELECT a.pos AS pos_a, b.pos AS pos_b, a.n AS na, b.n AS nb, count(*) AS c FROM p a JOIN p b ON a.shingle = b.shingle AND a.pos < b.pos GROUP BY ALL), nd AS (SELECT pos_a, pos_b, c::DOUBLE / (na + nb - c) AS similarity FROM i WHERE 10 * c >= 9 * (na + nb - c))"


@query(
    q.SHINGLES
    + _NEAR
    + f""", n AS (SELECT *, {q.norm('question')} AS nq, {q.norm_list('choices')} AS nc FROM c),
      e AS (SELECT pos, count(*) OVER (PARTITION BY nq, nc, answer_index) > 1 AS exact FROM n),
      st AS (SELECT nq, nc FROM n GROUP BY nq, nc HAVING count(*) > 1 AND count(DISTINCT nc[answer_index + 1]) > 1),
      x AS (SELECT pos FROM n JOIN st USING (nq, nc)), nr AS (SELECT pos_a AS pos FROM nd UNION SELECT pos_b FROM nd),
      k AS (SELECT pos, exact, pos IN (SELECT pos FROM x) AS contradictory, pos IN (SELECT pos FROM nr) AS near FROM e)
      SELECT count(*) AS items, (SELECT coalesce(sum(m - 1), 0)::BIGINT FROM (SELECT count(*) AS m FROM n GROUP BY nq, nc, answer_index)) AS redundant, count(*) FILTER (exact OR contradictory OR near) AS affected,
        count(*) FILTER (contradictory) AS contradictory, count(*) FILTER (near AND NOT exact) AS near_only FROM k"""
)
def ag4_census(spark, sf_dir):
    return du.census(materialise(corpus(spark, sf_dir), "items"))


@query(q.SHINGLES + "SELECT shingle, df FROM d")
def ag5_shingle_frequency(spark, sf_dir):
    return du.shingle_frequency(shingled(spark, sf_dir))


_HIST = _UNIFORM + ", ph AS (SELECT x.position::INT AS position, count(u.pos) AS n FROM (SELECT unnest(range(k)) AS position FROM modal) x LEFT JOIN u ON u.answer_index = x.position GROUP BY x.position)"


@query(q.CORPUS + _HIST + "SELECT position, n FROM ph")
def ag6_position_histogram(spark, sf_dir):
    return dt.position_histogram(corpus(spark, sf_dir))


@query(
    q.CORPUS
    + _HIST
    + """, t AS (SELECT sum(n)::BIGINT AS t, count(*) AS k FROM ph) SELECT max(t) AS n, max(k) AS k, round(sum(abs(n / t::DOUBLE - 1.0 / k)) / 2, 9) AS total_variation,
      round(sum(pow(n - t::DOUBLE / k, 2) / (t::DOUBLE / k)), 9) AS chi_square, (SELECT position FROM ph ORDER BY n DESC, position LIMIT 1) AS modal_position, round(max(n)::DOUBLE / max(t), 9) AS modal_share FROM ph CROSS JOIN t"""
)
def ag7_position_statistics(spark, sf_dir):
    return dt.position_statistics(dt.position_histogram(corpus(spark, sf_dir)))


@query(
    q.CORPUS
    + _LONGEST
    + """, e AS (SELECT len(choices) AS k, w, CASE WHEN hit THEN 1.0::DOUBLE / w ELSE 0 END AS v FROM lw)
      SELECT count(*) AS n, round(sum(v) / count(*), 9) AS accuracy, round(sum(1.0::DOUBLE / k) / count(*), 9) AS chance, round(sum(v - 1.0::DOUBLE / k) / count(*), 9) AS excess, sum((w > 1)::INT)::BIGINT AS ties FROM e"""
)
def ag10_longest_statistics(spark, sf_dir):
    return dt.longest_statistics(corpus(spark, sf_dir))


_FOLD = f"(('0x' || substr(sha256('{SEED}|fold|' || pos), 1, 8))::UBIGINT::BIGINT % {dt.FOLDS})::INT"
_TOKENS = (
    f""", ro AS (SELECT pos, {_FOLD} AS fold, len(choices) AS k, i - 1 AS option, (i - 1 = answer_index)::INT AS is_key, {q.tokens('choices[i]')} AS words FROM (SELECT *, unnest(range(1, len(choices) + 1)) AS i FROM c)),
      tk AS (SELECT * EXCLUDE (words), unnest(words) AS token FROM ro),
      ct AS (SELECT fold, token, sum(is_key)::BIGINT AS key_n, sum(1 - is_key)::BIGINT AS other_n FROM tk GROUP BY fold, token)"""
)
_WEIGHTS = (
    _TOKENS
    + f""", tt AS (SELECT token, sum(key_n) AS kt, sum(other_n) AS ot FROM ct GROUP BY token),
      tr AS (SELECT f.fold, tt.token, kt - coalesce(key_n, 0) AS p, ot - coalesce(other_n, 0) AS q FROM tt CROSS JOIN (SELECT unnest(range({dt.FOLDS}))::INT AS fold) f LEFT JOIN ct ON ct.fold = f.fold AND ct.token = tt.token),
      tn AS (SELECT * FROM tr WHERE p + q > 0), sm AS (SELECT fold, sum(p)::DOUBLE AS ps, sum(q)::DOUBLE AS qs, count(*) AS v FROM tn GROUP BY fold),
      wt AS (SELECT fold, token, ln((p + 1) / (ps + v)) - ln((q + 1) / (qs + v)) AS weight FROM tn JOIN sm USING (fold))"""
)


@query(q.CORPUS + _TOKENS + "SELECT fold, token, key_n, other_n FROM ct")
def ag12_token_counts(spark, sf_dir):
    return dt.token_counts(dt.option_rows(corpus(spark, sf_dir), SEED))


@query(q.CORPUS + _WEIGHTS + "SELECT fold, token, round(weight, 9) AS weight FROM wt")
def sc11_token_weights(spark, sf_dir):
    counts = materialise(dt.token_counts(dt.option_rows(corpus(spark, sf_dir), SEED)), "token-counts")
    return dt.token_weights(counts).select("fold", "token", _r("weight", "weight"))


@query(
    q.CORPUS
    + _WEIGHTS
    + """, oc AS (SELECT ro.pos, ro.k, ro.option, ro.is_key, coalesce(sum(wt.weight::DECIMAL(20,12)), 0) AS score FROM ro LEFT JOIN tk ON tk.pos = ro.pos AND tk.option = ro.option LEFT JOIN wt ON wt.fold = tk.fold AND wt.token = tk.token GROUP BY ALL),
      bs AS (SELECT *, max(score) OVER (PARTITION BY pos) AS top FROM oc), cr AS (SELECT pos, k, avg(is_key) FILTER (score = top) AS credit FROM bs GROUP BY pos, k)
      SELECT count(*) AS n, round(avg(credit), 6) AS accuracy, round(avg(credit - 1.0::DOUBLE / k), 6) AS excess FROM cr"""
)
def ag13_probe_excess(spark, sf_dir):
    rows = dt.probe_histogram(corpus(spark, sf_dir), SEED)
    n = F.col("n")
    return rows.agg(F.sum("n").alias("n"), _r(F.sum(F.col("credit") * n) / F.sum(n), "accuracy", 6), _r(F.sum((F.col("credit") - 1 / F.col("k")) * n) / F.sum(n), "excess", 6))


@query(q.CORPUS + "SELECT round(avg(1.0::DOUBLE / len(choices)), 9) AS chance FROM c")
def ag18_chance(spark, sf_dir):
    return au.chance_accuracy(corpus(spark, sf_dir))


@query(q.CORPUS + "SELECT subject, count(*) AS n FROM c GROUP BY subject")
def ag19_subject_sizes(spark, sf_dir):
    return sampling.subject_sizes(corpus(spark, sf_dir))


_SIZED = lambda x: f"length({x}) || ':' || {x}"


@query(
    q.NORMAL
    + f""", d AS (SELECT pos, sha256(item_id || '|sha256:' || sha256('item' || chr(31) || {_SIZED('nq')} || chr(31)
        || array_to_string(list_transform(nc, lambda x: {_SIZED('x')}), chr(30)) || chr(31) || answer_index)) AS d FROM n)
      SELECT floor(pos / 100000)::BIGINT AS range, count(*) AS n, sha256(string_agg(d, '' ORDER BY pos)) AS digest FROM d GROUP BY ALL"""
)
def ag22_corpus_hash(spark, sf_dir):
    return au.range_digests(corpus(spark, sf_dir))


@query(q.NORMAL + "SELECT pos, item_id FROM n QUALIFY pos = min(pos) OVER (PARTITION BY nq, nc, answer_index)")
def wn1_deduplicated(spark, sf_dir):
    return du.deduplicated(materialise(digested(spark, sf_dir).select("pos", "item_id", "digest"), "digests")).select("pos", "item_id")


_RAREST = ", rr AS (SELECT pos, shingle, df, row_number() OVER (PARTITION BY pos ORDER BY df, shingle) AS rank FROM p JOIN d USING (shingle))"


@query(q.SHINGLES + _RAREST + "SELECT pos, shingle, df, rank FROM rr WHERE rank <= 3")
def wn2_rarest_shingles(spark, sf_dir):
    return du.rarest_shingles(shingled(spark, sf_dir))


@query(
    q.CORPUS
    + """, v2 AS (SELECT pos, length(question) AS x FROM c), s2 AS (SELECT sum(x) AS s, count(*) AS n FROM v2) SELECT pos, round((s - x)::DOUBLE / (n - 1), 9) AS left_out FROM v2 CROSS JOIN s2"""
)
def wn6_jackknife(spark, sf_dir):
    rows = materialise(corpus(spark, sf_dir).select("pos", F.length("question").alias("x")), "values")
    return rows.select("pos", _r(st.jackknife(rows, "x"), "left_out"))


_CLASSES = """, sc AS (SELECT pos, min(pos) OVER (PARTITION BY list_sort(shingles)) AS rep FROM s)"""


@query(
    q.SHINGLES
    + _RAREST
    + _CLASSES
    + """, rp AS (SELECT DISTINCT rep FROM sc) SELECT DISTINCT least(a.pos, b.pos) AS rep_a, greatest(a.pos, b.pos) AS rep_b
      FROM rr a JOIN p b ON a.shingle = b.shingle AND a.pos <> b.pos WHERE a.rank <= 3 AND a.pos IN (SELECT rep FROM rp) AND b.pos IN (SELECT rep FROM rp)"""
)
def jn1_candidate_pairs(spark, sf_dir):
    """Candidate pairs between the representatives of equal shingle sets; ``jn1_members`` says which items each stands for."""
    sets = shingled(spark, sf_dir)
    return du.candidate_classes(sets, materialise(du.set_classes(sets), "classes"))


@query(q.SHINGLES + _CLASSES + "SELECT rep, pos FROM sc")
def jn1_members(spark, sf_dir):
    return du.set_classes(du.shingle_sets(corpus(spark, sf_dir)))


@query(q.SHINGLES + _NEAR + "SELECT pos_a, pos_b, round(similarity, 9) AS similarity FROM nd")
def jn2_near_pairs(spark, sf_dir):
    return du.near_pairs(du.shingle_sets(corpus(spark, sf_dir)))


@query(
    q.SHINGLES
    + _RAREST
    + ", pr AS (SELECT DISTINCT least(a.pos, b.pos) AS pos_a, greatest(a.pos, b.pos) AS pos_b FROM rr a JOIN p b ON a.shingle = b.shingle AND a.pos <> b.pos WHERE a.rank <= 3), en AS (SELECT pos_a AS pos FROM pr UNION ALL SELECT pos_b FROM pr) SELECT pos, count(*) AS candidates, count(*) > 400 AS over FROM en GROUP BY pos"
)
def topk1_candidate_ceiling(spark, sf_dir):
    sets = shingled(spark, sf_dir)
    classes = materialise(du.set_classes(sets), "classes")
    return du.ceiling_flags(materialise(du.candidate_classes(sets, classes), "candidates"), classes)


# -- order, samples, sets --------------------------------------------------------------------------


@query(q.CORPUS + "SELECT DISTINCT subject FROM c")
def srt2_subjects(spark, sf_dir):
    return sampling.subjects(corpus(spark, sf_dir))


_KEY = f"sha256('{SEED}|sample|' || item_id)"


@query(q.CORPUS + f"SELECT pos, item_id FROM c ORDER BY {_KEY} LIMIT {SAMPLE}")
def smp1_simple_sample(spark, sf_dir):
    return sampling.simple_sample(corpus(spark, sf_dir), SAMPLE, SEED).select("pos", "item_id")


_QUOTAS = f""", g AS (SELECT subject, count(*) AS n FROM c GROUP BY subject), h AS (SELECT *, sum(n) OVER () AS t, least({SAMPLE}, sum(n) OVER ()) AS w FROM g),
      e AS (SELECT *, (w * n) // t AS fl, row_number() OVER (ORDER BY (w * n) % t DESC, subject) AS r FROM h), qt AS (SELECT subject, n, (fl + (r <= w - sum(fl) OVER ())::INT)::BIGINT AS quota FROM e)"""


@query(q.CORPUS + _QUOTAS + "SELECT subject, n, quota FROM qt")
def smp2_quotas(spark, sf_dir):
    return sampling.quotas(corpus(spark, sf_dir), SAMPLE)


@query(q.CORPUS + _QUOTAS + f", rk AS (SELECT pos, item_id, subject, row_number() OVER (PARTITION BY subject ORDER BY {_KEY}) AS i FROM c) SELECT pos, item_id FROM rk JOIN qt USING (subject) WHERE i <= quota")
def smp2_stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(corpus(spark, sf_dir), SAMPLE, SEED).select("pos", "item_id")


@query(q.CORPUS + ", b1 AS (SELECT pos, item_id FROM c WHERE pos % 2 = 0), b2 AS (SELECT pos, item_id FROM c WHERE pos % 2 = 1) SELECT pos, item_id FROM b1 UNION ALL SELECT pos + (SELECT max(pos) + 1 FROM b1), item_id FROM b2")
def set1_union(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return benchmarks.union_corpora([rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1")]).select("pos", "item_id")


@query(
    q.SHINGLES
    + _NEAR
    + f""", n AS (SELECT *, {q.norm('question')} AS nq, {q.norm_list('choices')} AS nc FROM c), e AS (SELECT pos FROM n QUALIFY count(*) OVER (PARTITION BY nq, nc, answer_index) > 1),
      st AS (SELECT nq, nc FROM n GROUP BY nq, nc HAVING count(*) > 1 AND count(DISTINCT nc[answer_index + 1]) > 1) SELECT pos FROM e UNION SELECT pos FROM n JOIN st USING (nq, nc) UNION SELECT pos_a FROM nd UNION SELECT pos_b FROM nd"""
)
def set2_affected(spark, sf_dir):
    return du.affected_items(materialise(corpus(spark, sf_dir), "items")).select("pos")


@query(
    q.CORPUS
    + """, m AS (SELECT subject, count(*) FILTER (answer_index = 0) AS b, count(*) FILTER (answer_index = 1) AS v, count(*) AS n FROM c GROUP BY subject)
      SELECT subject AS part, 4 * b > n AS baseline, 4 * v > n AS variant FROM m WHERE (4 * b > n) <> (4 * v > n)"""
)
def set4_difference(spark, sf_dir):
    """The difference of two judged tables: a subject counts as charged to a run if its favoured position holds more than a quarter of the keys."""
    counted = corpus(spark, sf_dir).groupBy(F.col("subject").alias("part")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("answer_index") == k).alias(f"h{k}") for k in (0, 1)))
    counted = materialise(counted, "favoured")

    def run(k: int) -> DataFrame:
        verdict = F.when(F.col(f"h{k}") * 4 > F.col("n"), st.ESTABLISHED).otherwise("p")
        given = {"layer": F.lit("share"), "part": F.col("part"), "verdict": verdict}
        return counted.select(*(given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in JUDGED))

    return rp.charged_difference(run(0), run(1))


# -- interventions, scoring, audit -----------------------------------------------------------------


@query(q.CORPUS + f"SELECT pos, variant, {q.rotated('choices', 'answer_index', 'variant')} AS choices, variant AS answer_index FROM (SELECT *, unnest(range(len(choices)))::INT AS variant FROM c)")
def iv1_permute_options(spark, sf_dir):
    return iv.permute_options(corpus(spark, sf_dir)).select("pos", "variant", "choices", "answer_index")


@query(q.CORPUS + "SELECT pos, '' AS question FROM c")
def iv2_hide_question(spark, sf_dir):
    return iv.apply_coalition(corpus(spark, sf_dir), ["hide_question", "neutral_reframing"], SEED).select("pos", "question")


@query(q.CORPUS + f"SELECT pos, {q.reframed('question', iv.PREFIX)} AS question FROM c")
def iv3_neutral_reframing(spark, sf_dir):
    return iv.apply_coalition(corpus(spark, sf_dir), ["neutral_reframing"], SEED).select("pos", "question")


@query(q.draws(SEED) + "SELECT pos, distracted AS choices FROM k")
def iv4_stronger_distractor(spark, sf_dir):
    return iv.stronger_distractor(corpus(spark, sf_dir), SEED).select("pos", "choices")


@query(q.CORPUS + "SELECT pos, subject, choices[answer_index + 1] AS answer FROM c")
def iv5_distractor_pool(spark, sf_dir):
    return iv.distractor_pool(corpus(spark, sf_dir))


@query(q.variants(SEED, iv.PREFIX) + "SELECT pos, mask, variant, nq, nc, answer_index FROM r")
def jn3_coalition_grid(spark, sf_dir):
    return iv.coalitions(corpus(spark, sf_dir), SEED).select("pos", "mask", "variant", "nq", "nc", "answer_index")


def _by_item(spark, sf_dir) -> DataFrame:
    return au.coalition_outcomes(au.presented(corpus(spark, sf_dir), SIMULATED, SEED))


_OUT = q.outcomes(SEED, iv.PREFIX, _SIM_SQL)


@query(_OUT + "SELECT pos, mask, variant, correct FROM o")
def sr1_outcomes(spark, sf_dir):
    return au.presented(corpus(spark, sf_dir), SIMULATED, SEED).select("pos", "mask", "variant", "correct")


@query(_OUT + "SELECT count(*) AS lookups, count(DISTINCT (nq, nc)) AS misses, count(*) - count(DISTINCT (nq, nc)) AS hits FROM o")
def ag21_cache_counters(spark, sf_dir):
    return scoring.cache_counters(au.presented(corpus(spark, sf_dir), SIMULATED, SEED))


@query(_OUT + "SELECT pos, mask, hits, variants, round(mean, 9) AS mean FROM b")
def ag15_variant_means(spark, sf_dir):
    return _by_item(spark, sf_dir).withColumn("mean", F.round("mean", 9))


@query(_OUT + "SELECT mask, accuracy FROM a")
def ag14_coalition_accuracy(spark, sf_dir):
    return au.coalition_accuracy(_by_item(spark, sf_dir))


@query(_OUT + "SELECT round(max(accuracy) FILTER (mask = 0) - max(accuracy) FILTER (mask = 7), 9) AS total_drop FROM a")
def ag17_total_drop(spark, sf_dir):
    return au.total_drop(au.coalition_accuracy(_by_item(spark, sf_dir)))


def _sql_shares() -> str:
    matrix = rs.shapley_weights(3)
    parts = [f"SELECT '{name}' AS player, round(sum({matrix[i].tolist()}[mask + 1] * accuracy), 9) AS share FROM a" for i, name in enumerate(iv.PLAYERS)]
    return " UNION ALL ".join(parts)


@query(_OUT + _sql_shares())
def sc29_shapley_shares(spark, sf_dir):
    return au.shapley_shares(au.coalition_accuracy(_by_item(spark, sf_dir)))


_WIDE = ", wd AS (SELECT pos, " + ", ".join(f"round(max(mean) FILTER (mask = {m}), 12) AS m{m}" for m in range(8)) + " FROM b GROUP BY pos)"


@query(_OUT + _WIDE + f"SELECT {', '.join(f'm{m}' for m in range(8))}, count(*) AS n FROM wd GROUP BY ALL")
def au1_outcome_patterns(spark, sf_dir):
    return au.outcome_patterns(_by_item(spark, sf_dir), 8)


@query(
    _OUT
    + _WIDE
    + " UNION ALL ".join(
        f"SELECT '{name}' AS player, bool_and({' AND '.join(f'm{m} = m{m | 1 << i}' for m in range(8) if not m >> i & 1)}) AS inert FROM wd" for i, name in enumerate(iv.PLAYERS)
    )
)
def au4_inert_players(spark, sf_dir):
    return au.inert_flags(au.outcome_patterns(_by_item(spark, sf_dir), 8))


_BLIND = (
    q.NORMAL
    + f""", r AS (SELECT pos, mask, -1 AS variant, answer_index AS a0, nq AS nq0, nc AS nc0, CASE WHEN mask = 0 THEN nq ELSE '' END AS nq, nc, answer_index FROM n CROSS JOIN (SELECT unnest([0, 1]) AS mask)),
      z AS (SELECT pos, mask, variant, answer_index, nq, nc, {q.winner(*_SIM_SQL)} AS winner FROM r),
      o AS (SELECT pos, mask, (first_value(winner) OVER (PARTITION BY nq, nc ORDER BY mask, pos, variant) = answer_index)::INT AS correct FROM z),
      w AS (SELECT pos, max(correct) FILTER (mask = 0) AS c, max(correct) FILTER (mask = 1) AS t FROM o GROUP BY pos)"""
)


@query(
    _BLIND
    + """SELECT count(*) AS n, count(*) FILTER (c = 1 AND t = 1) AS both, count(*) FILTER (c = 1 AND t = 0) AS control_only, count(*) FILTER (c = 0 AND t = 1) AS treatment_only,
         count(*) FILTER (c = 0 AND t = 0) AS neither, round((count(*) FILTER (c = 0 AND t = 1) - count(*) FILTER (c = 1 AND t = 0))::DOUBLE / count(*), 9) AS delta FROM w"""
)
def ag16_paired_cells(spark, sf_dir):
    return au.paired_cells(au.coalition_outcomes(au.blind_outcomes(corpus(spark, sf_dir), SIMULATED)))


@query(
    q.CORPUS
    + """, w AS (SELECT pos, answer_index, list_transform(choices, lambda x: length(x) % 3) AS s, choices, question FROM c),
      x AS (SELECT pos, answer_index, list_filter(list_transform(choices, lambda y, i: CASE WHEN s[i] = list_max(s) THEN {'k': sha256(question || chr(0) || y), 'i': i - 1} END), lambda e: e IS NOT NULL) AS e FROM w)
      SELECT pos, (list_sort(e)[1]).i AS predicted FROM x"""
)
def wn5_predicted_option(spark, sf_dir):
    """The tie rule on scores with many ties: the length of each option modulo three."""
    rows = corpus(spark, sf_dir).withColumn("scores", F.transform("choices", lambda c: (F.length(c) % 3).cast("double")))
    return rows.select("pos", scoring.predicted(F.col("scores"), F.col("question"), F.col("choices")).cast("long").alias("predicted"))


@query(f"SELECT pos, round(greatest(0.0, r - a), 9) AS assayed, CASE WHEN r > 0 THEN round(greatest(0.0, r - a) / r, 9) END AS purity FROM (SELECT pos, (pos % 11) / 10.0::DOUBLE AS r, (pos % 7) / 10.0::DOUBLE AS a FROM items)")
def sc31_purity(spark, sf_dir):
    rows = table(spark, sf_dir, "items").select("pos", (F.col("pos") % 11 / 10).alias("r"), (F.col("pos") % 7 / 10).alias("a"))
    assayed, purity = st.purity(F.col("r"), F.col("a"))
    return rows.select("pos", _r(assayed, "assayed"), _r(purity, "purity"))


# -- training data: rows that fail to parse --------------------------------------------------------


@query()
def p4_found(spark, sf_dir):
    """(row_id, reason): rows of hswag_lines that cannot be loaded."""
    return rejects.rejected(table(spark, sf_dir, "hswag_lines"))


@query()
def p4_items(spark, sf_dir):
    """(row_id, ind, activity_label, ctx, endings, label): rows of hswag_lines that load."""
    return rejects.loaded(table(spark, sf_dir, "hswag_lines"))


# -- composites: their resampled intervals have no SQL -----------------------------------------------


@query(
    "SELECT mask, i AS player, bit_count(mask)::INT AS players, round(CASE WHEN (mask >> i) & 1 = 0 THEN 1 ELSE -1 END / (4 * (CASE bit_count(mask) - ((mask >> i) & 1) WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 1 END))::DOUBLE, 9) AS weight"
    " FROM (SELECT unnest(range(16))::INT AS mask) CROSS JOIN (SELECT unnest(range(4))::INT AS i)"
)
def sc30_popcount(spark, sf_dir):
    """Coalition sizes and the Shapley weights that follow from them, for four players."""
    weights = rs.shapley_weights(4)
    rows = [(mask, i, float(weights[i, mask])) for mask in range(16) for i in range(4)]
    return spark.createDataFrame(rows, "mask int, player int, weight double").select("mask", "player", F.bit_count("mask").alias("players"), _r("weight", "weight"))


@query()
def dt6_findings(spark, sf_dir):
    """The judged rows of the corpus layer over all items."""
    return spark.createDataFrame(list(dt.run_detectors(corpus(spark, sf_dir), SEED, Rule()).rows), JUDGED)


@query()
def au6_components(spark, sf_dir):
    """All judged rows of the whole audit of a simulated model over all items: shares, blind score and corpus layer."""
    return au.run_audit(corpus(spark, sf_dir), "items", SIMULATED, SEED).table(spark)
