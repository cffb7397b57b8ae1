"""SQL twins of the text and random-number functions, for DuckDB."""

from __future__ import annotations

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def norm(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({x}), '{SPACES}', ' ', 'g'))"


def norm_list(x: str) -> str:
    return f"list_transform({x}, lambda _c: {norm('_c')})"


def uniform(seed: int, name: str, key: str, slot: int | str) -> str:
    return f"(('0x' || substr(sha256('{seed}|{name}|' || {key} || '|' || {slot}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:[-''][a-z0-9]+)*')"


# valid items, the first of each id; the corpus of all core queries
CORPUS = """
WITH v AS (
  SELECT pos, id AS item_id, coalesce(question, '') AS question, choices, answer_index, coalesce(subject, '') AS subject FROM items
  WHERE coalesce(id, '') <> '' AND len(choices) >= 2 AND len(list_filter(choices, lambda x: x IS NULL)) = 0
    AND answer_index >= 0 AND answer_index < len(choices)
), c AS (SELECT * FROM v QUALIFY pos = min(pos) OVER (PARTITION BY item_id))
"""

NORMAL = CORPUS + f", n AS (SELECT *, {norm('question')} AS nq, {norm_list('choices')} AS nc FROM c)"

SHINGLES = (
    CORPUS
    + f""", w AS (
  SELECT pos, list_concat({tokens('question')}, flatten(list_transform(choices, lambda x: {tokens('x')}))) AS t FROM c
), s AS (
  SELECT pos, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' '))) ELSE [array_to_string(t, ' ')] END AS shingles
  FROM w WHERE len(t) > 0
), p AS (SELECT pos, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
d AS (SELECT shingle, count(*) AS df FROM p GROUP BY shingle)"""
)


def draws(seed: int, name: str = "stronger_distractor") -> str:
    """CTEs up to ``k``: the corpus in normal form with its swapped options. Each item meets every answer of its subject."""
    return (
        NORMAL
        + f""", pool AS (
  SELECT subject, nc[answer_index + 1] AS nanswer, min(choices[answer_index + 1]) AS answer, count(*) AS times FROM n GROUP BY ALL
), usable AS (
  SELECT n.pos, answer, nanswer, times, sum(times) OVER (PARTITION BY n.pos ORDER BY md5(nanswer)) AS upto, sum(times) OVER (PARTITION BY n.pos) AS size
  FROM n JOIN pool USING (subject) WHERE NOT list_contains(n.nc, nanswer)
), drawn AS (
  SELECT pos, answer AS distractor, nanswer AS ndistractor FROM usable
  WHERE floor({uniform(seed, name, 'pos', 0)} * size) >= upto - times AND floor({uniform(seed, name, 'pos', 0)} * size) < upto
),
x AS (
  SELECT n.*, distractor, ndistractor, floor({uniform(seed, name, 'n.pos', 99)} * (len(choices) - 1))::INT AS wrong FROM n LEFT JOIN drawn ON n.pos = drawn.pos
), k AS (
  SELECT * EXCLUDE (distractor, ndistractor, wrong),
    CASE WHEN distractor IS NULL THEN choices ELSE list_transform(choices, lambda c, i: CASE WHEN i - 1 = wrong + (wrong >= answer_index)::INT THEN distractor ELSE c END) END AS distracted,
    CASE WHEN distractor IS NULL THEN nc ELSE list_transform(nc, lambda c, i: CASE WHEN i - 1 = wrong + (wrong >= answer_index)::INT THEN ndistractor ELSE c END) END AS ndistracted
  FROM x
)"""
    )


def reframed(q: str, prefix: str) -> str:
    return f"""CASE WHEN trim({q}) = '' THEN {q} ELSE '{prefix}' || translate({q}, '"''', '”’') END"""


def rotated(c: str, answer: str, at: str) -> str:
    return f"list_transform(range(len({c})), lambda j: {c}[((j + {answer} - {at} + len({c})) % len({c}) + 1)::INT])"


def variants(seed: int, prefix: str) -> str:
    """CTEs up to ``r``: every variant of every coalition in normal form."""
    return (
        draws(seed)
        + f""", m AS (
  SELECT pos, answer_index AS a0, nq AS nq0, nc AS nc0, mask, CASE WHEN mask & 2 <> 0 THEN {reframed('nq', prefix)} ELSE nq END AS nq,
    CASE WHEN mask & 1 <> 0 THEN ndistracted ELSE nc END AS ncm
  FROM k CROSS JOIN (SELECT unnest(range(8))::INT AS mask)
), r AS (
  SELECT pos, mask, variant, a0, nq0, nc0, nq, CASE WHEN variant < 0 THEN ncm ELSE {rotated('ncm', 'a0', 'variant')} END AS nc, CASE WHEN variant < 0 THEN a0 ELSE variant END AS answer_index
  FROM (SELECT *, unnest(CASE WHEN mask & 4 <> 0 THEN range(len(ncm))::INT[] ELSE [-1]::INT[] END) AS variant FROM m)
)"""
    )


def winner(seed: int, skill: float, memorisation: float, distractor: float, position: float, favoured: int, choices_only: float) -> str:
    """The simulated scorer's choice for a row of ``r``."""
    u = lambda slot: uniform(seed, "simulated", "pos", slot)
    answer = "nc0[a0 + 1]"
    wrong = lambda c: f"list_sort(list_distinct(list_filter({c}, lambda y: y <> {answer})))"
    guess = f"floor({u(5)} * len(nc))::INT"
    knows = f"(nq <> '' AND {u(0)} < {skill}) OR (nq = nq0 AND {u(1)} < {memorisation}) OR ({wrong('nc')} = {wrong('nc0')} AND {u(2)} < {distractor}) OR {u(3)} < {choices_only}"
    at = f"(coalesce(list_position(nc, {answer}), 0) - 1)"
    return f"CASE WHEN {at} < 0 THEN {guess} WHEN {knows} THEN {at} WHEN {u(4)} < {position} THEN least({favoured}, len(nc) - 1) ELSE {guess} END"


def outcomes(seed: int, prefix: str, simulation: tuple) -> str:
    """CTEs up to ``o`` (pos, mask, variant, correct) and ``b`` (pos, mask, hits, variants, mean)."""
    return (
        variants(seed, prefix)
        + f""", z AS (SELECT pos, mask, variant, answer_index, nq, nc, {winner(*simulation)} AS winner FROM r),
o AS (
  SELECT pos, mask, variant, nq, nc, (first_value(winner) OVER (PARTITION BY nq, nc ORDER BY mask, pos, variant) = answer_index)::INT AS correct FROM z
), b AS (SELECT pos, mask, sum(correct)::BIGINT AS hits, count(*) AS variants, sum(correct)::DOUBLE / count(*) AS mean FROM o GROUP BY pos, mask),
a AS (SELECT mask, round(avg(mean), 9) AS accuracy FROM b GROUP BY mask)"""
    )
