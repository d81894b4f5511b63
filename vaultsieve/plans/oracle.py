"""Pieces of the SQL twins: written for another engine, with none of the code that the queries use."""

from __future__ import annotations

from vaultsieve.functions import constants as C
from vaultsieve.plans.corpus import SQL


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def entropy(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + list_sum([-(c / length({x})::DOUBLE) * log2(c / length({x})::DOUBLE) for c in map_values(list_histogram(string_split({x}, '')))]) END)"


def confidence(x: str) -> str:
    return f"(CASE WHEN {x} >= 5.5 THEN 0.8::DOUBLE WHEN {x} >= 4.0 THEN 0.6::DOUBLE + ({x} - 4.0) * (0.2::DOUBLE / 1.5::DOUBLE) ELSE 0.6::DOUBLE END)"


def any_match(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {text(p)})" for p in patterns) + ")"


def any_part(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(p)})" for p in parts) + ")"


def any_start(x: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {text(p)})" for p in parts) + ")"


#: Without look-behind: the character before the name is consumed.
ASSIGNMENT = C.ASSIGNMENT.replace("(?<![a-zA-Z])", "(?:^|[^a-zA-Z])")

_SIGNATURES = " UNION ALL ".join(
    f"SELECT file, line_no, line, stripped, {1000 * i} + unnest(range(len(m))) AS seq, '{n}' AS type, 'regex' AS evidence, '{tier}' AS severity, {C.CONFIDENCE[tier]}::DOUBLE AS confidence, unnest(m) AS token FROM (SELECT *, regexp_extract_all(stripped, {text(p)}) AS m FROM l)"
    for i, (tier, n, p) in enumerate([*(("critical", n, p) for n, p in C.CRITICAL.items()), *(("high", n, p) for n, p in C.HIGH.items())])
)

LINES = f"""
corpus AS ({SQL}),
l AS (SELECT file, line_no, line, stripped FROM (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS stripped FROM corpus)
      WHERE stripped <> '' AND NOT starts_with(stripped, '#') AND NOT starts_with(stripped, '/*#'))
"""
SECRET = f"""length(t) >= 20 AND len(list_distinct(string_split(t, ''))) > 3
  AND regexp_matches(t, '[a-z]')::INT + regexp_matches(t, '[A-Z]')::INT + regexp_matches(t, '[0-9]')::INT + regexp_matches(t, '[^a-zA-Z0-9]')::INT >= 2
  AND regexp_matches(t, '[^a-zA-Z]') AND NOT (regexp_matches(t, '[a-z]') AND NOT regexp_matches(t, '[A-Z0-9]')) AND {entropy("t")} >= 4.0"""
FINDINGS = f"""{LINES},
hits AS ({_SIGNATURES}),
free AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.file = l.file AND h.line_no = l.line_no) AND NOT regexp_matches(stripped, {text(C.ARMOUR_BODY)})),
tokens AS (SELECT file, line_no, line, stripped, unnest(regexp_extract_all(regexp_replace(stripped, {text(C.URL)}, ' ', 'g'), {text(C.TOKEN)})) AS t FROM free),
ent AS (SELECT *, {entropy("t")} AS e FROM tokens WHERE {SECRET}),
vals AS (SELECT file, line_no, line, stripped, unnest(regexp_extract_all(stripped, {text(ASSIGNMENT)}, 1)) AS t FROM free),
asg AS (SELECT *, {entropy("t")} AS e FROM vals WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.file = vals.file AND ent.line_no = vals.line_no AND ent.t = vals.t)),
findings AS (
  SELECT file, line_no, line, stripped, type, evidence, severity, confidence, {entropy("token")} AS entropy, token FROM hits
  UNION ALL SELECT file, line_no, line, stripped, 'ENTROPY_CANDIDATE', 'entropy', 'info', {confidence("e")}, e, t FROM ent
  UNION ALL SELECT file, line_no, line, stripped, 'ML_CANDIDATE', 'ml', 'critical', {confidence("e")}, e, t FROM asg)
"""
