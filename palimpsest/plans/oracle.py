"""DuckDB SQL that says what the recognisers and validators do, put together from their tables of fixed values."""

from __future__ import annotations

from palimpsest.functions.text import LABELS
from palimpsest.functions.validators import HOLDERS, MULTIPLY, PERMUTE, STATES
from palimpsest.operators import recognise as R
from palimpsest.operators import vote


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_in(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def context(start: str, end: str, width: int, text: str = "body") -> str:
    return f"substr({text}, greatest({start} - {width}, 0) + 1, {end} + {width} - greatest({start} - {width}, 0))"


def bounded(around: str, value: str) -> str:
    return f"lower(coalesce(list_filter(string_split_regex({around}, '[\\n.]'), lambda p: contains(p, trim({value})))[1], {around}))"


def verhoeff(digits: str) -> str:
    """The residue of a string of digits."""
    d, p = ([x for row in t for x in row] for t in (MULTIPLY, PERMUTE))
    places = f"list_transform(range(0, length({digits})), lambda i: {p}[CAST((i % 8) * 10 + CAST(substr(reverse({digits}), CAST(i + 1 AS INT), 1) AS INT) + 1 AS INT)])"
    return f"list_reduce(list_prepend(0, {places}), lambda c, x: {d}[c * 10 + x + 1])"


def luhn(digits: str) -> str:
    """The sum of a card number's digits, every other one doubled."""
    n = f"CAST(substr(reverse({digits}), CAST(i + 1 AS INT), 1) AS INT)"
    doubled = f"(CASE WHEN i % 2 = 1 THEN (CASE WHEN {n} * 2 > 9 THEN {n} * 2 - 9 ELSE {n} * 2 END) ELSE {n} END)"
    return f"list_sum(list_transform(range(0, length({digits})), lambda i: {doubled}))"


def spans(src: str, rule: R.Rule) -> str:
    """Rows (doc_id, body, start, end, value) of all matches."""
    p = lit(rule.pattern)
    before = "CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT)"
    value = f"regexp_extract(m[i], {p}, {rule.group})"
    shift = f" + length(m[i]) - length({value})" if rule.group else ""
    return f"""SELECT doc_id, body, {before}{shift} AS start, {before} + length(m[i]) AS "end", {value} AS value
        FROM (SELECT doc_id, body, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text AS body, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM ({src})))"""


def score(kind: str, base: float) -> str:
    digits = "regexp_replace(regexp_replace(upper(regexp_replace(value, '[^0-9OoIiLl]', '', 'g')), 'O', '0', 'g'), '[IL]', '1', 'g')"
    if kind == "AADHAAR_NUMBER":
        return f"CASE WHEN length({digits}) <> 12 OR {digits}[1] = '0' OR len(list_distinct(string_split({digits}, ''))) <= 3 THEN 0.0 WHEN {verhoeff(digits)} = 0 THEN {base} WHEN regexp_matches(value, '[OoIiLl]') THEN {base} * 0.9 ELSE {base} * 0.72 END"
    if kind == "PAN_NUMBER":
        fixed = "translate(substr(upper(value), 1, 5), '01583', 'OISBB') || translate(substr(upper(value), 6, 4), 'OILSB', '01158') || translate(substr(upper(value), 10), '01583', 'OISBB')"
        return f"CASE WHEN NOT regexp_matches({fixed}, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') THEN 0.0 WHEN NOT list_contains({HOLDERS}, ({fixed})[4]) THEN {base} * 0.4 ELSE {base} END"
    if kind == "DRIVING_LICENCE":
        return f"CASE WHEN list_contains({STATES}, upper(value[1:2])) THEN {base} ELSE {base} * 0.3 END"
    if kind == "IP_ADDRESS":
        return f"CASE WHEN len(list_filter(string_split(value, '.'), lambda o: CAST(o AS INT) > 255)) > 0 THEN 0.0 WHEN regexp_matches(value, '^(127\\.|10\\.|192\\.168\\.)') THEN {base} * 0.5 ELSE {base} END"
    if kind == "CREDIT_CARD":
        return f"CASE WHEN {luhn('value')} % 10 = 0 THEN {base} ELSE 0.0 END"
    if kind == "PIN_CODE":
        return f"CASE WHEN CAST(value[1:2] AS INT) BETWEEN 11 AND 99 THEN {base} ELSE 0.0 END"
    return str(base)


def gate(rule: R.Rule) -> str:
    wide, near = f"lower({context('start', '\"end\"', 80)})", bounded(context("start", '"end"', 35), "value")
    plain = f"regexp_replace({near}, '[^a-z0-9]', '', 'g')"
    bare = "length(regexp_replace(value, '[^0-9]', '', 'g')) IN (10, 12) AND length(regexp_replace(value, '[^0-9]', '', 'g')) = length(trim(value))"
    words = {"PHONE_NUMBER": R.PHONE_WORDS, "AADHAAR_NUMBER": R.AADHAAR_WORDS}.get(rule.entity_type)
    if words:
        return f"(NOT ({bare}) OR {any_in(near, words)} OR {any_in(plain, words)})"
    if rule.entity_type == "BANK_ACCOUNT":
        return any_in(wide, R.BANK_WORDS)
    return any_in(wide, R.PIN_WORDS) if rule.id == "r16" else "true"


def candidates(src: str, rules: list[R.Rule]) -> str:
    """(doc_id, body, start, end, entity_type, text, score, ord) of the patterns, gated and validated."""
    parts = []
    for r in rules:
        inner = f"SELECT *, CAST({score(r.entity_type, r.score)} AS DOUBLE) AS score FROM ({spans(src, r)}) WHERE NOT list_contains({LABELS}, lower(trim(value))) AND {gate(r)}"
        parts.append(f'SELECT doc_id, body, start, "end", {lit(r.entity_type)} AS entity_type, value AS text, score, {R.RULES.index(r) + 1} AS ord FROM ({inner}) WHERE score > 0')
    return " UNION ALL ".join(parts)


def adjusted(src: str) -> str:
    """Candidates with scores after the words near them."""
    near = bounded(context("start", '"end"', 60), "text")
    expr = "score"
    for t, words, change in vote.BOOSTS:
        expr = f"(CASE WHEN entity_type = {lit(t)} AND {any_in('near', words)} THEN least(1.0, {expr} + {change}) ELSE {expr} END)" if t in src else expr
    for t, words, change in vote.PENALTIES:
        expr = f"(CASE WHEN entity_type = {lit(t)} AND {any_in('near', words)} THEN greatest(0.0, {expr} - {change}) ELSE {expr} END)" if t in src else expr
    return f'SELECT doc_id, start, "end", entity_type, text, {expr} AS score, score >= 0.8 AS type_locked, ord FROM (SELECT *, {near} AS near FROM ({src}))'


def grouped(src: str) -> str:
    order = 'PARTITION BY doc_id ORDER BY start, score DESC, ord, "end", entity_type'
    return f"""SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM (
        SELECT *, row_number() OVER ({order}) AS pos, CASE WHEN start >= max("end") OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER ({order}) = 1 THEN 1 ELSE 0 END AS new FROM ({src}))"""


def elected(src: str, threshold: float = 0.5) -> str:
    """Entities of pattern candidates alone: all structured, of one source."""
    return f"""
        WITH g AS ({grouped(src)}),
        t AS (
            SELECT doc_id, grp, entity_type, round(sum(score * 1.4), 9) AS votes, min(pos) AS first, max(score) AS top,
                max(CASE WHEN type_locked THEN score END) AS lock, arg_max({{'start': start, 'end': "end", 'text': text}}, {{'s': score, 'p': -pos}}) AS best,
                min(CASE WHEN type_locked THEN pos END) AS first_locked
            FROM g GROUP BY ALL
        ), l AS (
            SELECT g.doc_id, g.grp, g.entity_type, row_number() OVER (PARTITION BY g.doc_id, g.grp ORDER BY g.score DESC, g.pos) AS r FROM g WHERE type_locked
        ), v AS (
            SELECT doc_id, grp, entity_type, row_number() OVER (PARTITION BY doc_id, grp ORDER BY votes DESC, first) AS r FROM t
        ), e AS (
            SELECT v.doc_id, v.grp, coalesce(l.entity_type, v.entity_type) AS entity_type FROM v LEFT JOIN l ON v.doc_id = l.doc_id AND v.grp = l.grp AND l.r = 1 WHERE v.r = 1
        ), s AS (SELECT doc_id, grp, max(score) AS score FROM g GROUP BY ALL)
        SELECT e.doc_id, t.best.start AS start, t.best."end" AS "end", e.entity_type, t.best.text AS text, least(s.score, 1.0) AS score
        FROM e JOIN t USING (doc_id, grp, entity_type) JOIN s USING (doc_id, grp) WHERE s.score >= {threshold}"""


def looks(text: str, score: str) -> str:
    from palimpsest.operators.policy import BENIGN, UNITS, UNTITLED

    t = f"trim({text})"
    digits = f"(length(regexp_replace({t}, '[^0-9]', '', 'g')) / greatest(length({t}), 1))"
    return f"(CASE WHEN list_contains({BENIGN + UNITS}, lower({t})) THEN 0.05 WHEN length({t}) <= 1 THEN 0.02 WHEN {digits} > 0.7 AND length({t}) >= 10 THEN 0.95 WHEN regexp_matches({t}, '\\p{{L}}') AND NOT regexp_matches({t}, '{UNTITLED}') AND length({t}) > 3 THEN least(0.95, {score} + 0.05) ELSE least(greatest({score}, 0.0), 1.0) END)"


def decided(src: str, auto: float = 0.85, review: float = 0.5, least: float = 0.4) -> str:
    """Statuses under a policy."""
    own = "entity_type IN ('AADHAAR_NUMBER', 'PAN_NUMBER')"
    inner = f"SELECT *, {looks('text', 'score')} AS looks FROM ({src})"
    inner = f"SELECT * REPLACE (CASE WHEN {own} OR looks < {least} THEN score ELSE greatest(score, looks) END AS score) FROM ({inner})"
    return f"""SELECT * EXCLUDE (looks), CASE WHEN looks < {least} THEN 'rejected' WHEN {own} AND score < 0.9 THEN (CASE WHEN score >= {review} THEN 'pending' ELSE 'rejected' END)
        WHEN score >= {auto} THEN 'accepted' WHEN score >= {review} THEN 'pending' ELSE 'rejected' END AS status FROM ({inner})"""


def spliced(docs: str, entities: str, shown: str) -> str:
    """Texts with entities, which do not overlap, replaced by an expression over them."""
    return f"""
        WITH d AS ({docs}), e AS ({entities}),
        p AS (SELECT e.*, d.text AS body, lag(e."end", 1, 0) OVER (PARTITION BY e.doc_id ORDER BY e.start) AS before FROM e JOIN d USING (doc_id)),
        s AS (SELECT doc_id, string_agg(substr(body, before + 1, start - before) || {shown}, '' ORDER BY start) || substr(any_value(body), CAST(max("end") + 1 AS INT)) AS shown, count(*) AS n FROM p GROUP BY doc_id)
        SELECT d.doc_id, coalesce(s.shown, d.text) AS redacted_text, coalesce(s.n, 0) AS entity_count FROM d LEFT JOIN s USING (doc_id)"""
