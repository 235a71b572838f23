"""All queries of the engine by operator, with the DuckDB SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import validators as V
from palimpsest.functions.scratch import cut
from palimpsest.functions.spans import dealt, stage
from palimpsest.operators import analytics, boxes, corpus, evaluate, policy, recognise, tables, verify, vote
from palimpsest.plans import carriers as C
from palimpsest.plans import oracle as O
from palimpsest.sources import files
from palimpsest.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
#: Patterns whose spans are the same in all dialects on the carriers.
MAIN = [r for r in recognise.RULES if r.id in ("r01", "r02", "r04", "r08", "r09", "r13", "r16")]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


# Patterns.


def _rule(rule: recognise.Rule, source: str) -> None:
    src = {"documents": "SELECT doc_id, text FROM documents", "carriers": C.CARRIER_SQL, "more": C.MORE_SQL}[source]
    sql = f'SELECT doc_id, start, "end", entity_type, text, round(score, 4) AS score FROM ({O.candidates(src, [rule])})'

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = {"documents": lambda *_: documents(spark, sf_dir), "carriers": C.carriers, "more": C.more}[source](spark, sf_dir)
        return recognise.scan_patterns(docs, [rule]).select("doc_id", "start", "end", "entity_type", "text", F.round("score", 4).alias("score"))

    query(f"{rule.id}_{rule.entity_type.lower()}", sql)(run)


for _r in recognise.RULES:
    _rule(_r, "documents" if _r.id == "r15" else "more" if _r.id in ("r03", "r05", "r06", "r07", "r10", "r11", "r12", "r14", "r17") else "carriers")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.carriers(spark, sf_dir)
    ords = {r.id: recognise.RULES.index(r) + 1 for r in MAIN}
    found = recognise.scan_patterns(docs, MAIN)
    real = F.element_at(F.array(*(F.lit(ords[r.id]) for r in MAIN)), F.col("ord"))
    return vote.score_context(found.withColumn("ord", real), docs)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.elect(candidates(spark, sf_dir))


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities for queries that read them more than once: written and read again, or each use would detect them anew.

    No such query reads the sources, and without their sets the election aggregates in order, with one sort.
    """
    return cut(entities(spark, sf_dir).drop("source", "merged_from"), "entities")


_CANDIDATES = O.adjusted(O.candidates(C.CARRIER_SQL, MAIN))
_ENTITIES = O.elected(_CANDIDATES)
_DECIDED = O.decided(_ENTITIES)


@query("c01_c02_context_scores", f'SELECT doc_id, start, "end", entity_type, round(score, 4) AS score FROM ({_CANDIDATES})')
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("doc_id", "start", "end", "entity_type", F.round("score", 4).alias("score"))


@query("c04_interval_grouping", f'SELECT doc_id, start, "end", entity_type, CAST(grp AS BIGINT) AS grp FROM ({O.grouped(_CANDIDATES)})')
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.group_spans(candidates(spark, sf_dir)).select("doc_id", "start", "end", "entity_type", "grp")


@query("c05_c10_elected_entities", f'SELECT doc_id, start, "end", entity_type, text, round(score, 4) AS score FROM ({_ENTITIES})')
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("doc_id", "start", "end", "entity_type", "text", F.round("score", 4).alias("score"))


@query("c14_type_filter", f"SELECT doc_id, start, text FROM ({_ENTITIES}) WHERE entity_type IN ('PAN_NUMBER', 'EMAIL_ADDRESS')")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).filter(F.col("entity_type").isin("PAN_NUMBER", "EMAIL_ADDRESS")).select("doc_id", "start", "text")


@query("r18_upi", f"SELECT doc_id, start, \"end\", value AS text, CAST(0.88 AS DOUBLE) AS score FROM ({O.spans(C.MORE_SQL, recognise.Rule('r18', 'UPI_ID', '[a-zA-Z0-9._-]{2,64}@[a-zA-Z]{2,20}', .88))})")
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise.scan_upi(C.more(spark, sf_dir)).select("doc_id", "start", "end", "text", "score")


@query("r19_dates", """SELECT o_orderkey AS doc_id, s AS start, s + 10 AS "end", CASE s WHEN 5 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE '2001-02-03' END AS text, CAST(CASE s WHEN 5 THEN 0.96 ELSE 0.9 END AS DOUBLE) AS score, true AS type_locked
    FROM orders, (VALUES (5), (21)) v(s)""")
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("DOB: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" sent 2001-02-03")).alias("text"))
    return recognise.scan_dates(orders).select("doc_id", "start", "end", "text", "score", "type_locked")


@query("r21_fragments")
def r21(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.regexp_replace("text", r"(?<=[A-Z0-9])(?=[A-Z0-9]{1,9}\b)", " ")
    return recognise.scan_fragments(C.carriers(spark, sf_dir).withColumn("text", spread)).select("doc_id", "start", "end", "entity_type", "text", "score")


@query("h_hindi_patterns")
def hindi(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("आवेदक का नाम: राहुल शर्मा\nआधार संख्या: "), F.lpad((F.col("c_custkey") + 234567890123).cast("string"), 12, "0"), F.lit("\nमोबाइल: 98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    docs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    scored = vote.score_context(recognise.scan_hindi(docs), docs, 80, hindi=True)
    locked = (F.col("source") == "hindi_regex") & (F.col("score") >= 0.8)
    return vote.elect(scored, 0.48, locked=locked).select("doc_id", "start", "end", "entity_type", "text", F.round("score", 4).alias("score"))


#: A line for each Hindi pattern: its label, what stands around the value, and the value, from k.
_DEVA_LINES = [
    ("AADHAAR_NUMBER", "आधार संख्या: ", "'2' || lpad({k}, 3, '0') || ' 4532 0151'", ""), ("PAN_NUMBER", "पैन कार्ड: ", "'ABCPE' || lpad({k}, 4, '0') || 'F'", ""), ("DATE_OF_BIRTH", "जन्मतिथि: ", "'12/03/19' || lpad({k2}, 2, '0')", ""),
    ("PHONE_NUMBER", "दूरभाष: ", "'9' || lpad({k}, 9, '0')", ""), ("PIN_CODE", "पिन कोड: ", "'4' || lpad({k}, 5, '0')", ""), ("GST_NUMBER", "जीएसटी: ", "'27ABCPE' || lpad({k}, 4, '0') || 'F1Z5'", ""),
    ("VOTER_ID", "मतदाता पहचान: ", "'ABC' || lpad({k}, 7, '0')", ""), ("IFSC_CODE", "आईएफएससी: ", "'SBIN0' || lpad({k}, 6, '0')", ""), ("BANK_ACCOUNT", "बैंक खाता: ", "'12' || lpad({k}, 9, '0')", ""),
    ("UPI_ID", "यूपीआई: ", "'user' || {k} || '@okaxis'", ""), ("PERSON", "Ravi Rao (", "'रवि किशन'", ")"), ("PERSON", "नाम: ", "'अनिल विनोद'", ""), ("PERSON", "x ", "'श्रीमती सुमन लता'", " y"), ("PERSON", "z ", "'महेश शर्मा'", " w"),
]


def _deva(cast: str) -> list[str]:
    k, k2 = f"cast(k as {cast})", f"cast(k % 100 as {cast})"
    return [value.format(k=k, k2=k2) for _, _, value, _ in _DEVA_LINES]


def _deva_text(cast: str) -> str:
    return " || chr(10) || ".join(f"'{before}' || {value} || '{after}'" for (_, before, _, after), value in zip(_DEVA_LINES, _deva(cast), strict=True))


_DEVA_SQL = " UNION ALL ".join(
    f"SELECT k AS doc_id, CAST(instr(text, '{before}' || {value}) - 1 + {len(before)} AS INT) AS start, CAST(instr(text, '{before}' || {value}) - 1 + {len(before)} + length({value}) AS INT) AS \"end\", '{kind}' AS entity_type, {value} AS text, CAST({rule.score} AS DOUBLE) AS score FROM c"
    for (kind, before, _, _), value, rule in zip(_DEVA_LINES, _deva("varchar"), recognise.HINDI_RULES, strict=True)
)


@query("h_hindi_spans", f"WITH c AS (SELECT c_custkey AS k, {_deva_text('varchar')} AS text FROM (SELECT c_custkey, c_custkey AS k FROM customer)) {_DEVA_SQL}")
def hindi_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the 14 Hindi patterns finds in a text with a line for each."""
    docs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("k")).select("doc_id", F.expr(_deva_text("string")).alias("text"))
    return recognise.scan_hindi(docs).select("doc_id", "start", "end", "entity_type", "text", "score")


@query("c12_union_languages")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled(spark, sf_dir)
    other = found.withColumn("score", F.col("score") - 0.1).withColumn("start", F.greatest(F.col("start") - 2, F.lit(0)))
    return vote.union_languages(found, other)


@query("x09_custom_rules", f"SELECT doc_id, start, \"end\", value AS text FROM ({O.spans(C.CARRIER_SQL, recognise.Rule('x', 'X', 'Customer [0-9]+', .85))})")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise.scan_custom(C.carriers(spark, sf_dir), {"customer": "Customer [0-9]+"}).select("doc_id", "start", "end", "text")


# Text and validators.

_ALPHA = "length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))"
_LETTERS = "greatest(length(text) - length(regexp_replace(text, '\\p{L}', '', 'g')), 1)"


@query("n07_script", f"SELECT doc_id, CASE WHEN ({_ALPHA}) / {_LETTERS} > 0.1 THEN 'english' ELSE 'unknown' END AS script FROM documents")
def n07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.script(F.col("text")).alias("script"))


@query("n02_latin_digits", "SELECT c_custkey AS doc_id, CAST(c_custkey AS VARCHAR) AS digits FROM customer")
def n02(spark: SparkSession, sf_dir: str) -> DataFrame:
    deva = F.translate(F.col("c_custkey").cast("string"), T.DIGITS, T.DEVANAGARI_DIGITS)
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), T.latin_digits(deva).alias("digits"))


@query("n12_scrub", f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'),
    '\\b[0-9]{{13,19}}\\b', '[CARD]', 'g'), '\\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\\b', '[PAN]', 'g'), '\\b[0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}\\b', '[AADHAAR]', 'g'), '\\b[6-9][0-9]{{9}}\\b', '[PHONE]', 'g') AS text FROM ({C.CARRIER_SQL})""")
def n12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.carriers(spark, sf_dir).select("doc_id", T.scrub(F.col("text")).alias("text"))


@query("n13_match_key", f"SELECT doc_id, upper(regexp_replace(text, '[\\s\\-_/\\\\.:,]', '', 'g')) AS key FROM ({C.CARRIER_SQL})")
def n13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.carriers(spark, sf_dir).select("doc_id", T.match_key(F.col("text")).alias("key"))


#: Labels with wide gaps, line ends of three kinds, and letters that stand for digits.
_NOISE = "replace(replace(text, ': ', ':' || chr(9) || '  '), 'Mail', chr(13) || chr(10) || chr(10) || chr(10) || 'Mail') || ' 0A B0 l5 7l `x`  ' || chr(13) || ' end ' || chr(10) || ' '"
_CLEANED = "text"
for _pattern, _to in [(r"\b0([A-Z])", r"O\1"), (r"([A-Z])0\b", r"\1O"), (r"\bl([0-9])", r"1\1"), (r"([0-9])l\b", r"\g1"), ("`", "chr(39)"), (r"\r\n|\r", "chr(10)"), (r"[ \t]{2,}", "' '")]:
    _with = _to if _pattern in ("`", r"\r\n|\r", r"[ \t]{2,}") else "'" + _to.replace(r"\g1", r"\11") + "'"
    _CLEANED = f"regexp_replace({_CLEANED}, '{_pattern}', {_with}, 'g')"


@query(
    "n01_n03_n11_texts",
    rf"""SELECT doc_id, regexp_replace({_CLEANED}, '^\s+|\s+$', '', 'g') AS cleaned, replace(regexp_replace(regexp_replace(trim(text), '\s*\n\s*|\s{{4,}}', chr(1), 'g'), '\s+', '', 'g'), chr(1), ' ') AS dense,
        trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS normalised
    FROM (SELECT doc_id, {_NOISE} AS text FROM ({C.CARRIER_SQL}))""",
)
def n01b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts that the three normalisers make of noisy ones."""
    noisy = C.carriers(spark, sf_dir).select("doc_id", F.expr(_NOISE).alias("text"))
    return noisy.select("doc_id", T.clean_ocr(F.col("text")).alias("cleaned"), T.dense(F.col("text")).alias("dense"), T.normalise_ocr(F.col("text")).alias("normalised"))


@query("n01_n11_cleaned_and_dense")
def n01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.length(T.clean_ocr(F.col("text"))).alias("cleaned"), F.length(T.dense(F.col("text"))).alias("dense"), F.length(T.normalise_ocr(F.col("text"))).alias("normalised"))


@query("v00_verhoeff", f"SELECT c_custkey AS id, CAST({O.verhoeff('d')} AS INT) AS residue FROM (SELECT c_custkey, CAST(100000000000 + c_custkey * 7919 AS VARCHAR) AS d FROM customer)")
def v00(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("c_custkey") * 7919 + 100000000000).cast("string")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.verhoeff_residue(d).alias("residue"))


@query("v05_luhn", f"SELECT o_orderkey AS id, {O.luhn('d')} % 10 = 0 AS valid FROM (SELECT o_orderkey, CAST(4000000000000000 + o_orderkey * 7919 AS VARCHAR) AS d FROM orders)")
def v05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), V.card_valid((F.col("o_orderkey") * 7919 + 4000000000000000).cast("string")).alias("valid"))


_KEYS, _DIGITS = V.AS_DIGIT[0] + "".join(V.OTHER_DIGIT), V.AS_DIGIT[1] + "".join(V.OTHER_DIGIT.values())
_ONLY_DIGITS = lambda d: f"CASE WHEN regexp_matches({d}, '^[0-9]+$') THEN {d} ELSE '' END"
_RIGHT = lambda d: f"(length({_ONLY_DIGITS(d)}) = 12 AND coalesce({O.verhoeff(_ONLY_DIGITS(d))} = 0, false))"
_RIGHT_PAN = lambda p: f"(regexp_matches({p}, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') AND list_contains({[h for h in V.HOLDERS if h not in 'KE']}, ({p})[4]))"
_AS_DIGITS, _AS_LETTERS = (lambda x, t=t: f"translate({x}, '{t[0]}', '{t[1]}')" for t in (V.AS_DIGIT, V.AS_LETTER))


@query(
    "v07_v08_fuzzy",
    f"""SELECT id, CAST(CASE WHEN {_RIGHT('v')} THEN 1.0 WHEN {_RIGHT('t')} THEN 0.95 WHEN len(list_filter(changed, lambda w: {_RIGHT('w')})) = 1 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS aadhaar,
        CAST(CASE WHEN {_RIGHT_PAN('p')} THEN 1.0 WHEN {_RIGHT_PAN('f')} THEN 0.92 ELSE 0.0 END AS DOUBLE) AS pan
    FROM (SELECT *, {_AS_DIGITS('v')} AS t, {_AS_LETTERS('p[1:5]')} || {_AS_DIGITS('p[6:9]')} || {_AS_LETTERS('p[10]')} AS f,
            list_filter(list_transform(range(1, 13), lambda j: v[1:j - 1] || translate(v[j], '{_KEYS}', '{_DIGITS}') || v[j + 1:]), lambda w: w <> v) AS changed
        FROM (SELECT c_custkey AS id, translate(CAST(c_custkey * 7919 + 200000000000 AS VARCHAR), '0', 'O') AS v, 'ABC' || substr('PQAK5', CAST(c_custkey % 5 + 1 AS INT), 1) || 'E12' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, 'O') || 'F' AS p FROM customer))""",
)
def v07(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("c_custkey") * 7919 + 200000000000).cast("string")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.fuzzy_aadhaar(F.translate(d, "0", "O")).alias("aadhaar"), V.fuzzy_pan(F.concat(F.lit("ABC"), F.substring(F.lit("PQAK5"), (F.col("c_custkey") % 5 + 1).cast("int"), F.lit(1)), F.lit("E12"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "O"), F.lit("F"))).alias("pan"))


@query("v12_char_shape", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\p{L}', chr(1), 'g'), '\\p{Nd}', chr(2), 'g'), '[^\\x01\\x02]', '?', 'g').replace(chr(1), 'L').replace(chr(2), 'D') AS shape FROM documents")
def v12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", V.char_shape(F.col("text")).alias("shape"))


@query("v12_char_shape_whole")
def v12_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, held against brute force."""
    return v12(spark, sf_dir)


@query("n08_stages", f"""SELECT doc_id, CASE WHEN ({_ALPHA}) / {_LETTERS} > 0.1 THEN 'ENGLISH' ELSE 'UNKNOWN' END AS label, 'regex,presidio,spacy' AS stages FROM documents
    UNION ALL SELECT -1 - c_custkey, ['HINDI', 'HINDI + ENGLISH'][c_custkey % 2 + 1], CASE WHEN c_custkey % 2 = 1 THEN 'regex,presidio,spacy,' ELSE '' END || 'hindi_regex,hindi_presidio,spacy_hi' FROM customer""")
def n08(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("doc_id"), F.when(F.col("c_custkey") % 2 == 1, "नाम राहुल name Rahul").otherwise("नाम राहुल १२").alias("text"))
    mode = T.script(F.col("text"))
    return documents(spark, sf_dir).union(made).select("doc_id", T.script_label(mode).alias("label"), F.array_join(T.stages(mode), ",").alias("stages"))


_HINDI_SQL = "SELECT c_custkey AS doc_id, 'Name of applicant: राहुल शर्मा, id ' || CAST(c_custkey AS VARCHAR) || ' - पता दिल्ली। अ x ' AS text FROM customer"


@query("n10_segments", f"SELECT doc_id, start, \"end\", value AS text FROM ({O.spans(_HINDI_SQL, recognise.Rule('n10', 'S', '[ऀ-ॿ][ऀ-ॿ\\s।॥०-९,.\\-:]*[ऀ-ॿ]', 1.0))}) WHERE length(trim(value)) >= 3")
def n10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Name of applicant: राहुल शर्मा, id "), F.col("c_custkey").cast("string"), F.lit(" - पता दिल्ली। अ x "))
    return recognise.devanagari_segments(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


_SHAPES = " UNION ALL ".join(f"SELECT doc_id, start, \"end\", {O.lit(r.entity_type)} AS entity_type, value AS text, CAST({r.score} AS DOUBLE) AS score FROM ({O.spans(C.CARRIER_SQL, r)}) WHERE NOT contains(value, chr(10))" for r in recognise.HINDI_SHAPES)


@query("m03_hindi_shapes", _SHAPES)
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise.scan_hindi_shapes(C.carriers(spark, sf_dir)).select("doc_id", "start", "end", "entity_type", "text", "score")


@query("v02b_repaired_pan", """SELECT c_custkey AS id, translate(substr(v, 1, 5), '01583', 'OISBB') || translate(substr(v, 6, 4), 'OILSB', '01158') || translate(substr(v, 10), '01583', 'OISBB') AS pan
    FROM (SELECT c_custkey, 'A8C' || CASE WHEN c_custkey % 2 = 0 THEN 'P5' ELSE 'KX' END || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, 'O') || 'F' AS v FROM customer)""")
def v02b(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("A8C"), F.when(F.col("c_custkey") % 2 == 0, "P5").otherwise("KX"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "O"), F.lit("F"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.repaired_pan(made).alias("pan"))


@query("v11_in_compound", "SELECT c_custkey AS id, regexp_matches(b, '[A-Za-z0-9]-*$') OR regexp_matches(a, '^-*[A-Za-z0-9]') AS inside FROM (SELECT c_custkey, ['SKU-', ': ', 'x--', ''][CAST(c_custkey % 4 + 1 AS INT)] AS b, [' end', '-9', '.'][CAST(c_custkey % 3 + 1 AS INT)] AS a FROM customer)")
def v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("c_custkey") % len(words) + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.in_compound(turn(["SKU-", ": ", "x--", ""]), turn([" end", "-9", "."])).alias("inside"))


@query("v15_ocr_distance", """SELECT id, CASE WHEN length(a) = length(b) THEN hamming(translate(a, '01528', 'OISZB'), translate(b, '01528', 'OISZB')) ELSE levenshtein(a, b) END AS d
    FROM (SELECT c_custkey AS id, upper(c_name) AS a, upper('customer#O' || CAST(c_custkey * 7 AS VARCHAR) || substr('00000000', 1 + CAST(c_custkey % 7 AS INT))) AS b FROM customer)""")
def v15(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    other = F.concat(F.lit("customer#O"), (k * 7).cast("string"), F.substr(F.lit("00000000"), (1 + k % 7).cast("int")))
    return read(spark, sf_dir, "customer").select(k.alias("id"), V.ocr_distance(F.col("c_name"), other).cast("bigint").alias("d"))


@query("v17_file_kind", "SELECT s_suppkey AS id, ['Aadhaar', 'PAN', 'Passport', 'Invoice', 'Bank Statement', 'Resume', 'Document'][CAST(s_suppkey % 7 + 1 AS INT)] AS kind FROM supplier")
def v17(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["my_AADHAR.pdf", "Pan-card.png", "passport.jpg", "Bill 3.pdf", "bank_2024.csv", "CV.docx", "notes.txt"]))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), V.file_kind(F.element_at(names, (F.col("s_suppkey") % 7 + 1).cast("int"))).alias("kind"))


@query("v22_half_even_double", "SELECT o_orderkey AS id, CAST(printf('%.2f', o_orderkey * CAST(0.005 AS DOUBLE)) AS DOUBLE) AS x, CAST(printf('%.4f', o_totalprice / 7) AS DOUBLE) AS y FROM orders")
def v22b(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("double") / 7.0
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), V.half_even_double(F.col("o_orderkey") * F.lit(0.005), 2).alias("x"), V.half_even_double(price, 4).alias("y"))


@query("v22_half_even", "SELECT o_orderkey AS id, CAST(round_even(CAST(o_orderkey AS DECIMAL(18, 3)) / 8, 2) AS DOUBLE) AS x FROM orders")
def v22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), V.half_even((F.col("o_orderkey").cast("decimal(18,3)") / 8).cast("decimal(18,3)"), 2).cast("double").alias("x"))


@query("v14_levenshtein", "SELECT s_suppkey AS id, levenshtein(s_name, 'Supplier#000000042') AS d FROM supplier")
def v14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.levenshtein("s_name", F.lit("Supplier#000000042")).cast("bigint").alias("d"))


@query("v20_sha256", "SELECT page_id, sha256(html) AS digest FROM pages")
def v20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@query("v21_hmac")
def v21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", V.signature("secret")(F.col("props")).alias("signature"))


# Tables and pages.


@query("t01_text_tables", f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM ({C.TABLES_SQL})),
    o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM l),
    c AS (SELECT *, unnest(string_split(raw, '|')) AS cell, generate_subscripts(string_split(raw, '|'), 1) AS i FROM o WHERE line > 2),
    b AS (SELECT *, ofs + coalesce(sum(length(cell) + 1) OVER (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(cell) - length(ltrim(cell)) AS s FROM c WHERE i < 4)
    SELECT doc_id, CAST(s AS INT) AS start, CAST(s + length(trim(cell)) AS INT) AS "end", ['PERSON', 'PHONE_NUMBER', 'BANK_ACCOUNT'][i] AS entity_type, trim(cell) AS text FROM b""")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.text_tables(C.tables(spark, sf_dir)).select("doc_id", "start", "end", "entity_type", "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return tables.page_offsets(rows)


_PAGES = """SELECT conv_id AS doc_id, turn AS page, length(text) AS char_count, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_offset, text FROM conversations"""


@query("s08_page_offsets", f"SELECT doc_id, page, CAST(char_count AS BIGINT) AS char_count, CAST(start_offset AS BIGINT) AS start_offset, CAST(start_offset + char_count AS BIGINT) AS end_offset FROM ({_PAGES})")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page", F.col("char_count").cast("bigint").alias("char_count"), F.col("start_offset").cast("bigint").alias("start_offset"), F.col("end_offset").cast("bigint").alias("end_offset"))


@query("c19_entities_to_pages", f"""WITH p AS ({_PAGES}), e AS (SELECT DISTINCT doc_id, unnest([0, 40, 400]) AS start FROM p)
    SELECT doc_id, e.start, page, CAST(e.start - start_offset AS BIGINT) AS page_start FROM e JOIN p USING (doc_id) WHERE e.start >= start_offset AND e.start < start_offset + char_count""")
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    spans = pages.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(0), F.lit(40), F.lit(400))).alias("start")).withColumn("end", F.col("start") + 5)
    return tables.pages_of(spans, pages).select("doc_id", "start", "page", F.col("page_start").cast("bigint").alias("page_start"))


@query("c18_entities_to_blocks", f"""WITH e AS ({_ENTITIES}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM ({C.CARRIER_SQL})),
    b AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
    SELECT e.doc_id, e.start, e.entity_type, CAST(b.block AS INT) AS block FROM e JOIN b ON e.doc_id = b.doc_id AND e.start < b.s + length(b.raw) AND e."end" > b.s""")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = files.as_blocks(C.carriers(spark, sf_dir)).withColumn("page", F.lit(1))
    box = F.struct(F.lit(0.0).alias("x0"), F.col("block").cast("double").alias("y0"), F.length("text").cast("double").alias("x1"), (F.col("block") + 1).cast("double").alias("y1"))
    return tables.blocks_of(entities(spark, sf_dir), blocks.withColumn("box", box)).select("doc_id", "start", "entity_type", "block")


@query("c20_shapes", f"""SELECT doc_id, start, entity_type, CAST(6 * start - 1 AS DOUBLE) AS x, CAST(6 * ("end" - start) + 2 AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height FROM ({_ENTITIES})""")
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = files.as_blocks(C.carriers(spark, sf_dir))
    box = F.struct((6.0 * F.col("start_index")).alias("x0"), (20.0 * F.col("block")).alias("y0"), (6.0 * F.col("end_index")).alias("x1"), (20.0 * F.col("block") + 10).alias("y1"))
    words = lines.select("doc_id", F.col("block").alias("ord"), "text", "start_index", "end_index", box.alias("box"), F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>").alias("symbols"))
    return boxes.shapes(entities(spark, sf_dir), words).select("doc_id", "start", "entity_type", "x", "width", "height")


@query("t02_overridden_types", f"""SELECT doc_id, start, "end", CASE WHEN entity_type = 'PHONE_NUMBER' AND doc_id % 3 = 0 THEN 'BANK_ACCOUNT' ELSE entity_type END AS entity_type FROM ({_ENTITIES})""")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled(spark, sf_dir)
    cells = found.filter("doc_id % 3 = 0").select("doc_id", (F.col("start") + 1).alias("start"), F.col("end"), F.when(F.col("entity_type") == "PHONE_NUMBER", "BANK_ACCOUNT").otherwise("PHONE_NUMBER").alias("entity_type"))
    return tables.overridden(found, cells).select("doc_id", "start", "end", "entity_type")


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a header and three blocks below it: one within its column, one beside it or not, one that is no phone."""
    k = F.col("c_custkey").cast("bigint")
    box = lambda x0, y0, x1, y1: F.struct(*(F.lit(v).cast("double").alias(n) if not hasattr(v, "cast") else v.cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)))
    phone = F.concat(F.lit("9"), F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0"))
    blocks = [("Mobile", box(100, 10, 160, 20)), (phone, box(100, 30, 160, 40)), (phone, box(100 + k % 4 * 20, 50, 160 + k % 4 * 20, 60)), (F.lit("soon"), box(100, 70, 160, 80))]
    each = F.array(*(F.struct(F.lit(i).alias("block"), (F.lit(t) if isinstance(t, str) else t).alias("text"), b.alias("box")) for i, (t, b) in enumerate(blocks)))
    return dealt(read(spark, sf_dir, "customer").select(k.alias("c_custkey")), "c_custkey").select(k.alias("doc_id"), F.lit(1).alias("page"), F.explode(each).alias("b")).select("doc_id", "page", "b.*")


@query("t03_below_headers", "SELECT c_custkey AS doc_id, b AS block, 'PHONE_NUMBER' AS entity_type FROM customer, (VALUES (1), (2)) v(b) WHERE (b = 1 AND c_custkey % 5 <> 0) OR (b = 2 AND c_custkey % 4 < 3)")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _columns(spark, sf_dir)
    known = blocks.filter("block = 1 and doc_id % 5 = 0").select("doc_id", "page", "box")
    return tables.uncovered(tables.below_headers(blocks), blocks, known).select("doc_id", "block", "entity_type")


@query("k02_geometry_leaks", """SELECT c_custkey AS doc_id, ['inside', 'narrow', 'after', 'before'][CAST(c_custkey % 5 + 1 AS INT)] AS leak FROM customer WHERE c_custkey % 5 < 4""")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("bigint")
    box = lambda x0, x1: F.struct(F.lit(x0).cast("double").alias("x0"), F.lit(10.0).alias("y0"), F.lit(x1).cast("double").alias("x1"), F.lit(20.0).alias("y1"))
    c = read(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("start"), F.lit("ABCDE 1234F").alias("text"), F.lit("accepted").alias("status"))
    turn = F.col("doc_id") % 5
    found = c.withColumn("box", F.when(turn == 1, box(100, 120)).otherwise(box(100, 160)))
    word = F.when(turn == 0, F.struct(F.lit("x").alias("text"), box(110, 115).alias("box"))).when(turn == 2, F.struct(F.lit("34F").alias("text"), box(162, 175).alias("box"))).when(turn == 3, F.struct(F.lit("(ABCD").alias("text"), box(80, 98).alias("box")))
    words = c.select("doc_id", "page", F.lit(0).alias("ord"), F.coalesce(word, F.struct(F.lit("far").alias("text"), box(400, 420).alias("box"))).alias("w")).select("doc_id", "page", "ord", "w.text", "w.box")
    return verify.geometry_leaks(found, words).select("doc_id", "leak")


# Policy and redaction.


def decided(spark: SparkSession, sf_dir: str, mode: str = "balanced") -> DataFrame:
    return policy.decide(entities(spark, sf_dir), mode)


for _mode in policy.MODES:

    @query(f"p01_policy_{_mode}", f"SELECT doc_id, start, entity_type, round(score, 4) AS score, status FROM ({O.decided(_ENTITIES, *policy.MODES[_mode])})")
    def p01(spark: SparkSession, sf_dir: str, mode: str = _mode) -> DataFrame:
        return decided(spark, sf_dir, mode).select("doc_id", "start", "entity_type", F.round("score", 4).alias("score"), "status")


_ACTIVE = f"SELECT * FROM ({_DECIDED}) WHERE status <> 'rejected'"


@query("x03_typed_placeholders", O.spliced(C.CARRIER_SQL, f"SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start) AS k FROM ({_ACTIVE})", "'[' || entity_type || '_' || CAST(k AS VARCHAR) || ']'"))
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = policy.redact_typed(C.carriers(spark, sf_dir), policy.active(decided(spark, sf_dir)))
    return out.withColumn("entity_count", F.col("entity_count").cast("bigint"))


@query("x02_blackout_everywhere")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.redact_everywhere(C.carriers(spark, sf_dir), policy.active(decided(spark, sf_dir)))


_PSEUDO = f"""SELECT doc_id, start, entity_type, '[' || entity_type || '_' || CAST(dense_rank() OVER (PARTITION BY entity_type ORDER BY f.d, f.s) AS VARCHAR) || ']' AS pseudonym
    FROM (SELECT *, min({{'d': doc_id, 's': start}}) OVER (PARTITION BY entity_type, lower(text)) AS f FROM ({_ENTITIES}))"""


@query("x04_pseudonyms", _PSEUDO)
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.pseudonyms(settled(spark, sf_dir), ()).select("doc_id", "start", "entity_type", "pseudonym")


@query("x05_masked_values", f"SELECT doc_id, start, CASE WHEN length(text) <= 4 THEN '****' ELSE text[1:2] || '****' || right(text, 2) END AS shown FROM ({_ENTITIES})")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("doc_id", "start", policy.rendered(F.col("text"), F.lit("mask")).alias("shown"))


_RULED = f"""SELECT *, dense_rank() OVER (PARTITION BY doc_id, entity_type ORDER BY f) AS k FROM (SELECT *, min(start) OVER (PARTITION BY doc_id, entity_type, lower(text)) AS f FROM ({_ENTITIES}) WHERE entity_type IN ('PAN_NUMBER', 'EMAIL_ADDRESS'))"""
_SHOWN = "CASE entity_type WHEN 'PAN_NUMBER' THEN text[1:2] || '****' || right(text, 2) ELSE '[EMAIL_ADDRESS_' || CAST(k AS VARCHAR) || ']' END"


@query("x07_x08_rules", f"SELECT doc_id, redacted_text FROM ({O.spliced(C.CARRIER_SQL, _RULED, _SHOWN)})")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("PAN_NUMBER", True, "mask"), ("EMAIL_ADDRESS", True, "replace"), ("PHONE_NUMBER", False, "blackout")], "rule_type string, is_active boolean, action string")
    return policy.redact_by_rules(C.carriers(spark, sf_dir), entities(spark, sf_dir), rules)


@query("x06_tokens", f"SELECT doc_id, CAST(2 * count(*) AS BIGINT) AS entity_tokens_doubled FROM ({_ENTITIES}) GROUP BY doc_id")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = policy.tokens(C.carriers(spark, sf_dir), entities(spark, sf_dir))
    return t.filter("type <> 'text'").groupBy("doc_id").agg((2 * F.count("*")).alias("entity_tokens_doubled"))


@query(
    "x06_token_table",
    f"""WITH d AS ({C.CARRIER_SQL}), e AS ({_ENTITIES}),
    p AS (SELECT e.*, d.text AS body, lag(e."end", 1, 0) OVER (PARTITION BY e.doc_id ORDER BY e.start) AS before, lead(e.start) OVER (PARTITION BY e.doc_id ORDER BY e.start) IS NULL AS last FROM e JOIN d USING (doc_id)),
    t AS (SELECT doc_id, 3 * start AS o, 'text' AS type, body[before + 1:start] AS value FROM p UNION ALL SELECT doc_id, 3 * start + 1, entity_type, body[start + 1:"end"] FROM p
        UNION ALL SELECT doc_id, 3 * start + 2, 'text', body["end" + 1:] FROM p WHERE last UNION ALL SELECT doc_id, 0, 'text', text FROM d WHERE doc_id NOT IN (SELECT doc_id FROM e))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INT) AS pos, type, value FROM t WHERE value <> ''""",
)
def x06b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.tokens(C.carriers(spark, sf_dir), entities(spark, sf_dir))


@query("x10_hash", f"SELECT doc_id, start, sha256(text) AS shown FROM ({_ENTITIES})")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("doc_id", "start", policy.simple_redaction(F.col("text"), F.col("entity_type"), F.lit("hash")).alias("shown"))


@query("x11_synthetic")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("doc_id", "start", "entity_type", policy.synthetic(F.col("entity_type"), F.col("text")).alias("shown"))


@query("x11_synthetic_documents")
def x11b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.synthesised(C.carriers(spark, sf_dir), entities(spark, sf_dir))


@query("p05_review_list", f"SELECT doc_id, start, entity_type, CASE WHEN entity_type = 'PIN_CODE' THEN 'accepted' ELSE status END AS status FROM ({_DECIDED}) WHERE entity_type IN ('PIN_CODE', 'PAN_NUMBER', 'IFSC_CODE')")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = policy.review_list(policy.decide(settled(spark, sf_dir)), ["PIN_CODE", "PAN_NUMBER", "IFSC_CODE"], sort="type")
    return policy.approve_types(shown, ["PIN_CODE"]).select("doc_id", "start", "entity_type", "status")


@query("d01_all_entities")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents and the made texts: payment addresses, 17 patterns, dates, fragments, repairs, tables."""
    made = C.carriers(spark, sf_dir).union(C.more(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 10**9)).union(C.tables(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 2 * 10**9))
    docs = documents(spark, sf_dir).select((-1 - F.col("doc_id")).alias("doc_id"), "text").union(made)
    return recognise.entities_of(docs).select("doc_id", "start", "end", "entity_type", "text", F.round("score", 4).alias("score"), "source")


# Verification.


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = policy.redact_typed(C.carriers(spark, sf_dir), policy.active(decided(spark, sf_dir)))
    # Worked out once, as a scan names the text more than once.
    return stage(out, ["doc_id"], text=F.col("redacted_text"))


_REDACTED = f"SELECT doc_id, redacted_text AS text FROM ({_sql['x03_typed_placeholders']})"
_CODE = r"""regexp_matches(body[:start], '[A-Za-z0-9]-*$') OR regexp_matches(body["end" + 1:], '^-*[A-Za-z0-9]')"""
_GOOD = {"CREDIT_CARD": O.luhn("regexp_replace(value, '[^0-9]', '', 'g')") + " % 10 = 0", "PAN_NUMBER": f"NOT ({_CODE})"}
_LEAKS = f"WITH red AS MATERIALIZED ({_REDACTED}) " + " UNION ALL ".join(
    f"SELECT doc_id, {O.lit(k)} AS leak_type, trim(value) AS text FROM ({O.spans('SELECT doc_id, text FROM red', recognise.Rule(k, k, p, 1.0))}) WHERE {_GOOD.get(k, 'true')}" for k, p in verify.RESIDUAL.items()
)


@query("k04_residual_patterns", _LEAKS)
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.residual_patterns(_redacted(spark, sf_dir))


@query("k07_verdict", f"""WITH l AS (SELECT doc_id, count(*) AS n FROM ({_LEAKS}) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_leaks, CASE WHEN n > 0 THEN 'FAILED' WHEN d.doc_id % 10 = 0 THEN 'REVIEW_REQUIRED' ELSE 'COMPLETED' END AS status FROM ({C.CARRIER_SQL}) d LEFT JOIN l USING (doc_id)""")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.carriers(spark, sf_dir).withColumn("has_scanned_pages", F.col("doc_id") % 10 == 0)
    none = spark.createDataFrame([], "doc_id bigint, reason string")
    return verify.verdict(docs, k04(spark, sf_dir), none).select("doc_id", "n_leaks", "status")


# Windows of the text's characters without white space: where they begin and end in it.
_COMPOUND = r"(regexp_matches(text[:a - 1], '[A-Za-z0-9]-*$') OR regexp_matches(text[b + 1:], '^-*[A-Za-z0-9]'))"
_WINDOWS = f"""SELECT doc_id, text, n, ats[i] AS a, ats[i + n - 1] AS b, list_aggregate(list_transform(ats[i:i + n - 1], lambda x: text[x]), 'string_agg', '') AS w
    FROM (SELECT *, unnest(range(1, len(ats) - n + 2)) AS i FROM (SELECT doc_id, text, list_filter(range(1, length(text) + 1), lambda j: NOT regexp_matches(text[j], '\\s')) AS ats FROM ({C.LEFTOVERS_SQL})), (VALUES (10), (12)) v(n))"""


@query(
    "k05_dense_leaks",
    f"""SELECT doc_id, CASE n WHEN 10 THEN 'PAN_NUMBER' ELSE 'AADHAAR_NUMBER' END AS leak_type, text[a:b] AS text FROM ({_WINDOWS})
    WHERE b - a + 1 > n + 2 AND CASE n WHEN 10 THEN regexp_matches(w, '^[A-Za-z]{{5}}[0-9]{{4}}[A-Za-z]$') AND NOT {_COMPOUND} ELSE regexp_matches(w, '^[0-9]{{12}}$') END""",
)
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.dense_leaks(C.leftovers(spark, sf_dir))


def _paged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, words and pages for each customer: ends that stand near the box, far off, in pieces, or on a turned page."""
    k = F.col("doc_id")
    c = C.carriers(spark, sf_dir).select("doc_id", F.regexp_extract("text", "[A-Z]{5}[0-9]{4}[A-Z]", 0).alias("v"))
    box = lambda x, y: F.struct(F.lit(x).cast("double").alias("x0"), F.lit(y).cast("double").alias("y0"), F.lit(x + 60).cast("double").alias("x1"), F.lit(y + 10).cast("double").alias("y1"))
    where = F.when(k % 7 == 3, None).otherwise(box(200, 100))
    found = c.select("doc_id", F.lit("PAN_NUMBER").alias("entity_type"), F.concat(F.left("v", F.lit(5)), F.lit(" "), F.substring("v", 6, 5)).alias("text"), F.when(k % 7 == 6, "rejected").otherwise("accepted").alias("status"), F.lit(1).alias("page"), where.alias("box"))
    lead, trail = F.left("v", F.lit(4)), F.right("v", F.lit(4))
    far = F.struct(F.lit(0).alias("ord"), F.concat(lead, F.lit("--")).alias("text"), box(200, 500).alias("box"))
    near = F.struct(F.lit(1).alias("ord"), F.concat(F.lit("("), lead).alias("text"), box(120, 108).alias("box"))
    pieces = [F.struct(F.lit(2).alias("ord"), F.left(trail, F.lit(2)).alias("text"), box(270, 100).alias("box")), F.struct(F.lit(3).alias("ord"), F.right(trail, F.lit(2)).alias("text"), box(335, 100).alias("box"))]
    words = c.select("doc_id", F.lit(1).alias("page"), F.explode(F.when(k % 7 == 1, F.array(far, near)).when(k % 7 == 2, F.array(*pieces)).otherwise(F.array(far))).alias("w")).select("doc_id", "page", "w.*")
    pages = c.select("doc_id", F.lit(1).alias("page"), F.when(k % 7 == 4, 90).otherwise(0).alias("rotation"))
    return found, words, pages


@query(
    "k06_fragments",
    rf"""WITH c AS (SELECT doc_id, doc_id % 7 AS m, regexp_extract(text, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') AS v FROM ({C.CARRIER_SQL})),
    w AS (SELECT doc_id, 0 AS ord, v[1:4] || '--' AS t, 200 AS x, 500 AS y FROM c WHERE m <> 2 UNION ALL SELECT doc_id, 1, '(' || v[1:4], 120, 108 FROM c WHERE m = 1
        UNION ALL SELECT doc_id, 2, v[7:8], 270, 100 FROM c WHERE m = 2 UNION ALL SELECT doc_id, 3, v[9:10], 335, 100 FROM c WHERE m = 2),
    e AS (SELECT *, v[1:5] || ' ' || v[6:] AS text FROM c WHERE m <> 6),
    b AS (SELECT e.doc_id, string_agg(w.t, '' ORDER BY ord) AS body FROM e JOIN w ON e.doc_id = w.doc_id AND (m = 4 OR (m <> 3 AND x < 260 + 100 AND x + 60 > 200 - 100 AND y < 110 + 15 AND y + 10 > 100 - 15)) GROUP BY e.doc_id
        UNION ALL SELECT e.doc_id, regexp_replace(d.text, '\s', '', 'g') FROM e JOIN ({C.CARRIER_SQL}) d USING (doc_id) WHERE m = 3)
    SELECT doc_id, 'PAN_NUMBER' AS entity_type, text, side FROM e JOIN b USING (doc_id), (VALUES ('leading'), ('trailing')) s(side) WHERE contains(body, CASE side WHEN 'leading' THEN v[1:4] ELSE v[7:10] END)""",
)
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.fragments(_paged(spark, sf_dir)[0], C.carriers(spark, sf_dir), *_paged(spark, sf_dir)[1:])


@query("k01_uncertain_pages", """SELECT page_id, CASE WHEN native > 0 OR ink <= 0 THEN NULL WHEN alnum = 0 THEN 'unreadable' WHEN alnum <= 3 THEN 'almost_unreadable' WHEN conf < 45 AND chars < 50 THEN 'low_confidence' WHEN alnum / greatest(chars, 1) < 0.25 THEN 'garbled' END AS reason
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN length(html) ELSE 0 END AS native, page_id % 4 AS ink, page_id % 7 * 5 AS alnum, page_id % 90 AS conf, page_id % 11 * 9 AS chars FROM pages)""")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = read(spark, sf_dir, "pages").selectExpr("page_id", "if(page_id % 3 = 0, length(html), 0) as native_chars", "page_id % 4 as ink", "page_id % 7 * 5 as alnum", "page_id % 90 as mean_conf", "page_id % 11 * 9 as chars")
    return verify.uncertain_pages(stats).select("page_id", "reason")


_PAN_ERRORS = r"length(regexp_replace(w[1:5] || w[10], '[A-Za-z]', '', 'g')) + length(regexp_replace(w[6:9], '[0-9]', '', 'g'))"
_BLANKS = "length(text[a:b]) - length(replace(text[a:b], ' ', ''))"
_NEAR = lambda words: rf"regexp_matches(lower(text[greatest(a - 120, 1):b + 120]), '(^|[^a-z0-9_])({'|'.join(words)})($|[^a-z0-9_])')"


@query(
    "k03_visual_windows",
    rf"""SELECT doc_id, CASE n WHEN 10 THEN 'PAN_NUMBER' ELSE 'AADHAAR_NUMBER' END AS leak_type, w AS "window" FROM ({_WINDOWS})
    WHERE b - a + 1 <= 3 * n AND CASE n
        WHEN 10 THEN regexp_matches(w, '^[A-Za-z{verify.FOR_LETTERS}]{{5}}[0-9{verify.FOR_DIGITS}]{{4}}[A-Za-z{verify.FOR_LETTERS}]$') AND NOT {_COMPOUND} AND length(regexp_replace(w, '[^A-Z]', '', 'g')) >= 2
            AND {_BLANKS} <= 1 AND ({_PAN_ERRORS} = 0 OR ({_PAN_ERRORS} = 1 AND ({_BLANKS} = 0 OR {_NEAR(verify.PAN_CONTEXT)})))
        ELSE regexp_matches(w, '^[0-9{verify.FOR_DIGITS}]{{12}}$') AND NOT regexp_matches(text[:a - 1], '[0-9]$') AND NOT regexp_matches(text[b + 1:], '^[0-9]') AND {_BLANKS} <= 2
            AND length(regexp_replace(w, '[0-9]', '', 'g')) <= 2 AND ({_BLANKS} > 0 OR {_NEAR(verify.AADHAAR_CONTEXT)} OR regexp_matches(w, '^[2-9][0-9]+$')) END""",
)
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.visual_candidates(C.leftovers(spark, sf_dir))


_VALUES = f"""SELECT doc_id, regexp_extract(text, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') AS value FROM ({C.CARRIER_SQL}) UNION ALL SELECT doc_id, lpad(CAST(200000000000 + doc_id * 7919 * 104729 % 700000000000 AS VARCHAR), 12, '0') FROM ({C.CARRIER_SQL})"""


@query(
    "e10_residual_values",
    rf"""SELECT doc_id, value, CASE WHEN there THEN 'CONFIRMED_LEAK' WHEN near IS NOT NULL THEN 'FUZZY_CANDIDATE' ELSE 'CLEAN' END AS status, CASE WHEN there THEN 0 WHEN near IS NOT NULL THEN 1 END AS distance,
        CASE WHEN there THEN value ELSE near END AS matched
    FROM (SELECT doc_id, value, contains(body, value) AS there, list_filter(list_transform(range(1, length(body) - length(value) + 2), lambda i: body[i:i + length(value) - 1]), lambda w: levenshtein(w, value) <= 1)[1] AS near
        FROM ({_VALUES}) JOIN (SELECT doc_id, replace(trim(text), ' ', '') AS body FROM ({C.LEFTOVERS_SQL})) USING (doc_id))""",
)
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax and citizen numbers in what is left of their documents, also with one wrong character."""
    uid = F.lpad((200000000000 + F.col("doc_id") * 7919 * 104729 % 700000000000).cast("string"), 12, "0")
    both = F.explode(F.array(F.regexp_extract("text", "[A-Z]{5}[0-9]{4}[A-Z]", 0), uid))
    return verify.residual_values(C.carriers(spark, sf_dir).select("doc_id", both.alias("value")), C.leftovers(spark, sf_dir))


@query(
    "s06_recognised_pages",
    r"""WITH w AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS ord, ws[i] AS text FROM (SELECT doc_id, string_split_regex(text, '\s') AS ws, unnest(range(1, len(string_split_regex(text, '\s')) + 1)) AS i FROM documents)),
    b AS (SELECT *, ord // 300 AS page, ord * 7 % 110 - 10 AS conf, ord % 10 * 50 AS x, ord % 300 // 10 * 20 AS y, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, ord // 300 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_index FROM w WHERE text <> '')
    SELECT doc_id, page, md5(string_agg(text, ' ' ORDER BY ord)) AS digest, count(*) AS word_count, round(avg(conf) FILTER (conf >= 0), 6) AS mean_conf, CAST(sum(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS BIGINT) AS alnum,
        CAST(max(start_index + length(text)) AS BIGINT) AS chars, CAST(min(x) AS DOUBLE) AS x0, CAST(min(y) AS DOUBLE) AS y0, CAST(max(x) + 40 AS DOUBLE) AS x1, CAST(max(y) + 15 AS DOUBLE) AS y1
    FROM b GROUP BY doc_id, page""",
)
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, laid out ten in a row and thirty rows on a page, as recognition would give them."""
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\s", -1)).alias("ord", "text"))
    x, y = F.col("ord") % 10 * 50.0, F.expr("ord % 300 div 10") * 20.0
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 15).alias("y1"))
    words = words.select("doc_id", F.expr("ord div 300").alias("page"), "ord", "text", (F.col("ord") * 7 % 110 - 10).cast("double").alias("conf"), box.alias("box"))
    pages = tables.ocr_pages(tables.ocr_blocks(words))
    return pages.select("doc_id", "page", F.md5("text").alias("digest"), "word_count", F.round("mean_conf", 6).alias("mean_conf"), "alnum", "chars", "box.*")


@query("k08_releasable", "SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read(spark, sf_dir, "orders").selectExpr("o_orderkey as job_id", "if(o_orderkey % 3 = 0, 'COMPLETED', 'FAILED') as status", "if(o_orderkey % 2 = 0, 'VERIFIED', 'UNVERIFIED') as safety_status", "if(o_orderkey % 5 = 0, 'raw/', 'redacted/') || o_orderkey as result_key")
    return verify.releasable(jobs).select("job_id")


# Analytics: events stand for usage and log rows.

_USAGE = "SELECT event_id, user_id, event_type AS endpoint, value AS processing_ms, ts FROM events"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("endpoint"), F.col("value").alias("processing_ms"), F.lit(1).alias("entity_count"), F.col("ts").alias("used_at"), F.col("ts"))


@query("a01_counts_by_type", f"SELECT entity_type, count(*) AS n FROM ({_ENTITIES}) GROUP BY 1")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.counts_by(entities(spark, sf_dir), "entity_type")


@query("a02_weekday_volume", "SELECT i, day, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 7))::INT AS i, unnest(['Mon','Tue','Wed','Thu','Fri','Sat','Sun']) AS day) LEFT JOIN (SELECT strftime(ts, '%a') AS day, count(*) AS n FROM events GROUP BY 1) USING (day)")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.weekday_volume(read(spark, sf_dir, "events"), "ts")


@query("a02_totals", "SELECT count(*) AS documents, CAST(sum(user_id) AS BIGINT) AS entities, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 1) AS success_rate FROM events")
def a02b(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = read(spark, sf_dir, "events").select(F.col("user_id").alias("entities"), F.when(F.col("event_type") != "error", "Completed").alias("status"))
    return analytics.audit_totals(logs)


@query("a03_top_rules_in_range", "SELECT event_type AS rule, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' GROUP BY 1 ORDER BY n DESC, rule LIMIT 10")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.between(read(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-15")
    return analytics.top_rules(rows.withColumn("rules", F.array("event_type")), 10)


@query("a04_session_metrics", "SELECT user_id AS session_id, count(*) AS documents, CAST(sum(event_id) AS BIGINT) AS entities, max(ts) AS updated_at FROM events GROUP BY 1")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.session_metrics(read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("entities"), F.col("ts").alias("created_at")))


@query("a05_latest_by_id", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("a06_usage_by_endpoint", "SELECT event_type AS endpoint, count(*) AS requests, round(avg(value), 4) AS avg_ms, count(*) AS entities FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.usage_by_endpoint(usage(spark, sf_dir), F.lit("2024-01-24").cast("timestamp"))
    return out.withColumn("avg_ms", F.round("avg_ms", 4))


@query("a06_usage_by_day", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests FROM events GROUP BY 1")
def a06b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.usage_by_day(usage(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("a07_organisation_usage", "SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS large, round(sum(value), 2) AS total FROM events WHERE date_trunc('month', ts) = TIMESTAMP '2024-01-01' AND props LIKE '%\"k\": 1%'")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").filter((F.date_trunc("month", "ts") == F.lit("2024-01-01").cast("timestamp")) & F.col("props").like('%"k": 1%'))
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(n(F.col("event_type") == "click", "clicks"), n(F.col("event_type") == "error", "errors"), n(F.col("value") > 50, "large"), F.round(F.sum("value"), 2).alias("total"))


@query("a08_delivery_stats", "SELECT count(*) AS n, count(*) FILTER (event_type = 'click') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 2) AS avg_ms FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "error", "failed")
    return analytics.delivery_stats(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), status.alias("status"), F.col("value").alias("response_ms")))


def _signal_sql() -> str:
    cols = []
    for kind, words in analytics.SIGNALS.items():
        text = " + ".join(f"{3 if ' ' in w else 1} * CAST(contains(s, {O.lit(w)}) AS INT)" for w in words)
        file = "2 * greatest(" + ", ".join(f"CAST(contains(f, {O.lit(w)}) AS INT)" for w in words[:5]) + ")"
        cols.append(f"{{'score': {text} + {file}, 'place': {-len(cols)}, 'kind': '{kind}'}}")
    return f"""SELECT doc_id, CASE WHEN b.score >= 3 THEN b.kind ELSE 'unknown' END AS document_type, CASE WHEN b.score >= 3 THEN round(least(b.score / t * 2, 1.0), 3) ELSE 0.0 END AS confidence FROM (
        SELECT doc_id, list_max(a) AS b, list_sum(list_transform(a, lambda x: x.score)) AS t FROM (SELECT doc_id, [{', '.join(cols)}] AS a FROM (SELECT page_id AS doc_id, lower(substr(html, 1, 2000)) AS s, lower(url) AS f FROM pages)))"""


@query("a09_document_classes", _signal_sql())
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.classify(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.col("url").alias("filename")))


@query("a10_merged_logs", "SELECT user_id AS id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 2 DESC, event_id DESC) = 1")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.col("ts").alias("created_at"))
    return analytics.merged_logs(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")).select("id", "event_id")


@query("a11_newest_rows", "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.newest(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))).select("id")


@query("q03_documents_with_jobs", "SELECT o_orderkey AS doc_id, l_linenumber AS job_id, l_returnflag AS status FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40")
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("job_id"), F.col("l_returnflag").alias("status"))
    return analytics.with_jobs(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), jobs)


@query("q08_current_state", "SELECT user_id, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'")
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("is_active", (F.col("event_type") != "error").cast("int"))
    return analytics.current(rows, ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("a12_entity_counters", f"SELECT doc_id, CAST(count(*) AS BIGINT) AS total FROM ({_ENTITIES}) GROUP BY 1")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.count_map(entities(spark, sf_dir)).select("doc_id", "total")


@query("a13_hash_chain")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return analytics.hash_chain(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("report_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("generated_at"), F.array(F.col("event_id").cast("string")).alias("log_ids"), F.lit(1).alias("entity_count")))


@query("q01_point_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7 OR o_custkey = 3")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").filter("o_orderkey = 7 or o_custkey = 3").select("o_orderkey", "o_totalprice")


@query("q02_members_with_users", "SELECT n_nationkey AS org_id, s_suppkey AS user_id, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("org_id"), F.col("s_suppkey").alias("user_id"))
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org_id"), "n_name")
    return members.join(nations, "org_id")


@query("q04_may_see", "SELECT o_orderkey AS id FROM orders WHERE o_custkey = 5 OR o_custkey % 25 IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 5)")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uploader_id"), (F.col("o_custkey") % 25).cast("int").alias("org_id"))
    members = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("org_id"), F.lit("member").alias("role"))
    return analytics.may_see(docs, members, 5).select("id")


@query("q05_latest_order", "SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS last_order FROM orders GROUP BY 1")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("q06_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


@query("q07_subscribed", "SELECT event_id FROM events WHERE list_contains(string_split(event_type || ',all', ','), 'error')")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.subscribed(read(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(",all")).alias("events")), "error").select("event_id")


@query("q09_over_limit", "SELECT o_custkey AS org_id, count(*) AS used, 15 AS most FROM orders GROUP BY 1 HAVING count(*) >= 15")
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("org_id"))
    return analytics.over_limit(rows, rows.distinct().withColumn("most", F.lit(15)))


@query("q10_expired", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.expired(read(spark, sf_dir, "events").withColumn("expires_at", F.col("ts")), F.lit("2024-01-10").cast("timestamp")).select("event_id")


# Evaluation: entities against the candidates of single patterns.


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = settled(spark, sf_dir).select("doc_id", "entity_type", "start", "end")
    return e, e.filter("doc_id % 7 <> 0").withColumn("end", F.when(F.col("doc_id") % 3 == 0, F.col("end") - 4).otherwise(F.col("end")))


_ENT = f"WITH ent AS MATERIALIZED ({_ENTITIES}) "
_E, _D = ('SELECT doc_id, entity_type, start, "end" FROM ent', 'SELECT doc_id, entity_type, start, CASE WHEN doc_id % 3 = 0 THEN "end" - 4 ELSE "end" END AS "end" FROM ent WHERE doc_id % 7 <> 0')
_M = f"SELECT e.doc_id, e.entity_type, e.start, (d.\"end\" - e.start) / (e.\"end\" - e.start) AS iou FROM ({_E}) e JOIN ({_D}) d ON e.doc_id = d.doc_id AND e.entity_type = d.entity_type AND e.start = d.start"


@query("e01_greedy_matching", f"{_ENT}SELECT doc_id, entity_type, start AS e_start, round(iou, 6) AS iou FROM ({_M}) WHERE iou >= 0.5")
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.greedy(*_sides(spark, sf_dir)).select("doc_id", "entity_type", "e_start", F.round("iou", 6).alias("iou"))


@query("e02_first_fit", f"{_ENT}SELECT doc_id, entity_type, start AS e_start FROM ({_M})")
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.first_fit(*_sides(spark, sf_dir)).select("doc_id", "entity_type", "e_start")


@query("e03_best_per_detection", f"{_ENT}SELECT doc_id, entity_type, start AS e_start FROM ({_M}) WHERE iou > 0.5")
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_per_detection(*_sides(spark, sf_dir)).select("doc_id", "entity_type", "e_start")


@query("s14_expected_spans", f"SELECT doc_id, 'NAME' AS entity_type, CAST(instr(text, v) - 1 AS INT) AS start, CAST(instr(text, v) - 1 + length(v) AS INT) AS \"end\" FROM (SELECT doc_id, text, 'Customer ' || CAST(doc_id AS VARCHAR) AS v FROM ({C.CARRIER_SQL}))")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.carriers(spark, sf_dir)
    said = F.array(F.struct(F.lit("NAME").alias("type"), F.concat(F.lit("Customer "), F.col("doc_id").cast("string")).alias("value")), F.struct(F.lit("NONE").alias("type"), F.lit("nowhere").alias("value")))
    return evaluate.expected_spans(docs.select("doc_id", F.col("text").alias("content"), said.alias("expected_entities")))


@query("e04_optimal_matching", f"{_ENT}SELECT doc_id, entity_type, start AS e_start FROM ({_M})")
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.optimal(*_sides(spark, sf_dir)).select("doc_id", "entity_type", "e_start")


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with a page, a number, and a box on a line of their own; of documents with odd ids they are recognised ones."""
    e = settled(spark, sf_dir).select("doc_id", "entity_type", "start", "end", "text")
    box = F.struct(F.lit(0.0).alias("x0"), (10.0 * F.col("start")).alias("y0"), (6.0 * F.length("text")).alias("x1"), (10.0 * F.col("start") + 8).alias("y1"))
    return e.select("*", F.col("start").alias("id"), F.lit(1).alias("page"), box.alias("box"), (F.col("doc_id") % 2 == 1).alias("is_ocr"))


@query("e05_dual_channel", f"""{_ENT}SELECT doc_id, entity_type, CAST(start AS BIGINT) AS e_id, CASE WHEN doc_id % 2 = 1 THEN 'box' WHEN doc_id % 3 = 0 THEN 'span' ELSE 'exact_span' END AS method,
    CAST(CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 4 ELSE 0 END AS BIGINT) AS residual FROM ent WHERE doc_id % 7 <> 0 AND (doc_id % 3 <> 0 OR (doc_id % 2 = 0 AND ("end" - start - 4) / ("end" - start) >= 0.5))""")
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _boxed(spark, sf_dir)
    cut, misread = F.col("doc_id") % 3 == 0, F.translate("text", "0158", "OISB")
    d = e.filter("doc_id % 7 <> 0").withColumn("text", F.when(cut, F.expr("left(text, length(text) - 4)")).otherwise(misread)).withColumn("end", F.when(cut, F.col("end") - 4).otherwise(F.col("end")))
    return boxes.dual_channel(e, d).select("doc_id", "entity_type", "e_id", "method", F.col("residual").cast("bigint").alias("residual"))


@query("e06_fragments", f"""{_ENT}SELECT doc_id, start AS e_id, CAST(2 AS BIGINT) AS parts, true AS exact FROM ent WHERE doc_id % 2 = 1 AND doc_id % 3 <> 0""")
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _boxed(spark, sf_dir)
    half, n = F.floor(F.length("text") / 2).cast("int"), F.length("text")
    side = lambda a, b: F.struct((6.0 * a).alias("x0"), F.col("box.y0"), (6.0 * b).alias("x1"), F.col("box.y1"))
    first = F.struct((2 * F.col("id")).alias("id"), F.substr("text", F.lit(1), half).alias("text"), side(F.lit(0), half).alias("box"))
    second = F.struct((2 * F.col("id") + 1).alias("id"), F.substr("text", half + 1, n).alias("text"), side(half, n).alias("box"))
    halves = F.explode(F.when(F.col("doc_id") % 3 != 0, F.array(first, second)).otherwise(F.array(first)))
    nowhere = F.lit(None).cast("int")
    d = e.select("doc_id", "entity_type", "page", halves.alias("h")).select("doc_id", "entity_type", "page", "h.*", nowhere.alias("start"), nowhere.alias("end"))
    found = boxes.fragments(e, d, boxes.dual_channel(e, d))
    return found.select("doc_id", "e_id", F.size("d_ids").cast("bigint").alias("parts"), "exact")


_TYPES = f"""SELECT entity_type, tp, d - tp AS fp, e - tp AS fn FROM (SELECT entity_type, count(*) AS e FROM ({_E}) GROUP BY 1) JOIN (SELECT entity_type, count(*) AS d FROM ({_D}) GROUP BY 1) USING (entity_type)
    JOIN (SELECT entity_type, count(*) AS tp FROM ({_M}) WHERE iou >= 0.5 GROUP BY 1) USING (entity_type)"""


@query("e07_measures_by_type", f"{_ENT}SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM ({_TYPES})")
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _sides(spark, sf_dir)
    out = evaluate.by_type(e, d, evaluate.greedy(e, d))
    return out.select("entity_type", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("e08_overall", f"{_ENT}SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM ({_TYPES})")
def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _sides(spark, sf_dir)
    return evaluate.overall(evaluate.by_type(e, d, evaluate.greedy(e, d))).select("tp", "fp", "fn", F.round("f1", 6).alias("f1"), F.round("macro_f1", 6).alias("macro_f1"))


@query(
    "e09_document_rates",
    f"""{_ENT}SELECT avg(CAST(CAST(m < e AS INT) AS DOUBLE)) FILTER (e > 0) AS leak_rate, avg(CAST(CAST(n > 0 AS INT) AS DOUBLE)) FILTER (e = 0) AS false_alarm_rate
    FROM (SELECT coalesce(e, 0) AS e, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM ({C.CARRIER_SQL}) d LEFT JOIN (SELECT doc_id, count(*) AS e FROM ({_E}) GROUP BY 1) USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_D}) GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS m FROM ({_M}) WHERE iou >= 0.5 GROUP BY 1) USING (doc_id))""",
)
def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _sides(spark, sf_dir)
    return evaluate.document_rates(e, d, evaluate.greedy(e, d), C.carriers(spark, sf_dir))


@query("e11_diagnostics", f"{_ENT}SELECT doc_id, entity_type, start, 'FN' AS kind FROM ({_E}) e ANTI JOIN (SELECT * FROM ({_M}) WHERE iou >= 0.5) m USING (doc_id, entity_type, start) UNION ALL SELECT doc_id, entity_type, start, 'FP' FROM ({_D}) d ANTI JOIN (SELECT * FROM ({_M}) WHERE iou >= 0.5) m USING (doc_id, entity_type, start)")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _sides(spark, sf_dir)
    return evaluate.diagnostics(e, d, evaluate.greedy(e, d)).select("doc_id", "entity_type", "start", "kind")


_TEMPLATES = ["Name: {name}\nPAN: {pan}", "Mail {email}, call {phone}", "{pan} of {name} ({phone})"]
_FIELDS = {"name": "'Customer ' || k", "pan": "pan", "email": "'user' || k || '@example.com'", "phone": "'9' || lpad(k, 9, '0')"}
_MADE = [" || ".join(f"({_FIELDS[x]})" if i % 2 else "'" + x.replace("\n", "' || chr(10) || '") + "'" for i, x in enumerate(re.split(r"\{(\w+)\}", t))) for t in _TEMPLATES]


@query(
    "m07_made_documents",
    f"WITH c AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, regexp_extract(text, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') AS pan FROM ({C.CARRIER_SQL})), d AS (SELECT *, CASE doc_id % 3 "
    + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_MADE))
    + " END AS text FROM c) "
    + " UNION ALL ".join(
        f"SELECT doc_id, CAST(instr(text, {_FIELDS[x]}) - 1 AS INT) AS start, CAST(instr(text, {_FIELDS[x]}) - 1 + length({_FIELDS[x]}) AS INT) AS \"end\", '{corpus.FIELD_TYPES[x]}' AS entity_type, {_FIELDS[x]} AS text FROM d WHERE doc_id % 3 = {i}"
        for i, t in enumerate(_TEMPLATES)
        for x in re.findall(r"\{(\w+)\}", t)
    ),
)
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of documents that templates make of customers."""
    rows = C.carriers(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("k"), F.regexp_extract("text", "[A-Z]{5}[0-9]{4}[A-Z]", 0).alias("pan"))
    rows = rows.select("doc_id", *(F.expr(value).alias(field) for field, value in _FIELDS.items()))
    return corpus.expanded(rows, _TEMPLATES, F.col("doc_id") % 3, "doc_id").select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")


@query(
    "e12_corpus_faults",
    """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CASE WHEN doc_id % 10 = 0 THEN 'hard_negative' ELSE coalesce(lang, 'none') END AS category FROM documents)
    SELECT fault, CAST(count(DISTINCT id) AS BIGINT) AS n, min(id) AS example FROM (
        SELECT CAST(doc_id AS VARCHAR) AS id, unnest(list_filter([CASE WHEN count(*) OVER (PARTITION BY sha256) > 1 THEN 'digest twice' END, CASE WHEN doc_id % 50 = 7 THEN 'no file' END, CASE WHEN doc_id % 50 <> 7 AND doc_id % 40 = 3 THEN 'file changed' END,
            CASE WHEN doc_id % 60 = 9 THEN 'no annotation' END, CASE WHEN doc_id % 100 = 0 THEN 'entities in a hard negative' END, CASE WHEN doc_id % 60 <> 9 AND doc_id % 10 <> 0 AND doc_id % 70 = 5 THEN 'no entities' END,
            CASE WHEN doc_id % 60 <> 9 AND doc_id % 70 <> 5 AND (doc_id % 10 <> 0 OR doc_id % 100 = 0) AND doc_id % 30 = 11 THEN 'box out of order' END,
            CASE WHEN doc_id % 60 <> 9 AND doc_id % 70 <> 5 AND (doc_id % 10 <> 0 OR doc_id % 100 = 0) AND doc_id % 90 = 13 THEN 'page out of range' END], lambda x: x IS NOT NULL)) AS fault FROM d
        UNION ALL SELECT category, 'quota missed' FROM (SELECT category FROM d GROUP BY 1) WHERE category <> 'hard_negative'
        UNION ALL SELECT 'absent', 'quota missed') GROUP BY fault""",
)
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit finds in a corpus whose files and annotations are made of documents, with faults in some."""
    k = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("none")).alias("lang"))
    sha, name, category = F.sha2("text", 256), F.concat(F.lit("d"), k.cast("string"), F.lit(".txt")), F.when(k % 10 == 0, "hard_negative").otherwise(F.col("lang"))
    manifest = docs.select(k.alias("id"), name.alias("file_name"), F.lit("A").alias("tier"), category.alias("category"), sha.alias("sha256"))
    files_ = docs.filter("doc_id % 50 <> 7").select(name.alias("name"), F.when(k % 40 == 3, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(sha).alias("sha256"))
    box = F.struct(F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"), F.when(k % 30 == 11, 0.5).otherwise(9.0).alias("x1"), F.lit(2.0).alias("y1"))
    entity = F.struct(F.when(k % 90 == 13, 3).otherwise(1).alias("page_num"), box.alias("box"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(0.9).alias("confidence"))
    none = F.filter(F.array(entity), lambda e: F.lit(False))
    some = ((k % 10 != 0) | (k % 100 == 0)) & (k % 70 != 5)
    notes = docs.filter("doc_id % 60 <> 9").select(k.alias("document_id"), sha.alias("sha256"), F.lit(2).alias("total_pages"), category.alias("category"), F.when(some, F.array(entity)).otherwise(none).alias("entities"))
    counts = manifest.filter("category = 'hard_negative'").groupBy("category").agg(F.count("*").alias("n"))
    quotas = counts.union(spark.createDataFrame([("absent", 1)], "category string, n bigint"))
    return corpus.audited(corpus.corpus_faults(manifest, notes, files_, quotas))


# Stateful operators.


@query("z01_rate_limit")
def z01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.rate_limited(read(spark, sf_dir, "events"), limit=2, span=3600.0)


@query("z01_in_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def z01b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.in_window(read(spark, sf_dir, "events"), 3600).select("event_id", "in_window")


@query("z03_lockout")
def z03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("email"), F.col("ts").alias("attempted_at"), (F.col("event_type") == "view").alias("success"))
    return limits.locked_out(rows, most=3, span=86_400.0)


@query("z05_job_states", "SELECT user_id AS job_id, arg_max(event_type, {'t': ts, 'e': event_type}) AS state FROM events GROUP BY 1")
def z05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.job_states(read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), F.col("ts").alias("at"))).select("job_id", "state")


@query("z07_daily_volume", "SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def z07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.volume(read(spark, sf_dir, "events"))


@query("z08_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def z08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.sessions(read(spark, sf_dir, "events")).select("user_id", "start", "n")


@query("s16_limits", "SELECT doc_id FROM documents WHERE length(text) <= 50000")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.within_limit(read(spark, sf_dir, "documents"), "scoring")[0].select("doc_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All personal data that the stages find in documents, elected, decided, and replaced by typed marks."""
    docs = documents(spark, sf_dir)
    return policy.redact_typed(docs, policy.active(policy.decide(recognise.entities_of(docs))))


query("x03_redacted_documents")(flagship)
