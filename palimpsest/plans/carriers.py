"""Documents with identifiers, derived from customer keys by integer arithmetic alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.spans import dealt, stage


def _text(div: str, k: str = "k") -> str:
    """SQL of a document's text; ``div`` is the operator of integer division."""
    s = lambda x: f"cast({x} as string)" if div == "div" else f"cast({x} as varchar)"
    letter = lambda x: f"chr(cast(65 + ({x}) % 26 as int))"
    pan = f"{letter(k)} || {letter(f'{k} {div} 7')} || {letter(f'{k} {div} 11')} || substr('ABCFGHJLPTKEXZ', cast(1 + {k} % 14 as int), 1) || {letter(f'{k} {div} 3')} || lpad({s(f'{k} * 37 % 10000')}, 4, '0') || {letter(f'{k} {div} 5')}"
    aadhaar = f"lpad({s(f'200000000000 + {k} * 7919 * 104729 % 700000000000')}, 12, '0')"
    spaced = f"substr({aadhaar}, 1, 4) || ' ' || substr({aadhaar}, 5, 4) || ' ' || substr({aadhaar}, 9, 4)"
    phone = f"{s(f'6 + {k} % 4')} || lpad({s(f'{k} * 7919 % 1000000000')}, 9, '0')"
    ifsc = f"substr('SBINHDFCICICPUNB', cast(1 + 4 * ({k} % 4) as int), 4) || '0' || lpad({s(k)}, 6, '0')"
    pin = s(f"110001 + {k} * 13 % 780000")
    nl = "chr(10)"
    label = lambda word: f"case when {k} % 5 = 0 then '' else '{word}: ' end"
    return (
        f"'Name: Customer ' || {s(k)} || {nl} || {label('PAN')} || ({pan}) || {nl} || {label('Aadhaar')} || (case when {k} % 2 = 0 then {spaced} else {aadhaar} end) || {nl} || "
        f"{label('Mobile')} || ({phone}) || {nl} || {label('IFSC')} || ({ifsc}) || {nl} || {label('Pin')} || ({pin}) || {nl} || 'Mail user' || {s(k)} || '@example' || {s(f'{k} % 7')} || '.com from 10.' || {s(f'{k} % 300')} || '.7.' || {s(f'{k} % 256')}"
    )


def _more(div: str, k: str) -> str:
    """SQL of a text with the kinds of identifiers that ``_text`` lacks."""
    s = lambda x: f"cast({x} as string)" if div == "div" else f"cast({x} as varchar)"
    letter = lambda x: f"chr(cast(65 + ({x}) % 26 as int))"
    digits = lambda x, n: f"lpad({s(f'({x}) % {10**n}')}, {n}, '0')"
    place = f"substr('AKMHDLXXTNGJ', cast(1 + 2 * ({k} % 6) as int), 2)"
    lines = [
        f"'GSTIN ' || {digits(f'1 + {k} % 35', 2)} || {letter(k)} || {letter(f'{k} {div} 7')} || 'CPK' || {digits(f'{k} * 37', 4)} || {letter(f'{k} {div} 5')} || {s(f'1 + {k} % 9')} || 'Z' || {letter(f'{k} {div} 3')}",
        f"'Voter ' || {letter(k)} || 'BC' || {digits(f'{k} * 7919', 7)} || ' Passport ' || substr('PRKMZ', cast(1 + {k} % 5 as int), 1) || {s(f'1 + {k} % 9')} || {digits(f'{k} * 31', 7)}",
        f"case when {k} % 3 = 0 then 'Ledger ' else 'Bank account ' end || {s(f'100000000 + {k} * 7919')}",
        f"'Licence ' || {place} || '12 2011 ' || {digits(k, 7)} || ' Vehicle ' || {place} || ' ' || {digits(f'1 + {k} % 98', 2)} || ' AB ' || {digits(f'{k} * 13', 4)}",
        f"'See https://site' || {s(f'{k} % 50')} || '.example.com/p?q=' || {s(k)} || ' and card ' || {s(f'4000000000000000 + {k} * 7919')}",
        f"'Pune ' || {s(f'110001 + {k} * 13 % 780000')} || ' Mobile 98' || {digits(k, 3)} || ' ' || {digits(f'{k} * 7919', 5)} || ' UPI user' || {s(k)} || '@okaxis'",
        f"'DOB: ' || {digits(f'1 + {k} % 28', 2)} || '/' || {digits(f'1 + {k} % 12', 2)} || '/' || {s(f'1950 + {k} % 60')}",
    ]
    return " || chr(10) || ".join(f"({x})" for x in lines)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys, dealt before texts are made of them."""
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("doc_id")))


MORE_SQL = f"SELECT c_custkey AS doc_id, {_more('//', 'c_custkey')} AS text FROM customer"


def more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) for each customer, with the other kinds of identifiers."""
    return _keys(spark, sf_dir).select("doc_id", F.expr(_more("div", "doc_id")).alias("text"))


CARRIER_SQL = f"SELECT c_custkey AS doc_id, {_text('//', 'c_custkey')} AS text FROM customer"


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) for each customer."""
    return _keys(spark, sf_dir).select("doc_id", F.expr(_text("div", "doc_id")).alias("text"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a table of four customers in pipes, with a header and a line of prose before."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey").cast("bigint") / 4).cast("bigint").alias("doc_id"), F.col("c_custkey").cast("bigint").alias("k"))
    row = F.concat(F.lit("Ann Lee | "), F.lpad((F.col("k") * 7919 % 1000000000 + 6000000000).cast("string"), 10, "0"), F.lit(" | "), (F.col("k") * 10 + 100000000).cast("string"), F.lit(" | paid"))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("k", row.alias("r")))).getField("r"), "\n")
    return c.groupBy("doc_id").agg(F.concat(F.lit("Staff list\nName | Mobile | Account | Status\n"), body).alias("text"))


TABLES_SQL = """
    SELECT c_custkey // 4 AS doc_id, 'Staff list' || chr(10) || 'Name | Mobile | Account | Status' || chr(10) || string_agg('Ann Lee | '
        || lpad(CAST(c_custkey * 7919 % 1000000000 + 6000000000 AS VARCHAR), 10, '0') || ' | ' || CAST(c_custkey * 10 + 100000000 AS VARCHAR) || ' | paid', chr(10) ORDER BY c_custkey) AS text
    FROM customer GROUP BY 1"""


def _leftovers(div: str) -> str:
    """SQL of a text that still shows a tax or citizen number in part or in full, or something like one; from k, pan and uid."""
    part = lambda x, a, n: f"substr({x}, {a}, {n})"
    spaced = " || ' ' || ".join(part("pan", i, 1) for i in range(1, 11))
    cases = [
        "'Holder: ' || pan || ' kept'", "'Part PART--' || pan || ' in stock'", f"'Ref: -' || {part('pan', 1, 5)} || ' ' || {part('pan', 6, 5)} || '-'", "'id X' || pan || ' or ' || pan || '9'",
        f"'got ' || {part('pan', 1, 5)} || 'O' || {part('pan', 7, 4)}", f"'income ' || {part('pan', 1, 5)} || ' O' || {part('pan', 7, 4)}", f"'say ' || {part('pan', 1, 5)} || ' O' || {part('pan', 7, 4)}", f"'as - ' || {spaced} || ' -'",
        f"'num ' || {part('uid', 1, 4)} || ' ' || {part('uid', 5, 4)} || ' ' || {part('uid', 9, 4)}", "'num ' || uid || '345'", f"'uid 1' || {part('uid', 2, 11)} || ' and 1' || {part('uid', 2, 10)} || '7'",
        f"'x O' || {part('uid', 2, 3)} || ' ' || {part('uid', 5, 4)} || ' ' || {part('uid', 9, 3)} || 'l'", f"'spread ' || {part('uid', 1, 3)} || ' ' || {part('uid', 4, 3)} || '  ' || {part('uid', 7, 2)} || ' ' || {part('uid', 9, 4)}",
    ]
    return "CASE " + " ".join(f"WHEN k % {len(cases)} = {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) for each customer."""
    uid = F.lpad((200000000000 + F.col("doc_id") * 7919 * 104729 % 700000000000).cast("string"), 12, "0")
    # Both values stand in the text's expression many times.
    rows = stage(carriers(spark, sf_dir).withColumn("k", F.col("doc_id")), ["k"], pan=F.regexp_extract("text", "[A-Z]{5}[0-9]{4}[A-Z]", 0), uid=uid)
    return rows.select(F.col("k").alias("doc_id"), F.expr(_leftovers("div")).alias("text"))


LEFTOVERS_SQL = f"""SELECT k AS doc_id, {_leftovers('//')} AS text
    FROM (SELECT doc_id AS k, regexp_extract(text, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') AS pan, lpad(CAST(200000000000 + doc_id * 7919 * 104729 % 700000000000 AS VARCHAR), 12, '0') AS uid FROM ({CARRIER_SQL}))"""
