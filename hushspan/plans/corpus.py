"""Inputs of the registered queries, as SQL that Spark and DuckDB both run.

The given tables hold few of the shapes the rules look for, so every order row and every
conversation turn also gets a line of text made from its own key columns.  All inputs therefore
grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """Register the parquet tables as views."""
    for table in tables or TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def _d(n: str, width: int, salt: int = 0) -> str:
    """`width` digits (at most 9) that follow from the number `n`."""
    return (f"lpad(concat('', ({n} * {7919 + 2 * salt} + {salt * 104729 + 17}) % {10 ** width}), "
            f"{width}, '0')")


def _l(n: str, salt: int = 0) -> str:
    return (f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(({n} * {31 + 2 * salt} + {salt}) % 26 + 1 "
            f"AS INT), 1)")


def _upto(n: str, top: int, salt: int = 0) -> str:
    return f"lpad(concat('', ({n} * {13 + 2 * salt} + {salt}) % {top} + 1), 2, '0')"


def _pick(n: str, *options: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"(CASE {n} % {len(options)} {whens} END)"


def _templates(n: str) -> list[str]:
    """Concat arguments of each line; secrets are put together from parts."""
    hexed, hexed2 = f"md5(concat('', {n}))", f"md5(concat('x', {n}))"
    nir = f"(1000000000000 + ({n} * 7919 + 17) % 900000000000)"
    return [
        f"'-----BEG', 'IN RSA PRIV', 'ATE KEY-----', chr(10), {hexed}, chr(10), "
        f"'-----E', 'ND RSA PRIV', 'ATE KEY-----'",
        f"'card ', {_pick(n, repr('4111 1111 1111 1111'), f'''concat('4', {_d(n, 9)}, {_d(n, 6, 1)})''', f'''concat('5500-00', {_d(n, 2)}, '-0000-', {_d(n, 4, 2)})''')}",
        f"'pay ', {_pick(n, repr('DE89 3704 0044 0532 0130 00'), f'''concat('DE', {_d(n, 9)}, {_d(n, 9, 1)}, {_d(n, 2, 2)})''', repr('GB82WEST12345698765432'), f'''concat('US', {_d(n, 9)}, {_d(n, 5, 1)})''')}",
        f"'postgres://svc:', {_d(n, 6)}, '@db', {_d(n, 2)}, '.internal:5432/app'",
        f"'AccountKey=', {hexed}, {hexed2}, '=='",
        f"'aws_secret_access_key = ', {hexed}, substr({hexed2}, 1, 8)",
        f"'Authorization: Bearer ', {hexed}",
        f"{_pick(n, repr('password='), repr('api_key: '), repr('token => '))}, "
        f"{_pick(n, f'''concat('Q', substr({hexed}, 1, 11), '!')''', repr('changeme'), f'''substr({hexed}, 1, 9)''', repr('wonderful'), '''concat('$', '{DB_PASS}')''')}",
        f"'routing number: ', {_pick(n, repr('021000021'), _d(n, 9))}",
        f"'account no: ', {_d(n, 8)}",
        f"'sort code: ', {_d(n, 2)}, '-', {_d(n, 2, 1)}, '-', {_d(n, 2, 2)}",
        f"'SWIFT: ', {_l(n)}, {_l(n, 1)}, 'UT', {_pick(n, repr('DE'), repr('US'), repr('ZZ'))}, 'FF'",
        f"'tax id ', {_d(n, 2)}, '-', {_d(n, 7, 1)}",
        f"'DOB: ', {_upto(n, 14)}, '/', {_upto(n, 33, 1)}, '/', {_pick(n, repr('1985'), repr('2150'), repr('07'))}",
        f"'born on March ', {_upto(n, 35)}, ', 19', {_d(n, 2)}",
        f"'date of birth 19', {_d(n, 2)}, '-', {_upto(n, 14)}, '-', {_upto(n, 33, 1)}",
        f"'passport no: ', {_pick(n, f'''concat('N', {_d(n, 7)})''', repr('attached'))}",
        f"'driver''s license no: D', {_d(n, 3)}, '-', {_d(n, 4, 1)}",
        f"'mrz ', chr(10), 'L89890', {_pick(n, repr('2'), repr('3'))}, 'C36UTO7408122F1204159ZE184226B<<<<<10', chr(10)",
        f"'vin 1HGCM826', {_d(n, 1)}, '3A004', {_d(n, 3, 1)}",
        f"'ITIN: 9', {_d(n, 2)}, '-', {_d(n, 2, 1)}, '-', {_d(n, 4, 2)}",
        f"'SIN: ', {_d(n, 3)}, ' ', {_d(n, 3, 1)}, ' ', {_d(n, 3, 2)}",
        f"'NHS number: ', {_d(n, 3)}, ' ', {_d(n, 3, 1)}, ' ', {_d(n, 4, 2)}",
        f"'national insurance no: ', {_l(n)}, {_l(n, 1)}, {_d(n, 6)}, {_pick(n, repr('A'), repr('c'), repr('E'))}",
        f"'TFN: ', {_d(n, 3)}, ' ', {_d(n, 3, 1)}, ' ', {_d(n, 3, 2)}",
        f"'aadhaar no: ', {_d(n, 4)}, ' ', {_d(n, 4, 1)}, ' ', {_d(n, 4, 2)}",
        f"'cf RSSMRA', {_d(n, 2)}, 'T', {_d(n, 2, 1)}, 'A', {_d(n, 3, 2)}, {_l(n)}",
        f"'dni ', {_pick(n, f'''concat({_d(n, 8)}, {_l(n)})''', f'''concat('X', {_d(n, 7)}, {_l(n)})''', repr('12345678Z'))}",
        f"'br ', {_pick(n, repr('111.444.777-35'), f'''concat({_d(n, 3)}, '.', {_d(n, 3, 1)}, '.', {_d(n, 3, 2)}, '-', {_d(n, 2, 3)})''', repr('111.111.111-11'))}",
        f"'cpf: ', {_pick(n, repr('52998224725'), f'''concat({_d(n, 9)}, {_d(n, 2, 1)})''')}",
        f"'PESEL: ', {_d(n, 9)}, {_d(n, 2, 1)}",
        f"'pnr ', {_d(n, 2)}, {_upto(n, 14)}, {_upto(n, 33, 1)}, '-', {_d(n, 4, 1)}",
        f"'bsn: ', {_d(n, 9)}",
        f"'nir: ', {nir}, {_pick(n, f'''lpad(concat('', 97 - {nir} % 97), 2, '0')''', repr('13'))}",
        f"'Steuer-ID: ', {_d(n, 9)}, {_d(n, 2, 1)}",
        f"'rid 1101051949', {_upto(n, 14)}, {_upto(n, 33, 1)}, {_d(n, 3)}, {_pick(n, repr('X'), _d(n, 1, 1))}",
        f"'MRN: ', {_d(n, 8)}",
        f"'NPI: ', {_d(n, 9)}, {_d(n, 1, 1)}",
        f"'DEA: B', {_l(n)}, {_d(n, 7)}",
        f"'MBI: 1', {_l(n)}, 'G4T', {_l(n, 1)}, '5MK73'",
        f"'member ID: XR4-', {_d(n, 3)}, '-', {_d(n, 3, 1)}",
        f"'Case No. 4:22-cv-', {_d(n, 5)}, '-KAW'",
        f"'see 1:21-cr-', {_d(n, 5)}",
        f"'wallet ', {_pick(n, repr('1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa'), repr('1A1zP1eP5QGefi2DMPTfTL5SLmv7Divfff'), f'''concat('0x', {hexed}, substr({hexed2}, 1, 8))''', repr('bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq'))}",
        f"'jwt ey', 'J', {hexed}, '.', {hexed2}, '.', {hexed}",
        f"'mac ', substr({hexed}, 1, 2), ':', substr({hexed}, 3, 2), ':', substr({hexed}, 5, 2), ':', "
        f"substr({hexed}, 7, 2), ':', substr({hexed}, 9, 2), ':', substr({hexed}, 11, 2)",
        f"'v6 2001:db8:', {_pick(n, repr(':'), repr('1:2:3:4:5:'), repr('::'))}, {_d(n, 3)}",
        f"'mail user', {n} % 500, '@example', {n} % 3, '.com'",
        f"'call (415) 555-', {_d(n, 4)}",
        f"'ssn is ', {_d(n, 3)}, '-', {_d(n, 2, 1)}, '-', {_d(n, 4, 2)}",
        f"'host ', {n} % 300, '.0.', {n} % 7, '.', {_d(n, 2)}",
        f"'key gh', 'p_', {hexed}",
        f"'site https://example.com/p/', {n}, '?q=1)'",
        f"'visit ', {n} % 900 + 1, ' Oak Hill Street'",
        f"'owes $', {n} % 99 + 1, ',', {_d(n, 3)}, '.50'",
        f"'badge EMP-', {_d(n, 5)}",
        "'nothing sensitive here, just Project Helios at Halcyon Labs'",
    ]


N_TEMPLATES = len(_templates("0"))
SPARK, DUCKDB = "spark", "duckdb"
_STEP = 8


def lines_sql(dialect: str, separator: str, *pairs: tuple[str, str]) -> str:
    """Lines for (k, n) pairs, joined: line `k` modulo the number of lines, values made from `n`."""
    whens = [f"WHEN {i} THEN concat({t})" for i, t in enumerate(_templates("x.n"))]
    if dialect == SPARK:
        # Inside a lambda Spark tries one branch after the other and computes the remainder anew for each, so
        # the remainder is taken once and the branches are tried in two steps.
        parts = [(at, f"CASE x.k {' '.join(whens[at:at + _STEP])} END") for at in range(0, N_TEMPLATES, _STEP)]
        steps = " ".join(f"WHEN x.k < {at + _STEP} THEN {part}" for at, part in parts)
        items = ", ".join(f"named_struct('k', ({k}) % {N_TEMPLATES}, 'n', {n})" for k, n in pairs)
        return f"array_join(transform(array({items}), x -> CASE {steps} END), '{separator}')"
    case = f"CASE x.k % {N_TEMPLATES} {' '.join(whens)} END"
    items = ", ".join(f"{{'k': {k}, 'n': {n}}}" for k, n in pairs)
    return f"array_to_string(list_transform([{items}], lambda x: {case}), '{separator}')"


def notes_sql(dialect: str) -> str:
    lines = lines_sql(
        dialect, ". Then ", ("o_orderkey", "o_orderkey + 3"),
        ("o_orderkey * 5 + 11", "o_orderkey * 3 + 1"), ("o_orderkey * 3 + 29", "o_custkey + 7"))
    return f"""
SELECT concat('note-', o_orderkey) AS doc_id,
       concat('Order ', o_orderkey, ': ', {lines}, chr(10), 'ref ', o_orderkey) AS text
FROM orders"""


def texts_sql(dialect: str) -> str:
    return f"""
SELECT concat('doc-', doc_id) AS doc_id, text FROM documents
UNION ALL SELECT concat('page-', page_id) AS doc_id, html AS text FROM pages
UNION ALL {notes_sql(dialect)}"""


def turns_sql(dialect: str) -> str:
    lines = lines_sql(
        dialect, " and ", ("conv_id * 7 + (turn % 3) * 5", "conv_id * 10 + turn % 3"),
        ("conv_id + turn * 11", "conv_id * 3 + turn % 2"))
    return f"""
SELECT concat('c', conv_id) AS conv_id, turn, concat('m', conv_id, '-', turn) AS msg_id, role,
       concat(text, chr(10), {lines}, ' cc user', turn % 4, '@example0.com') AS text
FROM conversations"""


#: Parts of a dealt table for each core of a cluster.
_PARTS = 4


def over_cores(df: DataFrame) -> DataFrame:
    """Deal the rows over the cores: however large the table, its files may have few row groups, and one task reads each.

    What follows takes far longer for a row than reading and sending it.
    """
    context = df.sparkSession.sparkContext
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    return df.repartition(context.defaultParallelism * (1 if local else _PARTS))


def load_dealt(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """As `load`, with the rows dealt over the cores before anything is made from them."""
    for table in tables:
        over_cores(spark.read.parquet(f"{sf_dir}/{table}.parquet")).createOrReplaceTempView(table)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, raw pages and order notes: (doc_id, text)."""
    load_dealt(spark, sf_dir, "documents", "pages", "orders")
    return spark.sql(texts_sql(SPARK))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: (conv_id, turn, msg_id, role, text)."""
    load_dealt(spark, sf_dir, "conversations")
    return spark.sql(turns_sql(SPARK))
