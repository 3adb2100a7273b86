"""Column-aware detection: header names say what the cells below them hold."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.functions import arrays as A
from hushspan.functions.checks import is_valid
from hushspan.kinds import CRITICAL_KINDS, SPAN_TYPE, SPANS_TYPE, sql_list
from hushspan.operators.scan import computed

# ---- Fixed values: header names, first match wins.  kind, whole words, parts ---------------------
HEADERS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("SSN", "ssn", ("social security",)),
    ("CREDITCARD", "pan cc", ("credit card", "card number")),
    ("IBAN", "iban", ()),
    ("US_BANK", "routing aba", ()),
    ("US_BANK", "acct", ("account number",)),
    ("SWIFT_BIC", "swift bic", ()),
    ("EIN", "ein", ()),
    ("US_ITIN", "itin", ()),
    ("CA_SIN", "sin", ()),
    ("UK_NHS", "nhs", ()),
    ("UK_NINO", "nino", ("national insurance",)),
    ("AU_TFN", "tfn", ()),
    ("AADHAAR", "aadhaar aadhar", ()),
    ("MEDICARE_MBI", "mbi", ("medicare",)),
    ("NPI", "npi", ()),
    ("DEA", "dea", ()),
    ("MRN", "mrn", ("medical record",)),
    ("HEALTH_ID", "", ("member id", "subscriber", "policy number")),
    ("VIN", "vin", ()),
    ("PASSPORT", "passport", ()),
    ("DRIVERS_LICENSE", "dl", ("driver", "licen")),
    ("DOB", "dob", ("birth",)),
    ("EMAIL", "email mail", ()),
    ("PHONE", "phone mobile cell tel fax", ()),
    ("IP", "ip", ("ip address",)),
    ("MAC_ADDRESS", "mac", ()),
    ("CRYPTO_WALLET", "wallet btc eth", ()),
    ("ADDRESS", "street", ("address",)),
    ("MONEY", "salary income wage", ("compensation",)),
    ("NAME", "name firstname lastname surname fullname", ()),
    ("CASE_NO", "docket", ("case number",)),
    ("CREDENTIAL", "password secret token apikey", ("api key",)),
)
EMPTY_MARKERS = ("null", "none", "n/a", "na", "nil", "-", "--", "unknown", "tbd")
DELIMITERS = (",", "\t", ";", "|")
CELL_CONFIDENCE = 0.9
# ---- end of the fixed values ---------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEYWORDS = "|".join(sorted(
    {w for _, words, _ in HEADERS for w in words.split()}
    | {p.replace(" ", ".") for _, _, parts in HEADERS for p in parts}))
def _block(delim: str) -> str:
    """Two lines that a block may start with: a header's first and last cell, of 1 to 40 characters and
    white space around them, a known name as a word of its own, and the same delimiter in the line below."""
    words = "|".join(sorted({w for _, words, _ in HEADERS for w in words.split()}))
    parts = "|".join(sorted({p.replace(" ", ".") for _, _, parts in HEADERS for p in parts}))
    other, blank = rf"[^\n{delim}]", rf"[\p{{IsWhite_Space}}&&[^\n{delim}]]"
    return (rf"(?mid)^(?={blank}*+{other}{{1,40}}{blank}*{delim}[^\n]*?\n{other}*+{delim})"
            rf"(?=[^\n]*?(?:(?<![a-z0-9])(?:{words})(?![a-z0-9])|{parts}))"
            rf"[^\n]*{delim}{blank}*+{other}{{1,40}}{blank}*\n")


#: What every block starts with and few other texts hold; a line is read a bounded number of times.
_BLOCKS = tuple(map(_block, (",", r"\t", ";", r"\|")))
_CHECKED = {kind for kind, _, _ in HEADERS if kind in CRITICAL_KINDS}


def _trim(text: str) -> str:
    return f"regexp_replace({text}, {A.lit(r'(?U)^\s+|\s+\z')}, '')"


def header_kind_sql(header: str) -> str:
    """Kind of the column a header names, or NULL."""
    plain = f"regexp_replace(translate({_trim(header)}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]', ' ')"

    def pick(h: str) -> str:
        whens = []
        for kind, words, parts in HEADERS:
            tests = [f"contains({h}, ' {w} ')" for w in words.split()]
            tests += [f"contains({h}, '{p}')" for p in parts]
            whens.append(f"WHEN {' OR '.join(tests)} THEN '{kind}'")
        return f"CASE {' '.join(whens)} ELSE cast(NULL as string) END"
    return A.let(f"concat(' ', {plain}, ' ')", pick)


def cell_is_empty_sql(cell: str) -> str:
    return f"(lower({_trim(cell)}) IN ('', {sql_list(EMPTY_MARKERS)}))"


def cell_kind_sql(kind: str, cell: str) -> str:
    """A blocking kind needs a valid value; an invalid one is still sensitive, but as CUSTOM."""
    valid = is_valid(kind, cell, _CHECKED)
    return (f"CASE WHEN {kind} NOT IN ({sql_list(sorted(_CHECKED))}) THEN {kind} "
            f"WHEN {valid} THEN {kind} ELSE 'CUSTOM' END")


def _header_sql(line: str) -> str:
    """The line read as a header: struct(delim, n, kinds); delim is '' when it is none."""
    none = "named_struct('delim', '', 'n', 0, 'kinds', cast(array() as array<string>))"

    def read(delim: str) -> str:
        d = A.lit(delim)
        cells, c, k = A.name("cells"), A.name("c"), A.name("k")
        plausible = (f"forall({cells}, {c} -> {_trim(c)} <> '' AND octet_length({_trim(c)}) <= 40 "
                     f"AND NOT contains({c}, '@'))")
        kinds = f"transform({cells}, {c} -> {header_kind_sql(c)})"
        with_kinds = A.let(kinds, lambda ks: (
            f"if(exists({ks}, {k} -> {k} IS NOT NULL), named_struct('delim', {d}, 'n', size({ks}),"
            f" 'kinds', {ks}), NULL)"))
        split = f"split({line}, {A.lit('[' + delim + ']')})"
        return (f"CASE WHEN contains({line}, {d}) THEN get(transform(array({split}), {cells} -> "
                f"if({plausible}, {with_kinds}, NULL)), 0) END")
    choice = ", ".join(read(d) for d in DELIMITERS)
    return f"if({line} rlike '(?i){_KEYWORDS}', coalesce({choice}, {none}), {none})"


def structured_sql(text: str) -> str:
    """Spans of all mapped cells of every tabular block in the text, as array<SPAN_TYPE>."""
    row_type = "struct<off:int,line:string,delim:string,kinds:array<string>>"
    cell_type = "struct<at:int,cell:string,kind:string>"

    def line_step(st: str, line: str) -> tuple[str, str]:
        same_shape = (f"({st}.h.delim <> '' AND length({line}) - "
                      f"length(replace({line}, {st}.h.delim, '')) + 1 = {st}.h.n"
                      f" AND {_trim(line)} <> '')")
        row = (f"named_struct('off', {st}.off, 'line', {line}, 'delim', {st}.h.delim,"
               f" 'kinds', {st}.h.kinds)")
        return (f"named_struct('off', {st}.off + length({line}) + 1,"
                f" 'h', if({same_shape}, {st}.h, {_header_sql(line)}))",
                f"if({same_shape}, array({row}), cast(array() as array<{row_type}>))")

    def cell_step(row: str):
        def step(st: str, cell: str) -> tuple[str, str]:
            kind = f"get({row}.kinds, {st}.col)"
            found = f"named_struct('at', {st}.at, 'cell', {cell}, 'kind', {kind})"
            return (f"named_struct('at', {st}.at + length({cell}) + 1, 'col', {st}.col + 1)",
                    f"if({kind} IS NULL, cast(array() as array<{cell_type}>), array({found}))")
        return step

    start = ("named_struct('off', 0, 'h', named_struct('delim', '', 'n', 0,"
             " 'kinds', cast(array() as array<string>)))")
    rows = A.running(f"split({text}, {A.lit(chr(10))})", start, line_step, row_type)
    row, cell, s = A.name("r"), A.name("c"), A.name("s")
    cells = A.running(f"split({row}.line, concat('[', {row}.delim, ']'))",
                      f"named_struct('at', {row}.off, 'col', 0)", cell_step(row), cell_type)
    mapped = f"flatten(transform({rows}, {row} -> {cells}))"
    lead = f"length(regexp_extract({cell}.cell, {A.lit(r'(?U)^\s*')}, 0))"
    trimmed = _trim(f"{cell}.cell")
    span = (f"named_struct('start', {cell}.at + {lead}, 'end', {cell}.at + {lead} + length({trimmed}),"
            f" 'kind', {cell_kind_sql(f'{cell}.kind', trimmed)}, 'raw', {trimmed}, 'alias', '',"
            f" 'confidence', cast({CELL_CONFIDENCE} as float))")
    wanted = f"filter({mapped}, {s} -> NOT {cell_is_empty_sql(f'{s}.cell')})"
    result = f"transform({wanted}, {cell} -> {span})"
    gate = f"contains({text}, {A.lit(chr(10))}) AND (" + " OR ".join(
        f"contains({text}, {A.lit(d)}) AND {text} rlike {A.lit(p)}" for d, p in zip(DELIMITERS, _BLOCKS)) + ")"
    return f"if({gate}, {result}, cast(array() as {SPANS_TYPE}))"


def detect_structured(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add the spans of tabular blocks inside a text, of any length.  One narrow pass."""
    return computed(df, out, f"coalesce({structured_sql(text)}, cast(array() as {SPANS_TYPE}))")


def classify_columns(df: DataFrame, header: str = "header", out: str = "kind") -> DataFrame:
    """Add the kind each header text stands for (NULL when it is not a sensitive column)."""
    return df.withColumn(out, F.expr(header_kind_sql(header)))


def header_kind(header: str) -> str | None:
    """Kind of one header in plain Python, for the few column names of a table."""
    plain = re.sub("[^a-z0-9]", " ", header.strip().translate(str.maketrans(_UPPER, _LOWER)))
    for kind, words, parts in HEADERS:
        if set(words.split()) & set(plain.split(" ")) or any(p in f" {plain} " for p in parts):
            return kind
    return None


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Kinds of a DataFrame's own columns; reads the schema only and runs no job."""
    return {c: kind for c in df.columns if (kind := header_kind(c))}


def scan_table_columns(df: DataFrame, *ids: str) -> DataFrame:
    """Sensitive cells of a real table: ids, column_name, kind, raw, confidence.

    Only the mapped columns are read; the unpivot and the checks are one narrow pass.
    """
    kinds = {c: k for c, k in column_kinds(df).items() if c not in ids}
    if not kinds:
        return df.select(*ids, F.lit("").alias("column_name"), F.lit("").alias("kind"),
                         F.lit("").alias("raw"), F.lit(0.9).cast("float").alias("confidence")).limit(0)
    pairs = ", ".join(f"'{c}', '{k}', cast(`{c}` as string)" for c, k in kinds.items())
    cells = df.select(*ids, F.expr(f"stack({len(kinds)}, {pairs}) as (column_name, hint, cell)"))
    return (cells.filter(F.col("cell").isNotNull())
            .filter(~F.expr(cell_is_empty_sql("cell")))
            .select(*ids, "column_name", F.expr(cell_kind_sql("hint", _trim("cell"))).alias("kind"),
                    F.expr(_trim("cell")).alias("raw"),
                    F.lit(CELL_CONFIDENCE).cast("float").alias("confidence")))
