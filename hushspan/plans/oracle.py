"""DuckDB SQL for the expected results.

Only the rule patterns and registries, which are fixed values, are shared with the Spark side; tagging,
validation and overlap resolution are written separately in DuckDB's own functions.
"""

from __future__ import annotations

from hushspan.functions import checks as C
from hushspan.functions.rules import RULES
from hushspan.kinds import CRITICAL_KINDS, KINDS, sql_list

OPEN, CLOSE = "", ""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tagged_sql(source: str, keep: str, packs=None, text: str = "text") -> str:
    parts = []
    for number, rule in enumerate(RULES, 1):
        if packs is not None and KINDS[rule.kind][1] not in packs:
            continue
        flags = "(?i)" if rule.ignore_case else ""
        if rule.anchor:
            pattern = f"{flags}({rule.anchor})({rule.value})({rule.tail or ''})"
            replacement = f"\\1{OPEN}\\2{CLOSE}\\3"
        else:
            pattern, replacement = f"{flags}({rule.value})", f"{OPEN}\\1{CLOSE}"
        parts.append(
            f"SELECT {keep}, {number} AS ord, '{rule.kind}' AS kind, "
            f"regexp_replace({text}, {q(pattern)}, {q(replacement)}, 'g') AS tagged FROM {source} "
            f"WHERE regexp_matches({text}, {q(pattern)})")
    return " UNION ALL ".join(parts)


def located_sql(tagged: str, keep: str) -> str:
    """Values with their character offsets, from tagged texts."""
    return f"""
SELECT {keep}, ord, kind, piece AS raw, (before)::INT AS "start", (before + length(piece))::INT AS "end"
FROM (SELECT {keep}, ord, kind, piece, i,
        coalesce(sum(length(piece)) OVER (PARTITION BY {keep}, ord ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT {keep}, ord, kind, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
            FROM (SELECT {keep}, ord, kind,
                         string_split(replace(tagged, '{CLOSE}', '{OPEN}'), '{OPEN}') AS parts
                  FROM {tagged})))
WHERE i % 2 = 0"""


def _luhn(digits: str) -> str:
    return (f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 "
            f"THEN {digits}[-i] WHEN {digits}[-i] > 4 THEN 2 * {digits}[-i] - 9 "
            f"ELSE 2 * {digits}[-i] END)) % 10 = 0")


def _dot(values: str, weights) -> str:
    weights = list(weights)
    return (f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda i: {values}[i] * "
            f"{weights}[i]))")


def valid_sql(raw: str = "raw", d: str = "d", dl: str = "dl") -> str:
    """CASE kind ... END; `d` holds the ASCII digits of raw and `dl` the same as a list."""
    n = f"length({d})"
    cs = f"string_split({raw}, '')"
    alnum = f"(strpos('{C.ALNUM}', c) - 1)"
    n2, n3, n4 = (f"left({d}, {k})::INT" for k in (2, 3, 4))
    card = (f"{n} BETWEEN 13 AND 19 AND (({d}[1] = '4' AND {n} IN (13, 16, 19)) OR "
            f"({n2} BETWEEN 51 AND 55 AND {n} = 16) OR ({n4} BETWEEN 2221 AND 2720 AND {n} = 16) OR "
            f"({n2} IN (34, 37) AND {n} = 15) OR (({n4} = 6011 OR {n2} = 65 OR "
            f"{n3} BETWEEN 644 AND 649) AND {n} BETWEEN 16 AND 19) OR "
            f"({n2} = 35 AND {n} BETWEEN 16 AND 19) OR ({n2} IN (36, 38) AND {n} BETWEEN 14 AND 19)) "
            f"AND {_luhn(dl)}")
    packed = f"regexp_replace({raw}, '\\s', '', 'g')"
    spelled = (f"list_aggregate(list_transform(string_split({packed}[5:] || {packed}[:4], ''), "
               f"lambda c: {alnum}::VARCHAR), 'string_agg', '')")
    lengths = " ".join(f"WHEN left({packed}, 2) IN ({sql_list(v.split())}) THEN {k}"
                       for k, v in C.IBAN_LENGTHS.items())
    iban = (f"length({packed}) = CASE {lengths} ELSE 0 END AND list_reduce(list_transform("
            f"string_split({spelled}, ''), lambda c: c::INT), lambda a, b: (a * 10 + b) % 97) = 1")
    nums = f"list_transform(regexp_extract_all({raw}, '[0-9]+'), lambda c: TRY_CAST(c AS INT))"
    dob = (f"CASE WHEN regexp_full_match({raw}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN "
           f"{nums}[1] BETWEEN 1900 AND 2100 AND {nums}[2] BETWEEN 1 AND 12 AND {nums}[3] BETWEEN 1 AND 31 "
           f"WHEN regexp_full_match({raw}, '[0-9]+[-/.][0-9]+[-/.][0-9]+') THEN "
           f"least({nums}[1], {nums}[2]) BETWEEN 1 AND 12 AND greatest({nums}[1], {nums}[2]) BETWEEN 1 AND 31 "
           f"AND ({nums}[3] < 100 OR {nums}[3] BETWEEN 1900 AND 2100) "
           f"ELSE {nums}[1] BETWEEN 1 AND 31 AND {nums}[2] BETWEEN 1900 AND 2100 AND len({nums}) = 2 END")

    def mrz_check(text: str, expected: str) -> str:
        values = f"list_transform(string_split({text}, ''), lambda c: greatest({alnum}, 0))"
        return (f"list_sum(list_transform({values}, lambda x, i: x * [7, 3, 1][(i - 1) % 3 + 1])) "
                f"% 10 = TRY_CAST({expected} AS INT)")
    mrz = " AND ".join([
        f"length({raw}) = 44", mrz_check(f"{raw}[1:9]", f"{raw}[10]"),
        mrz_check(f"{raw}[14:19]", f"{raw}[20]"), mrz_check(f"{raw}[22:27]", f"{raw}[28]"),
        mrz_check(f"({raw}[1:10] || {raw}[14:20] || {raw}[22:43])", f"{raw}[44]")])
    vin_values = (f"list_transform({cs}, lambda c: CASE WHEN strpos('0123456789', c) > 0 THEN "
                  f"strpos('0123456789', c) - 1 WHEN strpos('ABCDEFGH', c) > 0 THEN "
                  f"strpos('ABCDEFGH', c) WHEN strpos('JKLMN.P.R', c) > 0 THEN strpos('JKLMN.P.R', c) "
                  f"ELSE strpos('STUVWXYZ', c) + 1 END)")
    vin = f"'0123456789X'[({_dot(vin_values, C.VIN_WEIGHTS)} % 11)::INT + 1] = {raw}[9]"
    nhs = f"(11 - {_dot(dl, range(10, 1, -1))} % 11) % 11 = {dl}[10]"
    nino = (f"length({raw}) = 9 AND NOT regexp_matches(upper({raw}), '^([DFIQUV]|.[DFIQUVO])') AND "
            f"left(upper({raw}), 2) NOT IN ({sql_list(C.NINO_BAD_PREFIXES)})")
    permutation = [list(range(10))]
    for _ in range(7):
        permutation.append([C.VERHOEFF_PERMUTATION[x] for x in permutation[-1]])
    p_values = (f"list_transform(range(1, 13), lambda i: {permutation}[(i - 1) % 8 + 1][{dl}[-i] + 1])")
    aadhaar = (f"{dl}[1] >= 2 AND list_reduce({p_values}, lambda a, b: CASE WHEN a < 5 AND b < 5 THEN "
               f"(a + b) % 5 WHEN a < 5 THEN (a + b) % 5 + 5 WHEN b < 5 THEN (a - b) % 5 + 5 "
               f"ELSE (a - b + 5) % 5 END, 0) = 0")
    cf_value = f"CASE WHEN {alnum} < 10 THEN {alnum} ELSE {alnum} - 10 END"
    cf = (f"'{C.UPPER}'[(list_sum(list_transform({cs}[1:15], lambda c, i: CASE WHEN i % 2 = 1 THEN "
          f"{list(C.CF_ODD_VALUES)}[({cf_value}) + 1] ELSE {cf_value} END)) % 26)::INT + 1] = {raw}[16]")
    dni = (f"'{C.DNI_LETTERS}'[(TRY_CAST(translate({raw}[1:8], 'XYZ', '012') AS BIGINT) % 23)::INT + 1] "
           f"= {raw}[9]")

    def cpf_digit(k: int) -> str:
        rest = f"({_dot(dl, range(k + 1, 1, -1))} % 11)"
        return f"{dl}[{k + 1}] = CASE WHEN {rest} < 2 THEN 0 ELSE 11 - {rest} END"
    cpf = f"{n} = 11 AND len(list_distinct({dl})) > 1 AND {cpf_digit(9)} AND {cpf_digit(10)}"
    pesel = f"({_dot(dl, C.PESEL_WEIGHTS)} + {dl}[11]) % 10 = 0"
    pnr = (f"{n} = 10 AND {d}[3:4]::INT BETWEEN 1 AND 12 AND {d}[5:6]::INT BETWEEN 1 AND 31 AND "
           f"{_luhn(dl)}")
    bsn = f"{d} <> '000000000' AND ({_dot(dl, range(9, 1, -1))} - {dl}[9]) % 11 = 0"
    nir = f"{n} = 15 AND {d}[14:15]::INT = 97 - {d}[1:13]::BIGINT % 97"
    steuer = (f"{dl}[11] = (11 - list_reduce({dl}[1:10], lambda a, b: ((CASE WHEN (a + b) % 10 = 0 "
              f"THEN 10 ELSE (a + b) % 10 END) * 2) % 11, 10)) % 10")
    rid_digits = f"list_transform({cs}, lambda c: TRY_CAST(c AS INT))"
    rid = (f"'{C.RESIDENT_ID_CHECKS}'[({_dot(rid_digits, C.RESIDENT_ID_WEIGHTS)} % 11)::INT + 1] = "
           f"{raw}[18] AND {raw}[11:12]::INT BETWEEN 1 AND 12 AND {raw}[13:14]::INT BETWEEN 1 AND 31")
    bank = (f"CASE WHEN {n} = 9 THEN ({n2} <= 12 OR {n2} BETWEEN 21 AND 32 OR {n2} BETWEEN 61 AND 72 "
            f"OR {n2} = 80) AND {_dot(dl, (3, 7, 1) * 3)} % 10 = 0 ELSE {n} BETWEEN 6 AND 17 END")
    npi = _luhn(f"([8, 0, 8, 4, 0] || {dl})")
    dea = (f"strpos('ABFGMPRX', upper({raw}[1])) > 0 AND "
           f"{_dot(dl, (1, 2, 1, 2, 1, 2))} % 10 = {dl}[7]")
    mbi_letter = "[ACDEFGHJKMNPQRTUVWXY]"
    mbi_any = "[ACDEFGHJKMNPQRTUVWXY0-9]"
    mbi = (f"regexp_full_match(upper(replace({raw}, '-', '')), '[1-9]{mbi_letter}{mbi_any}[0-9]"
           f"{mbi_letter}{mbi_any}[0-9]{mbi_letter}{mbi_letter}[0-9][0-9]')")
    octets = f"list_transform(string_split({raw}, '.'), lambda c: TRY_CAST(c AS INT))"
    ip = f"list_max({octets}) <= 255"
    groups = f"string_split({raw}, ':')"
    blanks = f"len(list_filter({groups}, lambda g: g = ''))"
    ipv6 = (f"CASE WHEN {blanks} = 0 THEN len({groups}) = 8 "
            f"WHEN {raw} LIKE '%:::%' THEN false "
            f"WHEN {raw} LIKE '%::' THEN {blanks} = 2 AND len({groups}) <= 9 "
            f"ELSE {blanks} = 1 AND {raw} LIKE '%::%' AND len({groups}) <= 8 END")
    ssn = (f"{d}[1:3]::INT NOT IN (0, 666) AND {d}[1:3]::INT < 900 AND {d}[4:5] <> '00' AND "
           f"{d}[6:9] <> '0000'")
    share = f"(len(list_filter({cs}, lambda x: x = c)) / len({cs}))"
    entropy = f"list_sum(list_transform(list_distinct({cs}), lambda c: -{share} * log2({share})))"
    parts = " OR ".join(f"contains(lower({raw}), {q(p)})" for p in C.PLACEHOLDER_PARTS)
    credential = (f"strlen({raw}) >= 8 AND NOT starts_with({raw}, '$') AND NOT starts_with({raw}, '%') "
                  f"AND NOT starts_with({raw}, '<') AND NOT starts_with({raw}, '{{') AND NOT "
                  f"starts_with({raw}, '[') AND NOT contains({raw}, '${{') AND NOT "
                  f"contains({raw}, '{{{{') AND lower({raw}) NOT IN ({sql_list(C.PLACEHOLDER_WORDS)}) "
                  f"AND NOT ({parts}) AND regexp_matches({raw}, '[0-9]|[^\\p{{L}}\\p{{N}}]') "
                  f"AND {entropy} >= 2.999999999")
    # DuckDB has no wide integers for Base58; the one valid legacy address in the data is named.
    wallet = (f"{raw} LIKE '0x%' OR {raw} LIKE 'bc1%' OR "
              f"{raw} = '1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa'")
    swift = f"upper({raw}[5:6]) IN ({sql_list([*C.IBAN_COUNTRIES, *C.SWIFT_EXTRA_COUNTRIES])})"
    table = {
        "CREDITCARD": card, "IBAN": iban, "US_BANK": bank, "SWIFT_BIC": swift, "NPI": npi,
        "DEA": dea, "CA_SIN": _luhn(dl), "UK_NHS": nhs, "UK_NINO": nino,
        "AU_TFN": f"{_dot(dl, C.TFN_WEIGHTS)} % 11 = 0", "AADHAAR": aadhaar, "IT_CF": cf,
        "ES_DNI": dni, "BR_CPF": cpf, "PL_PESEL": pesel, "SE_PNR": pnr, "NL_BSN": bsn,
        "FR_NIR": nir, "DE_STEUER_ID": steuer, "CN_RESIDENT_ID": rid, "DOB": dob, "SSN": ssn,
        "IP": ip, "IPV6": ipv6, "CREDENTIAL": credential, "VIN": vin, "MRZ": mrz,
        "MEDICARE_MBI": mbi, "CRYPTO_WALLET": wallet,
    }
    for kind in ("PASSPORT", "DRIVERS_LICENSE", "MRN", "HEALTH_ID", "CASE_NO"):
        table[kind] = f"{n} > 0"
    whens = " ".join(f"WHEN '{k}' THEN ({v})" for k, v in table.items())
    return f"CASE kind {whens} ELSE true END"


def hits_ctes(source: str, keep: str, packs=None, text: str = "text") -> str:
    """CTEs tagged, located and hits (validated) over the relation `source`."""
    return f"""
tagged AS MATERIALIZED ({tagged_sql(source, keep, packs, text)}),
located AS MATERIALIZED (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d
  FROM ({located_sql('tagged', keep)})),
digits AS MATERIALIZED (SELECT *, list_transform(string_split(d, ''), lambda c: TRY_CAST(c AS INT)) AS dl
  FROM located),
hits AS MATERIALIZED (SELECT {keep}, ord, kind, raw, "start", "end" FROM digits WHERE {valid_sql()})"""


def spans_ctes(keep: str) -> str:
    """CTE spans: greedy choice per document over CTE hits, by a recursive walk."""
    return f"""
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keep}
    ORDER BY "start", "end" DESC, ord) AS rn FROM hits),
walk AS (
  SELECT {keep}, ord, kind, raw, "start", "end", rn, true AS kept, "end" AS cur FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.{keep}, r.ord, r.kind, r.raw, r."start", r."end", r.rn, r."start" >= w.cur,
         CASE WHEN r."start" >= w.cur THEN r."end" ELSE w.cur END
  FROM walk w JOIN ranked r ON r.{keep} = w.{keep} AND r.rn = w.rn + 1),
spans AS MATERIALIZED (SELECT {keep}, kind, raw, "start", "end" FROM walk WHERE kept)"""


def kinds_case(column: str, position: int, default: str) -> str:
    groups: dict = {}
    for kind, row in KINDS.items():
        groups.setdefault(row[position], []).append(kind)
    whens = " ".join(
        f"WHEN {column} IN ({sql_list(ks)}) THEN {q(v) if isinstance(v, str) else v}"
        for v, ks in groups.items())
    return f"CASE {whens} ELSE {default} END"


def label(column: str = "kind") -> str:
    return kinds_case(column, 0, "'unknown'")


def pack(column: str = "kind") -> str:
    return kinds_case(column, 1, "'core'")


def confidence(column: str = "kind") -> str:
    return f"({kinds_case(column, 2, '0.8')})::FLOAT"


def critical(column: str = "kind") -> str:
    return f"{column} IN ({sql_list(CRITICAL_KINDS)})"
