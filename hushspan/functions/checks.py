"""Validators as Spark SQL expressions over one string expression."""

from __future__ import annotations

from collections.abc import Callable

from hushspan.functions.arrays import chars, let, lit, name
from hushspan.kinds import sql_list

# ---- Fixed values: registries and weights ------------------------------------------------------
IBAN_LENGTHS: dict[int, str] = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO",
    24: "AD CZ ES MD PK RO SA SE SK VG TN", 25: "EG PT LY ST", 26: "IS TR",
    27: "FR GR IT MC MR SM BI DJ", 28: "AL AZ BY CY DO GT HU LB PL SV NI", 29: "BR PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
SWIFT_EXTRA_COUNTRIES = (
    "US CA AU NZ JP CN HK SG IN KR TW TH MY ID PH VN ZA NG KE GH MA MX AR CL CO PE UY PA EC BO "
    "PY VE AM UZ TJ KG NP BD LK MM KH LA BN MO FJ").split()
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
RESIDENT_ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
RESIDENT_ID_CHECKS = "10X98765432"
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CF_ODD_VALUES = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22,
                 25, 24, 23)
NINO_BAD_PREFIXES = "BG GB NK KN TN NT ZZ".split()
PLACEHOLDER_WORDS = ("true", "false", "null", "none", "nil", "undefined")
PLACEHOLDER_PARTS = (
    "password", "passwd", "passphrase", "changeme", "change-me", "change_me", "example", "sample",
    "dummy", "placeholder", "redacted", "secret", "your-", "your_", "xxxx", "****", "1234567",
    "abcdefg", "qwerty")
VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# ---- end of the fixed values -------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IBAN_COUNTRIES = " ".join(IBAN_LENGTHS.values()).split()


def _digits(raw: str) -> str:
    return f"regexp_replace({raw}, '[^0-9]', '')"


def _int(text: str, start: int | str, length: int = 1) -> str:
    return f"cast(substr({text}, {start}, {length}) as int)"


def _ascii_lower(raw: str) -> str:
    return f"translate({raw}, '{UPPER}', '{LOWER}')"


def _ascii_upper(raw: str) -> str:
    return f"translate({raw}, '{LOWER}', '{UPPER}')"


def _weighted(value_at: Callable[[str], str], weights) -> str:
    """Sum of weight(i) * value_at(i) over positions 1..n."""
    table = ",".join(str(w) for w in weights)
    acc, i = name("a"), name("i")
    return (f"aggregate(sequence(1, {len(weights)}), 0, ({acc}, {i}) -> {acc} + "
            f"{value_at(i)} * element_at(array({table}), {i}))")


def _luhn(d: str) -> str:
    """Every second digit from the right is doubled, with its digits added up."""
    acc, i = name("a"), name("i")
    digit = _int(d, f"-{i}")
    return (f"aggregate(sequence(1, length({d})), 0, ({acc}, {i}) -> {acc} + if({i} % 2 = 0, "
            f"cast(substr('0246813579', {digit} + 1, 1) as int), {digit})) % 10 = 0")


def _on_digits(raw: str, count: int, test: Callable[[str], str]) -> str:
    return let(_digits(raw), lambda d: f"if(length({d}) = {count}, {test(d)}, false)")


def credit_card(raw: str) -> str:
    def test(d: str) -> str:
        n1, n2, n3, n4 = (_int(d, 1, k) for k in (1, 2, 3, 4))
        size = f"length({d})"
        brand = (
            f"({n1} = 4 AND {size} IN (13, 16, 19)) OR ({n2} BETWEEN 51 AND 55 AND {size} = 16)"
            f" OR ({n4} BETWEEN 2221 AND 2720 AND {size} = 16) OR ({n2} IN (34, 37) AND {size} = 15)"
            f" OR (({n4} = 6011 OR {n2} = 65 OR {n3} BETWEEN 644 AND 649)"
            f" AND {size} BETWEEN 16 AND 19)"
            f" OR ({n2} = 35 AND {size} BETWEEN 16 AND 19)"
            f" OR ({n2} IN (36, 38) AND {size} BETWEEN 14 AND 19)")
        return f"if({size} BETWEEN 13 AND 19, ({brand}) AND {_luhn(d)}, false)"
    return let(_digits(raw), test)


def iban(raw: str) -> str:
    def test(s: str) -> str:
        acc, c = name("a"), name("c")
        value = f"instr('{ALNUM}', {c}) - 1"
        rotated = f"concat(substr({s}, 5), substr({s}, 1, 4))"
        mod97 = (f"aggregate({chars(rotated)}, 0, ({acc}, {c}) -> "
                 f"({acc} * if({value} < 10, 10, 100) + {value}) % 97)")
        lengths = " ".join(f"WHEN substr({s}, 1, 2) IN ({sql_list(cc.split())}) THEN {size}"
                           for size, cc in IBAN_LENGTHS.items())
        return (f"if({s} rlike '^[0-9A-Z]{{15,34}}$' AND "
                f"length({s}) = CASE {lengths} ELSE 0 END, {mod97} = 1, false)")
    return let(f"regexp_replace({raw}, {lit(r'(?U)\s')}, '')", test)


def us_bank(raw: str) -> str:
    def test(d: str) -> str:
        prefix = _int(d, 1, 2)
        total = _weighted(lambda i: _int(d, i), (3, 7, 1) * 3)
        good = (f"({prefix} <= 12 OR {prefix} BETWEEN 21 AND 32 OR {prefix} BETWEEN 61 AND 72"
                f" OR {prefix} = 80) AND {total} % 10 = 0")
        return f"if(length({d}) = 9, {good}, length({d}) BETWEEN 6 AND 17)"
    return let(_digits(raw), test)


def swift_bic(raw: str) -> str:
    countries = sql_list([*IBAN_COUNTRIES, *SWIFT_EXTRA_COUNTRIES])
    return f"({_ascii_upper(f'substr({raw}, 5, 2)')} IN ({countries}))"


def date_of_birth(raw: str) -> str:
    def test(p: str) -> str:
        a, b, c = (f"cast(get({p}, {k}) as int)" for k in (0, 1, 2))
        year = "{} BETWEEN 1900 AND 2100".format
        iso = f"{year(a)} AND {b} BETWEEN 1 AND 12 AND {c} BETWEEN 1 AND 31"
        numeric = (f"(({a} BETWEEN 1 AND 12 AND {b} BETWEEN 1 AND 31) OR "
                   f"({b} BETWEEN 1 AND 12 AND {a} BETWEEN 1 AND 31)) AND "
                   f"({c} < 100 OR {year(c)})")
        worded = f"size({p}) = 2 AND {a} BETWEEN 1 AND 31 AND {year(b)}"
        return (f"CASE WHEN {raw} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN {iso}"
                f" WHEN {raw} rlike '^[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}$' THEN {numeric}"
                f" WHEN {raw} rlike '^[A-Za-z]' THEN {worded} ELSE false END")
    return let(f"regexp_extract_all({raw}, '([0-9]+)', 1)", test)


def has_digit(raw: str) -> str:
    return f"({raw} rlike '[0-9]')"


def mrz(raw: str) -> str:
    def check(field: str, size: int, expected: str) -> str:
        total = _weighted(lambda i: f"greatest(instr('{ALNUM}', substr({field}, {i}, 1)) - 1, 0)",
                          [(7, 3, 1)[k % 3] for k in range(size)])
        return f"cast({total} % 10 as string) = {expected}"

    def part(start: int, size: int) -> str:
        return f"substr({raw}, {start}, {size})"

    def composite(field: str) -> str:
        return check(field, 39, part(44, 1))
    return (f"(octet_length({raw}) = 44 AND {check(part(1, 9), 9, part(10, 1))}"
            f" AND {check(part(14, 6), 6, part(20, 1))} AND {check(part(22, 6), 6, part(28, 1))}"
            f" AND {let(f'concat({part(1, 10)}, {part(14, 7)}, {part(22, 22)})', composite)})")


def vin(raw: str) -> str:
    letters = "ABCDEFGHJKLMNPRSTUVWXYZ"
    values = "".join(str((UPPER.index(c) if c < "J" else UPPER.index(c) - 9 if c < "S"
                          else UPPER.index(c) - 17) + 1) for c in letters)

    def test(t: str) -> str:
        total = _weighted(lambda i: _int(t, i), VIN_WEIGHTS)
        return (f"if({t} rlike '^[0-9]{{17}}$', "
                f"substr('0123456789X', {total} % 11 + 1, 1) = substr({raw}, 9, 1), false)")
    return let(f"translate({raw}, '{letters}', '{values}')", test)


def ca_sin(raw: str) -> str:
    return _on_digits(raw, 9, _luhn)


def uk_nhs(raw: str) -> str:
    def test(d: str) -> str:
        total = _weighted(lambda i: _int(d, i), range(10, 1, -1))
        # 11 means check digit 0; 10 can never equal a single digit.
        return f"(11 - {total} % 11) % 11 = {_int(d, 10)}"
    return _on_digits(raw, 10, test)


def uk_nino(raw: str) -> str:
    return let(_ascii_upper(raw), lambda s: (
        f"(octet_length({s}) = 9 AND NOT {s} rlike '^(?:[DFIQUV]|.[DFIQUVO])'"
        f" AND substr({s}, 1, 2) NOT IN ({sql_list(NINO_BAD_PREFIXES)}))"))


def au_tfn(raw: str) -> str:
    return _on_digits(raw, 9, lambda d: f"{_weighted(lambda i: _int(d, i), TFN_WEIGHTS)} % 11 = 0")


def _verhoeff_tables() -> tuple[str, str]:
    """Multiplication table of the dihedral group D5 and the powers of the permutation."""
    def product(j: int, k: int) -> int:
        if j < 5:
            return (j + k) % 5 + (5 if k >= 5 else 0)
        return (j - k) % 5 + (5 if k < 5 else 0)
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([VERHOEFF_PERMUTATION[x] for x in powers[-1]])
    return ("".join(str(product(j, k)) for j in range(10) for k in range(10)),
            "".join(str(x) for row in powers for x in row))


def aadhaar(raw: str) -> str:
    table, powers = _verhoeff_tables()

    def test(d: str) -> str:
        acc, i = name("a"), name("i")
        permuted = _int(f"'{powers}'", f"(({i} - 1) % 8) * 10 + {_int(d, f'-{i}')} + 1")
        fold = (f"aggregate(sequence(1, 12), 0, ({acc}, {i}) -> "
                f"{_int(f'{chr(39)}{table}{chr(39)}', f'{acc} * 10 + {permuted} + 1')})")
        return f"{_int(d, 1)} >= 2 AND {fold} = 0"
    return _on_digits(raw, 12, test)


def it_cf(raw: str) -> str:
    odd = ",".join(str(v) for v in CF_ODD_VALUES)
    acc, i = name("a"), name("i")
    place = f"instr('{ALNUM}', substr({raw}, {i}, 1)) - 1"
    value = f"if({place} < 10, {place}, {place} - 10)"
    total = (f"aggregate(sequence(1, 15), 0, ({acc}, {i}) -> {acc} + if({i} % 2 = 1, "
             f"element_at(array({odd}), {value} + 1), {value}))")
    return (f"if({raw} rlike '^[0-9A-Z]{{16}}$', "
            f"substr('{UPPER}', {total} % 26 + 1, 1) = substr({raw}, 16, 1), false)")


def es_dni(raw: str) -> str:
    number = f"cast(translate(substr({raw}, 1, 8), 'XYZ', '012') as bigint)"
    return (f"if({raw} rlike '^[XYZ0-9][0-9]{{7}}[A-Z]$', "
            f"substr('{DNI_LETTERS}', cast({number} % 23 + 1 as int), 1) = substr({raw}, 9, 1), false)")


def br_cpf(raw: str) -> str:
    def digit(d: str, n: int) -> str:
        rest = f"{_weighted(lambda i: _int(d, i), range(n + 1, 1, -1))} % 11"
        return let(rest, lambda r: f"if({r} < 2, 0, 11 - {r})") + f" = {_int(d, n + 1)}"
    return _on_digits(raw, 11, lambda d: (
        f"({d} <> repeat(substr({d}, 1, 1), 11) AND {digit(d, 9)} AND {digit(d, 10)})"))


def pl_pesel(raw: str) -> str:
    return _on_digits(raw, 11, lambda d: (
        f"(10 - {_weighted(lambda i: _int(d, i), PESEL_WEIGHTS)} % 10) % 10 = {_int(d, 11)}"))


def se_pnr(raw: str) -> str:
    return _on_digits(raw, 10, lambda d: (
        f"({_int(d, 3, 2)} BETWEEN 1 AND 12 AND {_int(d, 5, 2)} BETWEEN 1 AND 31 AND {_luhn(d)})"))


def nl_bsn(raw: str) -> str:
    return _on_digits(raw, 9, lambda d: (
        f"({d} <> '000000000' AND "
        f"({_weighted(lambda i: _int(d, i), range(9, 1, -1))} - {_int(d, 9)}) % 11 = 0)"))


def fr_nir(raw: str) -> str:
    return _on_digits(raw, 15, lambda d: (
        f"97 - cast(substr({d}, 1, 13) as bigint) % 97 = {_int(d, 14, 2)}"))


def de_steuer_id(raw: str) -> str:
    def test(d: str) -> str:
        acc, i = name("a"), name("i")
        total = f"({_int(d, i)} + {acc}) % 10"
        product = (f"aggregate(sequence(1, 10), 10, ({acc}, {i}) -> "
                   f"(if({total} = 0, 10, {total}) * 2) % 11)")
        return let(f"11 - {product}", lambda c: f"if({c} = 10, 0, {c}) = {_int(d, 11)}")
    return _on_digits(raw, 11, test)


def cn_resident_id(raw: str) -> str:
    total = _weighted(lambda i: _int(raw, i), RESIDENT_ID_WEIGHTS)
    return (f"if({raw} rlike '^[0-9]{{17}}[0-9X]$', "
            f"substr('{RESIDENT_ID_CHECKS}', {total} % 11 + 1, 1) = substr({raw}, 18, 1)"
            f" AND {_int(raw, 11, 2)} BETWEEN 1 AND 12 AND {_int(raw, 13, 2)} BETWEEN 1 AND 31, false)")


def npi(raw: str) -> str:
    return _on_digits(raw, 10, lambda d: let(f"concat('80840', {d})", _luhn))


def dea(raw: str) -> str:
    total = (f"{_int(raw, 3)} + {_int(raw, 5)} + {_int(raw, 7)}"
             f" + 2 * ({_int(raw, 4)} + {_int(raw, 6)} + {_int(raw, 8)})")
    return (f"if({raw} rlike '^[ABFGMPRXabfgmprx].[0-9]{{7}}$', "
            f"({total}) % 10 = {_int(raw, 9)}, false)")


def medicare_mbi(raw: str) -> str:
    a, n = "[AC-HJKMNP-RT-Y]", "[0-9AC-HJKMNP-RT-Y]"
    shape = f"^[1-9]{a}{n}[0-9]{a}{n}[0-9]{a}{a}[0-9]{{2}}$"
    return f"({_ascii_upper(f'replace({raw}, {chr(39)}-{chr(39)}, {chr(39)}{chr(39)})')} rlike '{shape}')"


def ipv4(raw: str) -> str:
    x = name("x")
    return (f"if({raw} rlike {lit(r'^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$')}, "
            f"forall(split({raw}, {lit(r'\.')}), {x} -> cast({x} as int) <= 255), false)")


def ipv6(raw: str) -> str:
    full = r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$"
    short = r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?$"
    groups = f"size(regexp_extract_all({raw}, '([0-9A-Fa-f]+)', 1))"
    return f"({raw} rlike '{full}' OR ({raw} rlike '{short}' AND {groups} <= 7))"


def ssn(raw: str) -> str:
    return _on_digits(raw, 9, lambda d: (
        f"({_int(d, 1, 3)} NOT IN (0, 666) AND {_int(d, 1, 3)} < 900"
        f" AND {_int(d, 4, 2)} <> 0 AND {_int(d, 6, 4)} <> 0)"))


def crypto_wallet(raw: str) -> str:
    """Base58Check.  The number is held in nine 24-bit limbs, low limb first, and takes in up to
    five characters per carry pass so that a limb never leaves 64 bits."""
    acc, block, i, limb, carry, x = (name(p) for p in ("a", "b", "i", "l", "k", "x"))
    block_value = (f"aggregate({chars(block)}, 0L, ({acc}, {x}) -> "
                   f"{acc} * 58 + instr('{BASE58}', {x}) - 1)")
    scale = f"cast(pow(58, length({block})) as bigint)"
    limbs = name("n")
    carried = (f"aggregate({limbs}, named_struct('c', {block_value}, 'out', cast(array() as "
               f"array<bigint>)), ({carry}, {limb}) -> named_struct("
               f"'c', ({limb} * {scale} + {carry}.c) div 16777216, "
               f"'out', array_append({carry}.out, ({limb} * {scale} + {carry}.c) % 16777216)),"
               f" {carry} -> {carry}.out)")
    blocks = (f"transform(sequence(1, length({raw}), 5), {i} -> substr({raw}, {i}, 5))")
    number = f"aggregate({blocks}, array_repeat(0L, 9), ({limbs}, {block}) -> {carried})"
    y = name("y")
    hexed = f"array_join(transform(reverse({number}), {y} -> lpad(hex({y}), 6, '0')), '')"
    ones = f"length({raw}) - length(ltrim('1', {raw}))"
    payload = (f"concat(repeat('00', {ones}), regexp_replace({hexed}, '^(?:00)+', ''))")

    def test(p: str) -> str:
        body = f"unhex(substr({p}, 1, length({p}) - 8))"
        digest = f"sha2(unhex(sha2({body}, 256)), 256)"
        return f"if(length({p}) >= 10, upper(substr({digest}, 1, 8)) = substr({p}, -8, 8), false)"
    base58 = f"if({raw} rlike '^[{BASE58}]{{26,35}}$', {let(payload, test)}, false)"
    return f"if({raw} like '0x%' OR {raw} like 'bc1%', true, {base58})"


def entropy(raw: str) -> str:
    """Shannon entropy of the characters, in bits per character."""
    acc, c = name("a"), name("c")
    share = f"((length({raw}) - length(replace({raw}, {c}, ''))) / cast(length({raw}) as double))"
    return (f"aggregate(array_distinct({chars(raw)}), 0D, ({acc}, {c}) -> "
            f"{acc} - {share} * log2({share}))")


def credential(raw: str) -> str:
    parts = "|".join(p.replace("*", "[*]") for p in PLACEHOLDER_PARTS)

    def test(low: str) -> str:
        return (f"(octet_length({raw}) >= 8 AND NOT {raw} rlike {lit(r'^[$%<{\[]')}"
                f" AND NOT contains({raw}, concat('$', '{{')) AND NOT contains({raw}, '{{{{')"
                f" AND {low} NOT IN ({sql_list(PLACEHOLDER_WORDS)}) AND NOT {low} rlike '{parts}'"
                f" AND {raw} rlike {lit(r'[0-9]|[^\p{IsAlphabetic}\p{N}]')}"
                # The tolerance keeps eight equal shares, which are exactly 3 bits, on the right side.
                f" AND {entropy(raw)} >= 2.999999999D)")
    return let(_ascii_lower(raw), test)


CHECKS: dict[str, Callable[[str], str]] = {
    "CREDITCARD": credit_card, "IBAN": iban, "US_BANK": us_bank, "SWIFT_BIC": swift_bic,
    "NPI": npi, "DEA": dea, "CA_SIN": ca_sin, "UK_NHS": uk_nhs, "UK_NINO": uk_nino,
    "AU_TFN": au_tfn, "AADHAAR": aadhaar, "IT_CF": it_cf, "ES_DNI": es_dni, "BR_CPF": br_cpf,
    "PL_PESEL": pl_pesel, "SE_PNR": se_pnr, "NL_BSN": nl_bsn, "FR_NIR": fr_nir,
    "DE_STEUER_ID": de_steuer_id, "CN_RESIDENT_ID": cn_resident_id, "DOB": date_of_birth,
    "SSN": ssn, "IP": ipv4, "IPV6": ipv6, "CREDENTIAL": credential, "VIN": vin, "MRZ": mrz,
    "MEDICARE_MBI": medicare_mbi, "CRYPTO_WALLET": crypto_wallet, "PASSPORT": has_digit,
    "DRIVERS_LICENSE": has_digit, "MRN": has_digit, "HEALTH_ID": has_digit, "CASE_NO": has_digit,
}


def is_valid(kind: str, raw: str, kinds=None) -> str:
    """True when a value passes the check of its kind; kinds without a check always pass."""
    wanted = [k for k in CHECKS if kinds is None or k in kinds]
    if not wanted:
        return "true"
    whens = " ".join(f"WHEN '{k}' THEN {CHECKS[k](raw)}" for k in wanted)
    return f"CASE {kind} {whens} ELSE true END"
