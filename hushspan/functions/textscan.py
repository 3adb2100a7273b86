"""The rules run over texts in Arrow batches, and the classes of characters they see.

A rule names ASCII characters and a few others; every other character counts by its class alone (part of a
word, digit, white space, none of these), as the JVM's patterns with Unicode flags have it.  So a text that is
not ASCII is read with one character in place of each class, of the same length, which keeps all offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from hushspan.functions.rules import GATES, RULES, Rule

#: \w and \s of the JVM's patterns with Unicode flags.
WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]")
SPACE = regex.compile(r"\p{White_Space}")
_DIGITS = regex.compile(r"\p{Nd}")
#: Characters beyond ASCII that a rule names, or that are a case of an ASCII letter.
_NAMED = frozenset("éÉº°ſ\u212a")


class _Classes(dict):
    """Table of str.translate: every character beyond ASCII as one of its class; filled as characters come."""

    def __missing__(self, code: int) -> int:
        char = chr(code)
        if char in _NAMED:
            out = code
        elif code < 128:
            # Not white space to the JVM, but to Python.
            out = 1 if 0x1c <= code <= 0x1f else code
        else:
            out = ord("\u0663" if _DIGITS.match(char) else "\u05d0" if WORD.match(char) else "\u2003" if SPACE.match(char) else "\u2014")
        self[code] = out
        return out


_CLASSES = _Classes()


def read(text: str) -> str:
    """The text as the rules see it."""
    return text if text.isascii() else text.translate(_CLASSES)


HIT = pa.struct([("start", pa.int32()), ("neg_len", pa.int32()), ("ord", pa.int32()), ("kind", pa.string()), ("raw", pa.string())])
_DIGIT = r"\d(?<!\w.)"
#: Where a rule's matches start at all, so that its pattern is tried at few places.  Each begins with a set of
#: characters, which `re` skips to.
STARTS = {
    "CREDITCARD": _DIGIT, "BR_CPF": _DIGIT, "SE_PNR": _DIGIT, "CN_RESIDENT_ID": _DIGIT, "SSN": _DIGIT, "IP": _DIGIT, "ADDRESS": _DIGIT,
    "CASE_NO": _DIGIT, "ES_DNI": r"[XYZ\d](?<!\w.)", "PHONE": r"[+(\d](?<=\b.)", "VIN": r"[A-HJ-NPR-Z0-9](?<!\w.)[A-HJ-NPR-Z0-9]{16}",
    "IBAN": r"[A-Z](?<!\w.)[A-Z]\d", "IT_CF": r"[A-Z](?<!\w.)[A-Z]{5}\d", "CRYPTO_WALLET": r"[01b3](?<!\w.)[a-zA-Z0-9]{20}",
    "MAC_ADDRESS": r"[0-9A-Fa-f](?<!\w.)[0-9A-Fa-f][:\-][0-9A-Fa-f]{2}[:\-]", "IPV6": r"[A-Fa-f0-9](?<!\w.)[A-Fa-f0-9]{0,3}:",
    "EMPID": r"E(?<!\w.)MP-", "JWT": r"e(?<!\w.)yJ",
    "APIKEY": r"[sprAghxndflytS](?<!\w.)(?:k[\-_]|KIA|SIA|h[a-z]_|ithub_|lpat-|ox|app-|f_|pm_|ypi-|lsa_|op_|hpat_|hpss_|igd_|in_|fp_|Iza|a29|G\.)",
}
#: What a text holds at all if the rule matches.
NEEDS = {"MRZ": r"[A-Z0-9<]{44}"}


def value_pattern(rule: Rule, flags: int = 0) -> re.Pattern:
    """The rule for texts as `read` gives them; group 1 is the value."""
    lead = f"(?={rule.lead})" if rule.lead else ""
    body = f"{lead}(?:{rule.anchor})({rule.value})(?:{rule.tail})"
    return re.compile(body.replace(r"\z", r"\Z"), flags | (re.IGNORECASE if rule.ignore_case else 0))


def start_pattern(rule: Rule) -> str | None:
    """What stands where a match of the rule starts: of an anchored one, a first letter of its lead at a word's front."""
    if not rule.anchor:
        return STARTS.get(rule.kind)
    if not (rule.ignore_case and rule.lead and rule.anchor.startswith(r"\b")):
        return None
    lead = rule.lead
    firsts = lead[1:lead.index("]")] if lead[0] == "[" else "".join(p[0] for p in lead[3:-1].split("|")) if lead[0] == "(" else lead[0]
    return f"[{firsts.lower()}{firsts.upper()}ſ\u212a](?<!\\w.)"


@lru_cache(maxsize=None)
def _plan(numbers: tuple[int, ...], flags: int) -> tuple:
    """Gates that the numbered rules share, and (number, kind, gate, keywords, what is needed, start, pattern) of each."""
    rules = [(i, RULES[i - 1]) for i in numbers]
    gates = {g: re.compile(p.removeprefix("(?U)"), flags) for g, p in GATES.items() if g == "digit" or any(r.gate == g for _, r in rules)}

    def compiled(pattern: str | None) -> re.Pattern | None:
        return None if pattern is None else re.compile(pattern, flags)
    return gates, [(i, r.kind, r.gate, r.any_of, compiled(NEEDS.get(r.kind)), compiled(start_pattern(r)), value_pattern(r, flags))
                   for i, r in rules]


def hits(text: str, numbers: tuple[int, ...]) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, rule number, kind) of all values of the rules in a text, before they are checked."""
    if text.isascii():
        flags, low = int(re.ASCII), text.lower()
    else:
        text, flags = read(text), 0
        low = text.replace("ſ", "s").lower()
    gates, rules = _plan(numbers, flags)
    digit = gates["digit"].search(text) is not None
    passed = {g: digit and (g == "digit" or p.search(text) is not None) for g, p in gates.items()}
    places: dict[re.Pattern, list[int]] = {}
    for number, kind, gate, words, needed, start, pattern in rules:
        if gate and not passed[gate]:
            continue
        for word in words:
            if word in low:
                break
        else:
            if words:
                continue
        if needed is not None and needed.search(text) is None:
            continue
        if start is None:
            for found in pattern.finditer(text):
                yield *found.span(1), number, kind
            continue
        if start not in places:
            places[start] = [m.start() for m in start.finditer(text)]
        upto = 0
        for at in places[start]:
            if at >= upto:
                found = pattern.match(text, at)
                if found is not None:
                    upto = found.end()
                    yield *found.span(1), number, kind


def hit_lists(texts: pa.Array, numbers: tuple[int, ...]) -> pa.Array:
    """A list of hits for every text; null for a null one."""
    offsets, starts, lengths, orders, kinds, raws = [0], [], [], [], [], []
    for text in texts.to_pylist():
        if text is not None:
            for start, end, number, kind in hits(text, numbers):
                starts.append(start)
                lengths.append(start - end)
                orders.append(number)
                kinds.append(kind)
                raws.append(text[start:end])
        offsets.append(len(starts))
    columns = [pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(orders, pa.int32()),
               pa.array(kinds, pa.string()), pa.array(raws, pa.string())]
    items = pa.StructArray.from_arrays(columns, fields=list(HIT))
    mask = pa.array(np.asarray(texts.is_null()))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=mask)
