"""Small SQL-expression helpers for work inside one row's arrays."""

from __future__ import annotations

import itertools
from collections.abc import Callable

_names = itertools.count()


def lit(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(prefix: str = "v") -> str:
    """A lambda variable name not used before, so that nested lambdas never shadow each other."""
    return f"{prefix}_{next(_names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate `value` once and use it several times in `body`."""
    var = name()
    return f"get(transform(array({value}), {var} -> {body(var)}), 0)"


def running(
    items: str,
    state: str,
    step: Callable[[str, str], tuple[str, str]],
    out_type: str,
    chunk: int = 256,
) -> str:
    """Left-to-right pass over an array that carries a state and emits elements.

    `step(state, item)` gives the next state and an array of emitted elements.  The pass goes
    through the array in slices, whose results are gathered as an array of arrays and joined once, so
    that appending costs O(n * chunk) and not O(n * n).
    """
    empty = f"cast(array() as array<{out_type}>)"
    none = f"cast(array() as array<array<{out_type}>>)"
    outer, part, inner, item, joined, index = (name(p) for p in ("o", "p", "a", "x", "j", "i"))
    next_state, emitted = step(f"{inner}.st", item)
    fold = (
        f"aggregate({part}, named_struct('st', {outer}.st, 'out', {empty}), ({inner}, {item}) -> "
        f"named_struct('st', {next_state}, 'out', concat({inner}.out, {emitted})))"
    )
    return let(items, lambda arr: (
        f"aggregate(transform(sequence(0, greatest(size({arr}) - 1, 0) div {chunk}), "
        f"{index} -> slice({arr}, cast({index} * {chunk} + 1 as int), {chunk})), "
        f"named_struct('st', {state}, 'out', {none}), ({outer}, {part}) -> "
        f"get(transform(array({fold}), {joined} -> named_struct('st', {joined}.st, "
        f"'out', concat({outer}.out, array({joined}.out)))), 0), {outer} -> flatten({outer}.out))"
    ))


def chars(text: str) -> str:
    """The characters of a non-empty string."""
    return f"split({text}, '')"
