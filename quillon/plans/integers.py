"""Integer semantics of SQL texts: int + - * wrap at 32 bits, int / truncates towards zero.

Spark analyses the text first. Where its plan has integer arithmetic, the place of that expression in the text is
known, and the operation is written there as one that wraps or truncates. Everything else stays as it was written.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\w+|<>|<=|>=|!=|\|\||.", re.S)
SIGNS = {"Add": "+-", "Subtract": "+-", "Multiply": "*/%", "Divide": "*/%"}
WHOLE = {"byte", "short", "integer", "long"}


def _all(s) -> list:
    return [s.apply(i) for i in range(s.length())]


def _place(e) -> tuple[int, int] | None:
    o = e.origin()
    return (o.startIndex().get(), o.stopIndex().get() + 1) if o.startIndex().isDefined() and o.stopIndex().isDefined() else None


def _kind(e, place: tuple[int, int]) -> str:
    """An operand's type as it was written: what the analyser has cast itself stands at its parent's place."""
    while e.getClass().getSimpleName() == "Cast" and _place(e) == place:
        e = e.child()
    return e.dataType().typeName()


def places(df: DataFrame, sql: str) -> dict[tuple[int, int], str]:
    """Start and end in the text of each int operation, and its class."""
    out: dict[tuple[int, int], str] = {}

    def expression(e) -> None:
        name, at = e.getClass().getSimpleName(), _place(e)
        if name in SIGNS and at and e.origin().sqlText().isDefined() and e.origin().sqlText().get() == sql:
            kinds = {_kind(c, at) for c in _all(e.children())}
            if kinds <= WHOLE and (name == "Divide" or kinds <= WHOLE - {"long"}):
                out[at] = "Divide long" if name == "Divide" and "long" in kinds else name
        for c in _all(e.children()):
            expression(c)
        if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            plan(e.plan())

    def plan(p) -> None:
        for e in _all(p.expressions()):
            expression(e)
        for c in _all(p.children()):
            plan(c)
        for c in _all(p.innerChildren()):
            if "logical" in c.getClass().getName():
                plan(c)

    plan(df._jdf.queryExecution().analyzed())
    return out


def _operator(sql: str, start: int, end: int, signs: str) -> tuple[int, int]:
    """The last binary operator of the outermost level."""
    depth, operand, found = 0, False, (start, start)
    for m in TOKEN.finditer(sql, start, end):
        t = m[0]
        if re.match(r"\s|--|/\*", t):
            continue
        word = t.upper()
        if depth == 0 and operand and t in signs:
            found, operand = m.span(), False
            continue
        depth += (t in ("(", "[")) + (word == "CASE") - (t in (")", "]")) - (word == "END")
        operand = t in (")", "]") or word == "END" or bool(re.match(r"\w|['\"`]", t))
    return found


def rewritten(sql: str, nodes: dict[tuple[int, int], str]) -> str:
    def render(lo: int, hi: int, inside: tuple[int, int] | None = None) -> str:
        out, at = "", lo
        for start, end in sorted((n for n in nodes if lo <= n[0] and n[1] <= hi and n != inside), key=lambda n: (n[0], -n[1])):
            if start >= at:
                out += sql[at:start] + operation(start, end)
                at = end
        return out + sql[at:hi]

    def operation(start: int, end: int) -> str:
        name = nodes[start, end]
        p, q = _operator(sql, start, end, SIGNS[name.split()[0]])
        if p == q:
            return render(start, end, (start, end))
        a, b = (f"CAST({render(x, y, (start, end)).strip()} AS BIGINT)" for x, y in ((start, p), (q, end)))
        if name == "Divide long":
            return f"({a} div {b})"
        whole = f"({a} div {b})" if name == "Divide" else f"({a} {sql[p:q]} {b})"
        return f"CAST(pmod({whole} + 2147483648L, 4294967296L) - 2147483648L AS INT)"

    return render(0, len(sql))


def with_integers(sql: str, run: Callable[[str], DataFrame]) -> tuple[DataFrame, str]:
    """The text's DataFrame with the integer semantics above, its columns named as they would be; and the text that ran."""
    df = run(sql)
    if not re.search(r"[-+*/]", re.sub(r"\(\s*\*\s*\)|'(?:[^']|'')*'", "", sql)):
        return df, sql
    nodes = places(df, sql)
    if not nodes:
        return df, sql
    text = rewritten(sql, nodes)
    return run(text).toDF(*df.columns), text
