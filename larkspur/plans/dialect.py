"""Two habits of other SQL engines, as rewritings of query text: NULLs sort last unless the text says otherwise, and, on request, a
scalar subquery of several rows gives its first row instead of an error."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|<=|>=|<>|!=|==|\s+|.", re.S)
_ENDS_KEYS = {"LIMIT", "OFFSET", "FETCH", "ROWS", "RANGE", "GROUPS", "UNION", "EXCEPT", "INTERSECT", "MINUS", "WINDOW", ";"}


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _skipped(token: str) -> bool:
    return token.isspace() or token.startswith(("--", "/*"))


def _next(parts: list[str], at: int, step: int = 1) -> int:
    """The place of the nearest token that is no space or comment, or -1."""
    at += step
    while 0 <= at < len(parts) and _skipped(parts[at]):
        at += step
    return at if 0 <= at < len(parts) else -1


def nulls_last(text: str) -> str:
    """Adds NULLS LAST to each sort key without NULLS, in windows too."""
    parts = tokens(text)
    after: set[int] = set()  # tokens behind which it goes
    for k, token in enumerate(parts):
        if token.upper() != "ORDER" or (by := _next(parts, k)) < 0 or parts[by].upper() != "BY":
            continue
        depth, last, told = 0, -1, False
        for at in range(by + 1, len(parts) + 1):
            word = parts[at].upper() if at < len(parts) else ";"
            ends = depth == 0 and (word in _ENDS_KEYS or word == ")")
            if ends or depth == 0 and word == ",":
                if last >= 0 and not told:
                    after.add(last)
                last, told = -1, False
                if ends:
                    break
                continue
            depth += (word == "(") - (word == ")")
            told |= depth == 0 and word == "NULLS"
            if not _skipped(word):
                last = at
    return "".join(x + " NULLS LAST" * (k in after) for k, x in enumerate(parts))


#: Words after which an opening bracket with a query in it holds no scalar.
_NO_SCALAR = {"IN", "EXISTS", "ANY", "SOME", "ALL", "AS", "FROM", "JOIN", "LATERAL", "UNION", "EXCEPT", "INTERSECT", "MINUS", "DISTINCT", "ARRAY"}
_TABLES_FOLLOW, _TABLES_END = {"FROM", "JOIN", "USING"}, {"SELECT", "WHERE", "ON", "GROUP", "HAVING", "ORDER", "LIMIT", "QUALIFY", "WINDOW", "UNION", "EXCEPT", "INTERSECT", "MINUS", "SET"}
_ONE_ROW = {"MIN", "MAX", "AVG", "SUM", "COUNT"}


def _one_row(parts: list[str], at: int) -> bool:
    """Whether the query whose SELECT is at ``at`` begins with an aggregate and has no GROUP BY of its own: it has one row anyway."""
    call = _next(parts, at)
    if call < 0 or parts[call].upper() not in _ONE_ROW:
        return False
    depth = 0
    for x in parts[at:]:
        depth += (x == "(") - (x == ")")
        if depth < 0:
            return True
        if depth == 0 and x.upper() in ("GROUP", "UNION"):
            return False
    return True


def first_row_scalars(text: str) -> str:
    """Limits each scalar subquery, wherever an expression may stand, to its first row."""
    parts, opened, out = tokens(text), [], []
    tables = [False]  # for each open bracket and the whole: does a table stand here, not an expression
    for k, token in enumerate(parts):
        word = token.upper()
        if token == "(":
            before, inside = _next(parts, k, -1), _next(parts, k)
            last = parts[before].upper() if before >= 0 else ""
            scalar = inside >= 0 and parts[inside].upper() == "SELECT" and last not in _NO_SCALAR and not tables[-1] and before >= 0 and not _one_row(parts, inside)
            opened.append(scalar)
            tables.append(tables[-1])
            out.append("(SELECT * FROM (" if scalar else token)
            continue
        if token == ")" and opened:
            tables.pop()
            out.append(") LIMIT 1)" if opened.pop() else token)
            continue
        if word in _TABLES_FOLLOW:
            tables[-1] = True
        elif word in _TABLES_END:
            tables[-1] = False
        out.append(token)
    return "".join(out)
