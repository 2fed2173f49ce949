"""Types of the DuckDB twins' results."""

from __future__ import annotations

import re

_KINDS = {"round": "DOUBLE", "round_even": "DOUBLE", "count_if": "BIGINT"}


def plain_types(sql: str) -> str:
    """sql with every outermost round(...) as a double and every outermost count_if(...) as a bigint."""
    out, at = "", 0
    for m in re.finditer(r"(?<![\w.])(round_even|round|count_if)\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += f"{sql[at : m.start()]}CAST({sql[m.start() : end]} AS {_KINDS[m.group(1)]})"
        at = end
    return out + sql[at:]
