"""SQL of the splitters that pack and cut again, as recursive common tables."""

from __future__ import annotations

from spanforge.functions.splitters import SEPARATORS


def _level(p: str, j: int, size: int) -> str:
    """Items {p}i{j} (sid, a, b, lev) to their pieces at the coarsest separator present, runs of short ones, and items {p}i{j + 1}."""
    literal = [f"'{s}'" if s.strip("\n") else " || ".join(["chr(10)"] * len(s)) for s in SEPARATORS[:-1]]
    last = len(literal)
    level = " ".join(f"WHEN lev <= {k} AND contains(s, {mark}) THEN {k}" for k, mark in enumerate(literal))
    named = " ".join(f"WHEN {k} THEN {mark}" for k, mark in enumerate(literal))
    width = " ".join(f"WHEN {k} THEN {len(s)}" for k, s in enumerate(SEPARATORS[:-1]))
    return f"""
        {p}t{j} AS (SELECT i.sid, a, b, substr(text, (a + 1)::BIGINT, (b - a)::BIGINT) AS s, lev FROM {p}i{j} i JOIN {p}src USING (sid) WHERE lev <= {last}),
        {p}l{j} AS (SELECT *, CASE {level} ELSE {last} END AS sep FROM {p}t{j}),
        {p}w{j} AS (SELECT sid, a, b, sep, unnest(string_split(s, CASE sep {named} END)) AS part, generate_subscripts(string_split(s, CASE sep {named} END), 1) AS k FROM {p}l{j} WHERE sep < {last}),
        {p}e{j} AS (
            SELECT sid, a, sep, (a + sum(length(part)) OVER (PARTITION BY sid, a ORDER BY k ROWS UNBOUNDED PRECEDING) + (k - 1) * CASE sep {width} END)::BIGINT AS x FROM {p}w{j}
            UNION SELECT sid, a, sep, unnest(range(a, b)) FROM {p}l{j} WHERE sep = {last}
            UNION SELECT sid, a, sep, a FROM {p}l{j} UNION SELECT sid, a, sep, b FROM {p}l{j}),
        {p}p{j} AS (SELECT sid, a, sep, x, lead(x) OVER (PARTITION BY sid, a ORDER BY x) AS y FROM {p}e{j}),
        {p}g{j} AS (SELECT *, y - x >= {size} AS long, sum(CASE WHEN y - x >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY sid, a ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM {p}p{j} WHERE y IS NOT NULL),
        {p}r{j} AS (SELECT sid, list_prepend(min(x), list(y ORDER BY y)) AS edges FROM {p}g{j} WHERE NOT long GROUP BY sid, a, g),
        {p}i{j + 1} AS (SELECT sid, x AS a, y AS b, sep + 1 AS lev FROM {p}g{j} WHERE long),"""


def recover_sql(p: str) -> str:
    """Common tables from {p}told (sid, i, piece), pieces numbered from 1, and {p}src (sid, text) to {p}cut (sid, i, a, b): of each
    piece the first place that does not begin before the piece ahead of it."""
    return f"""{p}found(sid, i, a, piece) AS (
            SELECT sid, i, (strpos(text, piece) - 1)::BIGINT, piece FROM {p}told JOIN {p}src USING (sid) WHERE i = 1
            UNION ALL SELECT t.sid, t.i, (f.a + strpos(substr(s.text, (f.a + 1)::BIGINT), t.piece) - 1)::BIGINT, t.piece FROM {p}found f JOIN {p}told t ON t.sid = f.sid AND t.i = f.i + 1 JOIN {p}src s ON s.sid = f.sid),
        {p}cut AS (SELECT sid, i, a, (a + length(piece))::BIGINT AS b FROM {p}found)"""


def recursive_sql(p: str, size: int, overlap: int) -> str:
    """Common tables from {p}src (sid, text) to {p}cut (sid, i, a, b): recursive cuts where recovered offsets place them, in order.

    {p}src has no empty texts. Names begin with p.
    """
    n = len(SEPARATORS)
    upto = f"len(list_filter(edges, lambda x: x <= edges[{{0}} + 1] + {size})) - 1"
    onward = f"least(upto, greatest(first, len(list_filter(edges, lambda x: x < greatest(edges[upto + 1] - {overlap}, edges[upto + 2] - {size})))))"
    return f"""{p}i0 AS (SELECT sid, 0::BIGINT AS a, length(text)::BIGINT AS b, 0 AS lev FROM {p}src),{''.join(_level(p, j, size) for j in range(n))}
        {p}runs AS ({' UNION ALL '.join(f'SELECT * FROM {p}r{j}' for j in range(n))}),
        {p}pack(sid, edges, first, upto) AS (
            SELECT sid, edges, 0::BIGINT, ({upto.format(0)})::BIGINT FROM {p}runs
            UNION ALL SELECT sid, edges, nf, ({upto.format('nf')})::BIGINT FROM (SELECT *, ({onward})::BIGINT AS nf FROM {p}pack WHERE upto < len(edges) - 1)),
        {p}said AS (SELECT sid, edges[first + 1] AS a, edges[upto + 1] AS b FROM {p}pack UNION ALL {' UNION ALL '.join(f'SELECT sid, a, b FROM {p}i{j} WHERE lev = {n}' for j in range(1, n + 1))}),
        {p}told AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY a, b) AS i, substr(text, (a + 1)::BIGINT, (b - a)::BIGINT) AS piece FROM {p}said JOIN {p}src USING (sid)),
        {recover_sql(p)}"""
