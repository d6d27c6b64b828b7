"""SQL of the queries that SQL can express, for DuckDB on the same tables."""
from __future__ import annotations

from clipgraph.llm import turns, urls
from clipgraph.llm.common import LOWER, UPPER

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op2_urls() -> str:
    """Host and path by position, literal rules by prefix, words as whole tokens."""
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}"
                    for v, h, p in sorted(urls.BASE, key=lambda r: -len(r[1] + r[2])))
    words = "|".join(urls.BLOCKED_WORDS)
    return f"""WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM cut),
judged AS (SELECT *, CASE {fits} END AS hit FROM parts)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN regexp_matches(host || lower(path), '(^|[^0-9a-z])({words})([^0-9a-z]|$)') THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""


def op8_decontamination(size: int = 10) -> str:
    """Windows of both tables as word lists, joined; every position a window covers counts once."""
    def cut(table: str, key: str) -> str:
        return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS ws FROM {table}"

    return f"""WITH d AS (SELECT *, row_number() OVER () AS r FROM ({cut('documents', 'doc_id')})), b AS ({cut('benchmark', 'item_id')}),
win AS (SELECT item_id, array_to_string(ws[i:i + {size} - 1], ' ') AS w, least(len(ws), {size}) AS n FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - {size} + 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT p.r, p.i, p.n, win.item_id FROM place p JOIN win USING (w, n)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, o: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}), 4294967295)"


def op11_turns() -> str:
    """Damage and faults by windows, then the cheapest edits row by row over four states, with the letters and lines written so far."""
    names = {turns.U: "user", turns.A: "assistant"}
    rows = []
    for code, table in enumerate(turns.CHOICES):
        for y, row in enumerate(table):
            for x, choice in enumerate(row):
                if choice:
                    # lines of the letters: inserts name a role, K keeps the row's, R takes the state's
                    state, before, last = y, "", ""
                    for letter in choice[1]:
                        if letter == "I":
                            state = turns.INSERTED[state]
                            before += f"{names[state]}:\n"
                        else:
                            last = {"K": "keep", "R": names[turns.INSERTED[state]], "D": ""}[letter]
                    rows.append(f"({code}, {y}, {x}, {choice[0]}, '{choice[1]}', '{before}', '{last}')")
    crc = crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")
    visible = r"[^\x20\x09-\x0D]"
    return f"""WITH RECURSIVE step(code, y, x, cost, letters, before, last) AS (VALUES {', '.join(rows)}),
hurt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations),
bad AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
FROM hurt WHERE h <> 0),
placed AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '{visible}') AS blank FROM bad WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faulty AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS twice, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS short, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM placed),
coded AS (SELECT *, CASE WHEN blank OR twice THEN {turns.MUST_GO} ELSE 2 * CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END + CAST(short AS INT) END AS code FROM faulty),
every AS (SELECT conv_id, i, code, role, text FROM coded UNION ALL SELECT DISTINCT conv_id, n + 1, {turns.END}, '', '' FROM coded),
walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {turns.NOTHING} AS x, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM coded UNION ALL
SELECT conv_id, i, x, min(cost), arg_min(audit, struct_pack(c := cost, a := audit)), arg_min(lines, struct_pack(c := cost, a := audit)) FROM
(SELECT e.conv_id, e.i, s.x, w.cost + s.cost AS cost, w.audit || s.letters AS audit,
w.lines || s.before || CASE s.last WHEN '' THEN '' WHEN 'keep' THEN e.role || ':' || e.text || chr(10) ELSE s.last || ':' || e.text || chr(10) END AS lines
FROM walk w JOIN every e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 JOIN step s ON s.code = e.code AND s.y = w.x) GROUP BY conv_id, i, x),
done AS (SELECT w.* FROM walk w JOIN every e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i AND e.code = {turns.END}),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(twice) AS duplicate, count_if(short AND NOT blank AND NOT twice) AS truncated,
count_if(prev IS NOT NULL AND prev || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(lines, length(lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_urls": op2_urls(), "op8_decontamination": op8_decontamination(), "op11_turns": op11_turns()}
