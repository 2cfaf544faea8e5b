"""SQL of the repair of damaged conversations: a recursion over turns that keeps the best edits for each state."""

from __future__ import annotations

from .turn_edits import CHOSEN, KINDS, ROLES, STATES, arcs_of


def moves() -> str:
    """Rows (kind, state, target, cost, letters, said) of what may be done up to a turn: at most two inserts, then an
    edit that uses it up. ``said`` has what stays: U or A inserted, k the turn as it is, u or a the turn in that role."""
    rows = []
    for kind in KINDS:
        for state in STATES:
            at, inserted = state, ""
            for n in range(3):
                for letter, cost, to in arcs_of(kind, at):
                    said = {"D": "", "K": "k", "R": ROLES[CHOSEN[at]][0]}[letter]
                    rows.append((kind, state, to, 2 * n + cost, "I" * n + letter, inserted + said))
                at = CHOSEN[at]
                inserted += ROLES[at][0].upper()
    return ", ".join(map(str, rows))


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32, bit by bit: 3988292384 is its reversed polynomial.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]
    FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')])),
    lambda c, v: CASE WHEN xor(c, v) & 1 = 1 THEN xor(xor(c, v) >> 1, 3988292384) ELSE xor(c, v) >> 1 END), 4294967295)"""
SAID = """array_to_string([CASE x WHEN 'U' THEN chr(10) || 'user:' WHEN 'A' THEN chr(10) || 'assistant:'
    WHEN 'k' THEN chr(10) || role || ':' || text WHEN 'u' THEN chr(10) || 'user:' || text
    WHEN 'a' THEN chr(10) || 'assistant:' || text ELSE '' END FOR x IN string_split(said, '')], '')"""

REPAIR_SQL = f"""
WITH RECURSIVE
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC} % 20 AS f FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE f WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed),
placed AS (SELECT conv_id, turn, role, text, trim(text, {BLANKS}) AS bare, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 16), left(text, 32), role, text) AS k FROM hurt),
told AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY k) AS pair FROM placed),
turns AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN translate(initial, 'suax', '1234')
    WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS kind FROM told),
moves(kind, state, target, cost, letters, said) AS (VALUES {moves()}),
tails(state, cost, letters, said) AS (VALUES (0, 0, '', ''), (1, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 'I', chr(10) || 'assistant:'), (3, 0, '', '')),
best AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'kept': ''}} AS v FROM turns
    UNION ALL
    SELECT b.conv_id, t.k, m.target, min({{'cost': b.v.cost + m.cost, 'audit': b.v.audit || m.letters, 'kept': b.v.kept || {SAID}}})
    FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.k = b.k + 1 JOIN moves m ON m.kind = t.kind AND m.state = b.state
    GROUP BY ALL),
facts AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY 1),
done AS (SELECT b.conv_id, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal,
    min({{'cost': b.v.cost + t.cost, 'audit': b.v.audit || t.letters, 'kept': b.v.kept || t.said}}) AS v
    FROM best b JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.k JOIN tails t USING (state) GROUP BY ALL)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.cost, 0)::BIGINT AS cost,
    coalesce(v.audit, '') AS audit, sha256(coalesce(substr(v.kept, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
