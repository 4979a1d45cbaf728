"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"

_LINES = r"""
lines AS (
  SELECT d.doc_id, t.i AS pos, t.line,
    translate(regexp_replace(regexp_replace(t.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d,
    LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                    unnest(range(len(string_split(coalesce(d.text, ''), chr(10))))) AS i) t
),
firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) > 1
)
"""

# the table of the checksum's polynomial (reflected, 0xEDB88320), one entry per byte
_CRC_TABLE = """
crc_table AS (
  SELECT list(v ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
      CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) t(i)
  )
)
"""


def _crc32(text: str) -> str:
    """Checksum of an ASCII expression; ``crc_table`` must be in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), "
        "lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
    )


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _edit(key: str, cost: str, letter: str) -> str:
    """Nine digits of cost and the letters so far, after one more edit."""
    return f"(printf('%09d', substr({key}, 1, 9)::BIGINT + {cost}) || substr({key}, 10) || '{letter}')"


def _least(*keys: str) -> str:
    return f"list_min([{', '.join(keys)}])"


def _after_row(last: str, before: list[str], initial: str) -> str:
    """Cheapest edits that consume a row and leave ``last`` as the last role."""
    options = [_edit(last, "4", "D")]
    options += [f"CASE WHEN NOT must THEN {_edit(k, '3 + 3 * cut::INT', 'R')} END" for k in before if last != "ks"]
    options += [f"CASE WHEN NOT must AND initial = '{initial}' THEN {_edit(k, '3 * cut::INT', 'K')} END" for k in before]
    return _least(*options)


_TURN_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM harmed WHERE kind <> 0
),
placed AS (
  SELECT *, trim(text, {_BLANKS}) AS bare, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i FROM damaged
),
flagged AS (
  SELECT *, bare = '' AS blank,
    bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
    substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed
),
judged AS (
  SELECT *, blank OR dup AS must, NOT blank AND NOT dup AND right(bare, 1) NOT IN ('.', '!', '?') AS cut
  FROM flagged
),
-- cheapest edits by last role: none yet, system, user, assistant
states(conv_id, i, k0, ks, ku, ka) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, '000000003I', '000000006II' FROM conversations
  UNION ALL
  SELECT conv_id, i, k0, ks, u, {_least("a", _edit("u", "3", "I"))} FROM (
    SELECT conv_id, i, k0, ks, a, {_least("u", _edit("k0", "3", "I"), _edit("ks", "3", "I"), _edit("a", "3", "I"))} AS u FROM (
      SELECT s.conv_id, r.i, {_edit("k0", "4", "D")} AS k0, {_after_row("ks", ["k0"], "s")} AS ks,
        {_after_row("ku", ["k0", "ks", "ka"], "u")} AS u, {_after_row("ka", ["ku"], "a")} AS a
      FROM states s JOIN judged r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1
    )
  )
),
solved AS (
  SELECT conv_id, i AS n, least(k0, ka) AS k FROM states
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
),
letters AS (
  SELECT conv_id, unnest(string_split(substr(k, 10), '')) AS letter,
    unnest(range(length(k) - 9)) AS pos FROM solved WHERE length(k) > 9
),
numbered AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS kept
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
),
stayed AS (
  SELECT l.conv_id, l.pos, l.letter, l.kept, r.role, CASE WHEN l.letter = 'I' THEN '' ELSE r.text END AS text,
    bool_or(l.letter = 'K' AND l.kept = 1 AND r.initial = 's') OVER (PARTITION BY l.conv_id) AS begun
  FROM numbered l LEFT JOIN judged r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i AND l.letter <> 'I'
  WHERE l.letter <> 'D'
),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role
      WHEN (kept - begun::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos)) AS h
  FROM stayed GROUP BY conv_id
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, substr(k, 1, 9)::BIGINT AS cost,
  substr(k, 10) AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM solved s LEFT JOIN counted c ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON s.conv_id IS NOT DISTINCT FROM r.conv_id
"""

_PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    strlen(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM turns),
convs AS (
  SELECT conv_id, {_crc32("conv_id::VARCHAR")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, p.i, p.digest, p.size FROM convs c
  JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 5 AND p.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, p.i, p.digest, p.size FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.i > c.h
),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(digest, ',') OVER w) AS k, size
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs
),
linked AS (
  SELECT *, lag(k) OVER w AS parent, lead(k) OVER w IS NULL AS last FROM steps
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
),
nodes AS (
  SELECT k, depth, any_value(parent) AS parent, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM linked GROUP BY k, depth
),
children AS (SELECT parent AS k, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.k AS top, b.k FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
held AS (
  SELECT b.top AS k, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens, count(*) FILTER (c.k IS NULL) AS n_leaves
  FROM below b JOIN nodes n ON b.k = n.k LEFT JOIN children c ON b.k = c.k GROUP BY b.top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
  h.n_leaves, h.saved_tokens, n.ends_sha256
FROM nodes n JOIN held h ON n.k = h.k LEFT JOIN children c ON n.k = c.k LEFT JOIN nodes p ON n.parent = p.k
"""

ORACLES = {
    "op12_prefix_trie": _PREFIX_TRIE,
    "op13_turn_repair": _TURN_REPAIR,
    "op1_line_dedup": f"""
WITH {_LINES},
marked AS (
  SELECT l.doc_id, l.pos, l.line, f.first IS NOT NULL AND f.first <> l.doc_id AS gone
  FROM lines l LEFT JOIN firsts f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op9_mixing": rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
    CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0
      ELSE len(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_SPACE}+')) END AS size
  FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source
),
-- a source is cut off before those with a larger ratio of limit to weight
ordered AS (
  SELECT *, 2.0 * source_size / w AS ratio, sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
    1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM sources
),
level AS (SELECT arg_min(rest / w_rest, ratio) FILTER (rest / w_rest <= ratio) AS x FROM ordered),
targets AS (
  SELECT source, source_size, least(2.0 * source_size, x * w)::DOUBLE AS target FROM ordered, level
),
keyed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.source,
    md5('mix-1:' || coalesce(s.doc_id::VARCHAR, ':' || s.text_md5)) AS k,
    round_even(t.target, 0)::BIGINT AS quota
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
running AS (
  SELECT *, quota // greatest(source_size, 1) AS passes, quota % greatest(source_size, 1) AS rest,
    sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (CASE WHEN source_size = 0 THEN 0 ELSE passes END + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
""",
}
