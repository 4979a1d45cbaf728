"""The registered queries as plain SQL for DuckDB, on the same tables."""

from __future__ import annotations

from tagweave.functions import text, vocabulary
from tagweave.operators.communities import SLICES
from tagweave.plans.queries import PROSE_STOP_WORDS, PROSE_SYNONYMS
from tagweave.plans.tables import STOP, THEME


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_quote(v) for v in values)


def _replace(expr: str, rules) -> str:
    for old, new in rules:
        expr = f"replace({expr}, {_quote(old)}, {_quote(new)})"
    return expr


def _with(*parts: str) -> str:
    *ctes, body = parts
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


# --- documents --------------------------------------------------------------------

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

PHRASES = """phrases AS (
  SELECT doc_id, unnest(string_split(replace(text, ';', ','), ', ')) AS label
  FROM documents)"""

TOKENS = r"""tokens AS (
  SELECT unnest(string_split_regex(lower(text), '[ \t\n\x0b\f\r]+')) AS label
  FROM documents)"""
WORDS = """words AS (
  SELECT label, count(*) AS n FROM tokens WHERE label <> '' GROUP BY label)"""

_ACRONYM = "({c} = upper({c}) AND {c} <> lower({c}))"


def _decapitalize(c: str) -> str:
    return (
        f"CASE WHEN {_ACRONYM.format(c=c)} THEN {c}"
        f" ELSE lower(substr({c}, 1, 1)) || substr({c}, 2) END"
    )


def _singular(c: str) -> str:
    word = rf"regexp_extract({c}, '([^ ]*)\z', 1)"
    cases = [f"WHEN {word} = {_quote(k)} THEN {_quote(v)}"
             for k, v in text.IRREGULAR_PLURALS.items()]
    cases.append(f"WHEN length({word}) < 4 THEN {word}")
    for pattern, new in text.PLURAL_SUFFIXES:
        new = new.replace("$1", r"\1")
        cases.append(
            f"WHEN regexp_matches({word}, {_quote(pattern)})"
            f" THEN regexp_replace({word}, {_quote(pattern)}, {_quote(new)})"
        )
    return (
        f"CASE WHEN {_ACRONYM.format(c=c)} THEN {c} ELSE"
        f" left({c}, length({c}) - length({word})) ||"
        f" CASE {' '.join(cases)} ELSE {word} END END"
    )


def _clean(drop_and: str) -> str:
    bare = r"regexp_replace(label, '\(.*\)', '', 'g')"
    bare = _replace(bare, [("&", " "), (":", " ")])
    bare = drop_and.format(c=bare)
    bare = f"regexp_replace({bare}, '{SPACE}+', ' ', 'g')"
    return _with(
        PHRASES,
        f"c1 AS (SELECT doc_id, {_replace(bare, text.SYNONYMS)} AS c FROM phrases)",
        f"c2 AS (SELECT doc_id, {_decapitalize('c')} AS c FROM c1)",
        f"SELECT doc_id, lower({_singular('c')}) AS new_label FROM c2",
    )


def _without_and(c: str) -> str:
    sign = text.WORD_SIGN.replace("{", "{{").replace("}", "}}")
    return rf"regexp_replace({c}, '(^|[^{sign}])and([^{sign}]|$)', '\1\2', 'g')"


def _phrase(expr: str) -> str:
    return _with(PHRASES, f"SELECT doc_id, {expr} AS new_label FROM phrases")


# --- stems ------------------------------------------------------------------------


def _stem_ctes() -> list[str]:
    """One CTE per step over ``(label, word, w)``."""

    def cut(name, source, suffixes):
        pattern = _quote("(?s)^(.*?)(" + "|".join(suffixes) + r")\z")
        return (
            f"{name} AS (SELECT *, regexp_extract(w, {pattern}, 1) AS stem,"
            f" regexp_extract(w, {pattern}, 2) AS suffix FROM {source})"
        )

    def has(pattern, c="stem"):
        return f"regexp_matches({c}, {_quote(pattern)})"

    def lookup(rules, key="suffix"):
        cases = " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in rules.items())
        return f"CASE {key} {cases} END"

    def step(name, source, expr, extra=""):
        return f"{name} AS (SELECT label, word, {expr} AS w{extra} FROM {source})"

    v = vocabulary
    positive, above = has(v.MEASURE_POSITIVE), has(v.MEASURE_ABOVE_ONE)
    repair = f"(suffix IN ('ed', 'ing') AND {has(v.HAS_VOWEL)})"
    base = "(stem || CASE suffix WHEN 'logi' THEN 'l' ELSE '' END)"
    last, before = "right(w, 1)", "substr(w, length(w) - 1, 1)"
    doubled = (
        f"(length(w) > 1 AND {last} = {before}"
        f" AND {last} NOT IN ('a', 'e', 'i', 'o', 'u', 'y'))"
    )
    return [
        "s0 AS (SELECT label, lower(label) AS word,"
        " regexp_replace(lower(label), '^y', 'Y') AS w FROM words)",
        cut("t1", "s0", ["sses", "ies", "ss", "s"]),
        step("s1", "t1",
             "CASE WHEN suffix = 'ies' AND length(w) = 4 THEN stem || 'ie'"
             " WHEN suffix = 'ies' THEN stem || 'i'"
             " WHEN suffix IN ('sses', 'ss') THEN stem || 'ss'"
             " WHEN suffix = 's' THEN stem ELSE w END"),
        cut("t2", "s1", ["ied", "eed", "ed", "ing"]),
        step("s2", "t2",
             "CASE WHEN suffix = 'ied' AND length(w) = 4 THEN stem || 'ie'"
             " WHEN suffix = 'ied' THEN stem || 'i'"
             f" WHEN suffix = 'eed' AND {positive} THEN stem || 'ee'"
             f" WHEN {repair} THEN stem ELSE w END",
             f", {repair} AS repair"),
        step("s3", "s2",
             r"CASE WHEN NOT repair THEN w"
             rf" WHEN {has(r'(at|bl|iz)\z', 'w')} THEN w || 'e'"
             f" WHEN {doubled} AND {last} IN ('l', 's', 'z') THEN w"
             f" WHEN {doubled} THEN left(w, length(w) - 1)"
             f" WHEN {has(v.MEASURE_ONE, 'w')} AND {has(v.SHORT_STEM, 'w')}"
             " THEN w || 'e' ELSE w END"),
        cut("t4", "s3", ["y"]),
        step("s4", "t4",
             f"CASE WHEN suffix = 'y' AND length(stem) > 1 AND {has(v.CONSONANT_END)}"
             " THEN stem || 'i' ELSE w END"),
        cut("t5", "s4", ["alli"]),
        step("s5", "t5",
             f"CASE WHEN suffix = 'alli' AND {positive} THEN stem || 'al' ELSE w END"),
        cut("t6", "s5", v.STEP_2),
        step("s6", "t6",
             f"CASE WHEN suffix <> '' AND"
             f" {has(v.MEASURE_POSITIVE, base)}"
             f" THEN stem || {lookup(v.STEP_2)} ELSE w END"),
        cut("t7", "s6", v.STEP_3),
        step("s7", "t7",
             f"CASE WHEN suffix <> '' AND {positive}"
             f" THEN stem || {lookup(v.STEP_3)} ELSE w END"),
        cut("t8", "s7", v.STEP_4),
        step("s8", "t8",
             f"CASE WHEN suffix <> '' AND {above}"
             rf" AND (suffix <> 'ion' OR {has(r'[st]\z')}) THEN stem ELSE w END"),
        cut("t9", "s8", ["e"]),
        step("s9", "t9",
             f"CASE WHEN suffix = 'e' AND ({above} OR ({has(v.MEASURE_ONE)}"
             f" AND NOT {has(v.SHORT_STEM)})) THEN stem ELSE w END"),
        cut("t10", "s9", ["l"]),
        step("s10", "t10",
             rf"CASE WHEN {has(r'll\z', 'w')} AND {above} THEN stem ELSE w END"),
        "stems AS (SELECT label, CASE WHEN length(word) <= 2 THEN word ELSE"
        f" coalesce({lookup(v.IRREGULAR_STEMS, 'word')}, regexp_replace(w, '^Y', 'y'))"
        " END AS stemmed_version FROM s10)",
    ]


# --- orders as papers ---------------------------------------------------------------

KW = """kw AS (
  SELECT l_orderkey AS paper, p_name AS label, p_name || ' ' || p_partkey AS new_label
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
KW_NULLS = """kw AS (
  SELECT l_orderkey AS paper,
         CASE WHEN p_brand <> 'Brand#12' THEN p_name || ' ' || p_partkey END AS new_label
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
KEPT = f"""kept AS (
  SELECT * FROM kw WHERE NOT coalesce(new_label IN ({_list(STOP)}), false))"""
MEMBER = "member AS (SELECT DISTINCT paper, new_label FROM kept)"
PAIRS = """pairs AS (
  SELECT a.paper AS paper_1, b.paper AS paper_2,
         count(DISTINCT a.new_label) + max((a.new_label IS NULL)::INT)
           AS shared_keywords
  FROM member a JOIN member b
    ON a.new_label IS NOT DISTINCT FROM b.new_label AND a.paper < b.paper
  GROUP BY 1, 2)"""
STRONG = "strong AS (SELECT * FROM pairs WHERE shared_keywords >= 2)"
REPORTS = """reports AS (
  SELECT o_orderkey AS report_note_number,
         strftime(o_orderdate, '%Y-%m-%d') AS published_date,
         c_name AS researcher, c_mktsegment AS new_theme,
         'Order ' || o_orderkey AS research_report_title
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
THEMED = """themed AS (
  SELECT s.*, t1.new_theme AS new_theme1, t2.new_theme AS new_theme2
  FROM strong s
  LEFT JOIN (SELECT DISTINCT report_note_number AS r, new_theme FROM reports) t1
    ON t1.r = paper_1
  LEFT JOIN (SELECT DISTINCT report_note_number AS r, new_theme FROM reports) t2
    ON t2.r = paper_2)"""
TE = f"""te AS (
  SELECT * FROM themed WHERE new_theme1 = '{THEME}' OR new_theme2 = '{THEME}')"""
TE_PARTS = (KW, KEPT, MEMBER, PAIRS, STRONG, REPORTS, THEMED, TE)

INDEX = """ends AS (
  SELECT paper_1 AS name, 0 AS t, paper_2 AS x, paper_1 AS y FROM te
  UNION ALL SELECT paper_2, 1, paper_2, paper_1 FROM te),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY t, x, y) AS rn FROM ends),
idx AS (
  SELECT row_number() OVER (ORDER BY t, x, y) AS id, name FROM firsts WHERE rn = 1)"""
NUMBERED = """numbered AS (
  SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, te.*
  FROM te JOIN idx a ON paper_1 = a.name JOIN idx b ON paper_2 = b.name)"""
DEGREE = """degrees AS (
  SELECT node, count(*) AS degree
  FROM (SELECT paper_1 AS node FROM te UNION ALL SELECT paper_2 FROM te) GROUP BY node)"""
ADJ = """adj AS (
  SELECT paper_1 AS v, paper_2 AS w FROM te UNION ALL SELECT paper_2, paper_1 FROM te)"""
COMPONENTS = """reach AS (
  SELECT DISTINCT v AS s, v FROM adj
  UNION SELECT s, w FROM reach JOIN adj ON reach.v = adj.v),
components AS (SELECT s AS node, min(v) AS component FROM reach GROUP BY s)"""
# no shortest path is longer than the largest component has edges to spare
PATHS = """longest AS (
  SELECT max(n) - 1 AS d FROM (SELECT count(*) AS n FROM components GROUP BY component)),
walk AS (
  SELECT DISTINCT v AS s, v, 0 AS d, 1.0::DOUBLE AS n FROM adj
  UNION ALL
  SELECT s, w, d + 1, sum(n) FROM walk JOIN adj ON walk.v = adj.v
  WHERE d < (SELECT d FROM longest) GROUP BY s, w, d + 1),
shortest AS (SELECT s, v, min(d) AS d, arg_min(n, d) AS n FROM walk GROUP BY s, v),
through AS (
  SELECT a.v AS node, sum(a.n * b.n / c.n) / 2 AS bc
  FROM shortest a
  JOIN shortest b ON b.s = a.v
  JOIN shortest c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d
  WHERE a.v <> a.s AND a.v <> b.v AND a.s <> b.v
  GROUP BY a.v),
scores AS (
  SELECT node, round(coalesce(bc, 0), 6) AS betweenness
  FROM components LEFT JOIN through USING (node))"""
FIRST_KEYWORDS = """ranked AS (
  SELECT paper, new_label,
         row_number() OVER (PARTITION BY paper ORDER BY new_label NULLS LAST) AS pos
  FROM kept),
first_keywords AS (
  SELECT paper AS report_note_number,
         max(CASE WHEN pos = 1 THEN new_label END) AS keyword_1,
         max(CASE WHEN pos = 2 THEN new_label END) AS keyword_2,
         max(CASE WHEN pos = 3 THEN new_label END) AS keyword_3
  FROM ranked GROUP BY paper)"""
THEME_NODES = """theme_nodes AS (
  SELECT node AS id, degree, new_theme
  FROM degrees JOIN reports ON node = report_note_number)"""
LEVELS = """cells AS (
  SELECT f.name AS id_from, t.name AS id_to,
         try_cast(nullif(regexp_extract(f.name::VARCHAR, '[0-9]+'), '') AS DOUBLE)
           AS number_from,
         try_cast(nullif(regexp_extract(t.name::VARCHAR, '[0-9]+'), '') AS DOUBLE)
           AS number_to,
         shared_keywords
  FROM numbered JOIN idx f ON src = f.id JOIN idx t ON dst = t.id),
xs AS (
  SELECT id_to, row_number() OVER (ORDER BY m NULLS LAST, id_to) AS x
  FROM (SELECT id_to, median(number_to) AS m FROM cells GROUP BY id_to)),
ys AS (
  SELECT id_from, row_number() OVER (ORDER BY m NULLS LAST, id_from) AS y0
  FROM (SELECT id_from, median(number_from) AS m FROM cells GROUP BY id_from))"""

RAW = """raw AS (
  SELECT l_orderkey, CASE WHEN p_partkey % 10 = 0 THEN upper('P' || p_partkey || ' ' || p_name)
    ELSE '(' || p_brand || ') ' || p_partkey || ' and ' || p_name || 's' END AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
catalogue AS (
  SELECT o_orderkey AS r, o_orderpriority AS theme, key_words FROM orders
  LEFT JOIN (SELECT l_orderkey, string_agg(k, '; ' ORDER BY k) AS key_words FROM raw GROUP BY 1)
    ON l_orderkey = o_orderkey),
phrases AS (
  SELECT r, theme, unnest(string_split(replace(key_words, ';', ','), ', ')) AS label FROM catalogue)"""


def _prepared(body: str) -> str:
    bare = r"regexp_replace(label, '\(.*\)', '', 'g')"
    bare = _replace(bare, [("&", " "), (":", " "), ("and", "")])
    bare = f"regexp_replace({bare}, '{SPACE}+', ' ', 'g')"
    return _with(
        RAW,
        f"c1 AS (SELECT r, theme, label, {_replace(bare, text.SYNONYMS)} AS c FROM phrases)",
        f"c2 AS (SELECT r, theme, label, {_decapitalize('c')} AS c FROM c1)",
        f"c3 AS (SELECT r, theme, label, lower({_singular('c')}) AS c FROM c2)",
        """lemmas AS (SELECT ' ' || p_partkey || ' ' || p_name AS surface,
          p_name || ' numbered ' || p_partkey AS lemma FROM part WHERE p_partkey % 3 = 0)""",
        f"""prepared AS (SELECT r, theme, label, {_replace("coalesce(lemma, c)", text.SYNONYMS_AFTER_LEMMA)} AS new_label
          FROM c3 LEFT JOIN lemmas ON c = surface)""",
        "words AS (SELECT DISTINCT new_label AS label FROM prepared)",
        *_stem_ctes(),
        """kept AS (SELECT r AS paper, p.label AS raw, p.new_label AS lemma, stemmed_version AS new_label, theme
          FROM prepared p JOIN stems s ON s.label = p.new_label)""",
        body,
    )


QUOTIENT = """elements AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS label FROM part),
lines AS (
  SELECT l_partkey AS a, lead(l_partkey) OVER w AS b,
    l_quantity = lead(l_quantity) OVER w AND l_discount = lead(l_discount) OVER w AS same
  FROM lineitem WINDOW w AS (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount)),
labels AS (SELECT label, min(id) AS first FROM elements GROUP BY label),
ties AS (
  SELECT DISTINCT x.label AS a, y.label AS b FROM lines JOIN elements x ON a = x.id JOIN elements y ON b = y.id
  WHERE same AND x.label <> y.label),
both_ways AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
tied AS (
  SELECT label AS s, label AS v FROM labels
  UNION SELECT s, b FROM tied JOIN both_ways ON v = a),
classes AS (SELECT s AS label, min(first) AS rep FROM tied JOIN labels ON v = label GROUP BY s),
placed AS (SELECT id, e.label, rep FROM elements e JOIN classes USING (label))"""

KEYWORD_PAIRS = """kwpairs AS (
  SELECT a.new_label AS keyword_1, b.new_label AS keyword_2, count(*) AS n
  FROM member a JOIN member b ON a.paper = b.paper AND a.new_label < b.new_label
  GROUP BY 1, 2 HAVING count(*) >= 2)"""
ALL_KEPT = "kept AS (SELECT * FROM kw)"

BIPARTITE = """links AS (
  SELECT DISTINCT s_name AS who, p_name AS what
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey),
tagged AS (
  SELECT DISTINCT who AS owner, 0 AS k, who AS label FROM links
  UNION ALL SELECT min(who), 1, what FROM links GROUP BY what),
named AS (
  SELECT row_number() OVER (ORDER BY owner, k, label) - 1 AS id, label, k FROM tagged)"""

# every node alone: best pairs, the mutual ones, and those that may follow
ROUND = f"""m AS (SELECT count(*)::HUGEINT AS m FROM te),
linked AS (
  SELECT least(paper_1, paper_2) AS lo, greatest(paper_1, paper_2) AS hi, count(*) AS e
  FROM te GROUP BY 1, 2),
gain AS (
  SELECT lo, hi, e, 2 * m * e - a.degree * b.degree AS g,
         (lo % 2147483647 * 715827883 + hi % 2147483647 * 433494437) % 2147483647 AS tie
  FROM linked, m, degrees a, degrees b WHERE a.node = lo AND b.node = hi),
choice AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY g DESC, tie, lo, hi) AS rn
  FROM (SELECT lo AS c, * FROM gain WHERE g > 0
        UNION ALL SELECT hi, * FROM gain WHERE g > 0)),
prefs AS (SELECT * FROM choice WHERE rn = 1),
mutual AS (SELECT lo, hi FROM prefs GROUP BY lo, hi HAVING count(*) = 2),
members AS (SELECT lo AS c, lo AS target FROM mutual UNION ALL SELECT hi, lo FROM mutual),
follower AS (
  SELECT p.c, p.e, d.degree AS a, t.target,
         length(bin(d.degree // p.e)) AS sparsity,
         (p.c % 2147483647 * 715827883) % 2147483647 % {SLICES} AS slice
  FROM prefs p JOIN members t ON t.c = CASE WHEN p.lo = p.c THEN p.hi ELSE p.lo END
  JOIN degrees d ON d.node = p.c
  WHERE p.c NOT IN (SELECT c FROM members)),
bounded AS (
  SELECT f.*,
         (SELECT sum(degree) FROM members JOIN degrees ON node = c
          WHERE members.target = f.target) AS a_pair,
         sum(a) OVER (PARTITION BY target ORDER BY sparsity, slice DESC
                      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_ahead
  FROM follower f),
merges AS (
  SELECT hi AS c, lo AS target FROM mutual
  UNION ALL
  SELECT c, target FROM bounded, m
  WHERE 2 * m * e - a * (a_pair + a_ahead - a) > 0)"""


def _te(*parts: str) -> str:
    return _with(*TE_PARTS, *parts)


ORACLES: dict[str, str] = {
    "keyword_split": """
        SELECT doc_id, array_to_string(k, '|') AS keywords, len(k)::BIGINT AS n
        FROM (SELECT doc_id, string_split(replace(text, ';', ','), ', ') AS k
              FROM documents)""",
    "csv_records": """
        SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars,
               md5(coalesce(text, '')) AS text_md5
        FROM documents""",
    "exploded": _with(PHRASES, "SELECT doc_id, label FROM phrases"),
    "flattened": r"""
        SELECT nodes, count(*) AS n_reports FROM (
          SELECT unnest(string_split(replace(line, ';', ','), ', ')) AS nodes
          FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
        GROUP BY nodes""",
    "clean_label": _clean("replace({c}, 'and', '')"),
    # twice, as neighbouring words share the sign between them
    "clean_label_whole_word": _clean(_without_and(_without_and("{c}"))),
    "synonyms": _phrase(_replace("label", PROSE_SYNONYMS)),
    "decapitalize": _phrase(_decapitalize("label")),
    "strip_punct": _phrase(
        rf"regexp_replace(label, '[^\pL\pM\p{{Nd}}\p{{Pc}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')"
    ),
    "stop_words": _phrase(
        "array_to_string(list_filter(string_split("
        f"trim(regexp_replace(label, '{SPACE}+', ' ', 'g')), ' '),"
        f" lambda w: w NOT IN ({_list(PROSE_STOP_WORDS)})), ' ')"
    ),
    "singular": _with(
        TOKENS, WORDS, f"SELECT label, {_singular('label')} AS singular FROM words"
    ),
    "lemma_join": _with(
        TOKENS,
        WORDS,
        """SELECT a.label, a.n,
                  replace(coalesce(b.label, a.label), 'emission greenhouse',
                          'greenhouse gas') AS lemma
           FROM words a LEFT JOIN words b ON a.label = b.label || 's'""",
    ),
    "stem": _with(TOKENS, WORDS, *_stem_ctes(), "SELECT * FROM stems"),
    "stem_families": _with(
        TOKENS,
        WORDS,
        *_stem_ctes(),
        """SELECT stemmed_version,
                  first(label ORDER BY n DESC, label) AS canonical,
                  count(*) AS n_labels, sum(n)::BIGINT AS n_rows
           FROM stems JOIN words USING (label) GROUP BY stemmed_version""",
    ),
    "first_theme": """
        SELECT o_orderkey AS report_note_number,
               string_split_regex(o_orderpriority, '[ ,]')[1] AS new_theme
        FROM orders""",
    "paper_number": """
        SELECT s_name, try_cast(nullif(regexp_extract(s_name, '[0-9]+'), '') AS DOUBLE)
                 AS number
        FROM supplier""",
    "keyword_counts": """
        SELECT p_name AS nodes, count(*) AS n_reports
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name""",
    "keyword_nodes": f"""
        SELECT row_number() OVER (ORDER BY nodes) - 1 AS id, nodes, n_reports,
               {_singular('lower(nodes)')} AS label
        FROM (SELECT p_name AS nodes, count(*) AS n_reports
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name)""",
    "stop_filter": _with(
        KW_NULLS, KEPT, "SELECT paper AS report_note_number, new_label FROM kept"
    ),
    "pairs": _with(
        KW, KEPT, MEMBER, PAIRS, STRONG,
        """SELECT paper_1, paper_2, a.new_label
           FROM strong JOIN member a ON a.paper = paper_1
           JOIN member b ON b.paper = paper_2 AND a.new_label = b.new_label""",
    ),
    "shared_keywords": _with(
        KW_NULLS, KEPT, MEMBER, PAIRS, STRONG,
        "SELECT paper_1, paper_2, shared_keywords::BIGINT AS shared_keywords FROM strong",
    ),
    "strong_pairs": _with(KW, KEPT, MEMBER, PAIRS, STRONG, "SELECT * FROM strong"),
    "pair_weights": _with(
        KW, KEPT, MEMBER, PAIRS,
        "SELECT shared_keywords AS weight, count(*) AS n_pairs FROM pairs GROUP BY 1",
    ),
    "edge_themes": _with(*TE_PARTS[:-1], "SELECT * FROM themed"),
    "theme_edges": _te("SELECT * FROM te"),
    "first_keywords": _with(KW, KEPT, FIRST_KEYWORDS, "SELECT * FROM first_keywords"),
    "keyword_pairs": _with(KW, ALL_KEPT, MEMBER, KEYWORD_PAIRS, "SELECT * FROM kwpairs"),
    "keyword_graph": _with(
        KW, KEPT, MEMBER, KEYWORD_PAIRS,
        "te AS (SELECT keyword_1 AS paper_1, keyword_2 AS paper_2, n FROM kwpairs)",
        INDEX, NUMBERED,
        """SELECT src, dst, paper_1 AS keyword_1, paper_2 AS keyword_2, n
           FROM numbered""",
    ),
    "node_index": _te(INDEX, "SELECT id, name FROM idx"),
    "undirected_edges": _te("SELECT * FROM te"),
    "symmetric_edges": _te(
        """SELECT paper_1, paper_2, shared_keywords FROM te
           UNION ALL SELECT paper_2, paper_1, shared_keywords FROM te"""
    ),
    "degree": _te(DEGREE, "SELECT node, degree FROM degrees"),
    "adjacency": _te(
        ADJ,
        """SELECT v AS node, row_number() OVER (PARTITION BY v ORDER BY w) - 1 AS position,
                  w AS neighbour
           FROM (SELECT DISTINCT v, w FROM adj)""",
    ),
    "named_edges": _te(
        INDEX, NUMBERED,
        """SELECT src, dst, shared_keywords, f.name AS id_from, t.name AS id_to
           FROM numbered JOIN idx f ON src = f.id JOIN idx t ON dst = t.id""",
    ),
    "node_attrs": _te(
        INDEX,
        """SELECT id, name, published_date, researcher, new_theme, research_report_title
           FROM idx LEFT JOIN reports ON name = report_note_number""",
    ),
    "node_export": _te(
        INDEX,
        """SELECT name, published_date, researcher, new_theme, research_report_title,
                  id AS Id
           FROM idx LEFT JOIN reports ON name = report_note_number""",
    ),
    "edge_export": _te(
        INDEX, NUMBERED,
        """SELECT row_number() OVER (ORDER BY paper_2, paper_1) AS row_name,
                  src AS Source, dst AS Target, shared_keywords, new_theme1, new_theme2
           FROM numbered""",
    ),
    "widget_links": _te(
        INDEX, NUMBERED,
        """SELECT src - 1 AS source, dst - 1 AS target, shared_keywords AS value
           FROM numbered""",
    ),
    "widget_json": _te(
        INDEX, NUMBERED,
        """SELECT '{"source":' || (src - 1) || ',"target":' || (dst - 1) ||
                  ',"value":' || shared_keywords || '}' AS value FROM numbered""",
    ),
    "heatmap": _te(
        INDEX, NUMBERED, LEVELS,
        """SELECT id_from, id_to, number_from, number_to, x,
                  (SELECT max(y0) FROM ys) + 1 - y0 AS y, shared_keywords
           FROM cells JOIN xs USING (id_to) JOIN ys USING (id_from)""",
    ),
    "every_nth": _te(
        INDEX, NUMBERED, LEVELS, "SELECT x, id_to FROM xs WHERE (x - 1) % 5 = 0"
    ),
    "top_paper": _te(
        DEGREE, THEME_NODES,
        """SELECT id, degree, new_theme, n FROM (
             SELECT *, count(*) OVER (PARTITION BY new_theme) AS n,
                    row_number() OVER (PARTITION BY new_theme
                                       ORDER BY degree DESC, id) AS rn
             FROM theme_nodes) WHERE rn = 1""",
    ),
    "group_size": _te(
        DEGREE, THEME_NODES,
        "SELECT new_theme, count(*) AS n FROM theme_nodes GROUP BY new_theme",
    ),
    "legend": _te(DEGREE, THEME_NODES, "SELECT DISTINCT new_theme FROM theme_nodes"),
    "bipartite_nodes": _with(
        BIPARTITE,
        """SELECT id AS Id, label AS Label,
                  CASE WHEN k = 0 THEN 'researcher' ELSE 'keyword' END AS kind
           FROM named""",
    ),
    "bipartite_edges": _with(
        BIPARTITE,
        """SELECT a.id AS Source, b.id AS Target, 'Directed' AS Type,
                  'researched' AS Kind,
                  row_number() OVER (ORDER BY who, what) - 1 AS Id,
                  NULL::VARCHAR AS Label, NULL::VARCHAR AS timeset,
                  1::BIGINT AS Weight
           FROM links JOIN named a ON a.label = who AND a.k = 0
           JOIN named b ON b.label = what AND b.k = 1""",
    ),
    "dangling": """
        SELECT DISTINCT e AS end, missing FROM (
          SELECT 'Source' AS e, o_custkey AS missing FROM orders
          UNION ALL SELECT 'Target', o_orderkey FROM orders)
        WHERE missing NOT IN (SELECT l_orderkey FROM lineitem)""",
    "prepared_keywords": _prepared(
        """SELECT paper AS report_note_number, raw AS label, lemma AS new_label, new_label AS stemmed_version,
             string_split_regex(theme, '[ ,]')[1] AS new_theme FROM kept"""
    ),
    "prepared_nodes": _with(
        RAW,
        f"""SELECT row_number() OVER (ORDER BY nodes) - 1 AS id, nodes, n_reports, {_singular('lower(nodes)')} AS label
            FROM (SELECT label AS nodes, count(*) AS n_reports FROM phrases GROUP BY label)""",
    ),
    "prepared_pairs": _prepared(
        """SELECT paper_1, paper_2, shared_keywords FROM (
             SELECT a.paper AS paper_1, b.paper AS paper_2, count(*) AS shared_keywords
             FROM (SELECT DISTINCT paper, new_label FROM kept) a
             JOIN (SELECT DISTINCT paper, new_label FROM kept) b USING (new_label)
             WHERE a.paper < b.paper GROUP BY 1, 2) WHERE shared_keywords >= 2"""
    ),
    "quotient_elements": _with(
        QUOTIENT, "SELECT rep AS id, min(label) AS label, count(*) AS n_elements FROM placed GROUP BY rep"
    ),
    "quotient_edges": _with(
        QUOTIENT,
        """SELECT x.rep AS "from", y.rep AS "to", 'Follows' AS connection_type, count(*) AS n
           FROM lines JOIN placed x ON a = x.id JOIN placed y ON b = y.id
           WHERE NOT same AND x.rep <> y.rep GROUP BY 1, 2""",
    ),
    "price_medians": """
        SELECT l_partkey, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY l_partkey""",
    # without a node its neighbours reach each other or not
    "cut_nodes": _te(
        ADJ,
        """gone AS (
  SELECT DISTINCT v AS x, w AS s, w AS v FROM adj
  UNION SELECT x, s, w FROM gone JOIN adj USING (v) WHERE w <> x)""",
        """SELECT node, count(DISTINCT piece) AS parts FROM (
             SELECT x AS node, s, min(v) AS piece FROM gone GROUP BY 1, 2)
           GROUP BY node HAVING count(DISTINCT piece) > 1""",
    ),
    "dup_labels": """
        SELECT p_name AS label, count(*) AS n FROM part
        GROUP BY p_name HAVING count(*) > 1""",
    "transpose": """
        SELECT i - 1 AS r, vec_id AS c, round(embedding[i]::DOUBLE, 6) AS v
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i
              FROM embeddings)""",
    "components": _te(ADJ, COMPONENTS, "SELECT node, component FROM components"),
    "component_numbers": _te(
        ADJ, COMPONENTS,
        """SELECT node, number AS community
           FROM components JOIN (
             SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) AS number
             FROM components GROUP BY component) USING (component)""",
    ),
    "betweenness": _te(ADJ, COMPONENTS, PATHS, "SELECT node, betweenness FROM scores"),
    "modularity": _te(
        DEGREE, ADJ, COMPONENTS,
        """SELECT round(sum(i::DOUBLE / m - (d::DOUBLE / (2 * m)) ** 2), 6) AS modularity
           FROM (SELECT component, sum(degree) AS d FROM components
                 JOIN degrees USING (node) GROUP BY component)
           JOIN (SELECT component, count(*) AS i FROM te
                 JOIN components ON node = paper_1 GROUP BY component)
             USING (component),
           (SELECT count(*) AS m FROM te)""",
    ),
    "code_length": _te(
        DEGREE, ADJ,
        "home AS (SELECT v AS node, least(v, min(w)) AS community FROM adj GROUP BY v)",
        "mass AS (SELECT community, sum(degree) AS a FROM degrees JOIN home USING (node) GROUP BY 1)",
        """gates AS (
             SELECT x.community AS one, y.community AS other FROM te
             JOIN home x ON x.node = paper_1 JOIN home y ON y.node = paper_2
             WHERE x.community <> y.community)""",
        """cuts AS (
             SELECT community, count(*) AS cut FROM (
               SELECT one AS community FROM gates UNION ALL SELECT other FROM gates) GROUP BY 1)""",
        """groups AS (
             SELECT a::DOUBLE AS a, coalesce(cut, 0)::DOUBLE AS cut
             FROM mass LEFT JOIN cuts USING (community))""",
        """terms AS (
             SELECT -2 * cut * log2(greatest(cut, 1)) + (cut + a) * log2(cut + a) AS t FROM groups
             UNION ALL SELECT -degree * log2(degree) FROM degrees
             UNION ALL SELECT sum(cut) * log2(greatest(sum(cut), 1)) FROM groups)""",
        "SELECT round(sum(t) / (SELECT sum(degree) FROM degrees), 4) AS bits FROM terms",
    ),
    "merge_round": _te(DEGREE, ROUND, "SELECT c, target FROM merges"),
    "paper_graph": _te(
        INDEX, DEGREE, ADJ, COMPONENTS, PATHS, FIRST_KEYWORDS,
        """SELECT id, name, betweenness, degree, published_date, researcher, new_theme,
                  research_report_title, keyword_1, keyword_2, keyword_3
           FROM idx JOIN scores ON scores.node = name
           JOIN degrees ON degrees.node = name
           LEFT JOIN reports ON name = reports.report_note_number
           LEFT JOIN first_keywords k ON name = k.report_note_number""",
    ),
}
