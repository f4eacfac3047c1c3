"""The registered queries in SQL, over the same tables."""

from __future__ import annotations

from quire.operators import roles
from quire.operators.metadata import LICENSES
from quire.plans.adapters import STYLES


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(column: str, pairs: dict, otherwise: str = "NULL") -> str:
    def shown(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    return f"CASE {column} " + " ".join(f"WHEN {shown(k)} THEN {shown(v)}" for k, v in pairs.items()) + f" ELSE {otherwise} END"


_HEADS = {s: level for s, (role, level) in roles.ROLES.items() if role == "heading"}
_NAMES = {s: role for s, (role, _) in roles.ROLES.items() if role != "heading"}

PARAGRAPHS = f"""
    lines AS (
        SELECT doc_id AS pkg_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS "index" FROM documents
    ),
    styled AS (
        SELECT *, {_case('(pkg_id * 31 + ("index" // 2) * 7) % 16', dict(enumerate(STYLES)))} AS style_id,
               CASE WHEN (pkg_id + "index") % 11 = 0 THEN 2 END AS outline_level
        FROM lines
    ),
    roled AS (
        SELECT *,
               CASE WHEN style_id IN {_list(_HEADS)} THEN 'heading' WHEN style_id = 'BodyText' THEN 'paragraph'
                    WHEN style_id IN {_list(_NAMES)} THEN {_case("style_id", _NAMES)}
                    WHEN outline_level IS NOT NULL THEN 'heading' WHEN style_id IS NULL THEN 'paragraph' ELSE 'unsupported' END AS role,
               CASE WHEN style_id IN {_list(_HEADS)} THEN {_case("style_id", _HEADS)} WHEN style_id = 'BodyText' OR style_id IN {_list(_NAMES)} THEN NULL
                    WHEN outline_level IS NOT NULL THEN outline_level + 1 END AS level,
               CASE WHEN style_id = 'BodyText' THEN 'consecutive' END AS rendition,
               trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' AS is_blank
        FROM styled
    ),
    numbered AS (
        SELECT *, sum(fresh) OVER (PARTITION BY pkg_id ORDER BY "index") AS island
        FROM (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY pkg_id ORDER BY "index") THEN 1 ELSE 0 END AS fresh FROM roled)
    )
"""

IDENTIFIERS = """
    named AS (
        SELECT o_custkey % 200 AS pkg_id, o_orderkey AS position,
               CASE o_orderkey % 8 WHEN 0 THEN 'isbn-13' WHEN 1 THEN 'isbn-10' WHEN 2 THEN 'issn' WHEN 3 THEN 'eissn' WHEN 4 THEN 'doi' WHEN 5 THEN 'doi' WHEN 6 THEN 'local' ELSE 'ark' END AS type,
               CASE WHEN o_orderkey % 3 = 0 THEN 'print' WHEN o_orderkey % 3 = 1 THEN 'epub' WHEN o_orderkey % 17 = 0 THEN 'scroll' END AS format,
               CASE WHEN o_orderkey % 8 = 0 THEN '978-' || lpad(o_orderkey::VARCHAR, 9, '0') || '-' || (o_orderkey % 10)
                    WHEN o_orderkey % 8 = 1 THEN lpad(o_orderkey::VARCHAR, 9, '0') || CASE WHEN o_orderkey % 11 = 10 THEN 'X' ELSE (o_orderkey % 11)::VARCHAR END
                    WHEN o_orderkey % 8 IN (2, 3) THEN lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '-' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || (o_orderkey % 10)
                    WHEN o_orderkey % 8 = 4 THEN 'https://doi.org/10.' || lpad((o_custkey % 1000)::VARCHAR, 4, '1') || '/a' || o_orderkey
                    WHEN o_orderkey % 8 = 5 THEN ' doi:10.12/' || o_orderkey
                    WHEN o_orderkey % 8 = 6 THEN '0000-0001-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '-' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || (o_orderkey % 10)
                    ELSE ' ' END AS value
        FROM orders
    ),
    compacted AS (SELECT *, upper(regexp_replace(value, '[\\s-]', '', 'g')) AS compact FROM named),
    checked AS (
        SELECT *,
               CASE WHEN (regexp_full_match(compact, '[0-9]{13}') AND list_sum([substr(compact, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END FOR i IN range(1, 14)]) % 10 = 0)
                      OR (regexp_full_match(compact, '[0-9]{9}[0-9X]') AND list_sum([(11 - i) * CASE WHEN substr(compact, i, 1) = 'X' THEN 10 ELSE try_cast(substr(compact, i, 1) AS INT) END FOR i IN range(1, 11)]) % 11 = 0)
                    THEN compact END AS isbn,
               CASE WHEN regexp_full_match(trim(value), '[0-9]{4}-?[0-9]{3}[0-9Xx]') AND list_sum([(9 - i) * CASE WHEN substr(upper(replace(trim(value), '-', '')), i, 1) = 'X' THEN 10 ELSE try_cast(substr(upper(replace(trim(value), '-', '')), i, 1) AS INT) END FOR i IN range(1, 9)]) % 11 = 0
                    THEN substr(upper(replace(trim(value), '-', '')), 1, 4) || '-' || substr(upper(replace(trim(value), '-', '')), 5, 4) END AS issn,
               CASE WHEN regexp_full_match(regexp_replace(trim(value), '^(https://doi\\.org/|http://doi\\.org/|https://dx\\.doi\\.org/|http://dx\\.doi\\.org/|doi:)', '', 'i'), '10\\.[0-9]{4,9}/\\S+')
                    THEN regexp_replace(trim(value), '^(https://doi\\.org/|http://doi\\.org/|https://dx\\.doi\\.org/|http://dx\\.doi\\.org/|doi:)', '', 'i') END AS doi
        FROM compacted
    )
"""

LISTS = """
    lines AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
    raw AS (
        SELECT l_orderkey AS pkg_id, l_linenumber::INT AS "index",
               CASE WHEN s % 9 = 8 THEN 'x1' WHEN s % 9 = 7 THEN NULL ELSE CASE WHEN p % 2 = 0 THEN '0' ELSE '' END || (s % 9) END AS raw_id,
               CASE WHEN p % 7 = 0 THEN NULL WHEN p % 7 = 1 THEN '12' ELSE (p % 4)::VARCHAR END AS raw_level
        FROM lines
    )
"""

NUMBERING = (
    LISTS
    + """,
    instances(num_id, abstract_id) AS (VALUES (1, 10), (2, 20), (3, 30), (4, 99), (5, 50)),
    levels(abstract_id, level, number_format, start, picture) AS (VALUES (10, 0, 'decimal', 1, NULL), (10, 1, 'lowerLetter', NULL, NULL), (10, 2, 'chicago', 1, NULL), (20, 0, 'bullet', NULL, NULL), (20, 1, 'bullet', NULL, '7'), (30, 1, '', 4, NULL), (30, 2, 'none', 1, NULL), (50, 0, 'upperRoman', 3, NULL), (50, 3, 'ordinal', 1, NULL)),
    overrides(num_id, level, start_override) AS (VALUES (1, 0, 5), (5, 3, 9)),
    parsed AS (SELECT *, CASE WHEN regexp_full_match(raw_id, '[0-9]+') THEN raw_id::INT END AS num_id, CASE WHEN regexp_full_match(raw_level, '[0-9]+') AND raw_level::INT BETWEEN 0 AND 8 THEN raw_level::INT END AS good FROM raw WHERE raw_id IS NOT NULL),
    hop AS (SELECT p.*, i.abstract_id, d.zero FROM parsed p LEFT JOIN instances i USING (num_id) LEFT JOIN (SELECT abstract_id, max((level = 0)::INT) AS zero FROM levels GROUP BY 1) d ON d.abstract_id = i.abstract_id),
    placed AS (SELECT *, coalesce(good, CASE WHEN zero = 1 AND (good IS NULL) THEN 0 END) AS level FROM hop),
    met AS (SELECT a.*, l.number_format, l.start, l.picture, o.start_override, coalesce(nullif(l.number_format, ''), 'decimal') AS shape FROM placed a LEFT JOIN levels l ON l.abstract_id = a.abstract_id AND l.level = a.level LEFT JOIN overrides o ON o.num_id = a.num_id AND o.level = a.level),
    kinds AS (SELECT *, CASE WHEN picture IS NOT NULL THEN 'unsupported' WHEN shape = 'bullet' THEN 'bulleted' WHEN shape = 'none' THEN 'none' WHEN shape IN ('decimal', 'decimalZero', 'upperRoman', 'lowerRoman', 'upperLetter', 'lowerLetter', 'ordinal', 'cardinalText', 'ordinalText') THEN 'ordered' ELSE 'unsupported' END AS kind FROM met),
    coded AS (SELECT *, CASE WHEN num_id IS NULL THEN 'invalid_numbering_identifier' WHEN num_id = 0 THEN NULL WHEN raw_level IS NOT NULL AND good IS NULL THEN 'invalid_numbering_level' WHEN abstract_id IS NULL THEN 'missing_numbering_instance' WHEN zero IS NULL THEN 'missing_abstract_numbering_definition' WHEN number_format IS NULL THEN 'missing_numbering_level_definition' WHEN picture IS NOT NULL THEN 'picture_bullet_not_supported' WHEN kind = 'unsupported' THEN 'unsupported_numbering_format' END AS code FROM kinds),
    resolved AS (SELECT *, CASE WHEN num_id = 0 THEN 'removed' WHEN code IN ('picture_bullet_not_supported', 'unsupported_numbering_format') THEN 'unsupported' WHEN code IS NOT NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM coded),
    shown AS (SELECT pkg_id, "index", status, code, CASE WHEN status <> 'removed' THEN level END AS level, CASE WHEN status IN ('resolved', 'unsupported') THEN shape END AS number_format, CASE WHEN status IN ('resolved', 'unsupported') THEN coalesce(start_override, start, 0) END AS start, CASE WHEN status IN ('resolved', 'unsupported') THEN kind END AS kind FROM resolved)
"""
)

PEOPLE = """
    people AS (SELECT c_custkey % 40 AS pkg_id, c_custkey AS person, [c_nationkey::BIGINT, (c_nationkey + 7)::BIGINT % 30] AS ids, c_name, c_mktsegment FROM customer),
    each AS (SELECT pkg_id, person, unnest(ids) AS affiliation_id, CAST(generate_subscripts(ids, 1) - 1 AS INT) AS position FROM people),
    affiliations AS (SELECT p.pkg_id, n_nationkey::BIGINT AS affiliation_id, n_name AS name FROM nation, (SELECT unnest(range(40)) AS pkg_id) p)
"""

NOTES = """
    notes AS (SELECT o_orderkey % 100 AS pkg_id, o_orderkey * 2 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS note_id FROM orders),
    refs AS (SELECT DISTINCT l_orderkey % 100 AS pkg_id, l_orderkey * 2 + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS note_id FROM lineitem)
"""

NESTED_NOTES = """numbered AS (SELECT o_orderkey % 97 AS pkg_id, o_orderkey AS k, o_orderpriority AS said, row_number() OVER (PARTITION BY o_orderkey % 97 ORDER BY o_orderkey) - 1 AS i FROM orders),
    aimed AS (SELECT *, list_filter([CASE WHEN k % 3 <> 0 THEN 2 * i + 1 END, CASE WHEN k % 3 <> 0 THEN 2 * i + 2 END, CASE WHEN k % 37 = 0 THEN floor((i - 1) / 2)::BIGINT END, CASE WHEN k % 53 = 0 THEN i END], lambda t: t IS NOT NULL) AS targets FROM numbered),
    edges AS MATERIALIZED (SELECT DISTINCT e.pkg_id, e.i, t.i AS target FROM (SELECT pkg_id, i, unnest(targets) AS target FROM aimed) e JOIN numbered t ON t.pkg_id = e.pkg_id AND t.i = e.target),
    steps AS (SELECT pkg_id, i, target, 1 AS depth FROM edges UNION SELECT s.pkg_id, s.i, e.target, depth + 1 FROM steps s JOIN edges e ON e.pkg_id = s.pkg_id AND e.i = s.target WHERE depth < 25)
"""

# A step of the state machine over blocks: what is open, what has been closed, and which numbers have been interrupted.
LIST_STEPS = """WITH RECURSIVE raw AS (
        SELECT l_orderkey % 499 AS pkg_id, row_number() OVER (PARTITION BY l_orderkey % 499 ORDER BY l_orderkey, l_linenumber)::INT AS "index", l_orderkey, s, p
        FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
    ), shaped AS (
        SELECT pkg_id, "index", s % 13 = 0 AS empty, (l_orderkey // 499 % 5 + CASE WHEN s % 7 = 0 THEN 1 ELSE 0 END)::INT AS num, (p // 10 % 3 + CASE WHEN s % 23 = 0 THEN 2 ELSE 0 END)::INT AS level, CASE WHEN s % 11 = 0 THEN 3 ELSE 1 END AS start,
               CASE WHEN p % 10 < 6 THEN 'item' WHEN p % 10 = 6 THEN 'candidate' WHEN p % 10 = 7 THEN CASE WHEN s % 2 = 0 THEN 'candidate' ELSE 'rejected' END WHEN p % 10 = 8 THEN 'quiet' ELSE 'other' END AS class
        FROM raw WHERE (s + p) % 40 <> 0
    ), spaced AS (
        SELECT *, num || ':' || level || ':' || start AS sig, row_number() OVER w AS n, "index" - row_number() OVER w AS region, lag(class) OVER w AS lag_class FROM shaped WINDOW w AS (PARTITION BY pkg_id ORDER BY "index")
    ), turned AS (
        SELECT *, coalesce(lag(region) OVER (PARTITION BY pkg_id ORDER BY n) <> region, false) AS gap,
               last_value(CASE WHEN class <> 'candidate' THEN {'class': class, 'region': region, 'num': num, 'level': level, 'sig': sig} END IGNORE NULLS) OVER (PARTITION BY pkg_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
               first_value(CASE WHEN class <> 'candidate' THEN {'class': class, 'region': region, 'num': num, 'level': level, 'sig': sig} END IGNORE NULLS) OVER (PARTITION BY pkg_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z
        FROM spaced
    ), weighed AS (
        SELECT *, class = 'candidate' AND coalesce(a.class = 'item' AND a.region = region, false) AS behind,
               CASE WHEN NOT coalesce(z.class = 'item' AND z.region = region, false) THEN 'end of sequence' WHEN z.num <> a.num THEN 'other number' WHEN z.level < a.level THEN 'other level, behind an inner list'
                    WHEN z.level <> a.level THEN 'other level' WHEN z.sig <> a.sig THEN 'other signature' END AS why
        FROM turned
    ), x AS MATERIALIZED (
        SELECT pkg_id, "index", n, empty, num, level, sig, gap, CASE WHEN behind AND why IS NULL THEN 'continuation' WHEN class IN ('item', 'quiet') THEN class ELSE 'other' END AS act,
               CASE WHEN behind AND (lag_class <> 'candidate' OR gap) THEN why WHEN class = 'rejected' AND lag_class = 'item' AND NOT gap THEN 'custom style' END AS reason
        FROM weighed
    ), state AS (
        SELECT pkg_id, 0::BIGINT AS n, NULL::VARCHAR AS act, 0 AS lists, []::INT[] AS interrupted, []::INT[] AS closed, NULL::INT AS root, NULL::INT AS prev, []::INT[] AS ids, []::VARCHAR[] AS closed_levels, []::INT[] AS closed_ids,
               []::STRUCT(level INT, num INT, sig VARCHAR, list INT, items INT)[] AS stack, []::VARCHAR[] AS codes
        FROM (SELECT DISTINCT pkg_id FROM x)
        UNION ALL
        SELECT pkg_id, n, act, lists + (item AND NOT same)::INT, interrupted,
               CASE WHEN jump OR split THEN ids ELSE closed END,
               CASE WHEN NOT item THEN root WHEN fresh THEN level ELSE root END, CASE WHEN item THEN level ELSE prev END,
               CASE WHEN NOT item THEN ids WHEN fresh THEN [num] ELSE list_append(ids, num) END,
               CASE WHEN NOT item THEN closed_levels WHEN fresh THEN [] ELSE closed_levels || list_transform(gone, lambda g: g.num || ':' || g.level) END,
               CASE WHEN NOT item THEN closed_ids WHEN fresh THEN [] ELSE closed_ids || list_transform(gone, lambda g: g.num) END,
               CASE WHEN NOT item THEN stack WHEN same THEN list_append(kept[:-2], {'level': level, 'num': num, 'sig': sig, 'list': kept[-1].list, 'items': kept[-1].items + 1})
                    ELSE list_append(kept, {'level': level, 'num': num, 'sig': sig, 'list': lists + 1, 'items': 1}) END,
               CASE WHEN item THEN list_filter([CASE WHEN hit THEN 'interrupted_list_continuation_not_serializable' END, CASE WHEN jump THEN 'list_level_jump_not_serializable' END, CASE WHEN split THEN 'list_root_level_decrease_split' END, CASE WHEN fresh AND level <> 0 THEN 'list_root_level_normalized' END], lambda c: c IS NOT NULL) ELSE [] END
        FROM (
            SELECT *, list_filter(staying, lambda t: NOT (t.level = level AND t.sig <> sig)) AS kept, list_filter(stack, lambda t: t.level > level OR (t.level = level AND t.sig <> sig)) AS gone,
                   len(list_filter(staying, lambda t: t.level = level AND t.sig = sig)) > 0 AS same
            FROM (
                SELECT *, CASE WHEN fresh THEN [] ELSE list_filter(stack, lambda t: t.level <= level) END AS staying,
                       item AND (list_contains(interrupted, num) OR (prev IS NOT NULL AND (list_contains(closed_levels, num || ':' || level) OR (list_contains(closed_ids, num) AND NOT list_contains(list_transform(stack, lambda t: t.num), num))))) AS hit
                FROM (
                    SELECT *, item AND (prev IS NULL OR jump OR split) AS fresh
                    FROM (
                        SELECT *, act = 'item' AS item, act = 'item' AND prev IS NOT NULL AND level > prev + 1 AS jump, act = 'item' AND prev IS NOT NULL AND level <= prev + 1 AND level < root AS split
                        FROM (
                            SELECT x.pkg_id, x.n, x.act, x.num, x.level, x.sig, s.lists, s.root,
                                   CASE WHEN stops THEN s.interrupted || CASE WHEN s.prev IS NOT NULL THEN s.ids ELSE s.closed END ELSE s.interrupted END AS interrupted,
                                   CASE WHEN stops THEN [] WHEN ends AND s.prev IS NOT NULL THEN s.ids ELSE s.closed END AS closed,
                                   CASE WHEN ends THEN NULL ELSE s.prev END AS prev, CASE WHEN ends THEN [] ELSE s.ids END AS ids, CASE WHEN ends THEN [] ELSE s.closed_levels END AS closed_levels,
                                   CASE WHEN ends THEN [] ELSE s.closed_ids END AS closed_ids, CASE WHEN ends THEN [] ELSE s.stack END AS stack
                            FROM state s JOIN (SELECT *, gap OR act = 'other' AS stops, gap OR act IN ('other', 'quiet') AS ends FROM x) x ON x.pkg_id = s.pkg_id AND x.n = s.n + 1
                        )
                    )
                )
            )
        )
    ), placed AS (
        SELECT s.pkg_id, x."index", s.n, s.act, x.empty, s.codes, s.stack[-1].list AS list_id, list_aggregate(list_transform(s.stack, lambda t: t.list || ':' || t.items), 'string_agg', '.') AS path
        FROM state s JOIN x USING (pkg_id, n) WHERE s.act IN ('item', 'continuation')
    ), numbered_parts AS (
        SELECT *, (n - max(CASE WHEN act = 'item' THEN n END) OVER (PARTITION BY pkg_id ORDER BY n))::INT AS part, starts_with(lead(path) OVER (PARTITION BY pkg_id ORDER BY n), path || '.') AS child FROM placed
    )
    SELECT pkg_id, "index", list_id, path, part, array_to_string(CASE WHEN NOT empty THEN codes WHEN part > 0 THEN list_append(codes, 'empty_list_continuation_not_serializable') WHEN child THEN list_append(codes, 'empty_parent_list_item') ELSE list_append(codes, 'empty_list_item_not_serializable') END, ',') AS codes, NULL AS reason
    FROM numbered_parts
    UNION ALL SELECT pkg_id, "index", NULL, NULL, NULL, 'ambiguous_list_continuation_not_serializable', reason FROM x WHERE reason IS NOT NULL
"""

_GROUPED = "role IN ('prose_quote', 'verse_quote', 'epigraph', 'floating_text')"


def _runs(role: str) -> str:
    return f"""WITH {PARAGRAPHS} SELECT pkg_id, min("index") AS start, count(*) AS n_paragraphs, sum(length(text))::BIGINT AS n_chars FROM numbered WHERE role = '{role}' GROUP BY pkg_id, island"""


_WORDS = """words AS (SELECT conv_id AS pkg_id, turn AS "index", unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS item FROM conversations)"""

# Blocks but headings as XML, where e has c (escaped text), is_first and is_last of its run.
_WRITTEN_BLOCKS = """                WHEN 'paragraph' THEN '<p' || CASE WHEN rendition IS NOT NULL THEN ' rend="' || rendition || '"' ELSE '' END || '>' || c || '</p>'
                WHEN 'prose_quote' THEN CASE WHEN is_first THEN '<quote>' ELSE '' END || '<p>' || c || '</p>' || CASE WHEN is_last THEN '</quote>' ELSE '' END
                WHEN 'signature' THEN CASE WHEN trim(c) <> '' THEN '<p>' || c || '</p>' END
                WHEN 'verse_quote' THEN CASE WHEN is_first THEN '<quote>' ELSE '' END || CASE WHEN trim(c) <> '' THEN '<lg><l>' || c || '</l></lg>' ELSE '' END || CASE WHEN is_last THEN '</quote>' ELSE '' END
                WHEN 'epigraph' THEN CASE WHEN is_first THEN '<epigraph>' ELSE '' END || '<p>' || c || '</p>' || CASE WHEN is_last THEN '</epigraph>' ELSE '' END
                WHEN 'floating_text' THEN CASE WHEN is_first THEN '<floatingText><body>' ELSE '' END || '<p>' || c || '</p>' || CASE WHEN is_last THEN '</body></floatingText>'"""

COLLECTIVE = """
    lowered AS (SELECT * REPLACE (CASE WHEN role = 'heading' AND level = 1 AND pkg_id % 4 <> 0 THEN 2 + pkg_id % 2 ELSE level END AS level) FROM numbered),
    counted AS (SELECT *, count(*) FILTER (role = 'heading' AND level = 2) OVER (PARTITION BY pkg_id ORDER BY "index") AS part FROM lowered),
    cut AS (SELECT *, max(part) OVER (PARTITION BY pkg_id) AS parts FROM counted)"""

ORACLES: dict[str, str] = {
    "f01_paragraph_role": f'WITH {PARAGRAPHS} SELECT pkg_id, "index", role, level, rendition FROM roled',
    "e07_style_diagnosis": f"""WITH {PARAGRAPHS} SELECT pkg_id, "index", style_id, CASE WHEN role = 'deferred' THEN 'deferred_paragraph_style' ELSE 'unsupported_paragraph_style' END AS code, 'error' AS severity FROM roled WHERE role IN ('deferred', 'unsupported')""",
    "f07_controlled_style": f"""WITH {PARAGRAPHS}, s AS (SELECT pkg_id, CASE WHEN style_id = 'TEIbiblreference' AND "index" % 3 = 0 AND "index" % 2 = 0 THEN 'valid' WHEN style_id = 'TEIbiblreference' OR "index" % 3 = 0 THEN 'invalid' ELSE 'unrelated' END AS status FROM styled) SELECT pkg_id, status, count(*) AS n FROM s GROUP BY ALL""",
    "w02_prose_quote_groups": _runs("prose_quote"),
    "w08_floating_text_groups": _runs("floating_text"),
    "w02_turn_groups": """WITH t AS (SELECT conv_id AS pkg_id, turn::INT AS "index", role, text, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS fresh FROM conversations), n AS (SELECT *, sum(fresh) OVER (PARTITION BY pkg_id ORDER BY "index") AS island FROM t) SELECT pkg_id, min("index") AS start, count(*) AS n_paragraphs, sum(length(text))::BIGINT AS n_chars FROM n WHERE role = 'assistant' GROUP BY pkg_id, island""",
    "w05_epigraph_runs": f"""WITH {PARAGRAPHS}, b AS (SELECT *, lag(role) OVER (PARTITION BY pkg_id ORDER BY "index") AS before FROM numbered) SELECT pkg_id, min("index") AS start, count(*) AS n_paragraphs, arg_min(coalesce(before, 'heading'), "index") = 'heading' AS allowed FROM b WHERE role = 'epigraph' GROUP BY pkg_id, island""",
    "w06_signature_runs": f"""WITH {PARAGRAPHS},
        runs AS (SELECT pkg_id, island, min("index") AS start, max("index") AS last, count(*) FILTER (NOT is_blank) AS n_lines FROM numbered WHERE role = 'signature' GROUP BY ALL),
        ahead AS (SELECT r.pkg_id, r.island, arg_min(CASE WHEN p.role = 'heading' AND p.level <= 2 THEN 1 ELSE 0 END, p."index") AS ends FROM runs r JOIN roled p ON p.pkg_id = r.pkg_id AND p."index" > r.last AND NOT p.is_blank GROUP BY ALL)
        SELECT r.pkg_id, r.start, r.n_lines, CASE WHEN n_lines > 2 THEN 'too_long' WHEN coalesce(ends, 1) = 0 THEN 'not_terminal' END AS refused FROM runs r LEFT JOIN ahead a ON a.pkg_id = r.pkg_id AND a.island = r.island""",
    "w10_heading_jumps": f"""WITH {PARAGRAPHS}, h AS (SELECT pkg_id, "index", level, lag(level) OVER (PARTITION BY pkg_id ORDER BY "index") AS previous FROM roled WHERE role = 'heading') SELECT * FROM h WHERE level > previous + 1""",
    "w11_sourced_quotes": f"""WITH {PARAGRAPHS},
        runs AS (SELECT pkg_id, island, role, min("index") AS start, max("index") AS last FROM numbered WHERE role IN ('prose_quote', 'verse_quote') GROUP BY ALL)
        SELECT r.pkg_id, r.role, r.start, CASE WHEN a.style_id = 'TEIbiblreference' THEN r.last + 1 END AS source_index, coalesce(a.style_id = 'TEIbiblreference', false) AND coalesce(b.style_id = 'TEIbiblreference', false) AS has_second
        FROM runs r LEFT JOIN styled a ON a.pkg_id = r.pkg_id AND a."index" = r.last + 1 LEFT JOIN styled b ON b.pkg_id = r.pkg_id AND b."index" = r.last + 2""",
    "w14_bibliography_cut": f"""WITH {PARAGRAPHS},
        first AS (SELECT pkg_id, min("index") AS opens FROM roled WHERE style_id = 'Bibliography' GROUP BY 1),
        near AS (SELECT f.pkg_id, f.opens, max(p."index") AS at FROM first f LEFT JOIN roled p ON p.pkg_id = f.pkg_id AND p."index" < f.opens AND NOT p.is_blank GROUP BY ALL),
        cuts AS (SELECT n.pkg_id, n.opens, CASE WHEN p.role = 'heading' THEN n.at ELSE n.opens END AS cut FROM near n LEFT JOIN roled p ON p.pkg_id = n.pkg_id AND p."index" = n.at)
        SELECT c.pkg_id, c.cut, count(*) FILTER (coalesce(r.style_id = 'Bibliography', false)) AS n_entries, count(*) FILTER (NOT coalesce(r.style_id = 'Bibliography', false) AND NOT r.is_blank) AS n_intruders
        FROM cuts c JOIN roled r ON r.pkg_id = c.pkg_id AND r."index" >= c.opens GROUP BY ALL""",
    "w19_contributions": f"""WITH {PARAGRAPHS}, s AS (SELECT *, sum(CASE WHEN role = 'heading' AND level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY pkg_id ORDER BY "index")::BIGINT AS segment FROM roled), m AS (SELECT *, max(segment) OVER (PARTITION BY pkg_id) AS n FROM s) SELECT pkg_id, segment, min("index") AS start, count(*) AS n_paragraphs FROM m WHERE n >= 2 GROUP BY pkg_id, segment""",
    "w20_preamble": f"""WITH {PARAGRAPHS}, l AS (SELECT *, max(CASE WHEN coalesce(style_id, '') NOT IN ('Title', 'Subtitle') THEN 1 ELSE 0 END) OVER (PARTITION BY pkg_id ORDER BY "index") AS gone FROM roled)
        SELECT pkg_id, "index", style_id, CASE WHEN gone = 1 THEN 'metadata_style_not_initial' WHEN is_blank THEN 'empty_metadata_suggestion' WHEN count(*) FILTER (NOT is_blank) OVER (PARTITION BY pkg_id, style_id, gone ORDER BY "index") > 1 THEN 'multiple_docx_' || lower(style_id) || 's' END AS code FROM l WHERE style_id IN ('Title', 'Subtitle')""",
    "t06_heading_paths": f"""WITH {PARAGRAPHS}, h AS (SELECT pkg_id, "index", level FROM roled WHERE role = 'heading') SELECT a.pkg_id, a."index", a.level, max(b."index") AS parent FROM h a LEFT JOIN h b ON b.pkg_id = a.pkg_id AND b."index" < a."index" AND b.level < a.level GROUP BY ALL""",
    "a02_editorial_summary": f"""WITH {PARAGRAPHS}, k AS (SELECT *, CASE WHEN {_GROUPED} THEN 'g' || island ELSE 'p' || "index" END AS block FROM numbered) SELECT pkg_id, """
    + ", ".join(f"count(DISTINCT block) FILTER (role = '{k}') AS n_{k}" for k in ("heading", "paragraph", "prose_quote", "verse_quote", "epigraph", "floating_text", "signature", "unsupported"))
    + ", max(level) AS deepest FROM k GROUP BY pkg_id",
    "w04_stanzas": """WITH t AS (SELECT conv_id AS pkg_id, turn AS "index", string_split(replace(text, '. ', chr(10) || chr(10)), chr(10)) AS parts FROM conversations), l AS (SELECT pkg_id, "index", unnest(parts) AS text, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS line FROM t), g AS (SELECT *, trim(text) = '' AS gap FROM l), n AS (SELECT *, sum(gap::INT) OVER (PARTITION BY pkg_id, "index" ORDER BY line) AS stanza FROM g) SELECT pkg_id, "index", min(line) AS first_line, count(*) AS n_lines FROM n WHERE NOT gap GROUP BY pkg_id, "index", stanza""",
    "j06_missing_note_targets": f"WITH {NOTES} SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.pkg_id = r.pkg_id AND n.note_id = r.note_id)",
    "j07_unreferenced_notes": f"WITH {NOTES} SELECT DISTINCT * FROM notes n WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE n.pkg_id = r.pkg_id AND n.note_id = r.note_id)",
    "j09_reachable_notes": "WITH RECURSIVE n AS (SELECT o_orderkey % 100 AS pkg_id, o_orderkey AS note_id FROM orders), r AS (SELECT pkg_id, note_id - note_id % 400 + note_id % 100 AS note_id FROM n UNION SELECT r.pkg_id, r.note_id + CASE WHEN r.note_id % 400 < 300 THEN 100 ELSE -300 END FROM r JOIN n USING (pkg_id, note_id)) SELECT DISTINCT * FROM r",
    "j10_affiliations_of_people": f"WITH {PEOPLE} SELECT e.pkg_id, e.person, e.position, e.affiliation_id, a.name FROM each e LEFT JOIN affiliations a USING (pkg_id, affiliation_id)",
    "j11_unknown_affiliations": f"WITH {PEOPLE} SELECT e.pkg_id, e.person, e.position, e.affiliation_id FROM each e ANTI JOIN affiliations a USING (pkg_id, affiliation_id)",
    "j12_unused_affiliations": f"WITH {PEOPLE} SELECT a.pkg_id, a.affiliation_id, a.name FROM affiliations a ANTI JOIN each e USING (pkg_id, affiliation_id)",
    "j13_unmatched_signatures": f"""WITH {PEOPLE}, s AS (SELECT c_custkey % 40 AS pkg_id, c_custkey AS at, CASE WHEN c_custkey % 3 = 0 THEN 'ADA  ' || c_mktsegment WHEN c_custkey % 3 = 1 THEN upper(c_name) ELSE c_name || 'x' END AS name FROM customer), known AS (SELECT pkg_id, lower(c_name) AS key FROM people UNION SELECT pkg_id, 'ada ' || lower(c_mktsegment) FROM people) SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.pkg_id = s.pkg_id AND k.key = trim(regexp_replace(lower(s.name), '\\s+', ' ', 'g')))""",
    "j04_relation_lookup": """WITH l AS (SELECT l_orderkey % 50 AS pkg_id, l_suppkey % 20 AS relation_id, l_orderkey * 10 + l_linenumber AS sequence, min(l_partkey) AS target FROM lineitem GROUP BY 1, 2, 3), f AS (SELECT *, row_number() OVER w AS at, count(*) OVER (PARTITION BY pkg_id, relation_id) > 1 AS duplicate FROM l WINDOW w AS (PARTITION BY pkg_id, relation_id ORDER BY sequence)) SELECT o_orderkey % 50 AS pkg_id, o_custkey % 25 AS relation_id, o_orderkey AS used_by, f.target, f.duplicate FROM orders LEFT JOIN f ON f.pkg_id = o_orderkey % 50 AND f.relation_id = o_custkey % 25 AND f.at = 1""",
    "l01_list_items": LIST_STEPS,
    "t10_nested_notes": f"""WITH RECURSIVE {NESTED_NOTES},
        whole AS (
            SELECT pkg_id, i, 0 AS n, '<note place="foot"><p>' || said || array_to_string(list_transform(targets, lambda t: chr(1) || t || chr(2)), '') || '</p></note>' AS xml FROM aimed
            WHERE (pkg_id, i) NOT IN (SELECT (pkg_id, i) FROM steps WHERE depth = 25)
            UNION ALL
            SELECT w.pkg_id, w.i, n + 1, replace(w.xml, chr(1) || w.first || chr(2), coalesce('<note place="foot"><p>' || t.said || array_to_string(list_transform(t.targets, lambda t: chr(1) || t || chr(2)), '') || '</p></note>', ''))
            FROM (SELECT *, regexp_extract(xml, chr(1) || '(-?[0-9]+)' || chr(2), 1) AS first FROM whole) w LEFT JOIN aimed t ON t.pkg_id = w.pkg_id AND t.i = try_cast(w.first AS BIGINT) WHERE first <> ''
        )
        SELECT pkg_id, 'footnote:' || i AS note_id, sha256(arg_max(xml, n)) AS sha256, length(arg_max(xml, n))::BIGINT AS n_chars FROM whole GROUP BY pkg_id, i""",
    "j19_note_cycles": f"""WITH RECURSIVE {NESTED_NOTES},
        body AS (SELECT pkg_id, i FROM numbered WHERE (i = 0 AND pkg_id % 2 = 0) OR i % 7 = 3),
        reached AS (SELECT pkg_id, i FROM body UNION SELECT e.pkg_id, e.target FROM reached r JOIN edges e ON e.pkg_id = r.pkg_id AND e.i = r.i),
        own AS MATERIALIZED (SELECT DISTINCT s.pkg_id, s.i, s.target FROM steps s JOIN reached r ON r.pkg_id = s.pkg_id AND r.i = s.i),
        turning AS (SELECT DISTINCT pkg_id, i FROM own WHERE i = target),
        core AS (SELECT pkg_id, i FROM turning UNION SELECT a.pkg_id, a.i FROM own a JOIN turning t ON t.pkg_id = a.pkg_id AND t.i = a.target JOIN own b ON b.pkg_id = a.pkg_id AND b.target = a.i JOIN turning u ON u.pkg_id = b.pkg_id AND u.i = b.i),
        outer_refs AS (SELECT pkg_id, i FROM body UNION SELECT e.pkg_id, e.target FROM edges e JOIN reached r ON r.pkg_id = e.pkg_id AND r.i = e.i WHERE (e.pkg_id, e.i) NOT IN (SELECT (pkg_id, i) FROM core))
        SELECT pkg_id, 'footnote:' || i AS note_id, (pkg_id, i) IN (SELECT (pkg_id, i) FROM core) AND (pkg_id, i) IN (SELECT (pkg_id, i) FROM outer_refs) AS entered FROM reached""",
    "j02_numbering": f"WITH {NUMBERING} SELECT * FROM shown",
    "l10_refused_numbering": f"""WITH {NUMBERING} SELECT pkg_id, "index", 'numbered_paragraph_not_serializable' AS code, status FROM shown WHERE status <> 'removed' AND NOT coalesce(status = 'resolved' AND kind IN ('ordered', 'bulleted') AND level IS NOT NULL, false)""",
    "j03_style_chains": """WITH RECURSIVE s AS (SELECT p_partkey % 20 AS pkg_id, p_partkey // 20 AS k, CASE WHEN (p_partkey // 20) % 9 = 0 THEN NULL WHEN (p_partkey // 20) % 13 = 1 THEN p_partkey // 20 + 1 ELSE p_partkey // 20 - 1 END AS up, CASE WHEN (p_partkey // 20) % 5 = 0 THEN 'n' || (p_partkey // 20) END AS raw_id FROM part),
        c AS (SELECT pkg_id, k, CASE WHEN raw_id IS NULL THEN up END AS up_to, raw_id, [k] AS seen, false AS cycle FROM s
              UNION ALL SELECT c.pkg_id, c.k, CASE WHEN NOT list_contains(c.seen, c.up_to) AND s.raw_id IS NULL THEN s.up END, CASE WHEN NOT list_contains(c.seen, c.up_to) THEN s.raw_id END, list_append(c.seen, c.up_to), list_contains(c.seen, c.up_to) FROM c LEFT JOIN s ON s.pkg_id = c.pkg_id AND s.k = c.up_to WHERE c.up_to IS NOT NULL AND NOT c.cycle)
        SELECT pkg_id, 's' || k AS style_id, CASE WHEN cycle THEN 'cycle' WHEN raw_id IS NOT NULL THEN 'set' ELSE 'none' END AS outcome, raw_id FROM c WHERE up_to IS NULL OR cycle""",
    "a05_distinct_diagnostics": """WITH d AS (SELECT user_id % 50 AS pkg_id, event_id AS sequence, CASE WHEN event_id % 2 = 0 THEN 'inspection' ELSE 'editorial' END AS origin, CASE WHEN event_type = 'error' THEN 'multiple_docx_titles' ELSE event_type END AS code, user_id % 3 AS "index" FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY pkg_id, origin, code, CASE WHEN code <> 'multiple_docx_titles' THEN "index" END ORDER BY sequence) AS n FROM d) SELECT pkg_id, sequence, origin, code, "index" FROM r WHERE n = 1""",
    "f18_converted": "SELECT user_id % 2000 AS pkg_id FROM events GROUP BY 1 HAVING NOT bool_or(event_id % 40 = 0)",
    "m09_identifiers": f"""WITH {IDENTIFIERS} SELECT pkg_id, position, type, CASE WHEN type = 'ark' THEN 'invalid_identifier_type' WHEN format = 'scroll' THEN 'invalid_identifier_format' WHEN trim(value) = '' THEN 'invalid_identifier_value'
        WHEN type = 'doi' AND doi IS NULL THEN 'invalid_doi' WHEN (type = 'isbn-13' AND coalesce(length(isbn), 0) <> 13) OR (type = 'isbn-10' AND coalesce(length(isbn), 0) <> 10) THEN 'invalid_isbn'
        WHEN type IN ('isbn-13', 'isbn-10') AND format IS NULL THEN 'missing_identifier_format' WHEN type IN ('issn', 'eissn') AND issn IS NULL THEN 'invalid_issn' END AS code FROM checked""",
    "a08_repeated_identifiers": f"""WITH {IDENTIFIERS}, r AS (SELECT *, row_number() OVER (PARTITION BY pkg_id, type, lower(trim(value)) ORDER BY position) AS v, row_number() OVER (PARTITION BY pkg_id, type, format ORDER BY position) AS f FROM named) SELECT pkg_id, position, 'duplicate_identifier_value' AS code FROM r WHERE v > 1 UNION ALL SELECT pkg_id, position, 'duplicate_identifier_type_format' FROM r WHERE f > 1 AND format IS NOT NULL""",
    "m10_orcid": f"""WITH {IDENTIFIERS}, d AS (SELECT position, value, replace(value, '-', '') AS digits FROM named WHERE type = 'local') SELECT position, CASE WHEN (12 - list_sum([substr(digits, i, 1)::BIGINT * (1 << (16 - i)) FOR i IN range(1, 16)]) % 11) % 11 = substr(digits, 16, 1)::INT THEN value END AS orcid FROM d""",
    "m11_doi": f"WITH {IDENTIFIERS} SELECT position, doi FROM checked WHERE type = 'doi'",
    "m12_isbn": f"WITH {IDENTIFIERS} SELECT position, isbn FROM checked WHERE type LIKE 'isbn%'",
    "m13_issn": f"WITH {IDENTIFIERS} SELECT position, issn FROM checked WHERE type LIKE '%issn'",
    "a07_repeated_ids": "SELECT c_custkey % 40 AS pkg_id, c_mktsegment AS id, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1",
    "a09_similar_keywords": """WITH k AS (SELECT p_partkey % 20 AS pkg_id, p_partkey AS position, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '  ') END AS keyword, lower(p_name) AS fold FROM part), f AS (SELECT *, first_value(keyword) OVER (PARTITION BY pkg_id, fold ORDER BY position) AS "first" FROM k) SELECT pkg_id, position, keyword, "first" FROM f WHERE keyword <> "first" """,
    "m14_licenses": f"""WITH r AS (SELECT s_suppkey AS pkg_id, {_case("s_suppkey % 9", dict(enumerate([x[0] for x in LICENSES] + ["MIT"])))} AS spdx_id, CASE WHEN s_suppkey % 4 = 0 THEN 'CC BY 4.0' END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'https://x.org' END AS url FROM supplier), l(id, n, u) AS (VALUES {", ".join(map(str, LICENSES))})
        SELECT pkg_id, spdx_id, coalesce(name, n) AS name, coalesce(url, u) AS url, CASE WHEN spdx_id IS NOT NULL AND n IS NULL THEN 'unknown_spdx_license' WHEN name <> n THEN 'license_name_differs_from_spdx' WHEN url <> u THEN 'license_url_differs_from_spdx' END AS code FROM r LEFT JOIN l ON l.id = spdx_id""",
    "m01_typed_json": """SELECT event_id, 'k' AS field, CASE WHEN event_id % 5 = 0 THEN json_extract_string(props, '$.k') END AS value, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'invalid_field_type' WHEN 2 THEN 'missing_metadata_field' WHEN 3 THEN 'invalid_field_type' ELSE 'invalid_json' END AS code FROM events""",
    "m23_partial_dates": """WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events), v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN day[1:4] WHEN 1 THEN day[1:7] WHEN 2 THEN day WHEN 3 THEN day[1:5] || '02-' || lpad((event_id % 31 + 1)::VARCHAR, 2, '0') ELSE day || 'T' END AS value FROM e) SELECT event_id, value, CASE WHEN length(value) = 10 THEN try_cast(value AS DATE) IS NOT NULL ELSE length(value) < 10 END AS valid FROM v""",
    "m22_language_tags": """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '-FR' WHEN 1 THEN ' ' || lang WHEN 2 THEN lang || '_x' ELSE lang END AS tag FROM documents) SELECT doc_id, regexp_full_match(tag, '[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*') AS valid, lower(split_part(trim(tag), '-', 1)) AS primary FROM t""".replace("AS primary", 'AS "primary"'),
    "m30_web_addresses": """WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?:', 'ftp:') WHEN 1 THEN regexp_replace(url, '//.*', '//') ELSE ' ' || url END AS url FROM pages) SELECT page_id, regexp_matches(trim(url), '^https?://[^/?#]+', 'i') AS valid FROM u""",
    "p04_strict_numbers": f"""WITH {LISTS} SELECT pkg_id, "index", raw_id IS NOT NULL AS present, coalesce(regexp_full_match(raw_id, '[0-9]+'), false) AS valid, CASE WHEN regexp_full_match(raw_id, '[0-9]+') THEN raw_id::BIGINT END AS canonical FROM raw""",
    "p09_switches": """SELECT CASE WHEN l_partkey % 7 <> 0 THEN CASE WHEN l_partkey % 5 IN (0, 1) THEN false ELSE true END END AS "on", count(*) AS n FROM lineitem GROUP BY 1""",
    "p19_affiliation_text": "SELECT n_nationkey, concat_ws(', ', n_name, CASE WHEN n_nationkey % 2 = 1 THEN 'Unit' END, CASE WHEN n_nationkey % 3 = 0 THEN 'Town' END, r_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey",
    "s26_distinct_content": "SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, first(strlen(text)) AS size, count(*) AS uses FROM documents GROUP BY 1",
    "p01_plain_text": f"""WITH {_WORDS} SELECT pkg_id, "index", string_agg(CASE item % 7 WHEN 0 THEN text WHEN 1 THEN chr(9) WHEN 2 THEN text WHEN 3 THEN CASE WHEN item % 2 = 0 THEN chr(10) ELSE '' END WHEN 4 THEN text WHEN 5 THEN '[footnote:' || item || ']' ELSE '[drawing]' END, '' ORDER BY item) AS text FROM words GROUP BY ALL""",
    "w17_spans": f"""WITH {_WORDS}, i AS (SELECT *, CASE WHEN item % 10 = 9 THEN 'tab' ELSE 'text' END AS kind, CASE WHEN (item // 3) % 2 = 0 THEN 'bold' ELSE '' END AS marks, CASE WHEN item % 12 > 9 THEN 'x' END AS link FROM words), k AS (SELECT * FROM i WHERE kind <> 'text' OR text <> ''), f AS (SELECT *, CASE WHEN kind = 'text' AND (kind, marks, coalesce(link, '')) = lag((kind, marks, coalesce(link, ''))) OVER (PARTITION BY pkg_id, "index" ORDER BY item) THEN 0 ELSE 1 END AS fresh FROM k), s AS (SELECT *, sum(fresh) OVER (PARTITION BY pkg_id, "index" ORDER BY item) AS span FROM f) SELECT pkg_id, "index", first(kind) AS kind, first(marks) AS marks, first(link) AS link, string_agg(text, '' ORDER BY item) AS text FROM s GROUP BY pkg_id, "index", span""",
    "s01_package_paragraphs": f"""WITH {PARAGRAPHS} SELECT pkg_id, "index", text, style_id, CASE WHEN role = 'heading' AND style_id NOT LIKE 'Heading%' THEN 'unsupported' WHEN role = 'heading' AND style_id IS NULL THEN 'paragraph' ELSE role END AS role, CASE WHEN style_id LIKE 'Heading%' THEN level END AS level FROM (SELECT *, coalesce(style_id, '') AS known FROM roled)""".replace("WHEN role = 'heading' AND style_id NOT LIKE 'Heading%' THEN 'unsupported'", "WHEN role = 'heading' AND known = '' THEN 'paragraph' WHEN role = 'heading' AND known NOT LIKE 'Heading%' THEN 'unsupported'"),
    "m05_record_rules": """SELECT s_suppkey AS pkg_id, 'missing_title' AS code, 'error' AS severity, 'document.title' AS path FROM supplier WHERE s_suppkey % 5 = 0
        UNION ALL SELECT s_suppkey, 'invalid_language', 'error', 'document.language' FROM supplier WHERE s_suppkey % 4 = 0
        UNION ALL SELECT s_suppkey, 'invalid_source_sha256', 'error', 'source_document.sha256' FROM supplier WHERE s_suppkey % 3 = 0
        UNION ALL SELECT s_suppkey, 'invalid_pagination', 'error', 'pagination' FROM supplier WHERE s_suppkey % 7 IN (0, 6)""",
    "m09_identifier_rules": f"""WITH {IDENTIFIERS}, n AS (SELECT *, position // 32 AS pkg, row_number() OVER (PARTITION BY position // 32 ORDER BY position) - 1 AS k FROM checked),
        e AS (SELECT pkg, k, type, row_number() OVER (PARTITION BY pkg, type, lower(trim(value)) ORDER BY k) AS v, row_number() OVER (PARTITION BY pkg, type, format ORDER BY k) AS f, trim(value) AS value, format FROM n),
        found AS (SELECT pkg, k, 'invalid_identifier_type' AS code, '.type' AS field FROM n WHERE type = 'ark' UNION ALL SELECT pkg, k, 'invalid_identifier_format', '.format' FROM n WHERE type <> 'ark' AND format = 'scroll'
            UNION ALL SELECT pkg, k, 'invalid_identifier_value', '.value' FROM n WHERE type <> 'ark' AND trim(value) = '' UNION ALL SELECT pkg, k, 'invalid_doi', '.value' FROM n WHERE type = 'doi' AND doi IS NULL
            UNION ALL SELECT pkg, k, 'invalid_isbn', '.value' FROM n WHERE type LIKE 'isbn%' AND coalesce(length(isbn), 0) <> CASE type WHEN 'isbn-13' THEN 13 ELSE 10 END
            UNION ALL SELECT pkg, k, 'missing_identifier_format', '.format' FROM n WHERE length(isbn) = CASE type WHEN 'isbn-13' THEN 13 WHEN 'isbn-10' THEN 10 END AND format IS NULL
            UNION ALL SELECT pkg, k, 'invalid_issn', '.value' FROM n WHERE type LIKE '%issn' AND issn IS NULL
            UNION ALL SELECT pkg, k, 'duplicate_identifier_value', '.value' FROM e WHERE v > 1 AND value <> '' UNION ALL SELECT pkg, k, 'duplicate_identifier_type_format', '' FROM e WHERE f > 1 AND format IS NOT NULL)
        SELECT pkg AS pkg_id, code, 'error' AS severity, 'identifiers[' || k || ']' || field AS path FROM found""",
    "m24_inconsistencies": """WITH lines AS (SELECT doc_id AS pkg_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        s AS (SELECT pkg_id, i, (pkg_id * 7 + i * i * 3) % 11 AS spot, CASE WHEN i % 3 = 0 THEN 'name  ' || pkg_id ELSE line END AS text FROM lines),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY pkg_id, spot < 5 ORDER BY i) AS run, lead(spot) OVER (PARTITION BY pkg_id ORDER BY i) AS ahead FROM s),
        r AS (SELECT pkg_id, min(i) AS start, list(nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') ORDER BY i) AS said, arg_max(coalesce(ahead, -1), i) AS ahead FROM g WHERE spot < 5 GROUP BY pkg_id, run),
        t AS (SELECT pkg_id, said[1] AS name, row_number() OVER (PARTITION BY pkg_id ORDER BY start) - 1 AS n FROM r WHERE len(said) <= 2 AND ahead IN (-1, 5, 6, 7)),
        k AS (SELECT c_custkey AS k FROM customer JOIN documents ON doc_id = c_custkey),
        found AS (SELECT k, 'metadata_source_filename_changed' AS code, 'source_document.path' AS path FROM k WHERE k % 2 = 1 UNION ALL SELECT k, 'metadata_source_changed', 'source_document.sha256' FROM k WHERE k % 3 > 0
            UNION ALL SELECT k, 'metadata_title_differs_from_docx', 'document.title' FROM k WHERE k % 5 = 0 UNION ALL SELECT k, 'metadata_subtitle_differs_from_docx', 'document.subtitle' FROM k WHERE k % 5 < 2 AND k % 3 > 0
            UNION ALL SELECT k, 'signature_contributor_not_in_metadata', 'signatures[' || n || ']' FROM k JOIN t ON pkg_id = k WHERE name IS NOT NULL AND NOT (k % 4 = 2 AND regexp_replace(name, '\\s+', ' ', 'g') = 'name ' || k))
        SELECT k AS pkg_id, code, 'warning' AS severity, path FROM found""",
    "t02_record_headers": """WITH r AS (SELECT c_custkey AS k, c_name || ' &amp; &lt;' || c_mktsegment || '&gt;' AS title FROM customer),
        p AS (SELECT *, coalesce(array_to_string([CASE WHEN (k + i) % 5 = 0 THEN '<author role="aut">' ELSE '<editor role="' || ['edt', 'trl', 'edt', 'ctb'][(k + i) % 5] || '">' END || '<persName>'
                || CASE WHEN (k + i) % 2 = 0 THEN 'Name ' || (k + i) ELSE CASE WHEN (k + i) % 3 > 0 THEN '<forename>Ada</forename>' ELSE '' END || '<surname>F&amp;' || (k + i) || '</surname>' END || '</persName>'
                || CASE (k + i) % 3 WHEN 0 THEN '<idno type="ORCID">0000-0002-1825-0097</idno>' WHEN 1 THEN '' ELSE '<affiliation>College, Letters, FR</affiliation>' END || CASE WHEN (k + i) % 3 > 0 THEN '<affiliation>Institute &amp; Co, Lyon</affiliation>' ELSE '' END
                || CASE WHEN (k + i) % 5 = 0 THEN '</author>' ELSE '</editor>' END FOR i IN range(0, k % 4)], ''), '') AS people,
            CASE k % 5 WHEN 0 THEN '<funder><orgName>Fund &lt;A&gt;</orgName><idno type="funder_registry">G' || k || '</idno></funder>' WHEN 1 THEN '<funder><orgName>B</orgName></funder>' ELSE '' END AS funders,
            CASE WHEN k % 7 = 0 THEN '<ref target="https://x.org/?a=1&amp;b=2" type="site">https://x.org/?a=1&amp;b=2</ref>' ELSE '' END || CASE WHEN k % 3 = 1 THEN '<date when="2024-05" type="publishing">2024-05</date>' ELSE '' END
                || CASE WHEN k % 3 = 0 THEN '<idno type="DOI">10.1234/a' || k || '</idno><idno type="pISSN">0378-5955</idno>' WHEN k % 9 = 4 THEN '<idno type="documentnumber">L' || k || '</idno>' WHEN k % 9 = 7 THEN '<idno type="' || CASE WHEN k % 2 = 1 THEN 'p' ELSE 'e' END || 'ISBN">978-2-07-036822-8</idno>' ELSE '' END
                || CASE k % 8 WHEN 0 THEN '<availability><licence target="https://creativecommons.org/licenses/by/4.0/">CC BY 4.0</licence></availability>' WHEN 1 THEN '<availability><p>All is free</p></availability>' WHEN 2 THEN '<availability><p>© Me</p></availability>' ELSE '' END AS details,
            CASE k % 10 WHEN 0 THEN '<series><title>S</title><editor>E</editor><biblScope unit="volume">3</biblScope><idno type="pISSN">0378-5955</idno></series>' WHEN 1 THEN '<series><title>S</title></series>' ELSE '' END || CASE WHEN k % 6 = 1 THEN '<biblScope unit="page">1-' || k || '</biblScope>' ELSE '' END AS source FROM r)
        SELECT k AS pkg_id, '<teiHeader><fileDesc><titleStmt><title type="main">' || title || '</title>' || CASE WHEN k % 3 = 0 THEN '<title type="sub">On "terms"</title>' ELSE '' END || people || funders || '</titleStmt><publicationStmt>'
            || CASE WHEN k % 4 = 0 THEN '<p></p>' ELSE '<publisher>House</publisher>' || details END || '</publicationStmt><sourceDesc><p>Conversion du fichier DOCX ' || k || '.</p></sourceDesc>' || CASE WHEN source <> '' THEN '<sourceDesc><bibl>' || source || '</bibl></sourceDesc>' ELSE '' END
            || '</fileDesc><profileDesc><langUsage>' || CASE WHEN k % 2 = 1 THEN '<language ident="fr">fr</language>' ELSE '<language ident="en-GB">en-GB</language>' END || '</langUsage>'
            || CASE WHEN k % 4 = 1 THEN '<textClass><keywords scheme="keywords" xml:lang="fr"><list><item>x &amp; y</item><item>z</item></list></keywords><keywords scheme="s" xml:lang="en"><list><item>q</item></list></keywords></textClass>' ELSE '' END || '</profileDesc></teiHeader>' AS header FROM p""",
    "t02_header_losses": """WITH p AS (SELECT c_custkey AS k, i, c_custkey + i AS n FROM customer, (SELECT unnest(range(0, 3)) AS i) WHERE i < c_custkey % 4),
        u AS (SELECT c_custkey AS k, coalesce(a0, false) AS a0, coalesce(a1, false) AS a1 FROM customer LEFT JOIN (SELECT k, bool_or(n % 3 > 0) AS a0, bool_or(n % 3 = 2) AS a1 FROM p GROUP BY k) ON k = c_custkey)
        SELECT k AS pkg_id, 'contributor_role_serialized_as_contributor' AS code, 'info' AS severity, 'contributors[' || i || '].role' AS path FROM p WHERE n % 5 = 4
        UNION ALL SELECT k, 'contributor_email_not_serialized', 'info', 'contributors[' || i || '].email' FROM p WHERE n % 4 = 0
        UNION ALL SELECT k, 'ror_not_serialized', 'warning', 'affiliations[0].ror' FROM u WHERE a0 AND k % 2 = 0 UNION ALL SELECT k, 'ror_not_serialized', 'warning', 'affiliations[1].ror' FROM u WHERE a1 AND k % 3 = 0
        UNION ALL SELECT k, 'unreferenced_affiliation_not_serialized', 'warning', 'affiliations[0].id' FROM u WHERE NOT a0 UNION ALL SELECT k, 'unreferenced_affiliation_not_serialized', 'warning', 'affiliations[1].id' FROM u WHERE NOT a1
        UNION ALL SELECT k, 'missing_publisher_for_publication_details', 'error', NULL FROM u WHERE k % 4 = 0 AND (k % 3 < 2 OR k % 7 = 0 OR k % 8 < 3)
        UNION ALL SELECT k, 'publisher_address_not_serialized', 'info', 'publication.publisher' FROM u WHERE k % 4 > 0 AND k % 6 = 0
        UNION ALL SELECT k, 'invalid_isbn', 'error', 'identifiers[0].value' FROM u WHERE k % 4 > 0 AND k % 9 = 1
        UNION ALL SELECT k, 'pagination_extent_not_serialized', 'warning', 'pagination.extent' FROM u WHERE k % 6 = 2
        UNION ALL SELECT k, 'editorial_responsibility_not_serialized', 'info', 'editorial_responsibility' FROM u WHERE k % 11 = 0""",
    "t08_body_xml": f"""WITH {PARAGRAPHS},
        e AS (SELECT *, replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS c, coalesce(last_value(CASE WHEN role = 'heading' THEN level END IGNORE NULLS) OVER (PARTITION BY pkg_id ORDER BY "index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth,
                role IS DISTINCT FROM lag(role) OVER w AS is_first, role IS DISTINCT FROM lead(role) OVER w AS is_last, lead("index") OVER w IS NULL AS is_end FROM numbered WINDOW w AS (PARTITION BY pkg_id ORDER BY "index")),
        x AS (SELECT pkg_id, "index", coalesce(CASE role
                WHEN 'heading' THEN repeat('</div>', greatest(depth - level + 1, 0)) || list_aggregate(['<div type="' || ['part', 'chapter', 'section1', 'section2', 'section3', 'section4'][n] || '">' FOR n IN CASE WHEN level > depth THEN range(depth + 1, level + 1) ELSE [level] END], 'string_agg', '') || '<head>' || c || '</head>'
{_WRITTEN_BLOCKS} ELSE '' END END, '')
                || CASE WHEN is_end THEN repeat('</div>', CASE WHEN role = 'heading' THEN level ELSE depth END) ELSE '' END AS xml FROM e),
        b AS (SELECT pkg_id, '<body>' || string_agg(xml, '' ORDER BY "index") || '</body>' AS body FROM x GROUP BY 1)
        SELECT pkg_id, sha256(body) AS sha256, length(body) AS n_chars FROM b""",
    "t07_collective_texts": f"""WITH {PARAGRAPHS}, {COLLECTIVE},
        e AS (SELECT *, replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS c, coalesce(last_value(CASE WHEN role = 'heading' THEN level END IGNORE NULLS) OVER (PARTITION BY pkg_id ORDER BY "index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth,
                role IS DISTINCT FROM lag(role) OVER w AS is_first, role IS DISTINCT FROM lead(role) OVER w AS is_last FROM cut WINDOW w AS (PARTITION BY pkg_id ORDER BY "index")),
        x AS (SELECT pkg_id, "index", part, parts, CASE WHEN role = 'heading' THEN level ELSE depth END AS left_open, role = 'heading' AND level = 2 AS opens, c,
                coalesce(CASE role WHEN 'heading' THEN repeat('</div>', greatest(depth - level + 1, 0)) || repeat('<div>', greatest(level - depth - 1, 0)) || '<div type="' || ['part', 'chapter', 'section1', 'section2', 'section3', 'section4'][level] || '">' || '<head>' || c || '</head>'
{_WRITTEN_BLOCKS} ELSE '' END END, '') AS xml FROM e),
        flat AS (SELECT pkg_id, '<body>' || string_agg(xml, '' ORDER BY "index") || repeat('</div>', arg_max(left_open, "index")) || '</body>' AS body FROM x WHERE parts < 2 GROUP BY pkg_id),
        texts AS (SELECT pkg_id, part, '<text><front><div type="titlePage"><p rend="title-main">' || any_value(c) FILTER (opens) || '</p></div></front><body>' || coalesce(string_agg(xml, '' ORDER BY "index") FILTER (NOT opens), '') || repeat('</div>', greatest(arg_max(left_open, "index") - 2, 0)) || '</body></text>' AS xml
            FROM x WHERE parts >= 2 AND part > 0 GROUP BY pkg_id, part),
        b AS (SELECT * FROM flat UNION ALL SELECT pkg_id, '<group type="article">' || string_agg(xml, '' ORDER BY part) || '</group>' FROM texts GROUP BY pkg_id)
        SELECT pkg_id, sha256(body) AS sha256, length(body) AS n_chars FROM b""",
    "t07_collective_problems": f"""WITH {PARAGRAPHS}, {COLLECTIVE},
        d AS (SELECT pkg_id, bool_or(role = 'heading' AND level = 1) AS parted, min("index") FILTER (role = 'heading' AND level = 2) AS begins, min("index") FILTER (NOT is_blank) AS lost FROM cut WHERE parts >= 2 GROUP BY pkg_id)
        SELECT pkg_id, NULL::INT AS "index", 'part_with_collective_work_not_serializable' AS code, 'error' AS severity FROM d WHERE parted
        UNION ALL SELECT pkg_id, lost, 'text_before_contributions_not_serialized', 'warning' FROM d WHERE NOT parted AND lost < begins""",
    "w21_signature_suggestions": """WITH lines AS (SELECT doc_id AS pkg_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        s AS (SELECT *, (pkg_id * 7 + i * i * 3) % 11 AS spot FROM lines),
        k AS (SELECT *, i - row_number() OVER (PARTITION BY pkg_id, spot < 5 ORDER BY i) AS run, lead(spot) OVER (PARTITION BY pkg_id ORDER BY i) AS ahead FROM s),
        r AS (SELECT pkg_id, min(i)::INT AS start, list(nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') ORDER BY i) AS said, arg_max(coalesce(ahead, -1), i) AS ahead FROM k WHERE spot < 5 GROUP BY pkg_id, run)
        SELECT pkg_id, start, said[1] AS name, said[2] AS affiliation FROM r WHERE len(said) <= 2 AND ahead IN (-1, 5, 6, 7)""",
    "e03_table_problems": """WITH c AS (SELECT l_orderkey AS pkg_id, l_linenumber::INT AS row_, l_suppkey % 3 AS col_, count(*) AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2, 3),
        w AS (SELECT *, count(*) OVER (PARTITION BY pkg_id, row_) AS width FROM c),
        g AS (SELECT pkg_id, max(row_) + 1 AS n_rows, max(width) AS n_cols, min(width) AS least, bool_or(p % 23 = 0 OR p % 29 = 0) AS merged, bool_or(p % 31 = 0) AS nested, max(row_) FILTER (p % 5 = 0) AS head, min(row_) FILTER (p % 5 <> 0) AS body, max(n) AS filled FROM w GROUP BY 1)
        SELECT pkg_id, 0 AS block, n_rows, n_cols, CASE WHEN merged THEN 'merged_table_cells_not_serializable' WHEN nested THEN 'nested_table_not_serializable' WHEN least < n_cols THEN 'irregular_table_not_serializable' WHEN head > body THEN 'invalid_table_header_not_serializable' WHEN filled > 1 THEN 'multiple_paragraph_table_cell_not_serializable' END AS code FROM g""",
    "w12_figures": """WITH l AS (SELECT doc_id AS pkg_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS i FROM documents),
        s AS (SELECT *, (pkg_id + i) % 6 AS at_, CASE WHEN (pkg_id + i) % 6 = 0 AND pkg_id % 3 = 0 THEN 'T' WHEN (pkg_id + i) % 6 = 2 THEN CASE WHEN pkg_id % 2 = 0 THEN 'N' ELSE 'C' END WHEN (pkg_id + i) % 6 = 3 AND pkg_id % 5 > 0 THEN 'N' WHEN (pkg_id + i) % 6 IN (3, 4) THEN 'R' END AS style FROM l),
        n AS (SELECT *, coalesce(lag(style) OVER w, '') AS p, coalesce(lead(style) OVER w, '') AS a, coalesce(lead(style, 2) OVER w, '') AS b, coalesce(lead(style, 3) OVER w, '') AS c FROM s WINDOW w AS (PARTITION BY pkg_id ORDER BY i)),
        f AS (SELECT *, a = 'N' AND b = 'N' AND p <> 'T' AS pair FROM n WHERE at_ = 1),
        k AS (SELECT *, CASE WHEN pair THEN 2 WHEN a IN ('C', 'N') THEN 1 ELSE 0 END AS last FROM f)
        SELECT pkg_id, i AS "index", CASE WHEN p = 'T' THEN i - 1 WHEN pair THEN i + 1 END AS title, CASE WHEN last > 0 THEN i + last END AS caption, CASE WHEN (CASE last WHEN 2 THEN c WHEN 1 THEN b ELSE a END) = 'R' THEN i + last + 1 END AS credits FROM k""",
}
