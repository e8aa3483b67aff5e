"""The registered queries in SQL for another engine, which has neither lookaround nor backreferences.

The texts of the patterns are shared with the engine; how sentences are cut, how
lists are followed and how decisions combine is said anew here, with windows
and placeholders.
"""

from __future__ import annotations

from lexfold.functions import vocabulary as v
from lexfold.functions.text import BLANK, QUOTES
from lexfold.sources.policy_corpus import EXCERPTS, PINS, policy_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def units(e: str) -> str:
    return f"(length({e}) + length(regexp_replace({e}, '[^\\x{{10000}}-\\x{{10ffff}}]+', '', 'g')))"


def trim(e: str) -> str:
    return f"regexp_replace({e}, {q(f'^{BLANK}+|{BLANK}+$')}, '', 'g')"


def copy(e: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({e}, {q(BLANK)}, ' ', 'g'), '[\\x{{10000}}-\\x{{10ffff}}]', '~~', 'g'), {q('[^' + chr(92) + 'x{0}-' + chr(92) + 'x{7f}' + QUOTES + ']')}, '~', 'g')"


def clip(e: str, most: int) -> str:
    """The first units of ``e``: the longest beginning that fits, and U+FFFD for half a character."""
    fits = f"list_max(list_filter(range(1, {most}), lambda k: {units(f'substr({e}, 1, k)')} <= {most - 1}))"
    exact = f"substr({e}, 1, {fits}) || CASE WHEN {units(f'substr({e}, 1, {fits})')} < {most - 1} THEN chr(65533) ELSE '' END"
    return f"CASE WHEN {units(e)} > {most} THEN CASE WHEN {units(e)} = length({e}) THEN substr({e}, 1, {most - 1}) ELSE {exact} END || '…' ELSE {e} END"


def first_marker(e: str) -> str:
    """The first of the block markers that stands whole within the window of units at the text's beginning."""
    within = lambda m: f"contains(lower({e}), {q(m)}) AND {units(f'regexp_extract({e}, {q(f'(?is)^(.*?){m}')}, 1)')} + {len(m)} <= {v.MARKER_WINDOW}"
    return f"coalesce({', '.join(f'CASE WHEN {within(m)} THEN {q(m)} END' for m in v.BLOCK_MARKERS)})"


def rx(e: str, patterns, cased: bool = False) -> str:
    one = patterns if isinstance(patterns, str) else "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({e}, {q(('' if cased else '(?i)') + one)})"


def before(e: str, p: str) -> str:
    return f"regexp_extract({e}, {q(f'(?i)^([{chr(92)}s{chr(92)}S]*?)(?:{p})')}, 1)"


def after(e: str, p: str) -> str:
    return f"regexp_extract({e}, {q(f'(?i)^[{chr(92)}s{chr(92)}S]*?(?:{p})([{chr(92)}s{chr(92)}S]*)$')}, 1)"


def spans_sql(source: str, keep: str) -> str:
    """CTEs up to spans(rid, keep..., sentence, index, lead_in) from a SELECT of (keep..., text)."""
    short = "|".join(a.replace(".", r"[.\x02]") for a in v.ABBREVIATIONS)
    body = "substr(line, length(mk) + 1)"
    for _ in range(2):  # all points after a short word; the second time for words that have one inside
        wrapped = f"regexp_replace({body}, {q(rf'(^|[^A-Za-z.\x02])((?:[A-Za-z]|(?i:{short})))(\.+)')}, '\\1\\2' || chr(3) || '\\3' || chr(4), 'g')"
        body = f"list_aggregate(list_transform(string_split({wrapped}, chr(3)), lambda x, i: CASE WHEN i = 1 THEN x ELSE repeat(chr(2), instr(x, chr(4)) - 1) || substr(x, instr(x, chr(4)) + 1) END), 'string_agg', '')"
    body = f"regexp_replace({body}, {q(rf'\.({BLANK}*[a-z])')}, chr(2) || '\\1', 'g')"
    for _ in range(2):
        body = f"regexp_replace({body}, '([0-9])\\.([0-9])', '\\1' || chr(2) || '\\2', 'g')"
    body = f"regexp_replace({body}, {q(rf'([.!?][.!?\x02{v.CLOSERS}]*)')}, '\\1' || chr(1), 'g')"
    marker = rf"^{BLANK}*(?:[{v.BULLETS}]|[-–—*]|\(?[0-9]{{1,3}}[.)]){BLANK}+"
    return f"""
        src AS (SELECT *, row_number() OVER () AS rid FROM ({source})),
        lines AS (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM src),
        marked AS (SELECT *, regexp_extract(line, {q(marker)}) AS mk, coalesce(sum({units('line')} + 1) OVER (PARTITION BY rid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM lines),
        cut AS (SELECT rid, n, mk, off, string_split(replace({body}, chr(2), '.'), chr(1)) AS p FROM marked),
        pieces AS (SELECT rid, n, mk, off, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM cut),
        placed AS (SELECT rid, n, mk, k, {trim('piece')} AS sentence,
                          off + {units('mk')} + coalesce(sum({units('piece')}) OVER (PARTITION BY rid, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {units(f"regexp_extract(piece, {q(f'^{BLANK}+')})")} AS idx
                   FROM pieces),
        said AS (SELECT * FROM placed WHERE sentence <> ''),
        stems AS (SELECT rid, n, mk <> '' AS item, arg_max(sentence, k) AS last FROM said GROUP BY ALL),
        grouped AS (SELECT *, CASE WHEN last LIKE '%:' THEN last END AS stem, sum(CASE WHEN item THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY n) AS grp FROM stems),
        led AS (SELECT rid, n, item, first_value(stem IGNORE NULLS) OVER (PARTITION BY rid, grp ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead FROM grouped),
        spans AS (SELECT s.rid, {keep}, sentence, idx::BIGINT AS "index", CASE WHEN item THEN lead END AS lead_in FROM said AS s JOIN led AS d USING (rid, n) JOIN src USING (rid))"""


def shares_at_all(e: str) -> str:
    start, name = v.SHARED_WITH_CASED
    masked = f"regexp_replace({e}, {q(rf'(\b(?:shared?|disclosed?)\s+with\s+)(?:{v.NOT_RECIPIENTS})\b')}, '\\1_', 'g')"
    return f"({rx(e, v.SHARING_POSITIVE)} OR {rx(masked, start + name, cased=True)})"


def discloses(e: str) -> str:
    place = [f"CASE WHEN {rx(e, p)} THEN length({before(e, p)}) END" for p in v.SHARING_DENIED]
    least = f"least({', '.join(place)})"
    tail = "CASE " + " ".join(f"WHEN {x} = {least} THEN {after(e, p)}" for p, x in zip(v.SHARING_DENIED, place)) + " ELSE '' END"
    contrast = after(f"({tail})", v.SHARING_CONTRAST)
    return f"""(CASE WHEN NOT {rx(e, v.SHARING_DENIED)} THEN {shares_at_all(e)}
        WHEN {rx(f'({tail})', v.SHARING_EXCEPTION)} THEN {rx(e, v.SHARING_DENIED_DATA)} OR {shares_at_all(e)}
        WHEN {rx(f'({tail})', v.SHARING_CONTRAST)} THEN {shares_at_all(contrast)} ELSE false END)"""


def sells(e: str) -> str:
    head, tail = before(e, v.SALE_CONTRAST), after(e, v.SALE_CONTRAST)
    return f"""(NOT {rx(e, v.SALE_RIGHTS)} AND (
        {rx(e, v.SALE_STRONG)} AND NOT ({rx(e, v.SALE_STRONG_DENIED)} AND NOT {rx(e, v.SALE_CONTRAST)})
        OR {rx(e, v.SALE_POSITIVE)} AND NOT {rx(e, v.SALE_DENIED)}
        OR {rx(e, v.SALE_CONTRAST)} AND ({rx(head, v.SALE_DENIED)} OR {rx(head, v.SALE_QUALIFIED_DENIAL)}) AND NOT {rx(tail, v.SALE_TAIL_DENIED)}
           AND ({rx(tail, v.SALE_POSITIVE)} OR {rx(tail, v.SALE_STRONG)} OR {rx(head, v.SALE_QUALIFIED_DENIAL)} AND {rx(tail, v.SALE_DISCLOSURE)})))"""


#: For each category: the decision over s (the copy), bare (without quotes around words) and l (the lead-in's copy).
DECISIONS = {
    "data_collection": f"CASE WHEN {rx('s', v.COLLECTION_DENIED)} THEN NULL WHEN {rx('s', v.SENSITIVE)} OR {rx('s', v.SENSITIVE_CASED, cased=True)} THEN 'warning' WHEN {rx('s', v.ORDINARY)} THEN 'info' END",
    "data_sale": f"CASE WHEN {sells('bare')} THEN '' END",
    "third_party_sharing": "CASE WHEN l IS NOT NULL AND NOT lead_says THEN CASE WHEN carried_says THEN '' END WHEN says THEN '' END",
    "retention": f"CASE WHEN NOT {rx('s', v.RETENTION_CONTEXT)} THEN NULL WHEN {rx('s', v.RETENTION_VAGUE)} THEN 'caution' WHEN {rx('s', v.RETENTION_SPECIFIC)} THEN 'info' END",
    "arbitration": f"CASE WHEN {rx('s', v.ARBITRATION)} THEN '' END",
    "class_action_waiver": f"CASE WHEN {rx('s', v.CLASS_WAIVER)} THEN '' END",
}


def matches_sql(source: str, keep: str = "doc_id") -> str:
    """CTEs up to matches(rid, keep..., ord, category, base, label, sentence, index, severity, decision)."""
    rows = ", ".join(f"({k}, {q(c)}, {q(label)}, {q(s)})" for k, (c, label, s) in enumerate(v.CATEGORIES))
    each = " UNION ALL ".join(f"SELECT rid, {keep}, {k} AS ord, sentence, \"index\", {DECISIONS[c]} AS decision FROM judged" for k, (c, _, _) in enumerate(v.CATEGORIES))
    bare = f"regexp_replace(s, {q(v.QUOTED_WORD)}, '\\1', 'g')"
    lead_says = f"CASE WHEN l IS NOT NULL THEN {discloses('l')} END"
    carried = f"CASE WHEN l IS NOT NULL THEN {discloses('carried')} END"
    return f"""{spans_sql(source, keep)},
        categories(ord, category, label, base) AS (VALUES {rows}),
        copies AS (SELECT *, {copy('sentence')} AS s, {copy('lead_in')} AS l FROM spans),
        bared AS (SELECT *, {bare} AS bare, l || ' ' || s AS carried FROM copies),
        judged AS (SELECT *, {discloses('s')} AS says, {lead_says} AS lead_says, {carried} AS carried_says FROM bared),
        decided AS ({each}),
        matches AS (SELECT d.*, category, label, base, nullif(decision, '') AS severity FROM decided AS d JOIN categories USING (ord) WHERE decision IS NOT NULL)"""


_POLICY = matches_sql(policy_sql())
#: A row for each document and category with its matches in order.
_RESULTS = f"""{_POLICY},
        firsts AS (SELECT *, row_number() OVER (PARTITION BY rid, ord ORDER BY CASE WHEN category = 'data_collection' AND severity = 'warning' THEN 0 ELSE 1 END, "index") AS nth FROM matches),
        grid AS (SELECT s.rid, s.doc_id, c.*, count(m.rid) AS n, max(CASE WHEN nth = 1 THEN m.sentence END) AS first_sentence,
                        greatest(list_position(['info', 'caution', 'warning'], c.base), coalesce(max(list_position(['info', 'caution', 'warning'], coalesce(m.severity, c.base))), 0)) AS rank
                 FROM src AS s CROSS JOIN categories AS c LEFT JOIN firsts AS m ON m.rid = s.rid AND m.ord = c.ord GROUP BY s.rid, s.doc_id, c.ord, c.category, c.label, c.base)"""


def _missed() -> str:
    each = []
    for k, (name, words, categories) in enumerate(v.MISS_FAMILIES):
        said = " OR ".join(f"contains(lower(sentence), {q(w)})" for w in words)
        ords = ", ".join(str(i) for i, (c, _, _) in enumerate(v.CATEGORIES) if c in categories)
        each.append(f"""SELECT p.rid, p.doc_id, p."index", {k}::BIGINT AS family_ord, {q(name)} AS family, {clip('p.sentence', v.MISS_CLIP)} AS sentence FROM spans AS p
                        WHERE ({said}) AND NOT EXISTS (SELECT 1 FROM matches AS m WHERE m.rid = p.rid AND m."index" = p."index" AND m.ord IN ({ords}))""")
    return f"{_POLICY}, missed AS ({' UNION ALL '.join(each)})"


def _page_text() -> str:
    s = "regexp_replace(coalesce(html, ''), '<!--[\\s\\S]*?-->', ' ', 'g')"
    for t in v.DROPPED_ELEMENTS:
        s = f"regexp_replace({s}, '(?i)<{t}\\b[\\s\\S]*?</{t}\\s*>', ' ', 'g')"
    t = "coalesce(nullif(regexp_extract(s, '(?i)<main\\b[\\s\\S]*?</main\\s*>'), ''), nullif(regexp_extract(s, '(?i)<article\\b[\\s\\S]*?</article\\s*>'), ''), nullif(regexp_extract(s, '(?i)<[a-z]+\\b[^>]*\\brole=[\"'']?main[\"'']?[^>]*>[\\s\\S]*'), ''), s)"
    for e in v.CHROME_ELEMENTS:
        t = f"regexp_replace({t}, '(?i)<{e}\\b[\\s\\S]*?</{e}\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<(?:{'|'.join(v.BREAK_ELEMENTS)})\\s*/?>', chr(10), 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?i)</?(?:{v.LINE_ELEMENTS})\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    for name, char in sorted(v.ENTITIES.items(), key=lambda x: x[0] == "amp"):
        t = f"regexp_replace({t}, '(?i)&{name};', {q(char)}, 'g')"
    return f"""stripped AS (SELECT page_id, {s} AS s FROM pages),
        shown AS (SELECT page_id, {t} AS t FROM stripped),
        raw AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM shown),
        tidy AS (SELECT page_id, n, {trim("regexp_replace(line, '[ " + chr(92) + "t" + chr(92) + "x{a0}]+', ' ', 'g')")} AS line FROM raw),
        squeezed AS (SELECT page_id, {trim("regexp_replace(string_agg(line, chr(10) ORDER BY n), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS t FROM tidy GROUP BY page_id),
        again AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM squeezed),
        counted AS (SELECT *, row_number() OVER (PARTITION BY page_id, line ORDER BY n) AS nth FROM again),
        page_texts AS (SELECT page_id, {trim("regexp_replace(string_agg(line, chr(10) ORDER BY n), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS text FROM counted WHERE {units('line')} < {v.PARAGRAPH_LENGTH} OR nth = 1 GROUP BY page_id)"""


def _clean(source: str = "documents") -> str:
    """CTEs over lines of ``source`` (doc_id, text): collapsed, unheaded, rejoined, deduped."""
    collapsed = f"trim(regexp_replace(line, {q(BLANK + '+')}, ' ', 'g'))"
    return f"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {source}),
        collapsed AS (SELECT doc_id, pos::BIGINT AS pos, {collapsed} AS line FROM l0 WHERE {collapsed} <> ''),
        heads AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS c FROM collapsed),
        unheaded AS (SELECT doc_id, pos, line FROM heads WHERE NOT ({units('line')} < {v.HEADING_LENGTH} AND NOT regexp_matches(line, '[.?!]$') AND c >= 2)),
        lagged AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM unheaded),
        runs AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND NOT regexp_matches(prev, '[.?!:]$') AND regexp_matches(line, '^[a-z]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM lagged),
        rejoined AS (SELECT doc_id, min(pos) AS pos, string_agg(line, ' ' ORDER BY pos) AS line FROM runs GROUP BY doc_id, run),
        nths AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS c, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM rejoined),
        deduped AS (SELECT doc_id, pos, line FROM nths WHERE NOT ({units('line')} >= {v.PARAGRAPH_LENGTH} OR c >= {v.LABEL_REPEATS}) OR nth = 1)"""


def _tree() -> str:
    """CTEs up to scanned(page_id, title, text, status): what the pages' fixed shape, one article after navigation, makes of the tree's rules."""
    plain = lambda e: f"regexp_replace(replace(regexp_replace({e}, '<[^>]*>', '', 'g'), '&quot;', chr(34)), '&amp;?', '&', 'g')"
    shown = f"""regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<article>(.*?)</article>', 1), '(?is)<h1>.*?</h1>', '', 'g'), '(?i)</?(p|br|div|ul|li)\\b[^>]*>', chr(10), 'g')"""
    return f"""shown AS (SELECT page_id AS doc_id, {trim(plain("regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1)"))} AS title, {plain(shown)} AS text FROM pages),
        {_clean('shown')},
        whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM deduped GROUP BY doc_id),
        scanned AS (SELECT doc_id AS page_id, title, coalesce(body, '') AS text, CASE WHEN {units("coalesce(body, '')")} < {v.THIN_LENGTH} THEN 'thin' ELSE 'results' END AS status FROM shown LEFT JOIN whole USING (doc_id))"""


_VALUES = lambda rows: ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else q(x) for x in r) + ")" for r in rows)
_WIDTH = max(len(c) for c, _, _ in v.CATEGORIES) + 2
#: Addresses and titles that exercise the page predicates, made from the pages' own.
PAGE_VARIANTS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || 'privacy-policy' WHEN 1 THEN url || 'Data_Protection' WHEN 2 THEN url || '?gdpr' WHEN 3 THEN NULL WHEN 4 THEN 'https://www.Big-Shop.co.uk/x' ELSE url END AS url, CASE page_id % 4 WHEN 0 THEN 'Our Privacy  Notice' WHEN 1 THEN 'Cookie policy' WHEN 2 THEN NULL ELSE 'Home' END AS title FROM pages"

ORACLE_SQL: dict[str, str] = {
    "segment_documents": f"WITH {spans_sql('SELECT doc_id, text FROM documents', 'doc_id')} SELECT doc_id, sentence, \"index\", lead_in FROM spans",
    "segment_conversations": f"WITH {spans_sql('SELECT conv_id, turn, text FROM conversations', 'conv_id, turn')} SELECT conv_id, turn, sentence, \"index\", lead_in FROM spans",
    "segment_policy": f"WITH {spans_sql(policy_sql(), 'doc_id')} SELECT doc_id, sentence, \"index\", lead_in FROM spans",
    **{f"detect_{c}": f"WITH {_POLICY} SELECT doc_id, sentence, \"index\", severity FROM matches WHERE ord = {k}" for k, (c, _, _) in enumerate(v.CATEGORIES)},
    "results_by_category": f"WITH {_RESULTS} SELECT doc_id, ord::BIGINT AS ord, category, label, base AS base_severity, n > 0 AS found, n AS n_matches FROM grid",
    "readout_cards": f"WITH {_RESULTS} SELECT doc_id, category, label, CASE WHEN n > 0 THEN 'Found' ELSE 'Not found' END AS found_label, CASE WHEN n > 0 THEN ['Info', 'Caution', 'Warning'][rank] END AS card_severity, CASE WHEN n > 0 THEN n || ' matched sentence(s)' END AS match_count_text FROM grid",
    "readout_quotes": f"WITH {_RESULTS} SELECT doc_id, category, (nth - 1)::BIGINT AS nth, sentence, CASE severity WHEN 'info' THEN 'Info' WHEN 'caution' THEN 'Caution' WHEN 'warning' THEN 'Warning' END AS badge FROM firsts",
    "eval_counts": f"WITH {_RESULTS} SELECT doc_id, category, n AS matches, {clip('first_sentence', v.SAMPLE_CLIP)} AS sample FROM grid",
    "eval_pivot": f"WITH {_RESULTS} SELECT doc_id, {', '.join(f'sum(CASE WHEN ord = {k} THEN n ELSE 0 END)::BIGINT AS {c}' for k, (c, _, _) in enumerate(v.CATEGORIES))} FROM grid GROUP BY rid, doc_id",
    "eval_totals": f"WITH {_RESULTS} SELECT category, sum(n)::BIGINT AS matches, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS documents_found, (count(*) / CASE WHEN category IS NULL THEN {len(v.CATEGORIES)} ELSE 1 END)::BIGINT AS documents FROM grid GROUP BY ROLLUP (category)",
    "misses": f"WITH {_missed()} SELECT doc_id, \"index\", family_ord, family, sentence FROM missed",
    "miss_counts": f"WITH {_missed()} SELECT s.doc_id, count(m.rid) AS misses FROM src AS s LEFT JOIN missed AS m USING (rid) GROUP BY s.rid, s.doc_id",
    "misses_by_family": f"WITH {_missed()} SELECT family, count(*) AS misses, count(DISTINCT doc_id) AS documents FROM missed GROUP BY family",
    "category_found_rate": f"WITH {_RESULTS} SELECT l.toxic, category, count(*) AS documents, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS documents_found FROM grid JOIN labels AS l USING (doc_id) GROUP BY l.toxic, category",
    "page_text": f"WITH {_page_text()} SELECT page_id, text FROM page_texts",
    "page_gate": f"""WITH {_page_text()}, g AS (SELECT page_id, text, {units('text')} AS n FROM page_texts),
        k AS (SELECT *, {first_marker('text')} AS marker FROM g)
        SELECT page_id, n::BIGINT AS n_units, CASE WHEN n < {v.THIN_LENGTH} THEN 'thin' ELSE 'results' END AS usable, CASE WHEN n < {v.FETCH_LENGTH} THEN 'short' WHEN marker IS NOT NULL AND n < {v.MARKER_LENGTH} THEN 'blocked' ELSE 'ok' END AS status, marker FROM k""",
    "page_name": f"""WITH p AS ({PAGE_VARIANTS}), h AS (SELECT *, lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM p)
        SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN nullif(regexp_replace(regexp_replace(string_split(regexp_replace(host, '^www\\.', ''), '.')[1], '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), '') END AS name FROM h""",
    "policy_hint": f"WITH p AS ({PAGE_VARIANTS}) SELECT page_id, regexp_matches(coalesce(url, ''), {q('(?i)' + v.POLICY_URL)}) OR regexp_matches(coalesce(title, ''), {q('(?i)' + v.POLICY_TITLE)}) AS hint, {' OR '.join(f'contains(coalesce(url, chr(32)), {q(s)})' for s in v.TOOLBAR_SIGNALS)} AS toolbar FROM p",
    "lines_without_headings": f"WITH {_clean()} SELECT doc_id, pos, line FROM unheaded",
    "lines_rejoined": f"WITH {_clean()} SELECT doc_id, pos, line FROM rejoined",
    "lines_cleaned": f"WITH {_clean()} SELECT doc_id, pos, line FROM deduped",
    "report_lines": f"""WITH {_RESULTS} SELECT doc_id, ord::BIGINT + 1 AS pos, '  ' || rpad(category, {max(len(c) for c, _, _ in v.CATEGORIES) + 2}, ' ') || CASE WHEN n > 999 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, ' ') END
        || coalesce('  e.g. "' || {clip('first_sentence', v.SAMPLE_CLIP)} || '"', '') AS line FROM grid UNION ALL SELECT doc_id, 0, '=== ' || doc_id || ' ===' FROM src""",
    "miss_lines": f"""WITH {_missed()}, per AS (SELECT s.rid, s.doc_id, count(m.rid) AS n FROM src AS s LEFT JOIN missed AS m USING (rid) GROUP BY s.rid, s.doc_id)
        SELECT doc_id, row_number() OVER (PARTITION BY rid ORDER BY "index", family_ord) AS pos, '  [' || family || '] "' || sentence || '"' AS line FROM missed
        UNION ALL SELECT doc_id, 0, '=== ' || doc_id || ' — ' || n || CASE WHEN n = 1 THEN ' candidate miss ===' ELSE ' candidate misses ===' END FROM per""",
    "report_totals": f"""WITH {_RESULTS}, t AS (SELECT ord, category, sum(n)::BIGINT::VARCHAR AS n FROM grid GROUP BY ord, category)
        SELECT ord::BIGINT + 1 AS pos, '  ' || rpad(category, {_WIDTH}, ' ') || CASE WHEN length(n) > 4 THEN n ELSE lpad(n, 4, ' ') END AS line FROM t UNION ALL SELECT 0, {q(v.TOTALS_HEAD)}""",
    "miss_total": f"WITH {_missed()}, n AS (SELECT (SELECT count(*) FROM missed) AS misses, (SELECT count(*) FROM src) AS documents) SELECT misses, documents, misses || ' candidate misses across ' || documents || ' documents.' AS line FROM n",
    "corpus_counts": """WITH n AS (SELECT count(*) FILTER (WHERE doc_id % 3 = 0) AS excerpts, count(*) FILTER (WHERE doc_id % 3 <> 0) AS "local" FROM documents)
        SELECT excerpts, "local", 'eval — ' || excerpts || ' committed excerpt(s), ' || "local" || CASE WHEN "local" = 1 THEN ' local policy' ELSE ' local policies' END AS line FROM n""",
    "corpus_pins": f"""WITH {matches_sql(f"SELECT * FROM (VALUES {_VALUES(EXCERPTS)}) AS e(name, text)", "name")}, pins(name, category, must, needle) AS (VALUES {_VALUES(PINS)})
        SELECT name, category, must, needle, must = EXISTS (SELECT 1 FROM matches AS m WHERE m.name = pins.name AND m.category = pins.category AND contains(m.sentence, needle)) AS holds FROM pins""",
    "page_document": f"WITH {_tree()} SELECT page_id, title, text, status FROM scanned",
    "page_scan": f"""WITH {_tree()} SELECT page_id, status, CASE status WHEN 'thin' THEN {q(v.THIN_NOTE)} ELSE replace(replace({q(v.SCANNED)}, '{{title}}', coalesce(nullif(title, ''), {q(v.NO_TITLE)})), '{{count}}', format('{{:,}}', {units('text')})) END AS message FROM scanned""",
    "page_fetched": f"""WITH {_page_text()}, g AS (SELECT page_id, text, {units('text')} AS n FROM page_texts),
        k AS (SELECT *, {first_marker('text')} AS marker FROM g),
        h AS (SELECT page_id, url, lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN nullif(regexp_replace(regexp_replace(string_split(regexp_replace(host, '^www\\.', ''), '.')[1], '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), '') END AS name,
               CASE WHEN n < {v.FETCH_LENGTH} THEN 'short' WHEN marker IS NOT NULL AND n < {v.MARKER_LENGTH} THEN 'blocked' ELSE 'ok' END AS status, marker, n::BIGINT AS n_units FROM k JOIN h USING (page_id)""",
    "corpus_summary": f"WITH t AS (SELECT {trim('text')} AS b, {units('text')} AS n FROM ({policy_sql()})) SELECT count(*) AS documents, count(*) FILTER (WHERE b <> '') AS usable, sum(n)::BIGINT AS n_units, count(*) FILTER (WHERE n < {v.THIN_LENGTH}) AS thin FROM t",
}
