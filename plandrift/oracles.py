"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations

from .functions import text
from .sources.views import DOCUMENT_PAIRS, TAG_SHEET



def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def found(t: str, pattern: str, options: str = "i", group: int = 0) -> str:
    return f"regexp_extract_all({t}, {q(pattern)}, {group}, {q(options)})"


def has(t: str, pattern: str, options: str = "i") -> str:
    return f"regexp_matches({t}, {q(pattern)}, {q(options)})"


def first_seen(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def normal(t: str) -> str:
    return rf"trim(regexp_replace(coalesce({t}, ''), '\s+', ' ', 'g'))"


def some(xs: str, test: str) -> str:
    return f"(len(list_filter({xs}, lambda x: {test})) > 0)"


def identified(t: str) -> str:
    every = f"list_concat(list_concat({found(t, text.INSTRUMENT)}, {found(t, text.EQUIPMENT)}), list_concat({found(t, text.LINE_TAG, 'c')}, {found(t, text.NOTE)}))"
    return f"list_transform({every}, lambda x: replace(upper({normal('x')}), ' ', ''))"


def kind(t: str, ids: str) -> str:
    return f"""CASE WHEN {has(t, text.NOTE)} THEN 'note' WHEN {some(ids, has('x', text.INSTRUMENT))} THEN 'instrument_tag' WHEN {some(ids, has('x', text.EQUIPMENT))} THEN 'equipment_tag'
        WHEN {has(t, text.LINE_TAG, 'c')} THEN 'line_tag' WHEN {has(t, text.CELL_WORDS)} OR {has(t, text.SETPOINT)} THEN 'table_cell' ELSE 'text' END"""


def elements(rows: str, name: str = "el") -> str:
    return f"""{name}0 AS (SELECT *, {normal('raw_text')} AS normalized_text FROM {rows}), {name}1 AS MATERIALIZED (SELECT *, {identified('normalized_text')} AS ids_ FROM {name}0),
    {name}2 AS (SELECT * EXCLUDE (ids_), {first_seen('ids_')} AS identifiers FROM {name}1), {name} AS (SELECT *, {kind('normalized_text', 'identifiers')} AS kind FROM {name}2)"""


def grid(down: bool = True, mark: str = "~", p: str = "") -> str:
    x = f"least(7, greatest(0, CAST(trunc(({p}x0 + {p}x1) / 2 * 8) AS INT)))"
    y = f"least(5, greatest(0, CAST(trunc(({p}y0 + {p}y1) / 2 * 6) AS INT)))"
    letter, number = (y, x) if down else (x, y)
    return f"concat(chr(65 + {letter}), {number} + 1, '{mark}')"


ELEMENT_ID = "concat('e_', substr(sha1(concat_ws('|', rev, page_number, kind, normalized_text, concat('(', " + ", ', ', ".join(f"CAST(round_even({v} / 0.01, 0) AS BIGINT)" for v in ("x0", "y0", "x1", "y1")) + ", ')'))), 1, 12))"
SHEET = f"WITH t AS MATERIALIZED ({TAG_SHEET}), {elements('t')}, e AS MATERIALIZED (SELECT *, {ELEMENT_ID} AS element_id FROM el), a AS MATERIALIZED (SELECT * FROM e WHERE rev = 'A'), b AS MATERIALIZED (SELECT * FROM e WHERE rev = 'B')"


def cut(a: str, b: str, side: str) -> str:
    return f"greatest(CAST(0 AS DOUBLE), least({a}.{side}1, {b}.{side}1) - greatest({a}.{side}0, {b}.{side}0))"


def area(a: str) -> str:
    return f"(greatest(CAST(0 AS DOUBLE), {a}.x1 - {a}.x0) * greatest(CAST(0 AS DOUBLE), {a}.y1 - {a}.y0))"


def both(a: str, b: str) -> str:
    return f"({cut(a, b, 'x')} * {cut(a, b, 'y')})"


def iou(a: str, b: str) -> str:
    return f"CASE WHEN {both(a, b)} > 0 AND {area(a)} + {area(b)} - {both(a, b)} > 0 THEN {both(a, b)} / ({area(a)} + {area(b)} - {both(a, b)}) ELSE 0.0 END"


def containment(a: str, b: str) -> str:
    return f"CASE WHEN {both(a, b)} > 0 THEN {both(a, b)} / greatest(CAST(1e-9 AS DOUBLE), least({area(a)}, {area(b)})) ELSE 0.0 END"


def apart(a: str, b: str) -> str:
    dx, dy = (f"(({a}.{v}0 + {a}.{v}1) / 2 - ({b}.{v}0 + {b}.{v}1) / 2)" for v in "xy")
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def lcs(a: str, b: str) -> str:
    """By the recurrence on 64 bits, for texts of up to 62 characters."""
    full = f"((CAST(1 AS BIGINT) << length({a})) - 1)"
    mask = f"CAST(list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN substr({a}, CAST(i + 1 AS BIGINT), 1) = c THEN CAST(1 AS BIGINT) << CAST(i AS BIGINT) ELSE CAST(0 AS BIGINT) END)) AS BIGINT)"
    masks = f"list_transform(string_split({b}, ''), lambda c: {mask})"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})) END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE CAST(200.0 AS DOUBLE) * ({lcs(a, b)}) / (length({a}) + length({b})) END"


#: Stages from rows p with text_1, text_2 to token_set, the token-set ratio.
TOKEN_SET = rf"""
    w1 AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(text_1, '\s+'), lambda x: x <> ''))) AS w_1, list_sort(list_distinct(list_filter(regexp_split_to_array(text_2, '\s+'), lambda x: x <> ''))) AS w_2 FROM p),
    w2 AS MATERIALIZED (SELECT *, array_to_string(list_filter(w_1, lambda x: list_contains(w_2, x)), ' ') AS w_b, array_to_string(list_filter(w_1, lambda x: NOT list_contains(w_2, x)), ' ') AS o_1, array_to_string(list_filter(w_2, lambda x: NOT list_contains(w_1, x)), ' ') AS o_2 FROM w1),
    w3 AS MATERIALIZED (SELECT *, length(w_b) AS s, length(o_1) AS la, length(o_2) AS lb, CASE WHEN length(w_b) > 0 THEN 1 ELSE 0 END AS gap, {lcs('o_1', 'o_2')} AS c FROM w2),
    ts AS (SELECT * EXCLUDE (w_1, w_2, w_b, o_1, o_2, s, la, lb, gap, c), CASE WHEN len(w_1) = 0 OR len(w_2) = 0 THEN 0.0 WHEN s > 0 AND (la = 0 OR lb = 0) THEN 100.0
        ELSE CAST(100.0 AS DOUBLE) * greatest(CAST(1.0 AS DOUBLE) - CAST(la + lb - 2 * c AS DOUBLE) / greatest(s + gap + la + s + gap + lb, 1),
            CASE WHEN s > 0 THEN CAST(1.0 AS DOUBLE) - CAST(gap + la AS DOUBLE) / (s + s + gap + la) ELSE 0.0 END, CASE WHEN s > 0 THEN CAST(1.0 AS DOUBLE) - CAST(gap + lb AS DOUBLE) / (s + s + gap + lb) ELSE 0.0 END) END AS token_set FROM w3)"""

PAIRED = "SELECT a.page_number, a.seq, a AS a, b AS b, a.normalized_text AS text_1, b.normalized_text AS text_2 FROM a JOIN b USING (page_number, seq)"
NEAR = f"SELECT a.page_number, a.seq, a AS a, b AS b, a.normalized_text AS text_1, b.normalized_text AS text_2 FROM a JOIN b USING (page_number) WHERE {apart('a', 'b')} <= 2.5 * 0.12 OR list_has_any(list_transform(a.identifiers, lambda x: upper(x)), list_transform(b.identifiers, lambda x: upper(x)))"
_ids = ("a.identifiers[1]", "b.identifiers[1]")
_kinds = "a.kind = b.kind"
_near_kinds = " OR ".join(f"(a.kind = '{x}' AND b.kind IN ({', '.join(map(q, ys))})) OR (b.kind = '{x}' AND a.kind IN ({', '.join(map(q, ys))}))" for x, ys in {"text": ("note", "table_cell", "dimension", "equipment_tag", "instrument_tag", "line_tag"), "dimension": ("table_cell",)}.items())
KIND_SCORE = f"CASE WHEN {_kinds} THEN 1.0 WHEN {_near_kinds} THEN 0.7 ELSE 0.0 END"
_wa, _wb = (f"(greatest(CAST(1e-6 AS DOUBLE), {s}.x1 - {s}.x0) * greatest(CAST(1e-6 AS DOUBLE), {s}.y1 - {s}.y0))" for s in "ab")
#: Stages from rows p to sc with the features and the score; every tag of the sheet has one identifier at most.
SCORED = f"""{TOKEN_SET},
    f1 AS MATERIALIZED (SELECT *, CASE WHEN len(a.identifiers) = 0 OR len(b.identifiers) = 0 THEN 0.0 WHEN {_ids[0]} = {_ids[1]} THEN 1.0 ELSE ({ratio(*_ids)}) / 100 END AS identifier,
        CAST(0.6 AS DOUBLE) * token_set / 100 + CAST(0.4 AS DOUBLE) * ({ratio('text_1', 'text_2')}) / 100 AS text_, CAST(0.6 AS DOUBLE) * ({iou('a', 'b')}) + CAST(0.4 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), CAST(1.0 AS DOUBLE) - {apart('a', 'b')} / CAST(0.2 AS DOUBLE)) AS spatial,
        CAST({KIND_SCORE} AS DOUBLE) AS type_, CAST(1.0 AS DOUBLE) - least(CAST(1.0 AS DOUBLE), abs({_wa} - {_wb}) / greatest({_wa}, {_wb})) AS geometry, {apart('a', 'b')} AS distance FROM ts),
    f2 AS (SELECT *, CAST(0.32 AS DOUBLE) * identifier + CAST(0.24 AS DOUBLE) * text_ + CAST(0.22 AS DOUBLE) * spatial + CAST(0.12 AS DOUBLE) * type_ + CAST(0.10 AS DOUBLE) * geometry AS total FROM f1 WHERE type_ > 0),
    sc AS (SELECT *, CASE WHEN identifier >= 1 AND text_ > 0.6 THEN least(CAST(1.0 AS DOUBLE), total + CAST(0.1 AS DOUBLE)) ELSE total END AS score FROM f2)"""


def numbers(t: str) -> str:
    """Numbers not after a letter A-Z: the letters go with the digit after them, as there is no look-behind."""
    return rf"regexp_extract_all(regexp_replace(upper({t}), '[A-Z][0-9]', 'A', 'g'), '[-+]?\d+(?:[.,]\d+)?')"


def noise(t: str) -> str:
    u = f"upper({normal(t)})"
    return f"(length({u}) <= 1 OR starts_with({u}, 'REV:') OR starts_with({u}, 'SHEET:') OR regexp_full_match({u}, '[A-H]|[0-9]'))"


_differ = f"(text_1 <> text_2 AND ({numbers('text_1')} <> {numbers('text_2')} OR text_ < 0.92))"
TYPED = f"""{SCORED}, ty AS (SELECT *, CASE WHEN distance > 0.018 AND {_differ} THEN 'moved_modified' WHEN distance > 0.018 THEN 'moved' WHEN {_differ} THEN 'modified' ELSE 'unchanged' END AS change_type FROM sc WHERE score > 0)"""
_band = "CASE WHEN confidence >= 0.78 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END"


def _one_sided(side: str, other: str, name: str, verb: str, alone: str | None = None) -> str:
    alone = alone or f"NOT EXISTS (SELECT 1 FROM {other} o WHERE o.page_number = {side}.page_number AND o.seq = {side}.seq)"
    known = "CASE WHEN len(identifiers) > 0 THEN 1.0 ELSE 0.0 END"
    base = f"CAST(0.15 + 0.135 + 0.2 + 0.225 + 0.05 AS DOUBLE) + CAST(0.1 AS DOUBLE) * {known}"
    return f"""SELECT page_number, seq, '{name}' AS change_type, kind AS entity_type, {'normalized_text' if side == 'a' else 'NULL'} AS before, {'normalized_text' if side == 'b' else 'NULL'} AS after,
        concat('{verb} ', kind, ': ', normalized_text, ' at sheet ', CASE WHEN page_number = 0 THEN 1 ELSE page_number END, ', grid ', {grid()}, '.') AS description, CASE WHEN len(identifiers) > 0 THEN least(CAST(1.0 AS DOUBLE), {base} + CAST(0.1 AS DOUBLE)) ELSE {base} END AS confidence,
        concat('D-', upper(substr(sha1(concat_ws('|', 'A', 'B', '{name}', concat(element_id, normalized_text))), 1, 8))) AS delta_item_id, x0, y0, x1, y1
        FROM {side} WHERE NOT {noise('normalized_text')} AND {alone}"""


_quoted = "concat({verb}, b.kind, ' from ''', text_1, ''' to ''', text_2, ''' on sheet ', CASE WHEN page_number = 0 THEN 1 ELSE page_number END, ', grid ', " + grid(p="b.") + ", '.')"
_MATCHED = f"""SELECT page_number, seq, change_type, b.kind AS entity_type, text_1 AS before, text_2 AS after,
        CASE change_type WHEN 'moved' THEN concat('Moved ', b.kind, ': ', text_2, ' on sheet ', CASE WHEN page_number = 0 THEN 1 ELSE page_number END, ', grid ', {grid(p='b.')}, '.') WHEN 'moved_modified' THEN {_quoted.format(verb="'Moved and modified '")} ELSE {_quoted.format(verb="'Modified '")} END AS description,
        CAST(0.15 AS DOUBLE) + CAST(0.135 AS DOUBLE) + CAST(0.2 AS DOUBLE) + CAST(0.3 AS DOUBLE) * round(score, 4) + CAST(0.1 AS DOUBLE) * identifier + CAST(0.1 AS DOUBLE) * (CAST(0.5 AS DOUBLE) * (text_ + spatial)) AS confidence,
        concat('D-', upper(substr(sha1(concat_ws('|', 'A', 'B', change_type, a.element_id, b.element_id, change_type, text_1, text_2)), 1, 8))) AS delta_item_id, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1
        FROM ty WHERE change_type <> 'unchanged' AND NOT ({noise('text_1')} AND {noise('text_2')})"""
_BANDED = f"SELECT *, {_band} AS confidence_band, {_band} <> 'high' AS review_required FROM ch0"
CHANGES = f"""{SHEET}, p AS MATERIALIZED ({PAIRED}), {TYPED}, mc AS ({_MATCHED}),
    ch0 AS (SELECT * FROM mc UNION ALL {_one_sided('a', 'b', 'removed', 'Removed')} UNION ALL {_one_sided('b', 'a', 'added', 'Added')}),
    ch AS MATERIALIZED ({_BANDED})"""

#: The best one-to-one pairs of a page, by trying the elements of revision A one after the other (a page of the sheet has
#: fourteen at most) with a bit for each element of B that is taken, and keeping the best sum for each set of bits.
_TIE = "CAST(concat('0x', substr(md5(concat_ws('|', a.element_id, b.element_id)), 1, 4)) AS BIGINT)"
_STEPS = ", ".join(
    f"""s{k + 1} AS MATERIALIZED (SELECT page_number, mask, max(total) AS total, arg_max(path, total) AS path FROM (SELECT page_number, mask, total, path FROM s{k}
        UNION ALL SELECT s.page_number, s.mask | (CAST(1 AS BIGINT) << j), s.total + w, s.path | ((j + 1) << {4 * k}) FROM s{k} s JOIN ix ON s.page_number = ix.page_number WHERE i = {k} AND (s.mask & (CAST(1 AS BIGINT) << j)) = 0) GROUP BY page_number, mask)"""
    for k in range(15)
)
ASSIGNED = f"""{SHEET}, p AS MATERIALIZED ({NEAR}), {SCORED},
    ix AS MATERIALIZED (SELECT page_number, a.element_id AS ida, b.element_id AS idb, score, CAST(round_even(score * 1000000, 0) AS BIGINT) * 1048576 + {_TIE} AS w,
        dense_rank() OVER (PARTITION BY page_number ORDER BY a.element_id) - 1 AS i, dense_rank() OVER (PARTITION BY page_number ORDER BY b.element_id) - 1 AS j FROM sc WHERE score > 0),
    s0 AS MATERIALIZED (SELECT DISTINCT page_number, CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS path FROM ix), {_STEPS},
    won AS MATERIALIZED (SELECT page_number, arg_max(path, total) AS path FROM s15 GROUP BY page_number),
    mt AS MATERIALIZED (SELECT ix.* FROM ix JOIN won USING (page_number) WHERE ((path >> CAST(4 * i AS BIGINT)) & 15) = j + 1 AND score >= 0.42)"""
_both = "page_number IN (SELECT page_number FROM a) AND page_number IN (SELECT page_number FROM b)"
_unmatched = lambda side: f"{_both} AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.page_number = {side}.page_number AND mt.id{side} = {side}.element_id)"
#: From the assignment's pairs to all changes, in ch.
DELTA = f"""{ASSIGNED}, tx AS (SELECT sc.* FROM sc JOIN mt ON mt.page_number = sc.page_number AND mt.ida = sc.a.element_id AND mt.idb = sc.b.element_id),
    ty AS MATERIALIZED (SELECT *, CASE WHEN distance > 0.018 AND {_differ} THEN 'moved_modified' WHEN distance > 0.018 THEN 'moved' WHEN {_differ} THEN 'modified' ELSE 'unchanged' END AS change_type FROM tx),
    ch0 AS ({_MATCHED} UNION ALL {_one_sided('a', 'b', 'removed', 'Removed', _unmatched('a'))} UNION ALL {_one_sided('b', 'a', 'added', 'Added', _unmatched('b'))}),
    ch AS MATERIALIZED ({_BANDED})"""

#: Documents' lines; the view D.
LINES = "WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), d AS (SELECT doc_id, unnest(lines) AS raw_text, generate_subscripts(lines, 1) AS line_no, len(lines) AS n_lines FROM l0)"

QUESTIONS = "qs AS (SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user')"
_word_tokens = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}')"
WORDS = f"list_concat({_word_tokens}, list_transform(range(1, len({_word_tokens})), lambda i: concat(({_word_tokens})[i], ' ', ({_word_tokens})[i + 1])))"
_padded = "list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: concat(' ', w, ' '))"
CHARS = f"flatten(list_transform({_padded}, lambda w: flatten(list_transform([3, 4, 5], lambda n: CASE WHEN length(w) > n THEN list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n)) WHEN n = 3 OR length(w) > n - 1 THEN [w] ELSE [] END))))"


def similar(grams: str, name: str = "sim", prefix: str = "") -> str:
    p = prefix
    return f"""{p}dt AS (SELECT item_id, unnest({grams}) AS term FROM benchmark), {p}tf AS (SELECT item_id, term, count(*) AS tf FROM {p}dt GROUP BY ALL), {p}nn AS (SELECT count(*) AS n FROM benchmark),
    {p}df AS (SELECT term, ln((1 + CAST(any_value(n) AS DOUBLE)) / (1 + count(*))) + 1 AS idf FROM {p}tf, {p}nn GROUP BY term),
    {p}dw AS (SELECT item_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS w FROM {p}tf JOIN {p}df USING (term)),
    {p}qt AS (SELECT qid, unnest({grams}) AS term FROM qs), {p}qf AS (SELECT qid, term, count(*) AS tf FROM {p}qt GROUP BY ALL),
    {p}qw AS (SELECT qid, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY qid)) AS w FROM {p}qf JOIN {p}df USING (term)),
    {name} AS (SELECT qid, item_id, round(sum({p}qw.w * {p}dw.w), 9) AS similarity FROM {p}qw JOIN {p}dw USING (term) GROUP BY qid, item_id)"""


def ranked(sim: str, name: str, depth: int) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, item_id DESC) - 1 AS rank FROM {sim} QUALIFY rank < {depth})"


EVIDENCE = f"WITH {QUESTIONS}, {similar(WORDS)}, {ranked('sim', 'rk', 3)}, ev AS (SELECT rk.*, qs.text AS question, benchmark.text AS text FROM rk JOIN qs USING (qid) JOIN benchmark USING (item_id))"


def any_word(t: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def _route(column: int) -> str:
    out = ["'general'", "'rev_a,rev_b,delta'"][column]
    for name, words, families in text.ROUTES:
        out = f"CASE WHEN {any_word('lower(text)', words)} THEN {q([name, ','.join(families)][column])} ELSE {out} END"
    return out


def tokens(t: str, pattern: str = text.CONTENT_TOKEN) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({t}, '')), {q(pattern)}))"


def listed(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


_support = f"list_filter({tokens('question')}, lambda x: NOT list_contains({listed(text.STOP_WORDS)}, x))"
SUPPORT = f"""{EVIDENCE}, g AS (SELECT qid, question, max(similarity) AS top, lower(string_agg(text, ' ' ORDER BY rank)) AS blob FROM ev GROUP BY qid, question),
    g1 AS (SELECT *, {_support} AS tk FROM g), g2 AS (SELECT *, CASE WHEN len(list_filter(tk, lambda x: length(x) >= 4)) > 0 THEN list_filter(tk, lambda x: length(x) >= 4) ELSE tk END AS content FROM g1),
    g3 AS (SELECT *, len(content) AS n, len(list_filter(content, lambda x: contains(blob, x))) AS present FROM g2),
    g4 AS (SELECT qid, top, CASE WHEN len(tk) = 0 THEN top WHEN n > present AND n - present >= greatest(1, (n + 1) // 2) THEN least(CAST(0.04 AS DOUBLE), CAST(0.2 AS DOUBLE) * top) ELSE CAST(0.45 AS DOUBLE) * top + CAST(0.55 AS DOUBLE) * present / greatest(1, n) END AS support FROM g3)
    SELECT qid, round(support, 6) AS support, support < 0.18 OR top < 0.01 AS weak FROM g4"""
_low_numbers = lambda t: rf"list_distinct(regexp_extract_all(regexp_replace(lower({t}), '[a-z][0-9]', 'a', 'g'), '\d+(?:[.,]\d+)?'))"
_ext = lambda t: f"list_distinct(regexp_extract_all({t}, '[a-z0-9\\-]{{2,}}'))"
_asked = f"list_filter({_ext('lower(question)')}, lambda x: NOT list_contains({listed(text.EXTRACTIVE_STOP_WORDS)}, x))"
_snippet = "substr(string_split(trim(text), chr(10))[1], 1, 240)"
EXTRACTIVE = rf"""{EVIDENCE}, x1 AS (SELECT qid, concat('B:p1:', item_id) AS source_id, rank AS position, lower(question) AS ql, {_snippet} AS snippet, {_asked} AS asked FROM ev),
    x2 AS (SELECT qid, source_id, position, CAST(3.0 AS DOUBLE) * len(list_filter(asked, lambda x: list_contains({_ext('lower(snippet)')}, x))) + 2.0 * len(list_filter(asked, lambda x: contains(lower(snippet), x)))
        + 6.0 * len(list_filter(list_distinct(regexp_extract_all(ql, '\d+(?:[.,]\d+)?')), lambda x: contains(lower(snippet), x))) + CASE WHEN {any_word('ql', ('value', 'duty', 'setpoint', 'how many'))} AND regexp_matches(snippet, '\d') THEN 2.0 ELSE 0.0 END
        + CASE WHEN {any_word('ql', ('revision b', 'rev b', 'current', 'after', 'new'))} THEN 2.5 ELSE 0.0 END - CAST(0.01 AS DOUBLE) * position AS score FROM x1)
    SELECT qid, source_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, position) AS rank FROM x2"""
CITATIONS = f"""{EVIDENCE}, c1 AS (SELECT qid, question AS answer, CASE WHEN rank = 2 THEN '?' ELSE CAST(item_id AS VARCHAR) END AS source_id FROM ev), r AS (SELECT qid, CAST(item_id AS VARCHAR) AS source_id, substr(text, 1, 240) AS quote FROM ev),
    c2 AS (SELECT c1.*, r.quote, {tokens('answer')} AS ta, {tokens('quote')} AS te FROM c1 LEFT JOIN r USING (qid, source_id)),
    c3 AS (SELECT qid, quote IS NOT NULL AS known, CASE WHEN len(ta) = 0 OR len(te) = 0 THEN len(te) > 0 AND len(ta) = 0
        ELSE (len({_low_numbers('answer')}) = 0 OR list_has_any({_low_numbers('answer')}, {_low_numbers('quote')})) AND (CAST(len(list_filter(ta, lambda x: list_contains(te, x))) AS DOUBLE) / greatest(1, len(ta)) >= 0.12 OR {some('list_sort(ta)[1:8]', 'length(x) > 4 AND contains(lower(quote), x)')}) END AS backed FROM c2),
    c4 AS (SELECT qid, count(*) FILTER (NOT known) AS n_unknown, count(*) FILTER (known AND NOT backed) AS n_unsupported, count(*) FILTER (known AND backed) AS n_valid FROM c3 GROUP BY qid)
    SELECT *, CASE WHEN n_unknown > 0 THEN 'unknown_citation' WHEN n_valid = 0 AND n_unsupported > 0 THEN 'unsupported_claim' WHEN n_valid = 0 THEN 'no_citation' ELSE 'ok' END AS status FROM c4"""


def literals(rows: list[str], start: int = -1) -> str:
    return " UNION ALL ".join(f"SELECT {start - k}, {q(x)}" for k, x in enumerate(rows))


_SCOPE = ["what is the duty value in revision C?", "between the revisions", "in rev A", "rev: 2 of the note", "revision B or rev Z9", "REV-D please"]
_ROUTED = ["show D-12AB", "how many items were added?", "list high-confidence changes", "what changed?"]
_FACTS = [("250", "duty 12500", False), ("12.5", "112.5", False), ("250", "changed to 250.", True), ("NOTE 12", "see NOTE12", True), ("", "x", True), ("12", "12,500", False), ("12.5", "12.5, ok", True), ("HH 250", "hh  250 set", True)]
_LABELS = ["", "  ", "REV: A", "sheet: 2", "C", "z", "7", "12", "HH 245", "rev:b", "I", "NOTE 1"]


def percentile(p: int) -> str:
    rank = f"greatest(1, least(n, CAST(round_even(CAST({p} AS DOUBLE) / 100 * n + 0.5, 0) AS BIGINT)))"
    return f"max(CASE WHEN k = {rank} THEN v END) AS p{p}_ms"


def percentiles(rows: str, key: str, v: str) -> str:
    return f"SELECT {key}, count(*) AS sample_size, {percentile(50)}, {percentile(95)}, max(v) AS max_ms FROM (SELECT {key}, {v} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {v}) AS k, count(*) OVER (PARTITION BY {key}) AS n FROM {rows}) GROUP BY {key}"


PREDICTED = f"""{CHANGES}, tr AS (SELECT page_number, seq, CASE max(edit) WHEN 0 THEN 'removed' WHEN 1 THEN 'added' WHEN 2 THEN 'modified' WHEN 3 THEN 'moved' WHEN 4 THEN 'moved_modified' END AS truth FROM t GROUP BY page_number, seq),
    pr AS (SELECT tr.*, ch.change_type AS found FROM tr LEFT JOIN ch USING (page_number, seq)),
    pc AS (SELECT page_number, count(*) FILTER (truth IS NOT DISTINCT FROM found AND truth IS NOT NULL) AS tp, count(*) FILTER (truth IS DISTINCT FROM found AND found IS NOT NULL) AS fp, count(*) FILTER (truth IS DISTINCT FROM found AND truth IS NOT NULL) AS fn FROM pr GROUP BY page_number),
    pf AS (SELECT *, CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM pc)"""
_f1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END"
_pair_tokens = lambda s: f"list_distinct(list_concat(list_transform(ids_{s}, lambda x: upper(x)), list_transform(regexp_extract_all(n_{s}, {q(text.STABLE_TOKEN)}, 0, 'i'), lambda x: upper(x))))"
_equipment = lambda s: f"list_distinct(list_filter(ids_{s}, lambda x: kind_{s} = 'equipment_tag' OR {has('x', text.PRIMARY_EQUIPMENT)}))"
_title = lambda s: rf"list_distinct(list_filter(regexp_split_to_array(lower(substr(text_{s}, 1, 400)), '\s+'), lambda x: x <> ''))"
_jaccard = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / greatest(1, len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0.0 END"
COMPATIBILITY = f"""WITH dp AS ({DOCUMENT_PAIRS}), k0 AS (SELECT *, {normal('text_a')} AS n_a, {normal('text_b')} AS n_b FROM dp), k1 AS (SELECT *, {identified('n_a')} AS ids_a, {identified('n_b')} AS ids_b FROM k0),
    k2 AS (SELECT *, {kind('n_a', 'ids_a')} AS kind_a, {kind('n_b', 'ids_b')} AS kind_b FROM k1), k3 AS (SELECT *, {_pair_tokens('a')} AS t_a, {_pair_tokens('b')} AS t_b, {_equipment('a')} AS e_a, {_equipment('b')} AS e_b, {_title('a')} AS w_a, {_title('b')} AS w_b FROM k2),
    k4 AS (SELECT *, {_jaccard('t_a', 't_b')} AS token_overlap, {_jaccard('w_a', 'w_b')} AS title_overlap, source_a IS DISTINCT FROM source_b AS differs, len(e_a) > 0 AND len(e_b) > 0 AND NOT list_has_any(e_a, e_b) AS disjoint FROM k3),
    k5 AS (SELECT *, text_a <> '' AND text_b <> '' AND title_overlap < 0.15 AS titled FROM k4),
    k6 AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) - CASE WHEN differs THEN CAST(0.45 AS DOUBLE) ELSE 0 END - CASE WHEN token_overlap < 0.25 THEN CAST(0.25 AS DOUBLE) WHEN token_overlap < 0.5 THEN CAST(0.1 AS DOUBLE) ELSE 0 END - CASE WHEN disjoint THEN CAST(0.25 AS DOUBLE) ELSE 0 END - CASE WHEN titled THEN CAST(0.1 AS DOUBLE) ELSE 0 END)) AS score FROM k5)
    SELECT doc_a, doc_b, token_overlap, title_overlap, score, score >= 0.65 AS compatible, array_to_string(list_filter([CASE WHEN differs THEN 'underlying_document_id differs' END, CASE WHEN token_overlap < 0.25 THEN 'stable-token overlap is low' WHEN token_overlap < 0.5 THEN 'stable-token overlap is moderate' END, CASE WHEN disjoint THEN 'primary equipment tag differs' END, CASE WHEN titled THEN 'title/block text differs strongly' END], lambda x: x IS NOT NULL), '; ') AS reasons,
        CASE WHEN score >= 0.65 THEN 'continue' ELSE 'continue_with_warning' END AS action FROM k6"""
_tags = "what changed near "

#: The assistant's turns judged against the questions before them, in jd.
_squashed = lambda t: rf"regexp_replace(lower({t}), '\s+', '', 'g')"
JUDGED = f"""j0 AS (SELECT s.conv_id, s.turn, coalesce(s.text, '') AS answer, u.text AS question, (regexp_extract_all(u.text, '[A-Za-z]{{4,}}'))[1:2] AS facts FROM conversations s JOIN conversations u ON u.conv_id = s.conv_id AND u.turn + 1 = s.turn AND u.role = 'user' WHERE s.role = 'assistant'),
    j1 AS (SELECT *, length(answer) < 40 AS unsupported, CASE WHEN conv_id % 3 = 0 THEN conv_id % 2 = 0 END AS expect_unsupported, coalesce(CASE WHEN conv_id % 3 = 0 THEN conv_id % 2 = 0 END, false) AS refused, concat(conv_id, '/', conv_id * 1000 + turn) AS subject, coalesce(facts, []) AS f FROM j0),
    jd AS MATERIALIZED (SELECT *, refused OR len(list_filter(f, lambda x: NOT contains({_squashed('answer')}, lower(x)))) = 0 AS fact_ok, unsupported = refused AS refusal_ok, CASE WHEN turn % 2 = 0 THEN 0.0 ELSE 1.0 END AS citation_precision,
        CASE WHEN refused OR len(f) = 0 THEN 1.0 ELSE CAST(len(list_filter(f, lambda x: contains({_squashed('question')}, lower(x)))) AS DOUBLE) / len(f) END AS groundedness, len(f) > 0 AND NOT refused AS measured FROM j1)"""
MEANS = "avg(CAST(fact_ok AS INTEGER)) AS chat_fact_accuracy, avg(citation_precision) AS citation_precision, avg(groundedness) AS citation_groundedness"

ORACLES: dict[str, str] = {
    "el_normalize": f"{LINES} SELECT doc_id, line_no, {normal('raw_text')} AS normalized_text FROM d",
    "el_identifiers": f"{SHEET} SELECT rev, page_number, seq, array_to_string(identifiers, ',') AS identifiers FROM e",
    "el_kind": f"{SHEET} SELECT rev, page_number, seq, kind FROM e",
    "el_ids_sha1": f"{SHEET} SELECT rev, page_number, seq, element_id FROM e",
    "el_grid_label": f"WITH t AS ({TAG_SHEET}) SELECT rev, page_number, seq, {grid()} AS grid, {grid(False, '')} AS grid_across FROM t",
    "limits_check": f"""{LINES}, g AS (SELECT doc_id, (line_no - 1) // 50 AS page, count(*) AS n, max(length(raw_text)) AS longest, sum(length(raw_text)) AS chars, length(string_agg(raw_text, chr(10))) AS page_chars FROM d GROUP BY ALL),
        h AS (SELECT doc_id, count(*) AS n_pages, max(n) AS max_page_elements, sum(n) AS n_elements, max(longest) AS longest_element, sum(chars) + sum(page_chars) AS n_chars FROM g GROUP BY doc_id)
        SELECT doc_id, n_pages, max_page_elements, CAST(n_elements AS BIGINT) AS n_elements, longest_element, CAST(n_chars AS BIGINT) AS n_chars, array_to_string(list_filter([CASE WHEN n_pages > 2 THEN 'pages' END, CASE WHEN max_page_elements > 40 THEN 'page_elements' END, CASE WHEN n_elements > 60 THEN 'elements' END, CASE WHEN longest_element > 2000 THEN 'element_chars' END, CASE WHEN n_chars > 8000 THEN 'chars' END], lambda x: x IS NOT NULL), ',') AS exceeded FROM h""",
    "vector_grid_clusters": f"""WITH t AS ({TAG_SHEET}), g AS (SELECT page_number, CAST(floor((x0 + x1) / 2 / 0.25) AS BIGINT) AS cell_x, CAST(floor((y0 + y1) / 2 / 0.25) AS BIGINT) AS cell_y, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM t WHERE rev = 'A' GROUP BY ALL)
        SELECT * FROM g WHERE n >= 2 AND (x1 - x0) * (y1 - y0) BETWEEN 0.002 AND 0.7 QUALIFY row_number() OVER (PARTITION BY page_number ORDER BY cell_x, cell_y) <= 3""",
    "format_routing": r"""WITH p AS (SELECT page_id, url, html, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_chars, len(regexp_extract_all(html, '<p')) AS vectors, len(regexp_extract_all(html, 'class="ad"')) AS images FROM pages),
        c AS (SELECT *, CASE WHEN images > 0 AND text_chars < 40 THEN greatest(least(1.0, 0.5 * images), 0.9) ELSE least(1.0, 0.5 * images) END AS image_coverage FROM p)
        SELECT page_id, CASE WHEN length(html) > 104857600 THEN 'too_large' WHEN starts_with(html, 'AC10') THEN 'dwg' WHEN starts_with(html, 'AutoCAD Binary DXF') OR regexp_matches(ltrim(upper(substr(html, 1, 2048))), '^0\s*\r?\n\s*SECTION|^999\b') THEN 'dxf' WHEN starts_with(html, '%PDF') OR ends_with(lower(url), '.pdf') THEN 'pdf' ELSE 'unsupported' END AS family,
        text_chars, vectors, CAST(image_coverage AS DOUBLE) AS image_coverage, CASE WHEN (text_chars >= 80 OR vectors >= 20) AND NOT (image_coverage >= 0.55 AND text_chars < 80) THEN 'native_pdf' ELSE 'scanned_pdf' END AS route FROM c""",
    "bbox_iou_containment": f"{SHEET} SELECT a.page_number, a.seq, {iou('a', 'b')} AS iou, {containment('a', 'b')} AS containment, {apart('a', 'b')} AS distance FROM a JOIN b USING (page_number, seq)",
    "bbox_affine_hull": f"""WITH t AS ({TAG_SHEET}), c AS (SELECT rev, page_number, seq, list_transform([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], lambda p: CAST(1.01 AS DOUBLE) * p[1] + CAST(0.002 AS DOUBLE) * p[2] + CAST(0.003 AS DOUBLE)) AS xs, list_transform([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], lambda p: CAST(-0.002 AS DOUBLE) * p[1] + CAST(0.99 AS DOUBLE) * p[2] + CAST(0.004 AS DOUBLE)) AS ys FROM t)
        SELECT rev, page_number, seq, list_min(xs) AS hx0, list_min(ys) AS hy0, list_max(xs) AS hx1, list_max(ys) AS hy1 FROM c""",
    "gap_split_lines": f"WITH t AS ({TAG_SHEET}), g AS (SELECT page_number, seq, x0, coalesce(CASE WHEN x0 - lag(x1) OVER (PARTITION BY page_number ORDER BY x0, seq) > CAST(0.035 AS DOUBLE) THEN 1 ELSE 0 END, 0) AS wide FROM t WHERE rev = 'A') SELECT page_number, seq, CAST(sum(wide) OVER (PARTITION BY page_number ORDER BY x0, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_no FROM g",
    "ocr_conf_filter": "WITH w AS (SELECT user_id, value - floor(value / 100) * 100 AS c0, event_type FROM events), c AS (SELECT user_id, CASE WHEN c0 > 1 THEN c0 / 100 ELSE c0 END AS c FROM w WHERE trim(event_type) <> '') SELECT user_id, count(*) AS n_words, CAST(sum(CAST(c AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS mean_confidence FROM c WHERE c >= 0.4 GROUP BY user_id",
    "pair_compat": COMPATIBILITY,
    "match_candidates": f"{SHEET}, p AS MATERIALIZED ({NEAR}) SELECT page_number, a.element_id AS element_id_a, b.element_id AS element_id_b FROM p",
    "pair_scores": f"{SHEET}, p AS MATERIALIZED ({NEAR}), {SCORED} SELECT page_number, a.element_id AS element_id_a, b.element_id AS element_id_b, identifier, text_ AS text, spatial, type_ AS type, geometry, score FROM sc WHERE score > 0",
    "assignment": f"{ASSIGNED} SELECT page_number, ida AS element_id_a, idb AS element_id_b, score FROM mt",
    "delta_changes": f"""{DELTA}, pg AS (SELECT page_number, bool_or(rev = 'A') AS in_a, bool_or(rev = 'B') AS in_b FROM t GROUP BY 1), px AS (SELECT page_number, CASE WHEN in_a THEN 'removed' ELSE 'added' END AS change_type FROM pg WHERE NOT (in_a AND in_b))
        SELECT page_number, change_type, entity_type, before, after, description, round(confidence, 4) AS confidence, confidence_band, review_required, delta_item_id, x0, y0, x1, y1 FROM ch
        UNION ALL SELECT page_number, change_type, 'page', CASE change_type WHEN 'removed' THEN concat('page ', page_number) END, CASE change_type WHEN 'added' THEN concat('page ', page_number) END, concat(CASE change_type WHEN 'added' THEN 'Added' ELSE 'Removed' END, ' page ', page_number, '.'), 0.9, 'high', false, concat('D-', upper(substr(sha1(concat_ws('|', 'A', 'B', change_type, concat('page-', page_number))), 1, 8))), NULL, NULL, NULL, NULL FROM px""",
    "suppressed_counts": f"""{DELTA}, q AS (SELECT page_number FROM ty WHERE change_type = 'unchanged' OR ({noise('text_1')} AND {noise('text_2')}) UNION ALL SELECT page_number FROM a WHERE {noise('normalized_text')} AND {_unmatched('a')} UNION ALL SELECT page_number FROM b WHERE {noise('normalized_text')} AND {_unmatched('b')})
        SELECT page_number, count(*) AS n FROM q GROUP BY 1""",
    "page_work": f"{SHEET}, na AS (SELECT page_number, count(*) AS n_a FROM a GROUP BY 1), nb AS (SELECT page_number, count(*) AS n_b FROM b GROUP BY 1) SELECT page_number, n_a, n_b, n_a * n_b AS comparisons, n_a * n_b > 30 AS exceeded FROM na JOIN nb USING (page_number)",
    "page_level_changes": f"""WITH t AS ({TAG_SHEET}), x AS (SELECT page_number, bool_or(rev = 'A') AS in_a, bool_or(rev = 'B') AS in_b FROM t GROUP BY 1), y AS (SELECT page_number, CASE WHEN in_a THEN 'removed' ELSE 'added' END AS change_type FROM x WHERE NOT (in_a AND in_b))
        SELECT page_number, change_type, concat(CASE change_type WHEN 'added' THEN 'Added' ELSE 'Removed' END, ' page ', page_number, '.') AS description, concat('D-', upper(substr(sha1(concat_ws('|', 'A', 'B', change_type, concat('page-', page_number))), 1, 8))) AS delta_item_id FROM y""",
    "kind_compat": f"{SHEET} SELECT a.page_number, a.seq, CAST({KIND_SCORE} AS DOUBLE) AS compatibility FROM a JOIN b USING (page_number, seq)",
    "classify_truth": f"{SHEET}, p AS MATERIALIZED ({PAIRED}), {TYPED} SELECT page_number, seq, change_type FROM ty",
    "unmatched_anti": f"{SHEET} SELECT page_number, seq, 'removed' AS change_type FROM a ANTI JOIN b USING (page_number, seq) UNION ALL SELECT page_number, seq, 'added' FROM b ANTI JOIN a USING (page_number, seq)",
    "confidence_bands": f"{CHANGES} SELECT page_number, seq, change_type, round(confidence, 4) AS confidence, confidence_band, review_required FROM ch",
    "change_descriptions": f"{CHANGES} SELECT page_number, seq, description, delta_item_id FROM ch",
    "change_summary": f"{CHANGES} SELECT change_type, confidence_band, count(*) AS n FROM ch GROUP BY GROUPING SETS ((change_type), (confidence_band), ())",
    "noise_filter": f"WITH t AS ({TAG_SHEET}), x AS (SELECT raw_text FROM t UNION ALL SELECT unnest({listed(_LABELS)})) SELECT raw_text, count(*) AS n, {noise('raw_text')} AS noise FROM x GROUP BY raw_text",
    "change_order": f"{CHANGES} SELECT page_number, delta_item_id, row_number() OVER (PARTITION BY page_number ORDER BY y0, x0, entity_type, delta_item_id) AS position FROM ch",
    "delta_fingerprint": f"{CHANGES} SELECT page_number, count(*) AS n_changes, substr(sha1(concat_ws('|', 'A', 'B', '8231ef4b4c0c1391', count(*), string_agg(delta_item_id, '|' ORDER BY delta_item_id))), 1, 12) AS delta_id FROM ch GROUP BY page_number",
    "residual_explained": f"{SHEET} SELECT page_number, seq FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page_number = a.page_number AND {containment('a', 'b')} > 0.6)",
    "nearby_identifiers": f"{SHEET} SELECT b.page_number, b.seq AS change_id, array_to_string(list_sort(list_distinct(flatten(list(a.identifiers)))), ',') AS nearby FROM b JOIN a USING (page_number) WHERE len(a.identifiers) > 0 AND {apart('a', 'b')} <= 0.18 GROUP BY ALL",
    "ui_filter_page": f"{CHANGES} SELECT page_number, seq, delta_item_id FROM ch WHERE change_type IN ('added', 'modified') AND confidence_band IN ('high', 'medium') AND contains(lower(concat_ws(' ', delta_item_id, change_type, entity_type, coalesce(before, ''), coalesce(after, ''), description)), 'note') ORDER BY page_number, seq, delta_item_id LIMIT 25 OFFSET 25",
    "failure_table": f"""{PREDICTED}, pg AS (SELECT page_number, bool_or(rev = 'A') AS in_a, bool_or(rev = 'B') AS in_b FROM t GROUP BY 1), {JUDGED},
        f AS (SELECT 'case_status' AS kind, CAST(page_number AS VARCHAR) AS subject, 1 AS n FROM pg WHERE NOT (in_a AND in_b) UNION ALL SELECT 'delta_false_positive', CAST(page_number AS VARCHAR), fp FROM pf WHERE fp > 0 UNION ALL SELECT 'delta_missed_change', CAST(page_number AS VARCHAR), fn FROM pf WHERE fn > 0
            UNION ALL SELECT 'chat_fact_miss', subject, 1 FROM jd WHERE NOT fact_ok UNION ALL SELECT 'citation_not_grounded', subject, 1 FROM jd WHERE groundedness < 1 UNION ALL SELECT 'refusal_miss', subject, 1 FROM jd WHERE NOT refusal_ok)
        SELECT kind, subject, CAST(n AS BIGINT) AS n FROM f""",
    "records_union": f"""{SHEET}, pt AS (SELECT rev, page_number, string_agg(normalized_text, chr(10) ORDER BY seq, normalized_text) AS page_text FROM e GROUP BY ALL),
        r AS (SELECT rev, concat(rev, ':p', page_number, ':', element_id) AS source_id, kind AS entity_type, normalized_text AS text, len(identifiers) AS n_ids FROM e WHERE normalized_text <> '' UNION ALL SELECT rev, concat(rev, ':p', page_number, ':page_text'), 'page_text', substr(page_text, 1, 2000), 0 FROM pt WHERE page_text <> '')
        SELECT CASE rev WHEN 'A' THEN 'rev_a' ELSE 'rev_b' END AS source_family, entity_type, count(*) AS n, count(DISTINCT source_id) AS n_ids, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(n_ids) AS BIGINT) AS n_identifiers FROM r GROUP BY ALL""",
    "tfidf_word": f"WITH {QUESTIONS}, {similar(WORDS)} SELECT * FROM sim",
    "tfidf_char": f"WITH {QUESTIONS}, {similar(CHARS)} SELECT * FROM sim",
    "rrf_fusion": f"""WITH {QUESTIONS}, {similar(WORDS, 'sw', 'w')}, {similar(CHARS, 'sc', 'c')}, {ranked('sw', 'rw', 24)}, {ranked('sc', 'rc', 24)},
        u AS (SELECT qid, item_id, CAST(1 AS DOUBLE) / (61 + rank) AS part, rank AS first FROM rw UNION ALL SELECT qid, item_id, CAST(1 AS DOUBLE) / (61 + rank), 1000000 + rank FROM rc),
        s AS (SELECT qid, item_id, sum(part) AS score, min(first) AS first FROM u GROUP BY ALL) SELECT qid, item_id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, item_id) AS position FROM s QUALIFY position <= 8""",
    "exact_tags": f"""{SHEET}, g AS (SELECT page_number, seq AS asked, list_concat(list_transform({found("concat('" + _tags + "', normalized_text)", text.QUERY_TAG)}, lambda x: replace(upper(x), ' ', '')), list_transform({found("concat('" + _tags + "', normalized_text)", text.BARE_TAG)}, lambda x: upper(x))) AS tags FROM a WHERE kind = 'instrument_tag'),
        h AS (SELECT g.*, a.seq, list_transform(identifiers, lambda x: replace(upper(x), ' ', '')) AS ids, replace(upper(normalized_text), ' ', '') AS blob, lower(normalized_text) AS low FROM g JOIN a USING (page_number))
        SELECT page_number, asked, seq FROM h WHERE {some('tags', "list_contains(ids, x) OR contains(blob, x) OR contains(replace(blob, '-', ''), replace(x, '-', '')) OR contains(low, lower(x))")}""",
    "proximity_boost": f"""{SHEET}, n AS (SELECT b.page_number, b.seq AS source_id, min({apart('b', 'a')}) AS nearest FROM b LEFT JOIN (SELECT * FROM a WHERE kind = 'instrument_tag') a USING (page_number) GROUP BY ALL)
        SELECT page_number, source_id, CASE WHEN nearest <= 0.18 THEN CAST(0.6 AS DOUBLE) * (CAST(1 AS DOUBLE) - nearest / CAST(0.18 AS DOUBLE)) ELSE 0.0 END AS boost FROM n""",
    "route_questions": f"WITH {QUESTIONS} SELECT qid, {_route(0)} AS intent, {_route(1)} AS families, {has('text', text.PROXIMITY)} AS proximity FROM qs",
    "scope_check": rf"WITH {QUESTIONS}, s AS (SELECT * FROM qs UNION ALL {literals(_SCOPE)}) SELECT qid, list_filter(list_transform({found('text', text.REVISION_LABEL, 'i', 1)}, lambda x: upper(x)), lambda x: x NOT IN ('A', 'B') AND regexp_full_match(x, '\d+|[A-Z]+'))[1] AS asked_revision FROM s",
    "deterministic_routes": rf"WITH {QUESTIONS}, s AS (SELECT * FROM qs UNION ALL {literals(_ROUTED)}) SELECT qid, CASE WHEN {any_word('lower(text)', ('high-confidence', 'high confidence'))} THEN 'deterministic_high_conf' WHEN contains(lower(text), 'how many') AND contains(lower(text), 'added') THEN 'deterministic_count' WHEN regexp_matches(text, '\b(D-[A-F0-9]+)\b', 'i') AND {any_word('lower(text)', ('show', 'what is', 'change'))} THEN 'deterministic_item' END AS route FROM s",
    "support_score": SUPPORT,
    "extractive_rank": EXTRACTIVE,
    "citation_support": CITATIONS,
    "fact_match": f"WITH t AS ({TAG_SHEET}) SELECT page_number * 100 + seq + 1000 AS id, regexp_matches(lower(raw_text), concat('(^|[^0-9.,])', seq, '($|[^0-9.,]|[.,]($|[^0-9]))')) AS present FROM t WHERE rev = 'A' UNION ALL " + " UNION ALL ".join(f"SELECT {k}, {x[2]}" for k, x in enumerate(_FACTS)),
    "gt_prf": f"{PREDICTED} SELECT page_number, tp, fp, fn, precision, recall, CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 ELSE {_f1} END AS f1 FROM pf",
    "micro_f1": f"{PREDICTED}, m AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pc), m2 AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM m) SELECT *, {_f1} AS f1 FROM m2",
    "latency_percentiles": percentiles("events", "event_type", "value"),
    "end_to_end_latency": f"WITH r AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total, 'end_to_end' AS stage FROM events GROUP BY 1) SELECT sample_size, p50_ms, p95_ms, max_ms FROM ({percentiles('r', 'stage', 'total')})",
    "budget_overruns": f"WITH p AS ({percentiles('events', 'event_type', 'value')}), b AS (SELECT * FROM (VALUES ('click', CAST(50 AS DOUBLE)), ('view', 100000), ('purchase', 60), ('error', 20)) v(event_type, budget_p95_ms)) SELECT event_type, p95_ms, budget_p95_ms, p95_ms - budget_p95_ms AS over_by_ms FROM p JOIN b USING (event_type) WHERE p95_ms > budget_p95_ms",
    "token_cost_rollup": "WITH c AS (SELECT event_type, count(*) AS llm_calls, coalesce(CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT), 0) AS total_tokens, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,6)) END) AS DOUBLE) AS total_cost FROM events GROUP BY event_type) SELECT *, CASE WHEN total_cost IS NULL THEN 'unavailable' ELSE 'estimated' END AS cost_status FROM c",
    "scorecard_compare": """WITH v AS (SELECT event_id % 2 AS half, event_type AS metric, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS value FROM events GROUP BY ALL), t AS (SELECT * FROM (VALUES ('click', CAST(0.5 AS DOUBLE)), ('view', 0.0), ('purchase', 0.1), ('signup', 2.0), ('error', 0.05), ('never', 0.1)) x(metric, tolerance)),
        j AS (SELECT t.*, b.value AS baseline, c.value AS current FROM t LEFT JOIN (SELECT * FROM v WHERE half = 0) b USING (metric) LEFT JOIN (SELECT * FROM v WHERE half = 1 AND metric <> 'signup') c USING (metric))
        SELECT metric, baseline, current, CASE WHEN baseline IS NULL AND current IS NULL THEN 'absent' WHEN baseline IS NULL THEN 'new' WHEN current IS NULL THEN 'missing' WHEN current - baseline < -tolerance THEN 'regressed' WHEN current - baseline > tolerance THEN 'improved' ELSE 'unchanged' END AS status FROM j""",
    "judge_means": f"WITH {JUDGED} SELECT {MEANS}, count(*) FILTER (measured) AS n_measured, coalesce(avg(CASE WHEN expect_unsupported IS NOT NULL THEN CAST(refusal_ok AS INTEGER) END), 1.0) AS unsupported_refusal_accuracy, count(*) AS n_answers FROM jd",
    "all_gates": f"WITH {JUDGED}, m AS (SELECT {MEANS} FROM jd), g AS (SELECT unnest(['chat_fact_accuracy', 'citation_precision', 'citation_groundedness']) AS metric, unnest([chat_fact_accuracy >= 0.0, citation_precision >= 0.4, citation_groundedness >= 1.1]) AS passed FROM m) SELECT bool_and(passed) AS all_gates_passed, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (NOT passed), '') AS failed FROM g",
    "retrieval_checks": f"""WITH {QUESTIONS}, {similar(WORDS)}, {ranked('sim', 'rk', 10)}, k AS (SELECT qid AS check_id, regexp_extract(text, '([A-Za-z]{{5,}})', 1) AS must FROM qs),
        h AS (SELECT qid AS check_id, max(contains(replace(replace(upper(text), ' ', ''), '-', ''), upper(must)) AND (qid % 2 = 1 OR item_id % 2 = 0)) AS hit FROM rk JOIN benchmark USING (item_id) JOIN k ON k.check_id = rk.qid WHERE rank < 5 GROUP BY 1)
        SELECT check_id, coalesce(hit, false) AS hit FROM k LEFT JOIN h USING (check_id) WHERE must <> ''""",
    "errors_by_type": "SELECT concat('E', json_extract_string(props, '$.k')) AS error_type, count(*) AS n_errors FROM events WHERE event_type = 'error' GROUP BY 1",
    "last_stage_latency": "SELECT user_id AS run, event_type AS stage, value AS latency_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC, value DESC) = 1",
    "html_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages",
    "hash_redaction": "SELECT conv_id, turn, role, substr(sha256(coalesce(text, '')), 1, 16) AS text_sha256, length(coalesce(text, '')) AS text_chars FROM conversations",
    "request_ids": f"WITH r AS (SELECT regexp_extract(url, '://([^?#]*)', 1) AS id FROM pages UNION ALL SELECT unnest({listed(['../etc/passwd', 'a/b', '', ' ok-1 ', 'x' * 65])})) SELECT id, count(*) AS n, regexp_full_match(trim(id), '[A-Za-z0-9_-]{{1,64}}') AS valid FROM r GROUP BY id",
}
