"""Text functions of the element model, as Columns."""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a tag, a note and a setpoint look like, and which words make a table cell.
INSTRUMENT = r"\b\d{1,3}-?(?:PIT|PT|TT|TI|FT|FI|LT|LI|PSH|PSL|PAHH|PALL|TSH|TSL|FSH|FSL)[-\s]?\d{2,5}\b"
EQUIPMENT = r"\b\d{1,3}-?(?:KA|KB|P|V|E|C|TK|F)[-\s]?\d{2,5}\b"
LINE_TAG = r"\b\d{1,2}\"?\s*[A-Z]{1,4}-\d{2,5}-[A-Z0-9]+\b"
NOTE = r"\bNOTE\s+\d+\b"
SETPOINT = r"\b(?:HH|H|LL|L|SP)\s*[=:]?\s*\d+(?:\.\d+)?\b"
CELL_WORDS = r"\b(duty|setpoint|hh|ll|capacity|kw|bar|psi)\b"
#: The line tag with a hyphen after the size, which LINE_TAG leaves out; an option.
LINE_TAG_HYPHEN = r"\b\d{1,2}\"?-?\s*[A-Z]{1,4}-\d{2,5}-[A-Z0-9]+\b"
STABLE_TOKEN = r"[A-Z0-9][A-Z0-9\-/]{2,}"
NUMBER = r"(?<![A-Z])[-+]?\d+(?:[.,]\d+)?"
PRIMARY_EQUIPMENT = r"KA|KB|P-\d|TK-"
QUERY_TAG = r"\b\d{0,3}-?[A-Z]{1,6}-?\d{2,5}\b"
BARE_TAG = r"\b[A-Z]{1,6}-\d{2,5}\b"
PROXIMITY = r"\b(near|nearby|around|close to|next to|beside|adjacent to|by the|at the)\b"
CONTENT_TOKEN = r"[a-z0-9\-]{3,}"
REVISION_LABEL = r"\brev(?:ision)?\b\s*[:\-]?\s*([A-Z0-9]{1,3})\b"
#: Words that are no evidence by themselves.
STOP_WORDS = ("what", "when", "where", "which", "does", "did", "the", "any", "this", "that", "with", "from", "about", "near", "only", "show", "list", "how", "many", "were", "was", "are", "and", "for", "change", "changed", "please", "tell", "between", "revisions", "revision", "value", "table", "there")
EXTRACTIVE_STOP_WORDS = ("what", "which", "where", "when", "near", "about", "value", "table", "revision", "between", "changed", "change", "from", "with", "that", "this", "only", "were", "was", "the", "and", "did")
REQUEST_ID = r"^[A-Za-z0-9_-]{1,64}$"

# Java's classes know ASCII only unless told otherwise
_ANY, _ANY_CASE = "(?U)", "(?iU)"


def all_of(text: Column, pattern: str, group: int = 0, any_case: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit((_ANY_CASE if any_case else _ANY) + pattern), F.lit(group))


def has(text: Column, pattern: str, any_case: bool = True) -> Column:
    return F.regexp_like(text, F.lit((_ANY_CASE if any_case else _ANY) + pattern))


@cache
def _singly() -> tuple[str, str]:
    """The letters with another letter for a capital, and those: title forms where the capital is several letters, as of ß."""
    pairs = [(c, u) for c in map(chr, range(1, 0x110000)) for u in ("ẞ" if c == "ß" else c.upper() if len(c.upper()) == 1 else c.title(),) if len(u) == 1 and u != c]
    return "".join(c for c, _ in pairs), "".join(u for _, u in pairs)


def upper_singly(text: Column) -> Column:
    """Upper-cased letter by letter, as SQL engines do; ``upper`` makes SS of ß and FI of a ligature, as Python does."""
    return F.translate(text, *_singly())


def normalise(text: Column) -> Column:
    """White space at the ends dropped, and made one space elsewhere."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def identifiers(text: Column, line_tag: str = LINE_TAG) -> Column:
    """Tags and notes in text, upper-cased and without spaces: instruments, equipment, lines, notes, each once."""
    found = F.concat(all_of(text, INSTRUMENT), all_of(text, EQUIPMENT), all_of(text, line_tag, any_case=False), all_of(text, NOTE))
    return F.array_distinct(F.transform(found, lambda x: F.replace(F.upper(normalise(x)), F.lit(" "), F.lit(""))))


def kind(text: Column, ids: Column) -> Column:
    return (
        F.when(has(text, NOTE), "note")
        .when(F.exists(ids, lambda i: has(i, INSTRUMENT)), "instrument_tag")
        .when(F.exists(ids, lambda i: has(i, EQUIPMENT)), "equipment_tag")
        .when(has(text, LINE_TAG, any_case=False), "line_tag")
        .when(has(text, CELL_WORDS) | has(text, SETPOINT), "table_cell")
        .otherwise("text")
    )


def numbers(text: Column) -> Column:
    return all_of(F.upper(F.coalesce(text, F.lit(""))), NUMBER, any_case=False)


def squashed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def whitespace_only_difference(a: Column, b: Column) -> Column:
    return (squashed(a) != "") & (squashed(a) == squashed(b))


def is_noise(text: Column) -> Column:
    """Empty, a revision or sheet label, a grid label, or a single character."""
    t = F.upper(normalise(text))
    return (F.length(t) <= 1) | t.startswith("REV:") | t.startswith("SHEET:") | t.rlike(r"^(?:[A-H]|\d)$")


def stable_tokens(text: Column) -> Column:
    return F.transform(all_of(F.coalesce(text, F.lit("")), STABLE_TOKEN), F.upper)


def query_tags(question: Column) -> Column:
    """Tags of a question; one that both patterns find comes twice."""
    return F.concat(F.transform(all_of(question, QUERY_TAG), lambda t: F.replace(F.upper(t), F.lit(" "), F.lit(""))), F.transform(all_of(question, BARE_TAG), F.upper))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


#: The words that route a question; of the rows that fit, the last counts.
ROUTES = (
    ("delta", ("change", "delta", "added", "removed", "difference", "modified", "moved"), ("delta", "rev_a", "rev_b")),
    ("rev_a", ("before", "old", "rev a", "revision a", "pid a"), ("rev_a", "delta")),
    ("rev_b", ("current", "new", "rev b", "revision b", "pid b", "after"), ("rev_b", "delta")),
    ("delta_high", ("high-confidence", "high confidence"), ("delta",)),
)


def route(question: Column) -> Column:
    """(intent, families, proximity) of a question."""
    q = F.lower(question)
    intent, families = F.lit("general"), F.array(*map(F.lit, ("rev_a", "rev_b", "delta")))
    for name, words, own in ROUTES:
        hit = has_any(q, words)
        intent, families = F.when(hit, name).otherwise(intent), F.when(hit, F.array(*map(F.lit, own))).otherwise(families)
    return F.struct(intent.alias("intent"), families.alias("families"), has(question, PROXIMITY).alias("proximity"))


def out_of_scope_revision(question: Column, labels: Column) -> Column:
    """The first revision label in a question, all digits or all letters, that is not of labels; or null."""
    asked = F.transform(all_of(question, REVISION_LABEL, 1), F.upper)
    out = F.filter(asked, lambda x: ~F.array_contains(labels, x) & (x.rlike(r"^\d+$") | x.rlike("^[A-Z]+$")))
    return F.when(F.size(labels) > 0, F.get(out, F.lit(0)))


def content_tokens(question: Column) -> Column:
    return F.array_distinct(F.filter(all_of(F.lower(question), CONTENT_TOKEN, any_case=False), lambda t: ~t.isin(*STOP_WORDS)))


def token_set(text: Column) -> Column:
    return F.array_distinct(all_of(F.lower(F.coalesce(text, F.lit(""))), CONTENT_TOKEN, any_case=False))


def lower_numbers(text: Column) -> Column:
    return F.array_distinct(all_of(F.lower(F.coalesce(text, F.lit(""))), r"(?<![a-z])\d+(?:[.,]\d+)?", any_case=False))


def fact_present(fact: Column, text: Column) -> Column:
    """Whether a fact stands in a text: a number between digit boundaries, other facts without regard to white space."""
    f, t = F.lower(normalise(fact)), F.lower(F.coalesce(text, F.lit("")))
    bounded = F.concat(F.lit(r"(?<![\d.,])\Q"), f, F.lit(r"\E(?!\d|[.,]\d)"))
    return F.when(f == "", True).when(f.rlike(r"^[\d.,]+$"), F.regexp_like(t, bounded)).otherwise(F.contains(squashed(t), squashed(f)))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


# Absolute paths in texts, and what stands in their place
PATHS, REDACTED = (r"(?i)\b[A-Z]:[\\/][^\s,;\"']+", r"(?<![\w:])/(?:[^/\s]+/)+[^\s,;\"']*"), "<redacted-path>"


def redact_paths(text: Column) -> Column:
    """A text without absolute paths."""
    return reduce(lambda t, pattern: F.regexp_replace(t, pattern, REDACTED), PATHS, text)


def without_paths(text: str) -> str:
    """The same on the driver."""
    return reduce(lambda t, pattern: re.sub(pattern, REDACTED, t), PATHS, text)


def valid_request_id(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(REQUEST_ID), F.lit(False))


def grid_label(x0: Column, y0: Column, x1: Column, y1: Column, columns: int = 8, rows: int = 6, letters_down: bool = True, approximate: bool = True) -> Column:
    """Row letter and column number of a box's centre, or with letters across, the other way round."""
    at = lambda low, high, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), ((low + high) / 2 * n).cast("int")))
    across, down = at(x0, x1, columns), at(y0, y1, rows)
    letter, number = (down, across) if letters_down else (across, down)
    return F.concat(F.chr(letter + 65), (number + 1).cast("string"), F.lit("~" if approximate else ""))


def element_id(pid: Column, page: Column, kind_: Column, text: Column, *box: Column) -> Column:
    """A hash of what an element is and where, to a hundredth of the page."""
    places = F.concat(F.lit("("), F.concat_ws(", ", *[F.rint(v / 0.01).cast("long").cast("string") for v in box]), F.lit(")"))
    return F.concat(F.lit("e_"), F.substring(F.sha1(F.concat_ws("|", pid, page.cast("string"), kind_, text, places)), 1, 12))
