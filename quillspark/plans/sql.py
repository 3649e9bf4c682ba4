"""Common table expressions of the SQL texts."""

from __future__ import annotations

from quillspark.functions import spans, text
from quillspark.sources.notes import MARKED


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def marked(c: str) -> str:
    for a, b in MARKED:
        c = f"replace({c}, {lit(a)}, {lit(b)})"
    return c


LAYER = "CASE doc_id % 4 WHEN 0 THEN 'inbox' WHEN 1 THEN 'distilled' WHEN 2 THEN 'skills' ELSE 'output' END"
_BASE = f"SELECT doc_id, 'doc_' || doc_id AS name, source || '/doc_' || doc_id || '.md' AS path, source AS bucket, {LAYER} AS layer, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 120 AS INTEGER)) AS mtime"
NOTES = f"notes AS ({_BASE}, text FROM documents)"
MARKED_NOTES = f"notes AS ({_BASE}, {marked('text')} AS text FROM documents)"
MARKDOWN = f"""marked AS ({_BASE}, {marked("text")} AS text FROM documents),
notes AS (SELECT doc_id, name, path, bucket, layer, mtime, '---' || chr(10) || 'description: ' || replace(left(text, 60), chr(10), ' ') || chr(10) || '---' || chr(10) || '# ' || name || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- ') AS text FROM marked)"""
S = r"[ \t\n\x0b\f\r]+"
TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def compact(c: str) -> str:
    return f"trim(regexp_replace({c}, '{S}', ' ', 'g'))"


def normalize(c: str) -> str:
    return f"replace(replace(replace(lower({c}), '｜', ' '), '_', ' '), '-', ' ')"


def lines(c: str) -> str:
    return f"string_split({c}, chr(10))"


def frontless(c: str) -> str:
    ls = lines(c)
    pos = f"list_position(list_transform({ls}[2:], lambda x: trim(x, {TRIM})), '---')"
    return f"CASE WHEN trim({ls}[1], {TRIM}) = '---' AND coalesce({pos}, 0) > 0 THEN coalesce(array_to_string({ls}[{pos} + 2:], chr(10)), '') ELSE {c} END"


def any_match(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {lit(p)})" for p in patterns) + ")"


def noise(x: str) -> str:
    t = compact(x)
    return (
        f"({t} = '' OR {any_match(t, text.NOISE_PATTERNS)} OR regexp_matches({t}, {lit(r'(?i)^\*+[ ]*Description[ ]*\*+$')}) OR {t} IN ({', '.join(map(lit, text.NOISE_LINES))})"
        f" OR {' OR '.join(f'starts_with({t}, {lit(s)})' for s in text.NOISE_STARTS)} OR regexp_matches({t}, {lit(text.PLAIN_LINE)}))"
    )


def unmarked(c: str) -> str:
    return f"regexp_replace(regexp_replace({frontless(c)}, '(?is)<iframe.*?</iframe>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


def clean_text(c: str) -> str:
    t = f"regexp_replace(regexp_replace({unmarked(c)}, '(?s)```.+?```', ' ', 'g'), 'https?://[^ \\t\\n\\x0b\\f\\r]+', ' ', 'g')"
    return compact(f"array_to_string(list_filter({lines(t)}, lambda x: NOT {any_match('x', text.DROP_LINES)}), chr(10))")


def clean_content(c: str) -> str:
    t = f"regexp_replace({unmarked(c)}, 'https?://[^ \\t\\n\\x0b\\f\\r]+', ' ', 'g')"
    head = lit(r"(?i)^[ \t]*\*+[ \t]*Description[ \t]*\*+[ \t]*")
    kept = f"list_transform(list_filter({lines(t)}, lambda x: NOT {noise('x')}), lambda x: trim(regexp_replace(x, {head}, ''), {TRIM}))"
    return f"coalesce(array_to_string(list_filter({kept}, lambda x: x <> ''), chr(10)), '')"


def sentences(c: str) -> str:
    t = f"regexp_replace({c}, '{S}', ' ', 'g')"
    return f"list_filter(list_transform(regexp_extract_all({t}, '[^。！？!?]*[。！？!?]|[^。！？!?]+'), lambda x: trim(x)), lambda x: length(x) >= 12)"


def comment(x: str) -> str:
    return any_match(x, (spans.COMMENT, spans.PLATFORM))


def first_distinct(l: str, n: int) -> str:
    """The first n distinct elements of a list expression, as a joined text."""
    return f"array_to_string(list_filter({l}, lambda x, i: list_position({l}, x) = i)[1:{n}], '|')"
