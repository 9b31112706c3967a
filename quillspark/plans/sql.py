"""Pieces of DuckDB SQL that mirror the column expressions in functions.text."""

from __future__ import annotations

from quillspark.functions import lexicon as lx
from quillspark.functions import text as tx

_TOKEN = tx.TOKEN.replace("'", "''")


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{_TOKEN}')"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def sentences_sql(c: str) -> str:
    marked = f"regexp_replace({c}, '(?s)(\\S.*?[.!?…])(\\s)', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip_sql('s')}), lambda s: s <> '')"


def key_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"


def mask_sql(c: str) -> str:
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    c = f"regexp_replace({c}, '(?i)(?:https?://|www\\.)\\S+', ' url ', 'g')"
    c = f"regexp_replace({c}, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+\\.[\\p{{L}}\\p{{N}}_.-]+', ' email ', 'g')"
    c = f"regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g')"
    return f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits(c: str, phrases: tuple[str, ...]) -> str:
    return " + ".join(f"contains({c}, {quoted(p)})::INT" for p in phrases)


def verdict_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'MIXED' " + " ".join(f"WHEN {c} < {b} THEN '{v}'" for b, v in lx.VERDICTS[:-1]) + f" ELSE '{lx.VERDICTS[-1][1]}' END"


GENERIC_SQL = " + ".join(f"((length(low) - length(replace(low, {quoted(t)}, ''))) // {len(t)})" for t in lx.GENERIC)

#: RE2 has no lookaround: double every separator, so that each number keeps one on both sides.  A
#: date or decimal that begins with one digit takes its later parts with it, as one number.
_PLAIN = "len(regexp_extract_all(regexp_replace(content, '[^\\p{L}\\p{N}_]', '  ', 'g'), '(?:^| )\\d{2,}(?: |$)'))"
_DOTTED = "'(?:^|[^\\p{L}\\p{N}_])\\d[./-]\\d{1,2}(?:[./-]\\d{2,4})?(?:$|[^\\p{L}\\p{N}_])'"
NUMBERS_SQL = f"({_PLAIN.replace('content', f'regexp_replace(content, {_DOTTED}, chr(32) || chr(57) || chr(57) || chr(32), chr(103))')})"

SEGMENTS_SQL = f"""
body AS (SELECT doc_id, {strip_sql("replace(substring(text, 1, 100000), chr(1), ' ')")} AS b FROM d),
blk AS (
  SELECT doc_id, b, list_filter(list_transform(string_split(regexp_replace(b, '((?:[ \\t]*\\r?\\n[ \\t]*){{2,}})', chr(1), 'g'), chr(1)), lambda s: {strip_sql('s')}), lambda s: s <> '') AS p, {sentences_sql('b')} AS s FROM body
),
parts AS (SELECT doc_id, list_slice(CASE WHEN len(p) = 1 AND len(s) > 1 THEN s ELSE p END, 1, 50) AS x FROM blk),
seg AS (SELECT doc_id, unnest(x) AS content, generate_subscripts(x, 1) AS idx, len(x) AS n FROM parts)"""
