"""SQL fragments (DuckDB) that mirror the column functions, for the checks of query results."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

# White space as in kindred.functions.text, as a regular expression class.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@cache
def _compatible() -> str:
    """A map literal from each character with a compatibility decomposition to its full decomposition."""
    found = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.decomposition(c).startswith("<")]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"map([{', '.join(map(quote, found))}], [{', '.join(quote(unicodedata.normalize('NFKD', c)) for c in found)}])"


def macros() -> str:
    """CTE ``compat`` (one row, column m), to be cross joined with the table whose texts ``clean`` takes."""
    return f"compat AS MATERIALIZED (SELECT {_compatible()} AS m)"


def clean(text: str) -> str:
    """SQL of clean_text; the column m of ``compat`` must be in scope."""
    spread = (
        f"nfc_normalize(array_to_string(list_transform(string_split({text}, ''), lambda ch: "
        f"CASE WHEN ch < '\x80' THEN ch ELSE coalesce(m[ch], ch) END), ''))"
    )
    nfkc = f"CASE WHEN regexp_matches({text}, '[^\\x00-\\x7f]') THEN {spread} ELSE {text} END"
    return f"coalesce(trim(regexp_replace(lower({nfkc}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), '')"


def clean_id(text: str) -> str:
    return f"nullif(lower(regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')), '')"


def words(clean_text: str) -> str:
    return f"list_distinct(list_filter(string_split({clean_text}, ' '), lambda w: w <> ''))"


def components(edges: str) -> str:
    """CTEs (of a WITH RECURSIVE) ending in ``grouped`` (node, label): the smallest node of each component of (src, dst)."""
    return f"""edges AS MATERIALIZED ({edges}),
both_ways AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)),
reach(node, label) AS (
  SELECT DISTINCT src, src FROM both_ways
  UNION
  SELECT e.dst, r.label FROM reach r JOIN both_ways e ON e.src = r.node WHERE r.label < e.dst
),
grouped AS (SELECT node, min(label) AS label FROM reach GROUP BY node)"""


def terms(clean_text: str) -> str:
    """Unigrams of at least two characters and their bigrams, as a list."""
    long = f"list_filter(string_split({clean_text}, ' '), lambda w: length(w) >= 2)"
    return f"list_transform([{long}], lambda ws: list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))[1]"


def jaccard(a: str, b: str) -> str:
    """Set similarity of two clean texts."""
    x, y = words(a), words(b)
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"
