"""SQL text fragments for the DuckDB side of the correctness checks.

They restate the scalar functions of ``veriloom.functions.text`` in the
dialect of the checking engine, independently of the Spark expressions.
"""

from __future__ import annotations

from veriloom.functions import vocab as V


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chars(s: str) -> str:
    """A text of arbitrary code points as an expression (no control characters in the SQL text)."""
    out = []
    for ch in s:
        out.append(lit(ch) if 32 <= ord(ch) < 127 else f"chr({ord(ch)})")
    return "(" + " || ".join(out) + ")"


SPACES = chars(V.SPACE_CHARS)


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def no_invisible(x: str) -> str:
    return f"translate({x}, {chars(V.INVISIBLE_CHARS)}, '')"


def clean_display(x: str) -> str:
    return strip(f"regexp_replace(coalesce({x}, ''), '[' || {SPACES} || ']+', ' ', 'g')")


def name(x: str) -> str:
    t = f"lower({strip(f'coalesce({x}, {lit(chr(39) * 0)})')})"
    t = f"translate({t}, '’‘“”', '''''\"\"')"
    t = f"trim({t}, {lit(V.EDGE_CHARS)})"
    once = r"'''s([^\p{L}\p{N}_]|$)'"
    t = f"regexp_replace(regexp_replace({t}, {once}, '\\1', 'g'), {once}, '\\1', 'g')"
    t = f"trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g'))"
    t = f"regexp_replace({t}, '^(?:(?:{'|'.join(V.ARTICLES + V.HONORIFICS)})(?: |$))+', '')"
    t = f"regexp_replace({t}, '(?:(?:^| )(?:{'|'.join(V.CORP_SUFFIXES)}))+$', '')"
    return f"trim({t})"


def canon(text: str, normalized: str) -> str:
    return f"coalesce(nullif({name(text)}, ''), nullif({name(normalized)}, ''), lower({strip(f'coalesce({normalized}, {lit(chr(39) * 0)})')}))"


def words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"
