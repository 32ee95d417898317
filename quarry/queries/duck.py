"""DuckDB SQL fragments for the oracle twins: the same semantics as ``quarry.functions.text``, in SQL.

RE2 accepts the same whitespace class as Java, so both sides share ``WS_CLASS``. DuckDB's
``regexp_replace`` needs the 'g' flag to replace every match, as Spark does.
"""

from __future__ import annotations

from quarry.functions.template import pieces
from quarry.functions.text import SPLIT_PATTERN_RE2 as SPLIT_PATTERN
from quarry.functions.text import STRIP_PATTERN_RE2 as STRIP_PATTERN


def lit(s: str) -> str:
    """Python string -> DuckDB expression (newlines as chr(10))."""
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n")) + ")"


def fill(template: str, **sql: str) -> str:
    """SQL form of ``quarry.functions.template.fill``."""
    return " || ".join(sql[p] if named else lit(p) for p, named in pieces(template))


def strip(e: str) -> str:
    return f"regexp_replace({e}, '{STRIP_PATTERN}', '', 'g')"


def split(e: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({e}, ''), '{SPLIT_PATTERN}'), lambda x: x <> '')"


def ngrams(tk: str, n: int) -> str:
    if n == 1:
        return tk
    return f"list_transform(range(0, len({tk}) - {n - 1}), lambda i: array_to_string({tk}[i + 1:i + {n}], ' '))"


def ngram_total(tk: str, n: int) -> str:
    return f"CAST(greatest(len({tk}) - {n - 1}, 0) AS BIGINT)"


def ngram_unique(tk: str, n: int) -> str:
    return f"CAST(len(list_distinct({ngrams(tk, n)})) AS BIGINT)"


def ratio(u: str, t: str) -> str:
    return f"coalesce(CAST({u} AS DOUBLE) / nullif(CAST({t} AS DOUBLE), 0), 0.0)"


def word_count(e: str) -> str:
    return f"CAST(len({split(e)}) AS BIGINT)"
