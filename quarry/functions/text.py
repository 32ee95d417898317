"""Text expressions as native Spark columns (no UDF): Python ``str.strip``/``str.split`` semantics,
n-grams, distinct-n, target matching, letter picks, labels and formatting.

Every function takes and returns ``Column`` so Catalyst keeps them inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points Python's str.split()/str.strip() treat as whitespace, written as a
# regex character class that Java (Spark) and RE2 (DuckDB) both accept.
WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same set for Java as one property lookup plus a range (Unicode White_Space lacks U+001C-U+001F);
# equal to WS_CLASS on every code point and about 1.8x faster to match.
SPARK_WS_CLASS = r"[\p{IsWhite_Space}\x1C-\x1F]"
STRIP_PATTERN = rf"\A{SPARK_WS_CLASS}++|{SPARK_WS_CLASS}++\z"
SPLIT_PATTERN = rf"{SPARK_WS_CLASS}++"
RARE_WS_CLASS = r"[\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"  # WS_CLASS but space, tab, newline
# The same 29 code points as a plain string, for btrim (Python strip() == trim these from both ends).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# RE2 (DuckDB oracle) forms.
STRIP_PATTERN_RE2 = rf"\A{WS_CLASS}+|{WS_CLASS}+\z"
SPLIT_PATTERN_RE2 = rf"{WS_CLASS}+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``s.strip()``; null stays null. ``btrim`` over the whitespace set touches only the two
    ends of the string (no regex scan of the whole text)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def py_split(c) -> Column:
    """Python ``s.split()`` tokens: no empty tokens; null -> empty array."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), SPLIT_PATTERN)
    return F.filter(parts, lambda x: x != "")


def py_split_spaces(c) -> Column:
    """``py_split`` by plain one-character splits, several times cheaper; texts with whitespace besides space, tab and newline go to the
    regex."""
    t = F.replace(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    return F.when(t.rlike(RARE_WS_CLASS), py_split(c)).otherwise(F.filter(F.split(t, " "), lambda x: x != ""))


def word_count(c) -> Column:
    return F.size(py_split(c)).cast("bigint")


def extend_grams(prev, tokens, n: int) -> Column:
    """n-grams from the (n-1)-grams: pair gram i with token i+n-1 (``zip_with``), drop the padded tail."""
    tk = _col(tokens)
    z = F.zip_with(_col(prev), F.slice(tk, n, F.greatest(F.size(tk), F.lit(1))),
                   lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(z, 1, F.greatest(F.size(tk) - (n - 1), F.lit(0)))


def ngrams(tokens, n: int) -> Column:
    """Space-joined n-grams of a token array, in order; empty when fewer than ``n`` tokens."""
    tk = _col(tokens)
    g = tk
    for k in range(2, n + 1):
        g = extend_grams(g, tk, k)
    return g


def ngram_total(tokens, n: int) -> Column:
    return F.greatest(F.size(_col(tokens)) - (n - 1), F.lit(0)).cast("bigint")


def gram_digest(grams: Column) -> Column:
    """md5 of all grams in order, one per line: a wrong gram anywhere changes it."""
    return F.md5(F.array_join(grams, "\n"))


def ngram_unique(tokens, n: int) -> Column:
    return F.size(F.array_distinct(ngrams(tokens, n))).cast("bigint")


def distinct_ratio(unique: Column, total: Column) -> Column:
    """unique / total, 0.0 when total is 0 (zeros count in means)."""
    return F.coalesce(F.try_divide(unique.cast("double"), total.cast("double")), F.lit(0.0))


def token_budget(tokens, k: int) -> Column:
    """First ``k`` tokens of an array."""
    return F.slice(_col(tokens), 1, k)


def first_target_correct(generated, target_true, target_false) -> Column:
    """True when the (stripped, lower-cased) true target occurs strictly before the false one.

    Only-true -> true; only-false or neither -> false; equal start (one prefixes the other) -> false.
    ``instr`` is 1-based and returns 1 for an empty needle, matching Python ``find`` on ''.
    """
    g = F.lower(py_strip(generated))
    t = F.lower(py_strip(target_true))
    f = F.lower(py_strip(target_false))
    pt, pf = F.instr(g, t), F.instr(g, f)
    return F.coalesce((pt > 0) & ((pf == 0) | (pt < pf)), F.lit(False))


def choice_letter(reply) -> Column:
    """First character of the reply that is one of A-D in any case, upper-cased; '' if none."""
    return F.upper(F.regexp_extract(F.coalesce(_col(reply), F.lit("")), "[A-Da-d]", 0))


def keep_or_discard(reply) -> Column:
    """KEEP when the upper-cased reply contains KEEP anywhere ("do not keep" too), else DISCARD."""
    r = F.upper(py_strip(reply))
    return F.when(F.coalesce(r.contains("KEEP"), F.lit(False)), F.lit("KEEP")).otherwise(F.lit("DISCARD"))


def last_segment(c, marker: str) -> Column:
    """Text after the last ``marker`` (whole text when absent), stripped."""
    return py_strip(F.substring_index(_col(c), marker, -1))


def run_label(name, family) -> Column:
    """``base`` when the name contains 'base' (any case), else ``<family>_n<k>`` from ``lora_n<k>``,
    else ``<family>_unknown``."""
    nm = _col(name)
    n = F.regexp_extract(nm, r"lora_n([0-9]+)", 1)
    return (
        F.when(F.lower(nm).contains("base"), F.lit("base"))
        .when(n != "", F.concat(_col(family), F.lit("_n"), n))
        .otherwise(F.concat(_col(family), F.lit("_unknown")))
    )


def signed_delta(c) -> Column:
    """4 decimals with a leading '+' when positive."""
    d = _col(c)
    body = F.format_string("%.4f", d)
    return F.when(d > 0, F.concat(F.lit("+"), body)).otherwise(body)


def epoch_to_date(c) -> Column:
    """Epoch seconds -> ``yyyy-MM-dd`` in the session time zone (pinned to UTC)."""
    return F.date_format(F.timestamp_seconds(_col(c)), "yyyy-MM-dd")


def run_stamp(ts) -> Column:
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss")


def parse_run_stamp(path) -> Column:
    """Time of a run stamp in a name: ``20240102_030405`` or ``2024-01-02T03-04-05`` (fractions are dropped)."""
    s = F.regexp_extract(_col(path), r"([0-9]{8}_[0-9]{6})", 1)
    iso = F.regexp_extract(_col(path), r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}-[0-9]{2}-[0-9]{2})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(s, F.lit("")), F.lit("yyyyMMdd_HHmmss")),
                      F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd'T'HH-mm-ss")))


def truncate_detail(c, n: int, ellipsis: bool = False) -> Column:
    """Keep the first ``n`` characters; with ``ellipsis`` append '...' only when something was cut."""
    x = _col(c)
    if not ellipsis:
        return F.left(x, F.lit(n))
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)
