r"""Personal data: pattern detection and information-theoretic sanitisation (native: DataFrame functions only).

Base spans are leftmost non-overlapping matches per kind (email, ip, card, phone); matches that fail their check
(parts at most 255, Luhn and 16 to 19 digits, 8 to 15 digits) are dropped without a retry. The regular
expressions are the plain ones made possessive, so a long run of digits or letters costs linear time.

The method then asks which terms give a protected entity away. For an entity e (a matched value) and a term t
near it, over the corpus of N distinct texts,

    PMI(t; e) = log( p(t | contexts of e) / p(t) )      IC(e) = -log( p(e) )

and t discloses e where PMI(t; e) >= disclosure * IC(e). p(t) counts whole texts; contexts are the ``reach``
characters on either side. Equal texts and equal contexts (copies) count once, so a copied document is no evidence,
neither that a term goes with an entity nor that it is common. Entities and terms need ``support`` distinct contexts. Terms are whole words of any length that begin with a letter; the statistics
alone decide which are too common to disclose. Every occurrence of a disclosing term, in any document and at any distance
from the entity, becomes a span of kind ``term``: those that determine an entity fully are removed, the others are
generalised.

Defined cases: null text is empty and has no spans; repeated rows have equal spans; an empty table gives no rows; other
columns are kept by ``sanitize``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, text_key

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}[\p{L}\p{N}]*+"
BYTE_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?(?:\.|$)){4}"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

SPAN = "struct<start:bigint,end:bigint,value:string>"


def find(text: Column, pattern: str, base: Column | None = None) -> Column:
    """Spans (code points, end exclusive) of all matches: the gaps between matches give their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct((F.lit(0) if base is None else base).cast("long").alias("at"),
                     F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(s, x):
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(s["out"], span).alias("out"))

    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found,
                       lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step)["out"]).otherwise(start["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.split(F.reverse(_digits(x)), "")

    def weigh(c, i):
        v = c.cast("int")
        return F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    total = F.aggregate(F.transform(F.filter(d, lambda c: c != ""), weigh), F.lit(0), lambda a, v: a + v)
    return F.length(_digits(x)).between(16, 19) & (total % 10 == 0)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans per kind. A cheap test comes first: most texts hold no match of a kind."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    email = F.when(F.contains(text, F.lit("@")), find(text, EMAIL)).otherwise(none)
    ip = F.filter(find(text, IP), lambda s: s["value"].rlike(BYTE_PARTS))
    card = F.filter(find(text, CARD), lambda s: _luhn(s["value"]))
    phone = F.when(F.contains(text, F.lit("+")), F.filter(
        find(text, PHONE), lambda s: F.length(_digits(s["value"])).between(8, 15))).otherwise(none)
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def _entity(kind: str, value: Column) -> Column:
    plain = {"email": F.lower(value), "card": _digits(value), "phone": _digits(value)}.get(kind, value)
    return F.concat(F.lit(kind + ":"), plain)


def _context(text: Column, kind: str, spans: Column, reach: int) -> Column:
    """Per span: the entity, a hash of the text around it and the terms that lie whole in it, outside the entity."""

    def one(s):
        lo = F.greatest(F.lit(0).cast("long"), s["start"] - reach)
        left = F.substring(text, (lo + 1).cast("int"), (s["start"] - lo).cast("int"))
        right = F.substring(text, (s["end"] + 1).cast("int"), F.lit(reach))
        at = F.greatest(F.lit(0).cast("long"), lo - 1)  # one character more on either side tells which terms are whole
        wide = F.substring(text, (at + 1).cast("int"), (s["end"] + reach + 1 - at).cast("int"))
        cut = (at > 0) & wide.rlike(r"^\p{N}++\p{L}") & F.substring(text, F.lit(1), at.cast("int")).rlike(r"\p{L}\p{N}*+$")
        whole = F.filter(find(wide, TERM, at), lambda t, i: (t["start"] >= lo) & (t["end"] <= s["end"] + reach)
                         & ((t["end"] <= s["start"]) | (t["start"] >= s["end"])) & ((i > 0) | ~cut))
        return F.struct(_entity(kind, s["value"]).alias("entity"), F.xxhash64(left, right).alias("context"),
                        F.array_distinct(F.transform(whole, lambda t: F.lower(t["value"]))).alias("terms"))

    return F.transform(spans, one)


def detect(docs: DataFrame, text: str = "text", reach: int = 80, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all), ``_text_key``, one array of spans per kind (``_email`` ...) and ``_near``."""
    keep = docs.columns if keep is None else keep
    body = docs.withColumn("_body", F.coalesce(F.col(text), F.lit("")))
    body = body.withColumns({f"_{k}": c for k, c in base_spans(F.col("_body")).items()})
    near = F.concat(*[_context(F.col("_body"), k, F.col(f"_{k}"), reach) for k in KINDS])
    return materialize(body.select(*keep, text_key("_body").alias("_text_key"), *(f"_{k}" for k in KINDS), near.alias("_near")), "pii")


def _words(text: Column) -> Column:
    """The distinct terms of a text. Case is folded after the match, as for the terms beside an entity."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def _bodies(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(text_key(body).alias("_text_key"), body.alias("_body"))


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many distinct texts each term occurs, over all documents and whole texts. Copies are
    dropped by a partial aggregate first."""
    once = _bodies(docs, text).groupBy("_text_key").agg(F.first("_body").alias("_body"))
    return once.select(F.explode(_words(F.col("_body"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str = "text", disclosure: float = 0.8,
                     support: int = 3) -> DataFrame:
    """(term, full) of the terms that give an entity away; full: one of them altogether."""
    near = found.filter(F.size("_near") > 0).select(F.explode("_near").alias("x")).select("x.*")
    seen = near.select("entity", "context", F.explode("terms").alias("term"))
    entities = near.groupBy("entity").agg(F.countDistinct("context").alias("n_e")).filter(F.col("n_e") >= support)
    both = (seen.join(entities.select("entity"), "entity", "left_semi").groupBy("entity", "term")
            .agg(F.countDistinct("context").alias("n_te")).filter(F.col("n_te") >= support).join(entities, "entity"))
    both = materialize(both, "pii-pairs")
    # written first: else the semi-join would move below the counting and meet every occurrence of a term
    df = materialize(document_counts(docs, text), "term-counts").join(both.select("term").distinct(), "term", "left_semi")
    n = F.lit(float(max(found.select("_text_key").distinct().count(), 1)))
    pmi = F.log(F.col("n_te") / F.col("n_e") * n / F.col("df"))
    told = both.join(df, "term").withColumns({"_ic": F.log(n / F.col("n_e")), "_pmi": pmi}) \
        .filter((F.col("_pmi") > 0) & (F.col("_pmi") >= disclosure * F.col("_ic")))
    return told.groupBy("term").agg(F.max(F.col("_pmi") >= 0.999 * F.col("_ic")).alias("full"))


def _occurrences(text: Column, told: Column) -> Column:
    """Spans (start, end, full) of the told terms in a text, in order. Only they are collected: linear in the text."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, TERM, -1), 1, F.size(found)), found,
                       lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.expr("cast(array() as array<struct<start:bigint,end:bigint,full:boolean>>)").alias("out"))

    def step(s, x):
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        hit = F.filter(told, lambda t: t["term"] == F.lower(x["value"]))
        span = F.transform(hit, lambda t: F.struct(begin.alias("start"), end.alias("end"), t["full"].alias("full")))
        return F.struct(end.alias("at"), F.when(F.size(hit) > 0, F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def term_spans(docs: DataFrame, told: DataFrame, text: str = "text") -> DataFrame:
    """(_text_key, _term) of every distinct text that holds a told term: all its occurrences, wherever they stand."""
    rows = _bodies(docs, text)
    held = rows.select("_text_key", F.explode(_words(F.col("_body"))).alias("term")).join(told, "term") \
        .groupBy("_text_key").agg(F.collect_set(F.struct("term", "full")).alias("_told"))
    at = rows.join(materialize(held, "told-texts"), "_text_key").select("_text_key", _occurrences(F.col("_body"), F.col("_told")).alias("_term"))
    return at.groupBy("_text_key").agg(F.first("_term").alias("_term"))


def with_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None, disclosure: float = 0.8,
               support: int = 3, reach: int = 80) -> DataFrame:
    """``keep`` columns, a span array per base kind and ``_term``: array of (start, end, full) in order."""
    found = detect(docs, text, reach, keep)
    told = materialize(disclosing_terms(docs, found, text, disclosure, support), "told-terms")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,full:boolean>>)")
    return found.join(term_spans(docs, told, text), "_text_key", "left") \
        .withColumn("_term", F.coalesce("_term", none)).drop("_near", "_text_key")


def span_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by kind as given, then start, comma-joined."""

    def said(k):
        return F.transform(f"_{k}", lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[said(k) for k in kinds]), ",")


def sanitize(docs: DataFrame, text: str = "text", disclosure: float = 0.8, support: int = 3, reach: int = 80) -> DataFrame:
    """All columns of ``docs`` with ``text`` sanitised: entities and generalised terms become their mark, terms that
    determine an entity are removed. Where spans of different kinds overlap, the earlier kind wins."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))  # own names cannot clash
    spans = with_spans(packed, "text", None, disclosure, support, reach)

    def marked(kind: str, rank: int, mark) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), mark(s).alias("mark")))

    masks = [marked(k, r, lambda s, k=k: F.lit(MASKS[k])) for r, k in enumerate(KINDS)]
    all_ = F.concat(*masks, marked("term", len(KINDS), lambda s: F.when(s["full"], F.lit("")).otherwise(F.lit(MASKS["term"]))))
    body = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(s, x):
        gap = F.substring(body, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(gap, x["mark"])).alias("out")))

    done = spans.withColumn("_all", F.sort_array(all_)).withColumn("_cut", F.aggregate("_all", start, step))
    clean = F.concat(F.array_join("_cut.out", ""), F.substring(body, (F.col("_cut.at") + 1).cast("int"), F.lit(2_147_483_647)))
    shown = F.when(F.size("_all") > 0, clean).otherwise(F.col("text"))
    return done.select(*[shown.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
