"""One registered query per operator, each over its whole table, with a DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read_table, ship_package
from quarry.queries.registry import Registry

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle

WORDS = r"[^\x20\x09-\x0D]+"


@register("op7_sampled_splitter_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.sharding import shard_by_bytes

    placed = shard_by_bytes(read_table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


#: The extra conversation of the op4 contract: both turns say a string made of control marks.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@register("op4_chat_round_trip", r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), conv AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         bool_or(contains(role || text, '<|says|>') OR contains(text || role, '<|end|>' || chr(10))) AS clash,
         sum(24 + length(role) + length(text)) AS chars,
         sum(len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS marks
  FROM said GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       (11 + chars + CASE WHEN clash THEN marks ELSE 0 END)::BIGINT AS formatted_chars
FROM conv""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.chat_format import format_conversations, masked_text, parse
    from quarry.llm.common import materialize

    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    written = materialize(format_conversations(rows.unionByName(extra)), "chat")
    read = written.withColumns({"_turns": parse(F.col("formatted")),
                                "_loss": masked_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0, max_tokens=2048)


@register("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_files import read_token_files, token_folder, write_token_files

    folder = token_folder(spark)
    index = write_token_files(read_table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(index, folder)


@register("op9_rule_cascade")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.rules import RULES, cascade, cheapest_order, measure

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    order = cheapest_order(measure(docs))
    metrics = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = cascade(docs, order, metrics=metrics)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *metrics, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def _id_part(parts: int):
    """crc32 of the document id as text, modulo ``parts``: the split of the labelled rows."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


@register("op8_pu_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_pu import fit, labelled_prior, with_quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    known = read_table(spark, sf_dir, "labels").filter(_id_part(5) != 0)
    model = fit(docs, known.filter(F.col("quality") == 1), prior=labelled_prior(known))
    scored = with_quality(docs, model).drop("text")
    return scored.select("doc_id", (_id_part(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op6_toxic_segments")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import fit, with_toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    known = read_table(spark, sf_dir, "labels").filter(_id_part(4) != 2).select("doc_id", "toxic")
    scored = with_toxicity(docs, fit(docs, known)).drop("text", "segments")
    return scored.select("doc_id", (_id_part(4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op2_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontaminate import split_item

    return read_table(spark, sf_dir, "benchmark").select("item_id", *split_item("text"))


@register("op5_bm25_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontaminate import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), benchmark_items(spark, sf_dir))


@register("op10_disclosure_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.pii import KINDS, span_text, with_spans

    spans = with_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(span_text(KINDS), 256).alias("base_sha256"),
                        span_text((*KINDS, "term")).alias("spans"))


#: The columns of a document's leaf, in order.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@register("op12_merkle_manifest", """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, *, sha256(leafed) AS leaf, sha256(CASE WHEN bad THEN spoilt ELSE leafed END) AS seen
  FROM (SELECT *, head || coalesce(strlen(text) || ':' || text, '-') AS leafed,
               head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS spoilt,
               xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1),
                     lambda i: ascii((doc_id::VARCHAR)[i])::UBIGINT)),
                   lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))),
                   4294967295) % 5 = 0 AS bad
        FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                     || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
              FROM documents))
), first AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM docs
), nodes AS (
  SELECT 0 AS level, g, idx, n, leaf AS h FROM first
  UNION ALL
  SELECT level + 1, g, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, g, idx // 16, n
), subs AS (
  SELECT *, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM (SELECT g, level AS height, h FROM nodes WHERE n = 1)
), tops AS (
  SELECT 0 AS level, idx, n, h FROM subs
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 16, n
), tree AS (  -- one numbering of levels per group: its own, then those of the top tree
  SELECT g, level, idx, h FROM nodes WHERE n > 1
  UNION ALL SELECT s.g, s.height + t.level, t.idx, t.h FROM subs s, tops t WHERE t.n > 1
), walk AS (
  SELECT r, 0 AS level, f.g, CASE WHEN s.height = 0 THEN s.idx ELSE f.idx END AS idx, seen AS h FROM first f JOIN subs s ON s.g = f.g
  UNION ALL
  SELECT w.r, w.level + 1, w.g, CASE WHEN w.level + 1 = any_value(s.height) THEN any_value(s.idx) ELSE w.idx // 16 END,
         sha256(string_agg(CASE WHEN t.idx = w.idx THEN w.h ELSE t.h END, '' ORDER BY t.idx))
  FROM walk w JOIN tree t ON t.g = w.g AND t.level = w.level AND t.idx // 16 = w.idx // 16 JOIN subs s ON s.g = w.g
  GROUP BY w.r, w.level, w.g, w.idx
), path AS (
  SELECT w.r, string_agg(t.h, '' ORDER BY w.level, t.idx) AS hs
  FROM walk w JOIN tree t ON t.g = w.g AND t.level = w.level AND t.idx // 16 = w.idx // 16 AND t.idx <> w.idx GROUP BY w.r
), roots AS (SELECT h FROM tops WHERE n = 1)
SELECT f.doc_id, f.leaf, s.h AS subroot, roots.h AS root, sha256(coalesce(path.hs, '')) AS proof_sha256, w.h AS folded_root, w.h = roots.h AS verified
FROM first f JOIN subs s ON s.g = f.g CROSS JOIN roots LEFT JOIN path ON path.r = f.r
JOIN (SELECT r, max_by(h, level) AS h FROM walk GROUP BY r) w ON w.r = f.r""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.merkle import fold, leaf_digest, manifest, proof_digest

    docs = read_table(spark, sf_dir, "documents").select(*LEAF_FIELDS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    spoilt = [F.translate(c, upper, upper.lower()) if c == "text" else F.col(c) for c in LEAF_FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    row = F.struct("doc_id", F.when(tampered, leaf_digest(spoilt)).alias("seen"))
    made = manifest(docs, leaf_digest([F.col(c) for c in LEAF_FIELDS]), "source", "doc_id", row)
    proofs = made.proofs().withColumn("folded_root", fold(F.coalesce("row.seen", "leaf"), F.col("path")))
    root = F.lit(made.root)
    return proofs.select("row.doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == root).alias("verified"))


@register("op13_subword_lattice")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.subword_lm import score_texts

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _id_part(10) == 0
    made = score_texts(docs, ~held_out, tokenizer_path("piece_bpe_32k.model"), F.struct("doc_id", held_out.alias("held_out")))
    return made.texts.select("kept.doc_id", "kept.held_out", "n_tokens", "n_known", F.lit(made.train_tokens).cast("long").alias("train_tokens"),
                             "base_score", "score")


@register("op11_hard_negatives", """
WITH vec AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM vec a JOIN vec v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read_table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", F.col("id") % 100 == 0)
