"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, chunk_table, decontaminate, hard_negatives, license_scan, line_dedup, pii, quality_rules, segment_bpe, simhash, token_counts, warc, whitening
from .common import read


#: A tokenizer's vocabulary file; a parameter of the operators, never copied.
VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), runs=True)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.char_length(kept).cast("long").alias("kept_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role FROM range(2)").withColumn("text", F.lit(said))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.read_back(chat_format.format_chats(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), "formatted_chars",
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(regexp_replace(text, '(###|</turn>)', '.\1', 'g')) + length('### : ') + length('</turn>') + 2) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    _, directory = warc.archive(pages, dedup_from=0)
    return warc.look_up(pages, directory)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, vocabulary(), limit=2048)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256)
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "longest_match", places.alias("hit_words"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.extract(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda c: F.size(c).cast("long")
    of = lambda k: n(F.filter("base", lambda s: s["kind"] == k)).alias(f"n_{k}")
    digest = F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return out.select(
        "doc_id", *map(of, ("email", "ip", "card", "phone")), digest, pii.joined(F.col("spans")).alias("spans"),
        n(F.col("spans")).alias("n_spans"), (n(F.col("spans")) - n(F.col("base"))).alias("n_found"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = license_scan.scan(docs, license_scan.train(license_scan.negative_sample(docs)))
    known = F.filter("licences", lambda x: x["family"] != "unknown")
    n = lambda a: F.size(a).cast("long")
    return out.select(
        "doc_id", "n_paragraphs", n(F.col("licences")).alias("n_licence_paragraphs"), n(known).alias("n_confirmed"),
        F.array_join(F.sort_array(F.array_distinct(known["family"])), ",").alias("families"),
    )


def op10_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = segment_bpe.encode(docs, vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4, scale=256)
    # a deviation beyond long is null here; the operator has it as a decimal
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = chunk_table.encode(docs, vocabulary(PIECES), begin=True, end=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, label=label, positives=5, negatives=5, low=80, high=100, scale=256)


OP8_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT r, doc_id, text, w, len(w) AS n_words,
         CASE WHEN len(w) < 5 THEN [] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM w),
windows AS (SELECT r, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM g),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in dict.fromkeys(quality_rules.STOP_WORDS))}))) AS n_stop,
         len(regexp_extract_all(text, '!')) AS n_exclaim, len(l) AS n_lines
  FROM g LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       NOT ({" AND ".join(r.sql() for r in quality_rules.BASE_RULES)}) AS base_failed,
       {" AND ".join(r.sql() for r in (*quality_rules.BASE_RULES, *quality_rules.RULES))} AS kept
FROM m
"""

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_chat_format, op3_simhash, op4_warc, op5_token_counts, op6_decontaminate, op7_pii, op8_quality_rules, op9_license_scan, op10_segment_bpe, op11_whitening, op12_sentencepiece, op13_hard_negatives)}
ORACLES = {"op2_chat_format": OP2_SQL, "op8_quality_rules": OP8_SQL}
