"""One query for each operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.llm.packing import best_fit_pack

    packed = best_fit_pack(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.llm.sp_codec import encode

    both = encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), dropout=0.1, seed=17, restored=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.llm.quality_classifier import held_out, learn_quality, score_quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn_quality(docs, labels, ~held_out(F.col("doc_id")))
    scored = score_quality(spark, docs, model, "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.llm.quality_rules import quality_rules

    return quality_rules(spark, table(spark, sf_dir, "documents"))


def op4_sql() -> str:
    from kinloom.llm.quality_rules import CUTOFF, steps_sql

    blank = r"[\x20\x09-\x0D]"
    stats = rf"""
texts AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT *, list_filter(string_split_regex(text, '{blank}+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM cut)),
repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM repeated, (SELECT unnest(range(5)) AS o) GROUP BY doc_id),
stats AS (
  SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM cut LEFT JOIN covered USING (doc_id))"""
    steps = "".join(f",\n{name} AS MATERIALIZED ({query})" for name, query in steps_sql())
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return f"""WITH {stats}{steps}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, {failed} AS base_failed,
  NOT {failed} AND (d2 IS NULL OR d2 <= {CUTOFF}) AS kept
FROM stats LEFT JOIN judged USING (doc_id)"""


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.llm.topk_search import topk_search

    return topk_search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP5_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.llm.line_dedup import dedup_lines

    kept = dedup_lines(spark, table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lined AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lined),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.llm.jaccard_join import jaccard_components

    return jaccard_components(spark, table(spark, sf_dir, "documents"), words=4, num=85, den=100)


SHARD_BYTES = 1 << 20


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.llm.scratch import Scratch
    from kinloom.llm.sharding import extendible_shards, write_shards

    path = f"{Scratch(spark, 'shard-files').root}/shards"
    sharded = extendible_shards(spark, table(spark, sf_dir, "documents"), SHARD_BYTES)
    write_shards(sharded, path)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return spark.read.schema(sharded.schema).parquet(path).select("doc_id", "shard", "depth", n_bytes, "shard_bytes")


OP8_SQL = f"""
WITH hashed AS (
  SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) AS n_bytes FROM documents),
levels AS (SELECT unnest(range(0, 61)) AS depth),
sums AS (
  SELECT depth, h >> (60 - depth) AS p, sum(n_bytes)::BIGINT AS shard_bytes FROM hashed, levels GROUP BY ALL),
found AS (
  SELECT doc_id, h, n_bytes, min(s.depth) AS depth FROM hashed JOIN sums s ON s.p = h >> (60 - s.depth)
  WHERE shard_bytes <= {SHARD_BYTES} GROUP BY ALL)
SELECT doc_id, substr(lpad(bin(h), 60, '0'), 1, f.depth::INT) AS shard, f.depth::INT AS depth, n_bytes, shard_bytes
FROM found f JOIN sums s ON s.depth = f.depth AND s.p = h >> (60 - f.depth)
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.llm.substring_dedup import dedup_units

    kept = dedup_units(spark, table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    return kept.select("doc_id", "n_units", "n_removed", gone.alias("removed_chars"), spans.alias("spans"), F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\n|[.!?,;:][ \t\r\x0b\x0c]+)', '\1' || chr(57344), 'g'), chr(57344)) AS us FROM documents),
clauses AS (
  SELECT doc_id, unnest(us) AS c, generate_subscripts(us, 1) AS i FROM cut),
ended AS (
  SELECT *, suffix(c, chr(10)) OR len(list_filter(string_split_regex(c, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 4 AS ends FROM clauses),
numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ended),
lined AS (
  SELECT doc_id, pos, string_agg(c, '' ORDER BY i) AS u FROM numbered GROUP BY doc_id, pos),
keyed AS (
  SELECT *, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY pos) - length(u) AS start, translate(trim(regexp_replace(u, '[\x20\x09-\x0D]+', ' ', 'g')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lined),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1 AS gone, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM keyed WHERE key <> ''),
islands AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM ranked WHERE gone),
runs AS (
  SELECT doc_id, min(start) AS a, max(start + length(u)) AS b, count(*) AS n FROM islands
  GROUP BY doc_id, island HAVING sum(len(string_split(key, ' '))) >= 30),
removed AS (
  SELECT doc_id, sum(n) AS n, sum(b - a) AS chars, string_agg(a::BIGINT || '-' || b::BIGINT, ' ' ORDER BY a) AS spans FROM runs GROUP BY doc_id)
SELECT k.doc_id, count(*) FILTER (WHERE key <> '') AS n_units, coalesce(max(d.n), 0)::BIGINT AS n_removed, coalesce(max(chars), 0)::BIGINT AS removed_chars,
  coalesce(max(spans), '') AS spans, sha256(coalesce(string_agg(u, '' ORDER BY pos) FILTER (WHERE r.a IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN runs r ON k.doc_id = r.doc_id AND k.start >= r.a AND k.start < r.b LEFT JOIN removed d ON d.doc_id = k.doc_id GROUP BY k.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_sentencepiece_dropout": op2_sentencepiece_dropout,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_quality_rules": op4_quality_rules,
        "op5_topk_search": op5_topk_search,
        "op6_line_dedup": op6_line_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_extendible_shards": op8_extendible_shards,
        "op9_token_counts": op9_token_counts,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": op4_sql(),
        "op5_topk_search": OP5_SQL,
        "op6_line_dedup": OP6_SQL,
        "op8_extendible_shards": OP8_SQL,
        "op10_substring_dedup": OP10_SQL,
    }
