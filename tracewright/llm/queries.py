"""Queries of this subpackage, by the names under which they are registered, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import ego_join, langid, line_dedup, minhash, mixing, spotsigs, substring_dedup, token_counts, toxicity, word_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_and_next(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold_of(F.col("doc_id"), 4) == 2
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "weight", "words")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = line_dedup.removed_lines(table(spark, sf_dir, "documents"))
    return gone.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_with_edits(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold_of(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    predicted = langid.predict(docs, model, reject=False)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_spotsigs": op2_spotsigs,
    "op3_toxicity": op3_toxicity,
    "op4_minhash": op4_minhash,
    "op5_bpe": op5_bpe,
    "op6_ego_join": op6_ego_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_langid": op10_langid,
}

_REACH = """
, reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, e.b FROM reach JOIN edges e ON reach.r = e.a),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked), nodes AS (SELECT doc_id AS id FROM documents)"""
    + _REACH
    + "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least ON least.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id",
    "op6_ego_join": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
linked AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked), nodes AS (SELECT vec_id AS id FROM embeddings)"""
    + _REACH
    + "SELECT vec_id, count(a) AS n_links, any_value(component_id) AS component_id, any_value(vec_id = component_id) AS kept FROM embeddings JOIN least ON least.id = vec_id LEFT JOIN edges ON a = vec_id GROUP BY vec_id",
}
