"""Registered training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dual_tree, fill_middle, graph_ann, html_crf, jaccard_join, language_id, lattice_lm, line_dedup, mixing, packing, token_counts, toxicity, transport_stream
from tidemark.llm.common import table


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return transport_stream.media_features(docs).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; every node has the package that holds it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.search(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeat to remove, however short: document, offsets in its text, and the documents that keep it."""
    return line_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("_key")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.components(table(spark, sf_dir, "documents"), jaccard_join.Likeness())
    return found.select("doc_id", "n_shingles", "component_id")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op12_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """Every round by plain comparison of all vectors with all centroids."""
    near = """
    a{n} AS MATERIALIZED (SELECT row, vec_id, v, c AS cluster, d AS distance FROM (
      SELECT k.row, k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d,
        row_number() OVER (PARTITION BY k.row ORDER BY list_sum(list_transform(list_zip(k.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.c) AS place
      FROM kept AS k CROSS JOIN c{n} AS c) AS t WHERE place = 1)"""
    move = """
    m{n} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{n}) AS t GROUP BY cluster, i),
    c{next} AS MATERIALIZED (SELECT c.c, coalesce(f.m, c.m) AS m FROM c{n} AS c LEFT JOIN (
      SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM m{n} GROUP BY cluster) AS f ON f.cluster = c.c)"""
    steps = ",".join(near.format(n=n) + "," + move.format(n=n, next=n + 1) for n in range(dual_tree.ROUNDS))
    last = dual_tree.ROUNDS
    return f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    c0 AS MATERIALIZED (SELECT place - 1 AS c, v AS m FROM (
      SELECT v, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) AS place FROM kept) AS t WHERE place <= 16),
    {steps},{near.format(n=last)}
    SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
      CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c.m, ',')) AS centroid_sha256
    FROM a{last} AS a JOIN c{last} AS c ON c.c = a.cluster"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(fill_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, tokens, len(tokens) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM hashed),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
parts AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(tokens[1:a], ''), '') AS p, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(tokens[b + 1:n], ''), '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transport_stream": op1_transport_stream,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_html_crf": op6_html_crf,
    "op7_lattice_lm": op7_lattice_lm,
    "op8_graph_ann": op8_graph_ann,
    "op9_line_dedup": op9_line_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_language_id": op11_language_id,
    "op12_dual_tree_lloyd": op12_dual_tree_lloyd,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op12_dual_tree_lloyd": _op12_sql(), "op13_fill_in_middle": OP13_SQL}
