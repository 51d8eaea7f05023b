"""Queries of the problems on text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundspark.llm import lookalike, packing, residue, splitting, tokens
from fundspark.sources.tables import table


TEXT_TABLES = (("page_text", "page_id"), ("parent_chunk", "chunk_no"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, id, text) of pages and parent chunks."""
    parts = [table(spark, d, name).select(F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("id"), "text") for name, key in TEXT_TABLES]
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(_pages(spark, d), ("tbl",))


def p1_normalised(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every page and parent chunk."""
    return lookalike.normalise(_pages(spark, d), keep=("tbl",)).select("tbl", "id", "normal")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every section."""
    return splitting.split_sections(table(spark, d, "doc_sections"), table(spark, d, "chunking_config"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.over_limit(splitting.split_sections(table(spark, d, "doc_sections"), table(spark, d, "chunking_config"), with_text=False))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) of each document by byte_bpe_50k, without special tokens."""
    return tokens.encode(spark, table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids: each must be the stored one."""
    return tokens.decode(spark, p8_ids(spark, d))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each document's container under each spec of container_spec."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    shards = packing.shards_for(docs.count())
    specs = [(r.spec_code, r.capacity_tokens, r.tokenizer) for r in table(spark, d, "container_spec").orderBy("spec_code").collect()]
    parts = []
    for name in sorted({t for _, _, t in specs}):
        parts.append(packing.pack(tokens.sizes(spark, docs, name), [(c, n) for c, n, t in specs if t == name], shards))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], packing.RESULT)


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per spec: containers above its capacity (there must be none) and documents that lie in some container (all must)."""
    capacity = table(spark, d, "container_spec").select("spec_code", "capacity_tokens")
    got = p9_containers(spark, d)
    loads = got.groupBy("spec_code", "container_id").agg(F.sum("tokens").alias("load")).join(capacity, "spec_code")
    over = loads.groupBy("spec_code").agg(F.count(F.when(F.col("load") > F.col("capacity_tokens"), 1)).alias("over"))
    return over.join(got.groupBy("spec_code").agg(F.count_distinct("doc_id").alias("documents")), "spec_code")


def p2_lengths(spark: SparkSession, d: str) -> DataFrame:
    """How far each section's pieces reach and what they cover: all of its text, once apart from the overlaps."""
    parts = splitting.split_sections(table(spark, d, "doc_sections"), table(spark, d, "chunking_config"), with_text=False)
    w = Window.partitionBy("section_id").orderBy("piece_no")
    fresh = F.col("end") - F.greatest(F.col("begin"), F.coalesce(F.lag("end").over(w), F.lit(0)))
    x = parts.withColumn("fresh", fresh).groupBy("section_id")
    return x.agg(F.max("end").cast("bigint").alias("reached"), F.sum("fresh").cast("bigint").alias("covered"), F.max(F.col("end") - F.col("begin") > F.col("child_size")).alias("oversized"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.marked(table(spark, d, "documents")).where("excluded").select("doc_id").distinct()


def p10_marked(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the kinds of residue found, the share of its text they cover and whether it is excluded."""
    return residue.marked(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_normalised": p1_normalised,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_lengths": p2_lengths,
    "p10_found": p10_found,
    "p10_marked": p10_marked,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_containers": p9_containers,
    "p9_checks": p9_checks,
}
ORACLE: dict[str, str] = {
    "p2_lengths": "SELECT section_id, length(text) AS reached, length(text) AS covered, false AS oversized FROM doc_sections WHERE text IS NOT NULL AND text <> ''",
    "p8_decoded": "SELECT doc_id, COALESCE(text, '') AS text FROM documents",
    "p9_checks": "SELECT spec_code, 0 AS over, (SELECT COUNT(DISTINCT doc_id) FROM documents) AS documents FROM container_spec",
    "p2_found": """WITH s AS (SELECT section_id, length(text) AS n, COALESCE(c.child_size, d.child_size) AS child_size, COALESCE(c.parent_max_chars, d.parent_max_chars) AS parent_max_chars
FROM doc_sections s LEFT JOIN chunking_config c ON s.config_code = c.config_code CROSS JOIN (SELECT * FROM chunking_config WHERE config_code = 'defaut') d)
SELECT section_id, 'child_size' AS limit_name FROM s WHERE n > child_size UNION ALL SELECT section_id, 'parent_max_chars' FROM s WHERE n > parent_max_chars""",
}
