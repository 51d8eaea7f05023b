"""Ingestion as one job: files to pages, sections, parents, children and vectors, merged into versioned tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.operators import children, chunking, retrieval
from fundspark.sources import readers
from fundspark.streaming.audit import versions

if TYPE_CHECKING:
    import pyarrow as pa


def form_feed_pages(content: bytes) -> list[str]:
    """The pages of a text file, parted by form feeds."""
    return content.decode("utf-8").split("\f")


def read_files(spark: SparkSession, folder: str, suffix: str = "txt", parse: Callable[[bytes], list[str]] = form_feed_pages) -> DataFrame:
    """(source_file, page, text, error) of all files of a suffix in any case, subfolders too; pages from 1, empty ones dropped.

    A file that can't be parsed gives one row with its error and without page, and stops no other. ``parse`` runs on the
    executors, a file at a time; where a PDF library is at hand it goes here.
    """
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        names, types = ["source_file", "page", "text", "error"], [pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows = [(name, k, t, None) for k, t in enumerate(parse(content), 1) if t.strip()]
                except Exception as e:  # noqa: BLE001
                    rows = [(name, None, None, f"{type(e).__name__}: {e}"[:500])]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return raw.select("path", "content").mapInArrow(run, "source_file string, page int, text string, error string")


def chunk_pages(pages: DataFrame, configs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of pages (source_file, page, text): cleaned, cut into sections, each a parent with its children. ``configs`` as for ``child_chunks`` (default: the usual sizes)."""
    spark = pages.sparkSession
    if configs is None:
        configs = spark.createDataFrame([(children.DEFAULT_CONFIG, children.SIZE, children.OVERLAP)], "config_code string, child_size int, child_overlap int")
    x = pages.select("source_file", "page", F.col("page").cast("long").alias("page_id"), chunking.clean_page(F.col("text")).alias("text"))
    secs = chunking.sections(x)
    return chunking.parent_chunks(secs), children.child_chunks(secs.withColumn("config_code", F.lit(None).cast("string")), configs)


def ingest(spark: SparkSession, folder: str, root: str, suffix: str = "txt", parse: Callable[[bytes], list[str]] = form_feed_pages, model=None, configs: DataFrame | None = None) -> DataFrame:
    """Ingests a folder into the tables parents, children and vectors under ``root``; gives one row of totals: files, failed, parents, children.

    Ids are those of source and position, so that ingesting again changes nothing and a changed file replaces what it was. Each
    table gets a fresh version that holds all before it; readers take ``latest``.
    """
    pages = read_files(spark, folder, suffix, parse).persist()
    parents, kids = chunk_pages(pages.where("error is null"), configs)
    vectors = retrieval.embed(kids.select("id", "text"), model)
    files = pages.select("source_file").distinct()
    for name, new in (("parents", parents), ("children", kids), ("vectors", vectors)):
        done = versions(spark, f"{root}/{name}")
        if done:
            old = spark.read.parquet(f"{root}/{name}/version={done[-1]}")
            # what a file was before goes as a whole, and vectors of children that are no more
            old = old.join(latest(spark, root, "children").select("id"), "id", "left_semi") if name == "vectors" else old.join(files, "source_file", "left_anti")
            new = readers.upsert(old, new)
        new.write.mode("overwrite").parquet(f"{root}/{name}/version={(done[-1] if done else 0) + 1}")
    failed = F.countDistinct(F.when(F.col("error").isNotNull(), F.col("source_file")))
    t = pages.agg(F.countDistinct("source_file").alias("files"), failed.alias("failed")).first()
    n = [latest(spark, root, name).join(files, "source_file", "left_semi").count() for name in ("parents", "children")]
    pages.unpersist()
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip(("files", "failed", "parents", "children"), (t.files, t.failed, *n))])


def latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The last version of a table."""
    return spark.read.parquet(f"{root}/{name}/version={versions(spark, f'{root}/{name}')[-1]}")
