"""Pages to sections to chunks, in window and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundspark.functions.scalars import chunk_id

# Forms of a heading line.
HEADINGS = (
    r"^\s*(\d+(?:\.\d+){0,3})\.?\s+(.{2,120}?)\s*$",
    r"^\s*([IVXLCDM]{1,6})[.)\-]\s+(.{2,120}?)\s*$",
    r"^\s*([A-Za-z])[.)]\s+(.{2,120}?)\s*$",
    r"^\s*(?i:Chapitre|Section|Partie|Titre|CM|Cours|TD|TP)\s+([IVXLCDMivxlcdm\d]+)\b[^A-Za-z]?\s*(.{0,120}?)\s*$",
)
PARENT_MAX = 12_000


def clean_page(text: Column) -> Column:
    """Without soft hyphens and hyphenation at line ends, lines without trailing blanks, runs of blank lines as one."""
    t = F.regexp_replace(F.replace(text, F.lit("\u00ad"), F.lit("")), r"-\n(?=[a-zà-ÿ])", "")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    return F.trim(t)


def is_heading(line: Column) -> Column:
    s = F.trim(line)
    fits = F.lit(False)
    for p in HEADINGS:
        fits |= s.rlike(p)
    return F.length(s).between(3, 140) & fits


def sections(pages: DataFrame) -> DataFrame:
    """Pages (source_file, page, text) to (source_file, section_index, title, text, start_page, end_page).

    A heading opens a section up to the next one; lines before the first are
    dropped; a file without heading is one section ``(document)``. Lines of a
    page stay together: the window by file runs over pages' counts of headings
    only, one row a page, so a large file's lines aren't gathered.
    """
    lines = pages.select("source_file", "page", "page_id", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "line"))
    lines = lines.withColumn("h", is_heading(F.col("line")).cast("int"))
    per_page = lines.groupBy("source_file", "page", "page_id").agg(F.sum("h").alias("n"))
    w = Window.partitionBy("source_file").orderBy("page", "page_id")
    per_page = per_page.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_page = per_page.withColumn("total", F.sum("n").over(Window.partitionBy("source_file")))
    in_page = Window.partitionBy("source_file", "page", "page_id").orderBy("line_no")
    x = lines.withColumn("seq", F.sum("h").over(in_page)).join(per_page.drop("n"), ["source_file", "page", "page_id"])
    x = x.withColumn("section_index", F.when(F.col("total") == 0, F.lit(0)).otherwise(F.col("seq") + F.col("before") - 1))
    x = x.where(F.col("section_index") >= 0)
    g = x.groupBy("source_file", "section_index").agg(
        F.array_sort(F.collect_list(F.struct("page", "page_id", "line_no", "line"))).alias("l"), F.max("total").alias("total"), F.min("page").alias("start_page"), F.max("page").alias("end_page")
    )
    text = F.trim(F.array_join(F.transform("l", lambda y: y["line"]), "\n"))
    title = F.when(F.col("total") == 0, "(document)").otherwise(F.trim(F.col("l")[0]["line"]))
    return g.select("source_file", F.col("section_index").cast("int").alias("section_index"), title.alias("title"), text.alias("text"), "start_page", "end_page")


def parent_chunks(secs: DataFrame, most: int | None = None) -> DataFrame:
    """(id, source_file, section_index, text): one parent a section with a deterministic id, its whole text; with ``most`` (PARENT_MAX is the usual bound) cut there."""
    text = F.col("text") if most is None else F.substring("text", 1, most)
    return secs.select(chunk_id(F.col("source_file"), "p", F.col("section_index")).alias("id"), "source_file", "section_index", text.alias("text"))
