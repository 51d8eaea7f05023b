"""Native sources: NAV files, fund sheets, pages; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET = (
    "isin string, name string, currency string, share_type string, nav double, nav_date string, aum double, aum_raw string, aum_date string, sfdr string, risk_sri int, "
    "benchmark string, is_benchmarked boolean, characteristics map<string,string>, asset_allocation array<struct<label:string,pct:double>>, "
    "currency_allocation array<struct<label:string,pct:double>>, costs struct<entry_pct:double,exit_pct:double,ongoing_pct:double,transaction_pct:double,performance_pct:double>, "
    "prospectus_url string, error string"
)


def read_nav_files(spark: SparkSession, folder: str) -> DataFrame:
    """(isin, dt, nav) of */nav.csv: ';', BOM and CRLF, day/month/year, comma or point; rows that can't be read are skipped. The isin is the folder's name."""
    raw = spark.read.option("header", True).option("sep", ";").schema("date string, nav string").csv(f"{folder}/*/nav.csv")
    isin = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/nav\.csv$", 1)
    dt, nav = F.try_to_date(F.trim("date"), "d/M/yyyy"), F.replace(F.trim("nav"), F.lit(","), F.lit(".")).try_cast("double")
    return raw.select(isin.alias("isin"), dt.alias("dt"), nav.alias("nav")).dropna()


def read_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Fund sheets of */summary.json with an explicit schema; unreadable files are dropped."""
    return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(SHEET).json(f"{folder}/*/summary.json")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` over ``old`` by key; written to a fresh folder by the caller."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_ids(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return old.join(ids.select(key).distinct(), key, "left_anti")


def pending(files: DataFrame, done: DataFrame, key: str = "source_file") -> DataFrame:
    """Work that isn't in the output yet."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, others as they are."""
    def one(name: str, kind: str) -> Column:
        return F.to_json(name).alias(name) if kind.startswith(("array", "map", "struct")) else F.col(name)
    return df.select(*[one(n, k) for n, k in df.dtypes])


def read_pages(spark: SparkSession, folder: str, suffix: str = "txt") -> DataFrame:
    """(source_file, page, text) of text files whose pages are parted by form feeds, 1-based, empty pages dropped; subfolders too, any case of the suffix."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    x = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source_file"), F.posexplode(F.split("value", "\f")).alias("k", "text"))
    return x.where(F.trim("text") != "").select("source_file", (F.col("k") + 1).alias("page"), "text")


def whole_texts(pages: DataFrame) -> DataFrame:
    """Pages of a file joined in order by a blank."""
    g = pages.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return g.select("source_file", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def append_events(events: DataFrame, folder: str) -> None:
    """Appends events as JSON lines."""
    events.write.mode("append").json(folder)


def append_rows(rows: DataFrame, folder: str, fields: list[str]) -> None:
    """Appends rows as CSV in the order of ``fields``; missing ones are N/A."""
    cols = [F.coalesce(F.col(f).cast("string"), F.lit("N/A")).alias(f) if f in rows.columns else F.lit("N/A").alias(f) for f in fields]
    rows.select(*cols).write.mode("append").option("header", True).csv(folder)


def union_of_keys(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the ordered union of their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def next_version(df: DataFrame, root: str, version: int) -> str:
    """Writes a table as a fresh version folder, which a reader is then pointed to (an upsert without in-place writes)."""
    path = f"{root}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path
