"""Quality of retrieval, citations and answers."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """Per item (id, expected array) and hits (query_id, rank, id): hit, recall and reciprocal rank; an item that expects nothing scores 1."""
    h = hits.groupBy(F.col("query_id").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("h"))
    x = golden.join(h, F.col("query_id") == F.col("qid"), "left")
    ids = F.coalesce(F.transform("h", lambda y: y["id"]), F.expr("cast(array() as array<bigint>)"))
    exp = F.array_distinct("expected")
    none = F.size(exp) == 0
    first = F.array_min(F.transform(F.filter("h", lambda y: F.array_contains("expected", y["id"])), lambda y: y["rank"]))
    found = F.size(F.array_intersect(exp, ids))
    return x.select(
        "query_id",
        F.when(none | (found > 0), 1.0).otherwise(0.0).alias("hit"),
        F.when(none, 1.0).otherwise(found / F.size(exp)).alias("recall"),
        F.when(none, 1.0).otherwise(F.coalesce(1.0 / first, F.lit(0.0))).alias("rr"),
    )


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def hit_metrics(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query of ``expected`` (query_id, expected: how many items are relevant) and hits (query_id, rank, relevant): hit, recall, reciprocal rank, and precision, recall and F1 of what was given.

    Counts stand for the lists of relevant items, which needn't be gathered. A query that expects nothing scores 1 in the first three; one without hits 0.
    """
    good = F.col("relevant")
    g = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("given"), F.count(F.when(good, 1)).alias("found"), F.min(F.when(good, F.col("rank"))).alias("first"))
    x = expected.join(g, "query_id", "left").na.fill(0, ["given", "found"])
    none = F.col("expected") == 0
    p, r = F.coalesce(F.try_divide(F.col("found"), F.col("given")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("found"), F.col("expected")), F.lit(0.0))
    return x.select(
        "query_id", F.when(none | (F.col("found") > 0), 1.0).otherwise(0.0).alias("hit"), F.when(none, 1.0).otherwise(r).alias("recall"),
        F.when(none, 1.0).otherwise(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"), p.alias("precision"), f1(p, r).alias("f1"),
    )


def citation_metrics(cited: DataFrame, expected: DataFrame) -> DataFrame:
    """Per item (query_id, expected array, out_of_domain) and answers (query_id, cited array): precision over all citations given, recall over distinct expected ones, F1.

    An item outside the domain scores 1 without citations and 0 with any; an item that expects nothing scores like one outside.
    """
    x = expected.join(cited, "query_id", "left").withColumn("cited", F.coalesce("cited", F.expr("cast(array() as array<string>)")))
    outside = F.coalesce(F.col("out_of_domain"), F.lit(False)) | (F.size("expected") == 0)
    clean = (F.size("cited") == 0).cast("double")
    good = F.size(F.filter("cited", lambda c: F.array_contains("expected", c)))
    p = F.when(outside, clean).otherwise(F.coalesce(F.try_divide(good, F.size("cited")), F.lit(0.0)))
    r = F.when(outside, clean).otherwise(F.size(F.array_intersect("expected", "cited")) / F.size(F.array_distinct("expected")))
    return x.select("query_id", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    """Mean of every figure over the queries, for each value of ``by``."""
    figures = [n for n, k in metrics.dtypes if k == "double" and n not in by]
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in figures])


def threshold_failures(scores: DataFrame, bounds: DataFrame) -> DataFrame:
    """(metric, score, failed) of bounds (metric, least): a metric that is missing, or below its bound, fails."""
    return bounds.join(scores, "metric", "left").select("metric", "score", (F.col("score").isNull() | (F.col("score") < F.col("least"))).alias("failed"))


def percentiles(x: DataFrame, key: str, value: str, qs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The value at index max(0, floor(n*q)-1) of the sorted values of each key, with mean and maximum; nulls don't count.

    A key may hold any share of the rows: values are counted per (key, value) with a map-side part, then per (key, range of
    values) in ranges that Spark's range partitioning balances by rows; only the counts of ranges, one a partition, are summed up by key, and each percentile is
    looked for in the one range that holds it.
    """
    spark = x.sparkSession
    counts = x.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = counts.repartitionByRange(parts, key, value).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    total = F.sum(F.col(value) * F.col("c"))
    ranges = ranged.groupBy(key, "_part").agg(F.sum("c").alias("_c"), total.alias("_sum"), F.max(value).alias("_max"))
    w = Window.partitionBy(key).orderBy("_part")
    ranges = ranges.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(key)))
    inside = Window.partitionBy(key, "_part").orderBy(value)
    y = ranged.join(ranges.select(key, "_part", "_before", "_n"), [key, "_part"]).withColumn("_upto", F.col("_before") + F.sum("c").over(inside))
    rank = lambda q: F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(q)))
    at = [F.max(F.when((F.col("_upto") >= rank(q)) & (F.col("_upto") - F.col("c") < rank(q)), F.col(value))).alias(f"p{int(q * 100)}") for q in qs]
    ends = ranges.groupBy(key).agg(F.sum("_c").alias("n"), (F.sum("_sum") / F.sum("_c")).alias("mean"), F.max("_max").alias("largest"))
    return ends.join(y.groupBy(key).agg(*at), key)


def category_summary(items: DataFrame, category: str, covered: Column, value: str) -> DataFrame:
    """Per category: items, those covered and the mean of ``value``; items whose cover isn't known count in neither of the last two."""
    known = covered.isNotNull()
    return items.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(covered, 1)).alias("covered"), F.avg(F.when(known, F.col(value))).alias("mean"))


def contingency(items: DataFrame, row: Column, column: Column) -> DataFrame:
    """(row, column, n) for the four cells of two yes-or-no columns, empty cells too; items with a null in either are left out."""
    x = items.select(row.alias("r"), column.alias("c")).dropna().groupBy().agg(*[F.count(F.when((F.col("r") == a) & (F.col("c") == b), 1)).alias(f"_{int(a)}{int(b)}") for a in (True, False) for b in (True, False)])
    cells = F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), F.col(f"_{int(a)}{int(b)}").alias("n")) for a in (True, False) for b in (True, False)])
    return x.select(F.inline(cells))


def arm_summary(runs: DataFrame) -> DataFrame:
    """Per arm of an ablation over rows (arm, covered, refused, should_refuse, ungrounded int, latency, tokens, calls, error): shares as counts of counts, ungrounded questions and numbers, mean latency, sums, errors."""
    count = lambda c: F.count(F.when(c, 1))
    return runs.groupBy("arm").agg(
        count(F.col("covered")).alias("covered"), count(F.col("covered").isNotNull()).alias("coverable"), count(F.col("refused") & F.col("should_refuse")).alias("refused"), count(F.col("should_refuse")).alias("refusable"),
        count(F.col("ungrounded") > 0).alias("ungrounded_questions"), F.sum("ungrounded").alias("ungrounded_numbers"), F.avg("latency").alias("latency"), F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"),
        count(F.col("error").isNotNull()).alias("errors"),
    )


def tool_coverage(runs: DataFrame, tools: list[str]) -> DataFrame:
    """One row: the tools used in any run, in the order of ``tools``, those never used, and whether all were."""
    used = runs.select(F.explode("tools").alias("t")).agg(F.collect_set("t").alias("u"))  # bounded by the list of tools' names
    known = F.array(*[F.lit(t) for t in tools])
    return used.select(F.array_intersect(known, "u").alias("used"), F.array_except(known, "u").alias("missing"), (F.size(F.array_except(known, "u")) == 0).alias("all_used"))


def golden_subset(items: DataFrame, only: str = "") -> DataFrame:
    """Items by a number (the first so many by id) or by prefixes of their id, comma-separated; all if empty."""
    if only.strip().isdigit():
        return items.orderBy("id").limit(int(only))
    prefixes = [p.strip() for p in only.split(",") if p.strip()]
    return items.where(F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.col("id"), p))) if prefixes else items


def score_answers(checks: DataFrame, answers: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, kind, verdict) of checks (id, kind num|text|refuse, fund_id, metric, text) on answers (id, answer) against the truth (fund_id, metric, value).

    A check without answer is ``missing``, one whose truth can't be computed ``no_truth``; else right or wrong: the number is among the answer's (2 %, percent or rounding), the text is in it whatever the accents, or it declines.
    """
    from fundspark.functions import gate, parsing, scalars

    x = checks.join(answers, "id", "left").join(truth, ["fund_id", "metric"], "left")
    said = F.coalesce("answer", F.lit(""))
    num = F.coalesce(parsing.numeric_match(scalars.numbers_in(said), F.col("value")), F.lit(False))
    right = F.when(F.col("kind") == "num", num).when(F.col("kind") == "text", F.contains(scalars.plain_lower(said), scalars.plain_lower(F.col("text")))).when(F.col("kind") == "refuse", gate.refuses(said))
    verdict = F.when(F.col("answer").isNull(), "missing").when((F.col("kind") == "num") & F.col("value").isNull(), "no_truth").when(right, "right").otherwise("wrong")
    return x.select("id", "kind", verdict.alias("verdict"))


def cyclic_next(x: DataFrame, order: str, value: str) -> DataFrame:
    """Each row with the value of the next one, the last with that of the first (a permuted control); rows are few questions."""
    w = Window.orderBy(order)
    n = x.select(order, value, F.row_number().over(w).alias("i"))
    total = n.agg(F.count(F.lit(1))).scalar()
    shifted = n.select(F.col(value).alias("other"), F.col("i").alias("j"))
    return n.withColumn("n", total).join(shifted, F.col("j") == F.col("i") % F.col("n") + 1).select(order, value, "other")
