"""The corrective loop over many questions at once: retrieve, grade, decide, rewrite, answer or fall back; models are Column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundspark.operators import retrieval

ANSWERS = "query_id, answer, citations, grounded, iterations, route"


def first_passage(question: Column, passages: Column) -> Column:
    """An answer that needs no model: the first passage, cited."""
    return F.concat(F.get(passages, F.lit(0)), F.lit(" [1]"))


def judge_by_words(question: Column, text: Column) -> Column:
    """A judge that needs no model: the share of the question's content words that the text holds."""
    share = retrieval.shared_words(question, text)
    label = F.when(share >= 0.5, "relevant").when(share > 0, "ambiguous").otherwise("irrelevant")
    return F.concat(F.lit('{"label": "'), label, F.lit('"}'))


def _answered(kept: DataFrame, generate: Callable, with_citations: bool) -> DataFrame:
    g = kept.groupBy("query_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", "id", "refined"))).alias("h"))  # at most k hits
    texts, ids = F.transform("h", lambda y: y["refined"]), F.transform("h", lambda y: y["id"].cast("string"))
    x = g.withColumn("answer", generate(F.col("question"), texts))
    none = F.expr("cast(array() as array<string>)")
    cited = retrieval.citations(F.col("answer"), ids) if with_citations else none
    plain = F.regexp_replace("answer", r"\s*\[\d+\]", "")
    return x.select("query_id", "answer", cited.alias("citations"), retrieval.grounded(plain, texts).alias("grounded"))


def corrective(
    queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], store: DataFrame, judge: Callable[[Column, Column], Column] = judge_by_words,
    rewrite: Callable[[Column], Column] = lambda q: q, generate: Callable[[Column, Column], Column] = first_passage, most: int = 2, enough: float = 0.0,
) -> DataFrame:
    """One row a question of ``queries`` (query_id, text): ANSWERS; ``route`` is answered or fallback.

    ``retrieve`` gives hits (query_id, rank, id, score) of questions, ``store`` (id, text) their texts. Each round grades the hits of the
    questions still open, decides for each, and hands on those to be rewritten; at most ``most`` + 1 rounds, each kept, so that no round runs twice.
    """
    open_, done = queries.select("query_id", "text"), []
    for n in range(most + 1):
        hits = retrieval.hydrate(retrieve(open_), store.select("id", "text")).join(open_.withColumnRenamed("text", "question"), "query_id")
        graded = hits.withColumn("raw", judge(F.col("question"), F.col("text"))).persist(StorageLevel.MEMORY_AND_DISK)
        label = retrieval.grade_label(F.col("raw"))
        counts = graded.groupBy("query_id").agg(*[F.count(F.when(label == x, 1)).alias(x) for x in ("relevant", "ambiguous", "irrelevant")])
        steps = retrieval.decide(open_.join(counts, "query_id", "left").na.fill(0), n, most, enough).select("query_id", "text", "step").persist(StorageLevel.MEMORY_AND_DISK)
        kept = retrieval.grade_and_keep(graded, F.col("raw")).join(steps.where("step = 'proceed'").select("query_id"), "query_id", "left_semi")
        done.append(_answered(kept, generate, True).withColumns({"iterations": F.lit(n + 1), "route": F.lit("answered")}))
        done.append(retrieval.fallback_answer(steps.where("step = 'fallback'")).withColumns({"iterations": F.lit(n + 1), "route": F.lit("fallback")}))
        open_ = steps.where("step = 'rewrite'").select("query_id", retrieval.rewritten(rewrite(F.col("text")), F.col("text")).alias("text"))
        if n == most or not open_.limit(1).count():
            break
    return reduce(DataFrame.unionByName, done)


def simple(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], store: DataFrame, generate: Callable[[Column, Column], Column] = first_passage) -> DataFrame:
    """The loop without grading: hits as they are, one round; here no citations are resolved. A question without hits falls back."""
    hits = retrieval.hydrate(retrieve(queries), store.select("id", "text")).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    said = _answered(hits.withColumn("refined", F.col("text")), generate, False).withColumn("route", F.lit("answered"))
    rest = retrieval.fallback_answer(queries.join(said.select("query_id"), "query_id", "left_anti")).withColumn("route", F.lit("fallback"))
    return said.unionByName(rest).withColumn("iterations", F.lit(1))
