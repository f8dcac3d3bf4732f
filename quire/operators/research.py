"""Rounds of web research for many questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import routing
from ..scratch import materialize

# Endings of first and further queries, and words of a question that ask for depth.
FIRST = [" machine learning OR AI research", " 2025 OR 2026 site:arxiv.org OR site:github.com OR site:huggingface.co"]
FURTHER = [" technical details OR architecture OR implementation", " benchmarks OR evaluation OR results"]
DEEP_WORDS = ["how", "implement", "architecture", "details", "code", "latest", "new"]
# Results of a query, results and characters that are studied, insights that are few and few for a deep question.
RESULTS, STUDIED, POINT, FEW, FEW_DEEP = 5, 6, 280, 3, 5


def first_queries(text: Column, title: Column) -> Column:
    """The question, the question with the paper's name, the question at the places where papers are."""
    name = F.regexp_replace(title, "\\.[^.]*$", "")
    of_paper = F.concat(text, F.lit(" "), name, F.lit(FIRST[0]))
    return F.array_compact(F.array(text, F.when(F.coalesce(title, F.lit("")) != "", of_paper), F.concat(text, F.lit(FIRST[1]))))


def next_queries(text: Column, title: Column, insights: Column, used: Column) -> Column:
    """Two further queries that have not been asked, or the first two again."""
    said = F.substring(F.array_join(F.slice(insights, 1, 3), " "), 1, 120)
    of_paper = F.when(F.coalesce(title, F.lit("")) != "", F.concat(text, F.lit(" in context of "), title))
    all_of = F.array_compact(F.array(*[F.concat(text, F.lit(end)) for end in FURTHER], F.concat(said, F.lit(" "), text), of_paper))
    fresh = F.slice(F.array_except(all_of, used), 1, 2)
    return F.when(F.size(fresh) > 0, fresh).otherwise(F.slice(all_of, 1, 2))


def goes_on(text: Column, insights: Column) -> Column:
    return (F.size(insights) < FEW) | (routing.has_any(F.lower(text), DEEP_WORDS) & (F.size(insights) < FEW_DEEP))


def research(questions: DataFrame, search: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """question, round, queries, insights, urls: what each round of each question found.

    questions: question (a key), text, title. search takes question, query and gives
    question, query, position, url, title, snippet, score. A round asks its queries, ranks each one's
    results (first of a URL, best score first), passes over URLs seen before, and studies the
    first few; a question goes on while it has few insights, and stops at a round without news.
    """
    spark = questions.sparkSession
    now = questions.select("question", "text", "title", first_queries(F.col("text"), F.col("title")).alias("queries"), F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("seen"))
    found = None
    for n in range(1, rounds + 1):
        now = materialize(now, "research")
        if now.isEmpty():
            break
        asked = now.select("question", "title", F.posexplode("queries").alias("n", "raw")).withColumn("query", routing.rewrite_query(F.col("raw"), F.col("title")))
        results = search(asked.select("question", "query").distinct()).where(F.coalesce("url", F.lit("")) != "")
        first = W.partitionBy("question", "query", "url").orderBy("position")
        best = W.partitionBy("question", "query").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "position")
        ranked = results.withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("k", F.row_number().over(best)).where(F.col("k") <= RESULTS)
        placed = asked.select("question", "n", "query").join(ranked, ["question", "query"])
        once = placed.withColumn("o", F.row_number().over(W.partitionBy("question", "url").orderBy("n", "k"))).where("o = 1")
        new = once.join(now.select("question", "seen"), "question").where(~F.array_contains("seen", F.col("url")))
        point = F.trim(F.substring("snippet", 1, POINT))
        insight = F.when(F.coalesce(point, F.lit("")) != "", F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(": "), point))
        listed = new.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("n", "k", "url", insight.alias("insight")))).alias("all"))
        studied = listed.select("question", F.transform("all", lambda e: e["url"]).alias("urls"), F.array_compact(F.transform(F.slice("all", 1, STUDIED), lambda e: e["insight"])).alias("insights"))
        both = materialize(now.join(studied, "question").withColumn("round", F.lit(n)), "research")
        done = both.select("question", "round", "queries", "insights", "urls")
        found = done if found is None else found.union(done)
        used = F.concat("used", F.transform("queries", lambda q: routing.rewrite_query(q, F.col("title"))))
        left = both.where(goes_on(F.col("text"), F.col("insights"))).withColumn("asked", used)
        now = left.select("question", "text", "title", next_queries(F.col("text"), F.col("title"), F.col("insights"), F.col("asked")).alias("queries"), F.col("asked").alias("used"), F.concat("seen", "urls").alias("seen"))
    return found if found is not None else spark.createDataFrame([], questions.select("question", F.lit(1).alias("round"), F.array(F.lit("")).alias("queries"), F.array(F.lit("")).alias("insights"), F.array(F.lit("")).alias("urls")).schema)
