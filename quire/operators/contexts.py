"""Contexts of a question, and the blocks of text that show them to a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import relational as r
from ..functions import routing

# What introduces parts of a prompt, and what stands where there is nothing.
FIGURES = "AVAILABLE PAPER FIGURES (embed any that genuinely help with `![caption](url)`):"
IMAGES = "AVAILABLE IMAGES (you may embed any of these inline with `![alt](url)`):"
PAPER_OVERVIEW, SECTION_SUMMARIES = "### Paper-Level Executive Overview\n", "\n\n### Detailed Section Summaries (in document order)\n"
NO_SUMMARIES, NO_HEADINGS = "[No pre-computed section summaries available for this paper yet.]", "(this paper has no detected headings)"
HIGHLIGHTED, SURROUNDING, EARLIER = "THE READER HIGHLIGHTED THIS PASSAGE:\n", "SURROUNDING TEXT:\n", "EARLIER IN THIS NOTE:"
READING = "The reader is currently reading around this point in the paper."


def lines_of(df: DataFrame, keys: list[str], order: list[str], line: Column, separator: str, name: str) -> DataFrame:
    """keys and the lines of each in order, joined; rows whose line is null are left out."""
    made = df.select(*keys, F.struct(*order, line.alias("__line")).alias("__l")).where("__l.__line is not null")
    return made.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("__l")), lambda e: e["__line"]), separator).alias(name))


def block(sequence: Column, kind: Column, body: Column, page: Column) -> Column:
    """A chunk that can be cited by its number; its type unless text, its page if known."""
    of_kind = F.when(F.coalesce(kind, F.lit("text")) != "text", F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise("")
    of_page = F.coalesce(F.concat(F.lit(" (p"), page.cast("string"), F.lit(")")), F.lit(""))
    return F.concat(F.lit("[["), sequence.cast("string"), F.lit("]]"), of_kind, of_page, F.lit("\n"), F.trim(F.coalesce(body, F.lit(""))))


def outline_line(sequence: Column, depth: Column, title: Column) -> Column:
    """A heading's line, indented by its depth; null for a blank title."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(depth, F.lit(1)) - 1), F.lit("[["), sequence.cast("string"), F.lit("]] "), F.trim(title))
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", line)


def anchor(quote: Column, window: Column) -> Column:
    """What the reader points at - a passage, or a place - and the text around it."""
    quoted = F.trim(F.coalesce(quote, F.lit("")))
    head = F.when(quoted != "", F.concat(F.lit(HIGHLIGHTED), F.lit("“"), quoted, F.lit("”"))).otherwise(READING)
    return F.concat(head, F.coalesce(F.concat(F.lit("\n\n"), F.lit(SURROUNDING), F.nullif(window, F.lit(""))), F.lit("")))


def thread_line(question: Column, answer: Column) -> Column:
    said = F.nullif(F.trim(F.coalesce(answer, F.lit(""))), F.lit(""))
    return F.concat(F.lit("Reader asked: "), F.coalesce(question, F.lit("")), F.coalesce(F.concat(F.lit("\nYou answered: "), said), F.lit("")))


def hit(sequence: Column, similarity: Column, body: Column) -> Column:
    """A retrieved chunk of the global context."""
    return F.concat(F.lit("[Chunk seq="), sequence.cast("string"), F.lit(", similarity="), F.format_string("%.3f", F.coalesce(similarity, F.lit(0.0))), F.lit("]\n"), F.coalesce(body, F.lit("")))


def figure_line(path: Column, caption: Column) -> Column:
    """A figure that may be shown; null without a file."""
    said = F.coalesce(F.nullif(F.trim(F.coalesce(caption, F.lit(""))), F.lit("")), F.lit("paper figure"))
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("- !["), F.substring(said, 1, 120), F.lit("](/static/images/"), path, F.lit(")")))


def global_context(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """One row a question: its retrieved chunks by descending similarity, and their figures after them.

    hits: question, id, sequence_id, similarity, body; assets: id (the chunk's), path, caption.
    """
    chunks = lines_of(hits.withColumn("__o", -F.col("similarity")), ["question"], ["__o", "id"], hit(F.col("sequence_id"), F.col("similarity"), F.col("body")), "\n\n", "chunks")
    shown = hits.join(assets, "id").withColumn("__o", -F.col("similarity"))
    figures = lines_of(shown, ["question"], ["__o", "id", "path"], figure_line(F.col("path"), F.col("caption")), "\n", "figures")
    tail = F.coalesce(F.concat(F.lit(f"\n\n{FIGURES}\n"), "figures"), F.lit(""))
    return chunks.join(figures, "question", "left").select("question", F.concat("chunks", tail).alias("context"))


def overview_context(documents: DataFrame, summaries: DataFrame) -> DataFrame:
    """document_id, context of every document: the newest-structure order of its summaries, the paper's own (level 0) first.

    summaries: document_id, level, sequence_start, created_at, heading_path, summary.
    """
    first = r.latest_per(summaries.where("level = 0"), "document_id", F.col("sequence_start").asc_nulls_last(), F.col("created_at"))
    paper = first.select("document_id", F.concat(F.lit(PAPER_OVERVIEW + "\n"), "summary").alias("paper"))
    title = F.coalesce(F.nullif(F.array_join("heading_path", " > "), F.lit("")), F.lit("Section"))
    section = F.concat(F.lit("\n#### "), title, F.lit("\n\n"), F.coalesce("summary", F.lit("")))
    late = summaries.where("level in (1, 2)").withColumn("__n", F.col("sequence_start").isNull())
    sections = lines_of(late, ["document_id"], ["level", "__n", "sequence_start", "created_at"], section, "\n", "sections")
    both = documents.select("document_id").join(paper, "document_id", "left").join(sections, "document_id", "left")
    tail = F.concat(F.lit(SECTION_SUMMARIES + "\n"), "sections")
    whole = F.concat_ws("\n", "paper", tail)
    return both.select("document_id", F.when(whole == "", NO_SUMMARIES).otherwise(whole).alias("context"))


def external_context(questions: DataFrame, results: DataFrame, images: DataFrame, most: int = 5) -> DataFrame:
    """question, query, context: the rewritten query, ranked results (first of each URL, best score first) and two images, or four if the question wants some.

    questions: question, text, title; results: question, url, title, snippet, score, position;
    images: question, position, title, img_url, thumbnail, source_url.
    """
    kept = r.latest_per(results.where(F.coalesce("url", F.lit("")) != "").withColumn("__k", F.struct("question", "url")), "__k", F.col("position"))
    ranked = kept.withColumn("__s", -F.coalesce("score", F.lit(0.0))).withColumn("k", F.row_number().over(W.partitionBy("question").orderBy("__s", "position"))).where(F.col("k") <= most)
    snippet = F.when(F.length("snippet") > 500, F.concat(F.substring("snippet", 1, 500), F.lit("..."))).otherwise(F.coalesce("snippet", F.lit("")))
    found = lines_of(ranked, ["question"], ["k"], F.concat(F.lit("["), "title", F.lit("]("), "url", F.lit(")\n"), snippet), "\n\n", "found")
    wants = questions.select("question", routing.has_any(F.lower("text"), routing.IMAGE_WORDS).alias("wants"))
    url = F.coalesce(F.nullif("thumbnail", F.lit("")), F.nullif("img_url", F.lit("")))
    few = images.join(wants, "question").withColumn("k", F.row_number().over(W.partitionBy("question").orderBy("position"))).where(F.col("k") <= F.when(F.col("wants"), 4).otherwise(2))
    source = F.coalesce(F.concat(F.lit("  · source: "), F.nullif("source_url", F.lit(""))), F.lit(""))
    shown = lines_of(few, ["question"], ["k"], F.when(url.isNotNull(), F.concat(F.lit("- !["), F.coalesce("title", F.lit("image")), F.lit("]("), url, F.lit(")"), source)), "\n", "shown")
    both = questions.join(found, "question", "left").join(shown, "question", "left")
    return both.select("question", routing.rewrite_query(F.col("text"), F.col("title")).alias("query"), F.concat_ws("\n\n", "found", F.concat(F.lit(IMAGES + "\n"), "shown")).alias("context"))
