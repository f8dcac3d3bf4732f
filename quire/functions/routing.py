"""Routing and parsing of questions, replies and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Phrases that decide a question's route, in order of precedence.
LOCAL = [
    "this formula", "this equation", "this chart", "this figure", "this image", "this table", "this paragraph", "this section", "here", "above", "below", "what does this", "explain this", "what is this", "the current", "on screen", "visible", "this page",
    "shown here", "bring a picture", "bring me a picture", "show me a picture", "show a picture", "show the figure", "show me the figure", "display the figure", "display the image", "show the image", "show me the image", "their shapes", "this diagram", "this picture",
]
OVERVIEW = [
    "summarize the paper", "summarize this paper", "paper summary", "what is this paper about", "what is this about", "what's this paper about", "big picture", "high level", "high-level", "overview of the paper", "main contribution", "key contributions",
    "core contribution", "tl;dr", "tldr", "too long didn't read", "executive summary", "walk me through the paper", "structure of the paper", "outline of the paper", "what does the paper argue", "what is the paper's main point", "give me an overview",
    "give an overview", "paper overview", "in a nutshell", "bottom line", "key takeaway", "key takeaways", "what are the main findings", "main results of the paper",
]
EXTERNAL = ["latest", "recent", "news", "today", "current events", "2025", "2026", "who is", "what happened", "search the web", "find online", "look up", "wikipedia", "according to"]
OTHER_FIELDS = [
    "biology", "biological", "biomedical", "genetics", "genomic", "medicine", "medical", "clinical", "pharma", "chemistry", "chemical", "physics", "physical", "neuroscience", "psychology", "psychological", "linguistics", "linguistic", "economics",
    "economic", "finance", "financial", "law", "legal", "legislation", "sociology", "anthropology", "philosophy", "history", "historical", "music", "art", "in other field", "in other fields", "across fields", "across disciplines", "outside cs",
    "outside computer science", "non-technical", "applied to ", "applied in ", "applications in ", "application in ",
]
FIGURE_WORDS = ["picture", "figure", "diagram", "image", "illustration", "show me", "bring me", "show the", "bring the", "display the", "show a", "bring a", "display a"]
IMAGE_WORDS = ["image", "picture", "photo", "diagram", "figure", "illustration", "visualize", "visualization", "show me", "draw", "generate a picture", "what does it look like", "looks like"]
TECH_WORDS = [
    "transformer", "neural", "embedding", "model", "lstm", "rnn", "cnn", "attention", "tokenizer", "gradient", "loss", "softmax", "encoder", "decoder", "deep learning", "machine learning", "ml ", " ai ", "nlp", "gpu", "cuda", "pytorch", "tensorflow",
    "huggingface", "arxiv", "algorithm", "dataset", "benchmark", "compiler", "kernel", "kubernetes",
]


def first_match(x: Column, phrases: list[str]) -> Column:
    """The first of phrases that x holds; null if none."""
    return F.get(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(x, p)), F.lit(0))


def has_any(x: Column, phrases: list[str]) -> Column:
    """Whether x holds one of phrases; false for null. One compiled condition a phrase, the first that holds ends it; x is best a column that is there already."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in phrases]), F.lit(False))


def route(prompt: Column, has_chunk: Column, has_document: Column) -> Column:
    """Struct of context_type and matched phrase: what is on screen, the whole paper, the web, else the document's search."""
    q = F.lower(F.trim(prompt))
    local, over, out = F.when(has_chunk, first_match(q, LOCAL)), first_match(q, OVERVIEW), first_match(q, EXTERNAL)
    kind = F.when(local.isNotNull(), "LOCAL").when(over.isNotNull(), "OVERVIEW").when(out.isNotNull() | ~(has_document | has_chunk), "EXTERNAL").when(has_document, "GLOBAL").otherwise("EXTERNAL")
    return F.struct(kind.alias("context_type"), F.coalesce(local, over, out).alias("matched"))


def route_of_reply(reply: Column) -> Column:
    """The context type that a model's reply names: its JSON, JSON inside it, its first word, else GLOBAL."""
    valid = ["LOCAL", "GLOBAL", "EXTERNAL", "OVERVIEW"]
    inner = F.coalesce(F.get_json_object(reply, "$.context_type"), F.get_json_object(F.regexp_extract(reply, "(?s)\\{.*?\\}", 0), "$.context_type"))
    named = F.upper(F.trim(inner))
    word = F.regexp_extract(F.upper(F.trim(reply)), "^(LOCAL|EXTERNAL|OVERVIEW)", 1)
    return F.when(named.isin(valid), named).when(word != "", word).otherwise("GLOBAL")


# What a search query gets besides the question, with a title, for a technical question, and for others.
OF_PAPER = (' (in the context of the research paper "', '", machine learning / computer science)')
OF_FIELD = " machine learning OR deep learning OR computer science"
OF_ANY = " in machine learning, deep learning, NLP, or computer science (research paper context, not biology / medicine / genetics)"


def rewrite_query(q: Column, title: Column) -> Column:
    """A search query with the paper's title, or with the field's name, less of it where the question is technical."""
    t = F.trim(F.regexp_replace(title, "\\.[^.]*$", ""))
    tech = has_any(F.concat(F.lit(" "), F.lower(q), F.lit(" ")), TECH_WORDS)
    named = F.concat(F.trim(q), F.lit(OF_PAPER[0]), t, F.lit(OF_PAPER[1]))
    return F.when(F.coalesce(title, F.lit("")) != "", named).otherwise(F.concat(F.trim(q), F.when(tech, OF_FIELD).otherwise(OF_ANY)))


def tool_calls(reply: Column, most: int = 3) -> Column:
    """Struct of searches and reads (from, to) inside a tool block; calls elsewhere don't count."""
    body = F.regexp_extract(reply, "(?is)<tool>(.*?)(?:</tool>|$)", 1)
    searches = F.filter(F.transform(F.regexp_extract_all(body, F.lit("(?im)^[ \t]*SEARCH:[ \t]*(\\S.*?)[ \t]*$"), 1), lambda s: F.trim(s)), lambda s: s != "")
    reads = F.regexp_extract_all(body, F.lit("(?im)^\\s*READ:\\s*(\\d+\\s*(?:-|–|to)\\s*\\d+)[ \t]*$"), 1)
    ends = F.transform(reads, lambda s: F.transform(F.regexp_extract_all(s, F.lit("(\\d+)"), 1), lambda n: n.cast("int")))
    return F.struct(F.slice(searches, 1, most).alias("searches"), F.slice(ends, 1, most).alias("reads"))


def cited(answer: Column) -> Column:
    """Block numbers an answer cites in double brackets, in order of first use."""
    blobs = F.regexp_extract_all(answer, F.lit("\\[\\[([0-9,;\\s\\[\\]]+?)\\]\\]"), 1)
    return F.array_distinct(F.flatten(F.transform(blobs, lambda b: F.transform(F.regexp_extract_all(b, F.lit("(\\d+)"), 1), lambda n: n.cast("int")))))


def needs_research(reply: Column) -> Column:
    """The queries that a reply asks to be looked up: those of its JSON, null if it asks for none."""
    body = F.regexp_extract(reply, "(?s)NEEDS_RESEARCH\\s*:?\\s*(\\{.*\\})", 1)
    return F.when(body != "", F.from_json(body, "queries array<string>")["queries"])


def friendly_error(message: Column) -> Column:
    """A short class for an internal error."""
    m = F.lower(message)
    return F.when(m.contains("undefinedcolumn") | m.contains("does not exist"), "schema").when(m.contains("too many") | m.contains("parameter") | m.contains("f405"), "fragments").otherwise("failed")


def rewrite_images(answer: Column, images: Column) -> Column:
    """Remote image addresses replaced by local ones: images is an array of (remote, local)."""
    return F.aggregate(images, answer, lambda text, i: F.when(i["remote"].isNull() | i["local"].isNull() | (i["remote"] == ""), text).otherwise(F.replace(text, i["remote"], i["local"])))


def used_citations(citations: Column, answer: Column) -> Column:
    """Citations (sequence_id, url) without those of web pages that the answer doesn't name."""
    return F.filter(citations, lambda x: x["url"].isNull() | (x["url"] == "") | F.contains(F.coalesce(answer, F.lit("")), x["url"]))


def is_cloud_model(name: Column, remote: Column | None = None) -> Column:
    """Whether a model runs elsewhere: its name says so, or it has a remote host."""
    by_name = F.lower(name).endswith("cloud")
    return by_name if remote is None else by_name | remote


def is_embedding_model(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("embed"))


def is_reasoning_model(name: Column) -> Column:
    """Whether a model's name, without its provider, is an o and a number."""
    return F.element_at(F.split(name, "/"), -1).rlike("^o[0-9]")
