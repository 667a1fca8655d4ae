"""What stands around a model's answer: context blocks, prefixes, languages, titles, intents, coverage, exports, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip_accents
from docloom.operators.quality import FUNCTION_WORDS, LETTER_WORD

# What marks off a chunk in a prompt, and the words that tell what a question is about.
DELIMITER = "«|CHUNK|»"
_WORD = "(^|[^\\p{{L}}])({})($|[^\\p{{L}}])"
INTENTS = [("notebook_op", "(?i)" + _WORD.format("create|rename|delete|share|list")), ("doc_qa", "(?i)[?]|" + _WORD.format("what|who|when|where|why|how|que|quel|wie|was"))]
TITLE_CHARS = 60


def context_blocks(chunks: DataFrame, key: list[str], order: str, title: str, page: str, content: str) -> DataFrame:
    """key, context: numbered blocks with title and page, the delimiter taken out of each content and put around it."""
    w = Window.partitionBy(*key).orderBy(order)
    body = F.concat(F.lit(DELIMITER), F.replace(F.coalesce(F.col(content), F.lit("")), F.lit(DELIMITER), F.lit("")), F.lit(DELIMITER))
    block = F.concat(F.lit("["), F.col("n"), F.lit("] "), F.col(title), F.lit(" (p. "), F.col(page), F.lit(")\n"), body)
    numbered = chunks.withColumn("n", F.row_number().over(w)).select(*key, "n", block.alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "block")))
    return numbered.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context"))


def with_prefix(prefix: Column, content: Column) -> Column:
    """What is indexed of a chunk: its prefix, if it has one, before the content that is shown."""
    return F.concat_ws("\n", prefix, content)


def answer_language(question: Column) -> Column:
    """vi if a tenth of the words are Vietnamese function words, else the other language (en)."""
    words = F.regexp_extract_all(F.lower(strip_accents(question)), F.lit(LETTER_WORD), F.lit(0))
    known = F.size(F.filter(words, lambda w: w.isin(FUNCTION_WORDS)))
    return F.when(known >= F.size(words) * 0.1, F.when(F.size(words) > 0, "vi").otherwise("en")).otherwise("en")


def session_titles(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, title: the beginning of the first question of a session."""
    asked = turns.filter("role = 'user'").groupBy(key).agg(F.min_by("text", "turn").alias("t"))
    return asked.select(key, F.trim(F.substring(F.regexp_replace("t", "[ \\t\\n]+", " "), 1, TITLE_CHARS)).alias("title"))


def intent(question: Column) -> Column:
    """The first intent whose rule a question meets; anything else is chat."""
    out = F.lit("chat")
    for name, rule in reversed(INTENTS):
        out = F.when(question.rlike(rule), name).otherwise(out)
    return out


def citation_coverage(answer: Column) -> Column:
    """The share of an answer's paragraphs that carry a marker; null without paragraphs."""
    parts = F.filter(F.split(answer, "\n"), lambda p: F.btrim(p) != "")
    return F.try_divide(F.size(F.filter(parts, lambda p: p.rlike("\\[[0-9]+\\]"))).cast("double"), F.size(parts))


def exported(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, markdown: a session as Markdown, turn by turn."""
    line = F.concat(F.lit("**"), "role", F.lit("**: "), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy(key).agg(F.concat(F.lit("# Session "), F.col(key).cast("string"), F.lit("\n\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n")).alias("markdown"))


def event(kind: str, *columns: str) -> Column:
    """One event of an answer's stream as JSON: its type, then the columns."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), *columns))


# The steps of an answer.
STEPS = ["condensing", "retrieving", "reranking", "generating"]


def reply_events(messages: DataFrame, *keys: str) -> DataFrame:
    """keys, no, event: what a listener hears of each answer, as JSON in the order of no, made in the row of the answer.

    messages: keys, message_id, mode, model, answer_kind, top_score, threshold, latency_ms, citations (an array of structs).
    It begins with `meta`; an answer that the gate stops doesn't get to its last step and says `no_answer` with the score and
    the threshold; others say a `citation` for each of theirs, but those from outside the sources never do; `done` ends all.
    """
    outside = F.col("answer_kind").isin("external", "cached_external")
    stopped = F.col("answer_kind") == "no_answer"
    status = F.transform(F.when(stopped, F.array(*map(F.lit, STEPS[:-1]))).otherwise(F.array(*map(F.lit, STEPS))), lambda s: F.to_json(F.struct(F.lit("status").alias("type"), s.alias("stage"))))
    citations = F.when(outside | stopped | F.col("citations").isNull(), F.array().cast("array<string>")).otherwise(F.transform("citations", lambda c: F.to_json(F.struct(F.lit("citation").alias("type"), c.alias("c")))))
    flat = F.transform(citations, lambda x: F.regexp_replace(F.regexp_replace(x, '^\\{"type":"citation","c":\\{', '{"type":"citation",'), "\\}\\}$", "}"))
    refused = F.when(stopped, F.array(event("no_answer", "top_score", "threshold"))).otherwise(F.array().cast("array<string>"))
    end = F.to_json(F.struct(F.lit("done").alias("type"), "message_id", "answer_kind", "latency_ms", F.col("model").alias("model_used")))
    heard = F.concat(F.array(event("meta", "message_id", "mode", "model")), status, flat, refused, F.array(end))
    return messages.select(*keys, F.posexplode(heard).alias("no", "event"))
