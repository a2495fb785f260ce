"""Conversation tables ``(conv_id, turn, role, text)`` and model responses as column jobs.

Turns of a conversation are numbered 0, 1, 2, ... without holes, as the positions of a message list are. One
conversation may be very long: nothing here gathers a whole conversation in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescope.functions.text import trimmed
from tablescope.plans.numbering import number_within

RECENT = 5
STORED_CHARS = 2000
RESULT_CHARS = 500
QUERY_CHARS = 40
OVERVIEW_CHARS = 500
DESCRIPTION_CHARS = 1000
TURNS_PER_CHUNK = 1024
RULE = "=" * 50
PARSE_WARNING = "LLM response was not valid JSON. Showing raw text."

RESPONSE_SCHEMA = (
    "dataset_overview string, key_metrics map<string,string>, "
    "insights array<struct<title:string,description:string,impact:string,category:string>>, "
    "anomalies array<struct<title:string,description:string,severity:string,affected_columns:array<string>>>, "
    "recommendations array<struct<action:string,rationale:string,priority:string>>"
)


def recent_results(
    conversations: DataFrame, recent: int = RECENT, stored_chars: int = STORED_CHARS, result_chars: int = RESULT_CHARS
) -> DataFrame:
    """The last question and answer pairs of each conversation: ``conv_id, turn, question, result``.

    User and assistant turns are numbered without holes first, whatever turns lie between them. An answer is the
    assistant turn right after a user turn, so the pairs come from an equi-join on conversation and number together,
    which spreads a long conversation evenly. The limit per conversation is applied in every task before the
    exchange. Answers are stored up to ``stored_chars`` characters and shown up to ``result_chars``.
    """
    spoken = conversations.filter("role IN ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    chunk = F.floor(F.col("turn") / TURNS_PER_CHUNK)
    numbered = number_within(spoken, "conv_id", chunk, F.col("turn"), "place")
    questions = numbered.filter("role = 'user'").select("conv_id", "place", "turn", F.col("text").alias("question"))
    answers = numbered.filter("role = 'assistant'").select(
        "conv_id",
        (F.col("place") - 1).alias("place"),
        F.substring(F.substring("text", 1, stored_chars), 1, result_chars).alias("result"),
    )
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    pairs = questions.join(answers, ["conv_id", "place"]).select("conv_id", "turn", "question", "result")
    return pairs.withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= recent).drop("back")


def conversation_context(
    conversations: DataFrame, recent: int = RECENT, base: str | None = None, analysed_at: str | None = None
) -> DataFrame:
    """``conv_id, n_results, context``: the recent pairs of each conversation as one text, oldest first.

    ``base``, the report of the table under discussion, stands in front, and the time of its analysis at the end.
    """
    entry = F.concat(F.lit("\nQuestion: "), "question", F.lit("\nResult: "), "result")
    entries = F.array_sort(F.collect_list(F.struct("turn", entry.alias("entry"))))  # at most ``recent`` entries
    heading = f"{base}\n" if base else ""
    heading += f"\n{RULE}\nPREVIOUS ANALYSIS RESULTS\n{RULE}\n"
    ending = f"\n\nAnalysis performed at: {analysed_at}" if analysed_at else ""
    return (
        recent_results(conversations, recent)
        .groupBy("conv_id")
        .agg(F.count("*").alias("n_results"), entries.alias("entries"))
        .select(
            "conv_id", "n_results", F.concat(F.lit(heading), F.array_join("entries.entry", "\n"), F.lit(ending)).alias("context")
        )
    )


def conversation_messages(conversations: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """The message list of each conversation, one row per message: ``conv_id, position, role, content``.

    System messages come first, then the turns in order, then the new user message of ``prompts (conv_id, text)``,
    once. The list stays in rows, so its length has no bound.
    """
    messages = conversations.select("conv_id", "turn", "role", F.col("text").alias("content"))
    if prompts is not None:
        last = F.lit(2**62).cast("bigint")
        messages = messages.unionByName(
            prompts.select(
                "conv_id", last.alias("turn"), F.lit("user").alias("role"), F.col("text").alias("content")
            )
        )
    after_system = F.when(F.col("role") == "system", F.lit(0)).otherwise(F.lit(1))
    chunk = F.struct(after_system.alias("part"), F.floor(F.col("turn") / TURNS_PER_CHUNK).alias("slice"))
    numbered = number_within(messages, "conv_id", chunk, F.col("turn"), "position")
    return numbered.select("conv_id", "position", "role", "content")


def conversation_queries(conversations: DataFrame, chars: int = QUERY_CHARS) -> DataFrame:
    """The user turns of each conversation, numbered and cut: ``conv_id, number, query, caption``."""
    asked = conversations.filter("role = 'user'")
    chunk = F.floor(F.col("turn") / TURNS_PER_CHUNK)
    numbered = number_within(asked, "conv_id", chunk, F.col("turn"), "number")
    query = F.substring("text", 1, chars)
    caption = F.concat(F.col("number").cast("string"), F.lit(". "), query, F.lit("..."))
    return numbered.select("conv_id", "number", query.alias("query"), caption.alias("caption"))


def _is_json_object(text: Column) -> Column:
    """Whether the whole text is one JSON object. The parser stops after the first value, so text behind it only
    shows when the text is put inside an array and inside an object."""
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    single = F.try_variant_get(in_array, "$[1]", "variant").isNull()
    return text.startswith("{") & in_array.isNotNull() & in_object.isNotNull() & single


def parse_responses(responses: DataFrame, key: str, response: str) -> DataFrame:
    """``key, parse_path, summary``: each response as a structured summary.

    The text is tried as JSON (``plain``, or ``fenced`` once a code fence is taken off), then its outermost braces
    (``embedded``); if neither is a JSON object, the raw text becomes the overview and one insight (``fallback``).
    """
    stripped = trimmed(F.col(response))
    opened = F.regexp_replace(stripped, r"\A```(?:json)?\s*\n?", "")
    unfenced = F.regexp_replace(opened, r"\n?```\s*\z", "")
    is_fenced = stripped.startswith("```")
    texts = responses.select(
        key, F.when(is_fenced, unfenced).otherwise(stripped).alias("body"), is_fenced.alias("fenced")
    ).withColumn("braces", F.regexp_extract("body", r"(?s)\{.*\}", 0))
    path = (
        F.when(_is_json_object(F.trim("body")), F.when(F.col("fenced"), "fenced").otherwise("plain"))
        .when(_is_json_object(F.col("braces")), "embedded")
        .otherwise("fallback")
    )
    chosen = F.when(F.col("parse_path") == "embedded", F.col("braces")).otherwise(F.col("body"))
    raw_insight = F.struct(
        F.lit("Raw Analysis").alias("title"),
        F.substring("body", 1, DESCRIPTION_CHARS).alias("description"),
        F.lit("medium").alias("impact"),
        F.lit("general").alias("category"),
    )
    fallback = F.struct(
        F.substring("body", 1, OVERVIEW_CHARS).alias("dataset_overview"),
        F.create_map().cast("map<string,string>").alias("key_metrics"),
        F.array(raw_insight).alias("insights"),
        F.array().cast(
            "array<struct<title:string,description:string,severity:string,affected_columns:array<string>>>"
        ).alias("anomalies"),
        F.array().cast("array<struct<action:string,rationale:string,priority:string>>").alias("recommendations"),
    )
    parsed = F.from_json(chosen, RESPONSE_SCHEMA)
    return texts.withColumn("parse_path", path).select(
        key, "parse_path", F.when(F.col("parse_path") == "fallback", fallback).otherwise(parsed).alias("summary")
    )


def llm_json_extract(responses: DataFrame, key: str, response: str) -> DataFrame:
    """One flat row per response: overview, numbers of entries and the parse warning."""

    def entries(name: str) -> Column:
        return F.coalesce(F.size(f"summary.{name}"), F.lit(0)).cast("bigint")

    overview = F.coalesce("summary.dataset_overview", F.lit("No overview available."))
    return parse_responses(responses, key, response).select(
        key,
        "parse_path",
        overview.alias("dataset_overview"),
        entries("key_metrics").alias("n_metrics"),
        entries("insights").alias("n_insights"),
        entries("anomalies").alias("n_anomalies"),
        entries("recommendations").alias("n_recommendations"),
        F.when(F.col("parse_path") == "fallback", F.lit(PARSE_WARNING)).alias("parse_warning"),
    )


def llm_insight_rows(responses: DataFrame, key: str, response: str) -> DataFrame:
    """Every entry of the summaries as a row: ``key, section, number, title, description, level, detail``.

    Sections are ``metric, insight, anomaly`` and ``recommendation``; missing fields get their defaults.
    """
    parsed = parse_responses(responses, key, response)
    none = F.lit("")

    def text(value: Column, default: str = "") -> Column:
        return F.coalesce(value, F.lit(default))

    def entry(section: str, at: Column, title: Column, description: Column, level: Column, detail: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            (at + 1).alias("number"),
            title.alias("title"),
            description.alias("description"),
            level.alias("level"),
            detail.alias("detail"),
        )

    def metric(e: Column, at: Column) -> Column:
        return entry("metric", at, F.initcap(F.translate(e["key"], "_", " ")), text(e["value"]), none, none)

    def insight(e: Column, at: Column) -> Column:
        return entry(
            "insight", at, text(e["title"], "Insight"), text(e["description"]), text(e["impact"]), text(e["category"])
        )

    def anomaly(e: Column, at: Column) -> Column:
        columns = text(F.array_join(e["affected_columns"], ", "))
        return entry("anomaly", at, text(e["title"], "Anomaly"), text(e["description"]), text(e["severity"]), columns)

    def recommendation(e: Column, at: Column) -> Column:
        return entry("recommendation", at, text(e["action"]), text(e["rationale"]), text(e["priority"]), none)

    # Each response is parsed once; all its entries become one array and then rows.
    lists = [
        F.transform(F.map_entries("summary.key_metrics"), metric),
        F.transform("summary.insights", insight),
        F.transform("summary.anomalies", anomaly),
        F.transform("summary.recommendations", recommendation),
    ]
    entries = F.flatten(F.filter(F.array(*lists), lambda part: part.isNotNull()))
    return parsed.select(key, F.inline(entries))
