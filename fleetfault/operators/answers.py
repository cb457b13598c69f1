"""Conversations to one prompt, and model answers back to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.functions.text import capture, computed
from fleetfault.operators.ordering import ordered_text

# Shape of an answer.
ITEM = (
    "struct<insightId:string,rootCause:string,fixSuggestion:string,confidence:string,evidence:array<string>,"
    "impactAssessment:string,debuggingSteps:array<string>,relatedInsights:array<string>,category:string,"
    "affectedComponents:array<string>>"
)
ANSWER = (
    "struct<executiveSummary:string,systemDiagnosis:string,"
    "correlationFindings:array<struct<description:string,insightIds:array<string>,confidence:string>>,"
    "prioritizedActions:array<struct<action:string,reason:string,effort:string,impact:string>>,"
    f"insights:array<{ITEM}>>"
)
SPOTS = [(r"```(?:json)?\s*([\s\S]*?)```", 1), (r"\{[\s\S]*\}", 0), (r"\[[\s\S]*\]", 0)]


def flatten_conversation(
    turns: DataFrame, keys: Sequence[str], turn: str, role: str = "role", text: str = "text", out: str = "prompt"
) -> DataFrame:
    """All turns but the last as ``User:``/``Assistant:`` history, then the last as it is."""
    final = turns.groupBy(*keys).agg(F.max(turn).alias("_last"), F.max_by(text, turn).alias("_final"))
    who = F.when(F.col(role) == "user", "User: ").otherwise("Assistant: ")
    earlier = turns.join(final.select(*keys, "_last"), list(keys)).where(F.col(turn) < F.col("_last"))
    history = ordered_text(earlier.withColumn("_t", F.concat(who, F.col(text))), keys, turn, "_t", "_history", "\n\n")
    lead = F.coalesce(F.concat(F.lit("Previous conversation:\n"), "_history", F.lit("\n\n")), F.lit(""))
    return final.join(history, list(keys), "left").select(*keys, F.concat(lead, "_final").alias(out))


def _candidate(found: Column) -> tuple[Column, Column]:
    """An object with an ``insights`` array, or a bare array, in one cut of the text."""
    # The reader stops after the first value; wrapped in a list, text behind it is an error.
    one = F.size(F.from_json(F.concat(F.lit("["), found, F.lit("]")), "array<string>")) == 1
    listed = F.ltrim(F.get_json_object(found, "$.insights")).startswith("[")
    as_object = F.when(found.startswith("{") & listed & one, F.from_json(found, ANSWER))
    # from_json would wrap an object into an array, so arrays must start as one.
    items = F.when(found.startswith("[") & one, F.from_json(found, f"array<{ITEM}>"))
    return as_object, items


def parse_answers(outputs: DataFrame, keys: Sequence[str], text: str = "content", out: str = "answer") -> DataFrame:
    """``answer`` struct or null: fenced block, widest object, widest array, the first that reads."""
    found: list[Column] = []
    empty = [F.lit("").alias("executiveSummary"), F.lit("").alias("systemDiagnosis")]
    lists = [
        F.lit(None).cast(ANSWER.split("correlationFindings:")[1].split(",prioritizedActions:")[0]).alias("correlationFindings"),
        F.lit(None).cast(ANSWER.split("prioritizedActions:")[1].split(",insights:")[0]).alias("prioritizedActions"),
    ]
    cuts = F.array(*[F.trim(capture(text, p, g), F.lit(" \n\r\t")) for p, g in SPOTS])
    for i in range(len(SPOTS)):
        as_object, items = _candidate(F.col("_cuts")[i])
        found += [as_object, F.when(items.isNotNull(), F.struct(*empty, *lists, items.alias("insights")))]
    cut = outputs.select(*keys, computed(cuts).alias("_cuts"))
    return cut.select(*keys, computed(F.coalesce(*found)).alias(out))


def deep_insights(insights: DataFrame, answers: DataFrame, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """Findings with the answer's item for their id; the last item of an id wins."""
    items = (
        answers.where("answer is not null")
        .select(*keys, F.posexplode("answer.insights"))
        .groupBy(*keys, F.col("col.insightId").alias("insight_id"))
        .agg(F.max_by("col", "pos").alias("d"))
    )
    none = F.array().cast("array<string>")
    told = F.struct(
        F.col("d.rootCause").alias("root_cause"), F.col("d.fixSuggestion").alias("fix_suggestion"),
        F.col("d.confidence").alias("confidence"), F.coalesce("d.evidence", none).alias("evidence"),
        F.coalesce("d.impactAssessment", F.lit("")).alias("impact_assessment"),
        F.coalesce("d.debuggingSteps", none).alias("debugging_steps"),
        F.coalesce("d.relatedInsights", none).alias("related_insights"),
        F.coalesce("d.category", F.lit("root_cause")).alias("category"),
        F.coalesce("d.affectedComponents", none).alias("affected_components"),
    )
    return insights.join(items, [*keys, "insight_id"], "left").withColumn("deep", F.when(F.col("d").isNotNull(), told)).drop("d")


def deep_overview(answers: DataFrame, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """Overview per report, only where the summary says something."""
    a = F.col("answer")
    return answers.where(a["executiveSummary"] != "").select(
        *keys, a["executiveSummary"].alias("executive_summary"),
        F.coalesce(a["systemDiagnosis"], F.lit("")).alias("system_diagnosis"),
        F.coalesce(a["correlationFindings"], F.array()).alias("correlation_findings"),
        F.coalesce(a["prioritizedActions"], F.array()).alias("prioritized_actions"),
    )
