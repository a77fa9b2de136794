"""Tables of model responses and of model calls."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwright.functions.money import mean_of, rounded

# Defaults of a parsed recommendation.
DEFAULT_ACTION = "investigate"
DEFAULT_TITLE = "Investigate finding"
DEFAULT_LEVEL = "medium"
NO_TARGET = "unknown"
INVALID = "Invalid JSON from LLM"
STRICT = {"allowSingleQuotes": "false"}
# Every character that counts as white space around a response.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Every field is read as text, so a number in quotes is not lost.
ITEM = (
    "finding_id string, action_type string, title string, rationale string, "
    "estimated_monthly_savings_usd string, confidence string, effort string, "
    "suggested_command string"
)


def without_fences(text: Column) -> Column:
    """Text without a surrounding markdown code fence and white space."""
    space = F.lit(WHITE_SPACE)
    opened = F.regexp_replace(F.btrim(text, space), r"\A(?:```json)?(?:```)?", "")
    return F.btrim(F.regexp_replace(opened, r"```\z", ""), space)


def parse_recommendations(
    responses: DataFrame, findings: DataFrame, as_of: date
) -> DataFrame:
    """One recommendation per item of each response's JSON array.

    `responses` has `response_id` and `response_text`, `findings` has `finding_id`
    and `affected_resource`. A response that is not JSON gives no rows. The text is
    parsed inside an object, which makes text after the array an error too.
    """
    wrapped = F.concat(F.lit('{"items":'), without_fences(F.col("response_text")), F.lit("}"))
    parsed = F.from_json(wrapped, f"items array<struct<{ITEM.replace(' string', ':string')}>>",
                         STRICT)
    items = responses.select(
        "response_id", F.posexplode(parsed["items"]).alias("item_no", "item")
    ).select("response_id", "item_no", "item.*").withColumn(
        "finding_id", F.nullif("finding_id", F.lit(""))
    )
    parents = findings.groupBy("finding_id").agg(
        F.min("affected_resource").alias("target_resource")
    )
    savings = F.coalesce(
        F.col("estimated_monthly_savings_usd").try_cast("double"), F.lit(0.0)
    )
    identity = F.concat_ws("|", F.col("response_id").cast("string"), "item_no")
    # Items without a finding would all meet on one NULL key of a shuffled join.
    named = items.where("finding_id is not null").join(parents, "finding_id", "left")
    nameless = items.where("finding_id is null").withColumn(
        "target_resource", F.lit(None).cast("string")
    )
    return named.unionByName(nameless).select(
        F.sha2(identity, 256).alias("recommendation_id"),
        "response_id",
        F.array_compact(F.array("finding_id")).alias("finding_ids"),
        F.coalesce("action_type", F.lit(DEFAULT_ACTION)).alias("action_type"),
        F.coalesce("title", F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce("rationale", F.lit("")).alias("rationale"),
        savings.alias("estimated_monthly_savings_usd"),
        F.coalesce("confidence", F.lit(DEFAULT_LEVEL)).alias("confidence"),
        F.coalesce("effort", F.lit(DEFAULT_LEVEL)).alias("effort"),
        F.coalesce("target_resource", F.lit(NO_TARGET)).alias("target_resource"),
        "suggested_command",
        F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def extract_json_object(responses: DataFrame) -> DataFrame:
    """The JSON object inside each response, from its first to its last brace.

    Adds `json_text` (NULL if it does not parse), `is_valid` and `error_message`.
    """
    # One column per step: a step read several times is then computed once.
    braced = (F.col("_first") > 0) & (F.col("_last") > F.col("_first"))
    inside = F.substr("_text", F.col("_first"), F.col("_last") - F.col("_first") + 1)
    body = (
        responses.withColumn("_text", without_fences(F.col("response_text")))
        .withColumns({
            "_first": F.instr("_text", "{"),
            "_from_end": F.instr(F.reverse("_text"), "}"),
        })
        .withColumn("_last", F.when(
            F.col("_from_end") > 0, F.length("_text") - F.col("_from_end") + 1))
        .withColumn("_body", F.when(braced, inside).otherwise(F.col("_text")))
    )
    # Text after the object breaks the field around it, a second value shows as a
    # second element.
    field = F.concat(F.lit('{"v":'), F.col("_body"), F.lit("}"))
    elements = F.concat(F.lit("["), F.col("_body"), F.lit("]"))
    checked = body.withColumns({
        "_field": F.from_json(field, "v string", STRICT)["v"],
        "_count": F.size(F.from_json(elements, "array<string>", STRICT)),
    }).withColumn(
        "is_valid",
        F.coalesce(F.col("_field").isNotNull() & (F.col("_count") == 1), F.lit(False)),
    )
    return checked.select(
        *responses.columns,
        F.when(F.col("is_valid"), F.col("_body")).alias("json_text"),
        "is_valid",
        F.when(~F.col("is_valid"), INVALID).alias("error_message"),
    )


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Calls, failures, tokens and latency per run and endpoint.

    Only successful calls count as calls and bring tokens and latency.
    """
    ok = F.col("success")

    def tokens(name):
        return F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0)).cast("long").alias(name)

    latency = F.when(ok, F.col("latency_seconds").cast("decimal(28,8)"))
    return calls.groupBy("run_id", "endpoint").agg(
        F.count(F.when(ok, 1)).alias("calls"),
        F.count(F.when(~ok, 1)).alias("failures"),
        tokens("prompt_tokens"),
        tokens("completion_tokens"),
        tokens("total_tokens"),
        F.coalesce(rounded(mean_of(F.sum(latency), F.count(latency))), F.lit(0.0)).alias(
            "avg_latency_seconds"
        ),
    )
