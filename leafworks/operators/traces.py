"""Execution traces: steps (session, step, ts, action, model, tokens, duration, observation, final_answer), rolled up, validated, redacted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def number_steps(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Steps numbered from 1, with the seconds until the next one (null for the last)."""
    w = Window.partitionBy(session).orderBy(*order)
    gap = (F.unix_micros(F.lead(order[0]).over(w).cast("timestamp")) - F.unix_micros(F.col(order[0]).cast("timestamp"))) / 1e6
    return events.withColumn("step", F.row_number().over(w)).withColumn("gap_s", gap)


def rollup(steps: DataFrame) -> DataFrame:
    """One row per session: steps, tokens, duration, actions in order, last non-empty answer and its citations; one shuffle."""
    answered = F.coalesce(F.col("final_answer"), F.lit("")) != ""
    ordered = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("action"), F.lit("")) != "", F.struct("step", "action"))))
    out = steps.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum("tokens").alias("total_tokens"), F.sum("duration").alias("total_duration"),
        F.count_if(F.coalesce(F.col("action"), F.lit("")) != "").alias("n_tool_calls"),
        F.transform(ordered, lambda x: x["action"]).alias("actions_used"),
        F.max_by(F.when(answered, F.col("final_answer")), F.when(answered, F.col("step"))).alias("final_answer"),
    )
    return out.withColumn("n_citations", T.citations("final_answer"))


def usage(steps: DataFrame) -> DataFrame:
    return steps.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


def validate(traces: DataFrame, max_steps: int | None = None, required: list[str] | None = None, min_citations: int | None = None, has_documents: bool = True) -> DataFrame:
    """(session, ok, errors, warnings) of rolled-up traces under constraints."""
    none = F.lit(None).cast("string")
    errors = F.array_compact(F.array(F.when(F.col("n_steps") == 0, F.lit("no steps")), F.when(F.col("final_answer").isNull(), F.lit("no final answer"))))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in required or []]).cast("array<string>"), F.array_distinct("actions_used")))
    warnings = F.array_compact(F.array(
        F.when(F.col("final_answer").isNotNull() & (F.col("n_tool_calls") == 0), F.lit("answer before any document action")) if has_documents else none,
        F.when(F.col("n_steps") > max_steps, F.concat(F.lit("too many steps: "), F.col("n_steps").cast("string"))) if max_steps is not None else none,
        F.when(F.size(missing) > 0, F.concat(F.lit("tools not used: "), F.array_join(missing, ","))) if required else none,
        F.when(F.col("final_answer").isNotNull() & (F.col("n_citations") < min_citations), F.concat(F.lit("too few citations: "), F.col("n_citations").cast("string"))) if min_citations is not None else none,
    ))
    return traces.select("session", (F.size(errors) == 0).alias("ok"), errors.alias("errors"), warnings.alias("warnings"))


def validate_reply(reply: Column, language: Column | None = None) -> Column:
    """struct(ok, errors, warnings) of a tagged reply: it acts or answers, its calls parse, names of tools aren't called in prose, its language fits."""
    final = T.tag_between(reply, "final_answer")
    blocks = T.tool_blocks(reply)
    acts, answers = F.size(blocks) > 0, final.isNotNull()
    bad = F.filter(blocks, lambda x: F.try_parse_json(x).isNull())
    parsed = F.filter(blocks, lambda x: F.try_parse_json(x).isNotNull())
    nameless = F.filter(parsed, lambda x: F.get_json_object(x, "$.name").isNull() | F.get_json_object(x, "$.arguments").isNull())
    prose = F.concat_ws(" ", *[T.tag_between(reply, n) for n in ("reasoning", "observation", "step_name")])
    called = [F.when(prose.rlike(rf"(?U)\b{n}\s*\("), F.lit(f"{n} called in prose")) for n in T.TOOL_NAMES]
    errors = F.array_compact(F.array(
        F.when(~acts & ~answers, F.lit("neither tool call nor answer")),
        F.when(F.size(bad) > 0, F.concat(F.size(bad).cast("string"), F.lit(" calls are no JSON"))),
        F.when(F.size(nameless) > 0, F.concat(F.size(nameless).cast("string"), F.lit(" calls lack a field"))),
    ))
    verdict = T.language_verdict(final, language) if language is not None else F.lit("ok")
    warnings = F.array_compact(F.array(*called, F.when(answers & (verdict != "ok"), verdict), F.when(answers & (T.citations(final) == 0), F.lit("no citation"))))
    return F.struct((F.size(errors) == 0).alias("ok"), errors.alias("errors"), warnings.alias("warnings"))


def redact(steps: DataFrame) -> DataFrame:
    """Steps fit to be shared: texts shortened and without secrets, empty fields null, raw replies dropped."""
    short = lambda c: T.redact_content(T.redact_secrets(F.nullif(F.col(c), F.lit(""))))
    return steps.withColumns({c: short(c) for c in ("observation", "final_answer") if c in steps.columns}).drop("raw_response")


def record_inputs(inputs: DataFrame) -> DataFrame:
    """(session, inputs, n_inputs): previews of what a session was given; when redacted only the number is shown."""
    item = F.struct("type", "source", T.preview("content").alias("content_preview"), F.coalesce(F.char_length("content"), F.lit(0)).alias("content_length"))
    return inputs.groupBy("session").agg(F.array_sort(F.collect_list(item)).alias("inputs")).withColumn("n_inputs", F.size("inputs"))


def response(traces: DataFrame, validation: DataFrame, redacted: bool = True) -> DataFrame:
    """What a caller gets of each session: answer, totals, validity."""
    return traces.join(validation, "session").select("session", F.coalesce("final_answer", F.lit("")).alias("answer"), "n_steps", "total_tokens", F.col("final_answer").isNotNull().alias("success"), "ok", F.size("warnings").alias("n_warnings"))
