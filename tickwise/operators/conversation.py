"""Question-and-answer log analytics.

The chat loop of the application is replaced by its *log*: one row per
message ``(conv_id, turn, role, content, tool_calls)``. Per-conversation
running values use the bucketed prefix helpers, so one very long session is
still computed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guardrail import category_of_variant, guardrail_root, is_guardrail_root, message_of_category
from ..functions.text import capitalise, clean_text, last_part, lookup, policy_error, reference_label
from .windows import carry_forward, prefix_sum, prefix_sums

TURN_BUCKET = 1024  # turns per bucket of the two-pass running sums
DOCS_SCHEMA = "array<struct<page_content:string,metadata:map<string,string>>>"


def _turn_bucket(turn: str) -> Column:
    return F.floor(F.col(turn) / F.lit(TURN_BUCKET))


def classify_message(log: DataFrame, role: str = "role", content: str = "content",
                     tool_calls: str = "tool_calls") -> DataFrame:
    """P14 – user / tool_call / answer / empty / tool_result / other, per message (stateless)."""
    has_calls = F.coalesce(F.size(F.col(tool_calls)) > 0, F.lit(False)) if tool_calls in log.columns else F.lit(False)
    has_content = F.coalesce(F.length(F.col(content)) > 0, F.lit(False))
    cleaned = clean_text(F.coalesce(F.col(content), F.lit("")))
    cls = (F.when(F.col(role) == "user", F.lit("user"))
           .when((F.col(role) == "assistant") & has_calls & has_content, F.lit("tool_call"))
           .when((F.col(role) == "assistant") & (F.length(cleaned) > 0), F.lit("answer"))
           .when(F.col(role) == "assistant", F.lit("empty"))
           .when(F.col(role) == "tool", F.lit("tool_result"))
           .otherwise(F.lit("other")))
    return log.withColumn("message_class", cls)


def segment_questions(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """W4 – question number = running count of user messages; 0 is the preamble."""
    flag = (F.col(role) == "user").cast("long")
    return prefix_sum(log, conv, turn, flag, _turn_bucket(turn), "question_no")


def final_answers(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  content: str = "content") -> DataFrame:
    """A12/X7 – last non-empty cleaned assistant answer per question (preamble excluded)."""
    seg = classify_message(segment_questions(log, conv, turn, role), role, content)
    answers = seg.where((F.col("message_class") == "answer") & (F.col("question_no") > 0))
    return answers.groupBy(conv, "question_no").agg(
        F.max_by(clean_text(content), F.col(turn)).alias("answer"),
        F.max(turn).alias("answer_turn"),
        F.count(F.lit(1)).alias("n_answers"))


def conversation_context(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         content: str = "content") -> DataFrame:
    """W7 – at each user message: number and characters of earlier user/assistant messages."""
    is_ctx = F.col(role).isin("user", "assistant")
    chars = F.when(is_ctx, F.coalesce(F.length(F.col(content)), F.lit(0))).otherwise(0).cast("long")
    sums = prefix_sums(log, conv, turn, {"context_messages": is_ctx.cast("long"), "context_chars": chars},
                       _turn_bucket(turn), inclusive=False)
    return sums.where(F.col(role) == "user").select(conv, turn, "context_messages", "context_chars")


def provider_of_calls(calls: DataFrame, catalog: DataFrame, name: str = "function_name") -> DataFrame:
    """J3 – provider of each tool call: last part of the name after ``__`` equals the
    last dotted part of a tool's coordinates; the first provider in catalog order wins.

    ``catalog`` is configuration (a handful of tools), broadcast explicitly.
    """
    tools = catalog.select(last_part("tool_coordinates", ".").alias("_fn"), "provider", "provider_pos")
    firsts = tools.groupBy("_fn").agg(F.min_by("provider", "provider_pos").alias("_provider"))
    return (calls.withColumn("_fn", last_part(name, "__"))
            .join(F.broadcast(firsts), "_fn", "left")
            .withColumn("provider", capitalise("_provider"))
            .drop("_fn", "_provider"))


def carry_provider(log: DataFrame, key: str, order: str, provider: str, bucket: Column,
                   out: str = "current_provider") -> DataFrame:
    """W3 – provider found by the latest tool call, carried to later rows of the session."""
    return carry_forward(log, key, order, provider, bucket, out)


def retrieved_documents(tool_messages: DataFrame, content: str = "content") -> DataFrame:
    """P15 – documents inside tool results; non-document content and documents
    without ``chunk_id`` are ignored."""
    docs = tool_messages.withColumn("_docs", F.from_json(F.col(content), DOCS_SCHEMA))
    return (docs.select("*", F.posexplode_outer("_docs").alias("doc_pos", "doc"))
            .where(F.col("doc.metadata").isNotNull() & lookup("doc.metadata", "chunk_id").isNotNull())
            .withColumn("chunk_id", lookup("doc.metadata", "chunk_id"))
            .drop("_docs"))


def supporting_documents(retrievals: DataFrame, question: list[str], chunk: str = "chunk_id",
                         seq: str = "seq", provider: str = "provider", doc: str | None = None) -> DataFrame:
    """A3/O2/X6 – per question and chunk: reference count, last provider, first-seen order."""
    aggs = [F.count(F.lit(1)).alias("n_references"),
            F.max_by(F.col(provider), F.col(seq)).alias("provider"),
            F.min(seq).alias("first_seen")]
    if doc:
        aggs.append(F.max_by(F.col(doc), F.col(seq)).alias("document"))
    out = retrievals.groupBy(*question, chunk).agg(*aggs)
    return out.withColumn("reference_label", reference_label("n_references"))


def active_tools(catalog: DataFrame, selection: DataFrame) -> DataFrame:
    """P11/J4 – enabled tools that are selected (selection: tool_id, selected)."""
    return (catalog.join(selection, "tool_id", "inner")
            .where(F.col("tool_enabled") & F.col("selected")))


def tool_summary(tools: DataFrame) -> DataFrame:
    """A4/O1 – tools grouped by type (sorted by type, as the tool builder groups them), ids sorted."""
    return tools.groupBy("tool_type").agg(
        F.count(F.lit(1)).alias("n_tools"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.col("tool_id")))).alias("tool_ids"))


def guardrail_report(errors: DataFrame, body: str = "body") -> DataFrame:
    """A13 – guardrail failures by category, with the friendly message and error text.

    Each body is parsed once: the guardrail root text and its VARIANT are
    projected first, and the category tests read that column.
    """
    roots = errors.select(guardrail_root(body).alias("_root"))
    g = (roots.where(is_guardrail_root("_root"))
         .select(F.try_parse_json("_root").alias("_v"))
         .select(category_of_variant("_v").alias("category")))
    return (g.groupBy("category")
            .agg(F.count(F.lit(1)).alias("n_errors"))
            .withColumn("message", message_of_category("category"))
            .withColumn("error_text", policy_error("message")))


__all__ = ["classify_message", "segment_questions", "final_answers", "conversation_context",
           "provider_of_calls", "carry_provider", "retrieved_documents", "supporting_documents",
           "active_tools", "tool_summary", "guardrail_report"]
