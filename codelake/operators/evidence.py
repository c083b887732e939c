"""Packing evidence for answers, and checking the answers' citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import settle

MOST, WINDOW, RESERVE, HITS = 5500, 6000, 128, 20
PROMPT = "Answer from the code given below alone, name every chunk that a claim rests on as [id], and reply with a JSON object of answer and citations."


def token_count(text: Column) -> Column:
    """The default tokenizer: runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def token_budget(prompt_tokens: Column) -> Column:
    """What is left of the window for evidence."""
    return F.greatest(F.lit(0), F.least(F.lit(MOST), WINDOW - prompt_tokens - RESERVE))


def pack_evidence(hits: DataFrame, budgets: DataFrame) -> DataFrame:
    """query_id, chunk_ids, tokens: hits (query_id, rank, chunk_id, n_tokens) in order of rank, without those that don't fit what is left."""
    listed = hits.where(F.col("rank") <= HITS).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("n_tokens").cast("long").alias("n"), "chunk_id"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def take(done: Column, item: Column) -> Column:
        fits = done["used"] + item["n"] <= F.col("budget")
        return F.when(fits, F.struct((done["used"] + item["n"]).alias("used"), F.concat(done["ids"], F.array(item["chunk_id"])).alias("ids"))).otherwise(done)

    packed = listed.join(budgets.select("query_id", F.col("budget").cast("long").alias("budget")), "query_id").withColumn("p", F.aggregate("items", start, take))
    return packed.select("query_id", F.col("p.ids").alias("chunk_ids"), F.col("p.used").alias("tokens"))


def for_queries(hits: DataFrame, chunks: DataFrame, queries: DataFrame, prompt: str = PROMPT, tokens: Callable[[Column], Column] = token_count) -> DataFrame:
    """query_id, budget, chunk_ids, tokens, context for every query: what of its hits (query_id, rank, chunk_id) fits beside prompt and query.

    A chunk takes the tokens of its JSON item (id, path, start_line, end_line, excerpt); context has the items taken, in order.
    """
    used = hits.where(F.col("rank") <= HITS)
    items = chunks.select(F.col("id").alias("chunk_id"), F.to_json(F.struct("id", "path", "start_line", "end_line", "excerpt")).alias("item"))
    sized = settle(used.select("query_id", "rank", "chunk_id").join(items, "chunk_id").withColumn("n_tokens", tokens(F.col("item"))), "items")
    budgets = queries.select("query_id", token_budget(tokens(F.concat(F.lit(prompt), F.coalesce("query", F.lit(""))))).cast("long").alias("budget"))
    packed = pack_evidence(sized, budgets)
    chosen = packed.select("query_id", F.explode("chunk_ids").alias("chunk_id")).join(sized, ["query_id", "chunk_id"])
    context = chosen.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("context"))  # of HITS at most
    none = F.array().cast("array<string>")
    found = budgets.join(packed, "query_id", "left").join(context, "query_id", "left")
    return found.select("query_id", "budget", F.coalesce("chunk_ids", none).alias("chunk_ids"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("context", none).alias("context"))


def check_replies(replies: DataFrame, packed: DataFrame, enabled: bool = True) -> DataFrame:
    """query_id, status, answer, citations for replies (query_id, raw; null raw: the request failed) and what was packed."""
    raw = F.col("raw")
    inner = F.regexp_replace(F.regexp_replace(raw, r"(?s)^```[^\n]*\n", ""), r"(?s)```(?:(?!```).)*$", "")
    body = F.when(raw.startswith("```"), inner).otherwise(raw)
    kinds = F.try_parse_json(body)
    parsed = replies.join(packed, "query_id", "full").withColumn("kinds", kinds)
    answer = F.try_variant_get("kinds", "$.answer", "string")
    text = F.schema_of_variant(F.try_variant_get("kinds", "$.answer", "variant")) == "STRING"
    listed = F.when(F.schema_of_variant(F.try_variant_get("kinds", "$.citations", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get("kinds", "$.citations", "array<string>"))
    parsed = parsed.withColumn("answer", F.when(text, answer)).withColumn("cited", listed)
    inline = F.regexp_extract_all("answer", F.lit(r"\[([^\]]+)\]"), F.lit(1))
    same = (F.size(F.array_except(inline, "cited")) == 0) & (F.size(F.array_except("cited", inline)) == 0)
    sound = F.col("answer").isNotNull() & F.col("cited").isNotNull() & same & (F.size(F.array_except("cited", "chunk_ids")) == 0)
    empty = F.coalesce(F.size("chunk_ids"), F.lit(0)) <= 0
    status = (
        F.when(F.lit(not enabled), "disabled")
        .when(empty, "insufficient-evidence")
        .when(~F.coalesce(sound, F.lit(False)), "unavailable")
        .when(F.size("cited") == 0, "insufficient-evidence")
        .otherwise("answered")
    )
    done = parsed.withColumn("status", status)
    answered = F.col("status") == "answered"
    return done.select("query_id", "status", F.when(answered, F.col("answer")).alias("answer"), F.when(answered, F.array_distinct("cited")).otherwise(F.array().cast("array<string>")).alias("citations"))
