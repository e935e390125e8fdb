"""Scores of model checks over trajectory events, and why a submission went missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies, text
from . import search

# --- Fixed values. Codes that explain a missing submission, in the order in which they are looked for.
MISSING = (
    "submission_text_is_quoted_or_commented", "submission_block_raised", "submission_answer_rebound", "submission_state_inconsistent",
    "submission_not_reached_at_runtime", "submission_text_in_unexecutable_fence", "submission_text_outside_fence",
)
SUBMISSION = r"answer\s*\[\s*[\"']ready[\"']\s*\]\s*=\s*True"
RUNNABLE = r"(?s)```(?:repl|python|py)[ \t]*\n(.*?)```"
OTHER_FENCE = r"(?s)```(?!repl|python|py)[a-z]+[ \t]*\n(.*?)```"


def _any(flag: Column) -> Column:
    return F.coalesce(F.max(flag), F.lit(False))


def emission(messages: DataFrame, by: str = "model", trial: str = "run_id") -> DataFrame:
    """(by, score, max_score, passed): 20 points shared over trials with a runnable block; passed by two of three."""
    met = messages.groupBy(by, trial).agg(_any(F.col("content").rlike(RUNNABLE)).alias("met"))
    share = F.count_if("met") / F.count(F.lit(1))
    return met.groupBy(by).agg(F.round(20 * share).cast("double").alias("score"), F.lit(20.0).alias("max_score"), (share >= 2 / 3).alias("passed"))


def helper_calls(messages: DataFrame, helpers: tuple[str, ...] = ("grep", "peek", "chunk"), by: str = "model") -> DataFrame:
    """(by, score, max_score, passed): 15 points shared over helper calls whose brackets balance on their line."""
    calls = messages.select(by, F.explode(F.regexp_extract_all("content", F.lit(rf"(\b(?:{'|'.join(helpers)})\([^\n]*)"), F.lit(1))).alias("call"))
    good = F.count_if(replies.balanced(F.col("call")))
    out = calls.groupBy(by).agg((15.0 * good / F.count(F.lit(1))).alias("score"), (good > 0).alias("passed"))
    all_ = messages.select(by).distinct().join(out, by, "left")
    return all_.select(by, F.round(F.coalesce("score", F.lit(0.0)), 1).alias("score"), F.lit(15.0).alias("max_score"), F.coalesce("passed", F.lit(False)).alias("passed"))


def quotes(messages: DataFrame, by: str = "model") -> DataFrame:
    """(by, score, max_score, passed): 5 points if no reply holds typographic quotes in a runnable block."""
    code = F.array_join(F.regexp_extract_all("content", F.lit(RUNNABLE), F.lit(1)), "\n")
    n = F.sum(text.smart_quotes(code))
    return messages.groupBy(by).agg(F.when(n == 0, 5.0).otherwise(0.0).alias("score"), F.lit(5.0).alias("max_score"), (n == 0).alias("passed"))


def recovery(events: DataFrame, by: str = "model", trial: str = "run_id") -> DataFrame:
    """(by, score, max_score, passed): 15 points if cells ran and none raised, or if a clean cell stands in a strictly later turn than the first that raised; none without cells. The worst trial of a model counts."""
    cells = events.where(F.col("event") == "repl_result").withColumn("failed", F.coalesce(F.trim("stderr"), F.lit("")) != "")
    first = cells.groupBy(by, trial).agg(F.min(F.when(F.col("failed"), F.col("turn"))).alias("first"))
    later = cells.join(first, [by, trial]).groupBy(by, trial).agg(_any(~F.col("failed") & (F.col("turn") > F.col("first"))).alias("again"), F.max("first").alias("first"))
    ok = later.select(by, trial, (F.col("first").isNull() | F.col("again")).alias("ok"))
    told = events.select(by, trial).distinct().join(ok, [by, trial], "left").groupBy(by).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("passed"))
    return told.select(by, F.when(F.col("passed"), 15.0).otherwise(0.0).alias("score"), F.lit(15.0).alias("max_score"), "passed")


def format_discipline(messages: DataFrame, by: str = "model") -> DataFrame:
    """(by, score, max_score, passed): 10 points less 5 for every reply of more than five characters without a runnable block, 0 at least."""
    own = F.trim("content")
    bad = F.count_if((F.length(own) > 5) & ~own.rlike(RUNNABLE))
    return messages.groupBy(by).agg(F.greatest(F.lit(0.0), 10.0 - 5.0 * bad).alias("score"), F.lit(10.0).alias("max_score"), (bad == 0).alias("passed"))


def _plain(said: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(said, F.lit(""))), r"[\s‐-―-]+", "")


def needles(answers: DataFrame, tasks: DataFrame, by: str = "model") -> DataFrame:
    """(by, score, max_score, passed): 5 points for every task whose needle an answer holds, case, hyphens and white space aside; passed from two. Rows (by, task, answer) and (task, needle)."""
    met = answers.join(tasks, "task").groupBy(by).agg(
        F.count_if(F.contains(_plain(F.col("answer")), _plain(F.col("needle")))).alias("right"), F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("asked"),
    )
    every = answers.select(by).distinct().join(met, by, "left").crossJoin(tasks.agg(F.count(F.lit(1)).alias("tasks")))  # one row
    right, n, asked = (F.coalesce(c, F.lit(0)) for c in ("right", "n", "asked"))
    return every.select(by, (5.0 * right).alias("score"), (5.0 * (n + F.col("tasks") - asked)).alias("max_score"), (right >= 2).alias("passed"))


def subcalls(messages: DataFrame, by: str = "model") -> DataFrame:
    """(by, score, max_score, passed): 5 points if a reply asks a further model, else 3."""
    used = _any(F.col("content").rlike(r"\bllm_query(?:_batched)?\s*\("))
    return messages.groupBy(by).agg(F.when(used, 5.0).otherwise(3.0).alias("score"), F.lit(5.0).alias("max_score"), used.alias("passed"))


def speed(events: DataFrame, by: str = "model") -> DataFrame:
    """(by, tokens, turns, seconds, tokens_per_second): a report without points: estimated tokens of replies over the time from first to last event."""
    reply = (F.col("event") == "root_message") & (F.col("role") == "assistant")
    seconds = F.max("timestamp") - F.min("timestamp")
    tokens = F.floor(F.coalesce(F.sum(F.when(reply, F.length("content"))), F.lit(0)) / 4).cast("long")
    out = events.groupBy(by).agg(tokens.alias("tokens"), F.count_if(F.col("event") == "turn_start").alias("turns"), seconds.alias("seconds"))
    return out.withColumn("tokens_per_second", F.when(F.col("seconds") > 0, F.round(F.col("tokens") / F.col("seconds"), 1)).otherwise(0.0))


def report_page(scores: DataFrame, totals: DataFrame, day: str, profile: str = "default", by: str = "model") -> DataFrame:
    """(by, page): a Markdown report of each model's check, with a head between --- lines. ``scores`` has by, probe, score, max_score, passed; ``totals`` by, score, verdict."""
    line = F.format_string("### %s — %s/%s (%s)\n", F.col("probe"), F.col("score").cast("string"), F.col("max_score").cast("string"), F.when(F.col("passed"), "PASS").otherwise("FAIL"))
    parts = scores.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("probe", line.alias("line")))), lambda x: x["line"]), "\n").alias("parts"), F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n"))
    head = F.format_string("---\nmodel: %s\nscore: %s\nverdict: %s\nweights: " + profile + "\ndate: " + day + "\n---\n# Model Suitability Report: %s\n\n", F.col(by), F.col("total").cast("string"), F.col("verdict"), F.col(by))
    body = F.format_string("**Score:** %s/100\n**Verdict:** %s\n**Probes:** %d/%d passed\n\n## Per-Probe Results\n\n", F.col("total").cast("string"), F.col("verdict"), F.col("n_passed"), F.col("n"))
    return parts.join(totals.withColumnRenamed("score", "total"), by).select(by, F.concat(head, body, "parts").alias("page"))


def missing_submission(messages: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, code): why a submission's text never became an answer; no row where no message holds it.

    ``messages`` has content and, for messages whose block ran, raised,
    rebound (the answer was no mapping at the end) and inconsistent (ready, but
    nothing recorded). A block that ran tells more than text beside it.
    """
    content = F.col("content")
    blocks = F.array_join(F.regexp_extract_all(content, F.lit(RUNNABLE), F.lit(1)), "\n")
    others = F.array_join(F.regexp_extract_all(content, F.lit(OTHER_FENCE), F.lit(1)), "\n")
    plain = F.regexp_replace(blocks, r"#[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''", "")
    rows = messages.where(content.rlike(SUBMISSION)).select(
        run, blocks.rlike(SUBMISSION).alias("ran"), plain.rlike(SUBMISSION).alias("statement"), others.rlike(SUBMISSION).alias("other"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("raised", "rebound", "inconsistent")],
    )
    c = F.col
    tests = (
        c("ran") & ~c("statement"), c("ran") & c("raised"), c("ran") & c("rebound"), c("ran") & c("inconsistent"), c("ran"), c("other"), F.lit(True),
    )
    rank = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])
    best = rows.groupBy(run).agg(F.min(rank).alias("rank"))
    return best.select(run, F.get(F.array(*map(F.lit, MISSING)), F.col("rank")).alias("code"))


def off_question(searches: DataFrame, question: str = "question", query: str = "query", band: str = "band") -> DataFrame:
    """(shares, band, n): searches by whether their query shares a term with the question, and by their best band."""
    shared = F.size(F.array_intersect(text.content_terms(F.col(question)), text.content_terms(F.col(query)))) > 0
    return searches.groupBy(shared.alias("shares"), F.col(band).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def passages(addresses: DataFrame, sources: DataFrame, most: int = 4096) -> DataFrame:
    """(address, text): the bytes that addresses name, ``most`` at most, from rows (source, content)."""
    parts = addresses.select("address", text.address_parts(F.col("address")).alias("p")).where("p.source IS NOT NULL").select("address", "p.*")
    return search.read_chunks(parts, sources, "source", "content", most).select("address", "text")


def run_page(facts: DataFrame) -> DataFrame:
    """(run_id, page): a Markdown page of each run's facts."""
    head = F.format_string("# Run %s\n\n- turns: %s\n- searches: %s\n- guardrails: %s\n- ended: %s\n", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("run_id", "turns", "searches", "guardrails", "ended")])
    return facts.select("run_id", F.concat(head, F.when(F.col("final_answer").isNotNull(), F.concat(F.lit("\n## Answer\n\n"), "final_answer", F.lit("\n"))).otherwise("")).alias("page"))
