"""Operators over raw contexts: lines, slices, grep, chunks, and mapped queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def lines(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, line_no, byte_start, byte_end, line): lines between newlines with their byte ranges, the newline outside; a carriage return before it is dropped from the text."""
    own = docs.select(key, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("all"))
    # starts: running bytes of the lines before, each with its newline
    starts = F.aggregate(
        "all", F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.octet_length(x) + 1)
    )
    rows = own.select(key, F.posexplode(F.arrays_zip(F.col("all").alias("line"), F.slice(starts, 1, F.size("all")).alias("byte_start"))).alias("line_no", "x"))
    out = rows.select(key, "line_no", F.col("x.byte_start"), (F.col("x.byte_start") + F.octet_length("x.line")).alias("byte_end"), F.regexp_replace("x.line", r"\r$", "").alias("line"))
    return out


def numbered(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, line_no, line) without byte ranges: one generated expression."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line_no", "line"))


def line_range(docs: DataFrame, key: str, text_col: str, start: int, count: int) -> DataFrame:
    """``count`` lines from line ``start`` (from 0) of every text."""
    picked = F.slice(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), start + 1, count)
    return docs.select(key, F.posexplode(picked).alias("at", "line")).select(key, (F.col("at") + start).alias("line_no"), "line")


def grep(docs: DataFrame, key: str, text_col: str, pattern: str, most: int = 50) -> DataFrame:
    """The first ``most`` lines of each text that match a regular expression, in order."""
    found = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: F.rlike(x["line"], F.lit(pattern)))
    return docs.select(key, F.explode(F.slice(found, 1, most)).alias("x")).select(key, "x.line_no", "x.line")


def byte_slice(docs: DataFrame, key: str, text_col: str, start: int, stop: int) -> DataFrame:
    """(key, bytes, text): bytes ``start`` to ``stop``; the text is null where they cut a character."""
    part = F.substring(F.col(text_col).cast("binary"), start + 1, stop - start)
    return docs.select(key, part.alias("bytes"), F.try_validate_utf8(part.cast("string")).alias("text"))


def paragraphs(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    return docs.select(key, F.posexplode(text.paragraphs(F.coalesce(F.col(text_col), F.lit("")))).alias("place", "paragraph"))


def pieces(docs: DataFrame, key: str, text_col: str, size: int = 3000) -> DataFrame:
    return docs.select(key, F.posexplode(text.fixed_chunks(F.coalesce(F.col(text_col), F.lit("")), size)).alias("place", "piece"))


def map_query(items: DataFrame, template: str, model: Callable[[list[str]], list[str]], item_col: str = "text") -> DataFrame:
    """``items`` with ``answer``: the model asked once for each distinct prompt, in batches, and joined back.

    ``{text}`` in the template stands for the item. A batch that fails gives
    its prompts the error's text, and the others their answers.
    """
    prompts = items.withColumn("prompt", F.replace(F.lit(template), F.lit("{text}"), F.coalesce(F.col(item_col), F.lit(""))))
    keyed = prompts.withColumn("prompt_key", F.sha2(F.col("prompt").cast("binary"), 256))

    def ask(frames):
        for frame in frames:
            try:
                answers = model(frame["prompt"].tolist())
            except Exception as error:  # the model is the caller's: what it raises is an answer here
                answers = [f"[error: {error}]"] * len(frame)
            yield pd.DataFrame({"prompt_key": frame["prompt_key"], "answer": answers})

    once = keyed.select("prompt_key", "prompt").dropDuplicates(["prompt_key"])
    return keyed.join(once.mapInPandas(ask, "prompt_key string, answer string"), "prompt_key", "left").drop("prompt_key", "prompt")


def call_warnings(chars: Column, budget: int, context_chars: Column, fraction: float) -> Column:
    """What a call is warned of: oversize beyond ``budget`` characters, shortcut where a prompt holds more than ``fraction`` of the whole context (none if either is 0)."""
    shortcut = (context_chars > 0) & F.lit(fraction > 0) & (chars / F.nullif(context_chars, F.lit(0)) > fraction)
    return F.array_compact(F.array(F.when(chars > budget, "oversize"), F.when(F.coalesce(shortcut, F.lit(False)), "shortcut")))


def budgeted(calls: DataFrame, by: str, order: str, chars: str, most_calls: int, most_chars: int) -> DataFrame:
    """Adds ``accepted``: calls in order while the count and characters of those accepted stay within budget; a rejected call uses none of it."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        n = used = 0
        out = []
        for size in group[chars].fillna(0).tolist():
            ok = n < most_calls and used + size <= most_chars
            n, used = n + ok, used + size * ok
            out.append(bool(ok))
        return group.assign(accepted=out)

    kept = calls.select(by, order, chars)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", accepted boolean"
    return kept.groupBy(by).applyInPandas(fold, schema)
