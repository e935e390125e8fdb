"""Analytics over trajectories: run facts, served and cited evidence, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import nearjoin


def run_facts(events: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, turns, searches, guardrails, first_helper_turn, ended): one row a run; a missing end is told, not guessed."""
    kind = F.col("event")
    return events.groupBy(run).agg(
        F.max("turn").alias("turns"),
        F.count_if(kind == "corpus_served").alias("searches"),
        F.count_if(kind == "guardrail").alias("guardrails"),
        F.min(F.when((kind == "repl_result") & (F.col("turn") > 0), F.col("turn"))).alias("first_helper_turn"),
        F.coalesce(F.max(kind == "end"), F.lit(False)).alias("ended"),
        F.max_by("final_answer", F.when(kind == "end", F.col("timestamp"))).alias("final_answer"),
    )


def messages(events: DataFrame, role: str = "assistant") -> DataFrame:
    """Root messages of a role."""
    return events.where((F.col("event") == "root_message") & (F.col("role") == role))


def results(events: DataFrame) -> DataFrame:
    """What cells that ran gave."""
    return events.where(F.col("event") == "repl_result")


def searches(events: DataFrame) -> DataFrame:
    return events.where(F.col("event") == "corpus_served")


def guardrails(events: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, guardrail, n): guardrails by name; citations recorded, repaired and weak are such."""
    return events.where(F.col("event") == "guardrail").groupBy(run, "guardrail").agg(F.count(F.lit(1)).alias("n"))


def bands(events: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, band, n): addresses served by their band; without one, none is told."""
    rows = searches(events).select(run, F.explode("addresses").alias("a"))
    return rows.groupBy(run, F.coalesce("a.band", F.lit("untold")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def search_quality(events: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, turn, query, strong, partial, weak, none): how many hits of each search have each band."""
    count = lambda b: F.size(F.filter(F.coalesce("addresses", F.array().cast(events.schema["addresses"].dataType)), lambda a: a["band"] == b))
    return searches(events).select(run, "turn", "query", *[count(b).alias(b) for b in ("strong", "partial", "weak", "none")])


def served(events: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, address, band): every address served to a run with its strongest band; an address without bands has none."""
    rows = events.where(F.col("event") == "corpus_served").select(run, F.explode("addresses").alias("a")).select(run, "a.address", "a.band")
    return rows.groupBy(run, "address").agg(F.min_by("band", F.when(F.col("band").isNotNull(), text.band_rank(F.col("band")))).alias("band"))


def cited(answers: DataFrame, run: str = "run_id", text_col: str = "final_answer") -> DataFrame:
    """(run, address) of every address in an answer, once."""
    return answers.select(run, F.explode(text.addresses(F.col(text_col))).alias("address")).distinct()


def audit(served_rows: DataFrame, cited_rows: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, answering, non_answering, unserved, unknown, left): each citation by what served it.

    Where nothing was served to a run, its citations are unknown, not
    fabricated. A citation served without a band is non-answering.
    """
    any_served = served_rows.select(run).distinct().withColumn("any", F.lit(True))
    bands = served_rows.select(run, "address", F.col("band"), F.lit(True).alias("was"))
    rows = cited_rows.join(bands, [run, "address"], "left").join(any_served, run, "left")
    told = (
        F.when(F.col("any").isNull(), "unknown").when(F.col("was").isNull(), "unserved")
        .when(F.col("band").isin("strong", "partial"), "answering").otherwise("non_answering")
    )
    names = ("answering", "non_answering", "unserved", "unknown")
    by = rows.withColumn("told", told).groupBy(run).agg(*[F.array_sort(F.collect_list(F.when(F.col("told") == n, F.col("address")))).alias(n) for n in names])
    left = served_rows.join(cited_rows, [run, "address"], "left_anti").groupBy(run).agg(F.array_sort(F.collect_list("address")).alias("left"))
    return by.join(left, run, "full")


def corruption(served_rows: DataFrame, cited_rows: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, cited, meant): cited addresses that no search served and that are one edit from exactly one served address."""
    lost = cited_rows.join(served_rows, [run, "address"], "left_anti").withColumnRenamed("address", "cited")
    near = nearjoin.one_edit_pairs(lost, served_rows.select(run, F.col("address").alias("meant")), [run], "cited", "meant")
    return near.groupBy(run, "cited").agg(F.count(F.lit(1)).alias("n"), F.min("meant").alias("meant")).where("n = 1").drop("n")


def usage(served_rows: DataFrame, cited_rows: DataFrame) -> DataFrame:
    """(source, served, cited, class) of every document, the most cited first, then the most served, then by name."""
    source = F.regexp_replace("address", r"#L\d+-\d+$", "")
    a = served_rows.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("served"))
    b = cited_rows.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("cited"))
    both = a.join(b, "source", "full").select("source", F.coalesce("served", F.lit(0)).alias("served"), F.coalesce("cited", F.lit(0)).alias("cited"))
    return both.withColumn("class", text.provenance(F.col("source"))).orderBy(F.desc("cited"), F.desc("served"), "source")


def refusals(audited: DataFrame, answers: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, refusal): unserved, weak (only non-answering evidence), uncited, or null."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    rule = (
        F.when(count("unserved") > 0, "unserved").when((count("non_answering") > 0) & (count("answering") == 0), "weak")
        .when(count("answering") + count("non_answering") + count("unknown") == 0, "uncited")
    )
    return answers.select(run).join(audited, run, "left").select(run, rule.alias("refusal"))


def islands(rows: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """(by, island, length, first): runs of consecutive rows with a true flag."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w))
    return marked.where(F.col(flag)).groupBy(by, "island").agg(F.count(F.lit(1)).alias("length"), F.min(order).alias("first"))


def recovered(cells: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, failed, recovered): whether a clean cell stands in a strictly later turn than the first failed one."""
    first = cells.groupBy(run).agg(F.min(F.when(F.col("failed"), F.col("turn"))).alias("first"))
    later = cells.join(first, run).groupBy(run, "first").agg(F.coalesce(F.max(~F.col("failed") & (F.col("turn") > F.col("first"))), F.lit(False)).alias("recovered"))
    return later.select(run, F.col("first").isNotNull().alias("failed"), "recovered")


def retention(files: DataFrame, keep: int = 50, by: str | None = None, order: str = "mtime", name: str = "name") -> DataFrame:
    """Files beyond the newest ``keep`` (of each ``by``, if named). Without a key only the newest are ranked, ``keep`` rows; files alike in time and name to the last of these are kept with it."""
    from pyspark.sql import Window

    if by is not None:
        w = Window.partitionBy(by).orderBy(F.desc(order), name)
        return files.withColumn("place", F.row_number().over(w)).where(F.col("place") > keep).drop("place")
    newest = files.select(order, name).orderBy(F.desc(order), name).limit(keep).collect()
    if len(newest) < keep:
        return files.limit(0)
    if not keep:
        return files
    at, last = newest[-1]
    after = F.col(name).isNotNull() if last is None else F.coalesce(F.col(name) > last, F.lit(False))
    beyond = F.col(order).isNull() & after if at is None else F.col(order).isNull() | (F.col(order) < at) | ((F.col(order) == at) & after)
    return files.where(beyond)


def selected(ranked: DataFrame, limit: int | None = None, cited_only: bool = False) -> DataFrame:
    """Documents of a ranked plan in its order, cited ones only if asked."""
    rows = ranked.where("cited > 0") if cited_only else ranked
    rows = rows.orderBy(F.desc("cited"), F.desc("served"), "source")
    return rows if limit is None else rows.limit(limit)


def plan_histogram(ranked: DataFrame) -> DataFrame:
    """(class, documents, cited): what a plan would describe."""
    return ranked.groupBy("class").agg(F.count(F.lit(1)).alias("documents"), F.sum("cited").alias("cited"))


def cost_range(ranked: DataFrame, least: float, most: float) -> DataFrame:
    """(documents, hours_least, hours_most): what describing a plan's documents would take at seconds a document."""
    n = F.count(F.lit(1))
    return ranked.agg(n.alias("documents"), F.round(n * least / 3600, 2).alias("hours_least"), F.round(n * most / 3600, 2).alias("hours_most"))


def index_page(facts: DataFrame) -> DataFrame:
    """(page): one Markdown page that lists runs by their ids, a line each."""
    line = F.format_string("- [%s](%s.md): %s turns, %s", F.col("run_id").cast("string"), F.col("run_id").cast("string"), F.coalesce(F.col("turns").cast("string"), F.lit("unknown")), F.when(F.col("ended"), "ended").otherwise("not ended"))
    return facts.select("run_id", line.alias("line")).agg(F.concat(F.lit("# Runs\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_id", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("page"))
