"""Typed pages: index tables, search with filters, delta, links, review life cycle."""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import binary, text
from ..sources.commits import Table
from . import nearjoin, paths, search

# --- Fixed values. Kinds, states, and what a page's head may hold.
KINDS = ("contract", "template", "definition", "helper", "fewshot", "note", "topic", "cache")
STATES = ("active", "deprecated", "superseded", "pending")
NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
HASH = r"^sha256:[a-f0-9]{64}$"
TITLE_MOST, SUMMARY_MOST = 256, 200
SEARCH_FIELDS = ("path", "kind", "name", "title", "summary", "body")
CORE = "memory/notes/core-memory.md"
IMPORTS = ("re", "json", "math", "collections", "itertools", "functools", "hashlib", "pathlib")


def tables(pages: DataFrame) -> dict[str, DataFrame]:
    """pages, links, tags, postings and stats of a table of pages."""
    body = F.concat_ws("\n", *SEARCH_FIELDS)
    postings, stats = search.index(pages.select("path", body.alias("all")), "path", "all")
    return {
        "pages": pages,
        "links": pages.select(F.col("path").alias("src"), F.explode(text.wikilinks(F.col("body"))).alias("dst")),
        "tags": pages.select(F.col("path").alias("page_id"), F.explode(F.array_distinct("tags")).alias("tag")),
        "postings": postings,
        "stats": stats,
    }


def find(index: dict[str, DataFrame], query: str, k: int = 10, kinds: Sequence[str] = (), tags: Sequence[str] = (), states: Sequence[str] = ("active",)) -> DataFrame:
    """The best ``k`` pages by BM25 over any of the query's words, of some kinds, tags and states."""
    keep = index["pages"].where(F.col("status").isin(list(states)))
    if kinds:
        keep = keep.where(F.col("kind").isin(list(kinds)))
    if tags:
        keep = keep.join(index["tags"].where(F.col("tag").isin(list(tags))).select(F.col("page_id").alias("path")), "path", "left_semi")
    scored = search.bm25(index["postings"], index["stats"], search.or_phrases(query), every=False, keep=keep.select(F.col("path").alias("doc")))
    return search.top(scored, k).join(index["pages"], F.col("doc") == F.col("path")).orderBy(F.desc("score"), "path")


def cards(hits: DataFrame, full: bool = False) -> DataFrame:
    base = ["path", "kind", "name", "title", "summary", "score", "status"]
    return hits.select(*base, *(["body", "tags", "version", "hash"] if full else []))


def with_quarantine(hits: DataFrame, quarantined: DataFrame, k: int) -> DataFrame:
    """Hits, then quarantined pages that fill up to ``k``."""
    both = hits.withColumn("rank", F.lit(0)).unionByName(quarantined.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("rank", F.desc("score"), "path").limit(k).drop("rank")


def search_quarantine(pages: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Quarantined pages whose name or body holds the query, newest first."""
    low = F.lower(F.lit(query))
    found = pages.where(F.startswith("path", F.lit("quarantine/")) & (F.contains(F.lower("name"), low) | F.contains(F.lower("body"), low)))
    return (found if kind is None else found.where(F.col("kind") == kind)).orderBy(F.desc("id"))


def listed(pages: DataFrame, prefix: str = "", kind: str | None = None) -> DataFrame:
    """Pages below a prefix by path; quarantine only if the prefix is exactly that."""
    rows = pages.where(F.startswith("path", F.lit(prefix)))
    if prefix != "quarantine":
        rows = rows.where(~F.startswith("path", F.lit("quarantine/")))
    return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy("path")


def delta(indexed: DataFrame, live: DataFrame, state: bool = True) -> DataFrame:
    """(path, change): new, removed or changed pages by hash and id, and by state unless ``state`` is false."""
    keys = ["hash", "id", *(["status"] if state else [])]
    a = indexed.select("path", F.struct(*keys).alias("was"))
    b = live.select("path", F.struct(*keys).alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def backlinks(links: DataFrame, target: str) -> DataFrame:
    return links.where(F.col("dst") == target).select("src").orderBy("src")


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst, path): each link's page by file stem, case ignored, the first by path."""
    stem = F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))
    first = pages.groupBy(stem.alias("stem")).agg(F.min("path").alias("path"))
    return links.join(first, F.lower("dst") == F.col("stem"), "left").select("src", "dst", "path")


@F.pandas_udf(ArrayType(StringType()))
def code_faults(code: pd.Series, name: pd.Series) -> pd.Series:
    """What keeps a helper's code from being taken: read as syntax, never run."""

    def one(source: str | None, wanted: str | None) -> list[str]:
        if not source:
            return ["no implementation"]
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return ["syntax error"]
        out = []
        if not any(isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef) and x.name == wanted for x in tree.body):
            out.append("does not define its name")
        modules = {a.name.split(".")[0] for x in ast.walk(tree) if isinstance(x, ast.Import) for a in x.names}
        modules |= {(x.module or "").split(".")[0] for x in ast.walk(tree) if isinstance(x, ast.ImportFrom)}
        return out + [f"import of {m}" for m in sorted(modules - set(IMPORTS))]

    return pd.Series([one(c, n) for c, n in zip(code, name, strict=True)])


def validate(pages: DataFrame, active: DataFrame) -> DataFrame:
    """(path, errors, warnings) by the rules of each page's kind."""
    c = F.col
    slots = text.slots(c("body"))
    links = pages.where(c("kind").isin("definition", "note")).select("path", F.explode(text.wikilinks(c("body"))).alias("link"))
    lost = links.join(active.select(F.lower("name").alias("taken")), F.lower("link") == F.col("taken"), "left_anti")
    warned = lost.groupBy("path").agg(F.array_sort(F.collect_list(F.concat(F.lit("link to nothing: "), "link"))).alias("warnings"))  # of one page
    rules = [
        (~c("kind").isin(*KINDS), "unknown kind"), (~c("status").isin(*STATES), "unknown status"), (~c("name").rlike(NAME), "bad name"),
        (c("hash").isNotNull() & ~c("hash").rlike(HASH), "bad hash"), (F.length("title") > TITLE_MOST, "long title"), (F.length("summary") > SUMMARY_MOST, "long summary"),
        (F.coalesce(F.trim("body"), F.lit("")) == "", "empty body"),
        (c("kind").isin("contract", "template") & (F.size(slots) != F.size(F.array_distinct(slots))), "slot repeated"),
        ((c("kind") == "helper") & text.section(c("body"), "Signature").isNull(), "no signature"),
        ((c("kind") == "fewshot") & ~c("body").rlike(r"(?i)##\s*question"), "no question"),
    ]
    none = F.array().cast("array<string>")
    code = F.when(c("kind") == "helper", code_faults(text.section(c("body"), "Implementation"), c("name"))).otherwise(none)
    found = F.array_compact(F.array(*[F.when(rule, F.lit(said)) for rule, said in rules]))
    told = pages.select("path", F.concat(found, code).alias("errors"))
    return told.join(warned, "path", "left").withColumn("warnings", F.coalesce("warnings", none))


def content_hash(pages: DataFrame) -> DataFrame:
    return pages.withColumn("hash", binary.page_hash(*[F.col(c) for c in ("kind", "name", "title", "summary", "tags", "body")]))


def propose(pages: DataFrame) -> DataFrame:
    """Pages as quarantine rows: version 0, pending, tagged proposed."""
    place = F.concat(F.lit("quarantine/"), "id", F.lit(".md"))
    return pages.withColumn("path", place).withColumn("status", F.lit("pending")).withColumn("version", F.lit(0)).withColumn("tags", F.array_union("tags", F.array(F.lit("proposed"))))


def promote(proposed: DataFrame, pages: DataFrame, faults: DataFrame, force: bool = False) -> DataFrame:
    """(path, outcome, version, hash): promoted ones take their kind's place with the next version.

    A page with errors is refused; so is one whose place an active page
    holds, and one whose place any other page holds unless forced.
    """
    target = F.concat("kind", F.lit("s/"), "name", F.lit(".md"))
    there = pages.select(F.col("path").alias("target"), F.col("status").alias("held"), F.col("version").alias("prior"))
    rows = content_hash(proposed).withColumn("target", target).join(there, "target", "left").join(faults.select("path", "errors"), "path", "left")
    outcome = (
        F.when(F.size("errors") > 0, "invalid").when(F.col("held") == "active", "occupied")
        .when(F.col("held").isNotNull() & F.lit(not force), "needs force").otherwise("promoted")
    )
    version = F.greatest(F.coalesce("prior", F.lit(0)), F.coalesce("version", F.lit(0))) + 1
    return rows.select("path", "target", outcome.alias("outcome"), F.when(outcome == "promoted", version).alias("version"), "hash")


def reject(pages: DataFrame, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(left, refused): pages without the rejected ones; only pages in quarantine may be, the other paths are refused."""
    asked = F.col("path").isin(list(paths))
    hidden = F.startswith("path", F.lit("quarantine/"))
    return pages.where(~(asked & hidden)), pages.where(asked & ~hidden).select("path")


def demote(pages: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Active pages become deprecated, deprecated ones superseded."""
    lower = F.when(F.col("status") == "active", "deprecated").when(F.col("status") == "deprecated", "superseded").otherwise(F.col("status"))
    return pages.withColumn("status", F.when(F.col("path").isin(list(paths)), lower).otherwise(F.col("status")))


def isolation(index_paths: DataFrame, live: DataFrame) -> DataFrame:
    """(strays, leaked): index paths that no page has, and quarantined ones in the index; both are 0 where all is well."""
    strays = index_paths.join(live.select("path"), "path", "left_anti").agg(F.count(F.lit(1)).alias("strays"))
    return strays.crossJoin(index_paths.where(F.startswith("path", F.lit("quarantine/"))).agg(F.count(F.lit(1)).alias("leaked")))


def new_only(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows (hash, body) that no stored row equals by hash or by trimmed body."""
    trimmed = stored.select(F.trim("body").alias("trimmed")).distinct()
    rows = incoming.join(stored.select("hash").distinct(), "hash", "left_anti").withColumn("trimmed", F.trim("body"))
    return rows.join(trimmed, "trimmed", "left_anti").drop("trimmed")


# --- Memory


def notes(rows: DataFrame) -> DataFrame:
    """Title, summary, keywords and slug of rows with a body."""
    b = F.col("body")
    return rows.select("*", text.title(b).alias("title"), text.summary(b).alias("summary"), text.keywords(b).alias("keywords"), text.slug(text.title(b)).alias("slug"))


def recall(scored: DataFrame, pages: DataFrame, now: float, k: int = 5, pool: int = 4, corrected: bool = False) -> DataFrame:
    """The best ``k`` of a pool of ``pool * k`` hits by relevance and decay.

    Relevance falls as the match gets better (1 / (1 + score)), as the measure
    was defined; ``corrected`` makes it rise (score / (1 + score)).
    """
    wide = search.top(scored, pool * k).join(pages, F.col("doc") == F.col("path"))
    age = F.lit(now) - F.unix_micros(F.coalesce("last_access", "updated", "created")) / 1e6
    relevance = (F.col("score") if corrected else F.lit(1.0)) / (F.lit(1.0) + F.col("score"))
    return wide.withColumn("rank", relevance * text.decay(age, F.col("access_count"))).orderBy(F.desc("rank"), "path").limit(max(1, k))


def with_core(ranked: DataFrame, pages: DataFrame) -> DataFrame:
    """Recalled notes with ``core_memory``, the core page's summary, on the first of them. Both are a few rows."""
    core = pages.where(F.col("path") == CORE).agg(F.max("summary").alias("core"))
    place = F.row_number().over(Window.orderBy(F.desc("rank"), "path"))
    said = F.when(F.col("place") == 1, F.nullif(F.col("core"), F.lit("")))
    return ranked.withColumn("place", place).crossJoin(F.broadcast(core)).withColumn("core_memory", said).drop("core", "place")


def write_core(pages: DataFrame, body: str, now: float) -> DataFrame:
    """``pages`` with the core page written or written over: its version counts up and its day of making stays."""
    b = F.lit(body)
    old = pages.where(F.col("path") == CORE).agg(F.max("version").alias("prior"), F.max("created").alias("born"))
    stamp = F.timestamp_micros(F.lit(int(now * 1e6)))
    said = F.when(text.title(b) == "untitled", "Core Memory").otherwise(text.title(b))
    made = old.select(
        F.lit(CORE).alias("path"), F.lit("note").alias("kind"), F.lit("core-memory").alias("name"), said.alias("title"), text.summary(b).alias("summary"), F.array(F.lit("core"), F.lit("pinned")).alias("tags"),
        F.lit("active").alias("status"), (F.coalesce("prior", F.lit(0)) + 1).alias("version"), F.coalesce("born", stamp).alias("created"), stamp.alias("updated"), F.trim(b).alias("body"),
    )
    return pages.where(F.col("path") != CORE).unionByName(made, allowMissingColumns=True)


def touched(pages: DataFrame, returned: DataFrame, now: float) -> DataFrame:
    """Pages with one more access for the returned ones only."""
    hit = pages.join(returned.select("path").withColumn("hit", F.lit(True)), "path", "left")
    yes = F.coalesce("hit", F.lit(False))
    return hit.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + yes.cast("int")).withColumn("last_access", F.when(yes, F.timestamp_micros(F.lit(int(now * 1e6)))).otherwise(F.col("last_access"))).drop("hit")


def forget(pages: DataFrame, query: str | None = None, older_than: float | None = None, now: float | None = None) -> DataFrame:
    """Pages with notes deprecated that hold the query and are older; never the core page; nothing without a condition."""
    which = F.col("path").startswith("memory/notes/") & (F.col("path") != CORE) & F.lit(query is not None or older_than is not None)
    if query is not None:
        which &= F.contains(F.lower(F.concat_ws("\n", "title", "body")), F.lit(query.lower()))
    if older_than is not None:
        which &= F.col("updated") < F.timestamp_micros(F.lit(int((now - older_than) * 1e6)))
    return pages.withColumn("status", F.when(which, "deprecated").otherwise(F.col("status")))


#: Rounds in which heads are told apart by joins; what is undecided then is folded by its group.
ROUNDS = 12


def clusters(rows: DataFrame, threshold: float = 0.85, by: str = "scope") -> DataFrame:
    """(by, path, keeper): each note with the newest note of its cluster, by likeness of titles.

    Notes are taken newest first (ties by path) and join the first cluster whose
    newest title is alike enough. Only notes whose titles may be alike meet:
    equal titles are one, whose newest note decides for all, and other pairs
    come from :func:`nearjoin.alike_pairs`. A note none of whose newer
    neighbours is a head is one itself; a note with a head among them joins the
    newest such head, once all newer still are decided. That is done in rounds
    of joins, and for what is left after :data:`ROUNDS` of them - long chains
    of titles, each alike to the next - by one task a group, over the
    neighbours that are left alone. A null title is empty.
    """
    title = F.lower(F.coalesce("title", F.lit("")))
    own = rows.select(by, "path", title.alias("title"), F.struct(F.col("updated").isNull().alias("unknown"), (-F.unix_micros("updated")).alias("age"), F.col("path").alias("first")).alias("order"))
    heads = own.groupBy(by, "title").agg(F.min("order").alias("order"))  # of copies of a title the newest note
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("order")).cast("long")).select(by, F.col("order.first").alias("path"), "title", "place")
    heads = paths.written(heads, "titles")
    pairs = paths.written(nearjoin.alike_pairs(heads.select(by, "title", "place"), by, threshold).select(F.col(by).alias("g"), "older", "newer"), "alike")
    # keeper: null while undecided
    older = pairs.select(F.col("g").alias("h"), F.col("older").alias("p")).distinct()
    state = heads.select(F.col(by).alias("g"), "place").join(older, F.col("g").eqNullSafe(F.col("h")) & (F.col("place") == F.col("p")), "left")
    state = state.select("g", "place", F.when(F.col("p").isNull(), F.col("place")).alias("keeper"))
    for _ in range(ROUNDS):
        state = paths.written(state, "clusters")
        if not state.where("keeper IS NULL").limit(1).count():
            break
        of = state.select(F.col("g").alias("h"), F.col("place").alias("p"), F.col("keeper").alias("k"))
        met = pairs.join(of, F.col("g").eqNullSafe(F.col("h")) & (F.col("newer") == F.col("p")))
        head = F.min(F.when(F.col("k") == F.col("p"), F.col("p")))
        told = met.groupBy(F.col("g").alias("h"), F.col("older").alias("p")).agg(head.alias("head"), F.min(F.when(F.col("k").isNull(), F.col("p"))).alias("open"))
        ready = F.when(F.col("open").isNull() | (F.col("head") < F.col("open")), F.coalesce("head", "place"))
        state = state.join(told, F.col("g").eqNullSafe(F.col("h")) & (F.col("place") == F.col("p")), "left").select("g", "place", F.coalesce("keeper", ready).alias("keeper"))
    state = _folded(paths.written(state, "clusters"), pairs)
    kept = state.join(heads.select(F.col(by).alias("h"), F.col("place").alias("p"), "title"), F.col("g").eqNullSafe(F.col("h")) & (F.col("place") == F.col("p"))).select("g", "title", F.col("keeper").alias("k"))
    named = kept.join(heads.select(F.col(by).alias("h"), F.col("place").alias("p"), F.col("path").alias("keeper")), F.col("g").eqNullSafe(F.col("h")) & (F.col("k") == F.col("p"))).select("g", F.col("title").alias("t"), "keeper")
    return own.join(named, F.col(by).eqNullSafe(F.col("g")) & (F.col("title") == F.col("t"))).select(by, "path", "keeper")


def _folded(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """Decides what rounds left open, a group at a time."""
    if not state.where("keeper IS NULL").limit(1).count():
        return state
    kind = state.schema["g"].dataType.simpleString()
    of = state.select(F.col("g").alias("h"), F.col("place").alias("p"), F.col("keeper").alias("k"))
    left = state.where("keeper IS NULL").join(pairs, (F.col("place") == F.col("older")) & state["g"].eqNullSafe(pairs["g"])).select(state["g"], "older", "newer")
    left = left.join(of, F.col("g").eqNullSafe(F.col("h")) & (F.col("newer") == F.col("p"))).select("g", "older", "newer", "k")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        keeper: dict[int, int] = {}
        for older, near in group.sort_values(["older", "newer"]).groupby("older"):
            found = next((n for n, k in zip(near["newer"], near["k"], strict=True) if (keeper.get(n, n) if pd.isna(k) else k) == n), older)
            keeper[older] = found
        return pd.DataFrame({"g": [group["g"].iloc[0]] * len(keeper), "place": list(keeper), "told": list(keeper.values())})

    told = left.groupBy("g").applyInPandas(fold, f"g {kind}, place long, told long").select(F.col("g").alias("h"), F.col("place").alias("p"), "told")
    return state.join(told, F.col("g").eqNullSafe(F.col("h")) & (F.col("place") == F.col("p")), "left").select("g", "place", F.coalesce("keeper", "told").alias("keeper"))


def compact(rows: DataFrame, clustered: DataFrame) -> DataFrame:
    """(path, body, absorbed): keepers with the bodies of what they absorb, newest first."""
    merged = clustered.where("path <> keeper").join(rows.select("path", "body", "updated"), "path")
    merged = merged.groupBy("keeper").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("updated")).alias("age"), "path", "body"))).alias("parts"))
    joined = rows.select(F.col("path").alias("keeper"), F.col("body").alias("own")).join(merged, "keeper")
    bodies = F.transform("parts", lambda p: p["body"])
    return joined.select(F.col("keeper").alias("path"), F.concat_ws("\n\n---\n\n", "own", bodies).alias("body"), F.transform("parts", lambda p: p["path"]).alias("absorbed"))


def helpers(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, name, signature, implementation, summary) of active helper pages by path."""
    rows = pages.where("kind = 'helper' AND status = 'active'").orderBy("path")
    rows = rows if limit is None else rows.limit(limit)
    return rows.select("path", "name", text.section(F.col("body"), "Signature").alias("signature"), text.section(F.col("body"), "Implementation").alias("implementation"), "summary")


def described(rows: DataFrame, model_summaries: DataFrame | None = None) -> DataFrame:
    """Notes with a model's summary and keywords where there are any (path, said, words), and the text's own else."""
    own = notes(rows)
    if model_summaries is None:
        return own
    both = own.join(model_summaries, "path", "left")
    return both.withColumn("summary", F.coalesce(F.nullif(F.trim("said"), F.lit("")), F.col("summary"))).withColumn("keywords", F.coalesce("words", F.col("keywords"))).drop("said", "words")


def migrate(pages: Table, content: str = "content") -> tuple[int, int]:
    """Renames the old key in the heads of a committed table of pages: (version, pages changed). Pages that can't be read otherwise are reached too; without one to change there is no commit."""
    new = pages.read().withColumn("__new", text.migrated_head(F.col(content))).where(F.col("__new") != F.col(content))
    if not new.limit(1).count():
        return pages.log.latest(), 0
    version = pages.upsert(new.drop(content).withColumnRenamed("__new", content), unique=True)
    return version, pages.own(version).count()
