"""Aliases of addresses: minting, resolving misspellings, rewriting text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edit
from . import nearjoin

CANDIDATES = 3


class Exhausted(RuntimeError):
    """There are more addresses than free codes."""


def mint(addresses: DataFrame, taken: DataFrame | None = None, seed: str = "") -> DataFrame:
    """(address, alias) of every distinct address; those of ``taken`` keep theirs.

    New ones get the free codes in an order given by ``seed``: the next free
    number of a fixed walk through the code space. A session holds at most
    93,750 aliases, so a session's table is small and numbering it needs one
    small window. Addresses beyond the free codes raise :class:`Exhausted`
    before any is numbered.
    """
    fresh = addresses.select("address").distinct()
    old, free = None, edit.CODES
    if taken is not None:
        old = taken.select("address", "alias")
        fresh = fresh.join(old, "address", "left_anti")
        free -= old.where(edit.checks(F.col("alias"))).select("alias").distinct().count()
    if fresh.limit(free + 1).count() > free:
        raise Exhausted(f"the alias space is exhausted: {free} of {edit.CODES} codes are free")
    order = Window.orderBy(F.md5(F.concat_ws("|", "address", F.lit(seed)).cast("binary")))
    numbered = fresh.withColumn("n", F.row_number().over(order) - 1)
    spark = addresses.sparkSession
    codes = spark.range(edit.CODES).select(F.pmod(F.col("id") * 48271 + 11, F.lit(edit.CODES)).alias("walk"), "id")
    codes = codes.select("id", edit.body_of(F.col("walk")).alias("body")).withColumn("alias", F.concat("body", F.lit("-"), edit.check_symbol(F.col("body"))))
    if old is not None:
        codes = codes.join(old.select("alias"), "alias", "left_anti")
    left = codes.withColumn("n", F.row_number().over(Window.orderBy("id")) - 1)
    minted = numbered.join(left, "n").select("address", "alias")
    return minted if old is None else old.unionByName(minted)


def resolve(written: DataFrame, table: DataFrame) -> DataFrame:
    """(written, status, alias, address, candidates): what each spelling means.

    The first that holds: exact, normalised, folded (look-alike glyphs, its
    check symbol verified), repaired (one live alias is one edit away),
    ambiguous (several are), unknown with the nearest three.

    Each rung is a join by equal keys: the spelling itself, its normal form, its
    folds, and its variants with a character left out. What no rung meets is
    held against a trie of all live aliases. A session's table is bounded by its
    code space: more than 93,750 rows are refused, so it may be broadcast.
    """
    live = table.select(F.col("alias").alias("live"), F.col("address").alias("at")).where(F.col("live").isNotNull())
    if live.limit(edit.CODES + 1).count() > edit.CODES:
        raise ValueError(f"more than {edit.CODES} live aliases")
    shared = F.broadcast(live)
    asked = written.select("written").distinct().withColumn("trimmed", F.trim(F.coalesce("written", F.lit("")))).withColumn("normal", edit.normalise_alias(F.col("trimmed")))
    asked = asked.withColumn("folds", F.filter(edit.folded_aliases(F.col("normal")), lambda v: edit.checks(v)))
    some = asked.where(F.col("trimmed") != "")
    spelt = some.select("written", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("trimmed").alias("key")), F.struct(F.lit(1).alias("rank"), F.col("normal").alias("key")))).alias("k")).select("written", "k.*")
    spelt = spelt.union(some.select("written", F.lit(2), F.explode("folds")))
    met = spelt.join(shared, F.col("key") == F.col("live")).select("written", "rank", "live", "at")
    bent = nearjoin.one_edit_pairs(some, shared, [], "normal", "live").join(some.select("written", "normal"), "normal")
    met = met.unionByName(bent.join(shared, "live").select("written", F.lit(3).alias("rank"), "live", "at"))
    met = met.groupBy("written", "live", "at").agg(F.min("rank").alias("rank"))  # a pair's first rung
    place = F.row_number().over(Window.partitionBy("written").orderBy("rank", "live", "at"))
    edits = F.count_if(F.col("rank") == 3).over(Window.partitionBy("written"))
    top = met.withColumn("edits", edits).withColumn("place", place).where(F.col("place") <= CANDIDATES)
    best = top.groupBy("written").agg(
        F.min(F.struct("rank", "live", "at")).alias("best"), F.max("edits").alias("edits"),
        F.array_sort(F.collect_list(F.when(F.col("rank") == 3, F.struct("place", "live")))).alias("near"),
    )
    status = (
        F.when(F.col("best.rank") == 0, "exact").when(F.col("best.rank") == 1, "normalised").when(F.col("best.rank") == 2, "folded")
        .when(F.col("edits") == 1, "repaired").otherwise("ambiguous")
    )
    told = best.withColumn("status", status)
    sure = F.col("status") != "ambiguous"
    told = told.select("written", "status", F.when(sure, F.col("best.live")).alias("alias"), F.when(sure, F.col("best.at")).alias("address"), F.when(~sure, F.transform("near", lambda x: x["live"])).alias("candidates"))
    lost = asked.join(told, "written", "left_anti")
    codes = [r["live"] for r in live.select("live").distinct().collect()]  # bounded above
    lost = nearjoin.nearest(lost.where(F.col("written").isNotNull()).select("written", F.when(F.col("trimmed") != "", F.col("normal")).alias("normal")), "normal", codes, CANDIDATES)
    lost = lost.select("written", F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("alias"), F.lit(None).cast("string").alias("address"), F.when(F.col("normal").isNotNull(), F.col("near")).otherwise(F.array().cast("array<string>")).alias("candidates"))
    blank = asked.where(F.col("written").isNull()).select("written", F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("alias"), F.lit(None).cast("string").alias("address"), F.array().cast("array<string>").alias("candidates"))
    return told.unionByName(lost).unionByName(blank)


def substitute(texts: DataFrame, table: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, text, repairs): aliases in each text replaced by their addresses; what was repaired.

    A text is cut at its alias tokens, the tokens are resolved once each, and
    the pieces joined again in order; tokens that mean nothing certain stay.
    """
    upper = F.upper(F.col(text_col))
    found = F.regexp_extract_all(upper, F.lit(f"({edit.TOKEN})"), F.lit(1))
    gaps = F.split(upper, edit.TOKEN, -1)
    cut = texts.select(F.col(key).alias("k"), F.col(text_col).alias("whole"), found.alias("found"), gaps.alias("gaps"))
    tokens = cut.select(F.explode(F.array_distinct("found")).alias("written"))
    meant = resolve(tokens, table).select("written", "status", "address")
    known = cut.select("k", F.explode(F.array_distinct("found")).alias("written")).join(meant, "written").where("address IS NOT NULL")
    maps = known.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("written", "address"))).alias("means"), F.array_sort(F.collect_list(F.when(F.col("status") == "repaired", F.struct("written", "address")))).alias("repairs"))
    joined = cut.join(maps, "k", "left")
    places = F.sequence(F.lit(0), F.size("gaps") - 1)

    def step(acc, i):
        gap, token = F.length(F.get("gaps", i)), F.get("found", i)
        kept = F.substring(F.col("whole"), acc["at"], gap)
        spelt = F.substring(F.col("whole"), acc["at"] + gap, F.coalesce(F.length(token), F.lit(0)))
        said = F.coalesce(F.try_element_at("means", token), spelt)
        return F.struct((acc["at"] + gap + F.coalesce(F.length(token), F.lit(0))).alias("at"), F.concat(acc["out"], kept, said).alias("out"))

    done = F.aggregate(places, F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])
    return joined.select(F.col("k").alias(key), F.when(F.size("found") > 0, done).otherwise(F.col("whole")).alias("text"), F.coalesce("repairs", F.array().cast("array<struct<written:string,address:string>>")).alias("repairs"))
