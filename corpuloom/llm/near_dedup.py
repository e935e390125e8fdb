"""MinHash near-duplicate detection with b-bit signatures.

1. Every distinct text gives its exact number of shingles, ``BANDS`` bucket
   hashes of ``ROWS`` minima each, and the low ``BITS`` bits of all minima,
   packed into 64-bit words. Exact copies share one class from here on.
2. Members of a bucket are paired with one leader of it (another one in every
   band), never with each other; a bucket of any size gives one pair a member.
3. The packed signatures estimate the similarity by bit counts, corrected for
   chance agreement; pairs far below the threshold go. The margin is seven
   standard deviations of the estimate.
4. Pairs left are confirmed on full shingle sets, and links joined to
   components.
5. No link is lost because a leader was no neighbour. Classes joined by close
   signatures form a neighbourhood; members of a bucket that lie in different
   ones are held against each other, in blocks, and join theirs if their
   signatures are close. Where a neighbourhood holds several components, their
   members are held against each other in blocks too: by signatures, and those
   that are close to one of another component by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_table, groups, materialise, text_key
from .components import components

BANDS, ROWS, BITS = 36, 5, 2
#: A pair is confirmed if its estimate is at most this far below the threshold.
MARGIN = 0.25
#: Members of a block of a neighbourhood that is searched across its components.
BLOCK = 256
_SIZE = BANDS * ROWS
_WORDS = -(-_SIZE * BITS // 64)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 63, _SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, _SIZE, dtype=np.uint64)
_LANES = np.uint64(sum(1 << i for i in range(0, 64, BITS)))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: bytes.lower and bytes.split know ASCII only, as the definition asks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """Distinct ``k``-word shingles; the whole sequence as one if there are fewer words; empty without words."""
    words = words_of(text)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C3
    return h ^ (h >> np.uint64(29))


def signature(text: str | None, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of distinct shingles, bucket hashes, packed low bits of the minima); no buckets without words."""
    words = words_of(text)
    if not words:
        return 0, np.empty(0, np.int64), np.zeros(_WORDS, np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[ids]
    size = min(k, len(words))
    n = len(words) - size + 1
    codes, own = ids[:n], hashes[:n] * _C1
    for j in range(1, size):
        if j > 1:
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * len(known) + ids[j : j + n]
        own = (_mix(own) ^ hashes[j : j + n]) * _C2
    first = np.unique(codes, return_index=True)[1]
    own = _mix(own[first] + np.uint64(size))
    minima = np.full(_SIZE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        np.minimum(minima, (own[at : at + 2048, None] * _MUL + _ADD).min(axis=0), out=minima)
    buckets = np.arange(BANDS, dtype=np.uint64) * _C1
    rows = minima.reshape(BANDS, ROWS)
    for j in range(ROWS):
        buckets = _mix((buckets ^ rows[:, j]) * _C2)
    low = _mix(minima) & np.uint64((1 << BITS) - 1)
    packed = np.zeros(_WORDS * (64 // BITS), np.uint64)
    packed[:_SIZE] = low
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return len(first), buckets.view(np.int64), np.bitwise_or.reduce(packed.reshape(_WORDS, -1) << shifts, axis=1).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: agreement of the minima's low bits, corrected for chance."""
    lanes = F.lit(sum(1 << i for i in range(0, 62, BITS)))  # the sign bit's lane is 62: added below
    differ = F.lit(0)
    for i in range(_WORDS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(any_bit.bitwiseAND(lanes)) + F.bit_count(F.shiftrightunsigned(any_bit, 62).bitwiseAND(F.lit(1)))
    chance = 1 / (1 << BITS)
    return ((1 - differ / _SIZE) - chance) / (1 - chance)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [signature(t.as_py(), k) for t in part.column(2)]

                def lists(i: int) -> pa.ListArray:
                    ends = np.cumsum([0, *(len(x[i]) for x in found)])
                    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x[i] for x in found])))

                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[0] for x in found], pa.int64()), lists(1), lists(2)], ["id", "key", "n", "buckets", "bits"])

    return docs.mapInArrow(run, "id long, key binary, n long, buckets array<long>, bits array<long>")


def _sizes(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can overlap enough at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _close(bits: np.ndarray, i: int, others: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` whose size and signature are near enough to i's."""
    others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
    x = bits[others] ^ bits[i]
    share = 1 - np.bitwise_count((x | (x >> np.uint64(1))) & _LANES).sum(axis=1) / _SIZE
    chance = 1 / (1 << BITS)
    return others[(share - chance) / (1 - chance) >= percent / 100 - MARGIN]


def _candidates(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): rows of a task's two blocks (or one) with other labels whose signatures are close, each pair once."""
    labels, n, side = (table.column(c).to_numpy() for c in ("label", "n", "side"))
    bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, _WORDS)
    one = table.column("within")[0].as_py() == 1
    left = np.arange(len(n)) if one else np.flatnonzero(side == 0)
    order = left if one else np.flatnonzero(side == 1)
    for i in left.tolist():
        others = order[order > i] if one else order
        others = _close(bits, i, others[labels[others] != labels[i]], n, percent)
        if len(others):
            yield i, others


def _union(labels: list[int]):
    """(root, join) of a union-find over the labels."""
    top = {x: x for x in labels}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def join(a: int, b: int) -> None:
        top[root(a)] = root(b)

    return root, join


def _met(tables: Iterator[pa.Table], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of labels that close signatures join, as far as they were apart in the task."""
    for table in tables:
        labels = table.column("label").to_pylist()
        root, join = _union(labels)
        for i, others in _candidates(table, percent):
            for j in others.tolist():
                if root(labels[i]) != root(labels[j]):
                    join(labels[i], labels[j])
                    yield labels[i], labels[j]


def _linked(tables: Iterator[pa.Table], k: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links between two blocks of a neighbourhood (or within one), as far as they join what was apart."""
    for table in tables:
        cids, labels, n, texts, sets = table.column("cid").to_pylist(), table.column("label").to_pylist(), table.column("n").to_pylist(), table.column("text"), {}
        root, join = _union(labels)
        for i, others in _candidates(table, percent):
            for j in others.tolist():
                if root(labels[i]) == root(labels[j]):
                    continue
                for q in (i, j):
                    if q not in sets:
                        sets[q] = shingle_set(texts[q].as_py(), k)
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (n[i] + n[j] - both):
                    join(labels[i], labels[j])
                    yield cids[i], cids[j]


_TASK = ["group", "within", "i", "j"]


def _dealt(state: DataFrame) -> DataFrame:
    """``state`` (group, label, cid, n, bits) dealt into tasks (within, i, j) of two blocks, or one, with the side that a row is on.

    Every member of a group meets every member of another label, in blocks of
    about ``BLOCK`` members; the largest label of a group doesn't meet itself.
    """
    sizes = state.groupBy("group", "label").count()
    shape = sizes.groupBy("group").agg(F.count(F.lit(1)).alias("parts"), F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n_all"))
    blocks = [F.ceil(F.col("n_main") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int").alias("rests")]
    state = state.join(shape.where("parts > 1").select("group", "main", *blocks), "group")
    main = F.col("label") == F.col("main")
    state = state.withColumn("own", F.pmod(F.xxhash64("cid"), F.when(main, F.col("mains")).otherwise(F.col("rests"))).cast("int"))

    def task(within, i, j, side):
        return F.struct(within.alias("within"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))

    no, yes = F.lit(0), F.lit(1)  # within: 0 between the largest label and the rest, 1 within a block of the rest, 2 between two of them
    to_rest = F.transform(F.sequence(no, F.col("rests") - 1), lambda j: task(no, F.col("own"), j, 0))
    to_main = F.transform(F.sequence(no, F.col("mains") - 1), lambda j: task(no, j, F.col("own"), 1))

    def other(j):
        i = F.col("own")
        first = task(F.lit(2), i, j, 0)
        return F.when(j == i, task(yes, i, i, 0)).when(i < j, first).otherwise(task(F.lit(2), j, i, 1))

    to_others = F.transform(F.sequence(no, F.col("rests") - 1), other)
    rows = state.select("group", F.explode(F.when(main, to_rest).otherwise(F.concat(to_main, to_others))).alias("task"), "cid", "label", "n", "bits")
    return rows.select("group", "task.within", "task.i", "task.j", "task.side", "cid", "label", "n", "bits")


def _tasks(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or few bytes of much work would be put together
    return rows.repartition(n, *_TASK).sortWithinPartitions(*_TASK, "cid")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _across(shared: DataFrame, near: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of neighbourhoods that close signatures in one bucket join.

    Small buckets are joined with themselves, which makes at most ``BLOCK``
    rows a member; larger ones are searched in blocks.
    """
    placed = shared.join(near, shared["cid"] == near["node"], "left").select("bucket", "cid", F.coalesce("label", "cid").alias("label"))
    open_ = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    side = materialise(placed.join(open_.select("bucket", "size"), "bucket").join(classes.select("cid", "bits", "n"), "cid"), "open")
    small = side.where(F.col("size") <= BLOCK)
    x, y = small.alias("x"), small.alias("y")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") < F.col("y.label")) & _sizes(F.col("x.n"), F.col("y.n"), percent)
    apart &= estimate(F.col("x.bits"), F.col("y.bits")) >= percent / 100 - MARGIN
    few = x.join(y, apart).select(F.col("x.label").alias("a"), F.col("y.label").alias("b"))
    large = side.where(F.col("size") > BLOCK).select(F.col("bucket").alias("group"), "label", "cid", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _pairs(list(_met(groups(batches, _TASK), percent)))

    found = materialise(few.union(_tasks(_dealt(large)).mapInArrow(run, "a long, b long")).distinct(), "across")
    drop_table(side)
    return found


def _within(near: DataFrame, parts: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components that lie in one neighbourhood (of classes joined by close signatures).

    Blocks of members are compared by their signatures first; texts go only to
    those tasks in which a member is close to one of another component. A task
    gives the links that join what was apart, never pairs.
    """
    state = near.select(F.col("node").alias("cid"), F.col("label").alias("group")).join(parts.select(F.col("node").alias("cid"), "label"), "cid", "left")
    state = state.withColumn("label", F.coalesce("label", "cid")).join(classes.select("cid", "n", "bits"), "cid")
    rows = _tasks(_dealt(state))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, _TASK):
            some = np.zeros(table.num_rows, bool)
            for i, others in _candidates(table, percent):
                some[i] = some[others] = True
            yield from table.filter(pa.array(some)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _pairs(list(_linked(groups(batches, _TASK), k, percent)))

    survivors = rows.mapInArrow(close, rows.schema).join(texts, "cid").select(*rows.columns, "text")
    return _tasks(survivors).mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            kept = []
            for i, (a, left, right) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if a != last:
                    last, own = a, shingle_set(left.as_py(), k)
                other = shingle_set(right.as_py(), k)
                both = len(own & other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("right"))
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("left"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("id"), text_key(docs[text_col]).alias("key"), docs[text_col].alias("text"))


def find_classes(rows: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, n, id, cid) of every distinct text, id being the smallest of its rows; and (node, label) of the classes that links join."""
    signed = _signatures(rows, k).groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("bits").alias("bits"))
    classes = materialise(signed.withColumn("cid", F.monotonically_increasing_id()), "classes")

    members = classes.select("cid", F.explode("buckets").alias("bucket"))
    mask = F.col("bucket").bitwiseAND(F.lit((1 << 62) - 1))  # another order of the classes in every bucket
    leaders = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("cid").bitwiseXOR(mask)).alias("least"))
    # written first, so that the join reads plain shuffles on both sides, and large partitions may be split
    leaders = materialise(leaders.where("size > 1").select("bucket", F.col("least").bitwiseXOR(mask).alias("leader")), "leaders")
    shared = materialise(members.join(leaders, "bucket").select("bucket", "cid", "leader"), "buckets")

    bits = classes.select("cid", "bits", "n")
    least = percent / 100 - MARGIN

    def close(pairs: DataFrame) -> DataFrame:
        left = bits.select(F.col("cid").alias("a"), F.col("bits").alias("left"), F.col("n").alias("n_left"))
        right = bits.select(F.col("cid").alias("b"), F.col("bits").alias("right"), F.col("n").alias("n_right"))
        return pairs.join(left, "a").join(right, "b").where(estimate(F.col("left"), F.col("right")) >= least).select("a", "b", "n_left", "n_right")

    stars = shared.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    stars = materialise(close(stars), "stars")

    wanted = shared.select("cid").distinct().join(classes.select("cid", "key", F.col("id").alias("own")), "cid")
    texts = rows.join(wanted, (rows["key"] == wanted["key"]) & rows["id"].eqNullSafe(wanted["own"])).select("cid", "text")
    texts = materialise(texts.dropDuplicates(["cid"]), "texts")  # one row a class, though a row may be repeated

    links = materialise(_confirm(stars.where(_sizes(F.col("n_left"), F.col("n_right"), percent)), texts, k, percent), "links")
    parts = components(links)

    near = components(stars)
    across = _across(shared, near, classes, percent)
    if across.limit(1).count():
        more = components(across).withColumnRenamed("label", "joined")
        # a class that was no neighbour of any leader is a neighbourhood of its own
        near = near.union(more.select("node", "node")).distinct()
        near = near.join(more.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("joined", "label").alias("label"))
    found = materialise(_within(near, parts, classes, texts, k, percent), "links")
    if found.limit(1).count():
        parts = components(links.union(found))
    drop_table(texts)

    return classes.select("cid", "id", "key", "n"), parts


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row.

    Two texts are linked if 100 * shared >= ``percent`` * united distinct
    ``k``-word shingles. ``component_id`` is the smallest id that a row reaches
    by links, itself included. Null, empty and wordless texts have no shingles
    and are linked with nothing, not even each other. Rows that share an id and
    text are one document to each other; a null id is never the smallest unless
    a component has no other. Other columns are not carried. An empty table
    gives no rows.
    """
    rows = _keyed(docs, id_col, text_col)
    ids, parts = find_classes(rows, k, percent)
    lowest = parts.join(ids.select("cid", "id"), parts["node"] == F.col("cid"))
    lowest = lowest.select("cid", "label", "id").join(lowest.groupBy("label").agg(F.min("id").alias("lowest")), "label").select("cid", "lowest")
    found = ids.join(lowest, "cid", "left").select("key", "n", F.coalesce("lowest", "id").alias("lowest"))
    out = rows.select("id", "key").join(found, "key")
    component = F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates, with all their columns.

    The row with the smallest id of a group stays (a null id only where there
    is no other; of several texts under the smallest id, the one of the least
    content key). Null, empty and wordless texts are no group and stay, but
    rows that repeat an id and a text are one document and stay once.
    """
    ids, parts = find_classes(_keyed(docs, id_col, text_col), k, percent)
    placed = ids.join(parts, ids["cid"] == parts["node"], "left")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = placed.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("first")).select(F.col("first.key").alias("key"))
    linked = placed.where("label IS NOT NULL").join(first, "key", "left_semi")
    winners = linked.select("key", "id").union(placed.where("label IS NULL AND n > 0").select("key", "id"))

    def name(id_: Column) -> Column:
        return F.coalesce(id_.cast("long").cast("string"), F.lit("null"))

    # by content and id, so that a crowd of copies is dealt over all tasks
    winners = winners.select(F.col("key").alias("__own"), name(F.col("id")).alias("__id"), F.lit(True).alias("__won"))
    keyed = docs.withColumn("__own", text_key(docs[text_col])).withColumn("__id", name(docs[id_col]))
    wordless = ~F.coalesce(docs[text_col], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    joined = keyed.withColumn("__wordless", wordless).join(winners, ["__own", "__id"], "left").where("__won OR __wordless")
    once = F.row_number().over(Window.partitionBy("__own", "__id").orderBy(F.lit(0)))
    return joined.withColumn("__once", once).where("__once = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=2, percent=80)
