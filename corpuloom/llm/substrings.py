"""Suffix-array dedup: repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts
anywhere else. Finding them takes four steps, each a shuffle on a content
hash, so no task sees more than its share:

1. Anchors. Of the strings of two fifths of the length in a window of
   ``length`` bytes the one with the least rolling hash is the window's anchor:
   equal windows have equal anchors at equal places, and at 400 bytes about one
   string in 120 bytes is an anchor. An anchor owns a run of consecutive windows.
2. Anchors whose hash occurs once are dropped: their windows are unique. Where
   all owned stretches under a hash are the same text, all their windows
   repeat. Stretches under one 64-bit hash are compared by their offsets and 64
   bits of MD5, so two different ones pass for equal with odds of 2**-64.
3. What is left are stretches that share an anchor but differ around it: edges
   of passages and edits of near copies. One of each distinct stretch is cut
   into pieces of some windows (48 of 400 bytes) at places given by the anchor,
   and pieces are dealt by a hash of the bytes that all windows of the piece
   share, so that a passage common to any number of documents spreads by what
   surrounds it.
4. In each group the suffixes to the right of the anchor, and the reversed
   prefixes to its left, are sorted by mergesort. Two suffixes are compared by
   the polynomial hashes of their prefixes and binary search for the longest
   common extension, a logarithmic number of steps; all neighbours are then
   verified byte by byte, and a group with a collision is sorted again by its
   bytes. Windows are equal exactly if they lie in one block of either order
   at their lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_table, groups, materialise, text_key

#: Bytes of a string that counts as repeated, unless another length is named.
LENGTH = 400
#: A repeated passage is a run of repeated strings of so many bytes that holds so many words: fifty words of prose have 240 bytes and more.
PASSAGE = (200, 50)
_BASE = 0x5851F42D4C957F2D
_CHUNK = 1 << 19
_RUNS = "array<struct<first: long, last: long>>"
_POW: list[np.ndarray] = []


def anchor_size(length: int) -> int:
    """Bytes of an anchor of a window."""
    return max(1, length * 2 // 5)


def piece_size(length: int) -> int:
    """Windows of a piece."""
    return max(1, length * 3 // 25)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 16)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _POW.append(np.multiply.accumulate(p))
        del _POW[:-2]
    return _POW[0], _POW[1]


class Prefixes:
    """Prefix polynomial hashes of a byte string: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def common_extension(p: Prefixes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common extension of the suffixes at ``a`` and ``b``, ``most`` at most, by binary search on prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    for _ in range(int(high.max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        same = p.of(a, mid) == p.of(b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_sort(p: Prefixes, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings p.data[start : start + length] within each group, and each one's common extension with the one before it (0 for a group's first).

    ``group`` ascends. A bottom-up mergesort in which all elements of a level
    find their rank in the sibling run together; a comparison takes a
    logarithmic number of hash probes. Neighbours are verified on their bytes.
    """
    n = len(start)
    order = np.arange(n)
    first = np.searchsorted(group, group, side="left")
    end = np.searchsorted(group, group, side="right")
    largest = int((end - first).max(initial=0))

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether string x comes before string y; ``ties`` where they are equal."""
        most = np.minimum(length[x], length[y])
        ext = common_extension(p, start[x], start[y], most)
        full = ext >= most
        at = np.where(full, 0, ext)
        last = len(p.data) - 1
        bytes_x, bytes_y = p.data[np.minimum(start[x] + at, last)], p.data[np.minimum(start[y] + at, last)]
        return np.where(full, (length[x] < length[y]) | ((length[x] == length[y]) & ties), bytes_x < bytes_y)

    width = 1
    while width < largest:
        place = np.arange(n)
        run = (place - first) // width
        other = first + (run ^ 1) * width  # the sibling run
        stop = np.minimum(other + width, end)
        todo = np.flatnonzero(other < end)
        low, high = other[todo].copy(), stop[todo].copy()
        left = (run[todo] & 1) == 0
        mine = order[todo]
        active = np.arange(len(todo))
        while len(active):
            mid = (low[active] + high[active]) >> 1
            less = before(order[mid], mine[active], ~left[active])
            low[active] = np.where(less, mid + 1, low[active])
            high[active] = np.where(less, high[active], mid)
            active = active[low[active] < high[active]]
        target = place.copy()
        pair = first[todo] + (run[todo] >> 1) * 2 * width
        own = place[todo] - (first[todo] + run[todo] * width)
        target[todo] = pair + own + (low - other[todo])
        merged = np.empty(n, order.dtype)
        merged[target] = order
        order = merged
        width *= 2

    ext = np.zeros(n, np.int64)
    inner = np.flatnonzero(group[1:] == group[:-1]) + 1
    x, y = order[inner - 1], order[inner]
    ext[inner] = common_extension(p, start[x], start[y], np.minimum(length[x], length[y]))
    bad = set()
    for t, a, b, e in zip(inner.tolist(), x.tolist(), y.tolist(), ext[inner].tolist(), strict=True):
        sa, sb = p.data[start[a] : start[a] + length[a]].tobytes(), p.data[start[b] : start[b] + length[b]].tobytes()
        if sa[:e] != sb[:e] or sa > sb or (e < min(len(sa), len(sb)) and sa[e] == sb[e]):
            bad.add(int(first[t]))
    for f in sorted(bad):  # a hash collision: this group again, by its bytes
        members = sorted(order[f : end[f]].tolist(), key=lambda i: p.data[start[i] : start[i] + length[i]].tobytes())
        order[f : end[f]] = members
        for t in range(f + 1, int(end[f])):
            a, b = (p.data[start[i] : start[i] + length[i]].tobytes() for i in order[t - 1 : t + 1])
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            ext[t] = k
    return order, ext


def anchors(data: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place, first owned window, last owned window) of a text's anchors, in stretches of ``_CHUNK`` windows."""
    anchor = anchor_size(length)
    n, span = len(data) - length + 1, length - anchor + 1
    for at in range(0, max(n, 0), _CHUNK):
        windows = min(_CHUNK, n - at)
        part = data[at : at + windows + length - 1]
        p = Prefixes(part)
        m = len(part) - anchor + 1
        keys = p.of(np.arange(m), np.full(m, anchor))
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
        # hash above place: the least of equal hashes is the leftmost
        packed = (keys & ~np.uint64((1 << 20) - 1)) | np.arange(m, dtype=np.uint64)
        least, width = packed, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: windows], least[span - width : span - width + windows])
        where = (least[:windows] & np.uint64((1 << 20) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        stop = np.concatenate([begin[1:], [windows]]) - 1
        place = where[begin]
        yield keys[place].view(np.int64), place + at, begin + at, stop + at


def _short(data: bytes) -> int:
    return int.from_bytes(hashlib.md5(data).digest()[:8], "little", signed=True)


#: place | windows owned before the anchor's place: first and last offset, in one long
def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (place << 20) | ((place - first) << 10) | (place - last)


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """(key, hash, at, stretch): the anchors of every row's text, or of its regions; at holds place and owned offsets, stretch is the MD5 (64 bits) of the owned bytes."""
    inner = "regions" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            count = 0
            for i, key in enumerate(batch.column(0).to_pylist()):
                raw = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                regions = [(r["from"], r["to"]) for r in batch.column(2)[i].as_py()] if inner else [(0, len(raw))]
                for low, high in regions:
                    for hashes, *where in anchors(np.frombuffer(raw[low:high], np.uint8), length):
                        place, first, last = (x + low for x in where)
                        out[0].extend([key] * len(place))
                        out[1].append(hashes)
                        out[2].append(_pack(place, first, last))
                        out[3].append(np.fromiter((_short(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.int64, len(place)))
                        count += len(place)
                if count > 100_000:
                    yield flushed(out)
                    out, count = [[], [], [], []], 0
            if count:
                yield flushed(out)

    def flushed(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *(pa.array(np.concatenate(x)) for x in out[1:])], ["key", "hash", "at", "stretch"])

    return rows.select("key", "text", *(["regions"] if inner else [])).mapInArrow(run, "key binary, hash long, at long, stretch long")


def _pieces(texts: DataFrame, length: int) -> DataFrame:
    """(deal, hash, stretch, n, piece, bytes): the pieces of the distinct stretches that a text stands for."""
    windows, most = piece_size(length), length - anchor_size(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = (batch.column(0)[k].as_py() or "").encode("utf-8", "surrogatepass")
                out: list[list] = [[] for _ in range(8)]
                for it in batch.column(1)[k].as_py():
                    place, high, low = it["at"] >> 20, (it["at"] >> 10) & 1023, it["at"] & 1023
                    for piece in range(low // windows, high // windows + 1):
                        x, y = min((piece + 1) * windows - 1, most), piece * windows
                        hi, lo = min(high, x), max(low, y)
                        # all windows at offsets y to x before the anchor cover the bytes that the piece is dealt by
                        row = (_short(raw[place - y : place - x + length]), it["hash"], it["stretch"], it["n"], piece, hi, lo, raw[place - hi : place - lo + length])
                        for column, v in zip(out, row, strict=True):
                            column.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["deal", "hash", "stretch", "n", "piece", "hi", "lo", "bytes"])

    return texts.select("text", "items").mapInArrow(run, "deal long, hash long, stretch long, n long, piece int, hi int, lo int, bytes binary")


def repeated_windows(strings: list[bytes], hi: np.ndarray, lo: np.ndarray, n: np.ndarray, group: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each string, the runs (from, to) of offsets o, lo <= o <= hi, whose window is found twice or more in its group.

    A string is the text from ``hi`` bytes before its anchor to ``length`` -
    ``lo`` after it and stands for ``n`` places. ``group`` ascends.
    """
    size = len(strings)
    lens = np.array([len(s) for s in strings])
    starts = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(strings), np.uint8)
    right_order, right_ext = suffix_sort(Prefixes(data), starts + hi, lens - hi, group)
    back = data[::-1].copy()  # the prefix before an anchor, reversed, is a suffix of the reversed text
    left_order, left_ext = suffix_sort(Prefixes(back), len(data) - (starts + hi), hi.astype(np.int64), group)
    right_at, left_at = np.empty(size, np.int64), np.empty(size, np.int64)
    right_at[right_order] = np.arange(size)
    left_at[left_order] = np.arange(size)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    base = int(lo.min(initial=0))
    found = np.zeros((size, int(hi.max(initial=0)) - base + 3), np.int8)
    for o in range(base, int(hi.max(initial=0)) + 1):
        mine = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(mine):
            continue
        right = np.cumsum(new | (right_ext < length - o))[right_at[mine]]
        left = np.cumsum(new | (left_ext < o))[left_at[mine]]
        _, which = np.unique(right * (size + 1) + left, return_inverse=True)
        found[mine, o - base + 1] = np.bincount(which, n[mine])[which] >= 2
    step = np.diff(found, axis=1)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    rise, fall = np.nonzero(step == 1), np.nonzero(step == -1)
    for i, a, b in zip(rise[0].tolist(), rise[1].tolist(), fall[1].tolist(), strict=True):
        runs[i].append((a + base, b + base - 1))
    return runs


def _sorted_groups(pieces: DataFrame, length: int) -> DataFrame:
    """(hash, stretch, first, last): runs of offsets of each distinct stretch whose windows repeat."""
    keys = ["hash", "piece", "deal"]
    rows = pieces.repartition(*keys).sortWithinPartitions(*keys, "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for table in groups(batches, keys):
            if table.num_rows == 1:
                if table.column("n")[0].as_py() < 2:
                    continue
            held.append(table)
            count += table.num_rows
            if count >= 4096:
                yield solved(held)
                held, count = [], 0
        if held:
            yield solved(held)

    def solved(tables: list[pa.Table]) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(tables)), [t.num_rows for t in tables])
        table = pa.concat_tables(tables)
        hi, lo, n = (table.column(c).to_numpy().astype(np.int64) for c in ("hi", "lo", "n"))
        runs = repeated_windows(table.column("bytes").to_pylist(), hi, lo, n, group, length)
        which = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        flat = np.array([x for r in runs for x in r], np.int32).reshape(-1, 2)
        columns = [table.column(c).combine_chunks().take(pa.array(which)) for c in ("hash", "stretch")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["hash", "stretch", "first", "last"])

    return rows.mapInArrow(run, "hash long, stretch long, first int, last int")


def _regions(found: DataFrame, shorter: int, length: int) -> DataFrame:
    """(key, regions array<struct<from, to>>): the bytes in which strings of ``length`` bytes may repeat, as all their strings of ``shorter`` bytes do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column(1).to_pylist():
                starts = spans(runs, 1)  # maximal runs of starts, ends excluded
                out.append([{"from": a, "to": b - 1 + shorter} for a, b in starts if b - 1 + shorter - a >= length])
            kinds = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            some = pa.array([bool(r) for r in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kinds)], ["key", "regions"]).filter(some)

    return found.mapInArrow(run, "key binary, regions array<struct<`from`: long, `to`: long>>")


def repeats(rows: DataFrame, length: int = LENGTH, shorter: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(key, runs array<struct<first long, last long>>) of texts with repeated windows of ``length`` bytes: runs of window starts. ``rows`` has id, key (of the text's content) and text.

    ``shorter`` is what this function gave for a smaller length, and that
    length: only where those strings repeat may longer ones.
    """
    if shorter is not None:
        rows = rows.join(_regions(*shorter, length).withColumnRenamed("key", "known"), F.col("key") == F.col("known")).drop("known")
    if not 8 <= length <= 1600:  # a window's offset from its anchor has 10 bits
        raise ValueError(f"strings of {length} bytes; 8 to 1600 can be found")
    found = materialise(_anchor_rows(rows, length), "stretches")  # written, as it is read twice
    common = found.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    # written first, so that the join reads plain shuffles on both sides, and large partitions may be split
    common = materialise(common.where("c > 1").select("hash", (F.col("low") != F.col("high")).alias("differ")), "common")
    # under another name of the hash, so that the sum doesn't take the join's partitions for its own: it is dealt anew, by text too
    shared = found.join(common, "hash").withColumn("hash", F.col("hash").bitwiseXOR(F.lit(1)))
    places = shared.groupBy("key", "hash", "at", "stretch", "differ").agg(F.count(F.lit(1)).alias("n"))
    places = materialise(places, "anchors")
    drop_table(found)
    drop_table(common)

    place, high, low = F.shiftright("at", 20), F.shiftright("at", 10).bitwiseAND(F.lit(1023)), F.col("at").bitwiseAND(F.lit(1023))
    whole = places.where("NOT differ").select("key", (place - high).alias("first"), (place - low).alias("last"))

    edges = places.where("differ")
    one = edges.groupBy("hash", "stretch").agg(F.sum("n").alias("n"), F.min(F.struct("key", "at")).alias("one"))
    owner = rows.groupBy("key").agg(F.min("id").alias("owner"))
    one = one.select(F.col("one.key").alias("key"), F.struct("hash", "stretch", "n", F.col("one.at").alias("at")).alias("item"))
    wanted = one.groupBy("key").agg(F.collect_list("item").alias("items"))  # of one text: as many as it has anchors
    wanted = wanted.join(owner, "key").withColumnRenamed("key", "wanted")
    texts = rows.join(wanted, (rows["key"] == wanted["wanted"]) & rows["id"].eqNullSafe(wanted["owner"])).dropDuplicates(["key"])
    runs = _sorted_groups(_pieces(texts, length), length)
    inner = edges.join(runs, ["hash", "stretch"]).select("key", (place - F.col("last")).alias("first"), (place - F.col("first")).alias("last"))
    found = whole.union(inner).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # of one text again
    found = materialise(found, "runs")  # so that the join with the texts may split a crowd of copies
    drop_table(places)
    return found


def spans(runs: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes (from, to) of runs of window starts."""
    out: list[list[int]] = []
    for a, b in sorted((r["first"], r["last"] + length) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), text_key(docs[text_col]).alias("key"), docs[text_col].alias("text"))


def cuts(raw: bytes, runs: list[dict] | None, length: int = LENGTH, min_words: int = 0) -> list[tuple[int, int]]:
    """The runs of bytes (from, to) that go: maximal ones of repeated bytes, of ``min_words`` words and parts of words at least."""
    found = spans(runs, length)
    return [(a, b) for a, b in found if len(raw[a:b].split()) >= min_words] if min_words else found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: tuple[int, int] | None = None) -> DataFrame:
    """(id_col, n_bytes, kept binary, removed array<struct<from, to>>, passage_bytes) of every row.

    ``passage`` (bytes, words) asks for shorter repeats too, which are counted
    and not removed: ``passage_bytes`` is how many bytes lie in runs of
    repeated strings of so many bytes that hold so many words; null without it.

    Matches never cross rows. Null and empty texts have no bytes and lose
    none. A row that repeats another's text loses all of it if it has
    ``length`` bytes. Null ids are carried; other columns are not. An empty
    table gives no rows.
    """
    rows = _keyed(docs, id_col, text_col)
    if passage is None:
        found = repeats(rows, length).withColumn("short", F.lit(None).cast(_RUNS))
    else:
        short = repeats(rows, passage[0])
        found = short.withColumnRenamed("runs", "short").join(repeats(rows, length, (short, passage[0])), "key", "left")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, kept, gone, passages = [], [], [], []
                for text, runs, short in zip(part.column(1), part.column(2), part.column(3), strict=True):
                    raw, cut = (text.as_py() or "").encode("utf-8", "surrogatepass"), spans(runs.as_py(), length)
                    edges = [0, *(x for s in cut for x in s), len(raw)]
                    sizes.append(len(raw))
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    gone.append([{"from": a, "to": b} for a, b in cut])
                    passages.append(None if passage is None else sum(b - a for a, b in cuts(raw, short.as_py(), *passage)))
                kinds = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, kinds), pa.array(passages, pa.int64())], ["id", "n_bytes", "kept", "removed", "passage_bytes"])

    joined = rows.join(found, "key", "left").select("id", "text", "runs", "short")
    out = joined.mapInArrow(run, f"id {kind}, n_bytes long, kept binary, removed array<struct<`from`: long, `to`: long>>, passage_bytes long")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, min_words: int = 0) -> DataFrame:
    """The rows of ``docs`` with all their columns, their texts without the repeated bytes.

    Bytes covered by a string of ``length`` bytes that also starts anywhere
    else go, in all their places, if the maximal run that they form holds
    ``min_words`` words at least; what the cut leaves of words at its ends
    counts. Null texts stay null. Where a cut leaves part of a character, that
    part goes too.
    """
    found = repeats(_keyed(docs, id_col, text_col), length).select(F.col("key").alias("__key"), F.col("runs").alias("__runs"))
    joined = docs.withColumn("__own", text_key(docs[text_col])).join(found, F.col("__own") == F.col("__key"), "left")
    place, columns = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            texts = []
            for text, runs in zip(batch.column(place).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                if text and runs:
                    raw = text.encode("utf-8", "surrogatepass")
                    edges = [0, *(x for s in cuts(raw, runs, length, min_words) for x in s), len(raw)]
                    text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore")
                texts.append(text)
            out = [batch.column(i) for i in range(len(columns))]
            out[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(out, columns)

    return joined.select(*[F.col(f"`{c}`") for c in columns], "__runs").mapInArrow(run, docs.schema)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir), passage=PASSAGE)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("passage_bytes").alias("n_passage_bytes"))
