"""Similarity joins: strings one edit apart, nearest codes, alike titles.

Strings one edit apart share a variant with one character left out; the nearest
codes are found in a trie whose branches have bounds; titles meet in blocks,
where two bounds on their likeness leave few pairs to compare.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edit


def variants(s: Column) -> Column:
    """Hashes of a string and of the string without each of its characters. A string of n characters has n + 1 and costs n * n bytes of hashing."""
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.left(s, i - 1), F.substr(s, i + 1)))
    return F.array_distinct(F.transform(F.concat(F.array(s), shorter), lambda v: F.xxhash64(v)))


def one_edit_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, a, b): pairs of strings of equal keys that one insertion, deletion, substitution or swap of neighbours turns into each other.

    Such strings share a variant: after an insertion or deletion the shorter is
    the longer without a character, and a substitution or swap leaves equal
    strings when the right character of each is left out. Candidates are an
    equi-join on the keys and the variants' hashes, each pair once; the edit is
    checked on the strings. Repeated rows count once, nulls never pair, and
    strings that share a variant are at most as many as one variant has
    extensions, whatever the tables hold.
    """
    one = left.select(*keys, a).where(F.col(a).isNotNull()).distinct().withColumn("__variant", F.explode(variants(F.col(a))))
    two = right.select(*keys, b).where(F.col(b).isNotNull()).distinct().withColumn("__variant", F.explode(variants(F.col(b))))
    met = one.join(two, [*keys, "__variant"]).where(F.abs(F.length(a) - F.length(b)) <= 1).select(*keys, a, b).distinct()
    return met.where(edit.one_edit(F.col(a), F.col(b)))


class Trie:
    """Codes by their prefixes, a level for each length, to find the nearest ones of a spelling.

    A branch has the row of edit distances of its prefix to all prefixes of the
    spelling. The least of the row bounds all codes below from below, as rows
    never fall; the row's last plus what the longest code still has bounds them from
    above. A branch whose lower bound passes the ``k``-th least upper bound
    (of codes, each of its own), or the ``k``-th least distance of the codes beside
    the spelling, has none of the ``k`` nearest.
    """

    def __init__(self, codes: list[str]) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, list[tuple[int, str]], np.ndarray]] = []  # letters, parents, codes that end here by node, the longest below
        nodes, at = [""], sorted(set(codes))
        for depth in range(max(map(len, at), default=0) + 1):
            place = {p: i for i, p in enumerate(nodes)}
            ends = [(place[c], c) for c in at if len(c) == depth]
            longest = np.zeros(len(nodes), int)
            for c in at:
                if len(c) >= depth:
                    longest[place[c[:depth]]] = max(longest[place[c[:depth]]], len(c) - depth)
            above = {p: i for i, p in enumerate(self._last)} if depth else {}
            self.levels.append((np.array([ord(p[-1]) if p else 0 for p in nodes]), np.array([above[p[:-1]] if depth else 0 for p in nodes]), ends, longest))
            self._last, nodes = nodes, sorted({c[: depth + 1] for c in at if len(c) > depth})
        self.codes, self.visited = at, 0

    @staticmethod
    def _distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, out = i, [i]
            for j, y in enumerate(b, 1):
                left = min(row[j] + 1, left + 1, row[j - 1] + (x != y))
                out.append(left)
            row = out
        return row[-1]

    def nearest(self, word: str, k: int) -> list[str]:
        """The ``k`` codes of least edit distance, ties in their order."""
        chars = np.array([ord(c) for c in word], int)
        steps = np.arange(len(chars) + 1)
        alive, rows = np.array([0]), steps[None, :]
        found: list[tuple[int, str]] = []
        at = bisect(self.codes, word)
        close = sorted(self._distance(word, c) for c in self.codes[max(0, at - 2 * k) : at + 2 * k])  # a first bound from those beside it
        first = close[k - 1] if len(close) >= k else len(word) + len(self.levels)
        for depth, (letters, parents, ends, longest) in enumerate(self.levels):
            if depth:
                old = np.full(len(self.levels[depth - 1][0]), -1)
                old[alive] = np.arange(len(alive))
                alive = np.flatnonzero(old[parents] >= 0)
                above = rows[old[parents[alive]]]
                # the row of a prefix from its parent's: a change or a letter more, then letters less from the left
                rows = np.minimum(above + 1, np.concatenate([above[:, :1] + 1, above[:, :-1] + (chars[None, :] != letters[alive][:, None])], axis=1))
                rows = np.minimum.accumulate(rows - steps, axis=1) + steps
            self.visited += len(alive)
            place = {n: i for i, n in enumerate(alive.tolist())}
            found.extend((int(rows[place[n], -1]), c) for n, c in ends if n in place)
            found = sorted(found)[:k]
            above_all = np.sort(np.concatenate([rows[:, -1] + longest[alive], [d for d, _ in found]]))  # a branch has one code at least
            if len(above_all) >= k:
                first = min(first, above_all[k - 1])
            keep = rows.min(axis=1) <= first
            alive, rows = alive[keep], rows[keep]
            if not len(alive):
                break
        return [c for _, c in found]


def nearest(words: DataFrame, col: str, codes: list[str], k: int) -> DataFrame:
    """The rows of ``words`` with ``near``: the ``k`` codes nearest to each. The codes are broadcast: the caller bounds them."""
    shared = words.sparkSession.sparkContext.broadcast(codes)
    place = words.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie | None = None
        for batch in batches:
            trie = trie or Trie(shared.value)
            near = pa.array([trie.nearest(w or "", k) for w in batch.column(place).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], [*batch.schema.names, "near"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(run, f"{schema}, near array<string>")


# --- Titles

#: Letters of European prose, the commonest first; all others are rarer.
_COMMON = " etaonirshdlucmfywgpbvk"


def rarest(title: str, threshold: float) -> list[str]:
    """The letters of a title, each with the number of its occurrence, that a title alike to it must share one of.

    Of titles of n and m letters, ratio <= 2 * common / (n + m), common being
    the letters that both hold, with repeats. At ``threshold`` t, common >=
    t / (2 - t) * n whatever m is, so in any one order of all letters the two
    share one of the first n - ceil(t / (2 - t) * n) + 1 of each.
    """
    seen: Counter = Counter()
    own = []
    for c in title:
        seen[c] += 1
        place = _COMMON.find(c)
        own.append((-seen[c] * log(30 if place < 0 else 6 + place), c, seen[c]))
    need = ceil(threshold / (2 - threshold) * len(own) - 1e-9)
    return [f"{c}{k}" for _, c, k in sorted(own)[: len(own) - need + 1]]


def alike(newer: str, older: str, threshold: float) -> bool:
    """Whether difflib's ratio of two titles reaches the threshold; its upper bounds are asked first."""
    if newer == older:
        return threshold <= 1
    m = SequenceMatcher(None, newer, older)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


#: Titles of a block, letters of a title that are compared bit by bit, and the commonest letters and (letter, occurrence) pairs that have columns of their own.
SIDE, BITS, LETTERS, COLUMNS = 2048, 64, 255, 1024


class _Titles:
    """What bounds the likeness of titles from above: which letters each has, with repeats, and where.

    Letters and pairs beyond the commonest have no column: a pair without one
    counts as shared as often as both titles have such, and letters without one
    count as equal, so no bound falls below the likeness.
    """

    def __init__(self, titles: list[str]) -> None:
        count = Counter(c for t in titles for c in t[:BITS])
        own = {c: i for i, (c, _) in enumerate(count.most_common(LETTERS))}
        self.lens = np.array([len(t) for t in titles], np.int64)
        self.codes = np.full((len(titles), BITS), LETTERS + 1, np.int64)  # the last is past the end and equals nothing
        self.masks = np.zeros((len(titles), LETTERS + 2), np.uint64)
        pairs = []
        for i, t in enumerate(titles):
            at = [own.get(c, LETTERS) for c in t[:BITS]]
            self.codes[i, : len(at)] = at
            np.bitwise_or.at(self.masks[i], at, np.uint64(1) << np.arange(len(at), dtype=np.uint64))
            pairs.append([(c, k) for c, n in Counter(t).items() for k in range(n)])
        place = {x: i for i, (x, _) in enumerate(Counter(x for p in pairs for x in p).most_common(COLUMNS))}
        self.has = np.zeros((len(titles), len(place)), np.float32)
        for i, p in enumerate(pairs):
            self.has[i, [place[x] for x in p if x in place]] = 1
        self.rest = self.lens - self.has.sum(1).astype(np.int64)

    def least(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Letters that alike titles have in common: ratio is twice these by both lengths."""
        return np.ceil(threshold * (self.lens[a] + self.lens[b]) / 2 - 1e-9)

    def share(self, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of ``a`` and ``b`` whose letters may suffice, whatever their order."""
        met = self.has[a] @ self.has[b].T + np.minimum(self.rest[a][:, None], self.rest[b][None, :])
        x, y = np.nonzero(met >= self.least(a[:, None], b[None, :], threshold))
        return a[x], b[y]

    def follow(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs' letters may suffice in their order: difflib's matching blocks are a common subsequence.

        Its length comes from one step a letter of b with a bit a letter of a,
        and letters from the 65th on count as common. Pairs that what is
        left of b can't save are dropped on the way.
        """
        past = np.maximum(self.lens - BITS, 0)
        need = self.least(a, b, threshold) - past[a] - past[b]
        alive, v = np.arange(len(a)), np.full(len(a), ~np.uint64(0))
        most = int(min(BITS, self.lens[b].max(initial=0)))
        for i in range(most):
            u = v & self.masks[a[alive], self.codes[b[alive], i]]
            v = (v + u) | (v - u)
            if i % 8 == 7 or i == most - 1:
                left = np.maximum(np.minimum(self.lens[b[alive]], BITS) - i - 1, 0)
                good = np.bitwise_count(~v) + left >= need[alive]
                alive, v = alive[good], v[good]
        return alive if most else alive[need <= 0]


def alike_pairs(titles: DataFrame, by: str, threshold: float) -> DataFrame:
    """(by, older, newer): pairs of distinct titles (by, title, place) of a group whose likeness, the newer first, reaches ``threshold``; ``place`` counts from the newest.

    Titles of a few dozen letters share some of their rarest with nearly all
    others, so a join on letters keeps nearly all pairs. Blocks of :data:`SIDE`
    titles meet instead, each pair of blocks in a task's memory: two bounds
    (:class:`_Titles`) leave few pairs for difflib. The pairs that are bounded
    grow with the square of a group's distinct titles.
    """
    kind = titles.schema[by].dataType.simpleString()
    rows = titles.select(F.col(by).alias("g"), "title", "place", F.floor(F.col("place") / SIDE).cast("long").alias("block"))
    last = rows.groupBy(F.col("g").alias("h")).agg(F.max("block").alias("last"))
    met = rows.join(last, F.col("g").eqNullSafe(F.col("h"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    keys = ["g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    n = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or few bytes of much work would be put together
    met = met.select(*keys, "title", "place", "block").repartition(n, "g", "i", "j")

    def check(part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        said, place, block = part.column("title").to_pylist(), part.column("place").to_numpy(), part.column("block").to_numpy()
        all_ = _Titles(said)
        one, two = (np.flatnonzero(block == part.column(c)[0].as_py()) for c in ("i", "j"))
        found: list[tuple[int, int]] = []
        for at in range(0, len(one), 256):
            a, b = all_.share(one[at : at + 256], two, threshold)
            a, b = a[a < b], b[a < b]
            good = all_.follow(a, b, threshold)
            found.extend((p, q) for p, q in zip(a[good].tolist(), b[good].tolist(), strict=True) if alike(said[p], said[q], threshold))
        older, newer = ([int(place[f[k]]) for f in found] for k in (1, 0))
        return pa.table({"g": part.column("g").take(pa.array([0] * len(found), pa.int64())), "older": pa.array(older, pa.int64()), "newer": pa.array(newer, pa.int64())})

    return met.groupBy("g", "i", "j").applyInArrow(check, f"g {kind}, older long, newer long").select(F.col("g").alias(by), "older", "newer")
