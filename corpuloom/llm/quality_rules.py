"""Quality rules by distribution divergence.

A document's histogram over character classes and its histogram over common
words are compared with references of each language by Jensen-Shannon
distance. References are sums over all documents that pass the base rules
and are long enough, by language; a document is held against every reference
and takes the nearest, so its own language label decides nothing as long as that
language has a reference. A text of another language, or of none that is told, is
held against the nearest reference too, but by classes alone, in which all
letters are one and with a wider cut: its words are no one's common words, and
its script may be none of the references'. Too short texts are not judged by
divergence: their histograms say little.

:func:`judge` reads texts once: counts and histograms are written to the shared
folder, some 500 bytes a document, and references and verdicts come from them.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, documents, drop_table, materialise

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Words below which a text is not held against common-word references, and characters for the classes.
GUARD_WORDS, GUARD_CHARS = 50, 200
#: Largest Jensen-Shannon distances (base 2, 0 to 1) to the nearest reference.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.45
#: Largest distance over classes with all letters as one, for languages without a reference.
MAX_MERGED_DISTANCE = 0.35
#: Reference documents from which a language has a reference, whatever the size of the table, and most references: those of most documents.
MIN_DOCS, MAX_REFERENCES = 10, 256
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Common words of English, French, German and Spanish.
COMMON = sorted(
    set(
        "the of and a to in is it that was for on with as be by at this are from or an not have had but "
        "le la les de des du un une et est en que qui dans pour sur avec au ne pas par plus ce se il elle "
        "der die das und ist ein eine den dem des zu von mit auf für nicht im als auch es an sich er sie "
        "el los las y o un una del en por con para se su al lo como más pero no es que de".split()
    )
)
_PLACE = {w: i for i, w in enumerate(COMMON)}
#: Lower and upper ASCII letters, digits, white space, punctuation of prose, marks of markup and code, other letters and symbols.
CLASSES = ("lower", "upper", "digit", "space", "prose", "mark", "control", "other")
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:32] = 6
_CLASS[127] = 6
for _k, _chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits, " \t\n\r\v\f", ".,;:'\"-()?!", "")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[[ord(c) for c in string.punctuation if c not in ".,;:'\"-()?!"]] = 5
_TRIM = string.punctuation + "«»„“”’…¿¡"


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words covered by ``window``-word windows that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
        keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    view = np.lib.stride_tricks.sliding_window_view(ids, window)
    pairs = np.flatnonzero(same)
    twice = np.zeros(n, bool)
    if (view[order[pairs]] == view[order[pairs + 1]]).all():
        twice[order[pairs]] = twice[order[pairs + 1]] = True
    else:  # two windows share a key but not their words
        _, place, count = np.unique(view, axis=0, return_inverse=True, return_counts=True)
        twice = count[place.ravel()] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, list[str]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words) of a text; null counts as empty."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeat_words(words), words


def base_failed(n_words, n_repeat):
    """Whether the base rules reject a text of so many words, or each of several texts."""
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def histograms(text: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters by class (bytes beyond ASCII by their first byte), and of words by common word, all others last."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    raw[0x80:0xC0] = 0
    classes = np.bincount(_CLASS, raw, len(CLASSES))
    common = np.zeros(len(COMMON) + 1)
    for w in words:
        common[_PLACE.get(w.lower().strip(_TRIM), -1)] += 1
    return classes, common


def distance(p: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the base-2 divergence) of a histogram, or of each of several, to each row of ``references``."""
    p = (p / p.sum(axis=-1, keepdims=True))[..., None, :]
    q = references / references.sum(axis=1, keepdims=True)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Columns of what is counted of a text: its counts, characters, and both histograms as 32-bit numbers.
_HELD = {**dict.fromkeys((*_COUNTS, "n_chars"), ("long", pa.int64())), "classes": ("binary", pa.binary()), "common": ("binary", pa.binary())}
_PREFIX = "__rules_"


def _held(texts: pa.Array) -> list[pa.Array]:
    """The columns of :data:`_HELD` of some texts."""
    rows = []
    for text in texts:
        text = text.as_py() or ""
        *counts, words = base_counts(text)
        rows.append((*counts, len(text), *(h.astype("<i4").tobytes() for h in histograms(text, words))))
    return [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _HELD.values(), strict=True)]


def counted(docs: DataFrame, text_col: str, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of every row, and what the rules need of its text, written to the shared folder."""
    columns = [docs[c] for c in carried] + [docs[text_col].alias(f"{_PREFIX}text")]
    kept = docs.select(*columns)
    schema = StructType([*kept.schema.fields[:-1], *StructType.fromDDL(", ".join(f"{_PREFIX}{n} {t}" for n, (t, _) in _HELD.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], *_held(part.column(len(carried)))], schema.names)

    return materialise(kept.mapInArrow(run, schema), "counts")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Counts, characters and both histograms of a batch of counted rows."""
    held = {n: batch.column(batch.schema.get_field_index(_PREFIX + n)) for n in _HELD}
    counts = np.array([held[n].to_numpy(zero_copy_only=False) for n in _COUNTS])
    classes, common = (np.frombuffer(b"".join(held[n].to_pylist()), "<i4").reshape(batch.num_rows, -1).astype(float) for n in ("classes", "common"))
    return counts, held["n_chars"].to_numpy(zero_copy_only=False), classes, common


def merged(classes: np.ndarray) -> np.ndarray:
    """Histograms over classes with lower, upper and other letters as one."""
    return np.concatenate([classes[..., [0, 1, 7]].sum(axis=-1, keepdims=True), classes[..., 2:7]], axis=-1)


class Judge:
    """Holds documents against the references; ``classes`` and ``common`` have one row for each of ``langs``."""

    def __init__(self, classes: np.ndarray, common: np.ndarray, langs: list[str | None]):
        self.classes, self.common, self.langs = classes, common, frozenset(langs)

    def distances(self, text: str, words: list[str], known: bool = True) -> tuple[float | None, float | None]:
        """Distance to the nearest reference by classes and by common words; null where a guard or an empty reference set forbids it, and by words where the language isn't ``known``."""
        if not len(self.classes):
            return None, None
        classes, common = histograms(text, words)
        if not known:
            return (float(distance(merged(classes), merged(self.classes)).min()) if classes.sum() >= GUARD_CHARS else None), None
        by_class = distance(classes, self.classes) if classes.sum() >= GUARD_CHARS else None
        by_word = distance(common, self.common) if len(words) >= GUARD_WORDS else None
        return (None if by_class is None else float(by_class.min())), (None if by_word is None else float(by_word.min()))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Judge:
    """Sums of the histograms of all documents that pass the base rules and both guards, by language."""
    rows = counted(docs.withColumn(_PREFIX + "lang", docs[lang_col].cast("string")), text_col, [_PREFIX + "lang"])
    found = judge_of(rows, _PREFIX + "lang")
    drop_table(rows)
    return found


def judge_of(rows: DataFrame, lang_col: str) -> Judge:
    """The references of counted rows.

    Every language of :data:`MIN_DOCS` documents that pass the base rules and
    both guards has one, if its classes are near those of all such documents
    together, so that junk under a label of its own is no reference. What
    reaches the driver is one row of counts for each of :data:`MAX_REFERENCES`
    languages at most and one for all, added up before. A null language counts
    as one more language.
    """
    size = 1 + len(CLASSES) + len(COMMON) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, chars, classes, common = _columns(batch)
            n_words, n_repeat = counts[0], counts[4]
            good = np.flatnonzero(~base_failed(n_words, n_repeat) & (n_words >= GUARD_WORDS) & (chars >= GUARD_CHARS))
            langs = batch.column(0).to_pylist()
            # each document weighs alike, in millionths: whole numbers add up alike in any order
            weights = [np.rint(h[good] / t[:, None] * 1e6) for h, t in ((classes, classes[good].sum(axis=1)), (common, n_words[good]))]
            table = np.concatenate([np.ones((len(good), 1)), *weights], axis=1).astype(np.int64)
            for i, row in zip(good.tolist(), table, strict=True):
                sums[langs[i]] = sums[langs[i]] + row if langs[i] in sums else row
        for lang, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(range(size), pa.int32()), pa.array(row)], ["lang", "place", "n"])

    sums = rows.select(F.col(lang_col).cast("string"), *[F.col(_PREFIX + n) for n in _HELD]).mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.max(F.when(F.col("place") == 0, F.col("n"))).alias("docs"), F.array_sort(F.collect_list(F.struct("place", "n"))).alias("counts"))
    top = rows.where(F.col("docs") >= MIN_DOCS).orderBy(F.desc("docs"), F.asc_nulls_last("lang")).limit(MAX_REFERENCES).collect()
    top.sort(key=lambda r: (-r["docs"], r["lang"] is not None, r["lang"] or ""))
    whole = dict(sums.groupBy("place").agg(F.sum("n")).collect())
    every = merged(np.array([whole.get(i, 0) for i in range(1, 1 + len(CLASSES))], float))[None, :]
    table = np.array([[c["n"] for c in r["counts"]] for r in top], float).reshape(-1, size)
    near = [i for i in range(len(top)) if distance(merged(table[i, 1 : 1 + len(CLASSES)]), every)[0] <= MAX_MERGED_DISTANCE]
    table = table[near]
    return Judge(table[:, 1 : 1 + len(CLASSES)], table[:, 1 + len(CLASSES) :], [top[i]["lang"] for i in near])


def verdicts(by: Judge, batch: pa.RecordBatch, langs: list[str | None]) -> list[pa.Array]:
    """Counts, decisions and distances of a batch of counted rows."""
    counts, _, classes, common = _columns(batch)
    n_words, n_repeat = counts[0], counts[4]
    known = np.array([lang in by.langs for lang in langs], bool)
    failed = base_failed(n_words, n_repeat)
    kept = ~failed
    long = classes.sum(axis=1) >= GUARD_CHARS
    steps = [(classes, by.classes, known & long, MAX_CLASS_DISTANCE, 0), (merged(classes), merged(by.classes), ~known & long, MAX_MERGED_DISTANCE, 0), (common, by.common, known & (n_words >= GUARD_WORDS), MAX_WORD_DISTANCE, 1)]
    found = np.full((2, batch.num_rows), np.nan)
    for h, reference, judged, most, column in steps:
        some = np.flatnonzero(judged) if len(by.classes) else []
        for at in range(0, len(some), 64):  # 64 rows against MAX_REFERENCES references at a time
            part = some[at : at + 64]
            found[column, part] = distance(h[part], reference).min(axis=1)
            kept[part] &= found[column, part] <= most
    told = [pa.array(far, pa.float64(), mask=np.isnan(far)) for far in found]
    return [*(pa.array(c) for c in counts), pa.array(failed), pa.array(kept), *told]


def verdict(judge: Judge, text: str | None, *lang: str | None) -> tuple:
    """The counts, decisions and distances of a text; a language that is given and has no reference is judged as such."""
    n_words, word_chars, n_symbols, n_dup, n_repeat, words = base_counts(text)
    failed, known = base_failed(n_words, n_repeat), judge.langs.issuperset(lang)
    by_class, by_word = judge.distances(text or "", words, known)
    kept = not failed and (by_class is None or by_class <= (MAX_CLASS_DISTANCE if known else MAX_MERGED_DISTANCE)) and (by_word is None or by_word <= MAX_WORD_DISTANCE)
    return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, kept, by_class, by_word


_NAMES = [*_COUNTS, "base_failed", "kept", "class_distance", "word_distance"]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", judge_by: Judge | None = None) -> DataFrame:
    """(id_col, counts, base_failed, kept, class_distance, word_distance) of every row's whole text.

    Null and empty texts have no words and fail the base rules. Texts under
    the guards, and all texts where there is no reference at all, have null
    distances and are kept if the base rules pass. A language without a
    reference has no word distance, and its class distance is over classes with
    all letters as one. Repeated rows and null ids yield one row each; other columns are not
    carried.
    """
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = counted(kept, "text", ["lang", "id"])
    by = judge_by or judge_of(rows, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                yield pa.RecordBatch.from_arrays([part.column(1), *verdicts(by, part, part.column(0).to_pylist())], ["id", *_NAMES])

    kind = kept.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in _COUNTS) + ", base_failed boolean, kept boolean, class_distance double, word_distance double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, without a shuffle.

    Texts are read twice, once for the references and once for the verdicts: to
    keep them beside their counts would write the whole table once more.
    """
    by, text, lang = references(docs, text_col, lang_col), docs.columns.index(text_col), docs.columns.index(lang_col)
    names = [_PREFIX + n for n in _HELD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                kept = verdicts(by, pa.RecordBatch.from_arrays(_held(part.column(text)), names), part.column(lang).cast(pa.string()).to_pylist())[6]
                yield part.filter(kept)

    return docs.mapInArrow(run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(documents(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})
