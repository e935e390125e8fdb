"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Cyclic boosting visits the features in
turn and adds a shrunken shallow tree over one feature's bins to that
feature's lookup table; then the pairs of features that explain most of what
is left get tables of their own in the same way. A document's score is the
sigmoid of the sum of its bins' entries: vectorised lookups and additions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, fold
from .toxicity import training_rows

FIT_LABELLED = 12_000
FOLDS, HELD = 3, 1
BINS, LEAVES, ROUNDS, RATE, PAIRS, PAIR_BINS = 32, 3, 120, 0.2, 8, 8
FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "lower", "upper", "digit", "space", "prose_marks", "marks", "non_ascii", "line_length",
    "short_lines", "dup_lines", "distinct_words", "top_word", "top_pair", "marked_words", "upper_words", "exclaimed", "ended_lines", "stray_marks",
)
_LOWER, _UPPER, _DIGIT, _SPACE, _PROSE = (frozenset(s.encode()) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\v\f", ".,;:'\"-()?!"))
_GROUP = np.array([0 if b in _LOWER else 1 if b in _UPPER else 2 if b in _DIGIT else 3 if b in _SPACE else 4 if b in _PROSE else 5 if b < 128 else 7 if b < 192 else 6 for b in range(256)])
_MARK = re.compile(r"[#*$%&|<>{}=\\^~@_]")


def describe(text: str | None) -> list[float]:
    """Features of a whole text; all zero for null and empty texts and texts without a word."""
    text = text or ""
    words = WORD.findall(text)
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    groups = np.bincount(_GROUP, raw, 8)[:7]
    n, k = max(1.0, groups.sum()), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    pairs: dict[tuple[str, str], int] = {}
    for p in zip(words, words[1:], strict=False):
        pairs[p] = pairs.get(p, 0) + 1
    marked = sum(1 for w, c in count.items() for _ in range(c) if _MARK.search(w)) if groups[5] else 0
    upper = sum(c for w, c in count.items() if len(w) > 1 and w.isupper())
    return [
        np.log1p(len(text)), np.log1p(k), sum(map(len, words)) / k, sum(c for w, c in count.items() if len(w) > 14) / k, *(groups / n), np.log1p(len(text) / max(1, len(lines))),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(count) / k, max(count.values()) / k, max(pairs.values(), default=0) / k,
        marked / k, upper / k, sum(c for w, c in count.items() if w.endswith("!")) / k, sum(x.rstrip().endswith((".", "!", "?", '"')) for x in lines) / max(1, len(lines)), count.get("|", 0) / k,
    ]


@dataclass
class Model:
    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def logit(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        out = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            out += table[at[:, j]]
        for i, j, table in self.pairs:
            out += table[_coarse(at[:, i], len(self.cuts[i])), _coarse(at[:, j], len(self.cuts[j]))]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _coarse(at: np.ndarray, n_cuts: int) -> np.ndarray:
    return at * PAIR_BINS // (n_cuts + 1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Newton steps of a tree with at most ``leaves`` leaves over ordered bins of gradients and curvatures."""
    spans = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for s, (a, b) in enumerate(spans):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = _gain(cg[k] - cg[a], ch[k] - ch[a]) + _gain(cg[b] - cg[k], ch[b] - ch[k]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                if gain.max() > best[0]:
                    best = (gain.max(), s, int(k[np.argmax(gain)]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in spans:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return step


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best one cut in each of two dimensions: its gain and the Newton steps of the four cells."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    r, c = g.shape
    best, out = 0.0, np.zeros_like(g)
    whole = _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.meshgrid(np.arange(1, r), np.arange(1, c), indexing="ij")

    def cells(x: np.ndarray) -> list[np.ndarray]:
        a, top, left = x[i, j], x[i, c], x[r, j]
        return [a, top - a, left - a, x[r, c] - top - left + a]

    gs, hs = cells(cg), cells(ch)
    gain = sum(_gain(a, b) for a, b in zip(gs, hs, strict=True)) - whole
    if gain.size and gain.max() > 1e-9:
        p, q = np.unravel_index(np.argmax(gain), gain.shape)
        best = float(gain[p, q])
        steps = [a[p, q] / (b[p, q] + 1.0) for a, b in zip(gs, hs, strict=True)]
        p, q = p + 1, q + 1
        out[:p, :q], out[:p, q:], out[p:, :q], out[p:, q:] = steps
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """A model of rows ``x`` with labels ``y``. Where a class is absent, all scores are alike."""
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(prior / (1 - prior))))
    if len(set(y.tolist())) < 2:
        return model
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = model.bins(x)
    f = np.full(len(y), model.bias)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = residual()
            step = rate * shallow_tree(np.bincount(at[:, j], g, len(table)), np.bincount(at[:, j], h, len(table)))
            table += step
            f += step[at[:, j]]
    coarse = [_coarse(at[:, j], len(model.cuts[j])) for j in range(x.shape[1])]

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * PAIR_BINS + coarse[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = residual()
    strength = sorted(((-quadrants(cells(i, j, g), cells(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)))[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in strength]
    for _ in range(rounds // 3):
        for i, j, table in model.pairs:
            g, h = residual()
            step = rate * quadrants(cells(i, j, g), cells(i, j, h))[1]
            table += step
            f += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, mod: int = FOLDS, held: int = HELD, labelled: int = FIT_LABELLED) -> Model:
    """Fitted on at most ``labelled`` labelled rows outside the held-out fold, those whose ids have the least hash. Executors describe them; a row's features are what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [describe(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2).cast(pa.int32())], ["id", "x", "y"])

    chosen = training_rows(docs, labels, "quality", mod, held, labelled)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    rows = sorted(tuple(r) for r in chosen.mapInArrow(run, f"id {kind}, x array<double>, y int").collect())
    return fit(np.array([x for _, x, _ in rows]).reshape(-1, len(FEATURES)), np.array([y for *_, y in rows], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row's whole text.

    Null, empty and wordless texts have the score of all-zero features.
    Repeated rows and null ids yield one row each; other columns are not
    carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some tables of BINS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([describe(t.as_py()) for t in part.column(1)]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(x))], ["id", "score"])

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
