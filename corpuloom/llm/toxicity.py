"""Toxicity by weak supervision.

1. Voters. Hand-written lexicon and pattern voters, and voters mined from the
   labelled training rows: words and word beginnings that toxic rows hold far
   more often than others. A voter fires on a text or not.
2. Label model. A generative model of the votes given the hidden class: each
   voter has its accuracy P(fires | class), and correlated voters are linked in
   a tree (the maximum spanning tree of their mutual information given the
   class), so that voters that repeat each other are not counted twice. Fitted
   by expectation-maximisation over all rows of the training folds: the sampled
   labelled rows hold their class, all others their posterior. Rows are counted
   by their votes, and executors add up what each step needs.
3. Classifier. Logistic regression over the words and word beginnings of a
   text, trained on posteriors of the sampled labelled rows. A row's label is one
   more voter there: its accuracy in each class is how far labels agree with
   the other voters' posteriors, so a label that these speak against teaches
   less.

Scores are 0 to 1; every whole text is scored, empty ones by the intercept and
the length's term. Labels of held-out rows are never read, and id, source,
language and labels are never inputs of a score. No text reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_table, fold, materialise

#: Most labelled rows that hold their class in the label model, are mined for voters and train the classifier: those of the least hash. Rows without a label all count in the label model.
FIT_LABELLED = 6000
#: Most mined voters, and the likelihood ratio (G squared) of a voter's firing with the label at least.
MINED, MINED_RATIO = 400, 24.0
#: Most features of the classifier, the rows that must hold one at least, and its likelihood ratio with the posterior at least.
FEATURES, FEATURE_ROWS, FEATURE_RATIO = 20_000, 4, 20.0
#: Weight of all rows of hidden class together, in shares of the labelled sample's.
HIDDEN_SHARE = 0.5
#: Distinct votes that a task of the label model adds up.
TASK_PATTERNS = 1 << 15
FOLDS = 5
PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")
LEXICON = {
    "insult_mind": "idiot idiots moron morons imbecile stupid dumb dumbass fool retard cretin dimwit idiota estúpido imbécil dumm dummkopf idiote débile crétin",
    "insult_worth": "worthless pathetic loser losers trash garbage scum filth vermin useless basura escoria abschaum müll ordure déchet minable",
    "insult_role": "clown clowns pig pigs coward liar freak creep payaso cerdo schwein feigling bouffon porc lâche",
    "disgust": "disgusting revolting repulsive vile nasty hateful asqueroso widerlich ekelhaft dégoûtant",
    "threat": "kill die hurt destroy murder shoot hang muere sterben töten crever tuer",
    "obscene": "fuck fucking shit bitch asshole bastard crap puta mierda scheiße arschloch putain merde connard",
    "shut_up": "hate despise loathe odio hasse déteste",
}
PATTERNS = {
    "you_are": r"\b(?:you|u)(?:'re|r| are)? (?:such )?(?:an? |all )?(?:\w+ )?(?:idiot|moron|clown|loser|scum|trash|stupid|pathetic|worthless)s?\b",
    "shut": r"\bshut (?:up|your)\b|\bget lost\b|\bdrop dead\b|\bgo to hell\b",
    "such_a": r"\b(?:such|what) an? (?:idiot|moron|clown|loser|fool)\b",
    "shout_insult": r"(?:idiot|moron|loser|scum|stupid)\w*!{2,}",
}
_LEXICON = {name: frozenset(words.split()) for name, words in LEXICON.items()}
_PATTERNS = {name: re.compile(p) for name, p in PATTERNS.items()}


#: Words of which a text holds one at least if a pattern fits it.
_NEEDED = {
    "you_are": frozenset(w + e for w in "idiot moron clown loser scum trash stupid pathetic worthless".split() for e in ("", "s")),
    "shut": frozenset("shut lost dead hell".split()),
    "such_a": frozenset("idiot moron clown loser fool".split()),
}


def word_set(text: str | None) -> tuple[str, set[str]]:
    """A text in lower case, and its words: runs of letters."""
    low, words = (text or "").lower(), set()
    for token in set(low.split()):
        if token.isalpha():
            words.add(token)
        else:
            words.update(_WORD.findall(token))
    return low, words


def features(words: Iterable[str]) -> set[str]:
    """A text's words and word beginnings; a beginning ends in an asterisk."""
    out = set()
    for w in words:
        out.add(w)
        for n in PREFIXES:
            if len(w) > n:
                out.add(w[:n] + "*")
    return out


def known_features(of: dict) -> Callable[[set[str]], set]:
    """A function of a text's words: what ``of`` has for their features. It remembers words, a bounded number."""
    seen: set[str] = set()
    telling: set[str] = set()
    told: dict[str, tuple] = {}

    def found(words: set[str]) -> set:
        if len(seen) > 1 << 18:
            seen.clear(), telling.clear(), told.clear()
        for w in words - seen:
            seen.add(w)
            if own := tuple(of[f] for f in features((w,)) if f in of):
                told[w] = own
                telling.add(w)
        return {x for w in words & telling for x in told[w]}

    return found


def fixed_votes(low: str, words: set[str]) -> list[bool]:
    fits = [not (k in _NEEDED and words.isdisjoint(_NEEDED[k])) and p.search(low) is not None for k, p in _PATTERNS.items()]
    return [not words.isdisjoint(v) for v in _LEXICON.values()] + fits


class LabelModel:
    """Votes given a hidden binary class, with a tree of dependent voters.

    ``total`` is a function that adds up f(votes, known, count) - a vector of a
    named size - over all rows, wherever these lie: rows of equal votes and
    known class (1, 0, or -1 where it is hidden) are one with their count.

    The first step takes the known rows alone. From then on hidden rows count
    with their posteriors, all together at most ``share`` of the known ones'
    weight: many more would let the classes drift to whatever parts them best.
    """

    def __init__(self, rounds: int = 15, smooth: float = 1.0, strength: float = 0.01, share: float = HIDDEN_SHARE):
        self.rounds, self.smooth, self.strength, self.share, self.table = rounds, smooth, strength, share, None

    def _classes(self, votes: np.ndarray, known: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each row as clean and as toxic."""
        hidden = known < 0
        weight = np.where(hidden, 0.0 if self.table is None else self.discount, 1.0) * count
        post = np.where(hidden, 0.0 if self.table is None else self.posterior(votes), known)
        return (1 - post) * weight, post * weight

    def _pair_sums(self, votes: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
        votes = votes.astype(float)
        return np.concatenate([np.concatenate([[w.sum()], w @ votes, ((votes * w[:, None]).T @ votes).ravel()]) for w in self._classes(votes, known, count)])

    def _sums(self, votes: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
        votes, above = votes.astype(float), np.array(self.parent)
        parents = np.where(above >= 0, votes[:, above], 0.0)
        return np.concatenate([np.concatenate([[w.sum()], w @ votes, w @ parents, w @ (votes * parents)]) for w in self._classes(votes, known, count)])

    def _tree(self, sums: np.ndarray, m: int) -> list[int]:
        """Parent of each voter (-1: none) in the maximum spanning forest over mutual information given the class."""
        total, rows = np.zeros((m, m)), sums.reshape(2, -1)
        for part in rows:
            n = part[0] + 4 * self.smooth
            one, both = part[1 : m + 1] + 2 * self.smooth, part[m + 1 :].reshape(m, m) + self.smooth
            p11 = both / n
            pa_, pb = np.repeat((one / n)[:, None], m, 1), np.repeat((one / n)[None, :], m, 0)
            for joint, left, right in ((p11, pa_, pb), (pa_ - p11, pa_, 1 - pb), (pb - p11, 1 - pa_, pb), (1 - pa_ - pb + p11, 1 - pa_, 1 - pb)):
                joint = np.clip(joint, 1e-12, 1)
                total += part[0] / max(rows[:, 0].sum(), 1e-9) * joint * np.log(joint / np.clip(left * right, 1e-12, 1))
        np.fill_diagonal(total, 0)
        parent, best, via = [-1] * m, np.full(m, -1.0), [-1] * m
        inside = np.zeros(m, bool)
        for _ in range(m):
            j = int(np.argmax(np.where(inside, -2, best)))
            parent[j] = via[j] if best[j] > self.strength else -1
            inside[j] = True
            better = ~inside & (total[j] > best)
            best[better] = total[j][better]
            for k in np.flatnonzero(better):
                via[k] = j
        return parent

    def fit(self, m: int, total: Callable) -> LabelModel:
        labelled, hidden = total(_known, 2)
        self.discount = min(1.0, self.share * labelled / hidden) if hidden else 1.0
        for step in range(self.rounds):
            if step % 5 == 0:
                self.parent = self._tree(total(self._pair_sums, 2 * (1 + m + m * m)), m)
            sums = total(self._sums, 2 * (1 + 3 * m)).reshape(2, -1)
            n, fired, above, both = sums[:, :1], sums[:, 1 : m + 1], sums[:, m + 1 : 2 * m + 1], sums[:, 2 * m + 1 :]
            rare, alone = self.smooth * 0.1, np.array(self.parent) < 0
            silent = np.where(alone, fired + rare, fired - both + rare) / (np.where(alone, n, n - above) + self.smooth)
            loud = np.where(alone, silent, (both + rare) / (above + self.smooth))
            table = np.clip(np.stack([silent, loud], axis=1), 1e-9, 1 - 1e-9)  # class, parent's vote, voter
            still = self.table is not None and np.abs(table - self.table).max(initial=0) < 1e-4
            self.table, self.prior = table, float((n[1, 0] + self.smooth) / (n.sum() + 2 * self.smooth))
            if still and step >= 5:
                break
        return self

    @property
    def accuracies(self) -> np.ndarray:
        """P(voter fires | toxic, its parent silent) beside P(fires | clean, its parent silent)."""
        return self.table[:, 0, :][::-1]

    def trust(self, total: Callable) -> tuple[float, float]:
        """P(label 1 | toxic) and P(label 1 | clean): how far labels agree with the votes' posteriors."""
        one1, one0, all1, all0 = total(self._agreement, 4) + self.smooth * np.array([0.5, 0.5, 1.0, 1.0])
        return float(one1 / all1), float(one0 / all0)

    def _agreement(self, votes: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
        some = known >= 0
        post, count, known = self.posterior(votes[some]), count[some], known[some]
        return np.array([(post * count)[known == 1].sum(), ((1 - post) * count)[known == 1].sum(), (post * count).sum(), ((1 - post) * count).sum()])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        votes, above = votes.astype(bool), np.array(self.parent)
        parents = np.where(above >= 0, votes[:, above], False).astype(int)
        voters = np.arange(votes.shape[1])
        fire, clean = self.table[1][parents, voters], self.table[0][parents, voters]
        logit = np.log(self.prior / (1 - self.prior)) + np.where(votes, np.log(fire / clean), np.log((1 - fire) / (1 - clean))).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _known(votes: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.array([count[known >= 0].sum(), count[known < 0].sum()], float)


def totals_of(patterns: DataFrame, m: int) -> Callable:
    """``total`` of a table (pattern: packed votes, known, n). Sums are whole millionths, so they add up alike in any order."""

    def total(f: Callable, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(size)
            for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
                packed = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                found += f(np.unpackbits(packed, axis=1, count=m).astype(bool), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float))
            whole = np.rint(found * 1e6).astype(np.int64)
            some = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(whole[some])], ["place", "n"])

        out = np.zeros(size)
        for place, n in patterns.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).collect():  # at most size rows, which the number of voters bounds
            out[place] = n / 1e6
        return out

    return total


@dataclass
class Model:
    bias: float = -3.0
    weights: dict[str, float] = field(default_factory=dict)
    length: tuple[float, float, float] = (0.0, 0.0, 1.0)  # weight, mean and spread of log(1 + words)

    def scorer(self):
        """A function of a text; remembers the weighted features of words (a bounded memory)."""
        weights, of = self.weights, known_features({f: f for f in self.weights})
        w_len, mean, spread = self.length

        def score(text: str | None) -> float:
            words = word_set(text)[1]
            found = of(words)
            logit = self.bias + sum(weights[f] for f in sorted(found)) + w_len * (np.log1p(len(words)) - mean) / spread
            return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

        return score


def _logistic(rows: list[np.ndarray], size: int, extra: np.ndarray, target: np.ndarray, l2: float = 1e-3, steps: int = 1000) -> tuple[float, np.ndarray, float]:
    """Logistic regression on sparse presence rows, one dense column and soft targets, by full-batch Adagrad."""
    at = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bias, w, we = float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))), np.zeros(size), 0.0
    g_w, g_b, g_e = np.full(size, 1e-8), 1e-8, 1e-8
    for _ in range(steps):
        z = bias + np.bincount(of, w[at], len(rows)) + we * extra
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        d = np.bincount(at, err[of], size) + l2 * w / 100
        g_w += d * d
        w -= 0.25 * d / np.sqrt(g_w)
        db, de = err.sum(), (err * extra).sum()
        g_b, g_e = g_b + db * db, g_e + de * de
        bias -= 0.25 * db / np.sqrt(g_b)
        we -= 0.25 * de / np.sqrt(g_e)
    return bias, w, we


def likelihood_ratio(a: Column, b: Column, n1: float, n0: float, both: bool = False) -> Column:
    """G squared of presence counts a of n1 and b of n0 rows; 0 where the first share isn't the larger, unless ``both``."""
    n1, n0 = F.lit(float(n1)), F.lit(float(n0))
    cells = ((a, n1, a + b), (n1 - a, n1, n1 + n0 - a - b), (b, n0, a + b), (n0 - b, n0, n1 + n0 - a - b))
    g = 2 * sum((F.when(x > 0, x * F.log(x * (n1 + n0) / (row * column))).otherwise(0.0) for x, row, column in cells), F.lit(0.0))
    return g if both else F.when(a * n0 > b * n1, g).otherwise(0.0)


def _described(sample: DataFrame) -> DataFrame:
    """(id, y, length, fixed, features) of sampled rows: what is fitted on in place of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                told = [word_set(t.as_py()) for t in part.column(1)]
                fixed = [np.packbits(fixed_votes(low, words)).tobytes() for low, words in told]
                lists = pa.array([sorted(features(words)) for _, words in told], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array([float(np.log1p(len(w))) for _, w in told]), pa.array(fixed, pa.binary()), lists], ["id", "y", "length", "fixed", "features"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    return materialise(sample.mapInArrow(run, f"id {kind}, y int, length double, fixed binary, features array<string>"), "features")


_FIXED = len(_LEXICON) + len(_PATTERNS)


def _patterns(train: DataFrame, known: DataFrame, mined: dict[str, int]) -> DataFrame:
    """(pattern, known, n): how many training rows cast the same votes, by their class where it is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known_features(mined)
        for batch in batches:
            out = []
            for text in batch.column(1):
                low, words = word_set(text.as_py())
                votes = np.zeros(_FIXED + len(mined), bool)
                votes[:_FIXED] = fixed_votes(low, words)
                votes[[_FIXED + i for i in of(words)]] = True
                out.append(np.packbits(votes).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "pattern"])

    kind = train.schema["doc_id"].dataType.simpleString()
    votes = train.select("doc_id", "text").mapInArrow(run, f"id {kind}, pattern binary")
    # the known rows are a bounded sample, so the broadcast is bounded
    rows = votes.join(F.broadcast(known.select(F.col("id").alias("known_id"), F.col("y").alias("known")).distinct()), F.col("id") == F.col("known_id"), "left")
    counted = rows.groupBy("pattern", F.coalesce("known", F.lit(-1)).alias("known")).agg(F.count(F.lit(1)).alias("n"))
    return materialise(counted, "patterns")


def fit(train: DataFrame, sample: DataFrame) -> Model:
    """A model from the rows of the training folds (doc_id, text) and a bounded sample of labelled ones (doc_id, text, y). Without a toxic and a clean label, all scores are low and alike."""
    rows = _described(sample)
    n1, n0 = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not n1 or not n0:
        return Model()
    held = rows.where("y IS NOT NULL").select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    held = held.withColumn("ratio", likelihood_ratio(F.col("a"), F.col("n") - F.col("a"), n1, n0)).where(F.col("ratio") >= MINED_RATIO)
    mined = {r["f"]: i for i, r in enumerate(held.orderBy(F.desc(F.round("ratio", 9)), "f").limit(MINED).collect())}
    m = _FIXED + len(mined)
    patterns = _patterns(train, rows.where("y IS NOT NULL"), mined)
    # each task gives all its sums, so there are no more tasks than the patterns want
    total = totals_of(patterns.coalesce(1 + patterns.count() // TASK_PATTERNS), m)
    labels = LabelModel().fit(m, total)
    true, false = labels.trust(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = np.zeros((batch.num_rows, m), bool)
            for i, (fixed, found) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                votes[i, :_FIXED] = np.unpackbits(np.frombuffer(fixed, np.uint8), count=_FIXED)
                votes[i, [_FIXED + mined[f] for f in found if f in mined]] = True
            post = labels.posterior(votes) if batch.num_rows else np.empty(0)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            odds = post / (1 - post) * np.where(y == 1, true / false, (1 - true) / (1 - false))
            post = np.round(odds / (1 + odds), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(post, pa.float64()), batch.column(2), batch.column(4)], ["id", "post", "length", "features"])

    kind = rows.schema["id"].dataType.simpleString()
    judged = materialise(rows.mapInArrow(run, f"id {kind}, post double, length double, features array<string>"), "posteriors")
    n, micros = judged.agg(F.count(F.lit(1)), F.sum(F.round(F.col("post") * 1e6).cast("long"))).first()
    some = judged.select((F.round(F.col("post") * 1e6).cast("long")).alias("p"), F.explode("features").alias("f")).groupBy("f").agg((F.sum("p") / 1e6).alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    some = some.where(F.col("n") >= FEATURE_ROWS).withColumn("ratio", likelihood_ratio(F.col("a"), F.col("n") - F.col("a"), micros / 1e6, n - micros / 1e6, both=True)).where(F.col("ratio") >= FEATURE_RATIO)
    names = [r["f"] for r in some.orderBy(F.desc(F.round("ratio", 9)), "f").limit(FEATURES).collect()]
    kept = {f: i for i, f in enumerate(names)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [sorted(kept[f] for f in found if f in kept) for found in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at, pa.list_(pa.int32()))], ["id", "post", "length", "at"])

    # of a bounded sample, and of each row at most the features that were kept
    found = judged.mapInArrow(placed, f"id {kind}, post double, length double, at array<int>").collect()
    found.sort(key=lambda r: (r["id"] is None, r["id"], r["post"], r["length"], r["at"]))
    for done in (rows, patterns, judged):
        drop_table(done)
    extra, post = np.array([r["length"] for r in found]), np.array([r["post"] for r in found])
    mean, spread = float(extra.mean()), float(extra.std() or 1)
    bias, w, we = _logistic([np.array(r["at"], np.int64) for r in found], len(kept), (extra - mean) / spread, post)
    return Model(bias, {f: float(w[i]) for f, i in kept.items() if abs(w[i]) > 1e-4}, (float(we), mean, spread))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, held: int, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled rows of the training folds: the ids of the least hash, one row each.

    Rows with a null id or a null label are left out. Of rows that repeat an id,
    the one whose text has the least hash is taken; of labels that do, the
    larger.
    """
    ours = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), mod) != held)).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    some = ours.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # the chosen ids are at most as many as named, so the broadcast is bounded
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text")))
    return rows.groupBy("doc_id", "y").agg(least.alias("least")).select("doc_id", F.col("least.text").alias("text"), "y")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row's whole text.

    Null and empty texts have the score of no features and no length. Repeated
    rows and null ids yield one row each; other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())], ["id", "score"])

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def train(docs: DataFrame, labels: DataFrame, mod: int = FOLDS, held: int = 0, labelled: int = FIT_LABELLED) -> Model:
    """Fitted on all rows outside the held-out fold, of which a bounded sample of labelled ones is mined and trained on."""
    rows = docs.select("doc_id", "text").where(fold(F.col("doc_id"), mod) != held)
    return fit(rows, training_rows(docs, labels, "toxic", mod, held, labelled))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
