"""Scores, rules and filters against brute force, held-out labels, and awkward tables."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuloom.llm import quality_model, quality_rules, queries, toxicity, url_filter
from corpuloom.llm.common import crc_fold, fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The cat and the dog went to the old house by the river in the rain. " * 4000
#: Nulls in any column, empty and very long texts, repeated rows and ids.
AWKWARD = [
    (1, "The cat sat.\nThe cat sat.\n", "en", "a", 26), (1, "The cat sat.\nThe cat sat.\n", "en", "a", 26), (2, "", "en", None, 0), (3, None, None, None, None), (None, "no id", "en", "a", 5),
    (4, LONG, "en", "b", len(LONG)), (5, " \n\t ", "fr", "b", 4), (1, "another text under one id", None, "a", None), (6, "é" * 3000, "fr", "c", 3000),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def held_out_scores(spark, sf_dir, name, label, mod, held):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert (got["held_out"] == [crc_fold(i, mod) == held for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    assert got["score"].between(0, 1).all()
    both = both[both["held_out"]]
    return both["score"].to_numpy(), both[label].to_numpy()


def auc(score, y):
    place = np.argsort(np.argsort(score))
    n = y.sum()
    return (place[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_toxicity_on_held_out_rows(spark):
    score, y = held_out_scores(spark, "/root/testdata/sf0.1", "op1_toxicity", "toxic", 5, 0)
    assert auc(score, y) > 0.99
    assert ((score >= 0.5) == y).mean() > 0.97
    assert (score[y == 0] >= 0.5).mean() < 0.01


def test_quality_on_held_out_rows(spark):
    score, y = held_out_scores(spark, "/root/testdata/sf0.1", "op6_quality_model", "quality", 3, 1)
    assert auc(score, y) > 0.99
    assert ((score >= 0.5) == y).mean() > 0.97


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in [0, 7, 123456, None]], "doc_id long")
    got = {r["doc_id"]: r["f"] for r in df.select("doc_id", fold(F.col("doc_id"), 5).alias("f")).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in [0, 7, 123456, None]}


def local_model(votes, known):
    return toxicity.LabelModel().fit(votes.shape[1], lambda f, size: f(votes, known, np.ones(len(votes))))


def slow_label_model(votes, known, parent, rounds, smooth=1.0, share=0.5):
    """The EM of a fixed tree, row by row."""
    n = sum(k >= 0 for k in known)
    discount = min(1, share * n / (len(known) - n))
    post, table = [max(k, 0) for k in known], None
    for step in range(rounds):
        weight = [1.0 if k >= 0 else 0.0 if step == 0 else discount for k in known]
        table = [[[0.0] * len(parent) for _ in (0, 1)] for _ in (0, 1)]
        for c in (0, 1):
            for j, p in enumerate(parent):
                for above in (0, 1):
                    rows = [(w * (q if c else 1 - q), v[j]) for w, q, v in zip(weight, post, votes, strict=True) if p < 0 or v[p] == above]
                    table[c][above][j] = (sum(w for w, x in rows if x) + 0.1 * smooth) / (sum(w for w, _ in rows) + smooth)
        prior = (sum(w * q for w, q in zip(weight, post, strict=True)) + smooth) / (sum(weight) + 2 * smooth)
        fresh = []
        for v, k in zip(votes, known, strict=True):
            logit = np.log(prior / (1 - prior))
            for j, p in enumerate(parent):
                fire, clean = (table[c][0 if p < 0 else int(v[p])][j] for c in (1, 0))
                logit += np.log(fire / clean) if v[j] else np.log((1 - fire) / (1 - clean))
            fresh.append(1 / (1 + np.exp(-logit)))
        post = [k if k >= 0 else q for q, k in zip(fresh, known, strict=True)]
    return prior, np.array(table), np.array(fresh)


def test_label_model_equals_plain_em(spark):
    r = np.random.default_rng(4)
    y = r.random(300) < 0.4
    votes = np.stack([np.where(y, r.random(300) < a, r.random(300) < b) for a, b in ((0.8, 0.1), (0.5, 0.05), (0.3, 0.3))], axis=1)
    votes = np.concatenate([votes, votes[:, :1] ^ (r.random((300, 1)) < 0.05)], axis=1)
    known = np.where(np.arange(300) < 60, y, -1).astype(int)
    patterns = Counter((np.packbits(v).tobytes(), int(k)) for v, k in zip(votes, known, strict=True))
    table = spark.createDataFrame([(bytearray(p), k, n) for (p, k), n in patterns.items()], "pattern binary, known int, n long")
    for total in (lambda f, size: f(votes, known, np.ones(300)), toxicity.totals_of(table, 4)):
        model = toxicity.LabelModel(rounds=5).fit(4, total)
        prior, want, post = slow_label_model(votes.tolist(), known.tolist(), model.parent, 5)
        assert model.prior == pytest.approx(prior, abs=1e-5)
        assert model.table == pytest.approx(want, abs=1e-5)
        assert model.posterior(votes) == pytest.approx(post, abs=1e-4)


def test_a_score_is_the_plain_formula(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.select("doc_id", "text").collect()
    toxic = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxic).collect()}
    w, mean, spread = toxic.length
    for r in rows:
        words = set(re.findall(r"[^\W\d_]+", r["text"].lower()))
        parts = words | {x[:n] + "*" for x in words for n in (4, 5, 6, 7) if len(x) > n}
        logit = toxic.bias + sum(v for f, v in toxic.weights.items() if f in parts) + w * (np.log(1 + len(words)) - mean) / spread
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)
    good = quality_model.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_model.score(docs, good).collect()}
    for r in rows:
        x = quality_model.describe(r["text"])
        at = [sum(v >= c for c in cuts) for v, cuts in zip(x, good.cuts, strict=True)]
        logit = good.bias + sum(t[i] for t, i in zip(good.tables, at, strict=True))
        for i, j, t in good.pairs:
            a, b = (int(quality_model._coarse(np.array([at[k]]), len(good.cuts[k]))[0]) for k in (i, j))
            logit += t[a][b]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)


def test_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    good = np.where(y, r.random(4000) < 0.9, r.random(4000) < 0.05)
    fair = np.where(y, r.random(4000) < 0.6, r.random(4000) < 0.1)
    noise = r.random(4000) < 0.3
    votes = np.stack([good, fair, good, noise], axis=1)
    votes[:, 2] ^= r.random(4000) < 0.01  # a copy of the first
    known = np.where(np.arange(4000) < 500, y, -1).astype(int)
    model = local_model(votes, known)
    assert model.parent[2] == 0 or model.parent[0] == 2
    assert -1 in model.parent
    post = model.posterior(votes)
    hidden = known < 0
    assert ((post >= 0.5) == y)[hidden].mean() > 0.9
    alone = local_model(votes[:, [0, 3]], known).posterior(votes[:, [0, 3]])
    # a voter that repeats another must not add confidence
    assert abs(post[hidden & good & ~fair].mean() - alone[hidden & good & ~fair].mean()) < 0.25


def test_scores_of_awkward_rows(spark):
    said = [("you are an idiot", 1), ("a fine day", 0)] * 20 + [("nothing said", None)]
    sample = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(said)], "doc_id long, text string, y int")
    extra = awkward(spark).withColumn("id", F.lit("clash")).withColumn("score", F.lit("clash"))
    model = toxicity.fit(extra.select("doc_id", "text").union(sample.select("doc_id", "text")), sample)
    assert model.weights["idiot"] > 0
    got = toxicity.score(extra, model).collect()
    assert len(got) == len(AWKWARD)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty(spark), model).count() == 0
    quality = quality_model.fit(np.array([quality_model.describe(t or "") for _, t, *_ in AWKWARD] * 3), np.array(([1, 1, 0, 0, 1, 1, 0, 1, 0]) * 3, float))
    got = quality_model.score(extra, quality).collect()
    assert len(got) == len(AWKWARD)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 5)}) == 1
    assert quality_model.score(empty(spark), quality).count() == 0


def test_training_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        assert toxicity.train(awkward(spark), labels).weights == {}
        assert toxicity.train(empty(spark), labels).weights == {}
        assert quality_model.train(awkward(spark), labels).tables == []


def test_fit_reads_no_held_out_label(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "a", 5) for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels, "toxic", 5, 0, 1000)
    seen = {int(r["text"].split()[1]) for r in rows.collect()}
    assert seen == {i for i in range(200) if crc_fold(i, 5) != 0}
    assert toxicity.training_rows(docs, labels, "toxic", 5, 0, 10).count() == 10


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = [(1, f"text {i % 7}", "en", "a", 5) for i in range(30_000)] + [(None, f"none {i % 3}", "en", "a", 5) for i in range(300)] + [(i, f"text {i}", "en", "a", 5) for i in range(2, 90)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (None, 0, 0), *((i, i % 2, i % 2) for i in range(2, 90))], "doc_id long, quality int, toxic int")
    for label, mod, held in (("toxic", 5, 0), ("quality", 3, 1)):
        got = toxicity.training_rows(docs, labels, label, mod, held, 40).collect()
        assert len(got) == len({r["doc_id"] for r in got}) == 40 and all(r["doc_id"] is not None for r in got)
    assert toxicity.training_rows(docs, labels, "toxic", 5, 0, 1000).where("doc_id = 1").count() <= 1
    assert len(quality_model.train(docs, labels).tables) > 0  # no order of null ids is asked for
    assert toxicity.train(docs, labels) is not None


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
    plain = quality_model.Model(model.bias, model.cuts, model.tables)
    assert ((plain.score(x) >= 0.5) == y).mean() < 0.7


# --- Quality rules


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rule_counts_equal_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in queries.op8_quality_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = slow_counts(d["text"]), got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_keep_clean_and_drop_junk(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_quality_rules(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    judged = got[~got["base_failed"]]
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.99
    assert judged[judged["quality"] == 0]["kept"].mean() < 0.6


def test_distance_is_jensen_shannon():
    p, q = np.array([1.0, 1.0, 0.0]), np.array([[1.0, 1.0, 0.0], [0.0, 0.0, 2.0]])
    assert quality_rules.distance(p, q) == pytest.approx([0, 1])


def test_rules_on_awkward_rows(spark):
    got = quality_rules.judge(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    assert all(r["base_failed"] for r in got if r["doc_id"] in (2, 3, 5))
    assert quality_rules.judge(empty(spark)).count() == 0
    kept = quality_rules.keep(awkward(spark).withColumn("kept", F.lit("clash")))
    assert kept.columns == [*awkward(spark).columns, "kept"]
    assert quality_rules.keep(empty(spark)).count() == 0


def test_rare_languages_are_kept_whatever_their_share(spark):
    def prose(words, n):
        return " ".join(r.choice(words) for _ in range(n))

    r = np.random.default_rng(8)
    english = ["the", "of", "and", "to", "in", "is", "house", "river", "winter", "garden"]
    russian, chinese = ["дом", "река", "зима", "и", "в", "на", "сад", "окно"], ["天地", "玄黄", "宇宙", "洪荒", "日月", "盈昃"]
    rare, none = quality_rules.MIN_DOCS, quality_rules.MIN_DOCS - 1
    rows = [(i, prose(english, 150), "en", "s", 0) for i in range(150 * rare)]
    rows += [(10_000 + i, prose(russian, 150), "ru", "s", 0) for i in range(rare)]  # under 1 % of all
    rows += [(20_000 + i, prose(chinese, 150), "zh", "s", 0) for i in range(none - 1)]  # too few for a reference, with the junk under that name too
    junk = prose(["#%&=", "<<>>", "@@[]", "{}|~"], 150)
    rows += [(30_000 + i, junk, lang, "s", 0) for i, lang in enumerate(["en", "zh", "zz", None, "ru"])]
    docs = spark.createDataFrame(rows, DOCS)
    assert quality_rules.references(docs).langs == {"en", "ru"}
    got = {x["doc_id"]: x for x in quality_rules.judge(docs).collect()}
    assert sorted(i for i, x in got.items() if not x["kept"]) == list(range(30_000, 30_005))  # whatever its language says
    assert all(got[i]["class_distance"] is not None for i in got)
    assert all((got[i]["word_distance"] is None) == (lang not in ("en", "ru")) for i, _, lang, _, _ in rows)
    assert {x["doc_id"] for x in quality_rules.keep(docs).collect()} == set(got) - set(range(30_000, 30_005))
    many = docs.union(spark.createDataFrame([(40_000 + i, junk, "junk", "s", 0) for i in range(5 * rare)], DOCS))
    assert quality_rules.references(many).langs == {"en", "ru"}  # junk under a label of its own is no reference
    assert not quality_rules.keep(many).where("doc_id >= 30000").count()


def test_rules_equal_their_sql_on_unknown_languages(spark, tmp_path, sf):
    r = np.random.default_rng(4)
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    docs["lang"] = [r.choice(["en", "fr", "rare", "odd", None], p=[0.5, 0.4, 0.02, 0.03, 0.05]) for _ in range(len(docs))]
    docs.loc[docs.index[:3], "text"] = "#%&= <<>> @@[] {}|~ " * 3 + " ".join(f"<{i}%&" for i in range(200))
    docs.to_parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got, want = queries.op8_quality_rules(spark, str(tmp_path)).toPandas(), db.sql(queries.SQL["op8_quality_rules"]).df()
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))
    assert got["word_distance"].isna().any()


def test_repeat_words_of_edges():
    assert quality_rules.repeat_words("a b c".split()) == 0
    assert quality_rules.repeat_words(("a b c d e f g h " * 2).split()) == 16
    assert quality_rules.repeat_words(["a"] * 9) == 9


# --- Urls


def slow_rule(host, path, rules):
    best = None
    for action, h, p in rules:
        if (host == h or host.endswith("." + h) or not h) and path.startswith(p):
            key = (h.count(".") + bool(h), len(p))
            if best is None or key > best[0]:
                best = (key, (h + p, action))
    return best and best[1]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), db.sql(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_trie_equals_brute_force():
    r = np.random.default_rng(3)
    labels, segments = ["a", "b", "com", "net"], ["x", "y", "xy", ""]

    def path():
        return "/" + "/".join(r.choice(segments) for _ in range(r.integers(0, 4)))

    rules = {(".".join(r.choice(labels) for _ in range(r.integers(1, 4))), path()): ("allow" if r.random() < 0.5 else "block") for _ in range(60)}
    rules = [(a, h, p) for (h, p), a in rules.items()]
    trie = url_filter.Trie(rules)
    for _ in range(3000):
        host, p = ".".join(r.choice(labels) for _ in range(r.integers(0, 5))), path()
        assert trie.match(host, p) == slow_rule(host, p, rules)


@pytest.mark.parametrize(
    ("url", "want"),
    [(None, ("", "")), ("x", ("", "")), ("http://A.Com", ("a.com", "")), ("http://a.com?x/y", ("a.com", "")), ("s://h/p/q#f?g", ("h", "/p/q")), ("a://b://c/d", ("b:", "//c/d")), ("://É.com/", ("É.com", "/"))],
)
def test_split_url(url, want):
    assert url_filter.split_url(url) == want


def test_url_rows(spark):
    rows = [(1, "http://www.example.com/en/x", "h"), (1, "http://www.example.com/en/x", "h"), (2, "http://m.example.com/en/x", "h"), (3, "http://example.com/EN/", "h"), (4, None, "h"), (None, "https://a.net/fr/", None), (5, "http://notcom/", "h"), (6, "", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.RULES).collect()]
    assert sorted(got, key=str) == sorted([(1, "www.example.com/en/", "allow")] * 2 + [(2, "example.com/en/", "block"), (3, "com/", "allow"), (4, None, "allow"), (None, "net/fr/", "block"), (5, None, "allow"), (6, None, "allow")], key=str)
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0
    with pytest.raises(ValueError, match="unknown action"):
        url_filter.Trie([("deny", "com", "/")])
