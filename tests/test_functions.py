import random

import pytest
from pyspark.sql import functions as F

from corpuloom.functions import binary, edit, text
from corpuloom.operators import aliases


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "kind"),
    [("a/node_modules/x.js", "vendored"), ("README.md", "documentation"), ("docs/a.txt", "documentation"), ("a/b.HTML", "markup"), ("a/b.py", "code"), ("a/b.json", "data"), ("a/b.txt#L12-99", "prose"), ("a/b", "prose"), ("a/.hidden", "prose"), ("a/b.xyz", "other")],
)
def test_provenance(spark, path, kind):
    assert one(spark, text.provenance(F.lit(path))) == kind
    assert one(spark, text.provenance_label(F.lit(path))) == (None if kind == "prose" else kind)


def test_non_prose_ending(spark):
    assert one(spark, text.non_prose_ending(F.lit("a/x.min.js"))) == ".js"
    assert one(spark, text.non_prose_ending(F.lit("a/x.jsonl"))) == ".jsonl"
    assert one(spark, text.non_prose_ending(F.lit("a/x.txt"))) is None


def test_prose_score(spark):
    prose = "It was a cold morning and nobody had come. The road lay empty, and the snow kept falling. We waited. Then we left."
    code = "for(i=0;i<n;i++){a[i]=b[i]*c[i];d[i]=e[i]&0xff;}"
    assert one(spark, text.prose_score(F.lit(prose))) > 0.9
    assert one(spark, text.prose_score(F.lit(code))) < 0.62
    assert one(spark, text.prose_score(F.lit("  \n"))) == 0.0
    assert one(spark, text.prose_score(F.lit(None).cast("string"))) == 0.0


def test_terms(spark):
    assert one(spark, text.content_terms(F.lit("What was the Año of the x_y año protocol?"))) == ["año", "x_y", "protocol"]
    terms = F.array(F.lit("proto"), F.lit("rat"))
    assert one(spark, text.term_coverage(F.lit("Protocols grate"), terms)) == 1
    assert one(spark, text.content_terms(F.lit(None).cast("string"))) == []


def test_titles(spark):
    assert one(spark, text.title(F.lit("\n## A head \nbody"))) == "A head"
    assert one(spark, text.title(F.lit("abc\nlonger"))) == "untitled"
    assert one(spark, text.title(F.lit("First line\n# Later"))) == "First line"
    assert one(spark, text.summary(F.lit("# H\nFirst one. Second."))) == "First one."
    assert one(spark, text.keywords(F.lit("# About Berlin\nThe Rhine and Rhine and Oder"))) == ["about", "berlin", "the", "rhine", "oder"]
    assert one(spark, text.slug(F.lit("  Hello, World! -- x "))) == "hello-world----x"
    assert one(spark, text.ingest_slug(F.lit("Hello, World!"))) == "hello-world"
    assert one(spark, text.question_slug(F.lit("Año 1?"))) == "año-1"


def test_markup_and_paragraphs(spark):
    assert one(spark, text.markup_to_text(F.lit("<p>a &amp; b</p>\n<b>c</b>"))) == "a & b c"
    assert one(spark, text.paragraphs(F.lit("a\n \n\n b \n\n\n"))) == ["a", "b"]
    assert one(spark, text.fixed_chunks(F.lit("abcdef"), 4)) == ["abcd", "ef"]
    assert one(spark, text.fixed_chunks(F.lit(""), 4)) == []


def test_replies(spark):
    fence = "```python\nx = 1\n```"
    assert one(spark, text.code_blocks(F.lit(f"a {fence} b {fence}"))) == ["x = 1\n"] * 2
    assert one(spark, text.reply_stage(F.lit("```python\nx"))) == "rescued"
    assert one(spark, text.reply_stage(F.lit("FINAL: 42"))) == "final"
    assert one(spark, text.final_line(F.lit("so\nFINAL: 42"))) == "42"
    assert one(spark, text.error_kind(F.lit("Traceback\nKeyError: x\nValueError: y"))) == "ValueError"
    assert one(spark, text.citations(F.lit("a; b, a"))) == ["a", "b"]


def test_addresses(spark):
    said = "see `a/b.txt#L1-20` and (c.md#L5-9), a/b.txt#L1-20"
    assert one(spark, text.addresses(F.lit(said))) == ["a/b.txt#L1-20", "c.md#L5-9"]
    assert one(spark, text.address_parts(F.lit("a/b.txt#L1-20"))).asDict() == {"source": "a/b.txt", "byte_start": 1, "byte_end": 20}
    assert one(spark, text.wikilinks(F.lit("[[A|x]] [[B#y]] [[A]] [[ ]]"))) == ["A", "B"]


def test_time(spark):
    assert [one(spark, text.duration(F.lit(x))) for x in ("90", "90s", "30m", "2h", "-5", "x")] == [90.0, 90.0, 1800.0, 7200.0, 0.0, None]
    assert one(spark, text.instant(F.lit("1970-01-01T00:01:00Z"))) == 60.0
    assert one(spark, text.instant(F.lit("12.5"))) == 12.5
    assert one(spark, text.decay(F.lit(0.0), F.lit(3))) == 1.0
    assert one(spark, text.decay(F.lit(None).cast("double"), F.lit(3))) == 1.0
    assert one(spark, text.decay(F.lit(86400.0), F.lit(0))) == pytest.approx(0.36787944)


def test_groundedness(spark):
    assert one(spark, text.groundedness(F.lit("Rivers flow slowly"), F.lit("The riversides"))) == pytest.approx(1 / 3)
    assert one(spark, text.groundedness(F.lit("a b"), F.lit("x"))) == 0.0
    assert one(spark, text.is_boilerplate(F.lit("As an AI, I cannot"))) is True


@pytest.mark.parametrize(
    ("data", "want"),
    [(b"", ("empty", None)), (b"PK\x03\x04abc", ("archive", None)), ("héllo".encode(), ("text", "utf-8")), (b"BM is a sentence", ("text", "utf-8")), (b"BM\x00\xff\xfe", ("media", None)), ("caf\xe9 con leche".encode("cp1252"), ("text", "cp1252")), (b"ab\x00cd", ("binary", None)), (b"log \x1b[31m\x07 line", ("text", "utf-8")), (bytes(range(128, 256)) * 4, ("binary", None)), (None, ("unreadable", None))],
)
def test_sniff(data, want):
    assert binary.kind_of(data) == want


def test_sniff_and_decode_columns(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1"), None), (bytearray("é".encode("cp1252")), "cp1252"), (bytearray(b"x"), "nonsense")], "d binary, e string")
    got = df.select(binary.sniff(F.col("d")).alias("s"), binary.decode("d", "e").alias("t")).collect()
    assert got[0]["s"]["kind"] == "document"
    assert [r["t"] for r in got] == ["%PDF-1", "é", "x"]


@pytest.mark.parametrize("ends", ["é", "€", "😀"])
def test_a_character_across_the_end_of_what_is_sniffed_is_text(spark, ends):
    n = len(ends.encode())
    whole = [(b"a" * (binary.SNIFF_BYTES - k) + ends.encode() + b" and more",) for k in range(n + 1)]
    rows = [*whole, (b"a" * (binary.SNIFF_BYTES - 1) + ends.encode()[:1],), (b"a" * (binary.SNIFF_BYTES - 2) + b"\xe9a" + ends.encode(),)]
    df = spark.createDataFrame([(i, bytearray(d)) for i, (d,) in enumerate(rows)], "i int, d binary")
    got = [tuple(r["s"]) for r in df.select("i", binary.sniff(F.col("d")).alias("s")).sort("i").collect()]
    assert got[: n + 1] == [("text", "utf-8")] * (n + 1)
    assert all(g != ("text", "utf-8") for g in got[n + 1 :])  # a character that the file itself breaks off, and a wrong one before the end


def slow_one_edit(a, b):
    if a == b:
        return False
    edits = {a[:i] + a[i + 1 :] for i in range(len(a))}
    edits |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in set(b)}
    edits |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in set(b)}
    edits |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in edits


def test_one_edit_equals_slow_form(spark):
    r = random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(5))) for _ in range(60)]
    rows = [(a, b, slow_one_edit(a, b)) for a in words for b in words]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(edit.one_edit(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def check(body):
    total = sum(edit.CHECK_DIGEST.index(g) * 4**i % len(edit.CHECK_DIGEST) for i, g in enumerate(body))
    return edit.CHECK[total % len(edit.CHECK)]


def test_aliases(spark):
    addresses = spark.createDataFrame([(f"f{i}.txt#L0-{i}",) for i in range(60)], "address string")
    table = aliases.mint(addresses, seed="s").collect()
    assert len({r["alias"] for r in table}) == 60
    assert all(r["alias"][5] == check(r["alias"][:4]) for r in table)
    minted = spark.createDataFrame(table)
    again = {r["address"]: r["alias"] for r in aliases.mint(addresses, minted).collect()}
    assert again == {r["address"]: r["alias"] for r in table}
    alias, address = table[0]["alias"], table[0]["address"]
    asked = [alias, alias.lower(), alias.replace("-", ""), alias.replace("-", " "), "", "QQQQ"]
    got = {r["written"]: r for r in aliases.resolve(spark.createDataFrame([(a,) for a in asked], "written string"), minted).collect()}
    assert got[alias]["status"] == "exact"
    assert got[alias.lower()]["address"] == address
    assert got[alias.replace("-", "")]["status"] == "normalised"
    assert got[""]["status"] == "unknown"
    assert got["QQQQ"]["status"] == "unknown"
    assert len(got["QQQQ"]["candidates"]) == 3


def test_a_slip_never_means_another_address(spark):
    table = aliases.mint(spark.createDataFrame([(f"a{i}",) for i in range(40)], "address string"), seed="x").collect()
    r = random.Random(3)
    slips = []
    for row in table:
        a = row["alias"]
        i = r.randrange(len(a))
        slips += [(a[:i] + a[i + 1 :], row["address"]), (a[:i] + r.choice("QX7") + a[i + 1 :], row["address"])]
    meant = {}
    for s, address in slips:
        meant.setdefault(s, set()).add(address)
    got = aliases.resolve(spark.createDataFrame([(s,) for s in meant], "written string"), spark.createDataFrame(table)).collect()
    for g in got:
        assert g["address"] is None or g["address"] in meant[g["written"]]
    assert sum(g["address"] is not None for g in got) > 40


def test_substitute(spark):
    table = spark.createDataFrame([("AAA2-" + check("AAA2"), "x.txt#L0-9")], "alias string, address string")
    alias = "AAA2-" + check("AAA2")
    texts = spark.createDataFrame([(1, f"See {alias.lower()}, and ZZZZ2-2."), (2, "none"), (3, None)], "id long, t string")
    got = {r["id"]: r["text"] for r in aliases.substitute(texts, table, "id", "t").collect()}
    assert got[1] == "See x.txt#L0-9, and ZZZZ2-2."
    assert got[2] == "none"
    assert got[3] is None
