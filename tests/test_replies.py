import pytest
from pyspark.sql import functions as F

from corpuloom.functions import replies
from corpuloom.operators import probes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_repair_json(spark):
    got = each(spark, ['```json\n{"a": {"b": 1}} tail\n```', 'x {"a": 1', "'plain'", None], replies.repair_json)
    assert got == ['{"a": {"b": 1}}', '{"a": 1', "plain", None]


def test_clean_question(spark):
    got = each(spark, ["- Pregunta: **¿Qué pasó?**", "Here it is:\n1. Who   came?", "I cannot answer. Why?", "A statement.", None], replies.clean_question)
    assert got == ["¿Qué pasó?", "Who came?", "", "", ""]


def test_decisions(spark):
    good = '{"answers": {"action": {"type": "choice", "choice": "drop"}, "relevant": {"type": "noul", "noul": false}, "importance": {"type": "score", "score": 2}}}'
    bad = good.replace('"drop"', '"keep"')
    got = each(spark, [good, bad, "{}", good.replace('"noul", "noul"', '"x", "noul"')], replies.decision)
    assert got[0].asDict() == {"action": "drop", "relevant": False, "importance": 2, "fault": None}
    assert [g["fault"] for g in got[1:]] == ["unknown action", "no answers", "no noul for relevant"]
    assert got[1]["action"] is None
    assert one(spark, replies.decision_request(F.lit("q"), F.lit("x" * 9000))) is None
    assert '"type":"noul"' in one(spark, replies.decision_request(F.lit("q"), F.lit("card")))
    assert [g.asDict() for g in each(spark, ["yes", "3", "drop"], replies.labelled_answer)] == [
        {"type": "noul", "noul": True, "score": None, "choice": None}, {"type": "score", "noul": None, "score": 3, "choice": None}, {"type": "choice", "noul": None, "score": None, "choice": "drop"},
    ]


def test_server_blocks(spark):
    full = '{"usage": {"prompt_tokens": 10}, "timings": {"prompt_ms": 500.0, "predicted_ms": 250.0, "prompt_n": 1, "cache_n": 99}}'
    got = each(spark, [full, "{}", '{"usage": {}}'], replies.server_block)
    assert got[0]["prompt_ms"] == 500.0 and got[0]["completion_tokens"] is None
    assert got[1] is None
    assert each(spark, [full, "{}"], lambda c: replies.residual_seconds(F.lit(1.0), replies.server_block(c))) == [0.25, None]
    assert each(spark, [full, "{}"], lambda c: replies.cache_served(replies.server_block(c))) == [True, False]


def test_ulids(spark):
    a, b = (one(spark, replies.ulid(F.lit(t), F.lit("k"))) for t in (1000, 2000))
    assert len(a) == 26 and a < b
    assert a == one(spark, replies.ulid(F.lit(1000), F.lit("k")))


FENCE = "```repl\n{}\n```"
LINE = 'answer["ready"] = True'


@pytest.mark.parametrize(
    ("content", "flags", "code"),
    [
        (FENCE.format("# " + LINE), (True, False, False), probes.MISSING[0]), (FENCE.format(LINE), (True, False, False), probes.MISSING[1]), (FENCE.format(LINE), (False, True, True), probes.MISSING[2]),
        (FENCE.format(LINE), (False, False, True), probes.MISSING[3]), (FENCE.format(LINE), (False, False, False), probes.MISSING[4]), (f"```json\n{LINE}\n```", (None, None, None), probes.MISSING[5]), (f"I set {LINE}", (None, None, None), probes.MISSING[6]), ("nothing", (False, False, False), None),
    ],
)
def test_missing_submission(spark, content, flags, code):
    df = spark.createDataFrame([("r", content, *flags)], "run_id string, content string, raised boolean, rebound boolean, inconsistent boolean")
    got = [r["code"] for r in probes.missing_submission(df).collect()]
    assert got == ([] if code is None else [code])


def test_probe_scores(spark):
    rows = [("m", "1", FENCE.format('grep("a)")')), ("m", "2", "no block"), ("m", "3", FENCE.format("peek((1)\nx = “q”"))]
    df = spark.createDataFrame(rows, "model string, run_id string, content string")
    assert tuple(probes.emission(df).first()) == ("m", 13.0, 20.0, True)
    assert tuple(probes.helper_calls(df).first()) == ("m", 7.5, 15.0, True)
    assert tuple(probes.quotes(df).first()) == ("m", 0.0, 5.0, False)


def test_passages_and_off_question(spark):
    addresses = spark.createDataFrame([("a.txt#L1-3",), ("junk",)], "address string")
    sources = spark.createDataFrame([("a.txt", bytearray("xéy".encode()))], "source string, content binary")
    assert [tuple(r) for r in probes.passages(addresses, sources).collect()] == [("a.txt#L1-3", "é")]
    s = spark.createDataFrame([("When was the treaty signed?", "treaty date", "strong"), ("When was the treaty signed?", "weather", "weak")], "question string, query string, band string")
    assert {(r["shares"], r["band"], r["n"]) for r in probes.off_question(s).collect()} == {(True, "strong", 1), (False, "weak", 1)}
