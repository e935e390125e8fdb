"""Functions over model replies: mending JSON, drafted questions, typed decisions, timings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text

# --- Fixed values. What a decision may be, and what each action costs.
ACTIONS = {
    "expand": "Read the full passage: it is likely to contain the answer, and nothing shorter will do",
    "summarise": "Use a short description of it instead of the full passage",
    "one_line": "Keep only its title or first line as a hint that it exists",
    "drop": "Leave it out of the context entirely",
}
IMPORTANCE = ("No bearing on the question", "Background only", "Part of the answer", "The answer itself")
MOST_TOKENS, CHARS_PER_TOKEN = 1024, 3.0
INSTRUCTIONS = {
    "action": "Decide what this card should contribute to the context of the model answering it.",
    "relevant": "Does the card contain anything that bears on that question?",
    "importance": "How much would including the full card help answer it?",
}
# --- Fixed values. Lead-ins, decoration and commentary of drafted questions.
LEAD_INS = ("question:", "pregunta:", "q:", "1.", "1)", "2.", "2)")
DECORATION = "`*_#> \t\"'-•·"
COMMENTARY = (
    r"(?i)^(i (cannot|can't|can not|am unable|don't|do not|apologize|apologise|need|would)|as an ai|lo siento|no puedo|no es posible|sorry[,.]|unfortunately|"
    r"the passage (does not|doesn't)|this passage (does not|doesn't))"
)
DECISION = (
    "answers struct<action:struct<type:string,choice:string,confidence:double,probabilities:map<string,double>>,"
    "relevant:struct<type:string,noul:boolean>,importance:struct<type:string,score:int,probabilities:map<string,double>>>"
)
SERVER = (
    "usage struct<prompt_tokens:long,completion_tokens:long,prompt_tokens_details:struct<cached_tokens:long>>, "
    "timings struct<prompt_ms:double,prompt_n:long,prompt_per_second:double,predicted_ms:double,predicted_n:long,predicted_per_second:double,cache_n:long>"
)


@F.pandas_udf(StringType())
def _object(reply: pd.Series) -> pd.Series:
    def first(t: str | None) -> str | None:
        if t is None:
            return None
        begin = t.find("{")
        if begin < 0:
            return t.strip().strip("'\"")
        depth = 0
        for m in re.finditer(r"[{}]", t[begin:]):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return t[begin : begin + m.end()]
        return t[begin:]

    return reply.map(first)


def repair_json(reply: Column) -> Column:
    """The first balanced object of a reply without its fences; what follows the first brace if none closes; the bare text if there is none."""
    bare = F.regexp_replace(F.regexp_replace(text._bare(reply), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return _object(bare)


@F.pandas_udf(StringType())
def clean_question(reply: pd.Series) -> pd.Series:
    """The first line of a reply that is a question, bare of decoration and lead-ins; '' if there is none or it is commentary."""
    commentary = re.compile(COMMENTARY)
    lead = re.compile("(?i)^(?:" + "|".join(map(re.escape, LEAD_INS)) + r")\s*")

    def one(t: str | None) -> str:
        for line in (t or "").splitlines():
            for _ in range(4):
                line = lead.sub("", line.strip().strip(DECORATION), count=1)
            line = " ".join(line.strip().split())
            if commentary.match(line):
                return ""
            if line.endswith(("?", "¿", "？")):
                return line
        return ""

    return reply.map(one)


def decision_request(question: Column, card: Column) -> Column:
    """A decision request about a card as JSON; null where it would pass the model's tokens."""
    asked = F.concat(F.lit("Question being answered: "), question, F.lit("\n"))
    says = {name: F.concat(asked, F.lit(said)) for name, said in INSTRUCTIONS.items()}
    options = F.struct(*[F.lit(v).alias(k) for k, v in ACTIONS.items()])
    parts = F.struct(
        F.struct(F.lit("choice").alias("type"), says["action"].alias("instructions"), options.alias("criteria")).alias("action"),
        F.struct(F.lit("noul").alias("type"), says["relevant"].alias("instructions")).alias("relevant"),
        F.struct(F.lit("score").alias("type"), says["importance"].alias("instructions"), F.array(*map(F.lit, IMPORTANCE)).alias("criteria")).alias("importance"),
    )
    size = F.length(card) + sum((F.length(s) for s in says.values()), F.lit(sum(map(len, ACTIONS.values()))))
    return F.when(F.floor(size / CHARS_PER_TOKEN) + 1 <= MOST_TOKENS, F.to_json(F.struct(card.alias("state"), parts.alias("questions"))))


def decision(reply: Column) -> Column:
    """Struct (action, relevant, importance, fault) of a decision reply; a missing or unknown answer is a fault, never a default."""
    a = F.from_json(reply, DECISION)["answers"]
    action, relevant, importance = a["action"], a["relevant"], a["importance"]
    fault = (
        F.when(a.isNull(), "no answers").when(~F.coalesce(action["type"] == "choice", F.lit(False)), "no choice for action").when(~F.coalesce(action["choice"].isin(*ACTIONS), F.lit(False)), "unknown action")
        .when(~F.coalesce(relevant["type"] == "noul", F.lit(False)), "no noul for relevant").when(~F.coalesce(importance["type"] == "score", F.lit(False)), "no score for importance")
    )
    sure = lambda c: F.when(fault.isNull(), c)
    return F.struct(sure(action["choice"]).alias("action"), sure(relevant["noul"]).alias("relevant"), sure(importance["score"]).alias("importance"), fault.alias("fault"))


def labelled_answer(label: Column) -> Column:
    """A label of a classifier as a typed answer: yes and no a noul, digits a score, all else a choice."""
    yes = label.isin("yes", "no")
    score = label.rlike(r"^\d+$")
    return F.struct(
        F.when(yes, "noul").when(score, "score").otherwise("choice").alias("type"), F.when(yes, label == "yes").alias("noul"),
        F.when(~yes & score, label.try_cast("int")).alias("score"), F.when(~yes & ~score, label).alias("choice"),
    )


def classifier_heads(request: Column) -> Column:
    """A decision request as the heads of a label classifier: name to struct (labels, prompt); choices are labels that carry their criteria, a score counts its criteria, a noul is yes or no. Null where a question has nothing to choose from."""
    kinds = "questions map<string,struct<type:string,instructions:string,criteria:string>>"
    q = F.from_json(request, kinds)["questions"]

    def labels(s: Column) -> Column:
        levels = F.from_json(s["criteria"], "array<string>")
        scale = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(levels) - 1), lambda i: i.cast("string")), levels)
        choice = F.from_json(s["criteria"], "map<string,string>")
        return F.when(s["type"] == "noul", F.create_map(F.lit("yes"), F.lit("yes"), F.lit("no"), F.lit("no"))).when(s["type"] == "choice", choice).when((s["type"] == "score") & (F.size(levels) > 0), scale)

    heads = F.transform_values(q, lambda k, s: F.struct(labels(s).alias("labels"), s["instructions"].alias("prompt")))
    sound = F.forall(F.map_values(heads), lambda h: F.coalesce(F.size(h["labels"]) > 0, F.lit(False)))
    return F.when((F.size(q) > 0) & sound, heads)


def reply_content(body: Column) -> Column:
    """Struct (content, fault) of a chat completion's JSON: the first choice's text, the reasoning's where that is null, or why there is none."""
    kinds = "choices array<struct<finish_reason:string,message:struct<content:string,reasoning_content:string>>>"
    p = F.from_json(body, kinds)
    message = F.get(p["choices"], F.lit(0))["message"]
    own = F.coalesce(message["content"], F.nullif(message["reasoning_content"], F.lit("")))
    fault = (
        F.when(p.isNull() | ~F.startswith(F.ltrim(body), F.lit("{")), "response was not a JSON object").when(F.coalesce(F.size(p["choices"]), F.lit(0)) <= 0, "response has no 'choices' array")
        .when(message.isNull(), "response 'choices[0]' has no 'message' object").when(own.isNull(), "response message has no 'content'")
    )
    return F.struct(F.when(fault.isNull(), own).alias("content"), fault.alias("fault"))


def server_block(reply: Column) -> Column:
    """A server's own account of a call by name; null where it gave none, and fields it lacks stay null."""
    p = F.from_json(reply, SERVER)
    u, t = p["usage"], p["timings"]
    block = F.struct(
        u["prompt_tokens"].alias("prompt_tokens"), u["prompt_tokens_details"]["cached_tokens"].alias("cached_tokens"), u["completion_tokens"].alias("completion_tokens"), t["prompt_ms"].alias("prompt_ms"), t["prompt_n"].alias("prompt_n"),
        t["prompt_per_second"].alias("prompt_tokens_per_second"), t["predicted_ms"].alias("predicted_ms"), t["predicted_n"].alias("predicted_n"), t["predicted_per_second"].alias("predicted_tokens_per_second"), t["cache_n"].alias("cache_n"),
    )
    return F.when(u.isNotNull() | t.isNotNull(), block)


def residual_seconds(seconds: Column, block: Column) -> Column:
    """Seconds of a call that its server does not account for; null without timings."""
    spent = (F.coalesce(block["prompt_ms"], F.lit(0.0)) + F.coalesce(block["predicted_ms"], F.lit(0.0))) / 1000
    known = block["prompt_ms"].isNotNull() | block["predicted_ms"].isNotNull()
    return F.when(known, F.round(seconds - spent, 3))


def cache_served(block: Column, share: float = 0.9) -> Column:
    """Whether a server took most of a prompt from its cache; false without evidence."""
    fresh, reused = F.coalesce(block["prompt_n"], F.lit(0)), F.coalesce(block["cache_n"], block["cached_tokens"], F.lit(0))
    return F.coalesce((fresh + reused > 0) & (reused >= share * (fresh + reused)), F.lit(False))


def balanced(code: Column) -> Column:
    """Whether round brackets outside of quotes balance."""
    bare = F.regexp_replace(code, r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "")
    opened, closed = F.regexp_count(bare, F.lit(r"\(")), F.regexp_count(bare, F.lit(r"\)"))
    return opened == closed


def ulid(millis: Column, key: Column) -> Column:
    """A 26-character sortable id of a time and a key: the same for the same input, so a repeated task makes no new one."""
    digits = F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ")
    pick = lambda n: F.substring(digits, (n % 32 + 1).cast("int"), F.lit(1))
    head = F.concat(*[pick(F.shiftrightunsigned(millis.cast("long"), 5 * i)) for i in reversed(range(10))])
    tail = []
    for salt in (0, 1):
        h = F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit((1 << 60) - 1))
        tail += [pick(F.shiftrightunsigned(h, 5 * i)) for i in range(8)]
    return F.concat(head, *tail)
