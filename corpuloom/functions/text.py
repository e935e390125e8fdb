"""Column functions over text. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quote(text: str) -> str:
    """A Java regex that matches exactly ``text``."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


# --- Paths


def display(raw: Column) -> Column:
    """Display form of raw path bytes: U+FFFD where they aren't UTF-8."""
    return F.make_valid_utf8(raw.cast("string"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def under(path: Column, folder: str) -> Column:
    """Whether a path lies below ``folder``: a range in byte order, which a scan can prune by."""
    return (path >= folder + "/") & (path < folder + "/￿")


def _rooted(path: Column) -> Column:
    return F.concat(F.lit("/"), F.ltrim(F.lower(path), F.lit("/")))


def is_vendored(path: Column) -> Column:
    p = _rooted(path)
    return any_of([F.contains(p, F.lit(m)) for m in fixed.VENDORED_MARKERS])


def ending(path: Column) -> Column:
    """The file name's last suffix, lower-cased; '' without one. A leading dot starts no suffix."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def non_prose_ending(path: Column) -> Column:
    """The longest listed ending of a path that marks it as not prose; null if none does."""
    low = F.lower(path)
    longest = sorted(fixed.NON_PROSE_ENDINGS, key=lambda e: (-len(e), e))
    return F.coalesce(*[F.when(F.endswith(low, F.lit(e)), F.lit(e)) for e in longest])


def provenance(path: Column) -> Column:
    """vendored, documentation, markup, code, data, prose or other, the first that holds; a byte range is ignored."""
    bare = F.coalesce(F.regexp_extract(path, r"(?s)^(.*?)(?:#L.*)?$", 1), F.lit(""))
    suffix = ending(bare)
    return (
        F.when(is_vendored(bare), "vendored")
        .when(any_of([F.contains(_rooted(bare), F.lit(m)) for m in fixed.DOCUMENTATION_MARKERS]), "documentation")
        .when(suffix.isin(*fixed.MARKUP_ENDINGS), "markup")
        .when(suffix.isin(*fixed.CODE_ENDINGS), "code")
        .when(suffix.isin(*fixed.DATA_ENDINGS), "data")
        .when(suffix.isin("", *fixed.PROSE_ENDINGS), "prose")
        .otherwise("other")
    )


def provenance_label(path: Column) -> Column:
    """What a hit line shows: null for prose."""
    return F.nullif(provenance(path), F.lit("prose"))


# --- Prose


def _hits(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def prose_score(text: Column, digits: int = 4) -> Column:
    """0 to 1: how much a passage reads as written to be read. Blank and null texts score 0.

    Five shares, each capped: letters, spaces, little code punctuation, few
    digits, and sentence ends per word.
    """
    size = F.length(text).cast("double")
    marks = "[" + "".join("\\" + c for c in fixed.CODE_PUNCTUATION) + "]"
    words = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"(?U)\S+"))).cast("double")
    ends = F.regexp_count(text, F.lit(r"(?U)[.!?][\"')\]]?\s")) + F.when(F.regexp_replace(text, r"(?U)\s+\z", "").rlike(r"[.!?]\z"), 1).otherwise(0)
    one = F.lit(1.0)
    total = (
        F.lit(0.35) * F.least(one, _hits(text, r"\p{L}") / size / F.lit(0.75))
        + F.lit(0.25) * F.least(one, _hits(text, " ") / size / F.lit(0.14))
        + F.lit(0.25) * (one - F.least(one, _hits(text, marks) / size / F.lit(0.02)))
        + F.lit(0.05) * (one - F.least(one, _hits(text, r"\p{Nd}") / size / F.lit(0.05)))
        + F.lit(0.10) * F.least(one, ends / words / F.lit(0.06))
    )
    blank = text.isNull() | ~text.rlike(r"(?U)\S")
    return F.when(blank, 0.0).otherwise(F.round(F.least(one, F.greatest(F.lit(0.0), total)), digits))


def looks_like_prose(text: Column, floor: float = fixed.PROSE_FLOOR) -> Column:
    return prose_score(text) >= floor


# --- Search terms


def fold(text: Column) -> Column:
    """Lower case without diacritics, by decomposition to base letters for Latin letters with marks."""
    return F.regexp_replace(F.translate(F.lower(text), *_marks()), r"\p{M}", "")


def _marks() -> tuple[str, str]:
    import unicodedata

    found = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(code).lower())
        if len(base) > 1 and all(unicodedata.category(x) == "Mn" for x in base[1:]) and chr(code) == chr(code).lower():
            found.append((chr(code), base[0]))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters and numbers of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def content_terms(question: Column) -> Column:
    """A question's terms of three characters or more that are no stopwords, in order, once each."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(r"(?U)([\wÀ-ɏ]+)"), F.lit(1))
    stop = F.array(*map(F.lit, fixed.QUESTION_STOPWORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def term_coverage(text: Column, terms: Column) -> Column:
    """How many of ``terms`` start a word of the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(terms, lambda t: F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), t, F.lit(r"\E")))))


def match_quality(covered: Column, total: Column) -> Column:
    """strong, partial, weak, none, or unknown where a question has no terms."""
    strong = (covered >= total) | (covered >= F.greatest(F.lit(2.0), F.lit(fixed.STRONG_SHARE) * total))
    return F.when(total <= 0, "unknown").when(covered <= 0, "none").when(strong, "strong").when(covered >= 2, "partial").otherwise("weak")


BAND_RANK = {"strong": 0, "partial": 1, "weak": 2, "none": 3, "unknown": 4}


def band_rank(band: Column) -> Column:
    return F.coalesce(*[F.when(band == b, F.lit(r)) for b, r in BAND_RANK.items()], F.lit(5))


def match_note(covered: Column, total: Column) -> Column:
    """A line that states the band and the numbers behind it."""
    band = match_quality(covered, total)
    said = F.format_string("[match quality: %s: the best hit covers %d of %d content words of the question]", band, covered, total)
    return F.when(band == "unknown", "[match quality: unknown: the question has no content words]").when(
        band == "none", F.format_string("[match quality: none: no hit holds any of the %d content words of the question]", total)
    ).otherwise(said)


# --- Titles, summaries, slugs


def title(body: Column) -> Column:
    """The heading that a text begins with; else its first line if longer than four characters; else 'untitled'. At most 256 characters."""
    own = _bare(body)
    heading = _bare(F.regexp_extract(own, r"^#+\s+([^\n]+)", 1))
    first = _bare(F.split_part(own, F.lit("\n"), F.lit(1)))
    best = F.when(heading != "", heading).when(F.length(first) > 4, first).otherwise("untitled")
    return F.substring(best, 1, 256)


def summary(body: Column) -> Column:
    """The first sentence of a text less its first heading line, at most 200 characters."""
    own = _bare(body)
    rest = _bare(F.regexp_replace(own, r"\A#+[ \t]+[^\n]*\n", ""))
    rest = F.when(rest == "", own).otherwise(rest)
    sentence = _bare(F.regexp_extract(rest, r"[^.!?\n]+[.!?]?", 0))
    return F.substring(F.when(sentence != "", sentence).otherwise(rest), 1, 200)


def _bare(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def capitalised(text: Column) -> Column:
    """Words of an upper-case and two or more lower-case ASCII letters, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][a-z]{2,})\b"), F.lit(1))


def keywords(body: Column) -> Column:
    """The first five capitalised words, those of headings first, lower-cased and once each."""
    heads = F.concat_ws(" ", F.regexp_extract_all(body, F.lit(r"(?m)^#+[ \t]+(.+)$"), F.lit(1)))
    found = F.concat(capitalised(heads), capitalised(body))
    return F.slice(F.array_distinct(F.transform(found, lambda w: F.lower(w))), 1, 5)


def slug(text: Column) -> Column:
    """Slug of a note: other characters dropped, spaces to hyphens, 64 characters."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", "")
    cut = F.substring(F.regexp_replace(F.trim(kept), r"\s+", "-"), 1, 64)
    out = F.regexp_replace(cut, r"^-+|-+$", "")
    return F.when(out == "", "untitled").otherwise(out)


def ingest_slug(text: Column) -> Column:
    """Slug of an ingested file: each run of other characters one hyphen."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 64)


def question_slug(text: Column) -> Column:
    """Slug of a question's id: letters, digits, hyphens and underscores of any script kept; 'question' if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_-]", "-"), r"^-+|-+$", "")
    return F.when(kept == "", "question").otherwise(kept)


def quarantine_summary(body: Column) -> Column:
    """The first line that is neither empty nor a comment, at most 200 characters."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.substring(F.coalesce(F.get(kept, F.lit(0)), F.lit("")), 1, 200)


# --- Cleaning


def markup_to_text(markup: Column) -> Column:
    """Tags to spaces, the five named entities to characters, white space collapsed."""
    text = F.regexp_replace(markup, r"<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def squeeze(text: Column, size: int | None = None) -> Column:
    """White space collapsed to single spaces and trimmed, cut to ``size`` characters."""
    out = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return out if size is None else F.substring(out, 1, size)


def plain_quotes(text: Column) -> Column:
    return F.translate(text, "“”„‘’‚", "\"\"\"'''")


def needle(text: Column) -> Column:
    """Folded quotes, dashes as spaces, white space collapsed, lower case: for comparing passages."""
    return F.lower(squeeze(F.regexp_replace(plain_quotes(text), r"[-‐-―]", " ")))


def smart_quotes(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[“”„‘’‚]"))


def truncate_middle(text: Column, most: int) -> Column:
    """Head and tail of a long text with a note of what is left out."""
    head, tail = most // 2, most - most // 2
    cut = F.length(text) - most
    return F.when(cut <= 0, text).otherwise(F.concat(F.substring(text, 1, head), F.format_string("\n... [%d characters left out] ...\n", cut), F.right(text, F.lit(tail))))


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, empty ones dropped."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def fixed_chunks(text: Column, size: int = 3000) -> Column:
    """Pieces of ``size`` characters; none of an empty text."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))


# --- Summaries' measures


def content_words(text: Column) -> Column:
    """Distinct lower-case words of four characters or more without outer punctuation, stopwords dropped."""
    edges = "[" + "".join("\\" + c for c in fixed.WORD_EDGES) + "]+"
    words = F.transform(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.regexp_replace(w, rf"\A{edges}|{edges}\z", ""))
    stop = F.array(*map(F.lit, fixed.SUMMARY_STOPWORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= fixed.SUBJECT_LETTERS) & w.rlike(r"[\p{L}\p{N}]") & ~F.array_contains(stop, w)))


def groundedness(text: Column, source: Column) -> Column:
    """Share of a text's content words that the source contains as substrings; 0 without words."""
    words, low = content_words(text), F.lower(source)
    found = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.when(F.size(words) > 0, found / F.size(words)).otherwise(0.0)


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(text)
    return any_of([F.contains(low, F.lit(p)) for p in phrases])


def is_boilerplate(text: Column) -> Column:
    return contains_any(text, fixed.BOILERPLATE)


def cap_hit(tokens_out: Column, most: Column) -> Column:
    return tokens_out >= F.lit(0.9) * most


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


# --- Replies of models


def code_blocks(text: Column) -> Column:
    """Bodies of closed code fences; where none is closed, what follows an open one."""
    closed = F.regexp_extract_all(text, F.lit(r"(?s)```(?:python|repl|py)?[ \t]*\n(.*?)```"), F.lit(1))
    rescued = F.regexp_extract(text, r"(?s)```(?:python|repl|py)?[ \t]*\n(.*)$", 1)
    return F.when(F.size(closed) > 0, closed).when(rescued != "", F.array(rescued)).otherwise(F.array().cast("array<string>"))


def final_line(text: Column) -> Column:
    """What follows FINAL: at the start of a line; null if absent."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^\s*FINAL:\s*(.+)$", 1)), F.lit(""))


def reply_stage(text: Column) -> Column:
    """blocks, rescued, final or nudge: what a reply amounts to."""
    closed = text.rlike(r"(?s)```(?:python|repl|py)?[ \t]*\n.*?```")
    opened = text.rlike(r"```(?:python|repl|py)?[ \t]*\n")
    return F.when(closed, "blocks").when(opened, "rescued").when(final_line(text).isNotNull(), "final").otherwise("nudge")


def error_kind(stderr: Column) -> Column:
    """The last word that ends in Error, Exception, Warning or Interrupt; else the last line."""
    found = F.regexp_extract_all(stderr, F.lit(r"(\w+(?:Error|Exception|Warning|Interrupt))"), F.lit(1))
    lines = F.filter(F.split(stderr, "\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(F.coalesce(F.trim(F.try_element_at(lines, F.lit(-1))), F.lit("")))


def section(text: Column, heading: str) -> Column:
    """Code of the fence below ``## heading``; null if absent."""
    return F.nullif(F.regexp_extract(text, rf"(?is)##\s*{quote(heading)}\s*\n+```[a-z]*\n(.*?)```", 1), F.lit(""))


def slots(text: Column) -> Column:
    """Names in braces of a template, in order."""
    return F.regexp_extract_all(text, F.lit(r"\{([A-Za-z_]\w*)\}"), F.lit(1))


def citations(text: Column) -> Column:
    """Items of a citation list, split at semicolons and commas, trimmed and once each."""
    parts = F.transform(F.split(text, "[;,]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def with_citations(answer: Column, items: Column) -> Column:
    """An answer with a line of citations at its end, unless it has none."""
    return F.when(F.size(items) > 0, F.concat(F.regexp_replace(answer, r"\s+$", ""), F.lit("\n\nCitations: "), F.concat_ws("; ", items))).otherwise(answer)


def addresses(text: Column) -> Column:
    """Whole addresses (path#Lstart-end) in prose, once each in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({fixed.ADDRESS_TOKEN})"), F.lit(1)))


def usage_addresses(text: Column) -> Column:
    """Addresses by the usage reader's wider pattern."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({fixed.USAGE_ADDRESS})"), F.lit(1)))


def address_parts(address: Column) -> Column:
    """(source, byte_start, byte_end) of an address; nulls where it is none."""
    part = lambda i: F.nullif(F.regexp_extract(address, fixed.ADDRESS, i), F.lit(""))
    return F.struct(part(1).alias("source"), part(2).cast("long").alias("byte_start"), part(3).cast("long").alias("byte_end"))


def wikilinks(body: Column) -> Column:
    """Targets of [[target|alias#section]], trimmed, not empty, once each."""
    raw = F.regexp_extract_all(body, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    names = F.transform(raw, lambda x: F.trim(F.split_part(F.split_part(x, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1))))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def merge_tags(tags: Column, extra: Column) -> Column:
    """Explicit tags in order, then the lower-cased others that are new."""
    return F.array_union(F.array_distinct(tags), F.transform(extra, lambda x: F.lower(x)))


def retag(tags: Column, add: Column, remove: Column) -> Column:
    return F.array_sort(F.array_except(F.array_union(tags, add), remove))


# --- Time


def instant(text: Column) -> Column:
    """Epoch seconds (double) of an ISO-8601 time or a number; null if neither."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)).cast("double") / 1e6)


def duration(text: Column) -> Column:
    """Seconds of 90, 90s, 30m or 2h; negative ones count as 0; null if malformed."""
    number = F.regexp_extract(F.trim(text), r"^(-?\d+(?:\.\d+)?)\s*([smh]?)$", 1).try_cast("double")
    unit = F.regexp_extract(F.trim(text), r"^(-?\d+(?:\.\d+)?)\s*([smh]?)$", 2)
    seconds = number * F.when(unit == "h", 3600.0).when(unit == "m", 60.0).otherwise(1.0)
    return F.when(seconds < 0, 0.0).otherwise(seconds)


def age_said(seconds: Column) -> Column:
    """'45s ago', '12min ago', '3.5h ago'."""
    return F.when(seconds < 60, F.format_string("%ds ago", seconds.cast("long"))).when(seconds < 3600, F.format_string("%dmin ago", F.floor(seconds / 60))).otherwise(F.format_string("%.1fh ago", seconds / 3600))


def decay(age_seconds: Column, accesses: Column) -> Column:
    """exp(-age / (one day * (1 + ln(1 + accesses)))); 1 for an unknown or negative age."""
    age = F.greatest(F.coalesce(age_seconds, F.lit(0.0)), F.lit(0.0))
    return F.exp(-age / (F.lit(86400.0) * (F.lit(1.0) + F.log(F.lit(1.0) + F.coalesce(accesses, F.lit(0)).cast("double")))))


def md5_split(task: Column, percent: int = 70) -> Column:
    """'train' for md5(name) mod 100 below ``percent``, else 'held_out': long division over the hex digits."""
    digits = F.transform(F.split(F.md5(task.cast("binary")), ""), lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1)
    digits = F.filter(digits, lambda d: d >= 0)
    rest = F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + d) % 100)
    return F.when(rest < percent, "train").otherwise("held_out")


def next_at(now: Column, clock: str) -> Column:
    """The next time after ``now`` at which clocks show HH:MM or HH:MM:SS."""
    h, m, s = ([int(x) for x in clock.split(":")] + [0])[:3]
    today = F.timestamp_add("SECOND", F.lit(3600 * h + 60 * m + s), F.date_trunc("day", now))
    return F.when(today > now, today).otherwise(F.timestamp_add("DAY", F.lit(1), today))


def migrated_head(content: Column) -> Column:
    """A page whose head's first ``schema:`` line is ``schema_version:``, or is gone if the head has that key already; all other bytes stay. A page without a head or that key is as it was."""
    head = r"(?s)\A(---\s*\n)(.*?)\n---\s*\n"
    before, block = F.regexp_extract(content, head, 1), F.regexp_extract(content, head, 2)
    renamed = F.regexp_replace(block, r"(?s)\A(.*?\n)??schema:", "$1schema_version:")
    dropped = F.when(block.startswith("schema:"), F.regexp_replace(block, r"\Aschema:[^\n]*", "")).otherwise(F.regexp_replace(block, r"(?s)\A(.*?)\nschema:[^\n]*", "$1"))
    made = F.when(block.rlike(r"(?:\A|\n)schema_version:"), dropped).otherwise(renamed)
    rest = F.substr(content, F.length(before) + F.length(block) + 1)
    return F.when(content.rlike(head) & block.rlike(r"(?:\A|\n)schema:"), F.concat(before, made, rest)).otherwise(content)
