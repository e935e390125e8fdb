"""DuckDB SQL of the operators that SQL can express, by query."""

from __future__ import annotations

from . import quality_rules as q
from .substrings import LENGTH, PASSAGE



def _repeats(length: int, name: str) -> str:
    """CTEs up to spans: the maximal runs of bytes that repeated strings of a length cover."""
    return f"""starts{name} AS (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS i FROM d WHERE n >= {length}
), hashed{name} AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * length})) AS k FROM starts{name}
), common{name} AS (SELECT k FROM hashed{name} GROUP BY 1 HAVING count(*) > 1
), gone{name} AS (SELECT doc_id, i FROM hashed{name} SEMI JOIN common{name} USING (k)
), marked{name} AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {length} THEN 0 ELSE 1 END AS new FROM gone{name}
), runs{name} AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked{name}
), spans{name} AS (SELECT doc_id, run, min(i) AS a, max(i) + {length} AS b FROM runs{name} GROUP BY 1, 2
)"""


# words of bytes in hex: white space to _, other bytes to x, then runs of x
_WORDS = "len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(substr(h, 2 * a + 1, 2 * (b - a)), '(..)', '\\1 ', 'g'), '(20|09|0A|0B|0C|0D) ', '_', 'g'), '[0-9A-F]{2} ', 'x', 'g'), 'x+'))"
OP3 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), {_repeats(LENGTH, "")}, {_repeats(PASSAGE[0], "_short")}, passages AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_passage_bytes FROM (SELECT s.doc_id, a, b, {_WORDS} AS words FROM spans_short s JOIN d USING (doc_id)) WHERE words >= {PASSAGE[1]} GROUP BY 1
), edges AS (
  SELECT doc_id, b AS kept_from, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS kept_to FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY 1
), kept AS (
  SELECT e.doc_id, string_agg(substr(d.h, 2 * kept_from + 1, 2 * (coalesce(kept_to, d.n) - kept_from)), '' ORDER BY kept_from) AS h FROM edges e JOIN d USING (doc_id) GROUP BY 1
), sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256, coalesce(p.n_passage_bytes, 0) AS n_passage_bytes
FROM d LEFT JOIN sums s USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN passages p USING (doc_id)
"""
OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS s FROM w
), classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s
), rows AS (SELECT c, n, unnest(s) AS x FROM classes
), shared AS (
  SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS n_both FROM rows a JOIN rows b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
), linked AS (SELECT a, b FROM shared WHERE 100 * n_both >= 80 * (na + nb - n_both)
), links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach AS (SELECT c AS node, c AS low FROM classes UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node
), low AS (SELECT node, min(low) AS low FROM reach GROUP BY 1
), own AS (SELECT doc_id, len(s) AS n_shingles, list_sort(s) AS s FROM sets)
SELECT o.doc_id, o.n_shingles, CASE WHEN o.n_shingles = 0 THEN o.doc_id ELSE low.low END AS component_id, o.doc_id = CASE WHEN o.n_shingles = 0 THEN o.doc_id ELSE low.low END AS kept
FROM own o JOIN classes c ON c.s = o.s JOIN low ON low.node = c.c
"""
OP9 = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), rules(rule_host, rule_path, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.action,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule_host) DESC NULLS LAST, length(r.rule_path) DESC) AS place
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE place = 1
"""
OP10 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node
), low AS (SELECT node, min(low) AS component_id FROM reach GROUP BY 1)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, low.component_id, e.vec_id = low.component_id AS kept FROM embeddings e JOIN low ON low.node = e.vec_id
"""


_BAD = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))"
OP11 = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_BAD} = 0
), s AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, a.label AS own, b.r AS b, b.vec_id AS id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS place FROM s WHERE own = label QUALIFY place <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND s.own <> s.label AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5
"""


# the given pages hold one article of h1, p, b and br elements each; tests hold other pages against their known texts
OP12 = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '\s+', ' ', 'g') AS a FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(replace(a, '<br>', ' '), '</?b>', '', 'g'), '</?(h1|p)>', chr(10), 'g') AS b FROM a
), t AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(b, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""


def _op13(rounds: int = 6, entries: int = 16) -> str:
    away = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"

    def near(c: int) -> str:
        return f"a{c} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(d)::BIGINT AS d, min(e) FILTER (d = low) AS e FROM (SELECT *, min(d) OVER (PARTITION BY r, p) AS low FROM (SELECT r, part.p, x, e, {away} AS d FROM part JOIN c{c} ON c{c}.p = part.p)) GROUP BY 1, 2)"

    def mean(c: int) -> str:
        return f"""m{c} AS (SELECT p, e, list(y ORDER BY i) AS y FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)::DOUBLE)::BIGINT AS y FROM a{c}, unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL) GROUP BY 1, 2
), c{c + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{c}.y, c{c}.y) AS y FROM c{c} LEFT JOIN m{c} USING (p, e))"""

    steps = ", ".join(f"{near(c)}, {mean(c)}" for c in range(rounds))
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND {_BAD} = 0
), part AS MATERIALIZED (SELECT r, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS x FROM v, unnest(range(8)) u(p)
), c0 AS (SELECT p, r - 1 AS e, x AS y FROM part WHERE r <= {entries}
), {steps}, {near(rounds)}, told AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1
), books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS s FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT s FROM books) AS codebooks_sha256 FROM v JOIN told USING (r)
"""


OP13 = _op13()


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op8() -> str:
    prose = "[.,;:''\"()?!-]"
    mark = r"[#$%&*+/<=>@\[\]\\^_`{|}~]"
    counts = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", prose, mark, r"[\x00-\x08\x0E-\x1F\x7F]", r"[^\x00-\x7F]"]
    # white space within the control range counts as white space
    classes = ", ".join(f"len(regexp_extract_all(t, '{c}'))" for c in counts)
    common = ", ".join(map(_lit, q.COMMON))
    n = len(q.COMMON)

    def share(x: str) -> str:
        return f"list_transform({x}, lambda x: x / list_sum({x}))"

    def m(x: str, skip: int) -> str:  # lower, upper and other letters as one, then the classes between them
        return f"list_concat([{x}[{skip + 1}] + {x}[{skip + 2}] + {x}[{skip + 8}]], {x}[{skip + 3}:{skip + 7}])"

    def js(p: str, r: str) -> str:
        return f"sqrt(greatest(0, least(1, list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / (({p}[i] + {r}[i]) / 2)) ELSE 0 END + CASE WHEN {r}[i] > 0 THEN {r}[i] * log2({r}[i] / (({p}[i] + {r}[i]) / 2)) ELSE 0 END)) / 2)))"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1
), windows AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) > 8
), keyed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 7], ' ')) AS n FROM windows
), covered AS (SELECT doc_id, least(8, lead(i, 1, i + 8) OVER (PARTITION BY doc_id ORDER BY i) - i) AS n FROM keyed WHERE n > 1
), repeated AS (SELECT doc_id, sum(n) AS n_repeat_words FROM covered GROUP BY 1
), base AS (
  SELECT doc_id, lang, t, words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id)
), judged AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, [{classes}] AS c FROM base
), common AS (SELECT unnest([{common}]) AS w, unnest(range(1, {n + 1})) AS place
), said AS (SELECT doc_id, trim(lower(unnest(words)), {_lit(q._TRIM)}) AS w FROM judged
), hits AS (SELECT doc_id, place, count(*) AS n FROM said JOIN common USING (w) GROUP BY 1, 2
), maps AS (SELECT doc_id, map_from_entries(list((place, n))) AS m, sum(n) AS total FROM hits GROUP BY 1
), hist AS (
  SELECT j.*, list_transform(c, lambda x: x / list_sum(c)) AS cp,
    list_append(list_transform(range(1, {n + 1}), lambda i: coalesce(m[i], 0) / n_words), (n_words - coalesce(total, 0)) / n_words) AS wp FROM judged j LEFT JOIN maps USING (doc_id)
), long AS (SELECT lang, unnest(list_concat([1e-6], cp, wp)) AS v, unnest(range(0, {len(q.CLASSES) + n + 2})) AS place FROM hist WHERE NOT base_failed AND n_words >= {q.GUARD_WORDS} AND length(t) >= {q.GUARD_CHARS}
), sums AS (SELECT lang, place, sum(round_even(v * 1e6, 0)) AS s FROM long GROUP BY 1, 2
), refs AS (SELECT lang, list(s ORDER BY place) AS s FROM sums GROUP BY 1
), every AS (SELECT list(s ORDER BY place) AS s FROM (SELECT place, sum(s) AS s FROM sums GROUP BY 1)
), asked AS (SELECT lang, s, {m("s", 1)} AS p, (SELECT {m("s", 1)} FROM every) AS r FROM refs WHERE s[1] >= {q.MIN_DOCS}
), near_refs AS (SELECT lang, s FROM (SELECT lang, s, {share("p")} AS p, {share("r")} AS r FROM asked) WHERE {js("p", "r")} <= {q.MAX_MERGED_DISTANCE} ORDER BY s[1] DESC, lang LIMIT {q.MAX_REFERENCES}
), kept_refs AS (SELECT lang, s[2:{len(q.CLASSES) + 1}] AS cs, s[{len(q.CLASSES) + 2}:] AS ws FROM near_refs
), shares AS (SELECT {share("cs")} AS cr, {share("ws")} AS wr, {share(m("cs", 0))} AS mr FROM kept_refs
), far AS (SELECT doc_id, min({js("cp", "cr")}) AS by_class, min({js("wp", "wr")}) AS by_word, min({js("mp", "mr")}) AS by_merged FROM (SELECT *, {m("cp", 0)} AS mp FROM hist), shares WHERE n_words > 0 GROUP BY 1
), told AS (
  SELECT h.*, CASE WHEN list_sum(c) < {q.GUARD_CHARS} THEN NULL WHEN k.known THEN by_class ELSE by_merged END AS cd, CASE WHEN k.known AND n_words >= {q.GUARD_WORDS} THEN by_word END AS wd, CASE WHEN k.known THEN {q.MAX_CLASS_DISTANCE} ELSE {q.MAX_MERGED_DISTANCE} END AS most
  FROM hist h LEFT JOIN far USING (doc_id) LEFT JOIN (SELECT lang, true AS known FROM kept_refs) k ON h.lang IS NOT DISTINCT FROM k.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd <= most, true) AND coalesce(wd <= {q.MAX_WORD_DISTANCE}, true) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM told
"""


OP8 = _op8()
