"""URL filters by a trie over reversed host labels and path segments.

Rules are compiled to a trie whose first levels are the labels of the host
from the right (``www.example.com`` is com, example, www) and whose next
levels are the segments of the path. A url walks down once; the deepest rule
that it passes wins, so an allow entry below a block entry prevails and the
other way round. The trie is broadcast: its size is that of the rule list,
which is checked against :data:`MAX_RULES`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

#: Most rules that are broadcast; a longer list is refused, never cut.
MAX_RULES = 1_000_000
#: (action, host, path) of the production rule list.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_END = ""


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where ``://`` is absent."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return host.translate(_LOWER), tail[:stop]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Trie:
    """Longest-match trie. A node maps a label or segment to a node; under "/" hang the path levels.

    A rule's path holds whole segments, each with its slash, and perhaps a
    last one that is only a beginning; the latter are kept with their node as
    text to compare, longest first.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        count = 0
        for action, host, path in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"unknown action {action!r}")
            count += 1
            if count > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node.setdefault(("h", label), {})
            whole, _, start = path.rpartition("/") if "/" in path else ("", "", path)
            for segment in whole.split("/") if "/" in path else ():
                node = node.setdefault(("p", segment), {})
            node.setdefault(_END, {})[start] = (f"{host}{path}", action)
        self._sort(self.root)

    def _sort(self, top: dict) -> None:
        todo = [top]
        while todo:
            node = todo.pop()
            for key, value in node.items():
                if key == _END:
                    node[key] = dict(sorted(value.items(), key=lambda x: -len(x[0])))
                else:
                    todo.append(value)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest rule that fits: the longest host, then the longest path."""
        found, node = None, self.root
        found = self._path(node, path) or found
        if host:
            for label in reversed(host.split(".")):
                node = node.get(("h", label))
                if node is None:
                    break
                found = self._path(node, path) or found
        return found

    def _path(self, node: dict, path: str) -> tuple[str, str] | None:
        found, rest = None, path
        while node is not None:
            for start, rule in node.get(_END, {}).items():
                if rest.startswith(start):
                    found = rule
                    break
            segment, sep, rest = rest.partition("/")
            node = node.get(("p", segment)) if sep else None
        return found


def judge(urls: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) of each row's url.

    Urls that are null or lack ``://`` have an empty host and path; urls that
    no rule fits have a null rule and the ``default`` verdict. Repeated rows
    and null ids yield one row each; other columns are not carried.
    """
    spark = urls.sparkSession
    trie = spark.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [trie.value.match(h, p) or (None, default) for h, p in parts]
            columns = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], [v for _, v in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["id", "host", "path", "rule", "verdict"])

    kept = urls.select(urls[id_col].alias("id"), urls[url_col].alias("url"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages"), RULES)
