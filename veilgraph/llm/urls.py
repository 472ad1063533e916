"""URL filters: a trie over reversed host labels and path segments.

A rule is a host and a path prefix. The host's labels, last first, lead to a node; from there the
prefix's whole segments lead on, and what follows its last slash is kept at the node as a beginning that
the url's next characters must have. The deepest rule on a url's way wins: more host labels first, then the longer path prefix;
of an allow and a block rule for the same place the block wins. The trie holds the rules only (a list
the caller gives), so it is broadcast with the function whatever the table's size.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased (a port
or user name is part of its labels); the path goes on to ``?``, ``#`` or the end. Without ``://``, or
for null, both are empty. A url that no rule fits gets the default verdict and a null rule.

Cases: repeated rows and null ids each get a result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.plans.workspace import bounded_batches, freeing

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


class Node:
    """A label or a segment: what follows it, and rules that end in it by what must still follow."""

    __slots__ = ("next", "ends")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}


class Trie:
    """Rules (verdict, host and path prefix) by reversed host labels and path segments."""

    def __init__(self, rules):
        self.hosts: dict = {}
        for verdict, rule in rules:
            host, slash, rest = rule.partition("/")
            at = self.hosts
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                at = at.setdefault(label, {})
            node = at.setdefault(None, Node())
            *whole, partial = (slash + rest).split("/") if slash else [""]
            for segment in whole:
                node = node.next.setdefault(segment, Node())
            if node.ends.get(partial, ("",))[0] != "block":
                node.ends[partial] = (verdict, rule)

    @staticmethod
    def _path(node: Node, path: str):
        """The longest rule below a host's node that the path starts with."""
        best, at = None, 0
        while node is not None:
            for partial, found in sorted(node.ends.items(), key=lambda x: len(x[0])):
                if path.startswith(partial, at):
                    best = found
            cut = path.find("/", at)
            if cut < 0:
                return best
            node, at = node.next.get(path[at:cut]), cut + 1
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, self.hosts
        if None in at:
            best = self._path(at[None], path)
        for label in reversed(host.split(".")) if host else ():
            at = at.get(label)
            if at is None:
                break
            if None in at:
                best = self._path(at[None], path) or best
        return best


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


#: Bytes of rules, pickled, that are broadcast at most: they are a list that people keep, not a table that grows with the corpus.
MOST_BYTES = 256 << 20


def _judge(shared, default: str):
    def judge(batches):
        trie = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [trie.find(*p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in ([p[0] for p in parts], [p[1] for p in parts], [f and f[1] for f in found], [f[0] if f else default for f in found]))],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return judge


def judge(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``."""
    rules = list(rules)
    if sum(len(rule) + 64 for _, rule in rules) > MOST_BYTES:
        raise ValueError(f"the rules' trie is broadcast and takes at most {MOST_BYTES} bytes of rules")
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    bounded_batches(pages.sparkSession, records=10_000)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(
        freeing(_judge(shared, default)), "page_id long, host string, path string, rule string, verdict string"
    )


SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), rules(verdict, host, path, labels) AS (
  VALUES ('allow', 'org', '/', 1), ('block', 'example.org', '/es/', 2), ('block', 'example.org', '/en/1', 2), ('allow', 'com', '/fr/', 1), ('block', 'com', '/de/', 1)
), fits AS (
  SELECT s.page_id, arg_max(r.host || r.path, r.labels * 1000 + length(r.path)) AS rule,
         arg_max(r.verdict, r.labels * 1000 + length(r.path)) AS verdict
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY s.page_id
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id
"""
