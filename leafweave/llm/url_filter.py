"""URL filter: a trie over reversed host labels and path segments, broadcast, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import bounded_batches

#: (verdict, rule): the rule is a host, then a path that begins with a slash.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Rules past this many bytes of text are refused: every executor holds the whole trie.
MAX_RULE_BYTES = 64 << 20

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Trie:
    """hosts: nested dicts by label, the last label first; at "" a node has the paths of the rules for its host.
    paths: nested dicts by whole segment (one that a slash ends); at "" a node has the rules that end there, as
    (rest, rule, verdict): rest is an unfinished segment. Longest rests come first."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"no verdict: {verdict}")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label or ".", {})
            *whole, rest = (slash + path).split("/")
            node = node.setdefault("", {})
            for segment in whole:
                node = node.setdefault((segment,), {})
            ends = node.setdefault("", [])
            if all(x[0] != rest for x in ends):  # of rules given twice the first holds
                ends.append((rest, rule, verdict))
                ends.sort(key=lambda x: -len(x[0]))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the rule with the longest host that fits, of these the one with the longest path."""
        at, paths = self.root, []
        for label in reversed(host.split(".")):
            at = at.get(label or ".")
            if at is None:
                break
            if "" in at:
                paths.append(at[""])
        segments = path.split("/") if paths else []
        for node in reversed(paths):
            best = None
            for depth in range(len(segments)):
                if "" in node:
                    for rest, rule, verdict in node[""]:
                        if segments[depth].startswith(rest):
                            best = rule, verdict
                            break
                if depth == len(segments) - 1:
                    break
                node = node.get((segments[depth],))
                if node is None:
                    break
            if best:
                return best
        return None


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty where it is null or has no `://`."""
    rest = (url or "").partition("://")[2]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule and verdict of each row of pages, without a shuffle.

    A rule fits its host and every subdomain if the url's path starts with the rule's path. The longest host wins,
    then the longest path; where no rule fits, rule is null and the verdict is `default`. Null urls and urls without
    `://` have an empty host and path and so fit no rule. Repeated rows are judged each by itself; other columns are
    not read. The rules are broadcast; their size is checked against MAX_RULE_BYTES first."""
    rules = list(rules)
    if sum(len(r) for _, r in rules) > MAX_RULE_BYTES:
        raise ValueError("too many rules to broadcast")
    Trie(rules)  # a rule that is none fails here
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value)
        for b in batches:
            urls = [split_url(u) for u in b.column(1).to_pylist()]
            found = [trie.match(*u) or (None, default) for u in urls]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in ([u[0] for u in urls], [u[1] for u in urls], [f[0] for f in found], [f[1] for f in found]))], names=[id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return bounded_batches(pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`").cast("string"))).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
