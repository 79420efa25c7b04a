"""URL filtering by a trie over reversed host labels and path segments.

Rules are (host, path prefix, allow or block). A rule fits its host and every subdomain,
and every path that starts with its prefix, which may end inside a segment. Of the rules
that fit, the one with the most host labels wins, then the one with the longest path; of
two rules with the same host and path, block wins. Without a fitting rule the default
verdict holds.

The trie is built on the driver from at most `max_rules` rules and broadcast. A longer
list is cut into tries of that size, which are applied in turn over the small columns of
the URL only; the stronger match is kept at every step, so that the verdict doesn't
depend on the cut.

Defined cases: a null URL, or one without `://`, has an empty host and an empty path and
gets the default; repeated pages keep a row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 500_000
_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Trie:
    """Host nodes are nested dicts by label from the right; a node's None entry is its path trie.

    A path node is [segments, partial, lengths, rule]: whole segments lead to child nodes,
    partial has the last, possibly unfinished, segment of rules that end there.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            path = node.setdefault(None, [{}, {}, ()])
            *whole, last = rule.path.split("/")
            for segment in whole:
                path = path[0].setdefault(segment, [{}, {}, ()])
            old = path[1].get(last)
            if old is None or rule.verdict == "block":
                path[1][last] = rule
            path[2] = tuple(sorted({len(x) for x in path[1]}, reverse=True))

    def hosts(self, host: str) -> list[tuple[int, list]]:
        """(labels, path trie) of the rules' hosts that cover this one, the most labels first."""
        out, node = [], self.root
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                out.append((depth, node[None]))
        return out[::-1]

    @staticmethod
    def longest(node: list, path: str) -> Rule | None:
        best, at = None, 0
        while node is not None:
            end = path.find("/", at)
            segment = path[at:] if end < 0 else path[at:end]
            for n in node[2]:
                if n <= len(segment) and segment[:n] in node[1]:
                    best = node[1][segment[:n]]
                    break
            if end < 0:
                break
            node, at = node[0].get(segment), end + 1
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host and path."""
    m = _SPLIT.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def _judge(trie, url: str, default: str, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            keep = [c for c in batch.schema.names if c not in (url, "host", "path", "rule", "verdict", "__labels", "__path")]
            if first:
                parts = [split_url(x) for x in batch.column(url).to_pylist()]
                best = [(None, default, 0, -1)] * len(parts)
            else:
                parts = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
                best = list(zip(*(batch.column(c).to_pylist() for c in ("rule", "verdict", "__labels", "__path")), strict=True))
            for i, (host, path) in enumerate(parts):
                covers = known.get(host)
                if covers is None:
                    if len(known) > 100_000:
                        known.clear()
                    covers = known[host] = trie.value.hosts(host)
                for labels, node in covers:
                    rule = Trie.longest(node, path)
                    if rule is not None:
                        _, verdict, had, length = best[i]
                        if (labels, len(rule.path), rule.verdict == "block") > (had, length, verdict == "block"):
                            best[i] = (rule.name, rule.verdict, labels, len(rule.path))
                        break
            columns = [pa.array([x[k] for x in rows], kind) for rows, k, kind in ((parts, 0, pa.string()), (parts, 1, pa.string()), (best, 0, pa.string()), (best, 1, pa.string()), (best, 2, pa.int32()), (best, 3, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, "host", "path", "rule", "verdict", "__labels", "__path"])

    return run


def judge_urls(pages: DataFrame, rules: Iterable[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """key, host, path, rule (null where none fits) and verdict of every row."""
    rules = list(rules)
    context = pages.sparkSession.sparkContext
    out, schema = pages.select(key, url), f"`{key}` {dict(pages.dtypes)[key]}, host string, path string, rule string, verdict string, __labels int, __path int"
    for at in range(0, max(1, len(rules)), max_rules):
        out = out.mapInArrow(_judge(context.broadcast(Trie(rules[at : at + max_rules])), url, default, at == 0), schema)
    return out.drop("__labels", "__path")


def filter_urls(pages: DataFrame, rules: Iterable[Rule], *, url: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """Rows of pages whose URL is allowed, with their columns as they were."""
    names = [f"__{i}" for i in range(len(pages.columns))]
    rules, out = list(rules), pages.toDF(*names)
    schema = ", ".join([*(f"{n} {kind}" for n, kind in out.dtypes), "host string, path string, rule string, verdict string, __labels int, __path int"])
    at_url = names[pages.columns.index(url)]
    out = out.withColumn("__url", F.col(at_url))
    for at in range(0, max(1, len(rules)), max_rules):
        out = out.mapInArrow(_judge(pages.sparkSession.sparkContext.broadcast(Trie(rules[at : at + max_rules])), "__url", default, at == 0), schema)
    return out.where("verdict = 'allow'").select(*names).toDF(*pages.columns)
