"""URL filter rules by sort-merge range join.

A host's labels are reversed (blog.example.net: net.example.blog.), so a host and its subdomains form one
interval of keys, and the intervals of rules nest or lie apart. Each partition is sorted by key and swept
once beside the sorted rules, with a stack of the rules whose interval is open; a url's verdict is the
longest open rule whose path begins its path. No row is exchanged, so a host with a third of all pages
stays spread over the partitions it came in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ship

#: Rules sent to the tasks at a time; more are matched block by block and the longer match kept.
RULES_AT_ONCE = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def key(self) -> str:
        return ".".join(reversed(self.host.split("."))) + "."

    @property
    def reach(self) -> tuple[int, int, str]:
        """What makes a rule win: the longest text, then the longest host."""
        return len(self.name), len(self.host), self.name


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Sweep:
    """Walks keys in ascending order beside the rules, keeping the stack of open intervals."""

    def __init__(self, rules: Sequence[Rule]):
        grouped: dict[str, list[Rule]] = {}
        for r in rules:
            grouped.setdefault(r.key, []).append(r)
        self.todo = sorted(grouped.items())
        self.at = 0
        self.stack: list[tuple[str, list[Rule]]] = []

    def match(self, key: str, path: str) -> Rule | None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        while self.at < len(self.todo) and self.todo[self.at][0] <= key:
            begin, rules = self.todo[self.at]
            self.at += 1
            while self.stack and not begin.startswith(self.stack[-1][0]):
                self.stack.pop()
            if key.startswith(begin):
                self.stack.append((begin, rules))
        fits = [r for _, rules in self.stack for r in rules if path.startswith(r.path)]
        return max(fits, key=lambda r: r.reach, default=None)


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule and verdict of each url.

    Of the rules that fit, the one of the longest text (host and path) wins, then the longest host. Of
    rules equal in host and path the last given holds. Without one: rule null, verdict ``default``. A null
    url, or one without ://, has an empty host and path; an empty host fits no rule. Repeated rows stay.
    """
    ship(pages.sparkSession)
    rules = list({r.name: r for r in rules}.values())
    spread = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    spread = spread.withColumn("_key", reversed_host(F.col("host"))).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    for a in range(0, len(rules), RULES_AT_ONCE):
        spread = _block(spread, rules[a : a + RULES_AT_ONCE], key)
    return spread.drop("_key")


def _block(spread: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    shared = spread.sparkSession.sparkContext.broadcast(rules)
    ordered = spread.sortWithinPartitions("_key", "path", key)
    names = ordered.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(shared.value)
        by_name = {r.name: r for r in shared.value}
        for b in batches:
            got, verdicts = [], []
            for k, path, had, verdict in zip(*(b.column(c).to_pylist() for c in ("_key", "path", "rule", "verdict"))):
                r = sweep.match(k, path)
                if r is not None and (had is None or len(r.name) >= len(had)):
                    had, verdict = r.name, by_name[r.name].verdict
                got.append(had), verdicts.append(verdict)
            columns = {c: b.column(c) for c in names} | {"rule": pa.array(got, pa.string()), "verdict": pa.array(verdicts, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return ordered.mapInArrow(run, ordered.schema)
