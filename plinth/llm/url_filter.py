"""URL filters: many glob rules at once, by a bit-parallel automaton.

A rule is a verdict, a host and a path prefix. It is compiled to the glob ``*.host/path**`` over the canonical URL
``.host/path``: ``*`` is a run of characters other than "/", ``**`` is any run. All globs are packed one after the other
into 64-bit words; one Shift-And step per byte moves every state of every glob:

    D = (((D << 1) | first) & B[c]) | (D & S[c])

B[c] holds the states that read c, S[c] the stars that c leaves in place. The shift carries from word to word. Steps run
over all URLs of an Arrow batch at once; a URL leaves the batch as soon as no glob can still match or stop matching, soon
after its host, so that very long URLs cost nothing more.

Nulls and URLs without "://": host and path are empty, no rule fits. Empty tables give empty results. Repeated rows stay.

Null urls and urls without a scheme have an empty host and path and get the method's own verdict; rows repeat as often as they
come; of equally long rules that fit the first one counts; an empty table gives an empty one. Urls of any length run through
the automaton, megabytes of them at a time. Columns other than key and url are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._common import flat_bytes, sliced, small_batches, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Automaton(NamedTuple):
    """reads, stays: (256, words). first, final: (words). final_of: the rule whose glob ends in that state bit, by length rank."""

    reads: np.ndarray
    stays: np.ndarray
    first: np.ndarray
    final: np.ndarray
    ends: list[int]


def glob_items(glob: str) -> list[tuple[str, int]]:
    """The glob as ("byte", b), ("star", 0) and ("any", 0) items."""
    items, i, raw = [], 0, glob.encode()
    while i < len(raw):
        if raw[i : i + 2] == b"**":
            items.append(("any", 0))
            i += 2
        elif raw[i : i + 1] == b"*":
            items.append(("star", 0))
            i += 1
        else:
            items.append(("byte", raw[i]))
            i += 1
    return items


def compile_globs(globs: list[str]) -> Automaton:
    """Each glob's literal bytes become states; a star stays in the state before it. A state 0 of each glob stands for its start."""
    n_states = sum(1 + sum(kind == "byte" for kind, _ in glob_items(g)) for g in globs)
    words = max(1, -(-n_states // 64))
    reads, stays = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    first, final, ends, state = np.zeros(words, np.uint64), np.zeros(words, np.uint64), [], 0

    def put(mask: np.ndarray, at: int) -> None:
        mask[..., at // 64] |= np.uint64(1 << (at % 64))

    for g in globs:
        put(first, state)
        for kind, byte in glob_items(g):
            if kind == "byte":
                state += 1
                put(reads[byte : byte + 1], state)
            else:
                put(stays, state)
                if kind == "star":
                    stays[ord("/"), state // 64] &= ~np.uint64(1 << (state % 64))
        put(final, state)
        ends.append(state)
        state += 1
    return Automaton(reads, stays, first, final, ends)


def run_automaton(auto: Automaton, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The state words of each string after its last byte; stars before the end are kept by S."""
    n, words = len(at) - 1, len(auto.first)
    state = np.repeat(auto.first[None, :], n, axis=0)
    live, step = np.arange(n), 0
    one = np.uint64(1)
    while True:
        live = live[at[live] + step < at[live + 1]]
        if not len(live):
            return state
        d, c = state[live], flat[at[live] + step]
        carry = np.zeros_like(d)
        if words > 1:
            carry[:, 1:] = d[:, :-1] >> np.uint64(63)
        moved = (((d << one) | carry) & auto.reads[c]) | (d & auto.stays[c])
        state[live] = moved
        # a glob that has ended in ** can't be lost, and states that are all ended or dead can't change
        live = live[((moved & ~auto.final) != 0).any(axis=1)]
        step += 1


def url_parts(url: str = "url") -> tuple:
    """host and path columns of a URL column, as the contract has them."""
    start = F.instr(F.col(url), "://")
    rest = F.when(start > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict for every row of pages. The longest rule that fits wins; of equally long ones, the first."""

    rows = pages.select(F.col(key), F.col(url).alias("__url")).select(key, *(c.alias(a) for c, a in zip(url_parts("__url"), ("host", "path"))))
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    globs = [f"*.{rules[i].host}{rules[i].path}**" for i in ranked]
    schema = rows.select(key, "host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    for field in schema.fields:
        field.nullable = True

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = compile_globs(globs)
        names = pa.array([rules[i].name for i in ranked] + [None], pa.string())
        verdicts = pa.array([rules[i].verdict for i in ranked] + [default], pa.string())
        for batch in sliced(batches, "path"):
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            flat, at = flat_bytes(pa.array(["." + h + p for h, p in zip(hosts, paths)], pa.string()))
            state = run_automaton(auto, flat, at)
            best = np.full(batch.num_rows, len(globs), np.int64)
            for rank in range(len(globs) - 1, -1, -1):
                end = auto.ends[rank]
                hit = (state[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1)
                best[hit == 1] = rank
            pick = pa.array(best)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), names.take(pick), verdicts.take(pick)], names=[key, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judge, schema)


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


_CASES = "\n".join(
    f"    WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{{i}}}'" for i, r in sorted(enumerate(RULES), key=lambda x: -len(x[1].name))
)
OP10_SQL = f"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), ruled AS (
  SELECT page_id, host, path, CASE
{_CASES.format(*(r.name for r in RULES))}
  END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE rule
{chr(10).join(f"    WHEN '{r.name}' THEN '{r.verdict}'" for r in RULES)}
  ELSE 'allow' END AS verdict
FROM ruled
"""
