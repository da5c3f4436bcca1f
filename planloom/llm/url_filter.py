"""Operator 1, URL filters: one bit-parallel automaton for all wildcard rules.

Every rule is a glob over the canonical URL (``.host/path``): ``*`` is any run of characters, ``~`` any run without ``/``
(within the host), ``?`` one character. The characters of all rules are laid out one after the other
over the bits of several 64-bit words; a batch of URLs advances all of them together, one character at a time:
``state = ((state << 1 | first) & match[char]) | (state & loop[char])`` (Shift-And with self-loops for wildcards).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: URLs that advance together.
GROUP = 4096


def host_rule(rule: str) -> str:
    """``host/path``, which fits the host, all its subdomains and every longer path, as a glob over ``.host/path``."""
    return f"~.{rule}*"


class Automaton:
    """Masks of globs over code points. Pattern i accepts when its last bit is set after the last character."""

    def __init__(self, globs: list[str]):
        states: list[tuple[str, bool, bool]] = []  # character ('' for any), whether it loops on all, on all but '/'
        first, last = [], []
        for glob in globs:
            start = len(states)
            states.append(("", False, False))  # bit of "nothing read yet": set by hand at the start
            for c in glob:
                if c == "*":
                    states[-1] = (states[-1][0], True, states[-1][2])
                elif c == "~":
                    states[-1] = (states[-1][0], states[-1][1], True)
                else:
                    states.append((c, False, False))
            first.append(start)
            last.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.chars = np.array(sorted({ord(c) for c, _, _ in states if c not in ("", "?")} | {ord("/")}), np.uint32)
        n = len(self.chars) + 1  # the last class is every other character
        self.match, self.loop = np.zeros((n, self.words), np.uint64), np.zeros((n, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        bit = [(k // 64, np.uint64(1) << np.uint64(k % 64)) for k in range(len(states))]
        for k, (c, loops, in_host) in enumerate(states):
            word, b = bit[k]
            for i in range(n):
                known = chr(self.chars[i]) if i < n - 1 else None
                if k not in first and (c == "?" or c == known):
                    self.match[i, word] |= b
                if loops or in_host and known != "/":
                    self.loop[i, word] |= b
        for k in first:
            self.start[bit[k][0]] |= bit[k][1]
        self.accepts = [bit[k] for k in last]

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, at, len(self.chars)).astype(np.int32)

    def run(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix (text, pattern) of acceptance. A text whose state is empty, or whose remaining states only loop
        on everything, is not read further."""
        n = len(texts)
        final = np.tile(self.start, (n, 1))
        always = np.bitwise_and.reduce(self.loop, axis=0)  # bits that no character can clear
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = self.classes("".join(texts))
        offsets = np.concatenate(([0], np.cumsum(lengths)[:-1])) if n else lengths
        alive, state, k = np.flatnonzero(lengths > 0), None, 0
        state = final[alive]
        while len(alive):
            cls = flat[offsets[alive] + k]
            moved = state << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.match[cls]) | (state & self.loop[cls])
            k += 1
            settled = ((state & ~always) == 0).all(axis=1) & self._dead_ends(state)
            done = settled | (lengths[alive] == k)
            if done.any():
                final[alive[done]] = state[done]
                alive, state = alive[~done], state[~done]
        return np.stack([(final[:, w] & b) != 0 for w, b in self.accepts], axis=1) if self.accepts else np.zeros((n, 0), bool)

    def _dead_ends(self, state: np.ndarray) -> np.ndarray:
        """Whether no state leads to another one: all that is left are accepting bits."""
        ends = np.zeros(self.words, np.uint64)
        for w, b in self.accepts:
            ends[w] |= b
        return ((state & ~ends) == 0).all(axis=1)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes
    on to ``?``, ``#`` or the end. Both are empty without ``://`` or for null."""
    has = url.contains("://")
    rest = F.when(has, F.substr(url, F.length(F.substring_index(url, "://", 1)) + F.lit(4))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(df: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``; ``rules`` are (verdict, ``host/path``) pairs.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest fitting rule decides; of
    equally long ones a block before an allow, then the smaller text. Without one, ``rule`` is null and ``verdict`` is
    ``default``. Null and malformed URLs have an empty host and path, which no rule fits. Rows are kept as they are, repeated
    ones too; columns of these four names are replaced.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    automaton = Automaton([host_rule(r) for _, r in ranked])
    names = [r for _, r in ranked]

    def first_rule(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            texts, out = urls.tolist(), np.full(len(urls), -1, np.int32)
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # like lengths together
            for k in range(0, len(order), GROUP):
                own = order[k : k + GROUP]
                fits = automaton.run([texts[i] for i in own])
                if fits.shape[1]:
                    out[own] = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
            yield pd.Series(out)

    udf = F.pandas_udf(first_rule, "int")
    host, path = split_url(F.col(url))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    out = df.select(*kept, host.alias("host"), path.alias("path")).withColumn("_judge_hit", udf(F.concat(F.lit("."), "host", "path")))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_judge_hit") + 1)
    if not ranked:
        return out.drop("_judge_hit").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    found = F.col("_judge_hit") >= 0
    return out.withColumns({"rule": F.when(found, pick(names)), "verdict": F.when(found, pick([v for v, _ in ranked])).otherwise(default)}).drop("_judge_hit")
