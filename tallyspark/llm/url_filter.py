"""URL filters by a bit-parallel wildcard automaton.

Glob rules (``*`` any run, ``?`` one code point, all else literal) are packed into multiword Shift-And masks: one bit per
pattern position, all patterns in one row of 64-bit words. A batch of URLs is scanned byte by byte, every URL and every
pattern at once, so the work per byte doesn't depend on the number of URLs that match. Nothing is shuffled.

A URL is canonical as ``.host#path``: a leading dot makes ``*.example.com#`` fit a host and its subdomains, and ``#`` can
occur in neither part, so no host rule can match inside a path.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import lower_ascii

BATCH = 4096


class Rule(NamedTuple):
    """``verdict`` for ``host`` and its subdomains below ``path``; the longest fitting rule wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class GlobAutomaton:
    """All globs as one Shift-And automaton over UTF-8 bytes; a glob has to fit the whole string.

    Bit i of a glob means "its first i elements have been read". A star after element i lets bit i stay; an element ``?``
    takes a leading byte and stays on continuation bytes, so it reads one code point.
    """

    def __init__(self, globs: Sequence[str]):
        self.n = len(globs)
        accept_bits, start, stay, tail, finals = [], [], [], [], []
        at = 0
        for glob in globs:
            start.append(at)
            accept_bits.append((at, None))
            for element in re.findall(r"\*+|[^*]", glob, re.S):
                if element[0] == "*":
                    stay.append(at)
                elif element == "?":
                    at += 1
                    accept_bits.append((at, "?"))
                    tail.append(at)
                else:
                    for byte in element.encode("utf-8", "surrogatepass"):
                        at += 1
                        accept_bits.append((at, byte))
            finals.append(at)
            at += 1
        self.width = max(1, -(-at // 64))
        self.start, self.stay, self.tail = (self._mask(bits) for bits in (start, stay, tail))
        self.finals = np.array(finals, dtype=np.int64)
        taken: list[list[int]] = [[] for _ in range(256)]
        for bit, element in accept_bits:
            if element == "?":
                for byte in range(256):
                    if byte & 0xC0 != 0x80:
                        taken[byte].append(bit)
            elif element is not None:
                taken[element].append(bit)
        self.byte_mask = np.stack([self._mask(bits) for bits in taken])
        self.loop = np.stack([self.stay | (self.tail if byte & 0xC0 == 0x80 else 0) for byte in range(256)])

    def _mask(self, bits: list[int]) -> np.ndarray:
        mask = np.zeros(self.width, dtype=np.uint64)
        for bit in bits:
            mask[bit // 64] |= np.uint64(1 << bit % 64)
        return mask

    def match(self, strings: Sequence[bytes]) -> np.ndarray:
        """A boolean per string and glob."""
        found = np.zeros((len(strings), self.n), dtype=bool)
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            found[rows] = self._scan([strings[i] for i in rows])
        return found

    def _scan(self, strings: list[bytes]) -> np.ndarray:
        """``strings`` come longest first, so those still being read are always the first ones."""
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        state = np.tile(self.start, (len(strings), 1))
        active = len(strings)
        for t in range(int(lengths.max(initial=0))):
            while active and lengths[active - 1] <= t:
                active -= 1
            byte = data[offset[:active] + t]
            now = state[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.byte_mask[byte]) | (now & self.loop[byte])
        if not self.n:
            return np.zeros((len(strings), 0), dtype=bool)
        return (state[:, self.finals // 64] >> (self.finals % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _literal(text: str) -> str:
    if re.search(r"[*?]", text):
        raise ValueError(f"a rule's host and path are literal: {text!r}")
    return text


def judge(pages: DataFrame, rules: Sequence[Rule], block_globs: Sequence[str], id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """One row per page: ``id_col``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``.

    ``rules`` are literal; the longest that fits gives the verdict. Where none fits, a page is blocked if one of
    ``block_globs`` fits its canonical URL, else allowed. A null url, or one without ``://``, has an empty host and path and
    is judged as such. Ids may be null or repeated; only the two named columns are read, so others can't clash. An empty
    table gives no rows. The globs are parameters and travel with the task.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = GlobAutomaton([f"*.{_literal(r.host)}#{_literal(r.path)}*" for r in ranked] + list(block_globs))
    names = np.array([r.name for r in ranked] + [None], dtype=object)
    verdicts = [r.verdict for r in ranked]

    @F.pandas_udf("rule string, verdict string")
    def verdict_of(canonical: pd.Series) -> pd.DataFrame:
        found = automaton.match([s.encode("utf-8", "surrogatepass") for s in canonical])
        fits, globs = found[:, :len(ranked)], found[:, len(ranked):].any(axis=1)
        first = np.where(fits.any(axis=1), fits.argmax(axis=1) if len(ranked) else 0, len(ranked))
        outcome = np.array(verdicts + ["allow"], dtype=object)[first]
        outcome[(first == len(ranked)) & globs] = "block"
        return pd.DataFrame({"rule": names[first], "verdict": outcome})

    host, path = url_parts(F.col(f"`{url_col}`"))
    parts = pages.select(F.col(f"`{id_col}`").alias(id_col), host.alias("host"), path.alias("path"))
    judged = parts.withColumn("_v", verdict_of(F.concat(F.lit("."), "host", F.lit("#"), "path")))
    return judged.select(id_col, "host", "path", "_v.rule", "_v.verdict")
