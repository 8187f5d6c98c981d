"""A dictionary automaton over many rule texts, as flat arrays, run over all texts of a batch at once.

States are the prefixes of the rule texts. A text's next character leads to the child for it, or, where there is none, to
that of the longest shorter prefix that has one (failure links). Each state links to the longest rule text it ends with, so
all rule texts found at a place are a chain of states.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Travels with its task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """``texts`` are distinct and not empty; they are known by their position."""

    def __init__(self, texts: Iterable[str]):
        self.texts = list(texts)
        edges: dict[tuple[int, int], int] = {}
        ends, parents, codes = [-1], [0], [0]
        for number, text in enumerate(self.texts):
            state = 0
            for code in map(ord, text):
                child = edges.setdefault((state, code), len(ends))
                if child == len(ends):
                    ends.append(-1)
                    parents.append(state)
                    codes.append(code)
                state = child
            ends[state] = number
        self.ends = np.array(ends, dtype=np.int32)
        self._store(np.array([(state << 21) + code for state, code in edges], dtype=np.int64),
                    np.fromiter(edges.values(), dtype=np.int32, count=len(edges)))
        self._link(np.array(parents, dtype=np.int32), np.array(codes, dtype=np.int64))

    def _store(self, keys: np.ndarray, children: np.ndarray) -> None:
        """Edges sorted by a hash of state and character, with the place at which each hash begins."""
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        order = np.argsort(self._slot(keys), kind="stable")
        self.keys, self.children = keys[order], children[order]
        self.begin = np.searchsorted(self._slot(self.keys), np.arange((1 << bits) + 1))
        self.longest = int(np.diff(self.begin).max(initial=0))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def _child(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children, -1 where there is none."""
        keys = (states.astype(np.int64) << 21) + codes
        slot = self._slot(keys)
        at, end = self.begin[slot], self.begin[slot + 1]
        out = np.full(len(keys), -1, dtype=np.int32)
        for _ in range(self.longest):
            there = np.flatnonzero((at < end) & (out < 0))
            if not len(there):
                break
            hit = there[self.keys[at[there]] == keys[there]]
            out[hit] = self.children[at[hit]]
            at = at + 1
        return out

    def _link(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Failure links, level by level, and each state's next state that ends a rule text (0 for none)."""
        n = len(parents)
        self.fail, self.found = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        depth = np.zeros(n, dtype=np.int32)
        for state in range(1, n):  # a parent is numbered before its children
            depth[state] = depth[parents[state]] + 1
        by_depth = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 2))
        for begin, end in zip(edges[:-1], edges[1:]):
            level = by_depth[begin:end]
            if depth[level[0]] > 1:
                self.fail[level] = self.step(self.fail[parents[level]], codes[level])
            behind = self.fail[level]
            self.found[level] = np.where(self.ends[behind] >= 0, behind, self.found[behind])

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        states = states.copy()
        out = np.zeros(len(states), dtype=np.int32)
        open_ = np.arange(len(states))
        while len(open_):
            child = self._child(states[open_], codes[open_])
            out[open_] = np.maximum(child, 0)
            open_ = open_[(child < 0) & (states[open_] > 0)]
            states[open_] = self.fail[states[open_]]
        return out

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a text's position and that of a rule text it contains."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        left = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")  # texts longer than j
        states = np.zeros(len(texts), dtype=np.int32)
        hits: list[np.ndarray] = []
        for j, active in enumerate(left.tolist()):
            states = self.step(states[:active], codes[begin[:active] + j])
            at = np.arange(active)
            state = np.where(self.ends[states] >= 0, states, self.found[states])
            while True:
                some = state > 0
                at, state = at[some], state[some]
                if not len(at):
                    break
                hits.append(order[at] * len(self.texts) + self.ends[state])
                state = self.found[state]
        pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.int64)
        return pairs // max(1, len(self.texts)), pairs % max(1, len(self.texts))


def find_texts(automaton, column: str, found: str):
    """For ``mapInArrow`` over a column of texts: rows (text, rule text contained). ``automaton`` is a broadcast variable."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton.value
        names = pa.array(machine.texts, pa.string())
        for batch in batches:
            texts = batch.column(0)
            text, rule = machine.matches(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(text)), names.take(pa.array(rule))], [column, found])

    return scan
