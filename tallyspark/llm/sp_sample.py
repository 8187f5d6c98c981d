"""SentencePiece encoding by sampling without replacement, and decoding.

A text, with a space put before it, is cut before every space into units; pieces don't cross units. The pieces that fit a
unit form a lattice, and with a weight per piece the lattices give every segmentation of the text a probability. Gumbel
top-k draws ``k`` different segmentations: conceptually each gets its log probability plus independent Gumbel noise, and the
``k`` largest sums win. The search for them is A-star over regions of the lattice. A region is what shares a prefix of
pieces and avoids some pieces next; the largest sum in it is a Gumbel variable at the log of its probability mass, which is
drawn without looking inside and is an exact bound. The region with the largest bound is opened: the segmentation that
attains the bound is drawn, and what is left of the region falls apart into the regions that leave that segmentation at one
of its pieces. Only the first ``NEAR`` pieces get regions of their own at once; the rest is one region, split when opened.

Draws are counted from a hash of the row's key, so a text is encoded alike whatever its place in the data.

A segmentation's inclusion score is the chance of its sum to exceed the largest sum that was not drawn.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator
from functools import cache
from itertools import islice, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Numbers, mix64

SAMPLES = 2
NEAR = 8
#: Text that is encoded together; a longer text is by itself.
CHUNK_BYTES = 1 << 19
#: Arcs of units that are kept from one list of texts to the next.
KEPT_ARCS = 1_000_000
#: Paths that are drawn together, so that their numbers stay in a core's cache.
DRAW_BLOCK = 1 << 15
#: Units whose lattices are built together, for the same reason.
BUILD_BLOCK = 1 << 13
SEED = 11
_SPACE = "▁"
_SPACE_CODE = 0x110000  # a space inside a lattice; the text's own U+2581 is an ordinary, unknown character
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_UNIT_STEP = np.uint64(0xD1342543DE82EF95)


class Vocabulary(NamedTuple):
    """Pieces with their ids and log weights, and the ids of single bytes; ``texts`` has the bytes of every id."""

    pieces: list[str]
    ids: np.ndarray
    weights: np.ndarray
    byte_ids: np.ndarray
    texts: list[bytes]

    @property
    def unknown_weight(self) -> float:
        """Of a byte of a character without a piece: less than any piece."""
        return float(self.weights.min()) - 10.0


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model with byte fallback.

    The scores of a BPE model are merge ranks. Their frequencies follow Zipf's law closely enough for sampling: the weight
    of rank r is -log(r + 10), normalised. Pieces that hold a space after the first character would cross units; the model
    here has only runs of spaces, at a score that is never chosen, and they are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    chosen, texts = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            texts.append(piece.replace(_SPACE, " ").encode("utf-8"))
            if _SPACE not in piece[1:]:
                chosen.append((i, piece, -model.get_score(i)))
    ranks = np.array([rank for _, _, rank in chosen])
    weights = -np.log(np.maximum(ranks, 0) + 10.0)
    weights -= np.log(np.exp(weights).sum())
    return Vocabulary([p for _, p, _ in chosen], np.array([i for i, _, _ in chosen], dtype=np.int32), weights,
                      np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32), texts)


class Trie:
    """The pieces as a trie whose edges are one table, so that all positions of a text walk it at once.

    The table is addressed by a hash of node and letter; ``slots`` tells how far an edge may lie from its address.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        edges: dict[tuple[int, int], int] = {}
        self.piece_at = [-1]
        for number, piece in enumerate(vocabulary.pieces):
            node = 0
            for char in piece:
                code = _SPACE_CODE if char == _SPACE else ord(char)
                node = edges.setdefault((node, code), len(self.piece_at))
                if node == len(self.piece_at):
                    self.piece_at.append(-1)
            self.piece_at[node] = number
        self.piece_at = np.array(self.piece_at, dtype=np.int32)
        keys = np.array([(node << 21) + code for node, code in edges], dtype=np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.children = np.full((1 << bits) + 64, -1, dtype=np.int64), np.zeros((1 << bits) + 64, dtype=np.int32)
        self.slots = 1
        for key, child, slot in zip(keys.tolist(), edges.values(), self._address(keys).tolist()):
            at = slot
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.children[at] = key, child
            self.slots = max(self.slots, at - slot + 1)

    def _address(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _GOLDEN >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children, -1 where there is none."""
        keys = (nodes.astype(np.int64) << 21) + codes
        at = self._address(keys)
        out = np.where(self.keys[at] == keys, self.children[at], -1)
        left = np.flatnonzero((out < 0) & (self.keys[at] >= 0))
        for slot in range(1, self.slots):
            if not len(left):
                break
            there = self.keys[at[left] + slot]
            hit = there == keys[left]
            out[left[hit]] = self.children[at[left[hit]] + slot]
            left = left[~hit & (there >= 0)]
        return out


_ARC_COLUMNS = ("logp", "others", "reach", "ids")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Lattice:
    """The lattices of some distinct units, end to end. A node is a place before a character.

    Arcs are sorted by node, the longest (mostly the likeliest) first. ``first[v]`` is a node's first arc, ``to`` where an arc
    leads, ``logp`` its log probability given its node, ``others`` the probability of the node's other arcs together,
    ``reach`` the running sum of probabilities within the node.
    """

    def __init__(self, units: list[str], trie: Trie):
        self.room: dict[str, np.ndarray] = {}
        vocabulary = trie.vocabulary
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units)) + 1
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        codes = np.full(int(sizes.sum()), _SPACE_CODE, dtype=np.int64)
        inner = np.ones(len(codes), dtype=bool)
        inner[self.start] = False
        codes[inner] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        stop = np.repeat(self.end, sizes)
        origin, self.to, piece = self._arcs(codes, stop, trie)
        unknown = np.flatnonzero(piece < 0)
        weight = vocabulary.weights[piece]
        code = codes[origin[unknown]]
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + ((code > 0xFFFF) & (code != _SPACE_CODE))
        weight[unknown] = vocabulary.unknown_weight * n_bytes
        self.logp = self._normalise(weight, stop)
        share = np.exp(self.logp)
        heads = self.first[:-1]
        run = np.cumsum(share)
        self.reach = run - (run[heads] - share[heads])[origin]
        self.reach[self.first[1:] - 1] = np.inf  # rounding must not lead past a node's last arc
        # Of an arc with nearly all probability the others are added up: their share must not be rounded away.
        large = np.flatnonzero(share > 0.5)
        small = share.copy()
        small[large] = 0.0
        self.others = 1.0 - share
        self.others[large] = np.add.reduceat(small, heads)[origin[large]]
        self._set_ids(piece, unknown, code, vocabulary)

    def _arcs(self, codes: np.ndarray, stop: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Origins, ends and pieces of all arcs by node, the longest first; piece -1 for a character that is none."""
        at, nodes = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int32)
        count = np.zeros(len(codes), dtype=np.int32)  # arcs found from each node so far
        found = []
        length = 0
        while len(at):
            nodes = trie.step(nodes, codes[at + length])
            length += 1
            on = np.flatnonzero(nodes >= 0)
            start, nodes = at[on], nodes[on]
            pieces = trie.piece_at[nodes]
            whole = np.flatnonzero(pieces >= 0)
            if length == 1:
                lone = np.ones(len(codes), dtype=bool)
                lone[start[whole]] = False
                found.append((np.flatnonzero(lone), 1, -1, 0))
                count[lone] = 1
            origin = start[whole]
            found.append((origin, length, pieces[whole], count[origin]))
            count[origin] += 1
            on = np.flatnonzero(start + length < stop[start])
            at, nodes = start[on], nodes[on]
        self.first = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        origins = np.repeat(np.arange(len(codes)), count)
        to, piece = np.empty(len(origins), dtype=np.int64), np.empty(len(origins), dtype=np.int64)
        for origin, length, pieces, rank in found:
            place = self.first[origin + 1] - 1 - rank
            to[place], piece[place] = origin + length, pieces
        return origins, to, piece

    def _normalise(self, weight: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Log probabilities of arcs given their nodes: weight times the mass from there to the unit's end, from the back."""
        n = len(stop)
        mass = np.zeros(n + 1)
        left = stop - np.arange(n)
        # A stable sort of short integers is linear; arcs come by node.
        nodes = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        left = left[nodes]
        node_edges = np.concatenate(([0], np.flatnonzero(left[1:] != left[:-1]) + 1, [n]))
        spread = np.diff(self.first)[nodes]
        order = _ranges(self.first[nodes], spread)
        heads = np.cumsum(spread) - spread
        arc_edges = np.append(heads, len(order))[node_edges].tolist()
        # A unit's end is the next unit's start, whose mass is that of its own lattice: arcs to an end look at an empty place.
        beyond = np.where(self.to == np.repeat(stop, np.diff(self.first)), n, self.to)[order]
        weight = weight[order]
        node_edges = node_edges.tolist()
        for a, z, i, j in zip(arc_edges[:-1], arc_edges[1:], node_edges[:-1], node_edges[1:]):
            total = weight[a:z]
            total += mass[beyond[a:z]]
            own, sizes = heads[i:j] - a, spread[i:j]
            top = np.maximum.reduceat(total, own)
            sums = top + np.log(np.add.reduceat(np.exp(total - np.repeat(top, sizes)), own))
            mass[nodes[i:j]] = sums
            total -= np.repeat(sums, sizes)
        logp = np.empty(len(weight))
        logp[order] = weight
        return logp

    def _set_ids(self, piece: np.ndarray, unknown: np.ndarray, code: np.ndarray, vocabulary: Vocabulary) -> None:
        """``ids`` of arcs; an unknown character of several bytes has its bytes in ``bytes_of``."""
        self.ids = vocabulary.ids[piece]
        single = (code <= 0x7F) | (code == _SPACE_CODE)
        self.ids[unknown[single]] = vocabulary.byte_ids[np.where(code[single] == _SPACE_CODE, 0x20, code[single])]
        self.ids[unknown[~single]] = -1
        self.bytes_of = {arc: vocabulary.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))]
                         for arc, c in zip(unknown[~single].tolist(), code[~single].tolist())}

    def append(self, other: Lattice) -> None:
        """Put the lattices of other units behind these; ``other`` is not changed."""
        nodes, arcs = len(self.first) - 1, len(self.to)
        for name, values in (("start", other.start + nodes), ("end", other.end + nodes), ("first", other.first[1:] + arcs),
                             ("to", other.to + nodes), *((c, getattr(other, c)) for c in _ARC_COLUMNS)):
            setattr(self, name, self._grown(name, values))
        self.bytes_of.update({arc + arcs: ids for arc, ids in other.bytes_of.items()})

    def _grown(self, name: str, values: np.ndarray) -> np.ndarray:
        held = getattr(self, name)
        size = len(held) + len(values)
        room = self.room.get(name)
        if room is None or len(room) < size:
            room = self.room[name] = np.empty(size + size // 2, dtype=held.dtype)
            room[:len(held)] = held
        room[len(held):size] = values
        return room[:size]

    def keep(self, units: np.ndarray) -> None:
        """Drop all but some units (rising numbers), which are numbered anew."""
        start, end = self.start[units], self.end[units]
        arcs = _ranges(self.first[start], self.first[end] - self.first[start])
        back = start - (np.cumsum(end - start) - (end - start))
        self.to = self.to[arcs] - np.repeat(back, self.first[end] - self.first[start])
        sizes = np.diff(self.first)[_ranges(start, end - start)]
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.start, self.end = start - back, end - back
        for name in _ARC_COLUMNS:
            setattr(self, name, getattr(self, name)[arcs])
        for name, room in self.room.items():  # is used again
            values = getattr(self, name)
            setattr(self, name, room[:len(values)])
            room[:len(values)] = values
        unknown = np.array(sorted(self.bytes_of), dtype=np.int64)
        place = np.searchsorted(arcs, unknown)
        left = place < len(arcs)
        left[left] = arcs[place[left]] == unknown[left]
        self.bytes_of = {p: self.bytes_of[a] for p, a in zip(place[left].tolist(), unknown[left].tolist())}

    def draw(self, node: np.ndarray, stop: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from ``node`` to ``stop``, one for each entry: their arcs, one after the other, and their lengths."""
        blocks = [slice(a, a + DRAW_BLOCK) for a in range(0, max(1, len(node)), DRAW_BLOCK)]
        drawn = [self._draw(node[b], stop[b], seed[b]) for b in blocks]
        return np.concatenate([arcs for arcs, _ in drawn]), np.concatenate([steps for _, steps in drawn])

    def _draw(self, node: np.ndarray, stop: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = np.zeros(len(node), dtype=np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        active = np.flatnonzero(node < stop)
        if len(active) < len(node):
            node, stop, seed = node[active], stop[active], seed[active]
        while len(active):
            uniform = (mix64(seed + np.uint64((len(taken) + 1) * int(_GOLDEN) & (1 << 64) - 1)) >> np.uint64(11)) * 2.0 ** -53
            arc = self.first[node]
            miss = np.flatnonzero(uniform >= self.reach[arc])
            there, sought = arc[miss], uniform[miss]
            while len(miss):
                there += 1
                on = sought >= self.reach[there]
                arc[miss[~on]] = there[~on]
                miss, there, sought = miss[on], there[on], sought[on]
            taken.append((active, arc))
            node = self.to[arc]
            on = np.flatnonzero(node < stop)
            steps[active] = len(taken)
            active, node, stop, seed = active[on], node[on], stop[on], seed[on]
        begin = np.cumsum(steps) - steps
        arcs = np.empty(int(steps.sum()), dtype=np.int64)
        for step, (entries, chosen) in enumerate(taken):
            arcs[begin[entries] + step] = chosen
        return arcs, steps


class Units:
    """The lattices of the units met so far. Beyond ``max_arcs`` arcs (about 32 bytes each) the rarest are forgotten."""

    def __init__(self, trie: Trie, max_arcs: int = KEPT_ARCS):
        self.trie, self.max_arcs = trie, max_arcs
        self.numbers = Numbers()
        self.lattice: Lattice | None = None
        self.uses = np.empty(0, dtype=np.int64)  # by unit, in how many lists of texts it came up

    def of(self, texts: list[str | None]) -> tuple[Lattice | None, list[np.ndarray]]:
        """The lattice that holds the units of ``texts``, and the numbers of each text's units in it."""
        if self.lattice is not None and len(self.lattice.to) > self.max_arcs:
            self._forget()
        known, numbers = len(self.numbers), self.numbers
        # Arrow cuts the texts and finds the distinct units, so that only these are looked up one by one.
        cut = pc.split_pattern(pa.array([t.encode("utf-8", "surrogatepass") if t else None for t in texts], pa.large_binary()), " ")
        sizes = pc.fill_null(pc.list_value_length(cut), 0).to_numpy()
        words = cut.flatten().dictionary_encode()
        try:
            names = words.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        except pa.ArrowInvalid:  # halves of surrogate pairs
            names = [w.decode("utf-8", "surrogatepass") for w in words.dictionary.to_pylist()]
        found = np.fromiter(map(numbers.__getitem__, names), dtype=np.int64, count=len(names))
        types = np.split(found[words.indices.to_numpy()], np.cumsum(sizes[:-1])) if len(texts) else []
        if len(numbers) > known:
            met = list(islice(numbers, known, None))
            for at in range(0, len(met), BUILD_BLOCK):
                new = Lattice(met[at:at + BUILD_BLOCK], self.trie)
                if self.lattice is None:
                    self.lattice = new
                else:
                    self.lattice.append(new)
            self.uses = np.concatenate((self.uses, np.zeros(len(numbers) - known, dtype=np.int64)))
        self.uses[found] += 1
        return self.lattice, types

    def _forget(self) -> None:
        arcs = self.lattice.first[self.lattice.end] - self.lattice.first[self.lattice.start]
        order = np.argsort(-self.uses, kind="stable")
        kept = np.sort(order[np.cumsum(arcs[order]) <= self.max_arcs // 2])
        names = list(self.numbers)
        self.numbers = Numbers({names[u]: i for i, u in enumerate(kept.tolist())})
        self.lattice.keep(kept)
        self.uses = self.uses[kept] // 2
        if not len(kept):
            self.lattice = None


class Region(NamedTuple):
    """What shares the first ``depth`` pieces of ``leaf`` and avoids the arcs ``without`` there; a tail if that is None.

    A tail holds what shares the pieces, save the leaf itself.
    """

    leaf: int
    depth: int
    without: tuple[int, ...] | None
    log_mass: float


class Leaf(NamedTuple):
    """A drawn segmentation: the first ``drawn`` pieces are those of ``parent`` and an arc of unit ``head``, the rest was drawn.

    ``ends`` tells for unit ``head`` and every later one where its pieces end among those drawn, counted from ``offset``.
    """

    arcs: np.ndarray
    running: np.ndarray  # log probability of the first i pieces, for i from 0 to all
    key: float
    parent: Leaf | None
    drawn: int
    head: int
    ends: np.ndarray
    offset: int

    def unit(self, piece: int) -> int:
        """The unit of a piece."""
        leaf = self
        while piece < leaf.drawn - 1:
            leaf = leaf.parent
        if piece < leaf.drawn:
            return leaf.head
        return leaf.head + int(np.searchsorted(leaf.ends, piece - leaf.drawn + leaf.offset, side="right"))


class Search:
    """Perturbed A-star over the segmentations of one text."""

    def __init__(self, lattice: Lattice, rng: random.Random):
        self.lattice, self.rng = lattice, rng
        self.leaves: list[Leaf] = []
        self.frontier: list[tuple[float, int, tuple]] = []
        self.pushed = 0
        self.key = self._gumbel()

    def _gumbel(self) -> float:
        return -math.log(-math.log(self.rng.random() or 2.0 ** -54))

    def _push(self, regions: list[tuple], below: float, taken: int = -1) -> None:
        """Put regions on the frontier; the one numbered ``taken`` has the bound ``below`` itself."""
        frontier, uniform, log = self.frontier, self.rng.random, math.log
        for i, region in enumerate(regions):
            log_mass = region[3]
            if log_mass == -math.inf:
                continue
            if i == taken:
                key = below
            else:  # a Gumbel variable at the log mass, given that it is at most ``below``
                free = log_mass - log(-log(uniform() or 2.0 ** -54))
                low, high = (-below, -free) if free < below else (-free, -below)
                key = -(high + math.log1p(math.exp(low - high)))
            self.pushed += 1
            heapq.heappush(frontier, (-key, self.pushed, region))

    def add(self, leaf: Leaf, opened: Region | None) -> None:
        """Take a leaf, and what is left of the region it came from."""
        self.leaves.append(leaf)
        number, start = len(self.leaves) - 1, 0 if opened is None else opened.depth
        without = () if opened is None else opened.without
        self._push(self._split(number, start, without), leaf.key)

    def _split(self, number: int, start: int, without: tuple[int, ...]) -> list[tuple]:
        """The regions, as plain tuples, that leave a leaf at its pieces from ``start`` on; ``without`` is avoided at the first
        already."""
        leaf = self.leaves[number]
        if start == len(leaf.arcs):
            return []
        near = min(len(leaf.arcs), start + NEAR)
        arcs = leaf.arcs[start:near]
        log_mass = (leaf.running[start:near] + np.log(self.lattice.others[arcs])).tolist()
        out = list(zip(repeat(number), range(start, near), zip(arcs.tolist()), log_mass))
        if without:
            avoided = (*without, *out[0][2])
            mass = sum(math.exp(self.lattice.logp[a]) for a in self._others(avoided))
            out[0] = (number, start, avoided, float(leaf.running[start]) + math.log(mass) if mass > 0 else -math.inf)
        if near < len(leaf.arcs):
            gap = float(leaf.running[-1] - leaf.running[near])
            out.append((number, near, None, float(leaf.running[near]) + math.log1p(-math.exp(gap)) if gap < 0
                        else -math.inf))
        return out

    def _others(self, avoided: tuple[int, ...]) -> list[int]:
        """The arcs beside ``avoided`` at their node."""
        node = int(np.searchsorted(self.lattice.first, avoided[0], side="right")) - 1
        return [a for a in range(int(self.lattice.first[node]), int(self.lattice.first[node + 1])) if a not in avoided]

    def open(self) -> tuple[Region, int] | None:
        """The region with the largest bound, and the arc its best segmentation takes; None if nothing is left."""
        while self.frontier:
            key, _, found = heapq.heappop(self.frontier)
            self.key, region = -key, Region._make(found)
            if region.without is not None:
                arcs = self._others(region.without)
                return region, self.rng.choices(arcs, [math.exp(self.lattice.logp[a]) for a in arcs])[0]
            parts = [p for p in self._split(region.leaf, region.depth, ()) if p[3] > -math.inf]
            if not parts:
                continue
            top = max(p[3] for p in parts)
            best = self.rng.choices(range(len(parts)), [math.exp(p[3] - top) for p in parts])[0]
            self._push(parts, self.key, best)
        return None

    def inclusion(self) -> list[float]:
        """For each leaf the chance that its sum exceeds the largest one that was not drawn."""
        if not self.frontier:
            return [1.0] * len(self.leaves)
        limit = -self.frontier[0][0]
        return [-math.expm1(-math.exp(min(700.0, float(leaf.running[-1]) - limit))) for leaf in self.leaves]


def sample_texts(texts: list[str | None], keys: list[str], trie: Trie, k: int, met: Units | None = None) -> list[tuple]:
    """For each text up to ``k`` tuples (log probability, key, inclusion score, ids), by falling key.

    ``met`` holds lattices of earlier texts, which are not built again.
    """
    lattice, types = (Units(trie) if met is None else met).of(texts)
    seeds = [xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), SEED) for key in keys]
    searches = [Search(lattice, random.Random(s)) for s in seeds]
    places = _Places(types, seeds)
    # Each round draws one segmentation of every text that has another one.
    opened: list[tuple | None] = [(None, None)] * len(texts)
    with np.errstate(divide="ignore"):  # an arc without others leaves no mass
        for turn in range(k):
            jobs = [(i, *o) for i, o in enumerate(opened) if o is not None]
            if not jobs:
                break
            _draw_round(jobs, places, searches, lattice, turn)
            opened = [searches[i].open() if o is not None and turn + 1 < k else None for i, o in enumerate(opened)]
    paths = iter(_expanded(lattice, [leaf.arcs for search in searches for leaf in search.leaves]))
    return [[(float(leaf.running[-1]), leaf.key, score, next(paths)) for leaf, score in zip(search.leaves, search.inclusion())]
            for search in searches]


class _Places:
    """The units of some texts, end to end, with the seeds of the texts."""

    def __init__(self, types: list[np.ndarray], seeds: list[int]):
        self.sizes = np.fromiter(map(len, types), dtype=np.int64, count=len(types))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.units = np.concatenate(types) if types else np.empty(0, np.int64)
        self.seeds = np.array(seeds, dtype=np.uint64)


def _draw_round(jobs: list[tuple], places: _Places, searches: list[Search], lattice: Lattice | None, turn: int) -> None:
    """Draw the segmentations that attain the bounds of the opened regions, for all texts at once."""
    heads = [0 if region is None else searches[i].leaves[region.leaf].unit(region.depth) for i, region, _ in jobs]
    text, head = np.array([i for i, _, _ in jobs], dtype=np.int64), np.array(heads, dtype=np.int64)
    sizes = places.sizes[text] - head
    edges = np.concatenate(([0], np.cumsum(sizes)))
    if edges[-1]:
        units = places.units[_ranges(places.starts[text] + head, sizes)]
        node, stop = lattice.start[units], lattice.end[units]
        if turn:
            node[edges[:-1]] = lattice.to[[arc for _, _, arc in jobs]]
        first = places.seeds[text] ^ np.uint64((turn + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        first += (head - edges[:-1]).view(np.uint64) * _UNIT_STEP  # of the unit that comes at 0 here
        draws = np.arange(len(units), dtype=np.uint64)
        draws *= _UNIT_STEP
        draws += np.repeat(first, sizes)
        arcs, steps = lattice.draw(node, stop, mix64(draws))
        ends, logp = np.cumsum(steps), lattice.logp[arcs]
    else:
        arcs = ends = np.empty(0, np.int64)
        logp = np.empty(0)
    begin = 0
    for (i, region, arc), at, a, z in zip(jobs, heads, edges[:-1].tolist(), edges[1:].tolist()):
        end = int(ends[z - 1]) if z > a else begin
        path, search, parent, drawn = arcs[begin:end], searches[i], None, 0
        if region is not None:
            parent, drawn = search.leaves[region.leaf], region.depth + 1
            path = np.concatenate((parent.arcs[:region.depth], (arc,), path))
        running = np.empty(len(path) + 1)
        running[drawn + 1:] = logp[begin:end]
        if region is None:
            running[0] = 0.0
        else:
            running[:drawn] = parent.running[:drawn]
            running[drawn] = lattice.logp[arc]
        from_there = running[max(drawn - 1, 0):]
        np.add.accumulate(from_there, out=from_there)
        search.add(Leaf(path, running, search.key, parent, drawn, at, ends[a:z], begin), region)
        begin = end


def _expanded(lattice: Lattice | None, paths: list[np.ndarray]) -> list[np.ndarray]:
    """The ids of each path; an unknown character of several bytes has an id for each."""
    arcs = np.concatenate(paths) if paths else np.empty(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, paths), dtype=np.int64, count=len(paths)))
    if not len(arcs):
        return [np.empty(0, np.int32)] * len(paths)
    ids = lattice.ids[arcs]
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        parts = [lattice.bytes_of[a] for a in arcs[unknown].tolist()]
        wide = np.ones(len(ids), dtype=np.int64)
        wide[unknown] = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        place = np.concatenate(([0], np.cumsum(wide)))
        ids = np.repeat(ids, wide)
        ids[_ranges(place[unknown], wide[unknown])] = np.concatenate(parts)
        ends = place[ends]
    return np.split(ids, ends[:-1])


def decode_ids(ids: np.ndarray, texts: list[bytes]) -> str:
    """The text of a segmentation: its pieces' bytes without the space put before."""
    return b"".join(map(texts.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


@cache
def _trie(path: str) -> Trie:
    return Trie(load_vocabulary(path))


_ENCODED = pa.schema([("id", pa.string()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()),
                      ("key", pa.float64()), ("inclusion", pa.float64()), ("round_trip", pa.bool_())])


def encode(docs: DataFrame, model_path: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to ``k`` rows per row of ``docs``: ``id_col``, ``sample`` (from 1), ``ids``, ``log_prob``, ``key``, ``inclusion``,
    ``round_trip`` (whether the ids decode to the text).

    ``key`` is the perturbed log probability; samples are numbered by falling key and differ in their ids' boundaries. A text
    with fewer segmentations gets fewer rows; a null or empty text has one, without ids. Draws depend on the id and the text
    alone: rows equal in both are encoded alike, and a null id is a key like any other. An empty table gives no rows. Other
    columns aren't read. The model's pieces travel with the tasks.
    """
    trie = Trie(load_vocabulary(model_path))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, pieces = Units(trie), pa.array(trie.vocabulary.texts, pa.large_binary())
        for batch in batches:
            # Only the texts that are encoded together become Python strings: the batch may hold very long ones.
            for part in _parts(batch):
                yield _encoded_batch(part.column("id").to_pylist(), part.column("text").to_pylist(), met, pieces, k)
            del batch, part  # else they stay while the next batch is read

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInArrow(
        encoded, "id string, sample int, ids array<int>, log_prob double, key double, inclusion double, round_trip boolean")
    kind = docs.schema[id_col].dataType
    return found.select(F.col("id").cast(kind).alias(id_col), *[f.name for f in _ENCODED][1:])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, together as long as their texts have at most ``CHUNK_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
    at, done = 0, 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at, done = end, int(ends[end - 1])


def _encoded_batch(ids: list, texts: list, met: Units, pieces: pa.Array, k: int) -> pa.RecordBatch:
    drawn = sample_texts(texts, ["" if i is None else f"={i}" for i in ids], met.trie, k, met)
    rows = [(i, n + 1, s) for i, samples in enumerate(drawn) for n, s in enumerate(samples)]
    paths = [s[3] for _, _, s in rows]
    flat = np.concatenate(paths) if paths else np.empty(0, np.int32)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in paths]))).astype(np.int32)
    # All paths are decoded at once: their pieces' bytes come to lie one after the other.
    taken = pieces.take(pa.array(flat))
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(taken).to_numpy())))[offsets]
    decoded = memoryview(taken.buffers()[2] or b"").cast("B")
    sources = ["" if t is None else " " + t for t in texts]
    good = [decoded[begin:end] == (sources[i] if len(sources[i]) > 1 else "").encode("utf-8", "surrogatepass")
            for (i, _, _), begin, end in zip(rows, ends[:-1].tolist(), ends[1:].tolist())]
    return pa.RecordBatch.from_arrays([
        pa.array([ids[i] for i, _, _ in rows], pa.string()), pa.array([n for _, n, _ in rows], pa.int32()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *(pa.array([s[c] for _, _, s in rows], pa.float64())
                                                                     for c in (0, 1, 2)), pa.array(good, pa.bool_())],
        schema=_ENCODED)


def decode(ids: Column, model_path: str) -> Column:
    """The texts of id arrays; ids that are not pieces' are skipped, bytes that are no UTF-8 are replaced. Null gives null."""
    texts = load_vocabulary(model_path).texts

    @F.pandas_udf("string")
    def decoded(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else decode_ids(np.array([i for i in a if 0 <= i < len(texts)], dtype=np.int64), texts)
                          for a in arrays], dtype=object)

    return decoded(ids)
