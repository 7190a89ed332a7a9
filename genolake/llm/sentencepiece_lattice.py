"""SentencePiece encoding and decoding: distinct segmentations drawn from the lattice by Gumbel top-k without replacement.

The vocabulary and its order come from a SentencePiece model; a piece's log-probability is taken from its rank
(Zipf's law), and bytes cost BYTE_COST more. A text is cut into units that no piece crosses (a line end; spaces
and what follows them), so its lattice is a chain of small lattices, and the segmentations of the text form a
tree: the first unit's segmentations, below each the second's, and so on.

The search is perturbed A-star over that tree. A node stands for all texts' segmentations with the same first units
and, at the next unit, a segmentation not among those already split off; its priority is the largest Gumbel-perturbed
log-probability within. The best node is split: its maximum goes down to one leaf, drawn unit by unit in proportion to
mass, and at each unit what was not chosen becomes a node, whose maximum is a Gumbel truncated at the parent's. So
leaves come out in the order of their perturbed values, are distinct, and are a sample without replacement. A leaf's
inclusion score is the chance that its perturbed value exceeds that of the first leaf left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, kept, lean, unused

UNIT = re.compile(r"\n| *[^ \n]+| +")
SPACE = "▁"
BYTE_COST = 4.0
RANK_SHIFT = 2.7
#: Units that a worker remembers; beyond that it forgets those that came up once since the last time, or all but the half that came up most.
REMEMBERED = 200_000
#: Units whose lattices are handled at once.
TOGETHER = 8_192
#: Rows, and characters of text, that are searched at once; a longer text goes alone.
ROWS, SIGNS = 128, 500_000
#: Code points up to which a unit's weights are multiplied as they are, if none can underflow; others are added up as logarithms.
SHORT = 40
#: Logarithm above which the least weight that a way of a unit may have is far from underflow.
LEAST_LOG = -650.0
_ALL = (1 << 64) - 1


def _log_sum(*logs: float) -> float:
    most = max(logs)
    return most + math.log(math.fsum([math.exp(x - most) for x in logs])) if most > -math.inf else most


def _uniform(seed: int, step: int) -> float:
    """A number from 0 to 1 for each step of the draw that has this seed, whatever else is drawn beside it."""
    z = seed + (step + 1) * 0x9E3779B97F4A7C15 & _ALL
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _ALL
    return ((z ^ z >> 31) >> 11) * 2.0**-53


def _uniforms(seeds: np.ndarray, step: int) -> np.ndarray:
    """The same for many draws at once."""
    z = seeds + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & _ALL)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Trie:
    """All prefixes of the pieces as states; a step from many states at once is a lookup in a hash table of (state, sign)."""

    def __init__(self, pieces: list[tuple[str, int, float]]) -> None:
        signs = sorted({c for piece, _, _ in pieces for c in piece})
        #: Number of a sign by its code point, 0 if no piece has it.
        self.sign = np.zeros(0x110000, np.int32)
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.n_signs = len(signs) + 1
        number = {c: i for i, c in enumerate(signs, 1)}
        steps: dict[int, int] = {}
        ends: list[tuple[int, int, float]] = []
        for piece, i, w in pieces:
            state = 0
            for c in piece:
                state = steps.setdefault(state * self.n_signs + number[c], len(steps) + 1)
            ends.append((state, i, w))
        #: The piece that ends in a state (-1: none) and its weight.
        self.piece, self.weight = np.full(len(steps) + 1, -1, np.int32), np.zeros(len(steps) + 1)
        for state, i, w in ends:
            self.piece[state], self.weight[state] = i, w
        with np.errstate(divide="ignore"):
            self.log_weight = np.log(self.weight)
        self.shift = np.uint64(64 - (len(steps) * 8).bit_length())
        size = 1 << 64 - int(self.shift)
        self.keys, self.to = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int32)
        self.probes = 1
        for key, at in zip(steps, self._slot(np.fromiter(steps, np.int64, len(steps))).tolist()):
            first = at
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.to[at] = key, steps[key]
            self.probes = max(self.probes, at - first + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, states: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """The state after each state's sign, 0 if no piece goes on like that."""
        keys = states.astype(np.int64) * self.n_signs + signs
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.to[at], 0)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            there = at[open_] + probe
            found = self.keys[there] == keys[open_]
            out[open_[found]] = self.to[there[found]]
            open_ = open_[~found & (self.keys[there] >= 0)]
        return out


class Ways:
    """The lattices of many units at once, none of which can underflow or goes as bytes.

    The units stand one after the other with a place between them, so a unit of n signs has n + 1 places. An edge is
    a piece from one place to another. top is the mass of the best way to a place, rest that of all other ways, each
    added up apart; back is the last edge of the best way.
    """

    def __init__(self, trie: Trie, units: list[str]) -> None:
        self.trie = trie
        codes = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le"), np.uint32)
        self.sizes = np.fromiter(map(len, units), np.int64, len(units))
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.last = self.first + self.sizes
        signs = trie.sign[codes]
        offset = np.arange(len(codes)) - np.repeat(self.first, self.sizes + 1)
        at = np.flatnonzero(signs)
        states, found, length = np.zeros(len(at), np.int32), [], 0
        while len(at):
            states = trie.step(states, signs[at + length])
            length += 1
            at, states = at[states > 0], states[states > 0]
            ends = trie.piece[states] >= 0
            found.append((at[ends], states[ends], length))
        start = np.concatenate([x[0] for x in found] or [np.empty(0, np.int64)])
        state = np.concatenate([x[1] for x in found] or [np.empty(0, np.int32)])
        end = start + np.repeat([x[2] for x in found], [len(x[0]) for x in found]).astype(np.int64)
        away = offset[start].astype(np.uint16)
        order = np.argsort(away, kind="stable")
        self.start, self.end, self.state = start[order], end[order], state[order]
        self.top, self.rest, self.back = np.zeros(len(codes)), np.zeros(len(codes)), np.full(len(codes), -1, np.int64)
        self.top[self.first] = 1.0
        bounds = np.searchsorted(away[order], np.arange(int(self.sizes.max(initial=0)) + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):  # edges from one offset never end in the same place
            p, t, w = self.start[a:b], self.end[a:b], trie.weight[self.state[a:b]]
            x, old = self.top[p] * w, self.top[t]
            better = x > old
            self.rest[t] += np.where(better, old, x) + self.rest[p] * w
            self.top[t] = np.where(better, x, old)
            self.back[t] = np.where(better, np.arange(a, b), self.back[t])

    def _joined(self, steps: list[tuple[np.ndarray, np.ndarray]], n: int, kind: np.dtype) -> list[bytes]:
        """The ids of n ways that were walked from their end: each step holds the ways still under way and their edges."""
        counts = np.zeros(n, np.int64)
        for ways, _ in steps:
            counts[ways] += 1
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if n else 0, kind)
        for k, (ways, edges) in enumerate(steps):
            ids[ends[ways] - 1 - k] = self.trie.piece[self.state[edges]]
        raw, size = ids.tobytes(), kind.itemsize
        cuts = (ends * size).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def best(self, kind: np.dtype) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Per unit the ids of its best way, and the logarithms of its probability and of all other ways'."""
        steps, ways, at = [], np.arange(len(self.sizes)), self.last
        while len(ways):
            edges = self.back[at]
            steps.append((ways, edges))
            at = self.start[edges]
            going = at > self.first[ways]
            ways, at = ways[going], at[going]
        with np.errstate(divide="ignore"):
            ratio = np.log(self.rest[self.last] / self.top[self.last])
        log_p = -np.logaddexp(0.0, ratio)
        return self._joined(steps, len(self.sizes), kind), log_p, ratio + log_p

    def draw(self, unit: np.ndarray, seeds: np.ndarray, kind: np.dtype) -> tuple[list[bytes], np.ndarray]:
        """A way of each unit (by its place in the list) other than its best, by its probability; and the logarithm of that."""
        order = np.argsort(self.end, kind="stable")
        firsts = np.searchsorted(self.end[order], np.arange(len(self.top) + 1))
        whole, weight = self.top + self.rest, self.trie.weight[self.state]
        steps, logs = [], -np.log(whole[self.last[unit]])
        ways, at, on_best = np.arange(len(unit)), self.last[unit], np.ones(len(unit), bool)
        while len(ways):
            left = _uniforms(seeds[ways], len(steps)) * np.where(on_best, self.rest[at], whole[at])
            chosen = np.full(len(ways), -1, np.int64)
            k, open_ = 0, np.arange(len(ways))
            while len(open_):
                place = firsts[at[open_]] + k
                there = place < firsts[at[open_] + 1]
                open_, edge = open_[there], order[place[there]]
                best = on_best[open_] & (edge == self.back[at[open_]])
                mass = np.where(best, self.rest[self.start[edge]], whole[self.start[edge]]) * weight[edge]
                some = mass > 0
                chosen[open_[some]] = edge[some]  # the last with any mass holds, should rounding pass them all
                left[open_] -= mass
                open_ = open_[left[open_] >= 0]
                k += 1
            steps.append((ways, chosen))
            logs[ways] += self.trie.log_weight[self.state[chosen]]
            on_best = on_best & (chosen == self.back[at])
            at = self.start[chosen]
            going = at > self.first[unit[ways]]
            ways, at, on_best = ways[going], at[going], on_best[going]
        return self._joined(steps, len(unit), kind), logs


class Pieces:
    """The bytes of each id of a model."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.raw: list[bytes] = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" for i in range(size)]
        #: Ids of pieces that are neither bytes nor control signs, by their order in the model.
        self.plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        for i in self.plain:
            self.raw[i] = model.id_to_piece(i).replace(SPACE, " ").encode()

        #: All ids' bytes in one row, with the place and number of each id's.
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.sizes = np.fromiter(map(len, self.raw), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: bytes) -> str:
        return self.decode_many([ids])[0]

    def decode_many(self, rows: list[bytes]) -> list[str]:
        """The text of each row of ids, without the space that is put before a text."""
        ids = np.frombuffer(b"".join(rows), self.kind)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        signs = self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        last = np.cumsum(np.fromiter((len(r) // self.kind.itemsize for r in rows), np.int64, len(rows)))
        cuts = np.concatenate(([0], ends))[last].tolist()
        return [signs[a:b].decode("utf-8", "replace")[1:] for a, b in zip([0, *cuts], cuts)]


class Lattice(Pieces):
    def __init__(self, model_file: str, alpha: float = 1.0) -> None:
        import ahocorasick

        super().__init__(model_file)
        model, size = self.model, len(self.raw)
        coded = [int(i).to_bytes(self.kind.itemsize, "little") for i in range(size)]
        harmonic = math.fsum(1 / (i + RANK_SHIFT) for i in range(size))
        self.byte_ids = [coded[model.piece_to_id(f"<0x{b:02X}>")] for b in range(256)]
        #: What a byte costs of a character that is no piece.
        self.byte_log_p = -alpha * (math.log(size * harmonic) + BYTE_COST)
        self.single: set[str] = set()
        #: Finds all pieces in a unit: length, id, weight.
        self.finder = ahocorasick.Automaton()
        pieces: list[tuple[str, int, float]] = []
        for rank, i in enumerate(self.plain):
            piece = self.raw[i].decode()
            weight = ((rank + RANK_SHIFT) * harmonic) ** -alpha
            self.finder.add_word(piece, (len(piece), coded[i], weight))
            pieces.append((piece, i, weight))
            if len(piece) == 1:
                self.single.add(piece)
        self.finder.make_automaton()
        self.trie = Trie(pieces)
        #: The least logarithm of a piece's weight.
        self.least_log = -alpha * math.log(max(1.0, (len(self.plain) - 1 + RANK_SHIFT) * harmonic))
        self.forget(0)

    def edges(self, unit: str) -> list[tuple[int, tuple[int, bytes, float]]]:
        """The pieces in a unit by their last place: length, ids, weight. A character that is no piece goes as bytes."""
        found = list(self.finder.iter(unit))
        if not self.single.issuperset(unit):
            for i, sign in enumerate(unit):
                if sign not in self.single:
                    raw = sign.encode()
                    found.append((i, (1, b"".join([self.byte_ids[b] for b in raw]), math.exp(len(raw) * self.byte_log_p))))
            found.sort(key=lambda e: e[0])
        return found

    def _lattice(self, unit: str) -> tuple[list, list]:
        """For each place the edges that end there (start, ids, weight) and the sum of their weights.

        A weight is the mass of all ways to the place over that edge; where it could underflow, weights are scaled to sum up to 1.
        """
        n = len(unit)
        into: list[list] = [[] for _ in range(n + 1)]
        if self._safe(unit):
            mass = [1.0] + [0.0] * n
            for last, (size, ids, w) in self.finder.iter(unit) if self.single.issuperset(unit) else self.edges(unit):
                i = last + 1 - size
                x = mass[i] * w
                mass[last + 1] += x
                into[last + 1].append((i, ids, x))
            return into, mass
        for last, (size, ids, w) in self.edges(unit):
            into[last + 1].append((last + 1 - size, ids, math.log(w)))
        log_mass = [0.0] * (n + 1)
        for j in range(1, n + 1):
            logs = [e[2] + log_mass[e[0]] for e in into[j]]
            most = max(logs)
            log_mass[j] = most + math.log(math.fsum([math.exp(x - most) for x in logs]))
            into[j] = [(e[0], e[1], math.exp(x - log_mass[j])) for e, x in zip(into[j], logs)]
        return into, [1.0] * (n + 1)

    def _safe(self, unit: str) -> bool:
        """True if no way of the unit can underflow: then its weights are multiplied as they are."""
        if len(unit) > SHORT:
            return False
        if self.single.issuperset(unit):
            return len(unit) * self.least_log > LEAST_LOG
        return sum(self.least_log if sign in self.single else len(sign.encode()) * self.byte_log_p for sign in unit) > LEAST_LOG

    def _together(self, unit: str) -> bool:
        """True if the unit's lattice may be one of many in Ways."""
        return len(unit) <= SHORT and len(unit) * self.least_log > LEAST_LOG and self.single.issuperset(unit)

    def _add(self, units: list[str]) -> None:
        """Number new units; their best segmentation is kept with the logarithms of its probability and of all others'.

        The best way's mass and that of the other ways are added up apart, so neither is the other's rounding.
        """
        for i in range(0, len(units), TOGETHER):
            part = units[i : i + TOGETHER]
            joint = list(map(self._together, part))
            many = [u for u, x in zip(part, joint) if x]
            alone = [u for u, x in zip(part, joint) if not x]
            best, log_p, other = Ways(self.trie, many).best(self.kind) if many else ([], np.empty(0), np.empty(0))
            singly = [self._best(u) for u in alone]
            self.number.update(zip([*many, *alone], range(len(self.units), len(self.units) + len(part))))
            self.units += [*many, *alone]
            self.best += [*best, *[x[0] for x in singly]]
            logs = np.stack((np.concatenate((log_p, [x[1] for x in singly])), np.concatenate((other, [x[2] for x in singly])), np.arange(len(part)) < len(many)))
            while self.filled + len(part) > self.logs.shape[1]:
                self.logs = np.concatenate((self.logs, np.empty_like(self.logs)), axis=1)
                self.used = np.concatenate((self.used, np.zeros_like(self.used)))
            self.logs[:, self.filled : self.filled + len(part)] = logs
            self.filled += len(part)

    def _best(self, unit: str) -> tuple[bytes, float, float]:
        """One unit's best segmentation, and the logarithms of its probability and of all others', by sums of logarithms."""
        n = len(unit)
        back: list[tuple] = [(0, b"")] * (n + 1)
        top, rest = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)
        for last, (size, ids, w) in self.edges(unit):
            j = last + 1
            i, log_w = j - size, math.log(w)
            x = top[i] + log_w
            if x > top[j]:
                rest[j] = _log_sum(rest[j], top[j], rest[i] + log_w)
                top[j], back[j] = x, (i, ids)
            else:
                rest[j] = _log_sum(rest[j], x, rest[i] + log_w)
        ratio = rest[n] - top[n]
        parts, at = [], n
        while at:
            at, ids = back[at]
            parts.append(ids)
        log_p = -_log_sum(0.0, ratio)
        return b"".join(reversed(parts)), log_p, ratio + log_p

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The units of each text (with a space put before it, as the model does) by number."""
        units = [UNIT.findall(" " + t) for t in texts]
        found = [list(map(self.number.get, each)) for each in units]
        holes: list[tuple[list, int, str]] = []
        for each, got in zip(units, found):
            at = -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                holes.append((got, at, each[at]))
        if holes:
            self._add(list({unit for _, _, unit in holes}))
            for got, at, unit in holes:
                got[at] = self.number[unit]
        out = [np.array(got, np.int64) for got in found]
        if out:
            self.used += np.bincount(np.concatenate(out), minlength=len(self.used))
        return out

    def forget(self, more_than: int | None = None) -> None:
        """Called between batches of texts: keep memory bounded. What is forgotten is worked out again, with the same result."""
        if more_than is None and len(self.units) <= REMEMBERED:
            return
        if more_than is not None:
            self.number: dict[str, int] = {}
            self.units: list[str] = []
            self.best: list[bytes] = []
            #: Logarithms of the probability of each unit's best segmentation and of all others', and whether it is one of many in Ways.
            self.logs, self.filled = np.empty((3, 1 << 12)), 0
            #: How often each unit came up since the last time that some were forgotten.
            self.used = np.zeros(1 << 12, np.int64)
            return
        keep = np.flatnonzero(self.used[: self.filled] > 1)
        if len(keep) > REMEMBERED // 2:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: REMEMBERED // 2]])
        self.units, self.best = [self.units[i] for i in keep.tolist()], [self.best[i] for i in keep.tolist()]
        self.number = dict(zip(self.units, range(len(keep))))
        self.logs[:, : len(keep)], self.filled = self.logs[:, keep], len(keep)
        self.used[:] = 0

    @staticmethod
    def _barred(into: list, mass: list, barred: frozenset[bytes]) -> list:
        """The tree of some segmentations from the end: place, nodes by edge, and each edge's mass without theirs, and the sum of that.

        The mass left is added up from what is left behind each edge, never taken as a difference.
        """
        root: list = [len(into) - 1, {}, [], 0.0]
        nodes = [root]
        for ids in barred:
            node, end = root, len(ids)
            while node[0]:
                for e, (start, part, _) in enumerate(into[node[0]]):
                    if ids.endswith(part, 0, end):
                        break
                if e not in node[1]:
                    node[1][e] = [start, {}, [], 0.0]
                    nodes.append(node[1][e])
                node, end = node[1][e], end - len(part)
        for node in reversed(nodes):
            if node[0]:
                left = [e[2] for e in into[node[0]]]
                for e, child in node[1].items():
                    left[e] *= child[3] / mass[child[0]]
                node[2], node[3] = left, sum(left)
        return root

    def left_log(self, k: int, without: frozenset[bytes]) -> float:
        """The logarithm of the probability of all segmentations of unit k but some."""
        into, mass = self._lattice(self.units[k])
        left = self._barred(into, mass, without)[3]
        return math.log(left / mass[-1]) if left else -math.inf

    def draw(self, k: int, seed: int, without: frozenset[bytes]) -> tuple[bytes, float]:
        """A segmentation of unit k other than those in without, by its probability; and the logarithm of that."""
        into, mass = self._lattice(self.units[k])
        barred = self._barred(into, mass, without)
        step = 0
        while True:
            at, parts, p, log_p, met = len(into) - 1, [], 1.0, 0.0, barred
            while at:
                here = into[at]
                u = _uniform(seed, step)
                step += 1
                if met is not None:  # from each edge goes the mass of what is barred behind it
                    u *= met[3]
                    for i, x in enumerate(met[2]):
                        u -= x
                        if u < 0:
                            break
                    e, met = here[i], met[1].get(i)
                elif len(here) == 1:
                    e = here[0]
                else:
                    u *= mass[at]
                    for e in here:
                        u -= e[2]
                        if u < 0:
                            break
                parts.append(e[1])
                p *= e[2] / mass[at]
                if p < 1e-100:
                    log_p, p = log_p + math.log(p), 1.0
                at = e[0]
            parts.reverse()
            out = b"".join(parts)
            if out not in without:
                return out, log_p + math.log(p)

    def draw_others(self, units: np.ndarray, seeds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """A segmentation other than its best for each of the units (by number, repeats allowed), many units at once."""
        ids: list[bytes] = [b""] * len(units)
        logs = np.empty(len(units))
        which, place = np.unique(units, return_inverse=True)
        together = self.logs[2, which] > 0
        for i in np.flatnonzero(~together[place]).tolist():
            k = int(units[i])
            ids[i], logs[i] = self.draw(k, int(seeds[i]), frozenset({self.best[k]}))
        index = np.cumsum(together) - 1
        mine = np.flatnonzero(together[place])
        mine = mine[np.argsort(place[mine], kind="stable")]
        listed = [self.units[k] for k in which[together].tolist()]
        for a in range(0, len(listed), TOGETHER):
            here = mine[(index[place[mine]] >= a) & (index[place[mine]] < a + TOGETHER)]
            got, log_p = Ways(self.trie, listed[a : a + TOGETHER]).draw(index[place[here]] - a, seeds[here], self.kind)
            logs[here] = log_p
            for i, x in zip(here.tolist(), got):
                ids[i] = x
        return ids, logs

    def encode(self, text: str) -> bytes:
        """The likeliest segmentation."""
        return b"".join(map(self.best.__getitem__, self.numbers([text])[0].tolist()))


class Leaf:
    """A segmentation of a text: the best one of each unit but for some, with the log-probability of each unit's."""

    def __init__(self, other: dict[int, bytes], log_p: np.ndarray, value: float) -> None:
        self.other, self.log_p, self.value = other, log_p, value


def _below(log_mass: np.ndarray, top: float, rng: np.random.Generator) -> np.ndarray:
    """Maxima of Gumbel processes of these log-masses, given that they are below top."""
    return log_mass - np.log(np.exp(np.minimum(log_mass - top, 700.0)) + rng.exponential(size=np.shape(log_mass)))


class Search:
    """The search in one text. Its draws are asked for by begin() and handed in by end(), so that those of many texts go together."""

    def __init__(self, lattice: Lattice, units: np.ndarray, rng: np.random.Generator) -> None:
        self.lattice, self.units, self.rng = lattice, units, rng
        self.best_log, self.other_log = lattice.logs[0, units], lattice.logs[1, units]
        self.best_p = np.exp(self.best_log)
        self.leaves: list[Leaf] = []
        #: Nodes by leaf: value and log-mass at each unit; extra ones, where a unit has lost two choices or more.
        self.nodes: list[np.ndarray] = []
        self.extra: list[tuple[float, int, int, frozenset[bytes], float]] = []
        self.split: tuple | None = None
        self.begin({}, self.best_log.copy(), 0, -math.log(rng.exponential()))

    def begin(self, other: dict[int, bytes], log_p: np.ndarray, start: int, value: float) -> None:
        """From unit start on all units are drawn: those that don't take their best segmentation ask for another."""
        at = np.flatnonzero(self.rng.random(len(self.units) - start) >= self.best_p[start:]) + start
        self.asked, self.seeds = at, self.rng.integers(0, _ALL, len(at), np.uint64, endpoint=True)
        self.under_way = other, log_p, start, value

    def end(self, ids: list[bytes], logs: np.ndarray) -> None:
        """A leaf; every choice not taken becomes a node."""
        other, log_p, start, value = self.under_way
        other.update(zip(self.asked.tolist(), ids))
        log_p[self.asked] = logs
        before = np.cumsum(log_p) - log_p
        left, drawn = self.other_log.copy(), list(other)
        left[drawn] = np.log(-np.expm1(log_p[drawn]))  # at least a half: a better one is left
        log_mass = before + left
        values = np.full(len(log_p), -np.inf)
        values[start:] = _below(log_mass[start:], value, self.rng)
        values[np.isneginf(log_mass)] = -np.inf
        self.leaves.append(Leaf(other, log_p, value))
        self.nodes.append(values)
        if self.split:
            leaf, unit, at, taken, lost = self.split
            rest = 1 - lost
            log_rest = math.log(rest) if rest > 1e-3 else self.lattice.left_log(unit, taken)
            if log_rest > -math.inf:
                log_rest += float(leaf.log_p[:at].sum())
                self.extra.append((float(_below(np.array(log_rest), value, self.rng)), len(self.leaves) - 1, at, taken, lost))

    def top(self) -> tuple[float, int]:
        """The largest value of a node, and which: a leaf's number, or -1 - that of an extra one."""
        return max([(float(v.max(initial=-np.inf)), i) for i, v in enumerate(self.nodes)] + [(e[0], -1 - i) for i, e in enumerate(self.extra)])

    def next(self) -> bool:
        """Split the best node, if there is one: the way down from its maximum begins."""
        value, which = self.top()
        if value == -math.inf:
            return False
        if which >= 0:
            leaf, at = self.leaves[which], int(self.nodes[which].argmax())
            self.nodes[which][at] = -np.inf
            taken = frozenset({leaf.other.get(at, self.lattice.best[self.units[at]])})
            lost = math.exp(leaf.log_p[at])
        else:
            _, i, at, taken, lost = self.extra.pop(-1 - which)
            leaf = self.leaves[i]
        unit = int(self.units[at])
        choice, log_q = self.lattice.draw(unit, int(self.rng.integers(0, _ALL, dtype=np.uint64, endpoint=True)), taken)
        other = {i: x for i, x in leaf.other.items() if i < at}
        if choice != self.lattice.best[unit]:
            other[at] = choice
        log_p = np.concatenate((leaf.log_p[:at], [log_q], self.best_log[at + 1 :]))
        self.split = leaf, unit, at, taken | {choice}, lost + math.exp(log_q)
        self.begin(other, log_p, at + 1, value)
        return True


def search(lattice: Lattice, texts: list[str], k: int, rngs: list[np.random.Generator]) -> list[Search]:
    """For each text its units, at most k distinct segmentations by descending perturbed value, and the nodes that are left."""
    every = [Search(lattice, units, rng) for units, rng in zip(lattice.numbers(texts), rngs)]
    live = every
    for i in range(k):
        if i:
            live = [s for s in live if s.next()]
        asked = [s.units[s.asked] for s in live]
        ids, logs = lattice.draw_others(np.concatenate([*asked, np.empty(0, np.int64)]), np.concatenate([*[s.seeds for s in live], np.empty(0, np.uint64)]))
        at = 0
        for s, mine in zip(live, asked):
            s.end(ids[at : at + len(mine)], logs[at : at + len(mine)])
            at += len(mine)
    return every


def lattice(model_file: str, alpha: float = 2.0) -> Lattice:
    """The lattice of this worker process, which outlives its tasks."""
    return kept(("lattice", model_file, alpha), lambda: Lattice(model_file, alpha))


def samples(own: Lattice, keys: list[int | None], texts: list[str | None], k: int, seed: int = 0) -> list[list[tuple]]:
    """For each text: rank, ids, number of ids, log-probability, perturbed value and inclusion score of each segmentation drawn."""
    own.forget()
    rngs = [np.random.Generator(np.random.Philox(key=[(key or 0) & _ALL, (seed << 1) + (key is None)])) for key in keys]
    out = []
    for s in search(own, [t or "" for t in texts], k, rngs):
        best, rest, rows = list(map(own.best.__getitem__, s.units.tolist())), s.top()[0], []
        for rank, leaf in enumerate(s.leaves, 1):
            parts = best.copy()
            for i, ids in leaf.other.items():
                parts[i] = ids
            ids, log_p = b"".join(parts), float(leaf.log_p.sum())
            inclusion = -math.expm1(-math.exp(min(log_p - rest, 700.0))) if rest > -math.inf else 1.0
            rows.append((rank, ids, len(ids) // own.kind.itemsize, log_p, leaf.value, inclusion))
        out.append(rows)
    return out


def portions(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """A batch's keys and texts in portions of at most ROWS rows, and of SIGNS characters unless one text is longer."""
    for i in range(0, batch.num_rows, ROWS):
        keys, texts = (c.to_pylist() for c in batch.slice(i, ROWS).columns)
        first = size = 0
        for j, text in enumerate(texts):
            if size and size + len(text or "") > SIGNS:
                yield keys[first:j], texts[first:j]
                first, size = j, 0
            size += len(text or "")
        yield keys[first:], texts[first:]


def encode_samples(docs: DataFrame, model_file: str, k: int = 2, alpha: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, rank, ids, n_tokens, log_prob, perturbed, inclusion): up to k distinct segmentations of each row.

    ids are little-endian numbers (16 bits if the vocabulary allows). Draws are seeded by doc_id alone, so equal rows
    get equal rows whatever the partitions. A null text is empty and has one segmentation (of the space put before
    it); fewer than k rows come where a text has fewer segmentations. A very long text is one search of its own; what it
    needs grows with its words. Other columns are ignored, so their names may be any. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model_file, alpha)
        for batch in batches:
            for keys, texts in portions(batch):
                rows = [(key, *x) for key, found in zip(keys, samples(own, keys, texts, k, seed)) for x in found]
                columns = list(zip(*rows)) or [()] * 7
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "rank", "ids", "n_tokens", "log_prob", "perturbed", "inclusion"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(lean(run), "doc_id long, rank int, ids binary, n_tokens long, log_prob double, perturbed double, inclusion double")


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with the text of their ids as a last column; null ids give null.

    If the rows have a column of that name already, it stays, and the new one gets underscores after its name.
    """
    text_col = unused(text_col, rows)
    names = [*rows.columns, text_col]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("pieces", model_file), lambda: Pieces(model_file))
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                ids = part.column(at).to_pylist()
                texts = pa.array([None if x is None else t for x, t in zip(ids, own.decode_many([x or b"" for x in ids]))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names)

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of every document, with the hash of the text that is decoded from each."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode_samples(documents(spark, sf_dir), model), model)
    return out.select("doc_id", "rank", "n_tokens", F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "inclusion", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
