"""Operator 6: SentencePiece encoding and decoding with Gumbel top-k sampling.

A text's segmentations are the paths of a lattice whose arcs are vocabulary pieces (or the
byte pieces of a character that no piece covers). An arc of the piece with rank r weighs
(r + 2) ** -alpha, r being the negated score in a BPE model, and a path has the product of
its arcs' weights as its unnormalised probability. No piece crosses from a letter to a word
mark, and two characters side by side in no piece are always apart, so the lattice is a chain
of small lattices, one for each unit (about a word).

Sampling without replacement is a best-first (A*) search over sets of paths: a set with log
probability phi has the Gumbel(phi) maximum of its members as its priority. Popping a set
draws its best member unit by unit; what the draw leaves out splits into one set for each
unit ("same units before, another segmentation here"), whose maximum is a Gumbel truncated
at the popped value. The first k pops are the k largest perturbed paths, hence k distinct
segmentations drawn without replacement. Random numbers come from a counter-based generator
keyed by seed and row key, so a row gives the same samples wherever it runs.

The texts of a batch are drawn together in flat arrays. Each unit of the pool knows its likeliest
path and the mass of all its others, so most units of a draw are one comparison and one copy;
the rest walk their lattice in step, under the condition that they leave the likeliest path.

Inclusion score: 1 - exp(-exp(phi - kappa)), kappa being the (k+1)-th largest perturbed value;
1.0 when fewer than k+1 segmentations exist. A text with fewer segmentations gives all of
them, however unlikely (masses are sums of positive terms, down to the smallest double). Null
texts give no rows; an empty text gives one row with no pieces. Decoding inverts encoding
exactly, and every sample is decoded and compared with its text. Repeated rows with one id
give the same samples; rows without an id are keyed by their text."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gneiss.llm.common import col, give_back, map_rows

MARK = "▁"
ALPHA = 1.5
SAMPLES = 3
#: Arcs that a worker remembers before it starts anew, and characters worked on at once.
MEMO = 1_000_000
CHARS = 100_000
#: Units whose lattices are built at once.
BUILD = 4_000
REDRAWS = 3
_U64 = np.uint64
_SLOTS = 21


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 as numbers in (0, 1)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return ((x ^ (x >> _U64(31))) >> _U64(11)).astype(np.float64) / 2**53 + 2**-54


def _start(key: int, stream: int) -> np.uint64:
    return _U64((key * 0x9E3779B97F4A7C15 + stream * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)


def _at(start, place, step: int = 0) -> np.ndarray:
    """Numbers that depend on a start, a place in the text and a step only."""
    with np.errstate(over="ignore"):
        return _mix(start + (place.astype(_U64) << _U64(20)) + _U64(step) * _U64(0x9E3779B97F4A7C15))


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _numbers(start):
    """A stream of numbers of its own for a start."""
    for i in itertools.count():
        yield from _at(start ^ _U64(1 << 63), np.arange(i * 32, i * 32 + 32)).tolist()


class _Pool:
    """Arrays that grow at their end."""

    def __init__(self, kinds: dict[str, type]):
        self.room = {name: np.zeros(0, kind) for name, kind in kinds.items()}
        self.used = dict.fromkeys(kinds, 0)

    def append(self, name: str, values: np.ndarray) -> np.ndarray:
        n, room = self.used[name], self.room[name]
        if n + len(values) > len(room):
            grown = np.zeros(max(4096, 3 * (n + len(values)) // 2), room.dtype)
            grown[:n] = room[:n]
            room = self.room[name] = grown
        room[n : n + len(values)] = values
        self.used[name] = n + len(values)
        return room[: self.used[name]]

    def keep(self, name: str, values: np.ndarray) -> np.ndarray:
        """These values, of those held, alone."""
        self.room[name][: len(values)] = values
        self.used[name] = len(values)
        return self.room[name][: len(values)]


class Lattices:
    """The lattices of a list of units, as flat arrays.

    ``arcs`` holds the first arc of each node, the one that the likeliest path takes; ``other``
    the mass of all paths from a node but that one; ``best`` the pieces of each unit's likeliest
    path, from ``best_at`` on."""

    def __init__(self, units: list[str], tables):
        self.tables = tables
        data = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), size)
        self.first = np.cumsum(size + 1) - size - 1
        self.last = self.first + size
        chars = np.arange(len(data))
        node = chars + unit
        left = self.last[unit] - node
        # Extend every start by one character while some piece begins like that.
        starts, ends, pieces, turns = [], [], [], []
        many = np.zeros(len(data), np.int64)
        live, h, step = chars, np.zeros(len(chars), _U64), 0
        while len(live):
            with np.errstate(over="ignore"):
                h = h * tables.factor + data[live + step] + _U64(1)
            at, known = tables.find(h)
            piece = np.where(known, tables.piece[at], -1)
            hit = piece >= 0
            if not step and not hit.all():
                bare = ~hit
                point = data[live[bare]].astype(np.int64)
                piece[bare] = np.where(point < 128, tables.ascii[np.minimum(point, 127)], -2 - point)
                hit = np.ones(len(live), bool)
            step += 1
            begin = live[hit]
            starts.append(begin)
            ends.append(node[begin] + step)
            pieces.append(piece[hit])
            turns.append(many[begin])
            many[begin] += 1
            on = known & (left[live] > step)
            live, h = live[on], h[on]
        nodes = int(self.last[-1]) + 1 if len(units) else 0
        counts = np.zeros(nodes, np.int64)
        counts[node] = many
        self.arcs = np.append(0, np.cumsum(counts))
        n_arcs = int(self.arcs[-1])
        begin, rank, self.to, self.piece = (np.zeros(n_arcs, np.int64) for _ in range(4))
        for s, e, p, t in zip(starts, ends, pieces, turns, strict=True):
            here = node[s]
            where = self.arcs[here] + t
            begin[where], rank[where], self.to[where], self.piece[where] = here, left[s], e, p
        weight = tables.log_weight[np.maximum(self.piece, 0)]  # byte pieces have theirs, too
        for i in np.flatnonzero(self.piece < 0).tolist():
            weight[i] = tables.byte_log * len(tables.bytes_of(int(self.piece[i])))
        self.prob, self.other, best_log, best_arc = np.zeros(n_arcs), np.zeros(nodes), np.zeros(nodes), np.zeros(nodes, np.int64)
        # Log masses from each position to its unit's end, the nearest positions first.
        mass = np.zeros(nodes)
        far = int(rank.max()) if n_arcs else 0
        by = np.argsort(rank.astype(np.uint16) if far < 1 << 16 else rank, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(rank, minlength=far + 1)))[1:]
        # All in that order: the arcs, where those of each node begin, and the node's turn.
        begin, to, weight, prob = begin[by], self.to[by], weight[by], np.zeros(n_arcs)
        change = np.append(True, begin[1:] != begin[:-1])[:n_arcs]
        heads = np.flatnonzero(change)
        turn, at_node, edges = np.cumsum(change) - 1, begin[heads], np.searchsorted(heads, cuts)
        for lo, hi, x0, x1 in zip(cuts[:-1].tolist(), cuts[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            there, head, owner, at = to[lo:hi], heads[x0:x1] - lo, turn[lo:hi] - x0, at_node[x0:x1]
            x = weight[lo:hi] + mass[there]
            top = np.maximum.reduceat(x, head)
            p = np.exp(x - top[owner])
            whole = np.add.reduceat(p, head)
            p /= whole[owner]
            mass[at] = top + np.log(whole)
            prob[lo:hi] = p
            path = np.log(np.maximum(p, 1e-300)) + best_log[there]
            likeliest = np.maximum.reduceat(path, head)
            fits = np.flatnonzero(path == likeliest[owner])
            if len(fits) > len(head):
                fits = fits[np.append(True, owner[fits][1:] != owner[fits][:-1])]
            best_log[at], best_arc[at] = likeliest, by[fits + lo]
            p[fits] *= self.other[there[fits]]
            self.other[at] = np.add.reduceat(p, head)
        self.prob[by] = prob
        # The likeliest path's arc comes first.
        swap = np.flatnonzero((counts > 1) & (best_arc != self.arcs[:-1]))
        x, y = self.arcs[swap], best_arc[swap]
        for a in (self.to, self.piece, self.prob):
            a[x], a[y] = a[y], a[x]
        self.best_log = best_log[self.first] if nodes else np.zeros(0)
        at, live, found, owners = self.first.copy(), np.flatnonzero(size > 0), [], []
        while len(live):
            arc = self.arcs[at[live]]
            found.append(self.piece[arc])
            owners.append(live)
            at[live] = self.to[arc]
            live = live[at[live] < self.last[live]]
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        found = np.concatenate(found)[order] if len(owner) else owner
        self.best, lens = tables.spelled(found, np.bincount(owner, minlength=len(units)))
        self.best_at, self.best_len = np.cumsum(lens) - lens, lens

    FIELDS = (
        ("first", np.int64), ("last", np.int64), ("best_log", np.float64), ("best_at", np.int64), ("best_len", np.int64), ("best", np.int32),
        ("to", np.int32), ("piece", np.int32), ("prob", np.float64), ("other", np.float64),
    )

    @classmethod
    def pool(cls, tables) -> "Lattices":
        """No unit yet; :meth:`add` appends some."""
        self = cls([], tables)
        self.pooled = _Pool(dict(cls.FIELDS) | {"arcs": np.int64})
        self.arcs = self.pooled.append("arcs", np.zeros(1, np.int64))
        for name, kind in cls.FIELDS:
            setattr(self, name, np.zeros(0, kind))
        return self

    def add(self, units: list[str]) -> None:
        for at in range(0, len(units), BUILD):
            self._add(units[at : at + BUILD])

    def _add(self, units: list[str]) -> None:
        new, nodes, arcs, best = Lattices(units, self.tables), len(self.arcs) - 1, len(self.to), len(self.best)
        for name, _ in self.FIELDS:
            shift = nodes if name in ("first", "last", "to") else best if name == "best_at" else 0
            setattr(self, name, self.pooled.append(name, getattr(new, name) + shift if shift else getattr(new, name)))
        self.arcs = self.pooled.append("arcs", new.arcs[1:] + arcs)

    def arcs_of(self) -> np.ndarray:
        """How many arcs each unit has."""
        return self.arcs[self.last] - self.arcs[self.first]

    def keep(self, units: np.ndarray) -> None:
        """Drops all units of the pool but some, which are numbered anew in their order."""
        first, size, best_len = self.first[units], (self.last - self.first)[units] + 1, self.best_len[units]
        many, begin = self.arcs_of()[units], np.cumsum(size) - size
        nodes = np.repeat(first - begin, size) + np.arange(int(size.sum()))
        arcs = np.repeat(self.arcs[first] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        best = np.repeat(self.best_at[units] - (np.cumsum(best_len) - best_len), best_len) + np.arange(int(best_len.sum()))
        left = {
            "first": begin, "last": begin + size - 1, "best_log": self.best_log[units], "best_at": np.cumsum(best_len) - best_len, "best_len": best_len, "best": self.best[best],
            "to": self.to[arcs] - np.repeat(first - begin, many), "piece": self.piece[arcs], "prob": self.prob[arcs], "other": self.other[nodes],
            "arcs": np.append(0, np.cumsum((self.arcs[1:] - self.arcs[:-1])[nodes])),
        }
        for name in list(left):
            setattr(self, name, self.pooled.keep(name, left.pop(name)))

    def draw(self, units: np.ndarray, start: np.ndarray, place: np.ndarray):
        """A path for each unit: flat piece ids, how many each has, log probabilities, and the
        mass of the unit's other paths."""
        lens, log, rest = self.best_len[units], self.best_log[units], self.other[self.first[units]]
        odd = np.flatnonzero(rest > 2**-54)
        odd = odd[_at(start[odd], place[odd]) < rest[odd]]
        ids = more = None
        if len(odd):
            ids, more, log[odd] = self.unlikely(units[odd], start[odd], place[odd])
            lens[odd] = more
            rest[odd] = -np.expm1(log[odd])
        flat = np.take(self.best, np.repeat(self.best_at[units] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum())), mode="clip")
        if ids is not None:
            flat[np.repeat((np.cumsum(lens) - lens)[odd], more) + _ramp(more)] = ids
        return flat, lens, log, rest

    def unlikely(self, units: np.ndarray, start: np.ndarray, place: np.ndarray):
        """For each unit a path other than its likeliest: ids, how many, log probabilities."""
        n = len(units)
        node, stop, log = self.first[units], self.last[units], np.zeros(n)
        live, on, steps, owners, step = np.arange(n), np.ones(n, bool), [], [], 1
        while len(live):
            here, held = node[live], on[live]
            first, end = self.arcs[here], self.arcs[here + 1] - 1
            u = _at(start[live], place[live], step) * np.where(held, self.other[here], 1.0)
            u -= self.prob[first] * np.where(held, self.other[self.to[first]], 1.0)
            arc = first.copy()
            go = np.flatnonzero((u >= 0) & (first < end))
            while len(go):
                arc[go] += 1
                u[go] -= self.prob[arc[go]]
                go = go[(u[go] >= 0) & (arc[go] < end[go])]
            on[live] = held & (arc == first)
            log[live] += np.log(np.maximum(self.prob[arc], 1e-300))
            steps.append(self.piece[arc])
            owners.append(live)
            node[live] = self.to[arc]
            live = live[node[live] < stop[live]]
            step += 1
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        ids, lens = self.tables.spelled(np.concatenate(steps)[order].astype(np.int64), np.bincount(owner, minlength=n))
        return ids, lens, log

    def likeliest(self, unit: int) -> tuple[int, ...]:
        at = int(self.best_at[unit])
        return tuple(self.best[at : at + int(self.best_len[unit])].tolist())

    def _beside(self, unit: int, taken: list[tuple[int, ...]]):
        """(log mass, end, ids, taken paths that go on from there) of the arcs from the unit's
        start, each with the mass of its paths that are not taken."""

        def mass(at: int, log: float, ids: tuple[int, ...], left: list[tuple[int, ...]]) -> float:
            if at == stop:
                return 0.0 if left else math.exp(log)
            if not left:
                return math.exp(log)
            return sum(x[0] for x in options(at, log, ids, left))

        def options(at, log, ids, left):
            for a in range(int(self.arcs[at]), int(self.arcs[at + 1])):
                p = int(self.piece[a])
                j, new = int(self.to[a]), (*ids, *((p,) if p >= 0 else self.tables.bytes_of(p)))
                here = [t for t in left if t[: len(new)] == new]
                then = log + math.log(max(self.prob[a], 1e-300))
                yield mass(j, then, new, here), j, then, new, here

        stop = int(self.last[unit])
        return options

    def mass_beside(self, unit: int, taken: list[tuple[int, ...]]) -> float:
        """The mass of the unit's paths that are not taken, as a sum of positive terms."""
        return sum(x[0] for x in self._beside(unit, taken)(int(self.first[unit]), 0.0, (), taken))

    def beside(self, unit: int, taken: list[tuple[int, ...]], numbers) -> tuple[tuple[int, ...], float]:
        """A path of the unit that is not taken, drawn from what is left."""
        options, stop = self._beside(unit, taken), int(self.last[unit])
        at, log, ids, left = int(self.first[unit]), 0.0, (), taken
        while at < stop:
            found = [x for x in options(at, log, ids, left) if x[0] > 0]
            u = next(numbers) * sum(x[0] for x in found)
            for rest, j, then, new, here in found:
                if u < rest:
                    break
                u -= rest
            at, log, ids, left = j, then, new, here
        return ids, log


class _Tables:
    """The vocabulary: hashes of all beginnings of pieces, the piece that each one is or -1."""

    factor = _U64(0x9E3779B97F4A7C15)

    def __init__(self, begins: dict[int, int], log_weight: np.ndarray, byte_log: float, byte: dict[int, int]):
        keys = np.array(list(begins), _U64)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.piece = keys[order], np.array(list(begins.values()), np.int64)[order]
        self.head = np.searchsorted(slot[order], np.arange((1 << _SLOTS) + 1)).astype(np.int32)
        self.log_weight, self.byte_log, self.byte = log_weight, byte_log, byte
        self.ascii = np.array([byte[i] for i in range(128)], np.int64)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * _U64(0xD6E8FEB86659FD93)) >> _U64(64 - _SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is known."""
        slot = self._slot(h)
        at = np.minimum(self.head[slot], len(self.keys) - 1)
        known = self.keys[at] == h
        more = np.flatnonzero(~known)
        more = more[at[more] + 1 < self.head[slot[more] + 1]]
        while len(more):
            at[more] += 1
            known[more] = self.keys[at[more]] == h[more]
            more = more[~known[more]]
            more = more[at[more] + 1 < self.head[slot[more] + 1]]
        return at, known

    @functools.lru_cache(100_000)  # noqa: B019
    def bytes_of(self, piece: int) -> tuple[int, ...]:
        """Byte pieces of the character that stands as -2 - code point."""
        return tuple(self.byte[b] for b in chr(-2 - piece).encode("utf-8", "surrogatepass"))

    def spelled(self, pieces: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids, characters without a piece as their bytes, and how many each unit has."""
        bare = np.flatnonzero(pieces < 0)
        if not len(bare):
            return pieces.astype(np.int32), lens
        spelled = [self.bytes_of(p) for p in pieces[bare].tolist()]
        size = np.ones(len(pieces), np.int64)
        size[bare] = [len(b) for b in spelled]
        out = np.repeat(pieces, size)
        out[np.repeat((np.cumsum(size) - size)[bare], size[bare]) + _ramp(size[bare])] = [x for b in spelled for x in b]
        return out.astype(np.int32), np.bincount(np.repeat(np.arange(len(lens)), lens), weights=size, minlength=len(lens)).astype(np.int64)


@dataclass
class _Path:
    ids: np.ndarray
    ends: np.ndarray
    log: np.ndarray
    value: float


class _Text:
    """The search over one text's segmentations."""

    def __init__(self, units: np.ndarray, key: int):
        self.units, self.key, self.stream, self.out, self.order = units, key, 0, [], 0
        root = -math.log(-math.log(float(_at(_start(key, 0), np.zeros(1, np.int64))[0])))
        self.queue, self.kappa = [(-root, 0, None, 0, [])], -math.inf

    def pop(self, k: int):
        """The next set to open as (perturbed value, parent path, unit, taken), or None."""
        if not self.queue:
            return None
        value, _, parent, at, taken = heapq.heappop(self.queue)
        if len(self.out) == k:
            self.kappa, self.queue = -value, []
            return None
        self.stream += 1
        return -value, parent, at, taken

    def put(self, job, ids, ends, before, log, place_at, bound, k: int) -> None:
        """Adds the path drawn for a job and the sets that it leaves (places and bounds)."""
        value, parent, at, taken = job
        if parent:
            done = int(parent.ends[at])
            path = _Path(np.concatenate([parent.ids[:done], ids]), np.concatenate([parent.ends[:at], done + ends]), np.concatenate([parent.log[:at], before]), value)
        else:
            path = _Path(ids, ends, before, value)
        self.out.append(path)
        need = k + 1 - len(self.out)  # no more sets than that are opened still
        if len(bound) > need:
            best = np.argpartition(-bound, need - 1)[:need]
            place_at, bound = place_at[best], bound[best]
        for i, g in zip(place_at.tolist(), bound.tolist(), strict=True):
            self.order += 1
            gone = (tuple(ids[ends[i] : ends[i + 1]].tolist()), float(log[i]))
            heapq.heappush(self.queue, (-g, self.order, path, at + i, [*(taken if not i else []), gone]))


class _Index(dict):
    """Numbers for units in the order in which they are met."""

    def __missing__(self, unit):
        self[unit] = n = len(self)
        return n


@dataclass
class Drawn:
    """Samples of a batch, flat: the text of each, its ids, and its scores."""

    text: np.ndarray
    sample: np.ndarray
    ids: np.ndarray
    lens: np.ndarray
    log: np.ndarray
    value: np.ndarray
    inclusion: np.ndarray


class GumbelSampler:
    """Encodes, samples and decodes with a SentencePiece model file."""

    def __init__(self, path: str, alpha: float = ALPHA):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp, weight, byte, surface = sp, {}, {}, [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(piece[3:5], 16)] = i
                surface[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                weight[piece] = i
                surface[i] = piece.replace(MARK, " ").encode()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in weight):
            raise ValueError("the vocabulary has pieces that cross into a word mark")
        self.surface = surface
        self.spelling = pa.array(surface, pa.large_binary())
        self.spell_len = np.fromiter(map(len, surface), np.int64, len(surface))
        log_weight = np.zeros(sp.get_piece_size())
        for i in weight.values():
            log_weight[i] = -alpha * math.log(2 - sp.get_score(i))
        for i in byte.values():
            log_weight[i] = -alpha * math.log(2 + sp.get_piece_size())
        factor = int(_Tables.factor)
        begins: dict[int, int] = {}
        seen: dict[int, str] = {}
        for p, i in weight.items():
            h = 0
            for n, c in enumerate(p, 1):
                h = (h * factor + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                if seen.setdefault(h, p[:n]) != p[:n]:
                    raise ValueError("two beginnings of pieces share a hash")
                begins.setdefault(h, -1)
            begins[h] = i
        self.tables = _Tables(begins, log_weight, -alpha * math.log(2 + sp.get_piece_size()), byte)
        self.chars, self.memo = CHARS, MEMO
        self.forget()
        # Two characters that stand side by side in no piece are always cut apart.
        pairs = {(ord(x) << 21) | ord(y) for p in weight for x, y in zip(p, p[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        # The word mark and the characters under 510 have a table; the others, as 511, are searched.
        self.near = np.full(ord(MARK) + 2, 511, np.int32)
        self.near[:510], self.near[ord(MARK)] = np.arange(510), 510
        self.low = np.zeros((512, 512), bool)
        for x in pairs:
            a, b = (int(self.near[min(c, ord(MARK) + 1)]) for c in (x >> 21, x & 0x1FFFFF))
            if a < 511 and b < 511:
                self.low[a, b] = True
        self.low = self.low.ravel()

    def units(self, text: str) -> list[str]:
        """The units of the text as the model's lattice sees it, one word mark in front."""
        plain = self.sp.normalize(text)
        code = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        near = self.near[np.minimum(code, len(self.near) - 1)]
        joined = self.low[(near[:-1] << 9) + near[1:]]
        far = near == 511
        if far.any():
            wide = np.flatnonzero(far[:-1] | far[1:])
            key = (code[wide].astype(np.int64) << 21) | code[wide + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[wide] = self.pairs[at] == key
        cuts = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(plain)]
        return [plain[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids) -> str:
        """The text that the pieces spell, without the space put in front of it."""
        out = b"".join(self.surface[i] for i in ids)
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "surrogatepass")

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes that flat ids spell."""
        _, edges, data = self.spelling.take(pa.array(ids)).buffers()
        return data[: int(np.frombuffer(edges, np.int64)[len(ids)])].to_pybytes() if len(ids) else b""

    def round_trips(self, texts: list[str], drawn: Drawn) -> np.ndarray:
        """Whether each sample decodes to its text."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        want = [raw[i] and b" " + raw[i] for i in drawn.text.tolist()]
        got = self.spell(drawn.ids)
        if got == b"".join(want):
            size = np.add.reduceat(np.append(self.spell_len[drawn.ids], 0), np.cumsum(drawn.lens) - drawn.lens) * (drawn.lens > 0) if len(want) else np.zeros(0)
            if (size == np.fromiter(map(len, want), np.int64, len(want))).all():
                return np.ones(len(want), bool)
        edges = np.append(0, np.cumsum(drawn.lens))
        flat = drawn.ids.tolist()
        return np.array([self.decode(flat[a:b]) == texts[i] for i, a, b in zip(drawn.text.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)], bool)

    def sample(self, texts: list[str], keys: list[int], k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k distinct segmentations, best perturbed value first: (piece
        ids, log probability, perturbed log probability, inclusion score)."""
        out: list[list] = [[] for _ in texts]
        for first, last, d in self.batches(texts, keys, k):
            edges = np.append(0, np.cumsum(d.lens))
            for n, i in enumerate(d.text.tolist()):
                out[first + i].append((d.ids[edges[n] : edges[n + 1]], float(d.log[n]), float(d.value[n]), float(d.inclusion[n])))
        return out

    def batches(self, texts: list[str], keys: list[int], k: int = SAMPLES):
        """(first, last, samples) of stretches of texts."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > self.chars or i + 1 == len(texts):
                yield first, i + 1, self._sample(texts[first : i + 1], keys[first : i + 1], k)
                first, size = i + 1, 0

    def forget(self) -> None:
        """Drops the units met so far; the worker may serve other operators next."""
        self.index, self.lattices, self.uses = _Index(), Lattices.pool(self.tables), np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Keeps the units met most often, with half of the arcs that may be remembered; their
        counts are halved, so that units of past texts make way."""
        arcs = self.lattices.arcs_of()
        order = np.argsort(-self.uses[: len(arcs)], kind="stable")
        stay = np.sort(order[np.cumsum(arcs[order]) <= self.memo // 2])
        names = list(self.index)
        self.index = _Index(zip([names[i] for i in stay.tolist()], range(len(stay)), strict=True))
        self.lattices.keep(stay)
        self.uses = self.uses[stay] // 2

    def _sample(self, texts, keys, k) -> Drawn:
        if len(self.lattices.to) > self.memo:
            self.shrink()
        index, lattices, known = self.index, self.lattices, len(self.index)
        split = [np.array(list(map(index.__getitem__, self.units(t))) if t else [], np.int64) for t in texts]
        if len(index) > known:
            lattices.add(list(itertools.islice(index, known, None)))
            self.uses = np.append(self.uses, np.zeros(len(index) - known, np.int64))
        self.uses += np.bincount(np.concatenate(split), minlength=len(index))
        all_texts = [_Text(u, key) for u, key in zip(split, keys, strict=True)]
        while jobs := [(t, job) for t in all_texts if len(t.units) and (job := t.pop(k))]:
            self._open(jobs, k)
        rows = [(n, s, t, p) for n, t in enumerate(all_texts) for s, p in enumerate(t.out)]
        rows += [(n, 0, t, _Path(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1), 0.0)) for n, t in enumerate(all_texts) if not len(t.units)]
        rows.sort(key=lambda r: r[:2])
        log = np.array([p.log[-1] for *_, p in rows])
        kappa = np.array([t.kappa for _, _, t, _ in rows])
        sure = np.isneginf(kappa)
        inclusion = np.where(sure, 1.0, -np.expm1(-np.exp(np.minimum(700.0, log - np.where(sure, 0.0, kappa)))))
        ids = np.concatenate([p.ids for *_, p in rows]) if rows else np.zeros(0, np.int32)
        return Drawn(
            np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32), ids, np.fromiter((len(p.ids) for *_, p in rows), np.int64, len(rows)),
            log, np.array([p.value for *_, p in rows]), inclusion,
        )

    def _open(self, jobs, k: int) -> None:
        """Draws the best member of each popped set, and adds the sets that the draws leave."""
        lattices = self.lattices
        cuts = [job[2] + bool(job[3]) for _, job in jobs]
        sizes = np.array([len(t.units) - c for (t, _), c in zip(jobs, cuts, strict=True)])
        units = np.concatenate([t.units[c:] for (t, _), c in zip(jobs, cuts, strict=True)])
        starts = np.array([_start(t.key, t.stream) for t, _ in jobs], _U64)
        place = _ramp(sizes) + np.repeat(np.array(cuts), sizes)
        ids, lens, log, rest = lattices.draw(units, np.repeat(starts, sizes), place)
        # A popped set begins with another path of its unit; put those in front.
        front = np.array([bool(job[3]) for _, job in jobs])
        if front.any():
            others = self._others(jobs, starts)
            head, edge = np.cumsum(sizes) - sizes, np.append(0, np.cumsum(lens))
            where = head[front]
            size_of = np.array([len(o[0]) if f else 0 for o, f in zip(others, front, strict=True)])
            ids = np.insert(ids, np.repeat(edge[head], size_of), np.array([x for o in others for x in o[0]], ids.dtype))
            lens = np.insert(lens, where, size_of[front])
            log = np.insert(log, where, [o[1] for o, f in zip(others, front, strict=True) if f])
            rest = np.insert(rest, where, [o[2] for o, f in zip(others, front, strict=True) if f])
            sizes = sizes + front
        head = np.cumsum(sizes) - sizes
        phi = np.array([float(job[1].log[job[2]]) if job[1] else 0.0 for _, job in jobs])
        total = np.append(0.0, np.cumsum(log))
        before = total[:-1] - np.repeat(total[head] - phi, sizes)
        opened = np.flatnonzero(rest > 0)
        owner = np.repeat(np.arange(len(jobs)), sizes)[opened]
        local = opened - head[owner]
        spot = before[opened] + np.log(rest[opened])
        noise = np.log(_at((starts ^ _U64(1 << 62))[owner], local))
        values = np.array([job[0] for _, job in jobs])[owner]
        bound = spot - np.log(np.exp(np.minimum(spot - values, 700.0)) - noise)
        edge = np.searchsorted(owner, np.arange(len(jobs) + 1)).tolist()
        ends = np.append(0, np.cumsum(lens))
        for i, ((t, job), a, n) in enumerate(zip(jobs, head.tolist(), sizes.tolist(), strict=True)):
            own = ends[a : a + n + 1]
            b = np.append(before[a : a + n], total[a + n] - total[a] + phi[i])
            x, y = edge[i], edge[i + 1]
            t.put(job, ids[own[0] : own[-1]], own - own[0], b, log[a : a + n], local[x:y], bound[x:y], k)

    def _others(self, jobs, starts) -> list[tuple[tuple[int, ...], float, float]]:
        """For each job another path of its unit, its log probability, and the mass that is left
        beside it and the taken ones. Where only the likeliest path is taken, one draw under
        that condition; else a few free draws, then those still unlucky draw from what is left."""
        lattices, out = self.lattices, [((), 0.0, 0.0)] * len(jobs)
        todo, leave = [], []
        unit_of = {}
        for i, (t, job) in enumerate(jobs):
            if job[3]:
                unit_of[i] = u = int(t.units[job[2]])
                (leave if len(job[3]) == 1 and job[3][0][0] == lattices.likeliest(u) else todo).append(i)

        def done(i, ids, log):
            taken = [x[0] for x in jobs[i][1][3]] + [ids]
            rest = 1.0 - math.exp(log) - sum(math.exp(x[1]) for x in jobs[i][1][3])
            out[i] = ids, log, rest if rest > 1e-6 else lattices.mass_beside(unit_of[i], taken)

        if leave:
            flat, lens, log = lattices.unlikely(np.array([unit_of[i] for i in leave]), starts[leave] ^ _U64(1 << 60), np.zeros(len(leave), np.int64))
            flat, ends = flat.tolist(), np.append(0, np.cumsum(lens)).tolist()
            for n, i in enumerate(leave):
                done(i, tuple(flat[ends[n] : ends[n + 1]]), float(log[n]))
        for attempt in range(REDRAWS):
            if not todo:
                break
            units = np.array([unit_of[i] for i in todo])
            flat, lens, log, _ = lattices.draw(units, starts[todo] ^ _U64(1 << 61), np.full(len(todo), attempt))
            flat, ends, left = flat.tolist(), np.append(0, np.cumsum(lens)).tolist(), []
            for n, i in enumerate(todo):
                ids = tuple(flat[ends[n] : ends[n + 1]])
                if any(ids == t[0] for t in jobs[i][1][3]):
                    left.append(i)
                else:
                    done(i, ids, float(log[n]))
            todo = left
        for i in todo:
            done(i, *lattices.beside(unit_of[i], [x[0] for x in jobs[i][1][3]], _numbers(starts[i])))
        return out


@functools.cache
def sampler_of(path: str, alpha: float) -> GumbelSampler:
    return GumbelSampler(path, alpha)


def sample_segmentations(
    df: DataFrame,
    model: str,
    k: int = SAMPLES,
    seed: int = 0,
    alpha: float = ALPHA,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars: int = CHARS,
    memo: int = MEMO,
) -> DataFrame:
    """One row per text and sample: id, sample (from 0), n_pieces, log_prob, perturbed,
    inclusion, ids_crc32 (of the ids as little-endian int32), round_trip (the ids decode to
    the text), and the piece ids themselves. The row key is the id; rows without one are keyed
    by their text. An empty table gives no rows; other columns are not read. ``chars`` and ``memo``
    trade a worker's memory for time; the samples are the same."""
    key = F.when(col(id_col).isNull(), F.xxhash64(F.lit(seed), col(text_col))).otherwise(F.xxhash64(F.lit(seed), col(id_col)))
    src = df.filter(col(text_col).isNotNull()).select(col(id_col).alias("i"), col(text_col).alias("t"), key.alias("k"))
    fields = [
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField("sample", T.IntegerType()),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("log_prob", T.DoubleType()),
        T.StructField("perturbed", T.DoubleType()),
        T.StructField("inclusion", T.DoubleType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("round_trip", T.BooleanType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
    id_type, names = to_arrow_type(fields[0].dataType), [f.name for f in fields]

    def run(batches):
        s = sampler_of(model, alpha)
        s.chars, s.memo = chars, memo
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                keys = [r & 0xFFFFFFFFFFFFFFFF for r in part.column(2).to_pylist()]
                for first, last, d in s.batches(texts, keys, k):
                    edges = np.append(0, np.cumsum(d.lens)).astype(np.int32)
                    raw = memoryview(d.ids.astype("<i4", copy=False)).cast("B")
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    same = s.round_trips(texts[first:last], d)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(first + d.text)).cast(id_type), pa.array(d.sample), pa.array(d.lens), pa.array(d.log), pa.array(d.value),
                            pa.array(d.inclusion), pa.array(crc, pa.int64()), pa.array(same), pa.ListArray.from_arrays(pa.array(edges), pa.array(d.ids)),
                        ],
                        names=names,
                    )
                    del d, raw
                give_back()
        s.forget()
        give_back()

    return src.mapInArrow(run, T.StructType(fields))


def decode_pieces(df: DataFrame, model: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with the text that each row's ids spell; null for null."""

    def factory():
        s = sampler_of(model, ALPHA)
        return lambda rows: ([None if r is None else s.decode(r) for r in rows],)

    return map_rows(df, [ids_col], keep, [T.StructField("text", T.StringType())], factory)
