"""SentencePiece encoding: samples of distinct segmentations by Gumbel top-k, and decoding.

Every way to write a text in pieces is a path through a lattice; a path's probability is
the normalised product of its pieces' weights to the power alpha. The k paths with the highest
Gumbel-perturbed log-probability are k samples without replacement. They are found by A* over
the lattice with an exact bound: a node's perturbed value is the maximum over all
paths below it, the child that holds the maximum is drawn first, and all its siblings together
go on the agenda with a truncated Gumbel. So the best entry of the agenda is always the next
sample, and only its own path is opened.

No piece holds a blank behind another character, so a lattice is a chain of those of the words; each
distinct word is laid out once. Steps of many words are taken together in numpy.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNIT = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
#: No Gumbel of uniform() is larger.
MOST_GUMBEL = 37.5
#: Steps of a path that are looked at together with those of other paths.
AHEAD = 192
_MUL, _SHIFT, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(42), np.uint64(44)


_DRAW = np.uint64(0xD1B54A32D192ED03)
_ALL = (1 << 64) - 1


def _times(n: int, factor: np.uint64) -> np.ndarray:
    """n * factor modulo 2**64, as an array of one."""
    return np.array([n], np.uint64) * factor


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys alone."""
    return ((_mixed(key) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _mixed_int(x: int) -> int:
    """As _mixed() of one number, of any size."""
    x &= _ALL
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _ALL
    return x ^ (x >> 31)


def _uniform(key: int) -> float:
    """As uniform() of one key."""
    return ((_mixed_int(key) >> 11) + 0.5) / (1 << 53)


def branch_values(mass: np.ndarray, value: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Gumbels of what branches off, of log-probability mass, cut off at value: value - log(1 + excess)."""
    fresh, behind = -np.log(numbers), value - mass
    far = np.flatnonzero(behind > 700)
    out = value - np.log1p(fresh * np.exp(np.minimum(behind, 700)))
    out[far] = mass[far] - np.log(fresh[far])
    return out


class Vocabulary:
    """Pieces of a model file with unigram weights: a piece of rank r weighs (r + 3) ** -1, a byte as little as the last."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.model.is_byte(i)}
        self.value = {i: b for b, i in self.bytes.items()}
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[list(self.value)] = True
        self.dummy = self.model.normalize("a").startswith(BLANK)
        for b in range(128):  # bytes below 128 are whole characters
            if b in self.bytes and chr(b) != BLANK:
                self.pieces[self.bytes[b]] = chr(b)
                self.is_byte[self.bytes[b]] = False
        own = [i for i in range(len(self.pieces)) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        if any(BLANK in self.pieces[i].lstrip(BLANK) for i in own):
            raise ValueError("a piece holds a blank behind another character")
        self.unknown = self.model.unk_id()
        self.log_weight = np.full(len(self.pieces) + 1, -1.5 * alpha * np.log(len(self.pieces) + 3.0))
        self.log_weight[own] = -alpha * np.log(np.arange(len(own)) + 3.0)
        keys: dict[int, int] = {}
        prefixes = set()
        for i in own:
            h = 0
            for c in self.pieces[i]:
                h = (h + ord(c) + 1) * int(_MUL) % (1 << 64)
                prefixes.add(h)
            keys[h] = i
        self.keys = np.array(sorted(keys), np.uint64)
        self.ids = np.array([keys[int(k)] for k in self.keys], np.int32)
        size = np.array([len(p) for p in self.pieces], np.int64)
        self.size, self.at = size, np.cumsum(size) - size
        self.spelling = np.frombuffer("".join(self.pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        # the place of each key by its first bits; -1 where several keys share them and have to be searched for
        first = (_mixed(self.keys) >> _PLACE).astype(np.int64)
        self.place = np.zeros(1 << 20, np.int32)
        self.place[first] = np.where(np.bincount(first, minlength=1 << 20)[first] > 1, -1, np.arange(len(first)))
        self.starts = np.zeros(1 << 22, bool)
        self.starts[_mixed(np.array(sorted(prefixes), np.uint64)) >> _SHIFT] = True
        self.longest = max(len(self.pieces[i]) for i in own)

    def places(self, keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Where each key is, if it is one of the vocabulary's, else anywhere; mixed: _mixed(keys)."""
        at = self.place[(mixed >> _PLACE).astype(np.int64)]
        shared = np.flatnonzero(at < 0)
        at[shared] = np.minimum(np.searchsorted(self.keys, keys[shared]), len(self.keys) - 1)
        return at

    def fallback(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in char.encode("utf-8", "replace")]

    def normalized(self, ids: np.ndarray) -> str:
        """The normalised text that the pieces spell; bytes are taken together as UTF-8."""
        if ids.size and self.is_byte[ids].any():
            parts = [bytes([self.value[i]]) if i in self.value else self.pieces[i].encode() for i in ids.tolist()]
            return b"".join(parts).decode("utf-8", "replace")
        return "".join(map(self.pieces.__getitem__, ids.tolist()))

    def spells(self, ids: np.ndarray, text: str) -> bool:
        """Whether the pieces spell the normalised text."""
        if ids.size and self.is_byte[ids].any():
            return self.normalized(ids) == text
        size = self.size[ids]
        n = int(size.sum())
        if n != len(text):
            return False
        codes = self.spelling[np.arange(n) + np.repeat(self.at[ids] - (np.cumsum(size) - size), size)]
        return codes.tobytes() == text.encode("utf-32-le", "surrogatepass")

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation: blanks for blank marks, without the one that stands before every text."""
        text = self.normalized(np.asarray(ids, np.int64)).replace(BLANK, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


def _put(into: np.ndarray, at: int, rows: np.ndarray) -> np.ndarray:
    """into with rows from place at on; its length doubles where it is too short."""
    if at + len(rows) > len(into):
        into = np.concatenate([into[:at], np.zeros(2 * (at + len(rows)) - at, into.dtype)])
    into[at : at + len(rows)] = rows
    return into


class Lattice:
    """The lattices of all words seen, as arrays: nodes with their edges, edges with what follows from them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.first = np.zeros(0, np.int32)  # the first node of each word
        self.begin, self.target, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.upto = np.zeros(0)  # the share of its node that an edge and those before it have
        self.log_q, self.log_off = np.zeros(0), np.zeros(0, np.float32)  # logs of an edge's share, and of what the node's other edges have
        self.clear()

    def clear(self) -> None:
        """Forget all words; the arrays keep their room."""
        self.words = defaultdict(count().__next__)  # numbered in the order in which they are first asked for
        self.laid = self.nodes = self.edges = 0
        self.spelled: list[list[int]] = []  # ids of characters without a piece; such an edge's piece is -1 - place

    def add(self, words: list[str]) -> None:
        """Lay out the words that have been numbered last. A node without edges ends a word; of its edges the longest come first."""
        v, base, edges0 = self.v, self.nodes, self.edges
        size = np.array([len(w) for w in words], np.int64)
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        word = np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size)[word]  # place in text where the word of a place ends
        active, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        sources, lengths, pieces = [], [], []
        for n in range(1, v.longest + 1):
            ok = active + n <= ends[active]
            active, h = active[ok], h[ok]
            if not len(active):
                break
            h = (h + code[active + n - 1]) * _MUL
            mixed = _mixed(h)
            ok = v.starts[(mixed >> _SHIFT).astype(np.int64)]
            active, h = active[ok], h[ok]
            at = v.places(h, mixed[ok])
            hit = v.keys[at] == h
            sources.append(active[hit]), pieces.append(v.ids[at[hit]]), lengths.append(np.full(hit.sum(), n))
        single = np.zeros(len(code), bool)
        if sources:
            single[sources[0]] = True
        sources, lengths, pieces = sources[::-1], lengths[::-1], pieces[::-1]
        bare = np.flatnonzero(~single)
        spelled = []
        for i in bare:
            ids = v.fallback(text[i])
            if len(ids) == 1:
                spelled.append(ids[0])
            else:
                self.spelled.append(ids)
                spelled.append(-len(self.spelled))
        source, length = np.concatenate([*sources, bare]).astype(np.int64), np.concatenate([*lengths, np.ones(len(bare))]).astype(np.int64)
        piece = np.concatenate([*pieces, np.array(spelled, np.int32)]).astype(np.int32)
        weight = v.log_weight[np.where(piece < 0, len(v.pieces), piece)]
        weight = np.where(piece < 0, weight * 3, weight)
        left = (ends - np.arange(len(code)))[source]
        order = np.argsort(left * len(code) + source, kind="stable")
        source, length, piece, weight, left = source[order], length[order], piece[order], weight[order], left[order]
        node = np.arange(len(code)) + word  # words have a node more than characters
        start = np.flatnonzero(np.append(True, source[1:] != source[:-1]) | np.append(True, left[1:] != left[:-1]))
        count = np.diff(np.append(start, len(source)))
        total = np.zeros(len(code) + len(words))
        follow = node[source] + length
        q, groups = np.empty(len(source)), np.flatnonzero(np.append(True, np.diff(left[start]) != 0))
        bounds = np.append(groups, len(start))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # nodes that are equally far from their word's end
            lo, hi = start[a], start[b] if b < len(start) else len(source)
            value = weight[lo:hi] + total[follow[lo:hi]]
            cut = start[a:b] - lo
            top = np.maximum.reduceat(value, cut)
            e = np.exp(value - np.repeat(top, count[a:b]))
            s = np.add.reduceat(e, cut)
            total[node[source[start[a:b]]]] = top + np.log(s)
            q[lo:hi] = e / np.repeat(s, count[a:b])
        run = np.cumsum(q)
        upto = run - np.repeat(run[start] - q[start], count)
        upto[np.append(start[1:], len(source)) - 1] = 2.0  # the last edge takes what rounding leaves
        begin = np.full(len(total), -1, np.int64)
        begin[node[source[start]]] = start + edges0
        self.first = _put(self.first, self.laid, base + np.cumsum(size + 1) - size - 1)
        self.begin = _put(self.begin, base, begin)
        with np.errstate(divide="ignore"):
            log_off = np.where(q < 1 - 1e-12, np.log1p(-np.minimum(q, 1.0)), -np.inf)
            made = {"target": follow + base, "piece": piece, "upto": upto, "log_q": np.log(q), "log_off": log_off}
        for name, rows in made.items():
            setattr(self, name, _put(getattr(self, name), edges0, rows))
        self.nodes, self.edges, self.laid = base + len(total), edges0 + len(source), self.laid + len(words)

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges of all walks one after another, edges of each): ancestral samples from each node to its word's end."""
        who, took, steps = np.arange(len(node)), [], 0
        owners = []
        while True:
            edge = self.begin[node]
            going = edge >= 0
            if not going.all():
                who, edge = who[going], edge[going]
            if not len(who):
                break
            u = uniform(key[who] + _times(steps, _MUL))
            more = np.flatnonzero(u > self.upto[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] > self.upto[edge[more]]]
            took.append(edge), owners.append(who)
            node, steps = self.target[edge], steps + 1
        count = np.bincount(np.concatenate(owners), minlength=len(key)) if owners else np.zeros(len(key), np.int64)
        out, at = np.empty(count.sum(), np.int64), np.cumsum(count) - count
        for k, (edge, own) in enumerate(zip(took, owners, strict=True)):
            out[at[own] + k] = edge
        return out, count


class Sampler:
    """k distinct segmentations of each text, best perturbed value first."""

    def __init__(self, path: str, k: int, alpha: float, most_words: int = 150_000) -> None:
        self.v, self.k, self.most_words = Vocabulary(path, alpha), k, most_words
        self.lattice = Lattice(self.v)

    def units(self, normalized: str) -> list[str]:
        """The words of a normalised text: cut before each run of blanks and around line ends."""
        if BLANK * 2 in normalized or "\0" in normalized:
            return UNIT.findall(normalized)
        # the same cuts without a pattern, which takes four times as long
        return list(filter(None, normalized.replace(BLANK, "\0" + BLANK).replace("\n", "\0\n\0").split("\0")))

    def sample(self, normalized: list[str], seeds: np.ndarray) -> list[list[tuple]]:
        """Per normalised text up to k of (ids, log-probability, perturbed log-probability, log inclusion probability)."""
        x = self.lattice
        if len(x.words) > self.most_words:
            x.clear()
        docs = [self.units(t) for t in normalized]
        n_units = np.array([len(d) for d in docs])
        words = np.fromiter(map(x.words.__getitem__, chain.from_iterable(docs)), np.int64, n_units.sum())
        if len(x.words) > x.laid:
            x.add(list(islice(x.words, x.laid, None)))
        node = x.first[words]
        offset = np.cumsum(n_units) - n_units
        place = np.arange(len(node)) - np.repeat(offset, n_units)
        seeds = _mixed(seeds.astype(np.uint64))
        key = _mixed(np.repeat(seeds, n_units) + place.astype(np.uint64) * _MUL)
        edges, count = x.walk(node, key)
        root = -np.log(-np.log(uniform(seeds ^ np.uint64(0x5BF03635))))
        per_doc = np.add.reduceat(np.append(count, 0), np.minimum(offset, len(count))) if len(count) else np.zeros(len(docs), np.int64)
        per_doc[n_units == 0] = 0
        cuts = np.cumsum(per_doc) - per_doc
        unit_of = np.repeat(place, count)
        state = [_Agenda(self, seed) for seed in seeds]
        self.open([(s, edges[c : c + n], unit_of[c : c + n], 0, 0.0, v) for s, c, n, v in zip(state, cuts, per_doc, root, strict=True)])
        for _ in range(1, self.k):
            opened = [(i, s.pop()) for i, s in enumerate(state)]
            opened = [(i, p) for i, p in opened if p is not None]
            if not opened:
                break
            # the rest of the word in which the path turns off, then the words behind it
            tails = [node[offset[i] + p.unit + 1 : offset[i] + n_units[i]] for i, p in opened]
            heads = np.array([x.target[p.edge] for _, p in opened], np.int64)
            sizes = np.array([len(t) + 1 for t in tails])
            starts = np.cumsum(sizes) - sizes
            nodes = np.empty(sizes.sum(), np.int64)
            nodes[starts] = heads
            behind = np.ones(len(nodes), bool)
            behind[starts] = False
            nodes[behind] = np.concatenate(tails) if tails else []
            which = np.arange(len(nodes)) - np.repeat(starts, sizes) + np.repeat([p.unit for _, p in opened], sizes)
            salt = np.repeat([p.salt for _, p in opened], sizes).astype(np.uint64)
            edges, count = x.walk(nodes, _mixed(salt + which.astype(np.uint64) * _MUL))
            total = np.add.reduceat(count, starts)
            cuts, unit_of = np.cumsum(total) - total, np.repeat(which, count)
            self.open([state[i].turned(p, edges[c : c + n], unit_of[c : c + n]) for (i, p), c, n in zip(opened, cuts, total, strict=True)])
        return [s.samples() for s in state]

    def open(self, items: list[tuple]) -> None:
        """Add (agenda, edges, units, known, before, value): paths whose steps up to `known`, of log-probability `before`, belong to others.

        All paths' steps are taken together, up to AHEAD of each; the rare path of which a later step may count goes on by itself.
        """
        x = self.lattice
        own = [edges[known:] for _, edges, _, known, _, _ in items]
        size = np.array([len(e) for e in own])
        log_q = x.log_q[np.concatenate(own)] if size.sum() else np.zeros(0)
        ends = np.cumsum(size)
        some = np.minimum(size, AHEAD)
        at = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        place = at + np.repeat(ends - size, some)
        run = np.append(0.0, np.cumsum(log_q))
        before, value = np.array([i[4] for i in items]), np.array([i[5] for i in items])
        ahead = run[place] + np.repeat(before - run[ends - size], some)
        for i in items:
            i[0].draws += 1
        starts = np.array([i[0].draws for i in items], np.uint64) * _DRAW + np.array([i[0].seed for i in items], np.uint64)
        edge = np.concatenate([e[:AHEAD] for e in own]) if size.sum() else np.zeros(0, np.int64)
        numbers = uniform(np.repeat(starts, some) + at.astype(np.uint64) * _MUL)
        rest = branch_values(ahead + x.log_off[edge], np.repeat(value, some), numbers)
        total = before + run[ends] - run[ends - size]
        cuts = np.cumsum(some) - some
        for k, (agenda, edges, units, known, _, v) in enumerate(items):
            mine = rest[cuts[k] : cuts[k] + some[k]]
            if size[k] > AHEAD:
                left = before[k] + run[ends[k] - size[k] + AHEAD] - run[ends[k] - size[k]]
                # what lies behind has at most that, so it can't be among the k best
                if self.k > AHEAD or left + MOST_GUMBEL >= np.partition(mine, -self.k)[-self.k]:
                    later = np.arange(AHEAD, size[k], dtype=np.uint64)
                    more = log_q[ends[k] - size[k] + AHEAD : ends[k]]
                    mass = left + np.cumsum(more) - more + x.log_off[own[k][AHEAD:]]
                    mine = np.append(mine, branch_values(mass, np.full(len(more), v), uniform(starts[k : k + 1] + later * _MUL)))
            agenda.add(edges, units, known, float(total[k]), v, mine)

    def ids(self, edges: np.ndarray) -> np.ndarray:
        pieces = self.lattice.piece[edges]
        if (pieces >= 0).all():
            return pieces
        return np.array([i for p in pieces for i in ([p] if p >= 0 else self.lattice.spelled[-1 - p])], np.int32)


class _Turn:
    """A way off a known path: behind `step` of path `path`, by another edge."""

    __slots__ = ("path", "step", "edge", "unit", "salt", "value", "before")

    def __init__(self, **kw: object) -> None:
        for k, v in kw.items():
            setattr(self, k, v)


class _Agenda:
    """The samples of one text so far, and the perturbed values of all that branches off from them."""

    def __init__(self, sampler: Sampler, seed: np.uint64) -> None:
        self.s, self.seed, self.draws = sampler, seed, 0
        self.paths: list[tuple[np.ndarray, np.ndarray, float, float]] = []  # edges, units, log-probability, value
        self.rests: list[np.ndarray] = []  # perturbed values of the branches off each step
        self.used: dict[tuple[int, int], list[int]] = {}  # edges taken at steps that have been turned off

    def add(self, edges: np.ndarray, units: np.ndarray, known: int, log_prob: float, value: float, rest: np.ndarray) -> None:
        """A path, and the perturbed values of the branches off its steps from `known` on."""
        self.paths.append((edges, units, log_prob, value))
        self.rests.append(np.concatenate([np.full(known, -np.inf), rest]) if known else rest)

    def best(self) -> tuple[float, int, int]:
        found = [(r[a], p, a) for p, r in enumerate(self.rests) if len(r) for a in (int(r.argmax()),)]
        return max(found, default=(-np.inf, 0, 0))

    def pop(self) -> _Turn | None:
        """Take the best entry off the agenda and draw the edge by which it leaves."""
        value, path, step = self.best()
        if value == -np.inf:
            return None
        x, edges = self.s.lattice, self.paths[path][0]
        used = self.used.setdefault((path, step), [int(edges[step])])
        first = int(edges[step])
        while first and x.upto[first - 1] < 2.0:  # 2 marks a node's last edge
            first -= 1
        last = int(edges[step])
        while x.upto[last] < 2.0:
            last += 1
        others = [e for e in range(first, last + 1) if e not in used]
        share = np.cumsum(np.exp(x.log_q[others]))
        self.draws += 1
        key = self.draws * int(_DRAW) + int(self.seed)
        chance, again = _uniform(key), _uniform(key + int(_MUL))
        edge = others[min(int(np.searchsorted(share, chance * share[-1])), len(others) - 1)]
        used.append(edge)
        before = float(x.log_q[edges[:step]].sum())
        left = share[-1] - np.exp(x.log_q[edge])
        rest = -np.inf
        if len(others) > 1 and left > 1e-300:
            mass = before + np.log(left)
            rest = min(value, mass - np.log(np.exp(min(mass - value, 700)) - np.log(again)))
        self.rests[path][step] = rest
        self.draws += 1
        salt = np.uint64(_mixed_int(int(self.seed) + self.draws))
        return _Turn(path=path, step=step, edge=edge, unit=int(self.paths[path][1][step]), salt=salt, value=value, before=before)

    def turned(self, turn: _Turn, edges: np.ndarray, units: np.ndarray) -> tuple:
        """The path that leaves by the turn and goes on by edges, for Sampler.open()."""
        own, at = self.paths[turn.path][0], self.paths[turn.path][1]
        whole = np.concatenate([own[: turn.step], [turn.edge], edges])
        places = np.concatenate([at[: turn.step], [turn.unit], units])
        return self, whole, places, turn.step + 1, turn.before + float(self.s.lattice.log_q[turn.edge]), turn.value

    def samples(self) -> list[tuple]:
        limit = self.best()[0]
        out = []
        for edges, _, logp, value in self.paths:
            above = min(logp - limit, 700)  # log(1 - exp(-exp(x))) is x itself for small x
            included = 0.0 if limit == -np.inf else above if above < -30 else float(np.log(-np.expm1(-np.exp(above))))
            out.append((self.s.ids(edges), float(logp), float(value), included))
        return out


@lru_cache(maxsize=1)
def sampler(path: str, k: int, alpha: float) -> Sampler:
    return Sampler(path, k, alpha)


def sample_segmentations(docs: DataFrame, model: str, k: int = 3, alpha: float = 0.5, seed: int = 0, with_ids: bool = True, verify: bool = False) -> DataFrame:
    """Up to k rows per document: doc_id, rank, n_ids, ids_crc32, log_prob, perturbed, log_inclusion, (ids,) (decodes).

    The samples of a text are distinct, depend on its doc_id, its text and the seed alone, and
    come in falling perturbed log-probability; log_inclusion is the log of the chance to be among
    the k at the threshold that this draw gave. A text with fewer segmentations gives
    all of them; a null or empty one gives its only one, of no pieces. Equal rows give
    equal samples. decodes (with verify) tells whether the ids give the text back. model: a
    model file that every executor can read.
    """
    source = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)).alias("_seed"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, rank int, n_ids int, ids_crc32 long, log_prob double, perturbed double, log_inclusion double"
    schema += ", ids array<int>" * with_ids + ", decodes boolean" * verify

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model, k, alpha)
        names = [x.split()[0] for x in schema.split(", ")]
        for big in batches:
            cuts, held = [0], 0
            for i, n in enumerate(pc.fill_null(pc.utf8_length(big.column("text")), 0).to_pylist()):
                if i > cuts[-1] and (held + n > 900_000 or i - cuts[-1] >= 600):
                    cuts.append(i)
                    held = 0
                held += n
            for a, b in zip(cuts, [*cuts[1:], big.num_rows], strict=True):
                batch = big.slice(a, b - a)
                texts = [own.v.model.normalize(t or "") for t in batch.column("text").to_pylist()]
                found = own.sample(texts, batch.column("_seed").to_numpy().view(np.uint64)) if texts else []
                at = [i for i, rows in enumerate(found) for _ in rows]
                rows = [(r, *row) for rows in found for r, row in enumerate(rows)]
                columns = [
                    batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], pa.int32()), pa.array([len(r[1]) for r in rows], pa.int32()),
                    pa.array([zlib.crc32(r[1].astype("<u4").tobytes()) for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], pa.float64()) for c in (2, 3, 4)),
                ]
                if with_ids:
                    columns.append(pa.array([r[1] for r in rows], pa.list_(pa.int32())))
                if verify:
                    columns.append(pa.array([own.v.spells(r[1], texts[i]) for i, r in zip(at, rows, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(encode, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with a text column from its ids, in place of any that it has; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sampler(model, 1, 1.0).v
        for batch in batches:
            texts = [None if ids is None else v.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return encoded.drop("text").mapInArrow(run, encoded.drop("text").schema.add("text", "string"))
