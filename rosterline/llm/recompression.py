"""Repeated passages by recompression: words are named, runs and pairs of names get names, equal passages share them.

A round of recompression replaces every run of one symbol, then every pair of a left and a right
symbol (by a coin that hangs on the symbol and the round), by a new symbol. Names are 128-bit hashes of
what they stand for, so all tasks give one name to one thing without meeting, and equal
names stand for equal words. What a round does to a symbol depends on its neighbours only: away
from its ends a passage is named alike wherever it occurs.

1. Naming: the symbols that a round makes inside a window of words, whatever lies around
   it, name the window: its anchor is the least three in a row of them (of its words, where
   runs leave fewer). Windows share anchors with their neighbours: about one row for five words.
2. Anchors that two documents share reveal where repeats may be; only these stretches go on. In them
   every window gets a second anchor (the greatest three in a row), which two stretches must share too.
3. Climbing: stretches are recompressed to the top. A long symbol that also occurs in an earlier
   document proves a repeat as a whole, whatever its length.
4. The other windows, over the edges of such symbols, are verified one by one, by 128-bit hashes of their words.

Shared anchors are broadcast as a Bloom filter of a bounded size (it may let others pass, which step 4 finds out), beyond
its capacity they are joined.

Documents with equal texts are one: all but the smallest doc_id are repeats from end to end.
All counts are partial aggregates (least and greatest doc_id); joins are between plain exchanges, which
adaptive execution splits when a passage is in a great part of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import forget, materialize

#: Symbols in a row that make an anchor.
IN_A_ROW = 3
#: Bytes that are worked on at once (arrays that stay in a core's cache); longer texts are cut, with an overlap of one window.
SLICE = 1 << 18
#: Up to so many ids are broadcast (16 bytes each); beyond that they are joined, with the same rows.
BROADCAST_IDS = 2_000_000
#: Bits of a filter at most (64 MB), bits for each key at best and at least; a block is built in one task.
FILTER_BITS, BEST_BITS, LEAST_BITS, _BLOCK = 1 << 29, 12, 5, 18
U = np.uint64
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BASES = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)  # any odd numbers


@lru_cache(maxsize=4)
def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of the lane's base and of its inverse modulo 2**64."""
    base = _BASES[lane]
    values = np.random.default_rng(lane).integers(0, 2**64, 256, dtype=np.uint64)
    return values, *(np.cumprod(np.r_[U(1), np.full(n - 1, b, np.uint64)]) for b in (base, pow(base, -1, 2**64)))


def named(data: bytes, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, begin, end) of the words of data: polynomials over random numbers for their bytes, in one lane of 64 bits or two."""
    at = np.frombuffer(data, np.uint8)
    edge = np.diff(np.r_[True, _BLANK[at], True].astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    names = np.empty((len(begin), lanes), np.uint64)
    size = 1 << max(20, (len(data) - 1).bit_length())
    with np.errstate(over="ignore"):
        for lane in range(lanes):
            values, power, inverse = _powers(lane, size)
            sums = np.r_[U(0), np.cumsum(values[at] * power[: len(at)])]
            names[:, lane] = mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return names, begin, end


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that looks random (multiply and shift)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def joined(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """Names of two things each, in every lane."""
    with np.errstate(over="ignore"):
        lanes = np.array([kind * 2 + 1, kind * 2 + 2], np.uint64)[: a.shape[1]] * U(0x9E3779B97F4A7C15)
        return mixed(mixed(a + lanes) * U(3) + b)


def sliced(data: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """(number of the first word, part) of parts of a text; parts overlap by window - 1 words, so each window lies in one of them as a whole.

    In texts over SLICE a word of that length is named by its digest.
    """
    if len(data) <= SLICE:
        yield 0, data
        return
    first, carried, rest, at = 0, [], b"", 0
    while at < len(data):
        part = rest + data[at : at + SLICE]
        at += SLICE
        cut = len(part)
        while at < len(data) and cut and not _BLANK[part[cut - 1]]:
            cut -= 1
        if not cut and len(part) <= len(data):  # within a word
            rest = part
            continue
        rest = part[cut:]
        words = carried + [w if len(w) < SLICE else b"\0" + xxhash.xxh3_128_hexdigest(w).encode() for w in part[:cut].split()]
        yield first, b" ".join(words)
        carried = words[max(0, len(words) - window + 1) :]
        first += len(words) - len(carried)
    if rest:
        yield first, b" ".join(carried + [rest if len(rest) < SLICE else b"\0" + xxhash.xxh3_128_hexdigest(rest).encode()])


class Round:
    """One round over symbols with names of one lane or two: runs, then pairs.

    names: of the new symbols; first: the old symbol each begins with; inside(lo, hi): the new
    symbols that are certain to stand where old symbols lo to hi - 1 are seen and nothing else is.
    """

    def __init__(self, names: np.ndarray, level: int) -> None:
        new = np.r_[True, (names[1:] != names[:-1]).any(axis=1)]
        self.run, start = np.cumsum(new) - 1, np.flatnonzero(new)
        count = np.diff(np.r_[start, len(names)])
        base = names[start]
        whole = base.copy()
        many = np.flatnonzero(count > 1)
        if len(many):
            whole[many] = joined(base[many], count[many, None].astype(np.uint64), 2 * level)
        with np.errstate(over="ignore"):
            right = (mixed(base[:, 0] + U(2 * level + 1)) & U(1)).astype(bool)
        self.opens = np.r_[~right[:-1] & right[1:], False] if len(base) else right
        self.closes = np.r_[False, self.opens[:-1]] if len(base) else right
        head = np.flatnonzero(~self.closes)
        self.symbol, self.names, self.first = np.cumsum(~self.closes) - 1, whole[head], start[head]
        pairs = np.flatnonzero(self.opens[head])
        self.names[pairs] = joined(whole[head[pairs]], whole[head[pairs] + 1], 2 * level + 1)

    def inside(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.run[lo] + 1, self.run[hi - 1]  # the runs at either end may go on outside
        some = a < b
        a, b = np.where(some, a, 0), np.where(some, b, 1) - 1
        lo = self.symbol[a] + self.closes[a]
        hi = self.symbol[b] + ~self.opens[b]
        return lo, np.where(some, np.maximum(lo, hi), lo)


def _least(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of values rows[lo:hi] (hi > lo) the place of the least, the first of equals: places for spans of 1, 2, 4, ..., two of which make up any span."""
    longest = int((hi - lo).max(initial=1))
    best, tables, span = np.arange(len(rows), dtype=np.int32), [], 1
    while True:
        tables.append(best)
        if 2 * span > longest:
            break
        left, right = best[:-span], best[span:]
        best = np.r_[np.where(rows[right] < rows[left], right, left), best[len(best) - span :]]
        span *= 2
    power = np.frexp(np.arange(longest + 1))[1][hi - lo] - 1
    flat, width = np.concatenate(tables), len(rows)
    left, right = flat[power * width + lo], flat[power * width + hi - (1 << power)]
    return np.where(rows[right] < rows[left], right, left)


def _in_a_row(names: np.ndarray, level: int) -> np.ndarray:
    """One 64-bit key for each IN_A_ROW symbols in a row."""
    key = names
    for k in range(1, IN_A_ROW):
        key = joined(key[:-1], names[k:], 1000 + 10 * level + k)
    return key[:, 0]


def anchors(names: np.ndarray, starts: np.ndarray, window: int, greatest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the anchor (least or greatest) of the window that begins at each of `starts`: a matter of the window's words alone, but for the place."""
    lo, hi, names = starts, starts + window, names[:, :1]
    one = Round(names, 0)
    a, b = one.inside(lo, hi)
    deep = b - a >= IN_A_ROW
    key, place = np.empty(len(starts), np.uint64), np.empty(len(starts), np.int64)
    for some, row, first, last, at in ((deep, _in_a_row(one.names, 1), a, b, one.first), (~deep, _in_a_row(names, 0), lo, hi, None)):
        if some.any():
            best = _least(~row if greatest else row, first[some], last[some] - IN_A_ROW + 1)
            key[some], place[some] = row[best], best if at is None else at[best]
    return key, place


def climbed(names: np.ndarray, part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words) of the symbols of `least` words and more, on all levels, that lie within one part.

    names: the words of several passages behind one another; part: the number of each word's
    passage. Symbols over the border of two passages stand for nothing and only go up with the others.
    """
    found, first, level = [], np.arange(len(names)), 1
    total = len(names)
    while True:
        done = Round(names, level)
        names, first = done.names, first[done.first]
        end = np.r_[first[1:], total]
        own = part[first] == part[end - 1]
        long = own & (end - first >= least)
        found.append((names[long], first[long], (end - first)[long]))
        if not own.any() or len(names) == 1:
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))
        level += 1


def window_hashes(names: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """128-bit hashes, in two lanes, of the words of the windows that begin at starts."""
    whole, done, power, span = None, 0, names, 1
    while True:
        if window & span:
            whole = power[starts + done] if whole is None else joined(whole, power[starts + done], 100_000 + span)
            done += span
        if 2 * span > window:
            return whole
        power, span = joined(power[:-span], power[span:], 200_000 + span), 2 * span


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _named(batches: Iterator[pa.RecordBatch], window: int, columns: list[str], lanes: int = 1) -> Iterator[tuple]:
    """(names, parts, data, begin, end) of about SLICE bytes; a part is (first row of names, end row, number of the first word, *columns)."""

    def whole() -> tuple:
        data = b" ".join(held)
        names, begin, end = named(data, lanes)
        cuts = np.searchsorted(begin, np.cumsum([0] + [len(h) + 1 for h in held])).tolist()
        return names, [(a, b, *k) for a, b, k in zip(cuts[:-1], cuts[1:], kept, strict=True)], data, begin, end

    held, kept, n = [], [], 0
    for batch in batches:
        values = [batch.column(c) for c in columns]
        for i, data in enumerate(batch.column("text").cast(pa.binary())):
            if not data.is_valid:
                continue
            for first, part in sliced(data.as_py(), window):
                held.append(part)
                kept.append((first, *[v[i].as_py() for v in values]))
                n += len(part)
                if n >= SLICE:
                    yield whole()
                    held, kept, n = [], [], 0
    if held:
        yield whole()


def _starts(parts: list[tuple], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows where windows begin, the part of each)."""
    many = np.maximum(np.array([p[1] - p[0] - window + 1 for p in parts]), 0)
    part = np.repeat(np.arange(len(parts)), many)
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat([p[0] for p in parts], many), part


def _anchor_rows(texts: DataFrame, window: int, with_places: bool = False, greatest: bool = False) -> DataFrame:
    """(key, doc_id[, mark, start, many]): `many` windows from the one at `start` have the anchor `key`."""
    schema = f"key long, doc_id {texts.schema['doc_id'].dataType.simpleString()}" + ", mark long, start long, many long" * with_places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for names, parts, *_ in _named(_peeked(batches, kinds := []), window, ["doc_id", "mark"]):
            kind = kinds[0]
            starts, part = _starts(parts, window)
            if not len(starts):
                continue
            key, place = anchors(names, starts, window, greatest)
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (part[1:] != part[:-1])])
            own = part[new]
            columns = [_signed(key[new]), pa.array([p[3] for p in parts], kind).take(pa.array(own))]
            if with_places:
                zero, number = np.array([p[0] for p in parts]), np.array([p[2] for p in parts])
                columns += [pa.array([p[4] for p in parts], pa.int64()).take(pa.array(own)), pa.array(starts[new] - zero[own] + number[own]), pa.array(np.diff(np.r_[new, len(starts)]))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return texts.mapInArrow(run, schema)


def _peeked(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds.append(batch.schema.field("doc_id").type) if not kinds else None
        yield batch


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _least) of what occurs in two documents or more."""
    seen = rows.groupBy(*keys).agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"))
    return seen.filter("_least < _most").select(*keys, "_least")


def _of_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows joined (semi or anti) to the written table ids(doc_id, mark)."""
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, ["doc_id", "mark"], how)


class Filter:
    """A Bloom filter of 64-bit keys in blocks: the key's first bits say the block, its hash three bits of it."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.blocks = bits, len(bits) * 8 >> _BLOCK

    @staticmethod
    def places(keys: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            h = mixed(keys + U(77))
        return [(h >> U(k * _BLOCK)) & U((1 << _BLOCK) - 1) for k in range(3)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        shift = 64 - self.blocks.bit_length() + 1
        base = (keys >> U(shift)) << U(_BLOCK) if self.blocks > 1 else np.zeros(len(keys), np.uint64)
        found = np.ones(len(keys), bool)
        for p in self.places(keys):
            at = base + p
            found &= (self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
        return found


def filter_of(keys: DataFrame) -> Filter | None:
    """A Filter of the written table keys(key); None if they are too many for FILTER_BITS. Blocks are built in tasks, the driver only lays them side by side."""
    n = keys.count()
    if n * LEAST_BITS > FILTER_BITS:
        return None
    blocks = max(1, min(FILTER_BITS, 1 << max(n * BEST_BITS - 1, 1).bit_length()) >> _BLOCK)
    depth = blocks.bit_length() - 1
    block = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])
        for batch in batches:
            own, key = batch.column("block").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            for b in np.unique(own):
                if b != at:
                    if at is not None:
                        yield row()
                    at, bits = int(b), np.zeros(1 << _BLOCK, bool)
                for p in Filter.places(key[own == b]):
                    bits[p.astype(np.int64)] = True
        if at is not None:
            yield row()

    rows = keys.select(block.alias("block"), "key").repartition("block").sortWithinPartitions("block").mapInArrow(build, "block int, bits binary")
    whole = np.zeros((blocks, (1 << _BLOCK) // 8), np.uint8)
    for r in rows.toLocalIterator():  # FILTER_BITS / 8 bytes in all
        whole[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return Filter(whole.ravel())


def _stretches(texts: DataFrame, window: int, seen) -> DataFrame:
    """(doc_id, mark, start, text) of the maximal runs of windows whose anchors are in the broadcast filter `seen`, or, without it, under texts.spans (start, many).

    text: the words with the blanks between them.
    """
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, mark long, start long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, parts, data, first_byte, end_byte in _named(_peeked(batches, kinds := []), window, ["doc_id", "mark"] + ["spans"] * (seen is None)):
            starts, part = _starts(parts, window)
            if not len(starts):
                continue
            if seen is not None:
                on = seen.value.has(anchors(names, starts, window)[0])
                begin = np.flatnonzero(on & np.r_[True, ~on[:-1] | (part[1:] != part[:-1])])
                end = np.flatnonzero(on & np.r_[~on[1:] | (part[1:] != part[:-1]), True])
                found = [(part[i], starts[i] - parts[part[i]][0], starts[j] - parts[part[i]][0] + 1) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
            else:
                found = []
                for k, (a, b, first, *_, spans) in enumerate(parts):
                    if b - a < window:
                        continue
                    at = np.array([x["start"] for x in spans], np.int64) - first
                    hit, most = np.zeros(b - a - window + 2, np.int64), b - a - window + 1
                    np.add.at(hit, np.clip(at, 0, most), 1)
                    np.add.at(hit, np.clip(at + np.array([x["many"] for x in spans], np.int64), 0, most), -1)
                    edge = np.diff(np.r_[0, np.cumsum(hit)[:-1] > 0, 0].astype(np.int8))
                    found += [(k, i, j) for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
            cut = lambda a, i, j: data[first_byte[a + i] : end_byte[a + j + window - 2]].decode()  # noqa: B023, E731
            rows = [(parts[k][3], parts[k][4], parts[k][2] + int(i), cut(parts[k][0], i, j)) for k, i, j in found]
            if rows:
                doc, mark, start, held = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, kinds[0]), pa.array(mark, pa.int64()), pa.array(start, pa.int64()), pa.array(held, pa.string())], names=["doc_id", "mark", "start", "text"])

    return texts.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(names, row, row's first place in names, rows): stretches of about SLICE bytes behind one another."""
    for batch in batches:
        held, n, begin = [], 0, 0
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            held.append(text)
            n += len(text)
            if n >= SLICE or i + 1 == batch.num_rows:
                names, first, _ = named(b" ".join(held), 2)
                cuts = np.searchsorted(first, np.cumsum([0] + [len(h) + 1 for h in held]))
                yield names, np.repeat(np.arange(len(held)), np.diff(cuts)), cuts[:-1], batch.slice(begin, len(held))
                held, n, begin = [], 0, i + 1


def _symbols(stretches: DataFrame, least: int) -> DataFrame:
    """(a, b, doc_id, mark, stretch, start, words) of the long symbols of stretches; a and b are the lanes of the name."""
    schema = f"a long, b long, doc_id {stretches.schema['doc_id'].dataType.simpleString()}, mark long, stretch long, start long, words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, row, zero, rows in _gathered(batches):
            name, first, words = climbed(names, row, least)
            own = row[first]
            place = first - zero[own] + rows.column("start").to_numpy()[own]
            columns = [_signed(name[:, 0]), _signed(name[:, 1]), *[rows.column(c).take(pa.array(own)) for c in ("doc_id", "mark", "start")], pa.array(place), pa.array(words)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc_id", "mark", "stretch", "start", "words"])

    return stretches.mapInArrow(run, schema)


def _windows(stretches: DataFrame, window: int, seen) -> DataFrame:
    """(a, b, doc_id, mark, start) of the windows of stretches that lie in none of `settled` (start, words) as a whole and have their second anchor in the broadcast filter `seen`, if there is one."""
    schema = f"a long, b long, doc_id {stretches.schema['doc_id'].dataType.simpleString()}, mark long, start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, row, zero, rows in _gathered(batches):
            within = np.zeros(len(names) + 1, np.int64)
            start, settled = rows.column("start").to_numpy(), rows.column("settled")
            whose = np.repeat(np.arange(rows.num_rows), [len(s) if s.is_valid else 0 for s in settled])
            parts = settled.flatten()
            begin = parts.field("start").to_numpy() - start[whose] + zero[whose]
            np.add.at(within, begin, 1)
            np.add.at(within, begin + parts.field("words").to_numpy() - window + 1, -1)
            last = np.r_[zero[1:], len(names)] - window
            at = np.flatnonzero((np.cumsum(within)[:-1] == 0) & (np.arange(len(names)) <= last[row]))
            if seen is not None and len(at):
                at = at[seen.value.has(anchors(names, at, window, greatest=True)[0])]
            lane, own = window_hashes(names, at, window), row[at]
            take = pa.array(own)
            columns = [_signed(lane[:, 0]), _signed(lane[:, 1]), rows.column("doc_id").take(take), rows.column("mark").take(take), pa.array(at - zero[own] + start[own])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc_id", "mark", "start"])

    return stretches.mapInArrow(run, schema)


def _earlier(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose name (a, b) also occurs in an earlier document, and a table that they read: written, so that the join's sides are plain exchanges and a hot name can be split."""
    first = materialize(_shared(rows, ["a", "b"]))
    return rows.join(first, ["a", "b"]).filter("_least < doc_id").drop("_least"), first


def repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """A written table (doc_id, mark, ranges of (start, words)): the words of docs(doc_id, text) under windows that start in an earlier document too; the caller forgets it.

    mark is the 64-bit hash of the text: rows of one doc_id with different texts stay apart, and
    as none is earlier than the other they don't cover each other. Null texts have no words. Rows without a
    doc_id are neither earlier nor later than any and stay out. The text of a smaller doc_id is a repeat
    from end to end: one range of -1 words, for all words of a text with a window or more.
    """
    spark = docs.sparkSession
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    marks = texts.select("doc_id", "mark", F.sha2("text", 256).alias("_sha"))
    first = marks.groupBy("_sha").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).filter("_least < _most").drop("_most")
    copies = materialize(marks.join(first, "_sha").filter("_least < doc_id").select("doc_id", "mark").distinct())
    texts = _of_ids(texts, copies, "left_anti")

    keys = materialize(_shared(_anchor_rows(texts, window), ["key"]).select("key"))
    seen = filter_of(keys)
    if seen is not None:
        stretches = materialize(_stretches(texts, window, spark.sparkContext.broadcast(seen)))
    else:
        rows = _anchor_rows(texts, window, with_places=True).join(keys, "key")
        spans = materialize(rows.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "many")).alias("spans")))
        stretches = materialize(_stretches(_of_ids(texts, spans.select("doc_id", "mark"), "left_semi").join(spans, ["doc_id", "mark"]), window, None))
        forget(spans)
    forget(keys)
    keys = materialize(_shared(_anchor_rows(stretches, window, greatest=True), ["key"]).select("key"))
    second = filter_of(keys)
    second = None if second is None else spark.sparkContext.broadcast(second)
    forget(keys)

    # Twice the window: a symbol of that length spares as many windows as lie over its edges.
    later, names = _earlier(_symbols(stretches, 2 * window))
    settled = materialize(later)
    by = settled.groupBy("doc_id", "mark", F.col("stretch").alias("start")).agg(F.collect_set(F.struct("start", "words")).alias("settled"))
    by = F.broadcast(by) if settled.count() <= BROADCAST_IDS else by
    windows = _windows(stretches.join(by, ["doc_id", "mark", "start"], "left"), window, second)
    later, hashes = _earlier(windows)
    found = settled.select("doc_id", "mark", "start", "words").union(later.select("doc_id", "mark", "start", F.lit(window).cast("long")))
    found = found.union(copies.select("doc_id", "mark", F.lit(0).cast("long"), F.lit(-1).cast("long")))
    covered = materialize(found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "words")).alias("ranges")))
    forget(stretches, settled, copies, names, hashes)
    return covered


def _kept(rows: DataFrame, window: int, ranges: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, one space between them)."""
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                many, gone, kept = [], [], []
                for text, own in zip(batch.column("text"), batch.column("ranges") if ranges else [None] * batch.num_rows, strict=True):
                    words = (text.as_py() or "").encode().split()
                    many.append(len(words))
                    if ranges:
                        begin, span = (own.values.field(c).to_numpy() for c in ("start", "words"))
                        span = np.where(span < 0, len(words) if len(words) >= window else 0, span)
                        on = np.zeros(len(words) + 1, np.int64)
                        np.add.at(on, begin, 1)
                        np.add.at(on, begin + span, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(on)[:-1] == 0).tolist()]
                    gone.append(many[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(many, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs(doc_id, text).

    Words are runs of other characters than the six ASCII blanks. A word goes if a window of `window` consecutive words over it also
    starts in a document with a smaller doc_id, in the input as it is. kept: the other words with one space
    between them. Null and empty texts have no words; rows without a doc_id keep all of theirs; repeated
    rows give repeated results. Reads one written table (repeats()).
    """
    covered = repeats(docs, window)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    touched = covered.select("doc_id", "mark")
    ranged = _of_ids(rows, touched, "left_semi").join(covered, ["doc_id", "mark"])
    return _kept(_of_ids(rows, touched, "left_anti"), window, False).union(_kept(ranged, window, True))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
place AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS x FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
earliest AS (SELECT x, min(doc_id) AS f FROM win GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN earliest USING (x), range(13) AS r(k) WHERE f < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n FROM place ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, len(w.words) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
