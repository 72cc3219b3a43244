"""Packing of tokenised documents into sequences by bulk-synchronous best fit.

Pieces and gaps (sequences with room) are two tables. One superstep takes a band of lengths: pieces
of the band and gaps are range-sorted together from the largest size down (their counts by size give the ends of the ranges), and tasks
sweep range by range. A piece's successor is the least gap that is long enough, which in this order
is the last open gap before it, so a task keeps its open gaps as a stack. Pieces
that want the same gap get it by rank, and those that lose go on to the next larger one. What a range
can't place and the gaps that it leaves open are ranked by size; their counts (no more than
2 * capacity sizes and two for every range) are matched over the ends of the ranges, and pieces
meet these gaps in a join by rank. Then gaps are updated, the step's tables are written, and
what has no place opens sequences or goes on to the next step.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm.common import forget, materialize

#: Bands of lengths, as parts of the capacity: a step's pieces are longer than one of these and at most as long as the one before.
BANDS = (1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 6, 1 / 8, 1 / 16, 1 / 32, 1 / 64, 1 / 128, 1 / 256, 1 / 512, 0)
#: Pieces up to this part of the capacity may go several at once, of one length, into a gap.
SMALL = 1 / 16
_SHIFT = 40


def _bytes_of_chars() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of the byte-level BPE vocabulary at path, as its tokenizer gives them without added tokens.

    The same merges run several times faster in tiktoken; a text that it can't take (runs of
    white space that exhaust its regex) goes to the tokenizer itself.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    model = json.load(open(path, encoding="utf-8"))
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    chars = _bytes_of_chars()
    ranks = {bytes(map(chars.__getitem__, k)): v for k, v in model["model"]["vocab"].items() if k not in special}
    fast = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = []

    def encode(text: str) -> np.ndarray:
        marks = {s for s in special if s in text}
        try:
            return fast.encode_to_numpy(text, allowed_special=marks, disallowed_special=())
        except BaseException as e:  # noqa: BLE001  the regex engine's panic is no Exception
            if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                raise
            slow.append(Tokenizer.from_file(path)) if not slow else None
            return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = True) -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32, number (and ids).

    Each document's ids end with end_id, so a null or empty text gives one piece of one
    token. Only documents over the capacity are cut, into full pieces after a shorter first.
    number tells pieces apart and hangs on the tasks; the table must be
    written before it is read twice. vocabulary: a path that every executor can read.
    """
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(vocabulary), TaskContext.get().partitionId() << _SHIFT
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                index, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    begin, k = 0, 0
                    while begin < len(ids):
                        n = (len(ids) - begin - 1) % capacity + 1 if k == 0 else capacity
                        own = ids[begin : begin + n]
                        index.append(i), piece.append(k), start.append(begin), length.append(n)
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            kept.append(own.astype(np.int32))
                        begin, k = begin + n, k + 1
                columns = [
                    batch.column("doc_id").take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.arange(number, number + len(index)), pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                number += len(index)
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return source.mapInArrow(cut, schema)


SWEPT = "range int, piece boolean, id long, size long, rank long, sequence_id long, offset long"
#: Rows of one range (up to twice as many); the task that sweeps it keeps the ids of its open gaps.
RANGE_ROWS = 500_000


def together(length: int, free: int, capacity: int) -> int:
    """How many pieces of one length go into a gap in one superstep."""
    return free // length if length <= capacity * SMALL else 1


def swept_ranges(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """SWEPT rows of ranges whose rows (range, size, piece, id) come one range after another, from the largest size down, gaps before pieces of their size.

    A piece with its place has sequence_id and offset; a gap that took pieces has its new size. Pieces
    and gaps that are left are ranked by size.
    """
    at, stack, missed, kind = None, [], Counter(), pa.schema([(n, {"int": pa.int32(), "boolean": pa.bool_()}.get(t, pa.int64())) for n, t in (x.split() for x in SWEPT.split(", "))])

    def rows(piece: bool, ids: np.ndarray, size, rank=None, sequence=None, offset=None) -> pa.RecordBatch:  # noqa: ANN001
        full = lambda x: pa.nulls(len(ids), pa.int64()) if x is None else pa.array(np.broadcast_to(x, len(ids)), pa.int64())
        columns = [pa.array(np.full(len(ids), at), pa.int32()), pa.array(np.full(len(ids), piece)), pa.array(ids, pa.int64()), *map(full, (size, rank, sequence, offset))]
        return pa.RecordBatch.from_arrays(columns, schema=kind)

    def still_open() -> Iterator[pa.RecordBatch]:
        open_ = Counter()
        for free, gaps in reversed(stack):
            yield rows(False, gaps, free, open_[free] + np.arange(len(gaps)))
            open_[free] += len(gaps)

    for batch in batches:
        ranges, sizes, pieces, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("range", "size", "piece", "id"))
        cuts = np.flatnonzero((np.diff(ranges) != 0) | (np.diff(sizes) != 0) | (np.diff(pieces.astype(np.int8)) != 0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if begin == end:
                continue
            if ranges[begin] != at:
                yield from still_open()
                at, stack, missed = int(ranges[begin]), [], Counter()
            length, own = int(sizes[begin]), ids[begin:end]
            if not pieces[begin]:
                stack.append((length, own))
                continue
            while len(own) and stack:
                free, gaps = stack.pop()
                many = together(length, free, capacity)
                used = min(len(gaps), -(-len(own) // many))
                placed, own = own[: used * many], own[used * many :]
                gap, nth = np.divmod(np.arange(len(placed)), many)
                yield rows(True, placed, length, None, gaps[gap], capacity - free + nth * length)
                yield rows(False, gaps[:used], free - length * np.bincount(gap, minlength=used))
                if used < len(gaps):
                    stack.append((free, gaps[used:]))
            if len(own):
                yield rows(True, own, length, missed[length] + np.arange(len(own)))
                missed[length] += len(own)
    yield from still_open()


def over_ends(left: dict[tuple[int, bool, int], int], capacity: int) -> list[tuple[int, ...]]:
    """Runs (range, length, first rank, count, many, range of gaps, their size, their first rank) that match what ranges have left.

    left: how many pieces (True) and gaps (False) of one size a range has left; `many` pieces with successive ranks share a gap.
    In a range the pieces that are left stand before the gaps, as they would have gone into them.
    """
    stack, runs = [], []
    for (at, piece, size), count in sorted(left.items(), key=lambda x: (x[0][0], not x[0][1], -x[0][2])):
        if not piece:
            stack.append((at, size, 0, count))
            continue
        first = 0
        while first < count and stack:
            gap_range, free, gap_first, gaps = stack.pop()
            many = together(size, free, capacity)
            used = min(gaps, -(-(count - first) // many))
            taken = min(count - first, used * many)
            runs.append((at, size, first, taken, many, gap_range, free, gap_first))
            first += taken
            if used < gaps:
                stack.append((gap_range, free, gap_first + used, gaps - used))
    return runs


RUNS = "_range int, _length long, _first long, _count long, _many long, _gap_range int, _free long, _gap_first long"


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver for a broadcast; its rows are runs of sizes, see over_ends()."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _met(missed: DataFrame, gaps: DataFrame, runs: DataFrame, capacity: int) -> DataFrame:
    """id, sequence_id, offset of the pieces that get a gap of another range, and with the first piece of a gap the gap's new size."""
    nth = F.col("rank") - F.col("_first")
    found = missed.join(runs, (F.col("range") == F.col("_range")) & (F.col("size") == F.col("_length")) & nth.between(0, F.col("_count") - 1))
    found = found.select("id", "_length", "_many", "_gap_range", "_free", nth.alias("_nth"), "_count", (F.col("_gap_first") + F.floor(nth / F.col("_many"))).alias("_gap"))
    ends = gaps.select("range", "size", "rank", F.col("id").alias("sequence_id"))
    found = found.join(ends, (F.col("_gap_range") == F.col("range")) & (F.col("_free") == F.col("size")) & (F.col("_gap") == F.col("rank")))
    turn = F.col("_nth") % F.col("_many")
    after = F.when(turn == 0, F.col("_free") - F.col("_length") * F.least("_many", F.col("_count") - F.col("_nth")))
    return found.select("id", "sequence_id", (F.lit(capacity) - F.col("_free") + turn * F.col("_length")).alias("offset"), after.alias("after"))


def bounds(sizes: dict[tuple[int, bool], int], range_rows: int) -> dict[tuple[int, bool], tuple[int, int]]:
    """(first range, ranges) of the pieces (True) or gaps (False) of each size, in the order of the sweep; a larger class is dealt over several ranges."""
    found, before = {}, 0
    for (size, piece), count in sorted(sizes.items(), key=lambda x: (-x[0][0], x[0][1])):
        first = before // range_rows
        found[size, piece] = first, max(1, -(-count // range_rows))
        before = before + count if found[size, piece][1] == 1 else (first + found[size, piece][1]) * range_rows
    return found


def _swept(rows: DataFrame, sizes: dict[tuple[int, bool], int], capacity: int, range_rows: int) -> DataFrame:
    """SWEPT rows of rows (size, piece, id), of which there are so many of each size, range-sorted and swept range by range.

    The counts give the ends of the ranges, so nothing is sampled; a row of a class that is dealt over several ranges goes by the hash of its id.
    """
    found = bounds(sizes, range_rows)
    if max(first + n for first, n in found.values()) == 1:
        range_ = F.lit(0)
    else:
        look = [",".join(str(found.get((n, piece), (0, 1))[k]) for n in range(capacity + 1) for piece in (False, True)) for k in (0, 1)]
        first, parts = (F.get(F.expr(f"array({x})"), (F.col("size") * 2 + F.col("piece").cast("int")).cast("int")) for x in look)
        range_ = (first + F.pmod(F.xxhash64("id"), parts)).cast("int")
    order = [F.col("range"), F.col("size").desc(), F.col("piece").asc(), F.col("id").asc()]
    ranged = rows.select(range_.alias("range"), "size", "piece", "id").repartition("range").sortWithinPartitions(*order)
    return ranged.mapInArrow(lambda batches: swept_ranges(batches, capacity), SWEPT)


def supersteps(pieces: DataFrame, counts: dict[int, int], capacity: int, range_rows: int = RANGE_ROWS) -> Iterator[tuple[DataFrame, list[DataFrame]]]:
    """(id, sequence_id, offset) of the pieces that a superstep places, and the written tables that it reads.

    pieces: a written table with number and length; counts: its rows by length. A step opens sequences only
    if no gap could take any piece of the band that is left, and then enough for all of them, for the longest first.
    """
    parts = lambda rows: max(1, -(-rows // range_rows))
    spark, left, gaps, table, sequences = pieces.sparkSession, dict(counts), Counter(), None, 0
    for high, low in zip((1, *BANDS), BANDS, strict=False):
        inside = F.col("length").between(int(low * capacity) + 1, int(high * capacity))
        waiting = pieces.filter(inside).select(F.col("length").alias("size"), F.lit(True).alias("piece"), F.col("number").alias("id"))
        while lengths := sorted((n for n, c in left.items() if c and int(low * capacity) < n <= int(high * capacity)), reverse=True):
            rows, parked, sizes = waiting, None, {(n, True): left[n] for n in lengths}
            if table is not None:
                rows = rows.union(table.filter(F.col("size") >= lengths[-1]))
                sizes |= {(n, False): c for n, c in gaps.items() if n >= lengths[-1]}
                nothing = [F.lit(None).cast("long").alias(c) for c in ("rank", "sequence_id", "offset")]
                parked = table.filter(F.col("size") < lengths[-1]).select(F.lit(-1).alias("range"), "piece", "id", "size", *nothing)
                parked = parked.coalesce(parts(sum(c for n, c in gaps.items() if n < lengths[-1])))
            swept = _swept(rows, sizes, capacity, range_rows)
            swept = materialize(swept.union(parked) if parked is not None else swept)

            open_, gaps = {}, Counter()
            where = F.when(F.col("rank").isNotNull(), F.col("range"))
            for at, piece, size, count in swept.filter("not piece or rank is not null").groupBy(where, "piece", "size").count().collect():
                if at is None:
                    gaps[size] += count
                else:
                    open_[at, piece, size] = count
            left |= dict.fromkeys(lengths, 0)
            runs = over_ends(open_, capacity)
            filled, met = Counter(), Counter()
            for at, length, _, count, many, gap_range, free, _ in runs:
                met[at, length] += count
                filled[gap_range, free] += -(-count // many)
                gaps[free - many * length] += count // many
                if count % many:
                    gaps[free - count % many * length] += 1
            for (at, piece, size), count in open_.items():
                if piece:
                    left[size] += count - met[at, size]
                else:
                    gaps[size] += count - filled[at, size]

            fresh, rest = [], sorted((at, -size) for at, piece, size in open_ if piece)
            if (lengths := [n for n in lengths if left[n]]) and max(+gaps, default=0) < lengths[-1]:
                need = -(-sum(left[n] for n in lengths) // (capacity // lengths[0]))
                for at, length in ((at, -negative) for at, negative in rest):
                    if count := min(need, open_[at, True, length] - met[at, length]):
                        fresh.append((at, length, met[at, length], count, sequences))
                        met[at, length] += count
                        left[length] -= count
                        gaps[capacity - length] += count
                        sequences, need = sequences + count, need - count

            missed, ends = swept.filter("piece and rank is not null").drop("sequence_id", "offset"), swept.filter("not piece and rank is not null")
            made = [_met(missed, ends, _small(spark, runs, RUNS), capacity)] if runs else []
            if fresh:
                nth = F.col("rank") - F.col("_first")
                own = _small(spark, fresh, "_range int, _length long, _first long, _count long, _sequence long")
                found = missed.join(own, (F.col("range") == F.col("_range")) & (F.col("size") == F.col("_length")) & nth.between(0, F.col("_count") - 1))
                made.append(found.select("id", (F.col("_sequence") + nth).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), (F.lit(capacity) - F.col("size")).alias("after")))
            total = sum(r[3] for r in (*runs, *fresh))
            made = [materialize(reduce(DataFrame.union, made).coalesce(parts(total)))] if made else []
            yield reduce(DataFrame.union, [x.select("id", "sequence_id", "offset") for x in (swept.filter("piece and rank is null"), *made)]), [swept, *made]

            waiting = _beyond(missed, met)
            least = min((n for n, c in left.items() if c), default=capacity + 1)
            new = [x.select(F.col("after").alias("size"), F.lit(False).alias("piece"), F.col("sequence_id").alias("id")).filter("size is not null") for x in made]
            table = reduce(DataFrame.union, [_beyond(swept.filter("not piece"), filled), *new]).filter(F.col("size") >= least)
            gaps = Counter({size: c for size, c in gaps.items() if size >= least and c})


def _beyond(rows: DataFrame, ranks: dict[tuple[int, int], int]) -> DataFrame:
    """(size, piece, id) of the rows without a rank, and of those whose rank is not below ranks[range, size]."""
    if ranks:
        first = _small(rows.sparkSession, [(*key, n) for key, n in ranks.items()], "_range int, _size long, _first long")
        rows = rows.join(first, (F.col("range") == F.col("_range")) & (F.col("size") == F.col("_size")), "left").filter("rank is null or rank >= coalesce(_first, 0)")
    return rows.select("size", "piece", "id")


def pack(pieces: DataFrame, capacity: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add sequence_id and offset to token_pieces(); number goes.

    Sequences overlap nowhere, hold capacity tokens at most and have no holes. An empty
    table gives an empty one. The result reads two written tables, the pieces and their places; those of the steps are deleted.
    """
    pieces = materialize(pieces)
    keep = [c for c in pieces.columns if c != "number"]
    totals = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    steps = list(supersteps(pieces, totals, capacity, range_rows))
    if not steps:
        return pieces.select(*keep, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    tasks = max(pieces.sparkSession.sparkContext.defaultParallelism, -(-sum(totals.values()) // range_rows))
    places = materialize(reduce(DataFrame.union, (placed for placed, _ in steps)).coalesce(tasks))
    for _, tables in steps:
        forget(*tables)
    return pieces.join(places, F.col("number") == F.col("id")).select(*keep, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset for every piece of every document.

    Null and empty texts are one piece of one token; other columns of docs are not looked at; rows that share a doc_id are packed
    one by one; an empty table gives an empty one.
    """
    return pack(token_pieces(docs, vocabulary, capacity, end_id, with_ids), capacity)
