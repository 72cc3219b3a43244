"""Alignment of two tokenizers' tokens over one text, and how often their entries meet in a corpus.

Tokens of A and B are the nodes of a bipartite graph; an edge joins two that share a byte. Union-find
over the edges gives the connected components: the least groups of tokens that cover the same bytes, as
components are intervals that begin and end where a token of either side does. Members of a component
expand into links again; links are counted by pair of ids in Spark, and every document is measured
against these counts by a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.llm.common import free_name, materialize
from rosterline.llm.packing import _bytes_of_chars

#: Texts of a batch that are worked on at once.
_TEXTS = 256


@lru_cache(maxsize=2)
def byte_level(path: str):
    """(text -> ids, bytes of each id) of the byte-level vocabulary at path; special tokens' strings in a text are plain text.

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
    fast = tiktoken.Encoding("plain byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    entries = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for entry, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
        entries[i] = entry
    slow = []

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # noqa: BLE001  the regex engine's panic is no Exception
            if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                raise
            if not slow:
                slow.append(Tokenizer.from_file(path))
                slow[0].encode_special_tokens = True
            return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode, entries


@lru_cache(maxsize=2)
def pieces(path: str):
    """(text -> ids, bytes of each id) of the SentencePiece model at path."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        entries.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return (lambda text: np.array(model.encode(text, num_threads=1), dtype=np.int64)), entries


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every overlap, by place, for the ends of tokens that cover the same bytes without gaps; each pair once."""
    ends = np.union1d(end_a, end_b)
    return np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)


def components(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """The component of each A token, then of each B token, by union-find over the edges (a, b); named by its first A token.

    All unions of a sweep at once: a root takes the least root that an edge joins it to, then
    all paths are halved until each node points to its root; sweeps go on until no edge joins two.
    """
    root = np.arange(n_a + n_b)
    # A tokens come before B tokens; the first edge of a B token unites it with the A token it begins in.
    a, b = a.astype(np.int64), b.astype(np.int64) + n_a
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root = higher
    return root


class Aligner:
    """Aligns texts; holds the vocabularies and the written forms of their ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.encode_a, self.bytes_a = byte_level(path_a)
        self.encode_b, self.bytes_b = pieces(path_b)
        self.length_a, self.length_b = (np.array([len(x) for x in e]) for e in (self.bytes_a, self.bytes_b))
        # An id is followed by "," within its side, A's last by "|", B's last by ";".
        self.written = [f"{i}{mark}" for mark in ",|" for i in range(len(self.bytes_a))] + [f"{i}{mark}" for mark in ",;" for i in range(len(self.bytes_b))]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of " " + text by A and of text by B; None where there is no text or either loses bytes."""
        if not text:
            return None
        a, b, data = self.encode_a(" " + text).astype(np.int64), self.encode_b(text), b" " + text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == data
        return (a, b) if same else None

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, written groups, distinct pairs as A id << 32 | B id, links of each) for every text."""
        found = [self.tokens(t) for t in texts]
        kept = [f for f in found if f is not None]
        if kept:
            a, b = (np.concatenate([f[side] for f in kept]) for side in (0, 1))
            at_a, at_b = (np.cumsum([0] + [len(f[side]) for f in kept]) for side in (0, 1))
            # Texts lie behind one another; as both sides end with each text, no component crosses.
            link_a, link_b = overlaps(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
            group = components(link_a, link_b, len(a), len(b))
            group_a, group_b = group[: len(a)], group[len(a) :]
            last_a, last_b = (np.r_[g[1:] != g[:-1], True] for g in (group_a, group_b))
            # Groups in order, A before B: B tokens come behind the last A token of their group.
            order = np.argsort(np.r_[group_a * 2, group_b * 2 + 1], kind="stable")
            word = np.r_[a + last_a * len(self.bytes_a), b + 2 * len(self.bytes_a) + last_b * len(self.bytes_b)][order]
            pair = (a[link_a] << 32) | b[link_b]
            at_link, ends = np.searchsorted(link_a, at_a), np.cumsum(last_a)
        k = 0
        for f in found:
            if f is None:
                yield 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
                continue
            begin, end = at_a[k] + at_b[k], at_a[k + 1] + at_b[k + 1]
            groups = int(ends[at_a[k + 1] - 1] - (ends[at_a[k] - 1] if k else 0))
            text = "".join(map(self.written.__getitem__, word[begin:end].tolist()))[:-1]
            own = pair[at_link[k] : at_link[k + 1]]
            yield len(f[0]), len(f[1]), groups, len(own), text, *np.unique(own, return_counts=True)
            k += 1


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links (and groups) of every row of docs(doc_id, text).

    A reads a space and the text, B the text (it adds the space). Null and empty texts, and those whose bytes either side does not give
    back, have no tokens: zeros, empty arrays and ''. groups: `a1,a2|b1;a3|b2,b3`. pairs: the text's distinct
    A id << 32 | B id, links: how many links of the text each has. Rows are taken one by one: repeated rows give
    repeated results. Both paths must be readable on every executor.
    """
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>" + ", groups string" * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for big in batches:
            for at in range(0, big.num_rows, _TEXTS):
                batch = big.slice(at, _TEXTS)
                n_a, n_b, groups, links, texts, pairs, counts = zip(*aligner.align(batch.column("text").to_pylist()), strict=True)
                sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                offsets = pa.array(np.cumsum([0] + [len(p) for p in pairs]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, counts)]
                columns = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)], pa.array(sha), *lists]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(texts)] * with_groups, names=[c.split()[0] for c in schema.split(", ")])

    return source.mapInArrow(run, schema)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, count, best) over all links of aligned() rows; best: no pair of its B id has a greater count. Counts are summed before and after one exchange."""
    counts = texts.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.links").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))  # at most as many rows as A has ids
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def corpus_alignment(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(documents, pair counts): aligned() rows with n_best and count_sum, and pair_counts(); two written tables are read.

    n_best: links whose pair has its B id's highest count in the corpus, ties included; count_sum: the
    counts of all links added up, null beyond a long. A document's distinct pairs meet the counts in a join that
    Spark plans by their size: broadcast while small, else by exchange of both, split where a
    pair is hot.
    """
    texts = aligned(docs, path_a, path_b)
    row = free_name("row", texts.columns)
    texts = materialize(texts.withColumn(row, F.monotonically_increasing_id()))
    counts = materialize(pair_counts(texts))
    one = texts.select(row, F.explode(F.arrays_zip("pairs", "links")).alias("p")).select(row, F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    of = one.join(counts, "pair").groupBy(row).agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links").cast("decimal(20,0)") * F.col("count")).alias("count_sum"),
    )
    sums = F.coalesce(F.col("count_sum").try_cast("long"), F.when(F.col("n_links") == 0, F.lit(0).cast("long"))).alias("count_sum")
    out = texts.drop("pairs", "links").join(of, row, "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), sums, "groups_sha256")
    return out, counts
