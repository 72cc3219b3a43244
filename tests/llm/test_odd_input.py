"""Faults that once slipped through: large groups alone, letterless texts, odd WARC files, huge and tiny vectors, clashing columns."""

from __future__ import annotations

import gzip
import heapq
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from rosterline.llm import embedding_index, language_id, sentencepiece_sampling, sharding, warc


def test_shards_of_large_groups_alone(spark):
    """No small group evens anything out: the spread stays within twice that of the plain algorithm on the very sizes."""
    sizes = [int(x) for x in np.random.default_rng(7).integers(5_000, 50_000, 4_000)]
    rows = spark.createDataFrame([(i, i, n, "mine") for i, n in enumerate(sizes)], "doc_id long, key long, size long, shard string")
    loads, slots = Counter(), Counter()
    out = sharding.shard_by_bytes(rows, "key", "size", ["doc_id"], 40)
    assert out.columns == ["doc_id", "key", "size", "shard", "shard_", "slot"] and out.filter("shard <> 'mine'").isEmpty()
    for r in out.collect():
        loads[r.shard_] += r.size
        slots[r.shard_] += 1
    heap = [(0, j) for j in range(40)]
    for s in sorted(sizes, reverse=True):
        heapq.heapreplace(heap, (heap[0][0] + s, heap[0][1]))
    plain = max(heap)[0] - min(heap)[0]
    assert len(loads) == 40 and max(loads.values()) - min(loads.values()) <= 2 * plain


def test_numerals_are_no_letters(spark):
    assert language_id.letters("½ ¼ ² Ⅷ ①② 12_") == [] and language_id.letters("Ab½cd ÉTÉ x²") == ["ab", "cd", "été", "x"]
    rows = [(i, w, lang) for i in range(60) for lang, w in (("en", "the house and the tree"), ("es", "la casa y el árbol"))]
    docs = spark.createDataFrame([(2 * i + (lang == "es"), w, lang) for i, w, lang in rows] + [(900, "½ ¼ ²", "en"), (901, "Ⅷ ①②", "es"), (902, None, "en"), (903, "the tree ½", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predictions(docs).collect()}
    assert [got[i] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]


def _record(kind, n, block, length=None, case=str):
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{n}>"), ("WARC-Target-URI", "http://x/"), *([("Content-Length", length if length is not None else str(len(block)))] if length != "none" else [])]
    return "WARC/1.0\r\n".encode() + "".join(f"{case(k)}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_warc_fields_in_any_case_and_odd_lengths(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n<p>text</p>"
    records = [
        _record("response", "a", block), _record("response", "b", block, case=str.lower), _record("RESPONSE", "c", block, case=str.upper), _record("response", "d", block, length="many"),
        _record("response", "e", block, length="none"), _record("response", "f", block, length="-3"), _record("response", "g", block + b"\r\n\r\n" + block), _record("response", "h", block, length="99999"),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, records)) + b"rubbish")
    for name in ("plain.warc", "whole.warc.gz", "each.warc.gz"):
        read = warc.read_records(spark, str(tmp_path / name))
        intact = {next(v for k, v in r.headers.items() if k.lower() == "warc-record-id"): r.intact for r in read.collect()}
        assert intact == {f"<{c}>": c in "abcg" for c in "abcdefgh"}
        derived = warc.derivatives(warc.responses_from_records(read)).filter("warc_type = 'conversion'").collect()
        text = {r.refers_to: r.block for r in derived}
        assert set(text) == {f"<{c}>" for c in "abcdefgh"} and all(text[f"<{c}>"] == "text" for c in "abcdef")


def test_records_come_in_chunks_of_any_size():
    block = bytes(range(256)) * 3
    data = b"junk" + b"".join(_record("resource", i, block[: 40 * i]) for i in range(12))
    for size in (1, 7, 100, 10_000):
        got = list(warc.split_records(data[at : at + size] for at in range(0, len(data), size)))
        assert [g["block"] for g in got] == [block[: 40 * i] for i in range(12)] and all(g["intact"] for g in got)
    big = gzip.compress(np.random.default_rng(1).bytes(3_000_000)) + gzip.compress(b"x" * 9_000_000)
    assert b"".join(warc.inflated(big))[-9_000_000:] == b"x" * 9_000_000 and max(map(len, warc.inflated(big))) <= 1 << 20
    assert list(warc.inflated(b"")) == [] and list(warc.inflated(b"\x1f\x8bbroken")) == []


def test_huge_and_tiny_vectors_link(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, 1e308]), (7, [0.0, 0.0]), (8, None), (9, [float("inf"), 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9)}
    x = np.random.default_rng(2).normal(size=(500, 64)).astype(np.float32)
    plain = x.astype(np.float64)
    assert (embedding_index.unit(x) == plain / np.linalg.norm(plain, axis=1)[:, None]).all()


def test_decode_replaces_a_text_column(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = sentencepiece_sampling.sampler(model, 1, 1.0).v.model.encode("a text")
    out = sentencepiece_sampling.decode(spark.createDataFrame([(1, "mine", ids), (2, "mine", None)], "doc_id long, text string, ids array<int>"), model)
    assert {r.doc_id: r.text for r in out.select("doc_id", F.col("text")).collect()} == {1: "a text", 2: None}
