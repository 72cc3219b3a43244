"""Centroid clustering, repeated passages and token alignment against brute force and odd input."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from rosterline.llm import centroid_clustering, recompression, token_alignment
from rosterline.llm import queries as registered
from rosterline.llm.common import WRITTEN, table

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_kmeans(x, centroids, rounds):
    c = centroids.astype(object).copy()
    for n in range(rounds + 1):
        d = ((x.astype(object)[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if n < rounds:
            for j in range(len(c)):
                if (own == j).any():
                    c[j] = [int(s) // int((own == j).sum()) for s in x.astype(object)[own == j].sum(axis=0)]
    return own, d, c


@pytest.mark.parametrize("spread", [3, 1000, 1 << 26])
def test_elkan_is_plain_kmeans(spark, spread):
    """Few different points make ties everywhere; the greatest components fill 63 bits."""
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (300, 6)) if spread > 3 else rng.integers(0, spread, (300, 2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<long>").repartition(3)
    first = centroid_clustering.first_by_hash(rows, 8, 3)
    want_first = sorted(range(300), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:8]
    assert (first == x[want_first]).all()
    before = list(WRITTEN)
    out, centroids, work = centroid_clustering.elkan_kmeans(rows, first, 10)
    assert len(WRITTEN) == len(before) + 1
    own, d, c = plain_kmeans(x, first, 10)
    assert (centroids == c).all()
    got = {r["id"]: r for r in out.collect()}
    total = sum(int(d[i, own[i]]) for i in range(300))
    for i in range(300):
        inertia = sum(int(d[k, own[k]]) for k in range(300) if own[k] == own[i])
        assert (got[i].cluster, got[i].distance) == (own[i], d[i, own[i]])
        assert (got[i].cluster_inertia, got[i].inertia) == tuple(v if v < 2**63 else None for v in (inertia, total))
    assert work[0] == 300 * 8 and (spread != 1000 or sum(work[1:]) < 10 * 300 * 8)


def test_bounds_never_prune_a_nearer_or_equal_centroid():
    rng = np.random.default_rng(1)
    for _ in range(60):
        x, c = rng.integers(0, 6, (40, 2)), rng.integers(0, 6, (5, 2))
        cluster, upper, lower, _ = centroid_clustering.first_assignment(x, c)
        for _ in range(4):
            new = c + rng.integers(-1, 2, c.shape)
            cluster, upper, lower, _ = centroid_clustering.next_assignment(x, cluster, upper, lower, c, new)
            c = new
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
            assert (cluster == d.argmin(axis=1)).all()
            assert (upper**2 >= d[np.arange(40), cluster]).all() and (lower**2 <= d).all()


def test_vectors_that_are_kept(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5], 7), (1, [0.5, -0.5], 7), (2, None, 7), (3, [1.0], 7), (4, [1.0, None], 7), (5, [nan, 1.0], 7), (6, [inf, 1.0], 7), (7, [-1e300, 1e300], 7), (None, [0.0, -0.0001], 7), (8, [], 7)]
    got = centroid_clustering.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector int"), "vec_id", "embedding", 2, 1024)
    most = centroid_clustering.LARGEST
    assert sorted(((r["id"], r["vector"]) for r in got.collect()), key=str) == sorted([(1, [512, -512]), (1, [512, -512]), (7, [-most, most]), (None, [0, -1])], key=str)
    first = centroid_clustering.first_by_hash(got, 8, 3)
    out = centroid_clustering.elkan_kmeans(got, first, 2)[0].collect()
    assert len(first) == 4 and {r["id"] for r in out} == {1, 7, None} and len(out) == 4 and all(r.distance == 0 for r in out)
    none = centroid_clustering.elkan_kmeans(got.limit(0), centroid_clustering.first_by_hash(got.limit(0), 8, 3), 2)
    assert none[0].count() == 0 and none[2] == []


def removed(rows, window=13):
    """(doc_id, n_words, n_removed, digest of what stays) by a table of all windows."""
    first, out = {}, []
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    starts = lambda doc, words: range(len(words) - window + 1) if doc is not None else ()
    for doc, words in split:
        for i in starts(doc, words):
            x = tuple(words[i : i + window])
            first[x] = min(first.get(x, doc), doc)
    for doc, words in split:
        gone = {i + k for i in starts(doc, words) if first[tuple(words[i : i + window])] < doc for k in range(window)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    r = random.Random(seed)
    para = lambda n, k: [f"w{r.randrange(k)}" for _ in range(n)]
    pool = [para(r.randrange(5, 120), r.choice([2, 3, 30, 3000])) for _ in range(12)]
    rows = []
    for d in range(120):
        words = []
        for _ in range(r.randrange(6)):
            words += r.choice(pool)[r.randrange(8) :] if r.random() < 0.6 else para(r.randrange(1, 60), r.choice([2, 30, 3000]))
        rows.append((d * 7 % 120, (" " if r.random() < 0.8 else "\n\t\x0b ").join(words)))
    return rows


def test_repeats(spark, monkeypatch):
    rows = passages(5)
    rows += [(500, rows[3][1]), (501, rows[3][1]), (1, rows[5][1]), (None, rows[3][1]), (502, None), (503, ""), (504, "a " * 4000), (505, "a " * 3999 + "b"), (506, "x y " * 2000), (506, "x y " * 2000), (507, " x y " * 30)]
    rows += [(1, rows[9][1]), (508, "nbsp is a letter 　 here " * 5), (509, "q " + "nbsp is a letter 　 here " * 5)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, mark string, kept int").repartition(3)
    out = recompression.without_repeats(docs)
    got = lambda out: sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()), key=str)
    assert got(out) == removed(rows) and sum(r[2] > 0 for r in removed(rows)) > 40
    assert got(recompression.without_repeats(docs, window=5)) == removed(rows, 5)
    # Ids and anchors that are joined, not broadcast.
    monkeypatch.setattr(recompression, "BROADCAST_IDS", 0)
    monkeypatch.setattr(recompression, "FILTER_BITS", 0)
    assert got(recompression.without_repeats(docs)) == removed(rows)
    assert recompression.without_repeats(docs.limit(0)).count() == 0


def test_filter_holds_its_keys(spark):
    keys = np.random.default_rng(4).integers(-(2**63), 2**63, 160_000)
    found = recompression.filter_of(spark.createDataFrame([(int(k),) for k in keys[:80_000]], "key long").repartition(3))
    assert found.blocks > 1 and found.has(keys[:80_000].view(np.uint64)).all() and found.has(keys[80_000:].view(np.uint64)).mean() < 0.05
    none = recompression.filter_of(spark.createDataFrame([], "key long"))
    assert not none.has(keys.view(np.uint64)).any()


def test_slices_cover_every_window():
    for _, text in passages(9)[:40] + [(0, "word" * 700 + " " + "b " * 90), (0, " "), (0, "a b " + "long" * 900), (0, "x" * 5000)]:
        for size in (50, 200, 1000):
            old, recompression.SLICE = recompression.SLICE, size
            try:
                name = lambda w: w if size > len(text) or len(w) < size else b"\0" + recompression.xxhash.xxh3_128_hexdigest(w).encode()  # noqa: B023, E731
                words, seen, windows = list(map(name, text.encode().split())), {}, set()
                for first, part in recompression.sliced(text.encode(), 13):
                    part = part.split()
                    assert all(seen.setdefault(first + i, w) == w for i, w in enumerate(part))
                    windows |= {first + i for i in range(len(part) - 12)}
            finally:
                recompression.SLICE = old
            assert [seen[i] for i in range(len(seen))] == words and windows == set(range(max(0, len(words) - 12)))


def test_names_hang_on_the_word_alone():
    words = [b"a", b"b", b"ab", b"ba", b"aa", b"\xc2\xa0", b"a" * 300]
    one, begin, end = recompression.named(b"\t" + b" ".join(words) + b"\n", 2)
    two = recompression.named(b"  ".join(words[::-1] + [b"tail"]), 2)[0]
    assert (one == two[:-1][::-1]).all() and len(np.unique(one)) == 2 * len(words) and len(begin) == len(end) == len(words)
    assert len(recompression.named(b"", 2)[0]) == 0


def test_symbols_inside_a_passage_hang_on_the_passage_alone():
    r = np.random.default_rng(3)
    for alphabet in (1, 2, 5, 1000):
        own = r.integers(0, alphabet, 60).astype(np.uint64)
        seen = []
        for _ in range(5):
            left, right = r.integers(0, alphabet, r.integers(1, 30)).astype(np.uint64), r.integers(0, alphabet, r.integers(1, 30)).astype(np.uint64)
            line = np.r_[left, own, right]
            names = np.column_stack([line, line])
            starts = np.arange(len(left), len(left) + 48)
            key, place = recompression.anchors(names, starts, 13)
            seen.append((key.tolist(), (place - len(left)).tolist()))
            assert (place >= starts).all() and (place < starts + 13).all()
        assert all(s == seen[0] for s in seen)


def written_groups(a, b, bytes_a, bytes_b):
    """(links, groups) by walking both lists of tokens and a breadth-first search over the links."""
    spans = lambda ids, of: [(sum(map(len, of[:i])), sum(map(len, of[: i + 1]))) for i in range(len(ids))]
    sa, sb = spans(a, bytes_a), spans(b, bytes_b)
    links = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
    near = defaultdict(set)
    for i, j in links:
        near["a", i].add(("b", j)), near["b", j].add(("a", i))
    groups, seen = [], set()
    for i in range(len(a)):
        if ("a", i) not in seen:
            front, own = [("a", i)], {("a", i)}
            while front:
                for n in near[front.pop()] - own:
                    own.add(n), front.append(n)
            seen |= own
            groups.append("|".join(",".join(str(ids[k]) for s, k in sorted(own) if s == side) for side, ids in (("a", a), ("b", b))))
    return [(a[i], b[j]) for i, j in links], groups


def test_alignment(spark):
    from tokenizers import Tokenizer

    texts = ["hello there", None, "", "x", " two  spaces", "naïve façade 数据 🙂", "<|endoftext|> is text </s>", "a▁b loses bytes", "the the the", "the the the", "A" * 50, "tab\tand\nline", "ﬁ ligature"]
    docs = spark.createDataFrame([(i % 12, t, 5, "x") for i, t in enumerate(texts)] + [(None, "the end", 5, "x")], "doc_id long, text string, row int, pairs string").repartition(2)
    out, counts = token_alignment.corpus_alignment(docs, BPE, PIECES)
    aligner, slow = token_alignment.Aligner(BPE, PIECES), Tokenizer.from_file(BPE)
    slow.encode_special_tokens = True
    total, want = Counter(), []
    for doc, text in [(i % 12, t) for i, t in enumerate(texts)] + [(None, "the end")]:
        found = aligner.tokens(text)
        if found is None:
            want.append((doc, None))
            continue
        a, b = (x.tolist() for x in found)
        assert a == slow.encode(" " + text, add_special_tokens=False).ids
        links, groups = written_groups(a, b, [aligner.bytes_a[i] for i in a], [aligner.bytes_b[i] for i in b])
        total.update(links)
        want.append((doc, (len(a), len(b), groups, links)))
    best = defaultdict(int)
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    rows = []
    for doc, w in want:
        if w is None:
            rows.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = w
            rows.append((doc, a, b, len(groups), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()]
    assert sorted(got, key=str) == sorted(rows, key=str) and sum(r[1] == 0 for r in rows) == 3
    assert {(r.pair >> 32, r.pair & 0xFFFFFFFF): r["count"] for r in counts.collect()} == dict(total)
    assert token_alignment.corpus_alignment(docs.limit(0), BPE, PIECES)[0].count() == 0
    shown = {r.doc_id: r.groups for r in token_alignment.aligned(docs.filter("doc_id = 3"), BPE, PIECES, with_groups=True).collect()}
    assert shown == {3: ";".join(next(w for d, w in want if d == 3)[2])}


def test_components_by_union_find():
    r = np.random.default_rng(2)
    for _ in range(50):
        ends = [np.unique(np.r_[r.integers(1, 40, r.integers(1, 20)), 40]) for _ in range(2)]
        a, b = token_alignment.overlaps(*ends)
        own = token_alignment.components(a, b, len(ends[0]), len(ends[1]))
        cuts = np.intersect1d(*ends)
        want = np.r_[np.searchsorted(cuts, ends[0]), np.searchsorted(cuts, ends[1])]
        assert len(set(zip(own, want))) == len(set(own)) == len(set(want))


def test_registered_alignment_adds_up(spark, sf):
    """Over the whole table: every link counted once, sums of counts equal to the sum of squares."""
    out = registered.op13_token_alignment(spark, sf).collect()
    docs = table(spark, sf, "documents")
    pairs = Counter()
    aligner = token_alignment.Aligner(BPE, PIECES)
    for row in aligner.align([r.text for r in docs.collect()]):
        pairs.update(dict(zip(row[5].tolist(), row[6].tolist())))
    assert len(out) == docs.count() and sum(r.n_links for r in out) == sum(pairs.values())
    assert sum(r.count_sum for r in out) == sum(n * n for n in pairs.values()) and all(r.n_best <= r.n_links == max(0, r.n_a + r.n_b - r.n_groups) for r in out)
