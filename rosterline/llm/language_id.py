"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is its words (runs of letters, lower-cased); a model predicts each letter and the end
of a word from up to order - 1 symbols before it in that word. N-grams are counted over all
training texts: tasks count the n-grams of their distinct words, Spark adds the counts up
and derives discounts, continuation counts and probabilities with joins. What reaches the
driver is the finished model: the probability and the back-off weight of every n-gram that was
counted, in the order of their whole 64-bit hashes, so an unseen n-gram meets no other; what is
broadcast grows with the n-grams.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import WRITTEN, forget_unread, free_name, materialize

WORD = re.compile(r"[^\W\d_]+")  # letters, and numerals such as ½ or Ⅷ
UNKNOWN = "und"
START, END = 1, 2
_BASE, _ORDER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xBF58476D1CE4E5B9)


def letters(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    words = WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [run for w in words for run in "".join(c if c.isalpha() else " " for c in w).split()]


def keys_of(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(symbols, place in the word, key of the n-gram that ends at each symbol for n = 1..order).

    Each word is its letters between a start and an end symbol. A key is meaningful where the
    place is at least n - 1.
    """
    flat = np.frombuffer(("\x01" + "\x02\x01".join(words) + "\x02").encode("utf-32-le"), np.uint32)
    at = np.arange(len(flat))
    place = at - np.maximum.accumulate(np.where(flat == START, at, 0))
    rolled, power, keys = np.zeros(len(flat), np.uint64), np.uint64(1), []
    codes = flat.astype(np.uint64)
    for n in range(1, order + 1):
        rolled = rolled.copy()
        rolled[n - 1 :] += codes[: len(codes) - n + 1] * power
        power = (power[None] * _BASE)[0]
        key = (rolled + np.uint64(n)) * _ORDER
        key = (key ^ (key >> np.uint64(31))) * _MIX
        keys.append(key ^ (key >> np.uint64(29)))
    return flat, place, keys


def _counts(words: Counter, lang: str, order: int) -> Iterator[pa.RecordBatch]:
    flat, place, keys = keys_of(list(words), order)
    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.diff(np.append(np.flatnonzero(flat == START), len(flat))))
    for n in range(1, order + 1):
        sel = np.flatnonzero((place >= max(1, n - 1)))
        gram, first, back = np.unique(keys[n - 1][sel], return_index=True, return_inverse=True)
        at = sel[first]
        context = keys[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        shorter = keys[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang] * len(gram)),
                "n": pa.array(np.full(len(gram), n, np.int32)),
                "gram": pa.array(gram.astype(np.int64)),
                "context": pa.array(context.astype(np.int64)),
                "shorter": pa.array(shorter.astype(np.int64)),
                "opens": pa.array(place[at] == n - 1),
                "c": pa.array(np.bincount(back, weights=weight[sel]).astype(np.int64)),
            }
        )


def count_grams(texts: DataFrame, order: int, words_at_once: int = 100_000) -> DataFrame:
    """(lang, n, gram, context, shorter, opens, c): counts of n-grams over all of texts(lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for big in batches:
            for at in range(0, big.num_rows, 500):
                part = big.slice(at, 500)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = seen.setdefault(lang, Counter())
                    words.update(letters(text))
                    if len(words) > words_at_once:
                        yield from _counts(words, lang, order)
                        words.clear()
        for lang, words in seen.items():
            if words:
                yield from _counts(words, lang, order)

    schema = "lang string, n int, gram long, context long, shorter long, opens boolean, c long"
    return (
        texts.mapInArrow(count, schema)
        .groupBy("lang", "n", "gram")
        .agg(F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.first("opens").alias("opens"), F.sum("c").alias("c"))
    )


def kneser_ney(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(lang, key, logp) of n-grams and (lang, key, logb) of contexts, from count_grams().

    Orders below the highest use continuation counts (different symbols before the n-gram),
    except for n-grams that open a word, before which there is none. Each probability is
    interpolated with that of the next shorter n-gram, down to the uniform one.
    """
    left = counts.filter("n > 1").groupBy("lang", F.col("shorter").alias("gram")).agg(F.count("*").alias("before"))
    grams = counts.join(left, ["lang", "gram"], "left").withColumn(
        "c", F.when((F.col("n") == order) | F.col("opens"), F.col("c")).otherwise(F.coalesce("before", F.lit(1)))
    )
    grams = materialize(grams.select("lang", "n", "gram", "context", "shorter", "c"))
    ones, twos = (F.sum(F.when(F.col("c") == k, 1.0).otherwise(0.0)) for k in (1, 2))
    discount = grams.groupBy("lang", "n").agg(F.try_divide(ones, ones + 2 * twos).alias("raw"))
    discount = discount.select("lang", "n", F.when((F.col("raw") > 0) & (F.col("raw") < 1), F.col("raw")).otherwise(0.75).alias("d"))
    contexts = (
        grams.groupBy("lang", "n", "context")
        .agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        .join(discount, ["lang", "n"])
        .withColumn("b", F.col("d") * F.col("types") / F.col("total"))
    )
    own = grams.join(contexts.select("lang", "n", "context", "total", "d", "b"), ["lang", "n", "context"])
    own = materialize(own.withColumn("own", (F.col("c") - F.col("d")) / F.col("total")))
    size = contexts.filter("n = 1").select("lang", (1 / (F.col("types") + 1)).alias("p0"))
    below = own.filter("n = 1").join(size, "lang").select("lang", "gram", (F.col("own") + F.col("b") * F.col("p0")).alias("p"))
    levels = [below]
    for n in range(2, order + 1):
        shorter = below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("q"))
        # an opening bigram's shorter n-gram is an ordinary letter; only the start symbol itself has no probability
        level = own.filter(F.col("n") == n).join(shorter, ["lang", "shorter"], "left")
        below = level.select("lang", "gram", (F.col("own") + F.col("b") * F.coalesce("q", F.lit(0.0))).alias("p"))
        levels.append(below)
    probabilities = levels[0]
    for level in levels[1:]:
        probabilities = probabilities.union(level)
    base = contexts.filter("n = 1").join(size, "lang").select("lang", F.lit(0).cast("long").alias("key"), F.log(F.col("b") * F.col("p0")).alias("logb"))
    backs = contexts.filter("n > 1").select("lang", F.col("context").alias("key"), F.log("b").alias("logb"))
    return probabilities.select("lang", F.col("gram").alias("key"), F.log("p").alias("logp")), backs.union(base)


@dataclass
class Model:
    """Sorted hashes of n-grams; a row of logp and logb has a column for each language.

    starts holds, for each value of the first index_bits bits, where hashes with it begin; it only
    speeds up the search.
    """

    langs: list[str]
    order: int
    index_bits: int
    slots: np.ndarray
    logp: np.ndarray
    logb: np.ndarray
    base: np.ndarray
    starts: np.ndarray | None = field(default=None, repr=False)
    known: dict[str, int] = field(default_factory=dict, repr=False)
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32), repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"starts": None, "known": {}, "sums": np.zeros((0, 0), np.float32)}

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for those that the model lacks."""
        shift = np.uint64(64 - self.index_bits)
        if self.starts is None:
            self.starts = np.searchsorted(self.slots >> shift, np.arange((1 << self.index_bits) + 1, dtype=np.uint64))
        first = (keys >> shift).astype(np.int64)
        row, end = self.starts[first], self.starts[first + 1]
        found, open_ = np.full(len(keys), -1), np.flatnonzero(row < end)
        while len(open_):
            here = self.slots[row[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = row[open_[hit]]
            open_ = open_[here < keys[open_]]
            row[open_] += 1
            open_ = open_[row[open_] < end[open_]]
        return found

    def word_sums(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        flat, place, keys = keys_of(words, self.order)
        lp = np.tile(self.base, (len(flat), 1))
        before = None
        for n, key in enumerate(keys, 1):
            row = self.rows_of(key)
            row[place < n - 1] = -1
            p = self.logp[row]  # the last row is that of the unseen
            if before is not None:
                back = self.logb[np.append(-1, before[:-1])]
                back[place < n - 1] = 0
                lp = lp + back
            lp = np.where(np.isnan(p), lp, p)
            before = row
        starts = np.flatnonzero(flat == START)
        lp[starts] = 0
        return np.add.reduceat(lp, starts, axis=0)

    def doc_sums(self, docs: list[list[str]], most_known: int = 250_000) -> np.ndarray:
        """Log-likelihood of each list of words in each language; words seen before are looked up."""
        if len(self.known) > most_known or self.sums.shape[1] != len(self.langs):
            self.known, self.sums = {}, np.zeros((0, len(self.langs)), np.float32)
        known = self.known
        new = list({w for words in docs for w in words if w not in known})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            self.sums = np.concatenate([self.sums, self.word_sums(part)])
        flat = np.fromiter((known[w] for words in docs for w in words), np.int64)
        ends = np.cumsum([len(words) for words in docs])
        total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.sums[flat], axis=0, dtype=np.float64)])
        return total[ends] - total[np.append(0, ends[:-1])]


def train(docs: DataFrame, order: int = 4) -> Model:
    """A model of every non-null lang of docs(lang, text), from all of its texts."""
    before = len(WRITTEN)
    counts = materialize(count_grams(docs.select("lang", "text").filter("lang is not null and text is not null"), order))
    tables = kneser_ney(counts, order)
    base = tables[1].filter("key = 0").toPandas()
    langs = sorted(base["lang"])
    place = F.array_position(F.array(*(F.lit(x) for x in langs)), F.col("lang")).cast("int") - 1 if langs else F.lit(0)
    p, b = (
        t.filter("key <> 0").select(place.alias("at"), "key", F.col(c).cast("float").alias("value")).toArrow() for t, c in zip(tables, ("logp", "logb"), strict=True)
    )
    keys = [t.column("key").to_numpy().view(np.uint64) for t in (p, b)]
    slots = np.unique(np.concatenate(keys))
    logp, logb = np.full((len(slots) + 1, len(langs)), np.nan, np.float32), np.zeros((len(slots) + 1, len(langs)), np.float32)
    for frame, key, matrix in ((p, keys[0], logp), (b, keys[1], logb)):
        matrix[np.searchsorted(slots, key), frame.column("at").to_numpy()] = frame.column("value").to_numpy()
    forget_unread(docs, WRITTEN[before:])
    bases = np.array([base.set_index("lang").loc[x, "logb"] for x in langs], np.float32)
    return Model(langs, order, int(np.clip(len(slots).bit_length(), 8, 28)), slots, logp, logb, bases)


def _row(docs: DataFrame, model: Model) -> Column:
    """struct(lang_pred, score, entropy, letters) of the column text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, entropy double, symbols long")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in parts:
            done = []
            for at in range(0, len(texts), 300):
                words = [letters(t) if t is not None else [] for t in texts.iloc[at : at + 300]]
                symbols = np.array([sum(map(len, w)) + len(w) for w in words], np.int64)
                if not own.langs:
                    done.append(pd.DataFrame({"lang_pred": [UNKNOWN] * len(words), "score": 0.0, "entropy": np.nan, "symbols": symbols}))
                    continue
                entropy = -own.doc_sums(words) / np.maximum(symbols, 1)[:, None]
                best = entropy.argmin(axis=1)
                least = entropy[np.arange(len(words)), best]
                odds = np.exp(-(entropy - least[:, None]) * np.minimum(symbols, 100)[:, None]).sum(axis=1)
                none = symbols == 0
                done.append(
                    pd.DataFrame(
                        {
                            "lang_pred": np.where(none, UNKNOWN, np.array(own.langs, dtype=object)[best]),
                            "score": np.where(none, 0.0, 1 / odds),
                            "entropy": np.where(none, np.nan, least),
                            "symbols": symbols,
                        }
                    )
                )
            yield pd.concat(done) if done else pd.DataFrame({"lang_pred": [], "score": [], "entropy": [], "symbols": []})

    return judge("text")


def held_out(doc_id: Column) -> Column:
    """The third of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, order: int = 4, quantile: float = 0.999, slack: float = 1.0, name: str = "_lang", with_text: bool = True) -> DataFrame:
    """docs with a last column: struct(lang_pred, score, entropy, symbols, held_out, accepted) of each text.

    It is called name, or name with underscores behind it if docs has such a column; all columns of docs
    are kept (without with_text: but for text). lang_pred is the language with the lowest cross-entropy per symbol; und
    for a text that is null or has no letter (and for every text if nothing can be learned). score is its odds
    against all languages, from at most 100 symbols' worth of evidence. A text is accepted if its
    cross-entropy is at most the given quantile of the training documents of that language
    plus slack (nats a symbol), and 8 times as much slack over the root of the symbols of a short one;
    where a language has no such documents, those of all languages give the quantile. Equal texts are judged
    alike, whatever their length; an empty table gives an empty one. The scored rows are a written table.
    """
    name = free_name(name, docs.columns)
    model = train(docs.filter(~held_out(F.col("doc_id"))), order)
    scored = docs.withColumn(name, _row(docs, model))
    scored = materialize(scored if with_text else scored.drop("text"))
    pred, entropy, symbols = (F.col(f"{name}.{x}") for x in ("lang_pred", "entropy", "symbols"))
    own = scored.filter(~held_out(F.col("doc_id")) & (F.col("lang") == pred) & (symbols >= 50))
    limits = own.rollup("lang").agg(F.percentile_approx(entropy, quantile, 10000).alias("limit"))
    known = {r[0]: r[1] for r in limits.collect()}  # a row for each language, and one for all
    limit = F.lit(known.pop(None, None)).cast("double")
    for lang, most in known.items():
        limit = F.when(pred == lang, F.lit(most)).otherwise(limit)
    allowed = limit + slack + 8 * slack / F.sqrt(F.greatest(symbols, F.lit(1)))
    accepted = (pred != UNKNOWN) & F.coalesce(entropy <= allowed, F.lit(True))
    return scored.withColumn(name, F.col(name).withField("held_out", held_out(F.col("doc_id"))).withField("accepted", accepted))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, accepted of every document; odd rows as in identify()."""
    found = identify(docs.select("doc_id", "lang", "text"), with_text=False)
    return found.select("doc_id", "_lang.held_out", "_lang.lang_pred", "_lang.score", "_lang.entropy", "_lang.accepted")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with their own columns (of any name); null and letterless texts go."""
    found = identify(docs)
    name = found.columns[-1]
    return found.filter(F.col(f"{name}.accepted")).drop(name)
