"""Document quality by co-training: one classifier sees the text, the other the page's metadata.

The content view is a logistic regression over hashed words and character trigrams and a few
shares of character classes, fitted by L-BFGS; the metadata view is a small one, fitted by Newton
steps. Gradients and Hessians are added up by Spark over all rows; only vectors of a fixed
size reach the driver. Labelled rows teach both. In each round, unlabelled rows of which one
view is sure teach the other. Labelled rows of the calibration fold teach neither; on them each
view is calibrated by itself, and then the sum of the calibrated views.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import forget, free_name, materialize

#: Hash buckets of source and lang among the metadata.
SOURCES, LANGS = 32, 16
DENSE, METADATA = 14, SOURCES + LANGS + 3
#: Hashed features of the text: words, then trigrams; together they are numbered by 16 bits.
WORDS, HASHED = 49_152, 65_536
CONTENT = HASHED + DENSE
#: Labelled rows of the calibration fold that are fetched at most, and labels (16 bytes each) that are broadcast at most.
CALIBRATION_ROWS, BROADCAST_LABELS = 20_000, 2_000_000
_SLICE, _CHUNK = 1 << 20, 1 << 13
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
#: A class of characters for each code point below 2**16: letters by case, digits, blanks, common and other marks.
_LOWER, _UPPER, _OTHER_LETTER, _DIGIT, _SPACE, _LINE, _STOP, _MARK, _SYMBOL = range(9)
#: What a run of characters is made of to be one word: letters, digits, marks; blanks part words.
_RUN = np.array([1, 1, 1, 2, 0, 0, 3, 3, 3], np.uint8)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    def kind(c: str) -> int:
        if c.isalpha():
            return _UPPER if c.isupper() else _LOWER if c.islower() else _OTHER_LETTER
        if c.isdigit():
            return _DIGIT
        if c.isspace():
            return _LINE if c == "\n" else _SPACE
        return _STOP if c in ".,;:?'\"()-" else _MARK if c in "!|*#%$&@~^_=<>[]{}\\/+" else _SYMBOL

    return np.array([kind(chr(i)) if not 0xD800 <= i < 0xE000 else _SYMBOL for i in range(1 << 16)], np.uint8)


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a factor and of its inverse modulo 2**64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(_SLICE, f, np.uint64)), dtype=np.uint64) for f in (_FACTOR, _INVERSE))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def dense_features(text: str | None) -> list[float]:
    """Shares of character classes, and how much words and lines repeat; zeros for a null or empty text."""
    if not text:
        return [0.0] * DENSE
    codes = _codes(text)
    count = np.bincount(classes()[np.minimum(codes, 0xFFFF)], minlength=9).astype(float)
    letters, total, words, lines = count[:3].sum(), float(len(codes)), text.split(), text.split("\n")
    kinds, n = len(set(words)), max(1, len(words))
    return [
        count[_UPPER] / max(1.0, letters), letters / total, count[_DIGIT] / total, count[_SPACE] / total, count[_LINE] / total,
        count[_STOP] / total, count[_MARK] / total, count[_SYMBOL] / total, float(np.sqrt(count[_MARK] / total)),
        float(np.log1p(kinds) / np.log1p(n)), kinds / n, 1 - len(set(lines)) / len(lines), letters / n / 10, float(np.log1p(n)) / 10,
    ]


def hashed_features(text: str | None) -> np.ndarray:
    """Sorted numbers of the words (runs of letters, of digits or of marks) and trigrams that the lower-cased text holds."""
    found = np.zeros(HASHED, bool)
    power, inverse = powers()
    codes = _codes((text or "").lower())
    for at in range(0, len(codes), _SLICE):  # a word that a slice's end cuts counts as two
        part = codes[at : at + _SLICE]
        run, wide = _RUN[classes()[np.minimum(part, 0xFFFF)]], part.astype(np.uint64)
        ends = np.flatnonzero(np.append(run[1:] != run[:-1], True)) + 1
        starts = np.append(0, ends[:-1])
        sums = np.append(np.uint64(0), np.cumsum(wide * power[: len(part)], dtype=np.uint64))
        own = run[starts] > 0
        word = (sums[ends[own]] - sums[starts[own]]) * inverse[starts[own]]
        word = (word ^ (word >> np.uint64(31))) * _FACTOR
        found[((word >> np.uint64(32)) * np.uint64(WORDS)) >> np.uint64(32)] = True
        if len(part) > 2:
            gram = ((wide[:-2] * _FACTOR + wide[1:-1]) * _FACTOR + wide[2:]) * _FACTOR
            gram = (gram ^ (gram >> np.uint64(29))) * _FACTOR
            found[WORDS + (gram >> np.uint64(50)).astype(np.int64)] = True  # 14 bits
    return np.flatnonzero(found).astype(np.uint16)


def metadata_features(sources: list, langs: list, n_chars: list) -> np.ndarray:
    x = np.zeros((len(sources), METADATA))
    at = np.arange(len(sources))
    x[at, [zlib.crc32(str(s).encode()) % SOURCES for s in sources]] = 1
    x[at, [SOURCES + zlib.crc32(str(s).encode()) % LANGS for s in langs]] = 1
    size = np.log1p(np.maximum(0, np.array([0 if n is None or n != n else n for n in n_chars], float))) / 10
    x[:, SOURCES + LANGS :] = np.stack([size, size**2, size**3], axis=1)
    return x.astype(np.float32).astype(np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


@dataclass
class Content:
    """The content features of some documents: the hashed ones one after another, how many each has, the dense ones."""

    hashed: np.ndarray
    count: np.ndarray
    dense: np.ndarray
    scale: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.scale = 1 / np.sqrt(np.maximum(1, self.count))  # a document's hashed features have length 1

    def logits(self, weights: np.ndarray) -> np.ndarray:
        run = np.append(0.0, np.cumsum(weights[self.hashed]))
        ends = np.cumsum(self.count)
        return (run[ends] - run[ends - self.count]) * self.scale + self.dense @ weights[HASHED:CONTENT] + weights[CONTENT]

    def gradient(self, residuals: np.ndarray) -> np.ndarray:
        own = np.bincount(self.hashed, np.repeat(residuals * self.scale, self.count), HASHED)
        return np.concatenate([own, residuals @ self.dense, [residuals.sum()]])


def content_of(texts: list) -> Content:
    hashed = [hashed_features(t) for t in texts]
    dense = np.array([dense_features(t) for t in texts], np.float32).reshape(-1, DENSE)
    return Content(np.concatenate([*hashed, np.zeros(0, np.uint16)]), np.array([len(x) for x in hashed], np.int64), dense.astype(np.float64))


@dataclass
class Model:
    """Weights of either view (the last is the bias), and (factor, bias) that calibrate each view and their sum."""

    content: np.ndarray
    metadata: np.ndarray
    prior: float = 0.0
    calibration: list[tuple[float, float]] = field(default_factory=lambda: [(1.0, 0.0)] * 3)

    def logits(self, content: Content, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return content.logits(self.content), metadata @ self.metadata[:-1] + self.metadata[-1]

    def views(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The calibrated logits of either view."""
        return tuple(np.clip(f * np.clip(x, -15, 15) + c, -15, 15) for x, (f, c) in zip((a, b), self.calibration, strict=False))

    def combined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The logit of views that are independent given the class: their sum without the prior that both hold, calibrated."""
        factor, bias = self.calibration[2]
        return factor * (a + b - self.prior) + bias


def features(docs: DataFrame) -> DataFrame:
    """doc_id, hashed (gaps between numbers, 16 bits each), dense and metadata of docs(doc_id, text, lang, source, n_chars)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                texts = batch.column("text").to_pylist()
                hashed = [np.diff(hashed_features(t), prepend=np.uint16(0)).astype("<u2").tobytes() for t in texts]
                dense = [np.array(dense_features(t), "<f4").tobytes() for t in texts]
                meta = metadata_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))).astype("<f4")
                columns = [batch.column("doc_id"), *(pa.array(x, pa.binary()) for x in (hashed, dense, [m.tobytes() for m in meta]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hashed", "dense", "metadata"])

    source = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("double"))
    return source.mapInArrow(extract, f"doc_id {kind}, hashed binary, dense binary, metadata binary")


def _read(batch: pa.RecordBatch) -> tuple[Content, np.ndarray]:
    """The features of a batch of rows that features() made."""
    packed = batch.column("hashed").to_pylist()
    count = np.array([len(x) // 2 for x in packed], np.int64)
    gaps = np.frombuffer(b"".join(packed), "<u2").astype(np.int64)
    run = np.append(0, np.cumsum(gaps))
    ends = np.cumsum(count)
    numbers = run[1:] - np.repeat(run[ends - count], count)
    dense, meta = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<f4").astype(np.float64).reshape(batch.num_rows, n) for c, n in (("dense", DENSE), ("metadata", METADATA)))
    return Content(numbers, count, dense), meta


def _summed(rows: DataFrame, columns: list[str], make) -> np.ndarray | None:  # noqa: ANN001
    """The sum over all rows of the vectors that make() returns for each batch.

    Every task sends its own sum in chunks; chunks are added in two steps, so that none adds more than the root of
    the number of tasks.
    """
    kind = "chunk int, part int, v binary"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                found = make(big.slice(at, 1000))
                total = found if total is None else total + found
        if total is not None:
            cuts = range(0, len(total), _CHUNK)
            parts = [TaskContext.get().partitionId()] * len(cuts)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(cuts)), pa.int32()), "part": pa.array(parts, pa.int32()), "v": pa.array([total[c : c + _CHUNK].tobytes() for c in cuts])})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, v in zip(batch.column("chunk").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.frombuffer(v)
                total[c] = total[c] + x if c in total else x
        if total:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(total), pa.int32()), "part": pa.array([0] * len(total), pa.int32()), "v": pa.array([x.tobytes() for x in total.values()])})

    sums = rows.select(*columns).mapInArrow(own, kind)
    ways = int(rows.rdd.getNumPartitions() ** 0.5) if len(columns) else 1
    if ways > 8:
        sums = sums.repartition("chunk", F.pmod("part", F.lit(ways))).mapInArrow(added, kind)
    found: dict[int, np.ndarray] = {}
    for r in sums.repartition("chunk").mapInArrow(added, kind).collect():
        found[r.chunk] = np.frombuffer(r.v)
    return np.concatenate([found[c] for c in sorted(found)]) if found else None


def _moments(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the weighted log-likelihood as one vector."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = _sigmoid(x @ weights)
    return np.concatenate([x.T @ (w * (y - p)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])


def _newton(weights: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    d = len(weights)
    gradient, hessian = sums[:d], sums[d : d + d * d].reshape(d, d)
    penalty = np.full(d, ridge)
    penalty[-1] = 1e-6
    step = np.linalg.solve(hessian + np.diag(penalty), gradient - penalty * weights)
    return weights + step * min(1.0, 8 / max(1e-9, np.abs(step).max()))


class Lbfgs:
    """Minimises a function of which each call tells value and gradient at the point asked for last."""

    def __init__(self, start: np.ndarray, memory: int = 8) -> None:
        self.memory, self.pairs = memory, []
        self.at, self.value, self.gradient, self.asked, self.step = start, None, None, start, 1.0
        self.direction = np.zeros_like(start)

    def forget_value(self) -> None:
        """The function has changed: begin again where we are."""
        self.pairs, self.value, self.asked = [], None, self.at

    def tell(self, value: float, gradient: np.ndarray) -> None:
        if self.value is not None:
            if value > self.value + 1e-4 * self.step * float(self.gradient @ self.direction) and self.step > 1e-4:
                self.step /= 4
                self.asked = self.at + self.step * self.direction
                return
            s, y = self.asked - self.at, gradient - self.gradient
            if (sy := float(s @ y)) > 1e-12:
                self.pairs = [*self.pairs[-self.memory + 1 :], (s, y, sy)]
        self.at, self.value, self.gradient = self.asked, value, gradient
        q, kept = gradient.copy(), []
        for s, y, sy in reversed(self.pairs):
            kept.append(a := float(s @ q) / sy)
            q -= a * y
        q *= self.pairs[-1][2] / float(self.pairs[-1][1] @ self.pairs[-1][1]) if self.pairs else 1 / max(1.0, float(np.linalg.norm(gradient)))
        for (s, y, sy), a in zip(self.pairs, reversed(kept), strict=True):
            q += (a - float(y @ q) / sy) * s
        self.direction, self.step = -q, 1.0
        self.asked = self.at + self.direction


def cotrain(
    rows: DataFrame, rounds: int = 2, passes: int = 10, more: int = 5, sure: float = 0.97, pseudo: float = 0.3, ridge: float = 0.5, calibration_rows: int = CALIBRATION_ROWS
) -> Model | None:
    """A model from rows(hashed, dense, metadata, y, fold): y 1, 0 or null, fold 0 for calibration. None without both labels.

    passes over all rows fit the labelled ones, `more` each of the rounds. A pseudo-label counts as the given part of a
    label. sure is the probability from which a view's opinion on an unlabelled row is taken over by the other view.
    """
    known = {r[0]: r[1] for r in rows.filter("y is not null and fold <> 0").groupBy("y").count().collect()}
    if set(known) != {0, 1}:
        return None
    prior = _logit(known[1] / (known[0] + known[1]))
    search = Lbfgs(np.append(np.zeros(CONTENT), prior))
    metadata, teachers = np.append(np.zeros(METADATA), prior), None
    columns = ["hashed", "dense", "metadata", "y", "fold"]
    for n in range(rounds + 1):
        for _ in range(more if n else passes):

            def sums(batch: pa.RecordBatch, w: np.ndarray = search.asked, m: np.ndarray = metadata, t: Model | None = teachers) -> np.ndarray:
                content, meta = _read(batch)
                y, fold = batch.column("y").to_numpy(zero_copy_only=False).astype(float), batch.column("fold").to_numpy(zero_copy_only=False)
                use = ~np.isnan(y) & (fold != 0)
                labels, weights = [np.nan_to_num(y)] * 2, [use.astype(float)] * 2
                if t is not None:
                    for view, logit in enumerate(reversed(t.logits(content, meta))):  # each is taught by the other
                        p = _sigmoid(logit)
                        taught = np.isnan(y) & ((p >= sure) | (p <= 1 - sure))
                        labels[view], weights[view] = np.where(taught, p > 0.5, labels[view]).astype(float), np.where(taught, pseudo, weights[view])
                z = content.logits(w)
                loss = float((weights[0] * (np.logaddexp(0, z) - labels[0] * z)).sum())
                return np.concatenate([[loss], content.gradient(weights[0] * (_sigmoid(z) - labels[0])), _moments(meta, labels[1], weights[1], m)])

            found = _summed(rows, columns, sums)
            shrink = np.append(np.full(CONTENT, ridge), 1e-6)
            w = search.asked
            search.tell(found[0] + 0.5 * float(shrink @ w**2), found[1 : CONTENT + 2] + shrink * w)
            metadata = _newton(metadata, found[CONTENT + 2 :], ridge)
        teachers = Model(search.at, metadata, prior)
        search.forget_value()
    return calibrated(teachers, rows.filter("y is not null and fold = 0"), calibration_rows)


def calibrated(model: Model, held: DataFrame, most: int) -> Model:
    """model with the logits of each view, then of their sum, fitted to the labels of about `most` of the held-out rows, chosen by hash.

    The logits are taken in the tasks; three numbers of a row reach the driver.
    """

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = model.logits(*_read(batch))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column("y").cast(pa.float64())], names=["a", "b", "y"])

    share = min(1.0, most / max(1, held.count()))
    chosen = held.filter(F.pmod(F.xxhash64("hashed", "metadata"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    found = chosen.select("hashed", "dense", "metadata", "y").mapInArrow(logits, "a double, b double, y double").toArrow()
    a, b, y = (found.column(c).to_numpy() for c in ("a", "b", "y"))
    if len(set(y.tolist())) < 2:
        return model

    def platt(logit: np.ndarray) -> tuple[float, float]:
        w = np.array([1.0, 0.0])
        for _ in range(12):
            w = _newton(w, _moments(np.clip(logit, -15, 15)[:, None], y, np.ones(len(y)), w), 1.0)
        return max(0.0, float(w[0])), float(w[1])

    model = Model(model.content, model.metadata, model.prior, [platt(a), platt(b), (1.0, 0.0)])
    a, b = model.views(a, b)
    return Model(model.content, model.metadata, model.prior, [*model.calibration[:2], platt(a + b - model.prior)])


def fold_of(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(1)).cast("int")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all docs and labels(doc_id, quality); a document's labels are averaged, null ones ignored."""
    truth = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    truth = materialize(truth)
    near = F.broadcast(truth) if truth.count() <= BROADCAST_LABELS else truth
    rows = features(docs).join(near, F.col("doc_id") == F.col("_id"), "left").select("hashed", "dense", "metadata", "y", fold_of(F.col("doc_id")).alias("fold"))
    rows = materialize(rows)
    model = cotrain(rows)
    forget(rows, truth)
    return model


def quality_of(model: Model | None) -> Column:
    """struct(content, metadata, score): either view's calibrated probability and the combined one, of text, source, lang, n_chars."""

    @F.pandas_udf("content double, metadata double, score double")
    def judge(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, source, lang, n_chars in parts:
            found = [np.full((3, len(text)), 0.5)] if model is None or not len(text) else []
            for at in range(0, len(text) if model is not None else 0, 500):
                part = [x.iloc[at : at + 500].tolist() for x in (text, source, lang, n_chars)]
                a, b = model.views(*model.logits(content_of(part[0]), metadata_features(*part[1:])))
                found.append(_sigmoid(np.stack([a, b, model.combined(a, b)])))
            yield pd.DataFrame(np.concatenate(found, axis=1).T, columns=["content", "metadata", "score"])

    return judge("text", "source", "lang", F.col("n_chars").cast("double"))


def scores(docs: DataFrame, labels: DataFrame, least: float = 0.5, name: str = "_quality") -> DataFrame:
    """docs with a last column: struct(content, metadata, score, accepted), for every document.

    It is called name, or name with underscores behind it if docs has such a column. A score of at
    least `least` is accepted. Null and empty texts are scored like others by their (zero)
    features; null metadata count as a value of their own. Without labels of both kinds every score is 0.5 and all is
    accepted. Repeated rows are judged alike. An empty table gives an empty one.
    """
    name = free_name(name, docs.columns)
    out = docs.withColumn(name, quality_of(train(docs, labels)))
    return out.withColumn(name, F.col(name).withField("accepted", F.col(f"{name}.score") >= least))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of good quality, with their own columns (of any name); nulls and empty tables as in scores()."""
    scored = scores(docs, labels)
    name = scored.columns[-1]
    return scored.filter(F.col(f"{name}.accepted")).drop(name)
