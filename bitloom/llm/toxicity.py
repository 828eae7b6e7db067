"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

Features are the character n-grams, edges marked, of a text's distinct lower-cased words; a feature is 1 where the text has it.
Its scale is the log ratio of its smoothed rates in toxic and other texts. N-grams whose ratio could be chance (a z-score
under `min_z`) have no feature. A logistic regression with an L2 penalty on the scaled features gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.tables import columns, forget, map_rows, release, table, written

WORD = re.compile(r"[^\W\d_]+")
#: The classifier is fitted on at most so many labelled rows, those with the smallest hashes of their ids.
TRAIN_ROWS = 5_000
#: Words whose features a worker keeps; it bounds memory, not results.
KEPT_WORDS = 300_000
#: Features of rows that are summed together when fitting.
ENTRIES = 1 << 19


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # the product of scale and coefficient, by n-gram
    bias: float
    sizes: tuple[int, ...]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def ngrams(word: str, sizes: tuple[int, ...]) -> set[str]:
    w = f"^{word}$"
    return {w[k : k + n] for n in sizes for k in range(len(w) - n + 1)}


def log_ratios(toxic: np.ndarray, other: np.ndarray, totals: tuple[float, float], smooth: float, min_z: float) -> tuple[np.ndarray, np.ndarray]:
    """The log ratio of each n-gram's smoothed rates, and whether it is more than chance; from its numbers in toxic and other texts, and the numbers of words."""
    a, b = toxic + smooth, other + smooth
    ratio = np.log(a / (totals[0] + smooth)) - np.log(b / (totals[1] + smooth))
    return ratio, np.abs(ratio) >= min_z * np.sqrt(1 / a + 1 / b)


def solve(features: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float = 0.02, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Coefficients of the scaled features and the bias of a logistic regression, by accelerated gradient steps. features: the numbers of each row's features."""
    n, m = len(features), len(scale)
    blocks, start = [], 0
    sizes = np.array([len(f) for f in features])
    while start < n:  # rows together, about ENTRIES features
        end = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), ENTRIES)) + start)
        at = np.flatnonzero(sizes[start:end]) + start
        blocks.append((at, sizes[at], np.concatenate([np.zeros(0, np.int32), *features[start:end]])))
        start = end
    features.clear()

    def times(w: np.ndarray) -> np.ndarray:
        out, w = np.zeros(n), w * scale
        for at, size, which in blocks:
            if len(at):
                out[at] = np.add.reduceat(w[which], np.cumsum(size) - size)
        return out

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros(m)
        for at, size, which in blocks:
            out += np.bincount(which, np.repeat(g[at], size), m)
        return out * scale

    # the step bound is a power iteration's largest singular value
    x = np.ones(m)
    for _ in range(20):
        x = back(times(x))
        x /= max(np.linalg.norm(x), 1e-12)
    step = 1 / (0.25 * (float(np.sum(times(x) ** 2)) + n) / n + penalty)
    w, bias = np.zeros(m), float(np.log(labels.mean() / (1 - labels.mean())))
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(times(ahead) + ahead_bias, -40, 40))) - labels) / n
        new = ahead - step * (back(g) + penalty / max(m, 1) * ahead)
        new_bias = ahead_bias - step * g.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, float(bias)


class Scorer:
    def __init__(self, model: Model):
        names = sorted(model.weights)
        self.bias, self.sizes, self.known = model.bias, model.sizes, {}
        self.number, self.weights = {g: k for k, g in enumerate(names)}, [model.weights[g] for g in names]

    def __call__(self, text: str) -> float:
        number, known, has = self.number, self.known, set()
        for w in words_of(text):
            grams = known.get(w)
            if grams is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                grams = known[w] = tuple({number[g] for g in ngrams(w, self.sizes) if g in number})
            has.update(grams)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(map(self.weights.__getitem__, sorted(has))), -500, 500))))


def fold(key: int | None) -> int:
    return zlib.crc32(str(key).encode()) % 5


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """The rows to fit on: key, label and the text's distinct words, sorted."""
    marked = columns(labels, key=f"{id_col}:long", label=f"{label_col}:int").where("key IS NOT NULL AND label IN (0, 1)")
    fitting = marked.where(F.crc32(F.col("key").cast("string").cast("binary")) % 5 != 0)
    chosen = fitting.orderBy(F.xxhash64("key"), "key", "label").limit(max_rows)  # its size is bounded, so it may be broadcast
    texts = columns(docs, key=f"{id_col}:long", text=text_col).join(F.broadcast(chosen), "key")

    def make():
        def each(key: int, text: str | None, label: int) -> Iterator[tuple]:
            yield key, label, sorted(words_of(text or ""))

        return each

    return map_rows(texts.select("key", "text", "label"), make, "key long, label int, words array<string>")


def _counted(rows: DataFrame, sizes: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """How many texts of each label have each word, and each n-gram: as often as words of texts have it."""
    words = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
    whole = F.concat(F.lit("^"), "word", F.lit("$"))
    of_size = lambda n: F.when(F.char_length(whole) >= n, F.transform(F.sequence(F.lit(1), F.char_length(whole) - n + 1), lambda k: F.substring(whole, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = words.select("toxic", "other", F.explode(F.array_distinct(F.concat(*map(of_size, sizes)))).alias("gram"))
    return words, grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = TRAIN_ROWS, sizes: tuple[int, ...] = (3, 4, 5), smooth: float = 0.5, min_z: float = 3.0, penalty: float = 0.02, rounds: int = 400) -> Model:
    """Fits on labelled rows outside the held-out fold (crc32 of the id as text, modulo 5, is 0): at most max_rows, by the hash of the id.

    Rows with a null id or label are left out; of an id with several labels or texts, each pair is a row. Without both labels the model is a constant.
    N-grams are counted on the executors; the driver gets those with a ratio beyond chance, and the numbers of the ones that each row has.
    """
    rows = written(_sample(docs, labels, id_col, text_col, label_col, max_rows), "sample")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n_toxic in (0, n):
        forget(rows)
        return Model({}, float(np.log((n_toxic + smooth) / (n - n_toxic + smooth))), sizes)
    words, grams = _counted(rows, sizes)
    totals = tuple(words.agg(F.sum("toxic"), F.sum("other")).first())
    a, b = F.col("toxic") + smooth, F.col("other") + smooth
    ratio = F.log(a / (totals[0] + smooth)) - F.log(b / (totals[1] + smooth))
    telling = grams.where(F.abs(ratio) >= (min_z - 1e-6) * F.sqrt(1 / a + 1 / b)).toPandas().sort_values("gram")
    log_ratio, sure = log_ratios(telling["toxic"].to_numpy(float), telling["other"].to_numpy(float), totals, smooth, min_z)
    names, scale = telling["gram"].to_numpy()[sure], log_ratio[sure]
    shared = docs.sparkSession.sparkContext.broadcast({g: k for k, g in enumerate(names)})  # bounded by the rows fitted on

    def make():
        number, known = shared.value, {}

        def each(key: int, label: int, own: list[str]) -> Iterator[tuple]:
            has: set[int] = set()
            for w in own:
                if w not in known:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[w] = [number[g] for g in ngrams(w, sizes) if g in number]
                has.update(known[w])
            yield key, label, np.array(sorted(has), "<i4").tobytes()

        return each

    found = sorted(tuple(r) for r in map_rows(rows, make, "key long, label int, has binary").collect())
    forget(rows)
    w, bias = solve([np.frombuffer(has, "<i4") for *_, has in found], np.array([y for _, y, _ in found], float), scale, penalty, rounds)
    return Model({g: float(a) for g, a in zip(names, w * scale, strict=True) if abs(a) > 1e-9}, bias, sizes)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score. A null text counts as empty and gets the model's bias; repeated rows give repeated rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the rows it was fitted on

    def make():
        score = Scorer(shared.value)

        def each(key: int | None, text: str | None) -> Iterator[tuple]:
            yield key, score(text or "")

        return each

    return map_rows(columns(docs, key=f"{id_col}:long", text=text_col), make, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the limit, in all their columns. docs: text and any others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        score = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([score(text.as_py() or "") < limit for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
