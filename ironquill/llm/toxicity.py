"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of how its words are spelled: the probability of a
letter after up to four before it, absolutely discounted. What the discount
frees goes to a shared lower-order Kneser-Ney model, whose continuation counts
cover every text of the corpus, labelled or not, so that rare expressions do
not count for a class that happens to have seen them once. A text's score compares its log-likelihoods
under both, divided by its words: once over all of them, less the median word,
which takes out what the text's language adds to each; and once over what
single words say beyond doubt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ironquill.llm.shared import cut, whole

ORDER = 5
DISCOUNT = 0.75
#: The models are fitted on at most so many labelled rows of each class, taken by a hash of the id.
FIT_ROWS = 8192
#: Of these, one fifth sets the scale of the score and is not counted.
FOLDS = 5
#: At most so many letter sequences are kept, those that tell the classes apart most.
MODEL_ENTRIES = 2_000_000
THRESHOLD = 0.7
#: Log-likelihood ratio from which a word speaks for itself.
CLEAR = 2.0
_START, _END = "\x02", "\x03"
_WORDS = regex.compile(r"\p{L}+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words whose scores a task remembers, and rows whose words it holds at once.
_REMEMBERED, _ROWS = 300_000, 128


@dataclass
class ToxicityModel:
    """Differences of log-likelihoods by letter sequence and, for letters not seen after it, by context."""

    grams: np.ndarray
    gram_gain: np.ndarray
    contexts: np.ndarray
    context_gain: np.ndarray
    slopes: tuple[float, float] = (1.0, 1.0)
    offset: float = 0.0

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        text = "".join(f"{_START}{w}{_END}" for w in words)
        symbols = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        starts = np.flatnonzero(symbols == ord(_START))
        place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
        keys = _keys(symbols, place)
        gain = _look(self.grams, self.gram_gain, keys)
        missed = np.isnan(gain)
        gain[missed] = np.nan_to_num(_look(self.contexts, self.context_gain, keys[missed] - symbols[missed]))
        gain[place == 0] = 0.0
        return np.add.reduceat(gain, starts)

    def probability(self, ratio: float, clear: float) -> float:
        at = self.slopes[0] * ratio + self.slopes[1] * clear + self.offset
        return float(1.0 / (1.0 + np.exp(-np.clip(at, -500, 500))))


def features(gains: np.ndarray) -> tuple[float, float]:
    """Mean log-likelihood ratio of the words less its median, and the mean of what exceeds CLEAR; 0 without words."""
    if not len(gains):
        return 0.0, 0.0
    return float(gains.mean() - np.median(gains)), float(np.maximum(gains - CLEAR, 0).mean())


def _keys(symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of each symbol with up to ORDER - 1 before it in its word; minus the symbol, that of its context."""
    out = symbols.copy()
    weight = np.uint64(1)
    for back in range(1, ORDER):
        weight = np.uint64((int(weight) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
        there = np.flatnonzero(place >= back)
        out[there] += symbols[there - back] * weight
    return out


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), np.nan)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.nan)


def _table(rows: list, context: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of (sequence, value) rows."""
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    texts = [r[0] + ("\x00" if context else "") for r in rows]
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.append(0, ends[:-1])
    place = np.arange(len(symbols)) - np.repeat(starts, ends - starts)
    keys = _keys(symbols, place)[ends - 1]
    values = np.array([r[1] for r in rows], np.float32)
    order = np.argsort(keys)
    return keys[order], values[order]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``_id, _text, _toxic, _fold``: up to ``rows`` documents of each class whose id's crc32 is not 1 modulo 3."""
    usable = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
              .filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    # As many of the larger class as a balanced fit needs, never more than the bound.
    picked = [usable.filter(F.col("_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    ids = cut(picked[0].unionByName(picked[1]), "sample-ids")
    joined = docs.select(F.col("doc_id"), whole("text").alias("_text")).join(F.broadcast(ids), "doc_id")  # 2 * rows ids at most
    return joined.select(F.col("doc_id").alias("_id"), "_text", "_toxic", (F.crc32(F.concat(F.lit("fold:"), F.col("doc_id").cast("string"))) % FOLDS).alias("_fold"))


def _words_of(text: str) -> Column:
    return F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))


def _sequences(word: str) -> Column:
    marked = F.concat(F.lit(_START), F.col(word), F.lit(_END))
    return F.explode(F.transform(F.sequence(F.lit(2), F.length(marked)),
                                 lambda e: F.substring(marked, F.greatest(e - ORDER + 1, F.lit(1)), F.least(e, F.lit(ORDER)))))


def letter_counts(sample: DataFrame) -> DataFrame:
    """``g, n1, n0``: sequences of a letter with up to four before it in its word, and their counts by class."""
    words = (sample.select(_words_of("_text").alias("w"), "_toxic")
             .groupBy("w").agg(F.sum("_toxic").alias("n1"), F.sum(1 - F.col("_toxic")).alias("n0")))
    return words.select(_sequences("w").alias("g"), "n1", "n0").groupBy("g").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def letter_types(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``g``: the distinct sequences, as in ``letter_counts``, of every whole text, labelled or not."""
    return docs.select(_words_of(text_col).alias("w")).distinct().select(_sequences("w").alias("g")).distinct()


def kneser_ney(counts: DataFrame, types: DataFrame | None = None, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """Log-likelihood differences ``g, gain`` of the sequences and ``h, gain`` of their contexts.

    The shared lower-order model counts the sequences of ``counts`` and those
    of ``types`` (``g``), such as the whole corpus has.
    A letter that neither class has seen after a context has the same shared
    probability under both; what differs is the weight that each gives it.
    """
    d = discount
    counts = cut(counts, "counts")
    known = counts.select("g") if types is None else cut(counts.select("g").unionByName(types).distinct(), "types")
    # Distinct sequences of each length; a shorter one continues each that ends in it.
    levels = {order: known.filter(F.length("g") == order)}
    continued = {}
    for k in range(order, 1, -1):
        continued[k - 1] = cut(levels[k].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c")), "continued")
        levels[k - 1] = continued[k - 1].select("g").unionByName(known.filter(F.length("g") == k - 1)).distinct()
    total = continued[1].agg(F.sum("c")).first()[0] or 1
    shared = continued[1].select("g", (F.col("c") / float(total)).alias("p"))
    below = [shared]
    for k in range(2, order):
        level = continued[k].withColumn("h", F.expr(f"substring(g, 1, {k - 1})"))
        sums = level.groupBy("h").agg(F.sum("c").alias("n"), F.count("*").alias("t"))
        lower = below[-1].select(F.col("g").alias("low"), F.col("p").alias("q"))
        below.append(cut(level.join(sums, "h").join(lower, F.expr("substring(g, 2)") == F.col("low"))
                         .select("g", ((F.greatest(F.col("c") - d, F.lit(0.0)) + d * F.col("t") * F.col("q")) / F.col("n")).alias("p")), "shared"))
    shared = below[0]
    for part in below[1:]:
        shared = shared.unionByName(part)
    top = counts.withColumn("h", F.expr("substring(g, 1, length(g) - 1)"))
    sums = cut(top.groupBy("h").agg(*[f(f"n{y}").alias(f"{name}{y}") for y in (1, 0) for f, name in (
        (F.sum, "m"), (lambda c: F.count(F.when(F.col(c) > 0, 1)), "t"))]), "contexts")
    freed = {y: F.when(F.col(f"m{y}") > 0, d * F.col(f"t{y}") / F.col(f"m{y}")).otherwise(1.0) for y in (1, 0)}
    seen = {y: F.when(F.col(f"m{y}") > 0, F.greatest(F.col(f"n{y}") - d, F.lit(0.0)) / F.col(f"m{y}")).otherwise(0.0) for y in (1, 0)}
    joined = top.join(sums, "h").join(shared.withColumnRenamed("g", "low"), F.expr("substring(g, 2)") == F.col("low"))
    gain = F.log(seen[1] + freed[1] * F.col("p")) - F.log(seen[0] + freed[0] * F.col("p"))
    return joined.select("g", gain.alias("gain")), sums.select("h", (F.log(freed[1]) - F.log(freed[0])).alias("gain"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, entries: int = MODEL_ENTRIES) -> ToxicityModel:
    """Models from the labelled rows that may be learned from; what they back off to is counted over all of ``docs``.

    Without rows of both classes every text scores 0.5.
    """
    sample = cut(labelled_sample(docs, labels, rows), "sample")
    grams, contexts = kneser_ney(letter_counts(sample.filter("_fold <> 0")), letter_types(docs))
    strongest = F.abs("gain").desc()
    gram_table, context_table = (_table(x.orderBy(strongest, x.columns[0]).limit(entries).collect(), c) if x.count() > entries
                                 else _table(x.collect(), c) for x, c in ((cut(grams, "grams"), False), (cut(contexts, "gains"), True)))
    model = ToxicityModel(*gram_table, *context_table)
    held = scored(sample.filter("_fold = 0").select("_id", "_toxic", "_text"), model, "_text").select("_ratio", "_clear", "_toxic").toPandas()
    model.slopes, model.offset = _logistic(held[["_ratio", "_clear"]].to_numpy(float), held["_toxic"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[tuple[float, float], float]:
    """Slopes and offset by Newton's method, both classes weighing the same."""
    if not len(x) or y.min() == y.max():
        return (1.0, 1.0), 0.0
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    rows, beta = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -50, 50)))
        rise = rows.T @ (weight * (y - p)) - ridge * beta * [1, 1, 0]
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag([ridge, ridge, 1e-9])
        step = np.clip(np.linalg.solve(bend, rise), -4, 4)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0] / scale[0]), float(beta[1] / scale[1])), float(beta[2])


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_ratio``, ``_clear`` (see ``features``) and ``_score``.

    A text without words has zeros for both. Whole texts are read; words are scored
    once per task, as far as it remembers them.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(
        (model.grams, model.gram_gain, model.contexts, model.context_gain, model.slopes, model.offset))
    added = ("_ratio", "_clear", "_score")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = ToxicityModel(*shipped.value), {}
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            texts = [_WORDS.findall((x.as_py() or "").lower()) for x in batch.column(position)]
            new = list(set().union(*texts).difference(known))
            if len(known) + len(new) > _REMEMBERED:
                known.clear()
                new = list(set().union(*texts))
            if new:
                known.update(zip(new, model.words(new).tolist(), strict=True))
            found = [features(np.fromiter(map(known.__getitem__, ws), np.float64, len(ws))) for ws in texts]
            values = [(r, c, model.probability(r, c)) for r, c in found]
            columns = [pa.array([v[i] for v in values], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema([*batch.schema, *((c, pa.float64()) for c in added)]))

    return docs.mapInArrow(run, schema)
