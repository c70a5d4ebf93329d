"""Toxicity: a convolutional text classifier over hashed words, trained in numpy, with thresholds calibrated by language.

Words (runs of letters and digits, A-Z lower-cased) are hashed whole and by two prefixes; convolutions of several widths and
max pooling over the whole text give one logit. The model is fitted on at most MAX_POSITIVE and MAX_NEGATIVE labelled
rows of at most MAX_BYTES, MAX_TOTAL together, chosen by a hash of the id. A part of them is held back from fitting, and on it the threshold of each language is set; the
language is found from the text's own function words, never from a column. A score is the logistic of logit minus threshold,
so 0.5 is the threshold in every language.

Cases: null and empty texts are scored like any other (as one padding token). Rows with a null id or without label are
scored but not learnt from; a row labelled more than once counts as toxic if any label says so. Without labels of both
kinds every score is 0. Texts are scored whole, in chunks of bounded size (a longer text is a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, fresh, mixed64, ship, stored
from .minhash import text_chunks
from .textcnn import TextCnn

MAX_POSITIVE, MAX_NEGATIVE = 1500, 3000
#: Longer texts are scored, but not learnt from.
MAX_BYTES = 1 << 17
#: Of all texts that are learnt from, together.
MAX_TOTAL = 64 << 20
CHUNK = 1 << 17
WORD_BUCKETS, PREFIX_BUCKETS = 1 << 16, 1 << 14
PREFIXES = (4, 6)
LEARN_STEPS, MIN_EPOCHS, MAX_EPOCHS = 24_000, 5, 25
#: Labelled texts that must hold a word or prefix for it to be learnt.
LEAST_TEXTS = 4
#: Labelled texts of either kind that a language needs for a threshold of its own.
MIN_OWN = 15
#: Function words by which a language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with be at by this from",
    "fr": "le les des du et un une en que qui est pour dans sur au aux par pas",
    "de": "der die das und ist den von zu mit sich auf für ein eine nicht auch",
    "es": "el los las del y que una por con no se su para es al como más",
}

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0xD6E8FEB86659FD93)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of each word in the word table and the prefix tables, and the number of words of each text."""
    gap = _BREAK[data]
    after = np.ones(len(data), bool)
    after[1:] = gap[:-1]
    after[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(after & ~gap)
    lengths = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return [np.empty(0, np.int64)] * (1 + len(PREFIXES)), lengths
    begun = np.zeros(len(data), np.int64)
    begun[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begun)
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE))
    values = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[place]
    values[gap] = 0
    found = [(mixed64(np.add.reduceat(values, starts)) % np.uint64(WORD_BUCKETS)).astype(np.int64)]
    for n in sorted(PREFIXES, reverse=True):
        values[place >= n] = 0
        found.insert(1, (mixed64(np.add.reduceat(values, starts) + np.uint64(n)) % np.uint64(PREFIX_BUCKETS)).astype(np.int64))
    return found, lengths


def _function_tables() -> np.ndarray:
    table = np.zeros((WORD_BUCKETS, len(FUNCTION_WORDS)), np.float32)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        data = np.frombuffer(words.encode(), np.uint8)
        table[tokens(data, np.array([0, len(data)]))[0][0], i] = 1
    return table


def languages(words: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Number of each text's language in FUNCTION_WORDS, or the number of languages if none is found."""
    ends = np.cumsum(lengths)
    counts = np.empty((len(lengths), table.shape[1]))
    for i in range(table.shape[1]):  # one language at a time, to hold one number a word
        sums = np.append(0, np.cumsum(table[:, i][words], dtype=np.float64))
        counts[:, i] = sums[ends] - sums[ends - lengths]
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), table.shape[1])


class ToxicityModel:
    def __init__(self) -> None:
        self.cnn: TextCnn | None = None
        self.functions = _function_tables()
        self.thresholds = np.zeros(len(FUNCTION_WORDS) + 1)

    def scores(self, ids: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        if self.cnn is None:
            return np.zeros(len(lengths))
        logits = self.cnn.logits(ids, lengths) - self.thresholds[languages(ids[0], lengths, self.functions)]
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))

    def fit(self, ids: list[np.ndarray], lengths: np.ndarray, labels: np.ndarray) -> None:
        """ids: by table the tokens of all texts, one behind the other."""
        if len(set(labels.tolist())) < 2:
            return
        back = np.random.default_rng(5).random(len(labels)) < 0.25
        learn, ends = np.flatnonzero(~back), np.cumsum(lengths)
        self.cnn = TextCnn((WORD_BUCKETS, *[PREFIX_BUCKETS] * len(PREFIXES)))
        epochs = int(np.clip(LEARN_STEPS // max(1, len(learn)), MIN_EPOCHS, MAX_EPOCHS))
        spoken = languages(ids[0], lengths, self.functions)[back]
        self.cnn.fit(ids, ends, labels, learn, epochs, least=LEAST_TEXTS)
        held = np.flatnonzero(back)
        logits = np.array([self.cnn.logits([x[ends[i] - lengths[i] : ends[i]] for x in ids], lengths[i : i + 1])[0] for i in held])
        y = labels[back]
        self.thresholds[:] = best_threshold(logits, y)
        for i in range(len(self.thresholds)):
            own = spoken == i
            if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= MIN_OWN:
                self.thresholds[i] = best_threshold(logits[own], y[own])


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """Between two neighbouring logits, where the F1 measure is highest; the middle of the best ones."""
    if len(set(labels.tolist())) < 2:
        return 0.0
    values = np.unique(logits)
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    ranked = np.sort(logits), np.sort(logits[labels == 1])
    above, true = (len(r) - np.searchsorted(r, cuts, "right") for r in ranked)
    measure = 2 * true / (above + len(ranked[1]))
    best = np.flatnonzero(measure >= measure.max() - 1e-12)
    return float(cuts[best].mean())


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fits on labelled rows whose id is not held out, MAX_POSITIVE and MAX_NEGATIVE of them and MAX_TOTAL bytes at most, each text of an
    id once."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    order = F.xxhash64(F.col(key), F.lit(17))
    sample = None
    for y, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)):
        part = known.where(F.col("_y") == y).orderBy(order, key).limit(most)
        sample = part if sample is None else sample.unionByName(part)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), content.alias("_text")).where(F.octet_length("_text") <= MAX_BYTES)
    rows = rows.join(F.broadcast(sample.withColumnRenamed(key, "_key")), "_key").select("_key", "_y", F.xxhash64("_text").alias("_h"), F.octet_length("_text").alias("_bytes"), "_text")
    # an id can have many rows: of these each text once, then as many rows of each label and bytes in all as are allowed
    own = Window.orderBy(F.xxhash64("_key", F.lit(17)), "_key", "_h")
    light = rows.select("_key", "_y", "_h", "_bytes").distinct()
    few = None
    for y, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)):
        part = light.where(F.col("_y") == y).orderBy(F.xxhash64("_key", F.lit(17)), "_key", "_h").limit(most)
        few = part if few is None else few.unionByName(part)
    few = few.withColumn("_upto", F.sum("_bytes").over(own.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_upto") <= MAX_TOTAL)
    chosen = stored(few.select("_key", "_h"), "sample")
    rows = rows.join(F.broadcast(chosen), ["_key", "_h"]).dropDuplicates(["_key", "_h"]).select("_key", "_y", "_h", "_text")
    kind = docs.schema[key].dataType.simpleString()
    names = [f"t{i}" for i in range(1 + len(PREFIXES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(3), CHUNK):
                ids, lengths = tokens(data, offsets)
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in ids]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(lengths)) for i in range(3)), *lists], names=["key", "y", "h", *names])

    found = rows.mapInArrow(run, f"key {kind}, y int, h long, " + ", ".join(f"{n} array<int>" for n in names)).toArrow()
    found = found.sort_by([("key", "ascending"), ("h", "ascending")])
    labels, columns = found.column("y").to_numpy(), [found.column(n).combine_chunks() for n in names]
    lengths = np.diff(columns[0].offsets.to_numpy()).astype(np.int64)
    ids = [c.flatten().to_numpy() for c in columns]
    del found, columns
    pa.default_memory_pool().release_unused()
    model = ToxicityModel()
    model.fit(ids, lengths, labels)
    return model


def with_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """docs plus the column `score`."""
    shared = Sent(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            scores = [shared.value.scores(*tokens(data, offsets)) for _, data, offsets in text_chunks(texts, CHUNK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    scored = with_scores(docs.select(key, text), train(docs, labels, key, text, label), text)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    (score,) = fresh(docs.columns, "toxicity")
    return with_scores(docs, train(docs, labels, key, text, label), text, score).where(F.col(score) < 0.5).select(*docs.columns)


ship(__name__)
