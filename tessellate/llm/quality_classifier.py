"""A quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words give two streams: the word itself (its letters in lower case) and its shape (runs of capitals, small letters and
digits as one sign each, other signs as they are). Unigrams and bigrams of the first, and up to trigrams of the second,
are hashed into 2^18 buckets, as is the number of words by powers of two. A stream counts by its share of the text.
"""

from __future__ import annotations

import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellate.llm._common import arrow_map, table
from tessellate.llm.language_id import held_out

BUCKETS = 1 << 18
MOST_ROWS = 12_000
EPOCHS = 3
WORDS_HELD = 200_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-3
SCALE = 8.0


def _sign(x: str) -> str:
    return "A" if x.isupper() else "a" if x.isalpha() else "0" if x.isdigit() else x


def word_hashes(word: bytes) -> tuple[int, int]:
    """32-bit hashes of a word's letters and of its shape."""
    text = word.decode()
    if text.isalpha() and text.islower():
        return zlib.crc32(word), zlib.crc32(b"a", 1)
    shape = "".join(k for k, _ in itertools.groupby(map(_sign, text)))
    letters = "".join(filter(str.isalpha, text)).lower()
    return zlib.crc32(letters.encode()), zlib.crc32(shape.encode(), 1)


class Hashes(dict):
    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = found = word_hashes(word)
        return found


_HASHES = Hashes()


def _hashes_of(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(_HASHES.__getitem__, words)), np.uint64).reshape(-1, 2)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64)


def occurrences(text: str | None) -> list[np.ndarray]:
    """The buckets of a whole text's n-grams, one array per stream, and of its length."""
    words = (text or "").encode().split()
    h = _hashes_of(words)
    word, shape, m = h[:, 0], h[:, 1], np.uint64(0x100000001B3)
    pair = shape[:-1] * m + shape[1:]
    return [
        _mixed(np.array([len(words).bit_length()], np.uint64), 1),
        _mixed(word, 2),
        _mixed(word[:-1] * m + word[1:], 3),
        _mixed((word[:-1] == word[1:]).astype(np.uint64), 4),
        _mixed(shape, 5),
        _mixed(pair, 6),
        _mixed(pair[:-1] * m + shape[2:], 7),
    ]


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their values: SCALE times their share in their stream."""
    streams = [s for s in occurrences(text) if len(s)]
    at, where = np.unique(np.concatenate(streams), return_inverse=True)
    weights = np.concatenate([np.full(len(s), SCALE / len(s)) for s in streams])
    return at, np.bincount(where, weights)


def ftrl(rows: list[tuple[float, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-Proximal (McMahan et al., KDD 2013), one row at a time; the last one is the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for label, at, values in rows:
            at, values = np.append(at, BUCKETS), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1)).astype(np.float32)


def score(text: str | None, weights: np.ndarray) -> float:
    """The probability of a whole text: a sparse dot product, summed over the occurrences of its n-grams."""
    total = float(weights[BUCKETS]) + sum(SCALE * float(weights[s].mean(dtype=np.float64)) for s in occurrences(text) if len(s))
    return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS
) -> np.ndarray:
    """Weights from the labelled rows, or from ``most_rows`` of them in the order of a hash of their id if there are more.

    - rows with a null id or label, or without a document, are left out; without any rows all weights are zero, and each score is 0.5.
    - null and empty texts: learned from as texts of no words. Very long texts: read whole, as their distinct buckets.
    - repeated rows: each is learned from. Ties of the hash: by id, then label. Further columns aren't read.
    """
    picked = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_of"), F.col(label_col).cast("double").alias("_y"))
        .orderBy(F.xxhash64("_of"), "_of", "_y")
        .limit(most_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    chosen = texts.join(F.broadcast(picked), F.col("_id") == F.col("_of"))  # most_rows rows of two numbers

    def run(rows: dict) -> dict:
        found = [sparse(t) for t in rows["_text"]]
        return {
            "u": rows["_u"], "y": rows["_y"], "at": [f[0].astype(np.int32) for f in found], "x": [f[1].astype(np.float32) for f in found],
        }

    vectors = arrow_map(
        chosen, [F.xxhash64("_of").alias("_u"), "_y", "_text"], "u long, y double, at array<int>, x array<float>", run
    )

    def fit(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() if i < 2 else [x.values.to_numpy(zero_copy_only=False) for x in c] for i, c in enumerate(b.columns)))]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        made = ftrl([r[1:] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()])], ["weights"])

    made = vectors.repartition(1).mapInArrow(fit, "weights binary").first()
    return np.frombuffer(bytes(made.weights), np.float32) if made else np.zeros(BUCKETS + 1, np.float32)


_HELD: dict[str, np.ndarray] = {}


def weights_of(key: str, broadcast) -> np.ndarray:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = broadcast.value
    return _HELD[key]


def classify(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``df``: id, score (0 to 1), predicted (1 if the score is ``threshold`` or more, else 0).

    - null texts: as empty ones, which score by the bias and their length alone. Very long texts: scored whole.
    - null ids, repeated rows and ties: each row is scored. Empty table: no rows. Further columns are neither read nor returned.
    """
    key, broadcast = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(weights)

    def run(rows: dict) -> dict:
        own = weights_of(key, broadcast)
        return {"id": rows["_id"], "score": [score(t, own) for t in rows["_text"]]}

    columns = [F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")]
    scored = arrow_map(df, columns, "id long, score double", run)
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = train(docs, labels.filter(~held_out("doc_id", 5, 0)))
    return classify(docs, weights).select("doc_id", F.coalesce(held_out("doc_id", 5, 0), F.lit(True)).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLE: dict[str, str] = {}
