"""Language identification of spans.

A word's script narrows down its languages; each of those scores it by the character trigrams and whole words counted in
labelled documents; and a Viterbi pass over the words, with a penalty for each switch, labels spans.

Counts are taken over a sample of about ``per_language`` documents of each language, and hashed into 2^16 buckets. A model
takes a quarter of a MB a language, so it is the number of languages that bounds it, and not the corpus.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellate.llm._common import arrow_filter, arrow_map, cut, table

BUCKETS = 1 << 16
PER_LANGUAGE = 2_000
SWITCH = 8.0
FLOOR = -4.0
LEAST_SHARE = 0.01
MOST_BROADCAST = 100_000
WORDS_HELD, BYTES_HELD = 200_000, 64 << 20

#: The Unicode ranges of scripts, as (script, first, last).
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
NAMES = (*dict.fromkeys(s for s, _, _ in SCRIPTS), "other")


def letters_of(word: str) -> str:
    """A word's letters in lower case."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


@functools.lru_cache(maxsize=4096)
def script_of(letter: str) -> str:
    return next((s for s, a, b in SCRIPTS if a <= ord(letter) <= b), "other")


def word_script(letters: str) -> int:
    """The number in NAMES of the script of most of a word's letters, the first one on ties."""
    if max(letters) < "\u0250":
        return 0
    found = [script_of(x) for x in letters]
    return NAMES.index(max(dict.fromkeys(found), key=found.count))


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): the hashed trigrams of each word with a sign before and after it, and those of whole words last.

    starts: where each word's trigrams begin; the whole words follow all trigrams, one for each word.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join([f"\2{w}\3" for w in words]).encode("utf-32-le"), np.uint32)
    mixed = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
    inside = np.ones(len(points), bool)
    ends = (lengths + 2).cumsum()
    inside[ends - 1] = inside[ends - 2] = False
    whole = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))
    return np.concatenate([mixed[inside[:-2]] >> 16, whole >> 16]).astype(np.int64), np.cumsum(lengths) - lengths


def count_rows(rows: dict) -> dict:
    """(lang, bucket, n) over a slice of documents; bucket -1-s counts the letters in script s."""
    sums: dict[str, np.ndarray] = {}
    for lang, text in zip(rows["_lang"], rows["_text"]):
        words = [x for t in (text or "").encode().lower().split() if (x := letters_of(t.decode()))]
        if words:
            own = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
            own += np.bincount(buckets(words)[0], minlength=len(own))
            for w in words:
                own[BUCKETS + word_script(w)] += len(w)
    at = {k: np.flatnonzero(v) for k, v in sums.items()}
    return {
        "lang": [k for k, v in at.items() for _ in range(len(v))],
        "bucket": [int(b) if b < BUCKETS else BUCKETS - 1 - int(b) for v in at.values() for b in v],
        "n": [int(x) for k, v in at.items() for x in sums[k][v]],
    }


class Model:
    """Log probabilities of the buckets by language, and the languages that use each script."""

    def __init__(self, counts: Iterable[tuple[str, list[int], list[int]]]):
        """counts: (language, buckets, how often each), a language at a time."""
        made: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, at, n in counts:
            own, scripts = made.setdefault(lang, (np.zeros(BUCKETS, np.float32), np.zeros(len(NAMES))))
            at, n = np.array(at, np.int64), np.array(n, np.float64)
            np.add.at(own, at[at >= 0], n[at >= 0])
            np.add.at(scripts, -1 - at[at < 0], n[at < 0])
        self.langs = sorted(made)
        seen, self.logs = np.zeros(BUCKETS, bool), np.empty((BUCKETS, len(made)), np.float32)
        for own, _ in made.values():
            seen |= own > 0
        used = max(1, int(seen.sum()))
        for i, x in enumerate(self.langs):
            own = made[x][0].astype(np.float64)
            self.logs[:, i] = np.log((own + 0.1) / (own.sum() + 0.1 * used))
        scripts = np.stack([made[x][1] for x in self.langs], 1) if made else np.zeros((len(NAMES), 0))
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.uses = share >= LEAST_SHARE
        self.common = self.langs[int(scripts.sum(axis=0).argmax())] if self.langs else None

    def used_by(self, words: list[str]) -> np.ndarray:
        """Whether each language uses the script of each word."""
        return self.uses[[word_script(w) for w in words]]

    def scores(self, words: list[str]) -> np.ndarray:
        """Each language's score of each word, 0 for the best one and FLOOR at worst; zeros where none uses the script."""
        at, starts = buckets(words)
        found = np.add.reduceat(self.logs[at[: -len(words)]], starts, axis=0) + self.logs[at[-len(words) :]]
        uses = self.used_by(words)
        found = np.where(uses, found, -np.inf)
        best = found.max(axis=1, keepdims=True)
        return np.where(np.isfinite(best), np.maximum(found - np.where(np.isfinite(best), best, 0), FLOOR), 0.0)


class Words(dict):
    """Rows of scores, numbers of letters and whether any language uses the script, by word; the last row is for what has no letters.

    Holds at most WORDS_HELD words, or fewer where BYTES_HELD are full of their scores.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.most = max(2, min(WORDS_HELD, BYTES_HELD // (4 * max(1, len(model.langs)))))
        self.scores = np.zeros((self.most + 1, len(model.langs)), np.float32)
        self.letters = np.zeros(self.most + 1, np.int64)
        self.known = np.zeros(self.most + 1, bool)
        self.used = 0

    def learn(self, words: list[bytes]) -> None:
        new: dict[str, int] = {}
        for word in words:
            letters = letters_of(word.decode())
            self[word] = new.setdefault(letters, self.used + len(new)) if letters else self.most
        if new:
            rows = slice(self.used, self.used + len(new))
            self.scores[rows] = self.model.scores(list(new))
            self.letters[rows] = list(map(len, new))
            self.known[rows] = self.model.used_by(list(new)).any(axis=1)
            self.used += len(new)

    def rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, letters, known) of words, by parts that fit with all that is held."""
        parts = []
        for i in range(0, max(1, len(words)), self.most // 2):
            own = words[i : i + self.most // 2]
            new = {w for w in own if w not in self}
            if len(self) + len(new) > self.most:
                self.clear()
                self.used, new = 0, set(own)
            self.learn(list(new))
            at = np.fromiter(map(self.__getitem__, own), np.int64, len(own))
            parts.append((self.scores[at], self.letters[at], self.known[at]))
        return tuple(np.concatenate(p) for p in zip(*parts))


def viterbi(scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The labels of the best path, each switch costing ``penalty``; ties keep the label, or take the first.

    The path stays on the overall best label when no stretch gains more by other labels than one switch costs. That is
    the largest sum of a stretch of gains, which takes no loop; only texts that exceed it go word by word.
    """
    best = int(scores.sum(axis=0).argmax())
    gain = (scores.max(axis=1) - scores[:, best]).cumsum() if scores.shape[1] > 1 else np.zeros(len(scores))
    if not len(scores) or scores.shape[1] == 1 or gain[-1] <= penalty:
        return np.full(len(scores), best)
    other = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
    run = np.concatenate([[0], other.cumsum()])
    if (run - np.minimum.accumulate(run)).max() <= penalty:
        return np.full(len(scores), best)
    n, k = scores.shape
    came = np.empty((n, k), np.int8 if k < 128 else np.int32)
    value, own = [0.0] * k, list(range(k))
    for i, row in enumerate(scores.tolist()):
        top = max(own, key=value.__getitem__)
        floor = value[top] - penalty
        came[i] = [j if value[j] >= floor else top for j in own]
        value = [(v if v >= floor else floor) + s for v, s in zip(value, row)]
    path = np.empty(n, np.int64)
    label = max(own, key=value.__getitem__)
    for i in range(n - 1, -1, -1):
        path[i] = label
        label = int(came[i, label])
    return path


def label(text: str | None, words: Words) -> tuple[str, float, float, str]:
    """(lang_pred, score, lang_share, spans) of one whole text; spans as lang:start:end in code points."""
    text, model = text or "", words.model
    scores, letters, known = words.rows(text.encode().lower().split())
    total = int(letters.sum())
    if not total or not model.langs:
        return "und", 0.0, 0.0, ""
    if not known.any():
        return model.common or "und", 0.0, 0.0, f"{model.common}:0:{len(text)}"
    path = viterbi(scores)
    by = np.bincount(path, letters, len(model.langs))
    pred = int(by.argmax())
    share = float(by[pred] / total)
    sums = scores[path == pred].sum(axis=0)
    margin = float(sums[pred] - np.delete(sums, pred).max()) if len(sums) > 1 else -FLOOR
    turns = np.flatnonzero(np.diff(path)) + 1
    starts = [0]
    if len(turns):
        found = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        starts += [found[t] for t in turns.tolist()]
    ends = [*starts[1:], len(text)]
    spans = ",".join(f"{model.langs[path[t]]}:{a}:{b}" for t, a, b in zip([0, *turns.tolist()], starts, ends))
    return model.langs[pred], share * float(-np.expm1(-max(margin, 0.0) / -FLOOR)), share, spans


def fit(df: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the labelled rows of ``df``: about ``per_language`` documents of each language, by a hash of the id."""
    labelled = df.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("_u")
    )
    rates = cut(labelled.groupBy(F.col("_lang").alias("_of")).agg(F.count(F.lit(1)).alias("_n")))
    # A join that shuffles would send all texts of a language to one task, so rates are broadcast while they are few.
    few = rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    picked = labelled.join(F.broadcast(rates) if few else rates, F.col("_lang") == F.col("_of")).filter(F.col("_u") * F.col("_n") < per_language * (1 << 30))
    counted = arrow_map(picked, ["_lang", "_text"], "lang string, bucket int, n long", count_rows)
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # A language at a time comes to the driver: BUCKETS counts at most.
    each = sums.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n"))
    return Model(tuple(r) for r in each.toLocalIterator())


_HELD: dict[str, Words] = {}


def words_of(key: str, broadcast) -> Words:
    """A worker's cache of words for the model last broadcast."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Words(broadcast.value)
    return _HELD[key]


def identify(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``df``: id, lang_pred, score, lang_share, spans.

    lang_pred is the language of most letters, ``und`` without letters. lang_share is its share of the letters, and score is
    that share times how clearly its words are told from the next language (0 to 1).

    - null and empty texts, or texts without letters: ``und``, 0, 0 and no spans.
    - letters in scripts that no learned language uses: the commonest learned language, with score 0.
    - very long texts: labelled whole, as many words at a time as the cache holds.
    - null ids, repeated rows and ties: each row is labelled; of tied languages the first by name.
    - empty table: no rows. Further columns are neither read nor returned.
    """
    key, broadcast = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict) -> dict:
        words = words_of(key, broadcast)
        found = list(zip(*(label(t, words) for t in rows["_text"]))) or [()] * 4
        return {"id": rows["_id"]} | dict(zip(("lang_pred", "score", "lang_share", "spans"), found))

    schema = "id long, lang_pred string, score double, lang_share double, spans string"
    columns = [F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")]
    return arrow_map(df, columns, schema, run).withColumnRenamed("id", id_col)


def held_out(id_col: str, of: int, remainder: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == remainder


def learn_and_identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``identify`` by a model of the rows that aren't held out (crc32 of the id as text, modulo 4, is not 2)."""
    out = held_out(id_col, 4, 2)
    model = fit(df.filter(~F.coalesce(out, F.lit(True))), text_col, lang_col, id_col)
    return identify(df, model, id_col, text_col).withColumn("held_out", F.coalesce(out, F.lit(True)))


def keep_identified(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_share: float = 0.5
) -> DataFrame:
    """The rows of ``df``, all columns kept, with a language that holds ``least_share`` of the letters or more.

    - ``und`` goes (null and empty texts too), and so do texts in scripts that no learned language uses.
    - very long texts, null ids, repeated rows and ties: as in ``identify``. Without any learned language, all rows go.
    - empty table: no rows. Further columns of any type and name come back as they are.
    """
    out = held_out(id_col, 4, 2)
    model = fit(df.filter(~F.coalesce(out, F.lit(True))), text_col, lang_col, id_col)
    key, broadcast = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(model)

    def keeps(texts: list) -> list[bool]:
        words = words_of(key, broadcast)
        return [(found := label(t, words))[0] != "und" and found[2] >= least_share for t in texts]

    return arrow_filter(df, text_col, keeps)


def op8_language_id(spark, sf_dir):
    return learn_and_identify(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "lang_share", "spans"
    )


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
