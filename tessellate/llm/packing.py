"""Best-fit packing of token sequences after a Martello-Toth reduction.

Pieces of documents matter to the packing by their lengths alone, of which there are ``capacity`` at most. So the plan is
made over the counts of lengths: as patterns (lengths that share a sequence) with how often each is used. The reduction
fixes sets of items that dominate every other way to use their largest item; best-fit decreasing packs what it leaves.
Pieces then find their place by their rank among the pieces of their length, which salted windows give.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellate.llm._common import arrow_map, cut, shuffle_partitions, table

CAPACITY = 2048
END = b"\0\0\0\0"


#: ASCII marks that end a run of letters; the apostrophe isn't one of them, as it may begin a piece with letters.
MARKS = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and c != 39)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 as it is, others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


#: What a tokenizer's file says where it composes letters, then lower-cases them, drops white space and takes letters,
#: single digits and other marks apart.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


def splits_at_words(config: dict) -> bool:
    """Whether a tokenizer works word by word as BY_WORD says, and its special strings hold ``<|`` and no white space."""
    special = [t["content"] for t in config["added_tokens"]]
    return all(config.get(k) == v for k, v in BY_WORD.items()) and config["model"]["type"] == "BPE" and not config["model"].get("dropout") and all(
        "<|" in x and len(x.split()) == 1 and not t["normalized"] for x, t in zip(special, config["added_tokens"])
    )


class WordIds(dict):
    """The ids of a word, packed as little-endian 32 bits, for tokenizers as BY_WORD. Holds at most ``most`` words.

    Texts of any other tokenizer are encoded whole.

    Words are found by ASCII white space, at which such a tokenizer always splits. Letters, and the marks that follow
    them, are looked up apart; Latin letters alone go straight to the tokenizer's model, all else through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as file:
            self.by_word = splits_at_words(json.load(file))
        self.tokenizer, self.most, self.letters = Tokenizer.from_file(path), most, _byte_letters()
        self.encode, self.merge = self.tokenizer.encode, self.tokenizer.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() if self.by_word else 0)]

    def ids(self, word: bytes) -> bytes:
        if word.isalpha():
            found = [t.id for t in self.merge(word.lower().decode())]
        else:
            core = word.rstrip(MARKS)
            if core and len(core) < len(word):
                # U+0130 in small letters ends with a mark, which would join those that follow.
                if core.isalpha() or (text := core.decode()).isalpha() and "\u0130" not in text:
                    return self[core] + self[word[len(core) :]]
            text = word.decode()
            # Below U+0130 a letter is composed already, and each engine knows the same small letter for it.
            if text.isalpha() and max(text) < "\u0130":
                found = [t.id for t in self.merge(text.lower().encode().decode("latin-1").translate(self.letters))]
            else:
                found = self.encode(text, add_special_tokens=False).ids
        return b"".join([self.packed[i] for i in found])

    def __missing__(self, word: bytes) -> bytes:
        packed = self.ids(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = packed
        return packed

    def of(self, text: str | None) -> bytes:
        if not self.by_word:
            return np.array(self.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        raw = (text or "").encode()
        # Case stays where there may be a special token's string, which counts as such in small letters only, or a mark that composes
        # with a letter (U+0300 to U+036F begin with these two bytes): letters are composed first, and only then made small.
        return b"".join(map(self.__getitem__, (raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split()))


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and an end id, cut where longer than ``capacity``."""

    def run(rows: dict) -> dict:
        out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        known = word_ids(tokenizer)
        for doc, text in zip(rows["_id"], rows["_text"]):
            ids = known.of(text) + END
            for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for k, v in zip(out, (doc, i, at // 4, len(part) // 4, zlib.crc32(part))):
                    out[k].append(v)
        return out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return arrow_map(df, [F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")], schema, run)


class Stock:
    """How many items of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = Counter({k: v for k, v in counts.items() if v > 0})
        self.lengths = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.lengths.remove(length)

    def largest(self, most: int, beside: int) -> int | None:
        """The largest length of at most ``most``, one item of ``beside`` set aside."""
        i = bisect.bisect_right(self.lengths, most) - 1
        if i >= 0 and self.lengths[i] == beside and self.n[beside] == 1:
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def smallest(self, n: int, beside: int) -> list[int]:
        """The n smallest items, one of ``beside`` set aside."""
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(n - len(out), self.n[length] - (length == beside))
            if len(out) == n:
                break
        return out

    def best_pair(self, most: int, beside: int) -> int:
        """The largest sum of two items of at most ``most``, one of ``beside`` set aside; 0 if there is none."""
        lengths = [x for x in self.lengths if self.n[x] > (x == beside)]
        best, i, j = 0, 0, len(lengths) - 1
        while i <= j:
            total = lengths[i] + lengths[j]
            if total > most or i == j and self.n[lengths[i]] - (lengths[i] == beside) < 2:
                j -= 1
            else:
                best, i = max(best, total), i + 1
        return best


def reduce_dominated(stock: Stock, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Takes from ``stock`` all that a dominance fixes, and returns it as (pattern, times).

    For an item j of the longest still open, with room r beside it: nothing fits -> j alone; an item of exactly r, or at
    most one item fits -> j with the largest that fits; at most two fit, and no two are larger together than the largest
    that fits alone -> the same. Each dominates every other set with j (Martello & Toth, Knapsack Problems, 8.5).
    """
    out, changed = [], True
    while changed:
        changed = False
        for j in sorted(stock.lengths, reverse=True):
            while stock.n.get(j):
                room, three = capacity - j, stock.smallest(3, j)
                if not three or three[0] > room:
                    n = 1 if three == [] else stock.n[j]
                    n = stock.n[j] if j > room else n
                    out.append((((j, 1),), n))
                    stock.take(j, n)
                    changed = True
                    continue
                mate = stock.largest(room, j)
                fit = len(three) if sum(three) <= room else 2 if sum(three[:2]) <= room else 1
                fit = min(fit, len(three))
                if mate != room and fit > 1 and (fit > 2 or mate < stock.best_pair(room, j)):
                    break
                if mate == j:
                    n = stock.n[j] // 2
                    out.append((((j, 2),), n))
                    stock.take(j, 2 * n)
                else:
                    n = min(stock.n[j], stock.n[mate])
                    out.append((((j, 1), (mate, 1)), n))
                    stock.take(j, n)
                    stock.take(mate, n)
                changed = True
    return out


def best_fit(stock: Stock, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over the counts: alike sequences are filled at once, as (pattern, times)."""
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple, times: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append([pattern, times])

    for length in sorted(stock.lengths, reverse=True):
        n = stock.n[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                room, pattern, times = capacity, (), n
            else:
                room = rooms[i]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            each = min(room // length, n)
            use = min(times, n // each)
            put(room - each * length, (*pattern, (length, each)), use)
            if pattern:
                put(room, pattern, times - use)
            n -= use * each
    return [(pattern, times) for group in open_.values() for pattern, times in group]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, items a sequence, offset) that place each rank of each length."""
    stock = Stock(counts)
    patterns = reduce_dominated(stock, capacity) + best_fit(stock, capacity)
    rows, sequence, used = [], 0, Counter()
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], times * each, sequence, each, offset))
            used[length] += times * each
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def place(steps: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of items by their length and rank."""
    out = np.empty((2, len(length)), np.int64)
    for x in np.unique(length):
        own, rows = length == x, steps[steps[:, 0] == x]
        row = rows[np.searchsorted(rows[:, 1], rank[own], "right") - 1]
        past = rank[own] - row[:, 1]
        out[0, own] = row[:, 3] + past // row[:, 4]
        out[1, own] = row[:, 5] + past % row[:, 4] * x
    return out[0], out[1]


def pack(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, salts: int | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    - null and empty texts: one piece that holds the end id alone. Very long texts: encoded whole.
    - texts over ``capacity`` ids: cut into pieces of that length, the last one shorter; others are never cut.
    - repeated rows and ties: each row is packed; which of equally long pieces goes where is arbitrary but stable.
    - null ids: packed as any other. Empty table: no rows. Further columns are neither read nor returned.

    To the driver go the counts of lengths only, ``capacity`` rows at most.
    """
    spark = df.sparkSession
    salts = salts or max(64, shuffle_partitions(spark))
    cells = ["length", "_salt"]
    made = cut(pieces(df, id_col, text_col, tokenizer, capacity)).withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    )
    sizes = cut(made.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*cells, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = made.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*cells).orderBy("doc_id", "piece", "ids_crc32")) - 1
    ).join(firsts, cells)
    steps = spark.sparkContext.broadcast(plan(counts, capacity))

    def run(batches):
        for b in batches:
            sequence, offset = place(steps.value, b.column("length").to_numpy(), b.column("_place").to_numpy())
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_first")).alias("_place")
    ).mapInArrow(run, out)


def op9_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLE: dict[str, str] = {}
