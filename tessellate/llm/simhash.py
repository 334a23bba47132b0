"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints that differ in at most ``k`` of 64 bits are found by walking a binary trie in pairs of nodes of one
depth: a step to children of different bits adds one to the pair's differing bits, and a pair over its budget is
left with all below it. To start from small tries, the bits are cut into k+1 parts on a ring. Of k differing bits,
some rotation has none in its first part, at most one in its first two, and so on (the pigeonring principle,
Qin & Xiao, VLDB 2018). So there is a trie for each rotation, with the budget j-1 down to the end of its j-th part;
all pairs start at one node at the end of the first part, and that node's bits are the key that work is dealt by.

A range partitioning in trie order deals the leaves out evenly, whichever nodes are hot; a node of many leaves is cut
into blocks, and pairs of blocks are joined too unless the bits between them already exceed the budget. A task holds
two blocks at a time, and returns a star for each group that it links instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellate.llm._common import arrow_map, cut, shuffle_partitions, table, whole_row
from tessellate.llm.graph import components

BITS = 64
SHINGLES_AT_ONCE = 1 << 16
LEAST_BLOCK, BLOCK = 128, 2048
LEAVES = 64
PAIRS_AT_ONCE = 1 << 17
ROWS_AT_ONCE = 20_000


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned SimHash of a text's word shingles, repeats included; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for i in range(0, len(first), SHINGLES_AT_ONCE):
        block = slice(i, i + SHINGLES_AT_ONCE)
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(first[block], last[block])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(rows: dict) -> dict:
        found = np.array([fingerprint(t, width) for t in rows["_text"]], np.uint64)
        return {"id": rows["_id"], "fp": found.view(np.int64)}

    return arrow_map(df, [F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")], "id long, fp long", run)


def ring(k: int) -> list[int]:
    """Sizes of the k+1 parts of the bits."""
    return [BITS // (k + 1) + (i < BITS % (k + 1)) for i in range(k + 1)]


def budgets(k: int, rotation: int) -> np.ndarray:
    """How many bits a node pair at each depth may differ in."""
    sizes = ring(k)
    sizes = sizes[rotation:] + sizes[:rotation]
    return np.concatenate([[0], np.repeat(np.arange(k + 1), sizes)])


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges lo..lo+n: the range's number and the element, for each element."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + lo[owner]


def _leaf_pairs(keys: np.ndarray, a0, a1, b0, b1, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (a1 - a0) * (b1 - b0)
    at = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS_AT_ONCE)) + 1, [len(sizes)]])
    for s, e in zip(at[:-1], at[1:]):
        owner, i = _expand(a0[s:e], a1[s:e] - a0[s:e])
        owner, j = _expand(b0[s:e][owner], (b1 - b0)[s:e][owner])
        i = i[owner]
        near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= k)
        yield i[near], j[near]


def joined_tries(keys: np.ndarray, pairs: np.ndarray, depth: int, budget: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys within budget[-1] differing bits below the node pairs given.

    keys: sorted within each node. pairs: rows of (start, end, start, end, differing bits) at ``depth``; the nodes of
    a pair are one or don't overlap. The walk is by depth; many node pairs are halved so that memory stays bounded.
    """
    stack = [(depth, pairs)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > PAIRS_AT_ONCE:
            stack += [(depth, pairs[: len(pairs) // 2]), (depth, pairs[len(pairs) // 2 :])]
            continue
        a0, a1, b0, b1, e = pairs.T
        small = ((a1 - a0) * (b1 - b0) <= LEAVES) | (depth == BITS)
        if small.any():
            yield from _leaf_pairs(keys, a0[small], a1[small], b0[small], b1[small], int(budget[-1]))
            a0, a1, b0, b1, e = pairs[~small].T
        if not len(a0):
            continue
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        other = a0 != b0
        below = np.concatenate(
            [
                np.stack([a0, am, b0, bm, e], 1),
                np.stack([am, a1, bm, b1, e], 1),
                np.stack([a0, am, bm, b1, e + 1], 1),
                np.stack([am, a1, b0, bm, e + 1], 1)[other],
            ]
        )
        depth += 1
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget[depth])]
        stack.append((depth, below))


def stars(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked groups of n items as (id, smallest id of its group), without the smallest ones themselves."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = np.arange(n)
    for i, j in found:
        i, j = rank[i], rank[j]
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    ids = ids[order]
    return ids[moved], ids[label[moved]]


def _unsigned(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).view(np.uint64)


def block_size(n: int) -> int:
    """Leaves of a block at n fingerprints: few of them while blocks are few anyway, so that units of work are small."""
    return max(LEAST_BLOCK, min(BLOCK, n >> 12))


def _cut_blocks(prefix_bits: int, size: int):
    """Rows (rot, key, id) in order -> with the block that each is in: one node's leaves, or ``size`` of them in a row.

    A block is named by the key of its first leaf, of which there is one in each rotation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, node = np.uint64(0), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rot = batch.column(0).to_numpy()
            key = _unsigned(batch.column(1)) ^ np.uint64(1 << 63)
            nodes = rot.astype(np.int64) << 32 | (key >> np.uint64(BITS - prefix_bits)).astype(np.int64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(nodes)) + 1, [len(nodes)]])
            block = np.empty(len(nodes), np.uint64)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if nodes[s] != node:
                    held, node = 0, nodes[s]
                while s < e:
                    if held in (0, size):
                        first, held = key[s], 0
                    n = min(e - s, size - held)
                    block[s : s + n] = first
                    s, held = s + n, held + n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes), pa.array(block.view(np.int64)), pa.array(key.view(np.int64)), batch.column(2)],
                ["rot", "node", "block", "key", "id"],
            )

    return run


def _linked(k: int, across: bool):
    """Rows (rot, a, b, side, key, id) -> stars of what is linked in each unit of work.

    A unit is a pair of blocks a and b of one rotation, or one block beside itself. Its rows come in a row, in trie order.
    """

    def turns(rows: list[np.ndarray]) -> np.ndarray:
        return np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0)) + 1

    def many(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for r in np.unique(rows[0]).tolist():
            own = [x[rows[0] == r] for x in rows]
            _, _, _, side, key, ids = own
            at = np.concatenate([[0], turns(own), [len(key)]])
            s, e = at[:-1], at[1:]
            if across:
                m = s + np.add.reduceat(side == 0, s)
                pairs = np.stack([s, m, m, e, np.zeros_like(s)], 1)
                pairs = pairs[(s < m) & (m < e)]
            else:
                pairs = np.stack([s, e, s, e, np.zeros_like(s)], 1)[e - s > 1]
            got = stars(len(key), joined_tries(key.view(np.uint64), pairs, min(ring(k)), budgets(k, r)), ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            ends = turns(held) if len(held[0]) >= ROWS_AT_ONCE else ()
            if len(ends):
                yield from many([x[: ends[-1]] for x in held])
                held = [x[ends[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield from many(held)

    return run


def _rotated(fp: Column, k: int) -> Column:
    """The rotations as an array of (rot, key): keys have their sign bit flipped, so they sort as unsigned."""
    starts = np.cumsum([0, *ring(k)])[:-1].tolist()
    turned = [F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, BITS - s)) if s else fp for s in starts]
    return F.array(*[F.struct(F.lit(r).alias("rot"), t.bitwiseXOR(F.lit(-(1 << 63))).alias("key")) for r, t in enumerate(turned)])


def block_pairs(blocks: DataFrame, k: int) -> DataFrame:
    """(rot, a, b): pairs of blocks of one node (rows rot, node, block, key, id) that may hold linked leaves.

    The bits above the first that vary within either block are the same for all pairs of their leaves. So a pair goes
    where they differ in more than the budget at that depth, or at the end of any part above it.
    """
    flip = F.lit(-(1 << 63))
    ends = blocks.groupBy("rot", "node", "block").agg(
        F.min(F.col("key").bitwiseXOR(flip)).alias("lo"), F.max(F.col("key").bitwiseXOR(flip)).alias("hi")
    )
    ends = ends.select("rot", "node", "block", "lo", F.col("lo").bitwiseXOR(F.col("hi")).alias("span"))
    a, b = (ends.select("rot", "node", *[F.col(c).alias(c + x) for c in ("block", "lo", "span")]) for x in "ab")
    spread, right = F.col("spana").bitwiseOR(F.col("spanb")), lambda x, n: F.call_function("shiftrightunsigned", x, n)
    pairs = a.join(b, ["rot", "node"]).filter(F.col("blocka") < F.col("blockb")).select(
        "rot", F.col("blocka").alias("a"), F.col("blockb").alias("b"), F.col("loa").bitwiseXOR(F.col("lob")).alias("differ"),
        (BITS - F.when(spread == 0, 0).otherwise(F.length(F.bin(spread)))).alias("depth"),
    )
    # The ends of the parts of each rotation, and how many bits may differ up to there.
    ends_of = ", ".join(
        "array(" + ", ".join(f"named_struct('at', {d}, 'most', {j})" for j, d in enumerate(np.cumsum((ring(k) * 2)[r : r + k + 1]).tolist())) + ")"
        for r in range(k + 1)
    )
    bounds = F.get(F.expr(f"array({ends_of})"), F.col("rot"))
    budget = F.size(F.filter(bounds, lambda x: x["at"] < F.col("depth")))
    within = F.bit_count(right(F.col("differ"), BITS - F.col("depth"))) <= budget
    parts = F.forall(bounds, lambda x: (F.col("depth") < x["at"]) | (F.bit_count(right(F.col("differ"), BITS - x["at"])) <= x["most"]))
    return pairs.filter(within & parts).select("rot", "a", "b")


def links(classes: DataFrame, k: int) -> DataFrame:
    """(u, v): ids whose fingerprints (columns id, fp; each fp once) differ in k bits or fewer, as spanning stars."""
    prefix = min(ring(k))
    leaves = classes.select("id", F.inline(_rotated(F.col("fp"), k)))
    dealt = leaves.select("rot", "key", "id").repartitionByRange(max(8, shuffle_partitions(classes.sparkSession)), "rot", "key")
    blocks = cut(
        dealt.sortWithinPartitions("rot", "key").mapInArrow(_cut_blocks(prefix, block_size(classes.count())), "rot int, node long, block long, key long, id long")
    )
    within = blocks.select("rot", F.col("block").alias("a"), F.col("block").alias("b"), F.lit(0).alias("side"), "key", "id")
    found = within.mapInArrow(_linked(k, across=False), "u long, v long")

    flip = F.lit(-(1 << 63))
    unit = block_pairs(blocks, k)
    sides = unit.select("*", F.inline(F.array(*[F.struct(F.col(x).alias("block"), F.lit(i).alias("side")) for i, x in enumerate("ab")])))
    crossed = (
        sides.join(blocks.select("rot", "block", "key", "id"), ["rot", "block"])
        .select("rot", "a", "b", "side", "key", "id", F.col("key").bitwiseXOR(flip).alias("_order"))
        .repartition("rot", "a", "b")
        .sortWithinPartitions("rot", "a", "b", "side", "_order")
        .drop("_order")
    )
    return found.unionByName(crossed.mapInArrow(_linked(k, across=True), "u long, v long"))


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, k: int = 4) -> DataFrame:
    """One row per row of ``df``: id, fingerprint, component_id (the smallest id that links reach).

    - null or empty text, or one without words: fingerprint zero, linked like any other. Fewer words than ``width``:
      the whole sequence is the one shingle. Very long texts: hashed whole, 65,536 shingles at a time.
    - ties: a bit that half of the hashes set is 0.
    - equal fingerprints are one class, whose smallest id stands for it; copies are never paired with one another.
    - repeated rows, and rows of one id with different texts: each gets its row; one id is one document, so its
      fingerprints are in one component.
    - null ids: the row belongs to its class; a class of null ids alone links nothing, and has component_id null.
    - empty table: no rows. Further columns are neither read nor returned.
    """
    prints = cut(fingerprints(df, id_col, text_col, width))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("id")))
    # An id of several fingerprints links their classes.
    several = prints.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select(F.col("id").alias("u"))
    own = prints.join(several, prints.id == several.u).select("u", "fp").join(classes, "fp").select("u", F.col("id").alias("v"))
    found = components(links(classes.filter("id IS NOT NULL"), k).unionByName(own))
    labelled = classes.join(found, classes.id == found.node, "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "id").alias("component_id")
    )
    return prints.join(labelled, prints.fp == labelled._fp).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, k: int = 4) -> DataFrame:
    """The rows of ``df``, all columns kept, whose id is the smallest of its group; rows without an id stay.

    - null and empty texts are one group, of which the smallest id stays. Very long texts: shuffled whole, once.
    - repeated rows of an id that stays all stay; ties can't be, as ids order a group. Empty table: no rows.
    - further columns of any type and name come back as they are.
    """
    gone = simhash_groups(df, id_col, text_col, width, k).filter(F.col(id_col) != F.col("component_id"))
    gone = gone.select(F.col(id_col).alias("_gone")).distinct()
    rows = df.select(whole_row(df), F.col(id_col).alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def op3_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLE: dict[str, str] = {}
