"""Token counts by section: whole documents are encoded once, and their tokens' spans joined to those of the sections.

The vocabulary is byte-level and loses nothing, so the tokens' bytes laid end to end are the text; their lengths give each
token's span. Sections split the text without gaps: each line with the line break that ends it, or spans of the caller's.
Where a token lies in several sections, a rule allocates it.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellate.llm._common import arrow_map, table

RULES = ("first", "last", "most")


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """(encoder, bytes of each id)."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_starts(raw: bytes) -> np.ndarray:
    """Where each line of a text begins, in bytes."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(raw)]]).astype(np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing ones among them) of each section.

    ends: where the tokens end. starts: where the sections start, the first at 0; the last ends at ``size``. A token goes to
    the section of its first byte (``first``), of its last (``last``), or of most of its bytes, the first of equals (``most``).
    """
    begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = first != last
    to = last if rule == "last" else first
    if rule == "most" and crossing.any():
        bounds = np.append(starts, size)
        to = first.copy()
        for i in np.flatnonzero(crossing).tolist():
            own = np.arange(first[i], last[i] + 1)
            held = np.minimum(bounds[own + 1], ends[i]) - np.maximum(bounds[own], begin[i])
            to[i] = own[held.argmax()]
    return np.bincount(to, minlength=len(starts)), np.bincount(to[crossing], minlength=len(starts))


def token_counts(
    df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first",
    sections: Callable[[bytes], np.ndarray] = line_starts,
) -> DataFrame:
    """One row per section of each row of ``df``: id, section, start, length, n_tokens, n_crossing, doc_tokens.

    start and length are in code points. n_crossing are those of n_tokens that lie in other sections too. The n_tokens of a
    document add up to doc_tokens. ``sections`` gives a text's section starts in bytes, the first at 0, on character bounds.

    - null and empty texts: one empty section without tokens.
    - very long texts: encoded whole. Repeated rows: each gives its sections. Null ids: kept. Ties: see ``rule``.
    - empty table: no rows. Further columns are neither read nor returned.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(rows: dict) -> dict:
        encoder, lengths = encoding(vocabulary, pattern)
        out: dict = {k: [] for k in ("id", "section", "start", "length", "n_tokens", "n_crossing", "doc_tokens")}
        for doc, text in zip(rows["_id"], rows["_text"]):
            raw = (text or "").encode()
            ids = np.array(encoder.encode_ordinary(text or ""), np.int64)
            starts = sections(raw)
            counts, crossing = attribute(lengths[ids].cumsum(), starts, len(raw), rule)
            if len(raw) == len(text or ""):
                points = np.append(starts, len(raw))
            else:
                heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
                points = np.concatenate([[0], heads.cumsum()])[np.append(starts, len(raw))]
            n = len(starts)
            out["id"] += [doc] * n
            out["section"] += range(n)
            out["start"] += points[:-1].tolist()
            out["length"] += np.diff(points).tolist()
            out["n_tokens"] += counts.tolist()
            out["n_crossing"] += crossing.tolist()
            out["doc_tokens"] += [len(ids)] * n
        return out

    schema = "id long, section int, start long, length long, n_tokens long, n_crossing long, doc_tokens long"
    columns = [F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")]
    return arrow_map(df, columns, schema, run).withColumnRenamed("id", id_col)


def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE: dict[str, str] = {}
