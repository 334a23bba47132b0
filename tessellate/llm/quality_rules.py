"""Quality rules by host: what documents fail is summed up by host, and the hosts' verdicts go back to them.

A host's failure rate is shrunk towards the rate of all hosts by a beta prior that is fitted to the hosts themselves
(moments of their rates), so a host of few documents isn't judged by those alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellate.llm._common import arrow_map, cut, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more, the first time included.

    Windows are numbered exactly, by doubling: those of twice a length by the numbers of their halves. So a text takes
    memory by its words alone, and not by their windows.
    """
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(words) <= width or len(known) == len(words):
        return 0
    size = 1
    while size < width:
        step = min(size, width - size)
        pair = number[:-step] * (number.max() + 1) + number[step:]
        number, size = np.unique(pair, return_inverse=True)[1], size + step
    at = np.flatnonzero(np.bincount(number)[number] > 1)
    ends = np.minimum(at + width, np.append(at[1:], len(words)))
    return int((ends - at).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The figures of COUNTS for one whole text; null counts as empty."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    again = sum(1 for x in lines if x in seen or seen.add(x))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        again,
        repeated_words(words),
    )


def host_verdicts(rates: DataFrame, limit: float) -> DataFrame:
    """(host, host_rate, host_bad) from (host, n, failed): posterior mean failure rates under a fitted beta prior.

    The prior has the mean m of the hosts' rates (weighted by documents) and, from their variance v beyond what
    sampling alone gives, the size s = m(1-m)/v - 1; hosts that don't differ give s its upper bound.
    """
    sums = rates.agg(
        F.sum("n").alias("n"),
        F.sum("failed").alias("failed"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("square"),
    ).first()
    mean = sums.failed / sums.n if sums.n else 0.0
    sampling = mean * (1 - mean) * sums.hosts / sums.n if sums.n else 0.0
    between = sums.square / sums.n - mean * mean if sums.n else 0.0
    variance = max(between - sampling, mean * (1 - mean) / 10_001, 1e-12)
    size = max(mean * (1 - mean) / variance - 1, 1e-6)
    rate = (F.col("failed") + mean * size) / (F.col("n") + size)
    return rates.select("host", rate.alias("host_rate"), (rate > limit).alias("host_bad"))


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.5,
    least_words: int = 20, most_repeats: int = 30, most_symbols: float = 0.1, most_dup_lines: float = 0.3,
) -> DataFrame:
    """One row per row of ``df``: id, the figures of COUNTS, base_failed, n_rules_failed, host_rate, kept.

    A document fails the base when it has fewer than ``least_words`` words, or over ``most_repeats`` percent of its words
    in repeated windows. A host's documents fail its rate when they fail the base, hold over ``most_symbols`` symbols a
    character of words, or repeat over ``most_dup_lines`` of their lines. Kept is what passes the base on a host
    whose shrunk rate is ``host_limit`` or less.

    - null text: empty, so it fails. Very long texts: counted whole, in memory that goes by their words. Null host: a host like any other.
    - null ids, repeated rows and ties: each row is judged and counted. Empty table: no rows.
    - further columns are neither read nor returned.
    """

    def run(rows: dict) -> dict:
        found = list(zip(*map(counts, rows["_text"]))) or [()] * len(COUNTS)
        lines = [max(1, (t or "").count("\n") + 1) for t in rows["_text"]]
        return {"id": rows["_id"], "host": rows["_host"], "n_lines": lines} | dict(zip(COUNTS, found))

    schema = "id long, host string, n_lines long, " + ", ".join(f"{c} long" for c in COUNTS)
    columns = [F.col(id_col).cast("long").alias("_id"), F.col(host_col).cast("string").alias("_host"), F.col(text_col).alias("_text")]
    figures = cut(arrow_map(df, columns, schema, run))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    symbols = F.col("n_symbols") > most_symbols * F.col("word_chars")
    lines = F.col("n_dup_lines") > most_dup_lines * F.col("n_lines")
    judged = figures.withColumns(
        {"base_failed": base, "n_rules_failed": base.cast("int") + symbols.cast("int") + lines.cast("int")}
    )
    rates = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_rules_failed") > 0).alias("failed")
    )
    verdicts = host_verdicts(rates, host_limit).withColumnRenamed("host", "_judged")
    return judged.join(verdicts, F.col("host").eqNullSafe(F.col("_judged"))).select(
        F.col("id").alias(id_col), *COUNTS, "base_failed", "n_rules_failed", F.round("host_rate", 6).alias("host_rate"),
        (~F.col("base_failed") & ~F.col("host_bad")).alias("kept"),
    )


def op4_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op4_quality_rules": op4_quality_rules}

ORACLE = {
    "op4_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i
              FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)),
        g AS (SELECT r, i, string_agg(word, ' ') OVER s AS gram, count(*) OVER s AS n
              FROM w WINDOW s AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
        t AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g WHERE n = 8),
        c AS (SELECT w.r, w.i, coalesce(bool_or(t.twice) OVER (
                PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), false) AS covered, w.word
              FROM w LEFT JOIN t ON t.r = w.r AND t.i = w.i),
        cw AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (covered) AS n_repeat_words
               FROM c GROUP BY r),
        l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
        cl AS (SELECT r, count(*) AS n_lines,
                      count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]'))
                      - count(DISTINCT line) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_dup_lines
               FROM l GROUP BY r),
        f AS (SELECT d.doc_id, d.source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, n_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words
              FROM d LEFT JOIN cw USING (r) LEFT JOIN cl USING (r)),
        j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
        k AS (SELECT *, base_failed::INT + (n_symbols > 0.1 * word_chars)::INT
                        + (n_dup_lines > 0.3 * n_lines)::INT AS n_rules_failed FROM j),
        h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (n_rules_failed > 0)::DOUBLE AS failed FROM k GROUP BY source),
        p AS (SELECT sum(failed) / sum(n) AS m, count(*) * 1.0::DOUBLE AS hosts, sum(n) AS n,
                     sum(failed * failed / n) / sum(n) AS sq FROM h),
        q AS (SELECT m, greatest(m * (1 - m) / greatest(sq - m * m - m * (1 - m) * hosts / n, m * (1 - m) / 10001, 1e-12) - 1,
                                 1e-6) AS s FROM p),
        v AS (SELECT source, (failed + m * s) / (n + s) AS rate FROM h, q)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_rules_failed,
               round(rate, 6) AS host_rate, NOT base_failed AND NOT rate > 0.5 AS kept
        FROM k JOIN v ON k.source IS NOT DISTINCT FROM v.source
    """
}
