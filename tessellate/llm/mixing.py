"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell of source, language and topic. Raking multiplies the cells until each marginal has its target
shares. A document's probability is its cell's multiplier times one scale, at most 1; the scale is the one by which the
expected tokens come to ``rate`` of all (cells that reach 1 are held there, and the rest is scaled up for it). Where cells
are held, the marginals under the probabilities miss their targets. With ``copies`` nothing is held: a document comes as often
as its multiplier times the scale says, which may be over 1, and rate and targets hold together. ``shares`` shows both.

A target share that isn't given is the observed one raised to ``alpha`` and normalised, which lifts small groups.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellate.llm._common import WORD, cut, table, whole_row

DIMS = ("source", "lang", "topic")
SWEEPS = 8
ALPHA = 0.7
RATE = 0.8
CELLS = 100_000


def topic_of(text: Column) -> Column:
    """A stand-in where a table has no topics: a text's form, by its length and the signs of tables, shouting and markup. Pass ``topic`` for real ones."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.char_length(text) < 400, "note")
        .when(text.contains(" | "), "tabular")
        .when(text.contains("!! "), "loud")
        .when(text.rlike(r"\*\*\*|###|%%%|&&&"), "marked")
        .when(F.char_length(text) < 3000, "article")
        .otherwise("treatise")
    )


def uniform(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from the md5 of seed and id: 52 of its bits, so the same in any engine."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(cells: list[tuple], targets: dict[str, dict], alpha: float, sweeps: int) -> list[float]:
    """Multipliers of cells (values of DIMS, tokens): ``sweeps`` rounds of proportional fitting over DIMS in turn."""
    total = sum(c[-1] for c in cells)
    shares = []
    for d, dim in enumerate(DIMS):
        seen: dict = {}
        for c in cells:
            seen[c[d]] = seen.get(c[d], 0) + c[-1]
        raised = {k: targets.get(dim, {}).get(k, (v / total) ** alpha if total else 0.0) for k, v in seen.items()}
        norm = sum(raised.values())
        shares.append({k: v / norm if norm else 0.0 for k, v in raised.items()})
    factors = [1.0] * len(cells)
    for _ in range(sweeps):
        for d, share in enumerate(shares):
            now: dict = {}
            for c, f in zip(cells, factors):
                now[c[d]] = now.get(c[d], 0.0) + f * c[-1]
            factors = [f * share[c[d]] * total / now[c[d]] if now[c[d]] else f for c, f in zip(cells, factors)]
    return factors


def calibrate(tokens: list[int], factors: list[float], rate: float) -> list[float]:
    """Probabilities min(1, scale x factor) whose expected tokens are ``rate`` of all."""
    order = sorted(range(len(tokens)), key=lambda i: -factors[i])
    left, open_ = rate * sum(tokens), sum(t * f for t, f in zip(tokens, factors))
    scale = 0.0
    for i in order:
        scale = left / open_ if open_ > 0 else 0.0
        if scale * factors[i] <= 1:
            break
        left, open_ = left - tokens[i], open_ - tokens[i] * factors[i]
    return [min(1.0, scale * f) for f in factors]


def _rake_frame(cells: DataFrame, targets: dict[str, dict], alpha: float, sweeps: int, rate: float) -> DataFrame:
    """The same over a DataFrame of cells, for more of them than fit the driver: one cut a step.

    Each step joins the cells with their own sums, so plans would double from step to step if they weren't cut.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    frame = cells.withColumn("factor", F.lit(1.0))
    for dim in DIMS:
        given = targets.get(dim, {})
        pairs = [F.lit(x) for k, v in given.items() for x in (k, float(v))]
        known = F.element_at(F.create_map(*pairs), F.col(dim)) if pairs else F.lit(None).cast("double")
        raised = F.coalesce(known, F.pow(F.sum("tokens") / F.lit(float(max(total, 1))), F.lit(alpha)))
        share = cells.groupBy(dim).agg(raised.alias("_r"))
        norm = share.agg(F.sum("_r")).first()[0] or 1.0
        share = share.select(F.col(dim).alias("_k"), (F.col("_r") / norm).alias(f"_share_{dim}"))
        frame = frame.join(share, F.col(dim).eqNullSafe(F.col("_k"))).drop("_k")
    frame = cut(frame)
    for _ in range(sweeps):
        for dim in DIMS:
            now = frame.groupBy(F.col(dim).alias("_k")).agg(F.sum(F.col("factor") * F.col("tokens")).alias("_now"))
            frame = frame.join(now, F.col(dim).eqNullSafe(F.col("_k"))).withColumn(
                "factor", F.when(F.col("_now") > 0, F.col("factor") * F.col(f"_share_{dim}") * total / F.col("_now")).otherwise(F.col("factor"))
            ).drop("_k", "_now")
            frame = cut(frame)
    low, high = 0.0, (frame.agg(F.max(1 / F.nullif("factor", F.lit(0.0)))).first()[0] or 1.0)
    for _ in range(40):
        scale = (low + high) / 2
        got = frame.agg(F.sum(F.least(F.lit(1.0), F.lit(scale) * F.col("factor")) * F.col("tokens"))).first()[0] or 0.0
        low, high = (scale, high) if got < rate * total else (low, scale)
    open_ = frame.agg(F.sum(F.col("factor") * F.col("tokens"))).first()[0] or 0.0
    return frame.select(
        *DIMS, "factor", F.least(F.lit(1.0), F.lit(high) * F.col("factor")).alias("p"),
        (F.lit(rate * total / open_ if open_ else 0.0) * F.col("factor")).alias("expected"), "tokens",
    )


def _labelled(df: DataFrame, text_col: str, topic: Column | None, *more: Column) -> DataFrame:
    """(_source, _lang, _topic), by which ``df`` is raked, _n tokens, and what else is asked for."""
    return df.select(
        F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"),
        (topic_of(F.col(text_col)) if topic is None else topic.cast("string")).alias("_topic"), _tokens(text_col).alias("_n"), *more,
    )


def _cells(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMS]).agg(F.sum("_n").alias("tokens"))


def _weights(
    cells: DataFrame, targets: dict[str, dict] | None, alpha: float, rate: float, sweeps: int, most_cells: int
) -> DataFrame:
    """(source, lang, topic, factor, p, expected, tokens) of cells (source, lang, topic, tokens)."""
    targets = targets or {}
    held = cells.limit(most_cells + 1).collect()
    if len(held) > most_cells:
        return _rake_frame(cut(cells), targets, alpha, sweeps, rate)
    held = sorted((tuple(r) for r in held), key=lambda c: tuple((x is not None, x) for x in c[:3]))
    factors = rake(held, targets, alpha, sweeps)
    ps = calibrate([c[-1] for c in held], factors, rate)
    open_ = sum(c[-1] * f for c, f in zip(held, factors))
    scale = rate * sum(c[-1] for c in held) / open_ if open_ else 0.0
    weights = cells.sparkSession.createDataFrame(
        [(*c[:3], f, p, scale * f, c[-1]) for c, f, p in zip(held, factors, ps)],
        "source string, lang string, topic string, factor double, p double, expected double, tokens long",
    )
    return F.broadcast(weights)  # most_cells rows at most


def _weighed(labelled: DataFrame, weights: DataFrame, id_col: str, seed: str) -> DataFrame:
    weights = weights.select(*[F.col(d).alias(f"_of_{d}") for d in DIMS], F.col("factor").alias("_factor"), F.round("p", 6).alias("_p"), F.round("expected", 6).alias("_expected"))
    same = functools.reduce(lambda a, b: a & b, [F.col(f"_{d}").eqNullSafe(F.col(f"_of_{d}")) for d in DIMS])
    u, whole = uniform(id_col, seed), F.floor("_expected")
    return labelled.join(weights, same).withColumns({
        "_sampled": u < F.col("_p"), "_copies": (whole + F.when(u < F.col("_expected") - whole, 1).otherwise(0)).cast("int"),
    })


def _tokens(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict] | None = None, alpha: float = ALPHA,
    rate: float = RATE, sweeps: int = SWEEPS, seed: str = "mix", topic: Column | None = None, most_cells: int = CELLS,
    copies: bool = False,
) -> DataFrame:
    """One row per row of ``df``: id, source, lang, topic, n_tokens, weight (multiplier), p, sampled; with ``copies`` expected and copies in
    place of the last two.

    Tokens are runs without ASCII white space. Cells go to the driver while there are ``most_cells`` of them or fewer; more
    are raked as a DataFrame, to the same weights.

    - null and empty texts: no tokens. Very long texts: counted whole. Null source, language or topic: a group like any other.
    - null ids and repeated rows: rows of one id are sampled alike. Ties play no part; the sample is a function of the id.
    - groups without tokens: their multiplier is what the other marginals give them. Empty table: no rows.
    - a table's own column ``topic``, and further columns, are neither read nor returned; pass ``topic`` to use one.
    """
    rows = cut(_labelled(df, text_col, topic, F.col(id_col).alias("_id")))
    weights = _weights(_cells(rows), targets, alpha, rate, sweeps, most_cells)
    return _weighed(rows, weights, "_id", seed).select(
        F.col("_id").alias(id_col), *[F.col(f"_{d}").alias(d) for d in DIMS], F.col("_n").alias("n_tokens"),
        F.round("_factor", 6).alias("weight"),
        *([F.col("_expected").alias("expected"), F.col("_copies").alias("copies")] if copies else [F.col("_p").alias("p"), F.col("_sampled").alias("sampled")]),
    )


def sample(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict] | None = None, alpha: float = ALPHA,
    rate: float = RATE, sweeps: int = SWEEPS, seed: str = "mix", topic: Column | None = None, most_cells: int = CELLS,
    copies: bool = False,
) -> DataFrame:
    """The rows of ``df`` that ``mix`` samples, with all their columns; with ``copies`` each one as often as ``mix`` says.

    - null and empty texts: sampled by their cell, as any other. Very long texts: counted whole, never shuffled.
    - null ids, repeated rows and ties: as in ``mix``. Empty table: no rows.
    - further columns of any type and name come back as they are.
    """
    weights = _weights(_cells(_labelled(df, text_col, topic)), targets, alpha, rate, sweeps, most_cells)
    rows = _weighed(_labelled(df, text_col, topic, F.col(id_col).alias("_id"), whole_row(df)), weights, "_id", seed)
    if copies:
        return rows.filter("_copies > 0").select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")).select("_row.*")
    return rows.filter("_sampled").select("_row.*")


def shares(
    df: DataFrame, text_col: str = "text", targets: dict[str, dict] | None = None, alpha: float = ALPHA, rate: float = RATE,
    sweeps: int = SWEEPS, topic: Column | None = None, most_cells: int = CELLS,
) -> DataFrame:
    """(dim, value, observed, raked, under_p, under_copies): each group's share of the tokens, by multiplier, and as expected of samples."""
    cells = _cells(_labelled(df, text_col, topic))
    by = {"observed": F.lit(1.0), "raked": F.col("factor"), "under_p": F.col("p"), "under_copies": F.col("expected")}
    each = _weights(cells, targets, alpha, rate, sweeps, most_cells).select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in DIMS])).alias("of"),
        *[(c * F.col("tokens")).alias(n) for n, c in by.items()],
    )
    sums = each.groupBy("of.dim", "of.value").agg(*[F.sum(n).alias(n) for n in by])
    totals = sums.groupBy("dim").agg(*[F.nullif(F.sum(n), F.lit(0.0)).alias(f"_{n}") for n in by])
    return sums.join(totals, "dim").select("dim", "value", *[(F.col(n) / F.col(f"_{n}")).alias(n) for n in by])


def op1_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op1_mixing_copies(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), copies=True)


QUERIES = {"op1_mixing": op1_mixing, "op1_mixing_copies": op1_mixing_copies}


def oracle_sql(rows: str = "documents") -> str:
    """The op's result over the relation ``rows``, with a common table expression for each step of each sweep."""
    steps, before = [], "c0"
    for i in range(SWEEPS * len(DIMS)):
        d = DIMS[i % len(DIMS)]
        name = f"c{i + 1}"
        steps.append(
            f"{name} AS (SELECT * REPLACE (CASE WHEN sum(factor * tokens) OVER w > 0 THEN factor * share_{d} * total"
            f" / sum(factor * tokens) OVER w ELSE factor END AS factor) FROM {before} WINDOW w AS (PARTITION BY {d}))"
        )
        before = name
    shares = ", ".join(
        f"s_{d} AS (SELECT {d} AS k_{d}, r / sum(r) OVER () AS share_{d} FROM (SELECT {d}, pow(sum(tokens)::DOUBLE / any_value(total), {ALPHA}) AS r"
        f" FROM t GROUP BY {d}))" for d in DIMS
    )
    joins = " ".join(f"JOIN s_{d} ON t.{d} IS NOT DISTINCT FROM s_{d}.k_{d}" for d in DIMS)
    return rf"""
        WITH d AS (
            SELECT doc_id, source, lang, CASE WHEN length(x) < 400 THEN 'note' WHEN contains(x, ' | ') THEN 'tabular'
                   WHEN contains(x, '!! ') THEN 'loud' WHEN regexp_matches(x, '\*\*\*|###|%%%|&&&') THEN 'marked'
                   WHEN length(x) < 3000 THEN 'article' ELSE 'treatise' END AS topic,
                   len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n_tokens
            FROM (SELECT *, coalesce(text, '') AS x FROM {rows})),
        t AS (SELECT *, sum(tokens) OVER () AS total FROM
              (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)),
        {shares},
        c0 AS (SELECT t.*, share_source, share_lang, share_topic, 1.0::DOUBLE AS factor FROM t {joins}),
        {", ".join(steps)},
        o AS (SELECT *, sum(tokens) OVER (ORDER BY factor DESC, source, lang, topic ROWS UNBOUNDED PRECEDING) - tokens AS ahead,
                     sum(tokens * factor) OVER (ORDER BY factor, source DESC, lang DESC, topic DESC ROWS UNBOUNDED PRECEDING) AS open,
                     row_number() OVER (ORDER BY factor DESC, source, lang, topic) AS i FROM {before}),
        z AS (SELECT arg_min(({RATE} * total - ahead) / open, i) AS scale FROM o
              WHERE ({RATE} * total - ahead) / open * factor <= 1),
        w AS (SELECT source, lang, topic, factor, least(1.0, scale * factor) AS p FROM o, z)
        SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(factor, 6) AS weight, round(p, 6) AS p,
               ('0x' || substr(md5('mix' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < round(p, 6) AS sampled
        FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source AND d.lang IS NOT DISTINCT FROM w.lang AND d.topic = w.topic
    """


ORACLE = {"op1_mixing": oracle_sql()}
