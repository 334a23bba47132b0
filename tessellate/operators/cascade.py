"""The residual cascade: what a stage leaves unmatched goes to the next one.

Everything is oriented from the smaller model of a pair to the larger. A stage sees the residual of the one before it and all
entities of the larger model, matched or not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellate.functions.similarity import cosine
from tessellate.operators.assign import greedy_one_to_one, top_one_then_unique
from tessellate.operators.confirm import coverage, smaller_side, status_counts
from tessellate.operators.describe import describe_associations, describe_children, describe_name_first, describe_plain
from tessellate.operators.lexical import PAIR
from tessellate.operators.scorers import PairScorer, TextEncoder, encode_texts, hashed_trigrams, score_pairs, token_containment
from tessellate.plans.lineage import cut
from tessellate.sources.models import ModelTables

STAGES = ("lexical", "mutual_entailment", "subsumption", "child_composition", "association", "synonym", "structural")
SIDES = ["domain", "smaller_model", "larger_model"]


@dataclass
class Config:
    """Thresholds of the stages."""

    entailment: float = 0.45
    forward: float = 0.50
    gap: float = 0.15
    child: float = 0.55
    association: float = 0.45
    synonym: float = 0.72
    all_models: bool = False


@dataclass
class Cascade:
    """matches (sides, stage, smaller, larger, score, desc_smaller, desc_larger), groups of subsumption, residual
    (sides, stage, entity, pos) after each stage, and summary (sides, total, a count and a cumulative coverage for each stage)."""

    matches: DataFrame
    groups: DataFrame
    residual: DataFrame
    summary: DataFrame


def oriented(status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, elements): the smaller and larger model of each pair with its totals, and the smaller side's entities."""
    side = smaller_side(status_counts(status))
    first = F.col("small") == "a"
    pairs = side.select(
        *PAIR, "small", F.when(first, F.col("model_a")).otherwise(F.col("model_b")).alias("smaller_model"),
        F.when(first, F.col("model_b")).otherwise(F.col("model_a")).alias("larger_model"), "total", "matched",
    )
    rows = status.filter("kind = 'entity'").join(pairs, PAIR).filter("side = small")
    return pairs.drop("small"), rows.select(*SIDES, F.col("entity").alias("smaller"), "status", "matched_to")


def _described(pairs: DataFrame, described: DataFrame, residual: DataFrame) -> DataFrame:
    """The residual beside all of the larger model, with descriptions and positions."""
    small = described.select("domain", F.col("model").alias("smaller_model"), F.col("entity").alias("smaller"), F.col("entity_pos").alias("smaller_pos"), F.col("description").alias("desc_smaller"))
    large = described.select("domain", F.col("model").alias("larger_model"), F.col("entity").alias("larger"), F.col("entity_pos").alias("larger_pos"), F.col("description").alias("desc_larger"))
    return residual.join(small, ["domain", "smaller_model", "smaller"]).join(large, ["domain", "larger_model"])


def _order():
    return [F.col("score").desc(), F.col("smaller_pos"), F.col("larger_pos")]


def entailment_stage(pairs: DataFrame, described: DataFrame, residual: DataFrame, scorer: PairScorer, threshold: float) -> DataFrame:
    """One-to-one matches by the lesser of both directions' scores, greedily; equals go in the order of definition."""
    scored = score_pairs(_described(pairs, described, residual), scorer).withColumn("score", F.least("fwd", "rev"))
    return greedy_one_to_one(scored.filter(F.col("score") >= threshold), SIDES, "smaller", "larger", _order())


def subsumption_stage(pairs: DataFrame, described: DataFrame, residual: DataFrame, scorer: PairScorer, forward: float, gap: float) -> DataFrame:
    """(sides, direction, abstract, member, fwd, asymmetry), not one-to-one: the member entails the abstract one, not the reverse."""
    scored = score_pairs(_described(pairs, described, residual), scorer)
    parts = []
    for direction, abstract, member, fwd, rev in (
        ("large_abstracts_small", "larger", "smaller", "fwd", "rev"), ("small_abstracts_large", "smaller", "larger", "rev", "fwd"),
    ):
        wide = F.col(fwd) - F.col(rev)
        parts.append(scored.filter((F.col(fwd) >= forward) & (wide >= gap)).select(
            *SIDES, F.lit(direction).alias("direction"), F.col(abstract).alias("abstract"), F.col(member).alias("member"), F.col(f"{member}_pos").alias("member_pos"),
            F.bround(fwd, 4).alias("fwd"), F.bround(wide, 4).alias("asymmetry"),
        ))
    return parts[0].unionByName(parts[1])


def subsumption_groups(found: DataFrame, keys: list[str] = SIDES) -> DataFrame:
    """Members of each abstract entity, the best first, with the group's size and mean score."""
    item = F.struct((-F.col("fwd")).alias("o"), "member_pos", "member", "fwd", "asymmetry")
    rows = found.groupBy(*keys, "direction", F.col("abstract").alias("abstract_entity")).agg(F.array_sort(F.collect_list(item)).alias("m"))
    of = lambda f: F.transform("m", lambda x: x[f])
    size = F.size("m")
    mean = F.aggregate(of("fwd"), F.lit(0.0), lambda a, x: a + x) / size
    return rows.select(
        *keys, "direction", "abstract_entity", of("member").alias("subsumed_entities"), of("fwd").alias("fwd_scores"), of("asymmetry").alias("asymmetry_scores"),
        size.alias("group_size"), (size > 1).alias("is_group"), mean.alias("mean_fwd"),
    )


def covered(found: DataFrame) -> DataFrame:
    """(sides, smaller) that subsumption accounts for: members below a larger entity, and smaller ones above members."""
    small = F.when(F.col("direction") == "large_abstracts_small", F.col("member")).otherwise(F.col("abstract"))
    return found.select(*SIDES, small.alias("smaller")).distinct()


def synonym_stage(pairs: DataFrame, described: DataFrame, residual: DataFrame, encoder: TextEncoder, threshold: float) -> DataFrame:
    """Each residual entity's nearest by cosine; of those with one nearest the best stays, and losers aren't tried again."""
    rows = _described(pairs, encode_texts(described, encoder).drop("description").withColumnRenamed("vector", "description"), residual)
    scored = rows.withColumn("score", cosine(F.col("desc_smaller"), F.col("desc_larger"))).drop("desc_smaller", "desc_larger")
    small, large = (described.select("domain", F.col("model").alias(f"{s}_model"), F.col("entity").alias(s), F.col("description").alias(f"desc_{s}")) for s in ("smaller", "larger"))
    nearest = top_one_then_unique(scored, SIDES, "smaller", "larger", _order())
    return nearest.filter(F.col("score") >= threshold).join(small, ["domain", "smaller_model", "smaller"]).join(large, ["domain", "larger_model", "larger"])


def run_cascade(
    tables: ModelTables, status: DataFrame, scorer: PairScorer = token_containment, encoder: TextEncoder | None = None, config: Config | None = None
) -> Cascade:
    """All stages after the lexical one over an element_status table."""
    config, encoder = config or Config(), encoder or hashed_trigrams()
    pairs, elements = oriented(status)
    if not config.all_models:
        for m in ("smaller_model", "larger_model"):
            pairs = pairs.join(tables.model.filter("versioned").select("domain", F.col("model").alias(m)), ["domain", m], "left_semi")
    pairs = cut(pairs)
    elements = elements.join(pairs.select(*SIDES), SIDES, "left_semi")
    residual = cut(elements.filter("status = 'missing'").select(*SIDES, "smaller"))
    columns = [*SIDES, "stage", "smaller", "larger", "score", "desc_smaller", "desc_larger"]
    matches = elements.filter("status = 'matched'").select(
        *SIDES, F.lit("lexical").alias("stage"), "smaller", F.col("matched_to").alias("larger"), F.lit(1.0).alias("score"),
        *[F.lit(None).cast("string").alias(c) for c in columns[-2:]],
    )
    left = residual.withColumn("stage", F.lit("lexical"))
    counts = [pairs.select(*SIDES, F.lit("lexical").alias("stage"), F.col("matched").alias("n"))]
    plain, groups = cut(describe_plain(tables)), None
    for stage in STAGES[1:-1]:
        if stage == "subsumption":
            groups = cut(subsumption_stage(pairs, plain, residual, scorer, config.forward, config.gap))
            new = covered(groups)
        else:
            if stage == "synonym":
                found = synonym_stage(pairs, describe_name_first(tables), residual, encoder, config.synonym)
            else:
                described, threshold = {
                    "mutual_entailment": (plain, config.entailment), "child_composition": (describe_children(tables), config.child),
                    "association": (describe_associations(tables), config.association),
                }[stage]
                found = entailment_stage(pairs, described, residual, scorer, threshold)
            new = cut(found.withColumn("stage", F.lit(stage)).withColumn("score", F.bround("score", 4)).select(*columns))
            matches = matches.unionByName(new)
        residual = cut(residual.join(new.select(*SIDES, "smaller"), [*SIDES, "smaller"], "left_anti").select(*SIDES, "smaller"))
        left = left.unionByName(residual.withColumn("stage", F.lit(stage)))
        counts.append(new.groupBy(*SIDES).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(stage)).select(*SIDES, "stage", "n"))
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    wide = pairs.select(*SIDES, "total").join(every, SIDES).groupBy(*SIDES, "total").pivot("stage", list(STAGES[:-1])).agg(F.sum("n"))
    sums, total = {}, F.lit(0)
    for stage in STAGES[:-1]:
        n = F.coalesce(F.col(stage), F.lit(0))
        total = total + n
        sums |= {stage: n, f"coverage_after_{stage}": coverage(total, F.col("total"))}
    return Cascade(matches, subsumption_groups(groups), left, wide.select(*SIDES, "total", *[v.alias(k) for k, v in sums.items()]))


def latest_residual(residual: DataFrame, ran: DataFrame, keys: list[str] = SIDES) -> DataFrame:
    """The residual of the last stage that ran for each pair (``ran``: keys, stage); it may be empty."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)])
    last = ran.groupBy(*keys).agg(F.max_by("stage", F.element_at(rank, F.col("stage"))).alias("stage"))
    return residual.join(last, [*keys, "stage"], "left_semi")


def stage_edges(cascade: Cascade, structural: DataFrame | None = None) -> DataFrame:
    """(sides, smaller, larger, stage, score): all stages' links, groups of subsumption unrolled."""
    edges = cascade.matches.select(*SIDES, "smaller", "larger", "stage", "score")
    g = cascade.groups.select(*SIDES, "direction", "abstract_entity", F.posexplode("subsumed_entities").alias("i", "member"), "fwd_scores")
    down = F.col("direction") == "large_abstracts_small"
    edges = edges.unionByName(g.select(
        *SIDES, F.when(down, F.col("member")).otherwise(F.col("abstract_entity")).alias("smaller"),
        F.when(down, F.col("abstract_entity")).otherwise(F.col("member")).alias("larger"), F.lit("subsumption").alias("stage"), F.get("fwd_scores", "i").alias("score"),
    ))
    if structural is not None:
        edges = edges.unionByName(structural.select(*SIDES, "smaller", "larger", F.lit("structural").alias("stage"), "score"))
    return edges


def stage_counts(edges: DataFrame, keys: list[str] = SIDES) -> DataFrame:
    return edges.groupBy(*keys, "stage").agg(F.count(F.lit(1)).alias("n"))


def dominant_stage(edges: DataFrame, keys: list[str] = SIDES, node: str = "smaller") -> DataFrame:
    """(keys, node, stage): the first stage in the order of STAGES that links a node."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)])
    return edges.groupBy(*keys, node).agg(F.min_by("stage", F.element_at(rank, F.col("stage"))).alias("stage"))
