"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words.  A document is due ``target / size of its source``
copies: the whole part is taken with certainty, the rest is its inclusion probability
p.  Documents are ranked by Pareto's order statistic, the odds of a random number over
the odds of p,

    q = (u / (1 - u)) / (p / (1 - p)),

and the ranking is taken from the front until the words that are still missing are
reached: a sample of fixed size, in words, with unequal probabilities.  An optional
weight column makes p differ between documents of a source.

The cut in the ranking is found by counting, not by sorting a source: words are summed
per source and slice of the ranking, the slice in which the target falls is cut into
slices again, until few enough documents are left to be ordered.  A source with a third
of all documents is summed by all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import cut
from quire.session import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 256
# A slice with more documents is sliced again before it is ordered; this never drops any.
ORDERED_AT_ONCE = 20_000
BITS = 52


@dataclass(frozen=True)
class Mix:
    """What the mix aims at: words overall as a share of all words, and the most copies."""

    share: float = 1.5
    max_copies: int = 2
    weights: tuple[int, ...] = (3, 1, 2)  # of the sources by code point, null last, repeating


def words_in(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Targets in proportion to the weights, none above ``max_copies`` times its source;
    what is above goes to the others by weight.  With sources in ascending order of
    ceiling over weight, the first j are at their ceilings, where j is the first number
    whose rest, shared out, stays below the next ceiling.
    """
    # One row per source from here on.
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    ceiling = F.col("source_size") * float(mix.max_copies)
    source = source.withColumn("place", place).withColumn("w", F.get(weights, F.col("place") % len(mix.weights)))
    source = source.withColumn("ceiling", ceiling).withColumn("ratio", F.col("ceiling") / F.col("w"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "place").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    wanted = F.sum("source_size").over(everything) * mix.share
    rest = (wanted - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("w").over(after)
    source = source.withColumn("rate", rest)
    # The first source whose ceiling is not reached fixes the rate of all after it.
    rate = F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "place", "rate"))).over(everything)["rate"]
    source = source.withColumn("rate", rate)
    target = F.least("ceiling", F.coalesce(F.col("rate") * F.col("w"), F.col("ceiling")))
    return source.select("source", "source_size", target.alias("target"))


def random_number(seed: int, *columns: str) -> Column:
    """A whole number of ``BITS`` bits fixed by ``seed`` and the columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    mix: Mix = Mix(),  # noqa: B008
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for each row of ``docs``.

    ``copies`` is how often the mix takes the whole document, ``taken`` the words this
    gives; no document is taken more than ``max_copies`` times.  A null text has size 0
    and counts 0 copies; a null source is a source of its own, last in order.  The
    sample depends on the seed and the ids alone, so reruns agree; rows with the same
    id are told apart by their place in the input.  A null or negative weight counts as
    0: such a document is never drawn.  Weights that the ceiling cuts short leave
    words missing; those are drawn by rank from the other documents.  Other columns
    are not read.  An empty table gives an empty result.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        words_in(F.col(text)).alias("size"),
        w.alias("weight"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("u", random_number(seed, "doc_id"))
    rows = cut(rows)
    mean = rows.groupBy("source").agg(F.sum(F.col("weight") * F.col("size")).alias("weighted"))
    goal = targets(rows, mix).alias("t").join(mean.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source")))
    # One row per source; beyond the measured limit the joins run shuffled.
    goal = broadcast_if_small(cut(goal.select("t.*", "weighted")))
    due = F.coalesce(F.col("target") * F.col("weight") / F.nullif("weighted", F.lit(0.0)), F.lit(0.0))
    placed = rows.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    placed = placed.select("r.*", "source_size", "target", F.least(due, F.lit(float(mix.max_copies))).alias("due"))
    placed = placed.withColumn("whole", F.floor(F.col("due") + 1e-12).cast("int"))
    p = F.least(F.greatest(F.col("due") - F.col("whole"), F.lit(0.0)), F.lit(1 - 1e-12))
    u = (F.col("u") + 0.5) / float(1 << BITS)
    q = F.when((p > 0) & (F.col("size") > 0) & (F.col("whole") < mix.max_copies), (u / (1 - u)) / (p / (1 - p)))
    # In (0, 1) and with the order of q, so that it can be cut into slices.
    placed = cut(placed.withColumn("rank", q / (1 + q)).drop("due", "weight", "u"))
    edge = broadcast_if_small(cut(cut_points(placed, goal)))
    out = placed.alias("p").join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
    drawn = F.col("rank").isNotNull() & F.coalesce(
        (F.col("rank") < F.col("e.rank_to")) | ((F.col("rank") == F.col("e.rank_to")) & (F.col("row") <= F.col("e.row_to"))),
        F.lit(False),
    )
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + drawn.cast("int"))
    out = out.select("doc_id", "p.source", "size", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def cut_points(placed: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, rank_to, row_to): the last document of each source that is drawn.

    A document is drawn while its middle word is among the words still missing, so the
    sample ends within half a document of the target.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    sure = placed.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    need = goal.alias("g").join(sure.alias("s"), same("g", "s"))
    need = need.select("g.source", (F.col("target") - F.col("sure")).alias("need"))
    # Per source the slice that is looked into, and the words before it.
    state = cut(need.select("source", "need", F.lit(0.0).alias("low"), F.lit(1.0).alias("width")))
    ranked = placed.filter(F.col("rank").isNotNull()).select("source", "rank", "row", "size")
    while True:
        inside = ranked.alias("r").join(broadcast_if_small(state).alias("n"), same("r", "n"))
        inside = inside.filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("width")))
        inside = inside.select("r.*", "need", "low", "width")
        most = inside.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        finest = state.agg(F.min("width")).first()[0] or 0.0
        if most <= ORDERED_AT_ONCE or finest < 2.0**-44:
            break
        step = F.col("width") / SLICES
        part = inside.withColumn("slice", F.least(F.floor((F.col("rank") - F.col("low")) / step), F.lit(SLICES - 1)))
        # At most SLICES rows per source.
        part = part.groupBy("source", "need", "low", "width", "slice").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("slice"))
        part = part.withColumn("words_before", upto - F.col("words"))
        chosen = F.max_by(F.struct("slice", "words_before"), "slice")
        found = part.filter(F.col("words_before") <= F.col("need")).groupBy("source", "need", "low", "width").agg(chosen.alias("c"))
        low = F.col("low") + F.col("c.slice") * step
        state = cut(found.select("source", (F.col("need") - F.col("c.words_before")).alias("need"), low.alias("low"), step.alias("width")))
    # Few documents per source are left to be ordered.
    order = Window.partitionBy("source").orderBy("rank", "row")
    middle = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    taken = inside.withColumn("middle", middle).filter(F.col("middle") <= F.col("need"))
    last = taken.groupBy("source").agg(F.max(F.struct("rank", "row")).alias("last"))
    edge = state.alias("n").join(last.alias("l"), same("n", "l"), "left")
    # Nothing drawn in the slice: the sample ends before it.
    return edge.select(
        "n.source",
        F.coalesce("last.rank", "n.low").alias("rank_to"),
        F.coalesce("last.row", F.lit(-1)).alias("row_to"),
    )


SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST(('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) AS u
    FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
r AS (SELECT *, 2 * source_size / w AS ratio,
             (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, place
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY 2 * source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, source_size,
             least(2 * source_size, coalesce(w * (SELECT arg_min(rate, place2) FROM (
                 SELECT rate, row_number() OVER (ORDER BY ratio, place) AS place2 FROM r WHERE rate <= ratio)), 2 * source_size)) AS target
      FROM r),
p AS (SELECT d.*, source_size, target, least(2, floor(target / source_size + 1e-12)) AS whole, target / source_size AS due
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                - size / 2.0 AS middle, target - whole * source_size AS need FROM p)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN whole < 2 AND due > whole AND middle <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m"""


@query("op4_mix_sources", SQL)
def op4(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
