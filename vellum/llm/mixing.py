"""Mixing sources to target weights.

Words are summed per source, a target is set for each, and every document is emitted floor(rate) times, rate being its source's
target over its size, plus one more copy where a hash-seeded draw falls below the fraction: the copy has the fraction for its probability, and what a
source takes comes near its target as its documents grow in number (README.md has the spread as measured).

fitted=True is for reports and small sources: the draw's bound is then set per source on the hash itself. The words of all documents below a bound are
known from a histogram of 1,024 cells of the hash, and the bound nearest to the wanted words is taken, so that a source of a few dozen
documents comes within its largest document of its target. A document's probability is then near the fraction only.

Defined results: null and empty texts have size 0 and are emitted floor(rate) times or once more as any other; a null source is a
source; a source without words has target 0 and none of its documents is emitted; rows with equal doc_id share their draw; a null
doc_id draws as the empty string; an empty table gives an empty table. Other columns pass through, whatever their names.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import draw, fresh, named, stored, word_count

CELLS_BITS = 10
WEIGHTS = (5.0, 2.0, 1.0)


def plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, fitted: bool = False) -> DataFrame:
    """One row per source of sized (source, draw, size): source, source_size, target, whole, bound: a draw below it takes one copy more.

    Targets: weights, repeating over the sources by code point with null last, share out share times all words; none exceeds cap times
    its source's words, and what is over goes to the others by weight until none is above. That is min(cap * size, level * weight) for
    one level. With sources by rising cap * size / weight, the level reached if the first k are at their cap rises with k up to the
    right k and falls after it, so the level is the largest of these. share has to be at most cap.
    Only one row per source (and cell, if fitted) and task is shuffled; one row per source, which are few, meets in a task.
    """
    if not 0 <= share <= cap:
        raise ValueError("share lies between 0 and cap")
    cells = sized.groupBy("source", F.shiftright("draw", 32 - CELLS_BITS).alias("cell")).agg(F.sum("size").alias("words")) if fitted else None
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size")) if fitted else sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(in_order) - 1).withColumn("weight", w)
    ranked = ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, rest, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level).withColumn("top", F.max("level").over(every))
    target = F.least(F.col("most"), F.col("top") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = ranked.withColumn("target", target).withColumn("whole", F.floor(rate).cast("long")).select("source", "source_size", "target", "whole")
    wanted = F.col("target") - F.col("whole") * F.col("source_size")
    if not fitted:
        fraction = F.when(F.col("source_size") > 0, wanted / F.col("source_size")).otherwise(F.lit(0.0))
        return targets.withColumn("bound", F.floor(fraction * F.lit(float(1 << 32))).cast("long"))
    key = targets.select(F.col("source").alias("t_source"), "source_size", "target", "whole")
    below = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    reach = cells.join(key, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("middle", below - F.col("words") / F.lit(2.0))
    taken = (wanted > 0) & (F.col("middle") <= wanted)
    last = F.coalesce(F.max(F.when(taken, F.col("cell"))), F.lit(-1).cast("long"))
    out = reach.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("whole").alias("whole"), last.alias("last_cell"))
    return out.withColumn("bound", (F.col("last_cell") + 1) * F.lit(1 << 32 - CELLS_BITS)).drop("last_cell")


def copies(docs: DataFrame, seed: str = "mix", weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, fitted: bool = False, size: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs with size, source_size, target and copies under free names; and those names.

    The plan, a row per source, is written first, so that Spark knows its size before it reads docs again: it is broadcast unless it is larger than the
    session lets broadcasts be, and docs are not shuffled; else adaptive execution splits the partition of a hot source.
    """
    names = dict(zip(("size", "draw", "source", "source_size", "target", "whole", "bound", "copies"), fresh(docs, "size", "draw", "plan_source", "source_size", "target", "whole", "bound", "copies"), strict=True))
    sized = docs.withColumns({names["size"]: word_count(named("text")) if size is None else size, names["draw"]: draw(seed, named("doc_id"))})
    few = sized.select(named("source").alias("source"), named(names["draw"]).alias("draw"), named(names["size"]).alias("size"))
    shares = stored(plan(few, weights, share, cap, fitted), "plan")
    shares = shares.select(*[F.col(c).alias(names[c]) for c in ("source", "source_size", "target", "whole", "bound")])
    out = sized.join(shares, named("source").eqNullSafe(named(names["source"])), "left")
    n = named(names["whole"]) + (named(names["draw"]) < named(names["bound"])).cast("long")
    return out.withColumn(names["copies"], n), names


def mix(docs: DataFrame, seed: str = "mix", weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, fitted: bool = False) -> DataFrame:
    """docs with each row as often as the mix takes it; columns as before. Words are counted once, for the plan."""
    out, names = copies(docs, seed, weights, share, cap, fitted)
    (i,) = fresh(out, "copy")
    n = named(names["copies"])
    return out.filter(n > 0).withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*[named(c) for c in docs.columns])


def report(docs: DataFrame, fitted: bool = True, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted) of each row. Texts are read once, for their words."""
    words = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out, names = copies(words, fitted=fitted, size=F.col("size"), **kw)
    n = named(names["copies"])
    return out.select("doc_id", "source", "size", named(names["source_size"]).alias("source_size"), named(names["target"]).alias("target"), (n * F.col("size")).alias("taken"), n.alias("copies"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS varchar), '')), 1, 8))::UBIGINT // 4194304)::INT AS cell FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[rank % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most FROM r),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(most, max(level) OVER () * weight) AS target FROM l),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT source, cell, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
m AS (SELECT p.*, c.cell, (sum(c.words) OVER (PARTITION BY c.source ORDER BY c.cell))::DOUBLE - c.words / 2.0::DOUBLE AS middle FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source, source_size, target, whole, coalesce(max(cell) FILTER (target > whole * source_size AND middle <= target - whole * source_size), -1) AS last_cell FROM m GROUP BY ALL)
SELECT doc_id, d.source, size, source_size, target, size * (whole + CASE WHEN cell <= last_cell THEN 1 ELSE 0 END) AS taken,
  whole + CASE WHEN cell <= last_cell THEN 1 ELSE 0 END AS copies
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
