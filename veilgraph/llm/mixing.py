"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Targets. Sources, by code point with null last, weigh ``WEIGHTS`` in turn and share the words of all
documents; a target stops at ``CAP`` times its source's size and the excess is shared anew by weight
until none is above (one pass over the sources by the weight at which each fills up).

Demand. A source's schedule gives its weight over training time, as straight lines between evenly spaced
knots. Its integral, scaled to the source's target, is the demand up to a time. The source's documents
stand one after the other by a hash of their id and text, and start over at the end; the word at the middle of a
document is demanded at the time that the inverse of the integral gives, which is the document's position. A document
is taken as often as it ends within the target; the one document whose size best closes the remaining gap is
taken once more, so a source misses its target by less than half of that document's size at most.

No source is sorted in one task: documents are dealt by (source, leading digits of their hash), and running sums of
the cells' sizes place each cell. Only one row per source meets in one place.

Cases: a null text has size 0; a null source is a source; rows with one id are separate documents, and rows that are alike in id and text are interchangeable; a document or source
without words is taken as often as its neighbours, at no cost; an empty table gives an empty result; extra columns
are kept by ``mix`` whatever their names, and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.ordered import numbered, running_sums
from veilgraph.llm.rows import plainly, with_keys
from veilgraph.plans.workspace import hold

WEIGHTS, CAP = (5, 2, 1), 3
#: Weight over training time at evenly spaced knots, for the sources of each weight in turn: heavy ones early, light ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Leading hexadecimal digits of a document's hash that name its cell, at the least, and the documents of one source that a cell is to hold at the most.
DIGITS, CELL_ROWS = 3, 1 << 18
WORDS = "[^\\\\x20\\\\x09-\\\\x0D]+"


def _integrals(schedule) -> list[float]:
    """The share of the whole demand up to each knot."""
    if len(schedule) < 2 or min(schedule) < 0 or sum(schedule) <= 0:
        raise ValueError("a schedule has two knots or more, none negative, not all zero")
    out = [0.0]
    for a, b in zip(schedule, schedule[1:], strict=False):
        out.append(out[-1] + (a + b) / 2)
    return [x / out[-1] for x in out]


def when_demanded(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """The training time in [0, 1] at which a source of this kind has had ``share`` of its demand."""
    if len({len(s) for s in schedules}) != 1:
        raise ValueError("schedules have equally many knots")
    steps = len(schedules[0]) - 1
    sums = [_integrals(s) for s in schedules]
    density = []  # weight per step, of the whole demand
    for s, c in zip(schedules, sums, strict=True):
        area = sum((a + b) / 2 for a, b in zip(s, s[1:], strict=False))
        density.append([x / area for x in s])
        assert abs(c[-1] - 1) < 1e-12
    at = lambda table, i: F.get(F.get(F.lit(table), kind), i)
    step = sum((F.when(share >= at(sums, F.lit(i)), 1).otherwise(0) for i in range(1, steps)), F.lit(0))
    rest = F.greatest(share - at(sums, step), F.lit(0.0))
    a, b = at(density, step), at(density, step + 1)
    root = F.sqrt(F.greatest(a * a + 2 * (b - a) * rest, F.lit(0.0)))
    within = F.coalesce(2 * rest / F.nullif(a + root, F.lit(0.0)), F.lit(0.0))
    return F.least((step + F.least(within, F.lit(1.0))) / F.lit(float(steps)), F.lit(1.0))


def targets(totals: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, kind, target) of (source, source_size): one row per source, in ranges, as sources may be many."""
    ordered = numbered(totals.select("source", "source_size"), [F.col("source").asc_nulls_last()], name="place")
    weighed = ordered.withColumn("kind", (F.col("place") % len(weights)).cast("int")).drop("place")
    weighed = weighed.withColumn("weight", F.get(F.lit([float(w) for w in weights]), F.col("kind"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    weighed = hold(weighed.withColumn("fills", F.col("most") / F.col("weight")))  # the share of a unit of weight at which it is full
    whole = weighed.agg(F.sum("source_size").cast("double").alias("all"), F.sum("weight").alias("weight")).first()
    steps = running_sums(weighed.groupBy("fills").agg(F.sum("most").alias("most"), F.sum("weight").alias("weight")), "fills", ["most", "weight"])
    level = (F.lit(whole["all"] or 0.0) - (F.col("cum_most") - F.col("most"))) / (F.lit(whole["weight"] or 0.0) - F.col("cum_weight") + F.col("weight"))
    # the first that the level doesn't fill, and the level there: all before it are full
    last = steps.withColumn("level", level).where("fills > level").agg(F.min(F.struct("fills", "level")).alias("least")).first()["least"]
    target = F.col("most") if last is None else F.when(F.col("fills") < last["fills"], F.col("most")).otherwise(F.least("most", F.col("weight") * F.lit(last["level"])))
    return weighed.select("source", "source_size", "kind", target.alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = CAP, schedules=SCHEDULES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, positions), one row per row of ``docs``; positions has one training position in [0, 1] per copy."""
    if len(schedules) != len(weights) or min(weights) <= 0:
        raise ValueError("weights are positive, with a schedule each")
    source = F.col(source_col).cast("string")
    text = F.md5(F.col(text_col).cast("binary"))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.coalesce(text, F.lit("")))).alias("hash"),
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("key"),  # joins need it not null
        F.expr(f"coalesce(regexp_count(`{text_col}`, '{WORDS}'), 0)").cast("long").alias("size"),
    )
    base = hold(base)
    digits = DIGITS  # more for larger tables, so that a cell stays about as large
    while base.count() >> 4 * digits > CELL_ROWS:
        digits += 1
    base = base.withColumn("cell", F.substring("hash", 1, digits))
    cells = hold(base.groupBy("key", "cell").agg(F.sum("size").alias("words")))
    totals = cells.groupBy("key").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("key") != "", F.expr("substring(key, 2)")))
    goals = targets(totals, weights, cap)
    goals = goals.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), "source_size", "kind", "target",
        F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long").alias("rounds"),
    )
    goals = hold(goals.withColumn("last", F.col("target") - F.col("rounds") * F.col("source_size")))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = hold(cells.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(goals, "key"))
    inside = Window.partitionBy("key", "cell").orderBy("hash", F.col("doc_id").asc_nulls_last(), "size")
    rows = base.withColumn("place", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.drop("hash").join(placed, ["key", "cell"]).withColumn("upto", F.col("upto") + F.col("offset")).drop("offset")
    rows = hold(rows.withColumn("more", (F.col("last") > 0) & (F.col("upto") <= F.col("last"))))
    # a source's gap is known once its last document that fits is; the cells carry it, so that no source meets in one task
    gaps = rows.groupBy("key").agg((F.max("last") - F.coalesce(F.max(F.when(F.col("more"), F.col("upto"))), F.lit(0))).alias("gap"))
    gaps = hold(cells.select("key", "cell").join(gaps, "key"))
    candidates = rows.where("not more and size > 0").join(gaps, ["key", "cell"]).where(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
    nearest = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "cell", "place"))
    closing = hold(candidates.groupBy("key").agg(nearest.alias("best")).select("key", "best.cell", "best.place", F.lit(True).alias("closes")))
    taken = rows.join(closing, ["key", "cell", "place"], "left").withColumn("closes", F.coalesce("closes", F.lit(False)))
    taken = taken.withColumn("copies", (F.col("rounds") + F.when(F.col("more") | F.col("closes"), 1).otherwise(0)).cast("int"))
    share = lambda e: (F.col("upto") - F.col("size") / F.lit(2.0) + e * F.col("source_size")) / F.nullif(F.greatest("target", F.lit(0.0)), F.lit(0.0))
    times = F.transform(
        F.sequence(F.lit(0), F.col("copies") - 1),
        lambda e: F.round(when_demanded(F.least(F.coalesce(share(e), F.lit(0.0)), F.lit(1.0)), F.col("kind"), schedules), 6),
    )
    return taken.select(
        "doc_id", F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("source"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        F.when(F.col("copies") > 0, times).otherwise(F.array().cast("array<double>")).alias("positions"),
    )


def in_order(planned: DataFrame) -> DataFrame:
    """``planned`` with each document's first position, range-sorted by it; documents that aren't taken last."""
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return planned.withColumn("position", F.get("positions", F.lit(0))).repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = CAP, schedules=SCHEDULES) -> DataFrame:
    """``docs`` as the training order has them: one row per copy, range-sorted by position. Where ids are null or repeat, rows are planned by their number (``with_keys``) instead."""
    plain, names = plainly(docs)
    text, source = names[text_col], names[source_col]
    keyed = with_keys(plain, names[id_col], [text, source], "key")
    order = plan(keyed, "key", text, source, weights, cap, schedules).where("copies > 0").select(F.col("doc_id").alias("key"), F.explode("positions").alias("at"))
    joined = keyed.join(order, "key")
    return joined.repartitionByRange("at", "key").sortWithinPartitions("at", "key").select(*plain.columns).toDF(*docs.columns)


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(concat(coalesce(doc_id::VARCHAR, ''), ' ', coalesce(md5(text), ''))) AS h
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 AS kind FROM totals
), w AS (
  SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS most FROM k
), f AS (
  SELECT *, row_number() OVER g AS place,
         coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM w WINDOW g AS (ORDER BY most / weight, encode(source) NULLS LAST)
), l AS (
  SELECT *, (total - filled) / open AS level, most <= weight * ((total - filled) / open) AS is_full FROM f
), goals AS (
  SELECT source, source_size, kind, CASE WHEN is_full THEN most ELSE least(most, weight * (SELECT arg_min(level, place) FROM l WHERE NOT is_full)) END AS target FROM l
), r AS (
  SELECT d.*, g.source_size, g.kind, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS rounds,
         sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size) AS place
  FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), m AS (
  SELECT *, target - rounds * source_size AS last, (target - rounds * source_size) > 0 AND upto <= target - rounds * source_size AS more FROM r
), gaps AS (
  SELECT source, max(last) - coalesce(max(CASE WHEN more THEN upto END), 0) AS gap FROM m GROUP BY source
), closing AS (
  SELECT m.source, arg_min(m.place, (abs(m.size - gap), m.place)) AS place
  FROM m JOIN gaps ON m.source IS NOT DISTINCT FROM gaps.source
  WHERE NOT more AND size > 0 AND abs(m.size - gap) < gap GROUP BY m.source
)
, t AS (
  SELECT m.*, (m.rounds + (m.more OR c.place IS NOT NULL)::INT)::INT AS copies,
         least(coalesce((m.upto - m.size / 2.0::DOUBLE) / nullif(m.target, 0), 0), 1) AS share,
         [0.625::DOUBLE, 0.5, 0.375][m.kind + 1] AS half, [0.75::DOUBLE, 0.5, 0.25][m.kind + 1] AS early, [0.25::DOUBLE, 0.5, 0.75][m.kind + 1] AS late
  FROM m LEFT JOIN closing c ON m.source IS NOT DISTINCT FROM c.source AND m.place = c.place
), s AS (
  SELECT *, (share >= half)::INT AS step, greatest(CASE WHEN share >= half THEN share - half ELSE share END, 0) AS rest,
         CASE WHEN share >= half THEN 0.5::DOUBLE ELSE early END AS a, CASE WHEN share >= half THEN late ELSE 0.5::DOUBLE END AS b
  FROM t
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies,
       CASE WHEN copies > 0 THEN round(least((step + least(2 * rest / (a + sqrt(greatest(a * a + 2 * (b - a) * rest, 0))), 1)) / 2.0::DOUBLE, 1), 6) END AS position
FROM s
"""
