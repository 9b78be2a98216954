"""Filter interaction audit: what each filter removes, in every order of the filters.

1. Rows get numbers of their own and are written once with their part and marks; each filter's failing
   row numbers are stored as a table of their own.
2. Only the set of filters applied before matters for a step, not their order. Level by level, survivors
   of a set are asked for each filter that is left: a left-semi join with the failing numbers gives the
   removals, a left-anti join the survivors of the larger set (each set is reached once, by its letters
   in order).
3. Counts per (part, set, filter) are turned into one row per part, order and step.

Rows that fail nothing survive every order, so they are counted once and take no part in the joins.
Joins are on (filter, row number), which no hot text, id or source can skew; what is counted is
aggregated before it is shuffled. Nothing is broadcast but the list of orders, whose size is fixed.

Defined results: null texts are empty and fail like empty ones; a null source is the part ''; rows
with a null id are rows like others, but no id is smaller than null and null is smaller than no id, so they
neither fail the copy filter nor make others fail it; repeated rows count one by one (with one id they
are no copies of each other); a label counts as set when any row of that id sets it; null labels
and labels of null ids are not set; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import stored

SPACES = r"[\x20\x09-\x0D]+"
# Fixed values of the five filters: words, distinct share, upper-case share (per cent), symbols.
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 2, r"[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails the filters A to D."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > MAX_UPPER * F.length(text).cast("long"),
        "D": F.regexp_like(text, F.lit(SYMBOLS)),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """Numbers of the rows whose text also stands under a smaller id; texts are compared by SHA-256."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = first.filter(F.col("first") < F.col("last")).select(F.col("digest").alias("same"), "first")
    # Written, so that the join is a stage of its own, whose hot digests adaptive execution can split.
    first = stored(first, "copies")
    return rows.join(first, (F.col("digest") == F.col("same")) & (F.col("doc_id") > F.col("first")), "left_semi").select("row")


def removals(rows: DataFrame, fails: dict[str, DataFrame], marks: list[str]) -> DataFrame:
    """Counts for every set of filters applied before, as a bit mask ``before``.

    ``rows`` has ``row``, ``part`` and 0/1 ``marks``; ``fails`` has the failing row numbers of each
    filter. Returns (part, before, filter, removed, one column per mark) without zero rows; with filter
    null, ``removed`` is the number of survivors of that set.
    """
    letters = list(fails)
    failing = reduce(DataFrame.unionByName, [t.select(F.lit(k).cast("byte").alias("filter"), "row") for k, t in enumerate(fails.values())])
    state = stored(rows.join(failing.select("row").distinct(), "row", "left_semi").withColumn("before", F.lit(0)), "survivors")
    found = []
    for level in range(len(letters)):
        found.append(state.groupBy("part", "before", F.lit(None).cast("byte").alias("filter")))
        left = F.expr(f"filter(transform(sequence(0, {len(letters) - 1}), k -> cast(k as byte)), k -> shiftright(before, k) % 2 = 0)")
        asked = state.withColumn("filter", F.explode(left))
        gone = asked.join(failing, ["filter", "row"], "left_semi")
        found.append(gone.groupBy("part", "before", "filter"))
        if level == len(letters) - 1:
            break
        # Only letters after the last one, so that each set is reached once.
        bit = F.expr("shiftleft(1, filter)")
        onward = asked.filter(bit > F.col("before")).join(failing, ["filter", "row"], "left_anti")
        # Written, so that no level is computed again for the next ones.
        state = stored(onward.withColumn("before", F.col("before") + bit).drop("filter"), "survivors")
    counted = [g.agg(F.count("*").alias("removed"), *[F.sum(m).alias(m) for m in marks]) for g in found]
    return reduce(DataFrame.unionByName, counted)


def audit(rows: DataFrame, fails: dict[str, DataFrame], marks: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included (see ``op13`` for the counts).

    ``<mark>`` counts the marked among the removed. Meant for a handful of filters: all orders are listed.
    """
    letters = list(fails)
    counted = stored(removals(rows, fails, marks), "removals")
    removed = counted.filter("filter is not null")
    alive = counted.filter("filter is null").select("part", "before", F.col("removed").alias("alive"))
    parts = rows.groupBy("part").agg(F.count("*").alias("rows"))
    failed = alive.filter("before = 0").select("part", F.col("alive").alias("failed"))
    parts = parts.join(failed, "part", "left").select("part", (F.col("rows") - F.coalesce("failed", F.lit(0))).alias("untouched"))

    steps = [f"struct({s} as before, {k}Y as filter)" for s in range(1 << len(letters)) for k in range(len(letters)) if not s >> k & 1]
    cells = parts.select("part", "untouched", F.expr(f"inline(array({', '.join(steps)}))"))
    counts = cells.join(removed, ["part", "before", "filter"], "left").join(alive, ["part", "before"], "left")
    counts = counts.fillna(0, ["removed", "alive", *marks])
    orders_with = F.lit(0)
    for size in range(len(letters)):
        times = factorial(size) * factorial(len(letters) - 1 - size)
        orders_with = F.when(F.bit_count("before") == size, F.lit(times)).otherwise(orders_with)
    whole = counts.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.bit_count("before") == len(letters) - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders_with).alias("shapley"),
    )
    counts = counts.join(whole, ["part", "filter"])

    listed = []
    for order in permutations(range(len(letters))):
        name = "".join(letters[k] for k in order)
        listed += [(name, i + 1, sum(1 << k for k in order[:i]), k) for i, k in enumerate(order)]
    orders = rows.sparkSession.createDataFrame(listed, "filter_order string, step int, before int, filter byte")
    return counts.join(F.broadcast(orders), ["before", "filter"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("untouched") + F.col("alive") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        *marks,
        "shapley",
    )


def marked(rows: DataFrame, labels: DataFrame, marks: dict[str, str]) -> DataFrame:
    """The rows with one 0/1 column per mark: whether a label row of their id sets the label to 1."""
    set_ = [F.max((F.col(label) == 1).cast("long")).alias(name) for name, label in marks.items()]
    known = labels.filter(F.col("doc_id").isNotNull() & reduce(Column.__or__, [F.col(x) == 1 for x in marks.values()]))
    return rows.join(known.groupBy("doc_id").agg(*set_), "doc_id", "left").fillna(0, list(marks))


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters in all 120 orders, per source.

    kept: rows left after the step; removed: rows it removes; redundant: rows that fail its filter but
    were removed earlier; unique_fails: rows that fail no other; good_lost and toxic_lost: removed rows with that label;
    shapley: the filter's removals summed over all orders.
    """
    text = F.coalesce("text", F.lit(""))
    conditions = text_filters(text)
    read = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        *[c.alias(f"fails_{k}") for k, c in conditions.items()],
    )
    # Row numbers depend on the partitions read; from here on they are what was written.
    read = stored(read, "audited")
    fails = {k: stored(read.filter(f"fails_{k}").select("row"), f"fails_{k}") for k in conditions}
    fails["E"] = stored(later_copies(read), "fails_E")
    marks = {"good_lost": "quality", "toxic_lost": "toxic"}
    rows = stored(marked(read.select("row", "doc_id", "part"), labels, marks).select("row", "part", *marks), "rows")
    return audit(rows, fails, list(marks))


ORACLE = rf"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id
), f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(ws) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end
    || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when d.doc_id > min(d.doc_id) over (partition by text) then 'E' else '' end as failed
  from d left join marks on marks.doc_id = d.doc_id
), classes as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
orders as (
  select a || b || c || e || g as filter_order from (values ('A'), ('B'), ('C'), ('D'), ('E')) t1(a), (values ('A'), ('B'), ('C'), ('D'), ('E')) t2(b),
    (values ('A'), ('B'), ('C'), ('D'), ('E')) t3(c), (values ('A'), ('B'), ('C'), ('D'), ('E')) t4(e), (values ('A'), ('B'), ('C'), ('D'), ('E')) t5(g)
  where len(list_distinct([a, b, c, e, g])) = 5
), steps as (
  select filter_order, step, substr(filter_order, step, 1) as letter, substr(filter_order, 1, step - 1) as earlier
  from orders, (values (1), (2), (3), (4), (5)) s(step)
), met as (
  select part, filter_order, step, letter, n, good, toxic,
    contains(failed, letter) as fails, failed = letter as sole,
    earlier <> '' and regexp_matches(failed, '[' || case when earlier = '' then 'Z' else earlier end || ']') as gone
  from steps, classes
), counted as (
  select part, filter_order, step, letter,
    sum(case when not gone and not fails then n else 0 end) as kept,
    sum(case when not gone and fails then n else 0 end) as removed,
    sum(case when gone and fails then n else 0 end) as redundant,
    sum(case when sole then n else 0 end) as unique_fails,
    sum(case when not gone and fails then good else 0 end) as good_lost,
    sum(case when not gone and fails then toxic else 0 end) as toxic_lost
  from met group by all
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from counted
"""
