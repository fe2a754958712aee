"""Mixing sources to target weights, in DataFrame functions only.

Rows hang in a tree of domain, language and source. A token budget goes down the tree by weight; a child that cannot
take its share leaves the rest to its siblings, and what a whole family cannot take goes back to its
parent's siblings, since a family's capacity is the sum of its leaves'. A leaf spends its budget on whole
epochs of its documents and on a prefix of the next one, in an order that seed, epoch and id decide. Where the prefix
ends is found by halving in many: sums of a leaf's slices tell the slice in which it ends, and that one is sliced again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .storage import count_words, materialize, owner, without

#: Documents in a slice of a leaf's order, about, and most slices of a leaf at a time.
SLICE_ROWS, MAX_SLICES = 256, 32_768
#: A plan of so many leaves is a few MB and may be broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_LEAVES = 50_000
LEVELS = ["mix_domain", "mix_lang", "mix_source"]


@dataclass(frozen=True)
class Weights:
    """Whole-number weights among siblings, by name; names that are not listed weigh `other`."""

    domain: dict[str, int] = field(default_factory=dict)
    language: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1

    def of(self, level: int) -> Column:
        given = (self.domain, self.language, self.source)[level]
        out = F.lit(self.other)
        for name, weight in sorted(given.items()):
            out = F.when(F.col(LEVELS[level]) == name, F.lit(weight)).otherwise(out)
        return out.cast("long")


DEFAULT_WEIGHTS = Weights({"web": 5, "books": 3, "code": 2}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {"src0": 3})


def default_domain(source: str = "source") -> Column:
    """web, books or code by the number that ends a source's name; other without one."""
    number = F.regexp_extract(F.col(source), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), (number.cast("int") % 3 + 1).cast("int")))


def word_count(text: str = "text") -> Column:
    return count_words(F.col(text), r"[\x20\x09-\x0D]+")


def _shares(nodes: DataFrame, parents: list[str], budget: Column) -> DataFrame:
    """nodes with `given`: the budget of its parent that each takes, by water-filling.

    With siblings in the order of capacity over weight, let a node's level be the parent's budget less the capacities before
    it, over the weights from it on. Levels rise while nodes are filled and fall after, so the highest is the one at which all is spent.
    """
    family = Window.partitionBy(*parents)
    order = family.orderBy(F.col("capacity") / F.col("weight"), *LEVELS[: len([p for p in parents if p in LEVELS]) + 1])
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = nodes.withColumn("_level", (budget - before).cast("double") / onward)
    high = F.max("_level").over(family)
    return level.withColumn("given", F.floor(F.least(F.col("capacity").cast("double"), F.greatest(F.lit(0.0), F.col("weight") * high))).cast("long")).drop("_level")


def budgets(leaves: DataFrame, weights: Weights, total: Column, max_epochs: int) -> DataFrame:
    """leaves (LEVELS, supply, rows) with `given` tokens each; names of weight 0 get none."""
    leaves = leaves.withColumn("capacity", F.col("supply") * max_epochs).where("capacity > 0")
    held = leaves
    for level in range(3):
        held = held.withColumn(f"w{level}", weights.of(level))
    held = held.where("w0 > 0 and w1 > 0 and w2 > 0")
    nodes = held.groupBy("mix_domain").agg(F.sum("capacity").alias("capacity"), F.max("w0").alias("weight"))
    given = _shares(nodes.withColumn("_all", F.lit(0)), ["_all"], total).select("mix_domain", F.col("given").alias("b0"))
    nodes = held.groupBy("mix_domain", "mix_lang").agg(F.sum("capacity").alias("capacity"), F.max("w1").alias("weight")).join(given, "mix_domain")
    given = _shares(nodes, ["mix_domain"], F.col("b0")).select("mix_domain", "mix_lang", F.col("given").alias("b1"))
    nodes = held.withColumn("weight", F.col("w2")).join(given, ["mix_domain", "mix_lang"])
    return _shares(nodes, ["mix_domain", "mix_lang"], F.col("b1")).select(*LEVELS, "supply", "rows", "given")


def _ends(rows: DataFrame, slice_: Column, name: str) -> DataFrame:
    """For each leaf of rows (LEVELS, n, left): the slice in which a prefix of `left` tokens ends, what is left at its start, and its rows."""
    sums = rows.groupBy(*LEVELS, slice_.alias(name)).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("left").alias("left"))
    through = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy(name))
    over = sums.withColumn("through", through).where("through > left")
    first = over.groupBy(*LEVELS).agg(F.min(F.struct(name, (F.col("left") - F.col("through") + F.col("n")).alias("left"), "rows")).alias("e"))
    return first.select(*LEVELS, f"e.{name}", "e.left", F.least(F.ceil(F.col("e.rows") / SLICE_ROWS), F.lit(MAX_SLICES)).cast("long").alias("k"))


@owner
def mix(df: DataFrame, weights: Weights = DEFAULT_WEIGHTS, percent: int = 100, max_epochs: int = 4, seed: int = 23,
        domain: Column | None = None, tokens: Column | None = None, lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", crossing: bool = False) -> DataFrame:
    """The chosen rows of df with domain, n_tokens and epochs (how often the row is taken, 1 or more).

    The budget is percent of all tokens; a row is taken max_epochs times at most. A null language or source counts as the
    empty name, and a null id as the empty one; rows without tokens are never taken. Each node's budget is rounded down to whole tokens,
    and a leaf's prefix ends before the document that would exceed its budget, or with it if crossing is set. Rows equal in id have equal places in the
    order, and ties are taken in any order. Input columns named like an added one are replaced; others may have any name. No slice of
    a hot leaf, or of the rows that share an id, is sorted but the small ones in which prefixes end. An empty table gives no rows.
    """
    own = without(df, ["domain", "n_tokens", "epochs"])
    rows = own.select(
        F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"), (tokens if tokens is not None else word_count()).alias("n"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.monotonically_increasing_id().alias("nth"),
        F.coalesce(domain if domain is not None else default_domain(source_col), F.lit("")).alias("mix_domain"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("mix_lang"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("mix_source"),
    ).where("n > 0")
    rows, _ = materialize(rows, "mix")
    leaves, _ = materialize(rows.groupBy(*LEVELS).agg(F.sum("n").alias("supply"), F.count(F.lit(1)).alias("rows")), "leaves")
    total = F.lit((leaves.agg(F.sum("supply").alias("n")).first()["n"] or 0) * percent // 100)
    plan = budgets(leaves, weights, total, max_epochs).where("given > 0")
    plan = plan.select(*LEVELS, F.expr("given div supply").alias("whole"), F.expr("given % supply").alias("left"), F.least(F.ceil(F.col("rows") / SLICE_ROWS), F.lit(MAX_SLICES)).cast("long").alias("k1"))
    plan, _ = materialize(plan, "plan")
    small = F.broadcast if plan.count() <= MAX_BROADCAST_LEAVES else (lambda x: x)

    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("whole").cast("string"), F.lit(":"), F.col("id")))
    place = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")  # the first 8 hex digits cut the order into even slices
    salt = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "nth"), 32)

    def placed(of: DataFrame) -> DataFrame:
        return of.join(small(plan), LEVELS).withColumn("order", order)

    def sliced(*factors: str) -> Column:
        return F.floor(place * F.expr(" * ".join(factors)) / F.lit(1 << 32)).cast("long")

    slices = [("e1", sliced("k1")), ("e2", sliced("k1", "k2")), ("e3", F.col("order")), ("e4", F.floor(salt * F.col("k4") / F.lit(1 << 32)).cast("long"))]
    narrow = rows.select("n", "id", "nth", *LEVELS)
    for i, (name, by) in enumerate(slices):
        # every leaf has an end, as what is left is below its supply
        inside = placed(narrow)
        for end, before in slices[:i]:
            inside = inside.where(before == F.col(end))
        ends = _ends(inside, by, name).withColumnRenamed("k", f"k{i + 2}")
        plan, _ = materialize(plan.drop("left").join(ends, LEVELS), "plan")
    taken, edge = F.lit(False), F.lit(True)
    for end, by in reversed(slices):
        taken = (by < F.col(end)) | ((by == F.col(end)) & taken)
        edge = (by == F.col(end)) & edge
    at = placed(rows).withColumn("edge", edge)
    clear = at.where(~F.col("edge")).withColumn("epochs", F.col("whole") + F.when(taken, 1).otherwise(0))
    running = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = (running - F.col("n") < F.col("left")) if crossing else (running <= F.col("left"))
    last = at.where("edge").withColumn("epochs", F.col("whole") + F.when(within, 1).otherwise(0))
    return clear.unionByName(last).where("epochs > 0").select("row.*", F.col("mix_domain").alias("domain"), F.col("n").alias("n_tokens"), "epochs")


def digest(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "lang", "source", word_count().alias("words"))
    return mix(rows, tokens=F.col("words")).select("doc_id", "domain", "lang", "source", "n_tokens", "epochs")


#: mix() with its default parameters over documents.
ORACLE = r"""
with docs as (
  select doc_id, lang, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as n_tokens,
    case when regexp_extract(source, '([0-9]{1,9})$', 1) = '' then 'other'
      else (['web', 'books', 'code'])[(regexp_extract(source, '([0-9]{1,9})$', 1)::int % 3) + 1] end as d0
  from documents),
r as (select doc_id, lang, source, n_tokens, coalesce(d0, '') as d, coalesce(lang, '') as l, coalesce(source, '') as s from docs where n_tokens > 0),
leaf as (
  select d, l, s, sum(n_tokens)::bigint as supply, sum(n_tokens)::bigint * 4 as capacity,
    case d when 'web' then 5 when 'books' then 3 when 'code' then 2 else 1 end as w0,
    case l when 'en' then 6 when 'de' then 2 when 'fr' then 2 else 1 end as w1,
    case s when 'src0' then 3 else 1 end as w2
  from r group by d, l, s),
n0 as (select d, sum(capacity)::bigint as capacity, max(w0)::bigint as w, (select sum(supply)::bigint from leaf) as b from leaf group by d),
v0 as (select *, (b - coalesce(sum(capacity) over (order by capacity / w, d rows between unbounded preceding and 1 preceding), 0))::double
  / sum(w) over (order by capacity / w, d rows between current row and unbounded following) as v from n0),
g0 as (select d, floor(least(capacity::double, greatest(0.0::double, w * max(v) over ())))::bigint as b from v0),
n1 as (select leaf.d, l, sum(capacity)::bigint as capacity, max(w1)::bigint as w, max(g0.b) as b from leaf join g0 on leaf.d = g0.d group by leaf.d, l),
v1 as (select *, (b - coalesce(sum(capacity) over (partition by d order by capacity / w, d, l rows between unbounded preceding and 1 preceding), 0))::double
  / sum(w) over (partition by d order by capacity / w, d, l rows between current row and unbounded following) as v from n1),
g1 as (select d, l, floor(least(capacity::double, greatest(0.0::double, w * max(v) over (partition by d))))::bigint as b from v1),
n2 as (select leaf.d, leaf.l, s, supply, capacity, w2::bigint as w, g1.b from leaf join g1 on leaf.d = g1.d and leaf.l = g1.l),
v2 as (select *, (b - coalesce(sum(capacity) over (partition by d, l order by capacity / w, d, l, s rows between unbounded preceding and 1 preceding), 0))::double
  / sum(w) over (partition by d, l order by capacity / w, d, l, s rows between current row and unbounded following) as v from n2),
g2 as (select d, l, s, supply, floor(least(capacity::double, greatest(0.0::double, w * max(v) over (partition by d, l))))::bigint as given from v2),
plan as (select d, l, s, given // supply as whole, given % supply as rest from g2 where given > 0),
o as (select r.*, whole, rest, sum(n_tokens) over (partition by r.d, r.l, r.s
    order by md5('23:' || whole::varchar || ':' || coalesce(doc_id::varchar, '')), doc_id rows between unbounded preceding and current row) as run
  from r join plan on r.d = plan.d and r.l = plan.l and r.s = plan.s)
select doc_id, d as domain, lang, source, n_tokens, (whole + case when run <= rest then 1 else 0 end)::bigint as epochs
from o where whole + case when run <= rest then 1 else 0 end > 0
"""
