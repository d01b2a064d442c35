"""Mixing sources to target weights by hierarchical budgets, in DataFrame expressions only.

A budget of tokens flows down a domain - language - source tree. Siblings share
their parent's budget by weight; one whose subtree can't use its share (a leaf can
give its tokens once in each of ``epochs`` epochs) gets what it can use, and the
rest goes to its siblings by their weights. As a parent never gets more than its
subtree can use, shortages are met among siblings before an ancestor's other
branches. Each leaf then takes whole epochs, and of one more epoch the longest
prefix of documents that fits, in the seeded order of md5(seed:epoch:doc_id).

A leaf's prefix is found by digits of that order: token sums by two hex digits,
then by the next two within the digits where the budget ends, until a handful of
documents is left, so no leaf is sorted or gathered, however large. Documents of equal
md5 (no id, a repeated id) are told apart by further digits: their tokens, then a
number of their own, mixed. Digits that all undecided documents share are skipped.

Defined results: a null text has no tokens; null lang and source are "none"; every
node needs a positive weight (``default`` if it has no own); shares are rounded
down; a budget above what the tree can give is cut to that; documents without
tokens are in a prefix if the one before them is; rows with equal doc_id and tokens are
interchangeable, each counts; a very long text is one document, taken whole or not at
all; an empty table gives an empty result; extra columns are ignored unless carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, materialize, table

LEVELS = ("domain", "lang", "source")
#: Documents of a leaf that one task may order by itself.
LAST_ROWS = 10_000
#: Digits of a document's order: md5, tokens, own number.
KEY_DIGITS = 32 + 16 + 16


@dataclass
class Plan:
    """Weights by level and name, the budget as a share of all tokens, epochs and seed."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default: int = 1
    budget: float = 1.0
    epochs: int = 1
    seed: int = 1


def tokens(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The trailing number of a source's name modulo 4, as d0 ... d3 (d0 without a number)."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), (F.when(number == "", F.lit(0)).otherwise(number.try_cast("int")) % 4).cast("string"))


def _weight(level: str, plan: Plan) -> Column:
    known = plan.weights.get(level, {})
    out = F.lit(plan.default)
    for name, w in known.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Adds ``alloc`` to siblings with cap, weight and the parent's budget: water-filling by weight."""
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    by = of.orderBy(F.col("cap").cast("double") / F.col("weight"), level)
    nodes = nodes.withColumn("before", F.sum("cap").over(by) - F.col("cap")).withColumn("heavy", F.sum("weight").over(of) - F.sum("weight").over(by) + F.col("weight"))
    full = F.col("before").cast("double") + F.col("cap").cast("double") * F.col("heavy") / F.col("weight") <= F.col("budget").cast("double")
    nodes = nodes.withColumn("full", full)
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(of)
    open_ = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(of)
    alloc = F.when(F.col("full"), F.col("cap")).otherwise(F.floor(left.cast("double") * F.col("weight") / open_))
    return nodes.withColumn("alloc", alloc.cast("long")).drop("before", "heavy", "full", "budget", "weight")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds epoch (whole epochs taken) and rest (tokens left for one more)."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    nodes = leaves.withColumn("cap", F.col("tokens") * plan.epochs)
    budget = F.lit(min(int(total * plan.budget), total * plan.epochs)).cast("long")
    parent: list[str] = []
    above = None
    for level in LEVELS:
        own = nodes.groupBy(*parent, level).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, plan))
        own = own.withColumn("budget", budget) if above is None else own.join(above, parent)
        above = share(own, parent, level).drop("cap").withColumnRenamed("alloc", "budget")
        parent = [*parent, level]
    out = leaves.join(above, list(LEVELS))
    epoch = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    return out.withColumn("epoch", epoch).withColumn("rest", F.col("budget") - F.col("epoch") * F.col("tokens")).drop("budget", "tokens")


def _shared_digits(low: Column, high: Column) -> Column:
    """The longest common beginning of two keys."""
    return F.substring(low, F.lit(1), F.array_max(F.filter(F.sequence(F.lit(0), F.lit(KEY_DIGITS)), lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n))))


def mix(docs: DataFrame, plan: Plan, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies of every document, and the columns to ``carry`` as struct ``row``. docs: doc_id, text, lang, source."""
    row = [F.struct(*carry).alias("row")] if carry else []
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    rows = materialize(docs.select(F.col("doc_id").cast("long"), domain_of(none("source")).alias("domain"), none("lang").alias("lang"), none("source").alias("source"), tokens(F.col("text")).alias("n_tokens"), F.monotonically_increasing_id().alias("own"), *row), "mix")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    state = materialize(budgets(leaves, plan).withColumn("edge", F.lit("")), "budgets")
    order = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    key = F.concat(order, *(F.lpad(F.hex(c), 16, "0") for c in (F.col("n_tokens"), F.xxhash64("own"))))
    leaf = list(LEVELS)
    while True:
        # undecided: the documents whose order begins with the digits at which the budget ends
        keyed = attach(rows, state, leaf).withColumn("key", key)
        undecided = keyed.where(F.col("key").startswith(F.col("edge")))
        open_ = materialize(undecided.groupBy(*leaf).agg(F.count("*").alias("n"), _shared_digits(F.min("key"), F.max("key")).alias("shared")), "open")
        if (open_.agg(F.max("n")).first()[0] or 0) <= LAST_ROWS:
            break
        state = state.join(open_, leaf, "left").withColumn("edge", F.coalesce("shared", "edge")).drop("n", "shared")
        keyed = attach(rows, state, leaf).withColumn("key", key)
        undecided = keyed.where(F.col("key").startswith(F.col("edge")))
        digits = F.substring(F.col("key"), F.length("edge") + 1, F.lit(2))
        sums = undecided.groupBy(*leaf, digits.alias("digits")).agg(F.sum("n_tokens").alias("t"))
        by = Window.partitionBy(*leaf).orderBy("digits")
        sums = sums.withColumn("upto", F.sum("t").over(by))
        # the first digits that don't fit; if all fit, an edge above every order
        ends = attach(sums, state, leaf).where(F.col("upto") > F.col("rest")).groupBy(*leaf).agg(F.min(F.struct("digits", (F.col("upto") - F.col("t")).alias("used"))).alias("at"))
        state = materialize(state.join(ends, leaf, "left").select(*leaf, "epoch", (F.col("rest") - F.coalesce("at.used", F.lit(0))).alias("rest"), F.when(F.col("at").isNull(), F.lit("~")).otherwise(F.concat("edge", "at.digits")).alias("edge")), "budgets")
    within = Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    last = undecided.withColumn("taken", F.sum("n_tokens").over(within) <= F.col("rest"))
    clear = keyed.where(~F.col("key").startswith(F.col("edge"))).withColumn("taken", F.col("key") < F.col("edge"))
    return last.unionByName(clear).select("doc_id", *leaf, "n_tokens", (F.col("epoch") + F.col("taken").cast("long")).alias("copies"), *(["row"] if carry else []))


PLAN = Plan(weights={"domain": {"d0": 4, "d1": 3, "d2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 2}}, budget=1.5, epochs=3, seed=17)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """One and a half times all tokens, from at most three epochs of each source."""
    return mix(table(spark, sf_dir, "documents"), PLAN)


def _sql(plan: Plan) -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in plan.weights.get(level, {}).items())
        return f"CAST(CASE {cases} ELSE {plan.default} END AS BIGINT)" if cases else str(plan.default)

    def filled(level: str, parent: list[str], source: str) -> str:
        of = f"PARTITION BY {', '.join(parent)}" if parent else ""
        by = f"{of} ORDER BY CAST(cap AS DOUBLE) / weight, {level}"
        keys = ", ".join([*parent, level])
        return f"""
{level}_a AS (SELECT {keys}, cap, weight, budget, CAST(sum(cap) OVER ({by}) - cap AS BIGINT) AS before, CAST(sum(weight) OVER ({of}) - sum(weight) OVER ({by}) + weight AS BIGINT) AS heavy FROM ({source})),
{level}_b AS (SELECT *, CAST(before AS DOUBLE) + CAST(cap AS DOUBLE) * heavy / weight <= CAST(budget AS DOUBLE) AS is_full FROM {level}_a),
{level}_c AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE CAST(floor(CAST(budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({of}) AS DOUBLE) * weight / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({of})) AS BIGINT) END AS alloc FROM {level}_b)"""

    domain = filled("domain", [], f"SELECT *, {weight('domain')} AS weight, (SELECT CAST(least(trunc(sum(tokens) * {plan.budget!r}), sum(tokens) * {plan.epochs}) AS BIGINT) FROM leaves) AS budget FROM (SELECT domain, CAST(sum(tokens) * {plan.epochs} AS BIGINT) AS cap FROM leaves GROUP BY ALL)")
    lang = filled("lang", ["domain"], f"SELECT n.*, {weight('lang')} AS weight, alloc AS budget FROM (SELECT domain, lang, CAST(sum(tokens) * {plan.epochs} AS BIGINT) AS cap FROM leaves GROUP BY ALL) n JOIN domain_c USING (domain)")
    source = filled("source", ["domain", "lang"], f"SELECT n.*, {weight('source')} AS weight, alloc AS budget FROM (SELECT domain, lang, source, CAST(tokens * {plan.epochs} AS BIGINT) AS cap FROM leaves) n JOIN lang_c USING (domain, lang)")
    return rf"""
WITH named AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
rows_ AS (SELECT *, 'd' || (CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 0 ELSE CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) END % 4) AS domain FROM named),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL),
{domain},
{lang},
{source},
taken AS (SELECT l.*, CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END AS epoch, alloc FROM leaves l JOIN source_c USING (domain, lang, source)),
ordered AS (SELECT r.*, t.epoch, t.alloc - t.epoch * t.tokens AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{plan.seed}:' || t.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM rows_ r JOIN taken t USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ordered"""


ORACLE_SQL = _sql(PLAN)
