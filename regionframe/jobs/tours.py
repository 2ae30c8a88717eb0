"""Queries on trees by their Euler tours: every node's leaves, leaf mean, overlap with a mask, depth and root, from running sums.

Two trees derived from the tables: a chain of merges, as a greedy run can leave it (order after order joins one growing
region, so that the tree is as deep as it is wide), and a forest of customers whose parents lie some numbers ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionframe.functions.linalg import safe_div
from regionframe.operators.tour import depths, leaves, outermost, roots, subtree_sums, tour
from regionframe.sources.cut import cut
from regionframe.sources.tables import table

QUERIES, ORACLES = {}, {}
TENTHS = 9  # of its leaves' mean that a node has to have


def _cents(c: Column) -> Column:
    """An amount in hundredths: sums of integers do not depend on their order."""
    return F.round(c * 100).cast("long")


def chain(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The tree (node, parent) and its leaves (node, value, hit). Leaf k is order k of n; node n + k joins what has been
    merged before with leaf k + 1."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("node")).agg(_cents(F.min("o_totalprice")).alias("value"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("long")).alias("hit"))
    n = F.col("n")
    every = o.select("node").crossJoin(o.agg(F.count("*").alias("n")))
    leaf = every.select("node", F.when(n > 1, n + F.greatest(F.col("node") - 1, F.lit(0))).alias("parent"))
    inner = every.where(F.col("node") < n - 1).select((n + F.col("node")).alias("node"), F.when(F.col("node") < n - 2, n + F.col("node") + 1).alias("parent"))
    return leaf.unionByName(inner), o


def forest(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The forest (node, parent) of customers, and (node, value, hit) of each of them."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("node")).agg(F.min("c_nationkey").alias("nation"), _cents(F.min("c_acctbal")).alias("value"), F.max((F.col("c_mktsegment") == "BUILDING").cast("long")).alias("hit"))
    above = F.col("node") + 1 + (F.col("node") * 7919 + F.col("nation") * 31) % 40
    tree = c.crossJoin(c.agg(F.count("*").alias("n"))).select("node", F.when(above < F.col("n"), above).alias("parent"))
    return tree, c.select("node", "value", "hit")


def described(tree: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tour, and (node, leaves, hits, total, mean, dice, depth, root) of every node."""
    t = tour(tree)
    v = leaves(t).join(values, "node").select("node", F.lit(1).cast("long").alias("leaves"), "hit", "value")
    sums = subtree_sums(t, v, ["leaves", "hit", "value"])
    mask = v.agg(F.sum("hit").alias("mask"))
    out = sums.join(depths(t), "node").join(roots(t), "node").crossJoin(mask)
    return t, out.select("node", "leaves", F.col("hit").alias("hits"), F.col("value").alias("total"), (F.col("value") / F.col("leaves")).alias("mean"), safe_div(2.0 * F.col("hit"), F.col("leaves") + F.col("mask")).alias("dice"), "depth", "root")


def _nodes(of):
    def query(spark, sf_dir):
        _, d = described(*of(spark, sf_dir))
        return d.select("node", "leaves", "hits", "total", "mean", F.round("dice", 8).alias("dice"), "depth", "root")

    return query


def forest_biggest_rep(spark, sf_dir):
    """Nodes whose own value is at least a share of their leaves' mean and that are below no other such node."""
    tree, values = forest(spark, sf_dir)
    t, d = described(tree, values)
    valid = d.join(values, "node").where(10 * F.col("value") * F.col("leaves") >= TENTHS * F.col("total")).select("node")
    return outermost(t, cut(valid)).where("node = top").select("node")


def forest_labels(spark, sf_dir):
    """Each leaf with the highest chosen node over it, one added; 0 is the background. Chosen: every seventh node."""
    t = tour(forest(spark, sf_dir)[0])
    top = outermost(t, t.where("node % 7 = 3").select("node"))
    return leaves(t).select("node").join(top, "node", "left").select("node", F.coalesce(F.col("top") + 1, F.lit(0)).alias("label"))


def forest_best_overlap(spark, sf_dir):
    """The node whose leaves overlap most with the mask by Dice; of equal ones the first."""
    _, d = described(*forest(spark, sf_dir))
    return d.select("node", F.round("dice", 8).alias("dice")).orderBy(F.desc("dice"), "node").limit(1)


QUERIES |= {"chain_nodes": _nodes(chain), "forest_nodes": _nodes(forest), "forest_biggest_rep": forest_biggest_rep, "forest_labels": forest_labels, "forest_best_overlap": forest_best_overlap}
ORACLES["chain_nodes"] = """
with o as (select o_orderkey as k, cast(round(o_totalprice * 100) as bigint) as v, case when o_orderpriority = '1-URGENT' then 1 else 0 end as h from orders),
s as (select count(*) as n, sum(h) as mask from o),
r as (select k, v, h, sum(v) over w as total, sum(h) over w as hits from o window w as (order by k rows unbounded preceding)),
x as (select k as node, 1 as leaves, h as hits, v as total, case when k = 0 then n - 1 else n - k end as depth from r, s
  union all select n + k - 1, k + 1, hits, total, n - 1 - k from r, s where k > 0)
select node, cast(leaves as bigint) as leaves, cast(hits as bigint) as hits, cast(total as bigint) as total, cast(total as double) / leaves as mean, round(2.0 * hits / (leaves + mask), 8) as dice, cast(depth as bigint) as depth, 2 * n - 2 as root from x, s"""
_FOREST_SQL = f"""
c as materialized (select c_custkey as node, cast(round(c_acctbal * 100) as bigint) as v, case when c_mktsegment = 'BUILDING' then 1 else 0 end as h, c_custkey + 1 + (c_custkey * 7919 + c_nationkey * 31) % 40 as above from customer),
t as materialized (select node, v, h, case when above < (select count(*) from c) then above end as parent from c),
up as (select node, node as anc, cast(0 as bigint) as steps from t union all select u.node, t.parent, u.steps + 1 from up u join t on t.node = u.anc where t.parent is not null),
leaf as (select node, v, h from t where node not in (select parent from t where parent is not null)),
d as (select anc as node, count(*) as leaves, sum(h) as hits, sum(v) as total, 2.0 * sum(h) / (count(*) + (select sum(h) from leaf)) as dice from up join leaf using (node) group by anc),
e as (select node, max(steps) as depth, max(anc) as root from up group by node),
valid as (select d.node from d join t using (node) where 10 * t.v * leaves >= {TENTHS} * total),
label as (select leaf.node, coalesce(max(anc) + 1, 0) as label from leaf left join (select * from up where anc % 7 = 3) u on u.node = leaf.node group by leaf.node)"""
ORACLES["forest_nodes"] = f"with recursive {_FOREST_SQL} select node, leaves, cast(hits as bigint) as hits, cast(total as bigint) as total, cast(total as double) / leaves as mean, round(dice, 8) as dice, depth, root from d join e using (node)"
ORACLES["forest_biggest_rep"] = f"with recursive {_FOREST_SQL} select node from valid where node not in (select up.node from up join valid v on v.node = up.anc where up.steps > 0)"
ORACLES["forest_labels"] = f"with recursive {_FOREST_SQL} select node, label from label"
ORACLES["forest_best_overlap"] = f"with recursive {_FOREST_SQL} select node, round(dice, 8) as dice from d order by 2 desc, 1 limit 1"
