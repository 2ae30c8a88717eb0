"""Queries on merge trees and the size model, on a fixed tree: node (level, pos div 2^level) over the 64 voxels.

Nodes are numbered by level, then place: leaves 0..63, the root 126.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionframe.functions.linalg import log10_or_neg_inf, safe_div, t2_one
from regionframe.jobs.permutation import ALPHA, PERM_SQL, SEEDS, _split
from regionframe.operators.antichain import greedy_cut as greedy_cut_in_rounds
from regionframe.operators.permute import labelled
from regionframe.operators.tree import ancestors, closure, greedy_cut
from regionframe.sources.cube import cube1
from regionframe.sources.cut import cut

QUERIES, ORACLES = {}, {}
STEPS = (0, 32, 48, 60)


def dyadic(spark, sf_dir) -> DataFrame:
    """(node, parent, level, at): the tree over the voxels that the data has, which are 64."""
    leaf = cube1(spark, sf_dir).select("pos").distinct()
    n = leaf.select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("level"), "pos").select("level", F.expr("cast(shiftright(pos, level) as int)").alias("at")).distinct()
    number = lambda level, at: (F.lit(128) - F.pow(F.lit(2.0), 7 - level) + at).cast("int")
    return n.select(number(F.col("level"), F.col("at")).alias("node"), F.when(F.col("level") < 6, number(F.col("level") + 1, F.expr("at div 2"))).alias("parent"), "level", "at")


DYADIC_SQL = """tree as (select distinct cast(128 - power(2, 7 - l) + (p // cast(power(2, l) as int)) as int) as node,
  case when l < 6 then cast(128 - power(2, 6 - l) + (p // cast(power(2, l + 1) as int)) as int) end as parent, cast(l as int) as level, cast(p // cast(power(2, l) as int) as int) as at
  from unnest(range(0, 64)) r(p), unnest(range(0, 7)) s(l)),
closure as (select distinct cast(128 - power(2, 7 - l) + (p // cast(power(2, l) as int)) as int) as ancestor, cast(p as int) as leaf from unnest(range(0, 64)) r(p), unnest(range(0, 7)) s(l))"""

QUERIES["tree_closure"] = lambda spark, sf_dir: closure(dyadic(spark, sf_dir).select("node", "parent"))
ORACLES["tree_closure"] = f"with {DYADIC_SQL} select ancestor, leaf from closure"
QUERIES["tree_ancestors"] = lambda spark, sf_dir: ancestors(dyadic(spark, sf_dir).select("node", "parent"))
ORACLES["tree_ancestors"] = """with recursive tree as (select distinct cast(128 - power(2, 7 - l) + (p // cast(power(2, l) as int)) as int) as node,
  case when l < 6 then cast(128 - power(2, 6 - l) + (p // cast(power(2, l + 1) as int)) as int) end as parent from unnest(range(0, 64)) r(p), unnest(range(0, 7)) s(l)),
up as (select node, parent as ancestor from tree where parent is not null union all select u.node, t.parent from up u join tree t on t.node = u.ancestor where t.parent is not null)
select node, ancestor from up"""


def node_stats(spark, sf_dir, seeds: int = SEEDS) -> DataFrame:
    """(perm, node, parent, size, f): every node's statistic under every permutation. Leaf moments are added up along the
    closure before any statistic is formed."""
    tree = dyadic(spark, sf_dir)
    c = cube1(spark, sf_dir).drop("grp", "label").join(labelled(_split(spark, sf_dir), seeds), "sbj")
    c = c.select("pos", "x", F.posexplode("labels").alias("perm", "grp")).groupBy("perm", "pos", "grp").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    up = closure(tree.select("node", "parent")).withColumnRenamed("leaf", "pos").withColumnRenamed("ancestor", "node")
    pick = lambda g, k: F.sum(F.when(F.col("grp") == g, F.col(k))).alias(f"{k}{g}")
    m = c.join(up, "pos").groupBy("perm", "node").agg(F.count_distinct("pos").alias("size"), *[pick(g, k) for g in (0, 1) for k in "nsq"])
    mean = {g: F.col(f"s{g}") / F.col(f"n{g}") for g in (0, 1)}
    var = {g: F.col(f"q{g}") / F.col(f"n{g}") - mean[g] * mean[g] for g in (0, 1)}
    t2 = t2_one(F.col("n0"), mean[0], var[0], F.col("n1"), mean[1], var[1])  # one feature: F is t²
    return m.select("perm", "node", "size", t2.alias("f")).join(F.broadcast(tree.select("node", "parent")), "node")


_STATS_SQL = f"""{PERM_SQL}, {DYADIC_SQL},
nm0 as (select p.perm, k.ancestor as node, p.grp, count(*) as n, sum(x) as s, sum(x * x) as q from cube1 c join perm_labels p using (sbj) join closure k on k.leaf = c.pos group by all),
nm1 as (select perm, node, {", ".join(f"max(n) filter (grp = {g}) as n{g}, max(s) filter (grp = {g}) as s{g}, max(q) filter (grp = {g}) as q{g}" for g in (0, 1))} from nm0 group by all),
ns as (select perm, node, cast((select count(*) from closure c where c.ancestor = nm1.node) as bigint) as size,
  (s1 / n1 - s0 / n0) * (s1 / n1 - s0 / n0) / ((n0 * (q0 / n0 - (s0 / n0) * (s0 / n0)) + n1 * (q1 / n1 - (s1 / n1) * (s1 / n1))) / (n0 + n1)) * n0 * n1 / (n0 + n1) as f from nm1)"""

QUERIES["node_size"] = lambda spark, sf_dir: closure(dyadic(spark, sf_dir).select("node", "parent")).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("size"))
ORACLES["node_size"] = f"with {DYADIC_SQL} select ancestor as node, count(*) as size from closure group by all"


def node_f(spark, sf_dir):
    """F of every node under every permutation."""
    return node_stats(spark, sf_dir).select("perm", "node", "size", F.round("f", 5).alias("f"))


QUERIES["node_f"] = node_f
ORACLES["node_f"] = f"with {_STATS_SQL} select perm, node, size, round(f, 5) as f from ns"


def observed(spark, sf_dir):
    return node_stats(spark, sf_dir, 0)


def leaf_means(stats: DataFrame, up: DataFrame) -> DataFrame:
    """(node, mean): the mean of each node's leaves' values."""
    leaf = stats.where("size = 1").select(F.col("node").alias("leaf"), F.col("f").alias("v"))
    return up.join(leaf, "leaf").groupBy(F.col("ancestor").alias("node")).agg(F.avg("v").alias("mean"))


def tree_leaf_mean(spark, sf_dir):
    return leaf_means(observed(spark, sf_dir), closure(dyadic(spark, sf_dir).select("node", "parent"))).select("node", F.round("mean", 5).alias("mean"))


QUERIES["tree_leaf_mean"] = tree_leaf_mean
ORACLES["tree_leaf_mean"] = f"with {_STATS_SQL} select ancestor as node, round(avg(f), 5) as mean from closure join ns on ns.node = leaf where perm = 0 group by all"


def biggest_rep(spark, sf_dir, share: float = 0.9) -> DataFrame:
    """Nodes at least `share` of their leaves' mean that are below no other such node."""
    tree, s = dyadic(spark, sf_dir).select("node", "parent"), observed(spark, sf_dir)
    valid = s.join(leaf_means(s, closure(tree)), "node").where(F.col("f") >= share * F.col("mean")).select("node")
    under = ancestors(tree).join(valid.withColumnRenamed("node", "ancestor"), "ancestor").select("node").distinct()
    return valid.join(under, "node", "left_anti")


QUERIES["cut_biggest_rep"] = biggest_rep
_REP_SQL = f"""{_STATS_SQL}, lm as (select ancestor as node, avg(f) as mean from closure join ns on ns.node = leaf where perm = 0 group by all),
valid as (select ns.node from ns join lm using (node) where perm = 0 and f >= 0.9 * mean),
anc as (select a.ancestor as node, b.ancestor as above from closure a join closure b using (leaf) where b.ancestor > a.ancestor group by all),
rep as (select node from valid where node not in (select anc.node from anc join valid v on v.node = above))"""
ORACLES["cut_biggest_rep"] = f"with {_REP_SQL} select node from rep"


def granularity(spark, sf_dir):
    """The nodes alive after so many merges: made by then, their parent not."""
    t = dyadic(spark, sf_dir)
    made = lambda c: F.greatest(F.lit(0), F.col(c) - 63)
    s = t.select("node", "parent", F.explode(F.array(*map(F.lit, STEPS))).alias("step"))
    return s.where((made("node") <= F.col("step")) & (F.col("parent").isNull() | (made("parent") > F.col("step")))).select("step", "node")


QUERIES["granularity"] = granularity
ORACLES["granularity"] = f"with {DYADIC_SQL} select step, node from tree, (values (0), (32), (48), (60)) s(step) where greatest(0, node - 63) <= step and (parent is null or greatest(0, parent - 63) > step)"


def label_volume(spark, sf_dir):
    """Each voxel with the largest chosen node over it, one added; 0 is the background. Chosen: nodes 64..110 divisible by 3."""
    t = dyadic(spark, sf_dir)
    chosen = t.where("node between 64 and 110 and node % 3 = 0").select(F.col("node").alias("ancestor"))
    painted = closure(t.select("node", "parent")).join(chosen, "ancestor").groupBy("leaf").agg(F.max("ancestor").alias("top"))
    return t.where("level = 0").select(F.col("node").alias("leaf")).join(painted, "leaf", "left").select("leaf", F.coalesce(F.col("top") + 1, F.lit(0)).alias("label"))


QUERIES["label_volume"] = label_volume
ORACLES["label_volume"] = f"with {DYADIC_SQL} select t.node as leaf, coalesce(max(c.ancestor) + 1, 0) as label from tree t left join (select * from closure where ancestor between 64 and 110 and ancestor % 3 = 0) c on c.leaf = t.node where level = 0 group by all"


def in_box(spark, sf_dir):
    return cube1(spark, sf_dir).where("i < 3 and j < 3").select(F.col("pos").alias("leaf")).distinct().withColumn("hit", F.lit(1))


def max_dice_node(spark, sf_dir):
    """The node whose voxels overlap most with the mask by Dice; of equal ones the first."""
    c = closure(dyadic(spark, sf_dir).select("node", "parent")).join(in_box(spark, sf_dir), "leaf", "left")
    total = in_box(spark, sf_dir).agg(F.count("*").alias("mask"))
    d = c.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("size"), F.count("hit").alias("hit")).crossJoin(F.broadcast(total))
    return d.select("node", F.round(2 * F.col("hit") / (F.col("size") + F.col("mask")), 8).alias("dice")).orderBy(F.desc("dice"), "node").limit(1)


QUERIES["max_dice_node"] = max_dice_node
_BOX = "(leaf // 16 < 3 and leaf // 4 % 4 < 3)"
ORACLES["max_dice_node"] = f"with {DYADIC_SQL} select ancestor as node, round(2 * count_if({_BOX}) / (count(*) + 36), 8) as dice from closure group by all order by dice desc, node limit 1"


def size_v(spark, sf_dir, most: int = 750):
    """The largest nodes: size, statistic, share of their voxels in the mask."""
    share = closure(dyadic(spark, sf_dir).select("node", "parent")).join(in_box(spark, sf_dir), "leaf", "left").groupBy(F.col("ancestor").alias("node")).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return observed(spark, sf_dir).join(share, "node").orderBy(F.desc("size"), "node").limit(most).select("node", "size", F.round("f", 5).alias("f"), F.round("share", 8).alias("share"))


QUERIES["size_v"] = size_v
ORACLES["size_v"] = f"with {_STATS_SQL}, sh as (select ancestor as node, avg(case when {_BOX} then 1 else 0 end) as share from closure group by all) select node, size, round(f, 5) as f, round(share, 8) as share from ns join sh using (node) where perm = 0 order by size desc, node limit 750"

# The size model


def last_logf(stats: DataFrame) -> DataFrame:
    """(perm, size, logf): of each size the node with the largest number."""
    return stats.where("perm > 0").groupBy("perm", "size").agg(F.max_by("f", "node").alias("f")).select("perm", "size", log10_or_neg_inf(F.col("f")).alias("logf"))


def rising(null: DataFrame) -> DataFrame:
    """The running maximum over sizes, on the dense grid of permutations and sizes (not of data); minus infinity where none
    is yet."""
    dense = null.select("perm").distinct().crossJoin(null.select("size").distinct()).join(null, ["perm", "size"], "left")
    w = Window.partitionBy("perm").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select("perm", "size", F.max(F.coalesce("logf", F.lit(float("-inf")))).over(w).alias("logf"))


def model_of(up: DataFrame) -> DataFrame:
    """(size, mu, sd): median, and mean absolute deviation (finite entries) made falling with size; one row a size."""
    mu = up.groupBy("size").agg(F.percentile("logf", F.lit(0.5)).alias("mu"))
    finite = F.when(F.col("logf") > float("-inf"), F.abs(F.col("logf") - F.col("mu")))
    d = up.join(mu, "size").groupBy("size", "mu").agg(F.avg(finite).alias("sd0"))
    w = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    return d.select("size", "mu", F.max("sd0").over(w).alias("sd"))


def interpolated(sizes: DataFrame, model: DataFrame) -> DataFrame:
    """sizes (size, ...) with mu and sd by linear interpolation in log size between the model's neighbours; clamped at its
    ends. The different sizes are put in order with the model's, and what each finds before and after it is joined back
    by size: the window runs over one row a size."""
    m = model.select("size", F.struct("size", "mu", "sd").alias("own"))
    every = sizes.select("size").distinct().join(m, "size", "full")
    w = Window.orderBy("size")
    lo = F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first("own", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    e = every.select("size", F.coalesce(lo, hi).alias("lo"), F.coalesce(hi, lo).alias("hi"))
    part = F.when(F.col("hi.size") == F.col("lo.size"), 0.0).otherwise((F.ln("size") - F.ln("lo.size")) / (F.ln("hi.size") - F.ln("lo.size")))
    at = lambda c: F.when(part == 0, F.col(f"lo.{c}")).otherwise(F.col(f"lo.{c}") + part * (F.col(f"hi.{c}") - F.col(f"lo.{c}")))
    return sizes.join(e.select("size", at("mu").alias("mu"), at("sd").alias("sd")), "size").select(*sizes.columns, "mu", "sd")


def scored(stats: DataFrame, model: DataFrame) -> DataFrame:
    """stats with saf, the size-adjusted log F; null where the deviation is zero."""
    return interpolated(stats, model).withColumn("saf", safe_div(log10_or_neg_inf(F.col("f")) - F.col("mu"), F.col("sd")))


_MODEL_SQL = f"""{_STATS_SQL},
last as (select perm, size, case when max_by(f, node) > 0 then log10(max_by(f, node)) else cast('-infinity' as double) end as logf from ns where perm > 0 group by all),
rise as (select perm, size, max(logf) over (partition by perm order by size rows unbounded preceding) as logf from last),
med as (select size, quantile_cont(logf, 0.5) as mu from rise group by all),
dev as (select size, mu, avg(case when isfinite(logf) then abs(logf - mu) end) as sd0 from rise join med using (size) group by all),
model as (select size, mu, max(sd0) over (order by size desc rows unbounded preceding) as sd from dev),
saf as materialized (select ns.*, (case when f > 0 then log10(f) else cast('-infinity' as double) end - mu) / nullif(sd, 0) as saf from ns join model using (size))"""

QUERIES["null_last_per_size"] = lambda spark, sf_dir: last_logf(node_stats(spark, sf_dir)).select("perm", "size", F.round("logf", 6).alias("logf"))
ORACLES["null_last_per_size"] = f"with {_MODEL_SQL} select perm, size, round(logf, 6) as logf from last"
QUERIES["logf_running_max"] = lambda spark, sf_dir: rising(last_logf(node_stats(spark, sf_dir))).select("perm", "size", F.round("logf", 6).alias("logf"))
ORACLES["logf_running_max"] = f"with {_MODEL_SQL} select perm, size, round(logf, 6) as logf from rise"


def _model(spark, sf_dir):
    return model_of(rising(last_logf(node_stats(spark, sf_dir))))


QUERIES["size_model"] = lambda spark, sf_dir: _model(spark, sf_dir).select("size", F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"))
ORACLES["size_model"] = f"with {_MODEL_SQL} select size, round(mu, 6) as mu, round(sd, 6) as sd from model"


def interp_logf(spark, sf_dir):
    """The model at sizes beside its own, its ends and beyond."""
    model = cut(_model(spark, sf_dir))
    sizes = model.select(F.explode(F.array((F.col("size") + F.lit(1)).cast("long"), F.expr("size * 3 div 2"))).alias("size")).distinct()
    return interpolated(sizes, model).select("size", F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"))


QUERIES["interp_logf"] = interp_logf
ORACLES["interp_logf"] = f"""with {_MODEL_SQL}, q as (select distinct unnest([size + 1, size * 3 // 2]) as size from model),
m as (select size as lo, mu as a, sd as c, lead(size) over (order by size) as hi, lead(mu) over (order by size) as b, lead(sd) over (order by size) as d from model),
p as (select q.size, a, b, c, d, case when hi is null then 0 else (ln(q.size) - ln(lo)) / (ln(hi) - ln(lo)) end as t from q join m on q.size >= lo and (hi is null or q.size < hi))
select cast(size as bigint) as size, round(case when t = 0 then a else a + t * (b - a) end, 6) as mu, round(case when t = 0 then c else c + t * (d - c) end, 6) as sd from p"""


def _saf(spark, sf_dir):
    """Every permutation's nodes, counted once: the null among them gives the model."""
    stats = cut(node_stats(spark, sf_dir))
    return scored(stats, model_of(rising(last_logf(stats))))


QUERIES["node_saf"] = lambda spark, sf_dir: _saf(spark, sf_dir).where("perm = 0").select("node", "size", F.round("saf", 5).alias("saf"))
ORACLES["node_saf"] = f"with {_MODEL_SQL} select node, size, round(saf, 5) as saf from saf where perm = 0"


def null_max(saf: DataFrame) -> DataFrame:
    return saf.where("perm > 0").groupBy("perm").agg(F.max("saf").alias("top"))


QUERIES["saf_null_max"] = lambda spark, sf_dir: null_max(_saf(spark, sf_dir)).select("perm", F.round("top", 5).alias("top"))
ORACLES["saf_null_max"] = f"with {_MODEL_SQL} select perm, round(max(saf), 5) as top from saf where perm > 0 group by all"
QUERIES["saf_threshold"] = lambda spark, sf_dir: null_max(_saf(spark, sf_dir)).agg(F.round(F.percentile("top", F.lit(1 - ALPHA)), 5).alias("threshold"))
ORACLES["saf_threshold"] = f"with {_MODEL_SQL}, t as (select perm, max(saf) as m from saf where perm > 0 group by all) select round(quantile_cont(m, {1 - ALPHA}), 5) as threshold from t"
QUERIES["model_f"] = lambda spark, sf_dir: _model(spark, sf_dir).select("size", F.round(F.pow(F.lit(10.0), F.col("mu") + F.col("sd")), 5).alias("f"))
ORACLES["model_f"] = f"with {_MODEL_SQL} select size, round(power(10, mu + sd), 5) as f from model"


def cut_greedy(spark, sf_dir):
    """Disjoint nodes of every permutation's tree by falling saf."""
    return greedy_cut(_saf(spark, sf_dir).select("perm", "node", "parent", F.round("saf", 9).alias("saf")), "saf")


QUERIES["cut_greedy"] = cut_greedy


def sig_nodes(spark, sf_dir, level: float = 0.25):
    """The observed tree's cut, and of it the nodes whose saf reaches the null's percentile (here of a 75 % error rate, so
    that some may)."""
    saf = cut(_saf(spark, sf_dir))
    limit = null_max(saf).agg(F.percentile("top", F.lit(level)).alias("limit"))
    kept = greedy_cut(saf.where("perm = 0").select("perm", "node", "parent", F.round("saf", 9).alias("saf")), "saf")
    return kept.join(saf.where("perm = 0").select("node", "size", "saf"), "node").crossJoin(F.broadcast(limit)).select("node", "size", F.round("saf", 5).alias("saf"), (F.col("saf") >= F.col("limit")).alias("significant"))


QUERIES["sig_nodes"] = sig_nodes
#: The same cut as cut_greedy, all permutations' trees in shared rounds and none of them in one task.
QUERIES["cut_rounds"] = lambda spark, sf_dir: greedy_cut_in_rounds(_saf(spark, sf_dir).select("perm", "node", "parent", F.round("saf", 9).alias("saf")), "saf")
#: The cut by steps: in order of saf a node is picked if no picked one is above, below or at it.
_CUT_SQL = f"""{_MODEL_SQL}, up_ as (select a.ancestor as node, b.ancestor as above from closure a join closure b using (leaf) where b.ancestor > a.ancestor group by all),
ranked as materialized (select perm, node, row_number() over (partition by perm order by round(saf, 9) desc, node) as r from saf where saf is not null),
clash as materialized (select p.perm, p.r, q.r as other from ranked p join ranked q using (perm) join up_ u on (u.node = p.node and u.above = q.node) or (u.node = q.node and u.above = p.node))"""
CUT_SQL = f"""with recursive {_CUT_SQL}, lists as materialized (select perm, r, list(other) as others from clash group by all),
pick(perm, r, picked) as (select perm, cast(0 as bigint), cast([] as bigint[]) from (select distinct perm from ranked) union all
  select p.perm, p.r + 1, case when len(list_intersect(p.picked, coalesce(l.others, cast([] as bigint[])))) = 0 then list_append(p.picked, p.r + 1) else p.picked end
  from pick p join ranked n on n.perm = p.perm and n.r = p.r + 1 left join lists l on l.perm = p.perm and l.r = p.r + 1),
cut_ as (select k.perm, k.node from (select perm, unnest(picked) as r from (select perm, max_by(picked, r) as picked from pick group by perm)) p join ranked k using (perm, r))"""
ORACLES["cut_greedy"] = f"{CUT_SQL} select perm, node from cut_"
ORACLES["cut_rounds"] = f"{CUT_SQL} select perm, cast(node as bigint) as node from cut_"
ORACLES["sig_nodes"] = f"""{CUT_SQL}, tops as (select perm, max(saf) as m from saf where perm > 0 group by all)
select s.node, s.size, round(s.saf, 5) as saf, s.saf >= (select quantile_cont(m, 0.25) from tops) as significant from cut_ join saf s using (perm, node) where perm = 0"""
