"""Queries over groups of responses: advantages, filters, pairs, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import advantages as A
from plumbline.operators import balancing, filters, preferences, sampling, training, validation
from plumbline.plans.carriers import PREDICTIONS, ROLLOUTS, derive, hash48, plain, r, rounded
from plumbline.plans.registry import query

G = f"with g as {plain(ROLLOUTS)}"
STATS = """s as (select g.*, count(*) over w as n, avg(score) over w as m, var_samp(score) over w as v, sum(score) over w as t
from g window w as (partition by uid))"""


def rollouts(spark, sf):
    return derive(spark, sf, ROLLOUTS)


def adv(spark, sf, name, **options):
    out = A.advantage(rollouts(spark, sf), name, **options)
    return rounded(out.select("seq_id", "uid", "advantage"))


def adv_sql(expr: str) -> str:
    return f"{G}, {STATS} select seq_id, uid, {r(expr)} as advantage from s"


@query("adv_grpo", adv_sql("case when n = 1 then score / (1 + 1e-6) else (score - m) / (sqrt(v) + 1e-6) end"))
def adv_grpo(spark, sf):
    return adv(spark, sf, "grpo")


@query("adv_grpo_unscaled", adv_sql("case when n = 1 then score else score - m end"))
def adv_grpo_unscaled(spark, sf):
    return adv(spark, sf, "grpo", norm=False)


@query("adv_grpo_vectorized", adv_sql("case when n = 1 then score / (1 + 1e-6) else (score - m) / (sqrt(greatest(v, 1e-6)) + 1e-6) end"))
def adv_grpo_vectorized(spark, sf):
    return adv(spark, sf, "grpo_vectorized")


@query(
    "adv_grpo_passk",
    f"""{G}, g2 as (select * from g where uid >= 0), k as (select g2.*, row_number() over (partition by uid order by score desc, seq_id) as rn,
  lead(score) over (partition by uid order by score desc, seq_id) as nxt, stddev_samp(score) over (partition by uid) as sd from g2)
select seq_id, uid, {r('case when rn = 1 then (score - nxt) / (sd + 1e-6) else 0 end')} as advantage from k""",
)
def adv_grpo_passk(spark, sf):
    """Single-sample prompts (negative ids) are an error and are left out."""
    out = A.grpo_passk(rollouts(spark, sf).where(F.col("uid") >= 0))
    return rounded(out.select("seq_id", "uid", "advantage"))


@query("adv_rloo", adv_sql("case when n > 1 then score * n / (n - 1) - m * n / (n - 1) else score end"))
def adv_rloo(spark, sf):
    return adv(spark, sf, "rloo")


@query("adv_rloo_vectorized", adv_sql("case when n > 1 then (n * score - t) / (n - 1) else 0 end"))
def adv_rloo_vectorized(spark, sf):
    return adv(spark, sf, "rloo_vectorized")


@query(
    "adv_opo",
    f"""{G} select seq_id, uid, {r('''score - case when count(*) over w = 1 then 0
else sum(response_length * score) over w / sum(response_length) over w end''')} as advantage from g window w as (partition by uid)""",
)
def adv_opo(spark, sf):
    return adv(spark, sf, "opo")


@query(
    "adv_gpg",
    f"""{G}, {STATS}, a as (select count(*) * 1e0 / sum(case when score <> 0 then 1 else 0 end) as alpha from g)
select seq_id, uid, {r('alpha * (score - case when n = 1 then 0 else m end)')} as advantage from s, a""",
)
def adv_gpg(spark, sf):
    return adv(spark, sf, "gpg")


@query(
    "adv_reinforce_pp_baseline",
    f"""{G}, {STATS}, x as (select *, score - case when n = 1 then 0 else m end as x from s),
mm as (select sum(response_length * x) / sum(response_length) as mu, sum(response_length) as w from x),
vv as (select sum(response_length * (x - mu) * (x - mu)) / (max(w) - 1) as v from x, mm)
select seq_id, uid, {r('(x - mu) / sqrt(vv.v + 1e-8)')} as advantage from x, mm, vv""",
)
def adv_reinforce_pp_baseline(spark, sf):
    return adv(spark, sf, "reinforce_plus_plus_baseline")


@query(
    "softmean_center",
    f"""{G}, z as (select max(score) as mx from g), l as (select mx * 1e0 + ln(sum(exp((score - mx) * 1e0))) - ln(count(*)) as l from g, z group by mx)
select seq_id, {r('score - l')} as centered from g, l""",
)
def softmean_center(spark, sf):
    return rounded(A.softmean_center(rollouts(spark, sf), 1.0).select("seq_id", "centered"))


@query(
    "group_mean_std",
    f"""{G} select uid, {r('case when count(*) = 1 then 0 else avg(score) end')} as mean,
{r('case when count(*) = 1 then 1 else sqrt(greatest(var_samp(score), 1e-6)) end')} as std, count(*) as n from g group by 1""",
)
def group_mean_std(spark, sf):
    return rounded(A.group_mean_std(rollouts(spark, sf)))


@query(
    "join_baseline_reward",
    f"""{G}, b as (select uid, max(score) as base from g group by 1)
select seq_id, uid, {r('score - base')} as advantage from g join b using (uid)""",
)
def join_baseline_reward(spark, sf):
    df = rollouts(spark, sf)
    greedy = df.groupBy("uid").agg(F.max("score").alias("reward_baseline"))
    joined = A.join_baseline(df, greedy)
    return rounded(joined.select("seq_id", "uid", (F.col("score") - F.col("reward_baseline")).alias("advantage")))


# filters ---------------------------------------------------------------------


@query(
    "filter_zero_variance_groups",
    f"{G} select seq_id, uid, {r('acc')} as acc from (select g.*, min(acc) over w as lo, max(acc) over w as hi, count(*) over w as n from g window w as (partition by uid)) where lo < hi or n = 1",
)
def filter_zero_variance_groups(spark, sf):
    return rounded(filters.filter_groups(rollouts(spark, sf), "acc").select("seq_id", "uid", "acc"))


@query("keep_prompts", f"{G} select seq_id, uid from g where uid in (select uid from g group by 1 having avg(score) > 0.5)")
def keep_prompts(spark, sf):
    df = rollouts(spark, sf)
    kept = df.groupBy("uid").agg(F.avg("score").alias("m")).where(F.col("m") > 0.5)
    return filters.keep_prompts(df, kept).select("seq_id", "uid")


@query(
    "align_batch",
    f"""{G}, a as (select uid, min(step) as r from g group by 1), f as (select uid from a order by r, uid limit 64)
select seq_id, uid from g where uid in (select uid from f)""",
)
def align_batch(spark, sf):
    df = rollouts(spark, sf)
    return filters.align_batch(df, 64, 10, round_col="step").select("seq_id", "uid")


@query(
    "prioritized_downsample",
    f"""{G}, q as (select uid, count(*) as n, case when avg(acc) between 0.2 and 0.5 and max(response_length) < 199 then 1 else 0 end as ok from g group by 1),
o as (select g.seq_id, g.uid, q.ok = 1 as passes, row_number() over (order by q.ok desc, g.uid, g.seq_id) as rn from g join q using (uid))
select seq_id, uid, passes from o where rn <= (select floor(count(*) / 2) from g)""",
)
def prioritized_downsample(spark, sf):
    out = filters.prioritized_downsample(rollouts(spark, sf), 0.2, 0.5, 200, 2)
    return out.select("seq_id", "uid", "passes")


# pairs -----------------------------------------------------------------------


@query(
    "preference_pairs",
    f"{G} select seq_id, uid, row_number() over (partition by uid order by score desc, seq_id) = 1 as chosen from g",
)
def preference_pairs(spark, sf):
    return preferences.mark_chosen(rollouts(spark, sf)).select("seq_id", "uid", "chosen")


@query(
    "pair_compare",
    f"""{G}, p as (select a.uid, (a.score - b.score > 0) = (a.acc - b.acc > 0) as hit, abs(a.acc - b.acc) as w
  from g a join g b on a.uid = b.uid and a.seq_id < b.seq_id),
u as (select uid, case when sum(w) = 0 then 0.5e0 else sum(case when hit then w else 0 end) / sum(w) end as a from p group by 1),
al as (select uid, coalesce(a, 0.5e0) as a from (select distinct uid from g) left join u using (uid))
select {r('avg(a)')} as accuracy from al""",
)
def pair_compare(spark, sf):
    return rounded(preferences.pairwise_preference_accuracy(rollouts(spark, sf)))


ENDS = """e as (select uid, count(*) as n, arg_max(log_prob_sum, score * 1000000 - seq_id / 1e6) as pc, arg_max(ref_log_prob_sum, score * 1000000 - seq_id / 1e6) as rc,
  arg_min(log_prob_sum, score * 1000000 - seq_id / 1e6) as pr, arg_min(ref_log_prob_sum, score * 1000000 - seq_id / 1e6) as rr from g group by 1),
x as (select pc - pr - (rc - rr) as l from e where n > 1)"""


def pairs(spark, sf):
    """Best and worst response of each prompt with their log-probabilities."""
    df = rollouts(spark, sf)
    values = F.struct(F.col("log_prob_sum").alias("p"), F.col("ref_log_prob_sum").alias("q"))
    order = F.struct(F.col("score"), (-F.col("seq_id")).alias("i"))
    ends = df.groupBy("uid").agg(
        F.max_by(values, order).alias("c"), F.min_by(values, order).alias("r"), F.count(F.lit(1)).alias("n")
    )
    return ends.where("n > 1").select(
        F.col("c.p").alias("policy_chosen"),
        F.col("r.p").alias("policy_rejected"),
        F.col("c.q").alias("ref_chosen"),
        F.col("r.q").alias("ref_rejected"),
    )


def log_sig(x: str) -> str:
    return f"(least({x}, 0) - ln(1 + exp(-abs({x}))))"


@query(
    "preference_loss",
    f"{G}, {ENDS} select {r('avg(-0.9e0 * ' + log_sig('0.1e0 * l') + ' - 0.1e0 * ' + log_sig('-0.1e0 * l') + ')')} as loss, {r('avg(l)')} as mean_logits from x",
)
def preference_loss(spark, sf):
    return rounded(preferences.preference_loss(pairs(spark, sf), 0.1, "sigmoid", 0.1))


@query("preference_loss_ipo", f"{G}, {ENDS} select {r('avg((l - 5e0) * (l - 5e0))')} as loss, {r('avg(l)')} as mean_logits from x")
def preference_loss_ipo(spark, sf):
    return rounded(preferences.preference_loss(pairs(spark, sf), 0.1, "ipo"))


@query(
    "implicit_rm_loss",
    f"""{G}, s as (select acc, score - 0.5e0 as q from g), p as (select acc, q, 1 / (1 + exp(-2e0 * q)) as p from s)
select {r('avg(-(acc * ln(p) + (1 - acc) * ln(1 - p)))')} as loss, {r('avg(case when sign(q) = sign(2 * acc - 1) then 1e0 else 0e0 end)')} as sign_accuracy from p""",
)
def implicit_rm_loss(spark, sf):
    df = rollouts(spark, sf).withColumn("score", F.col("score") - 0.5)
    return rounded(preferences.implicit_rm_loss(df, 2.0, "ce"))


@query(
    "implicit_rm_loss_pairwise",
    f"""{G}, s as (select uid, acc, score - 0.5e0 as q from g),
o as (select s.*, avg(case when acc > 0 then q end) over w as qr, avg(case when acc <= 0 then q end) over w as qw from s window w as (partition by uid)),
d as (select q, acc, 2e0 * (q - coalesce(case when acc > 0 then qw else qr end, 0)) * case when acc > 0 then 1 else -1 end as x from o)
select {r('avg(-' + log_sig('x') + ')')} as loss, {r('avg(case when sign(q) = sign(2 * acc - 1) then 1e0 else 0e0 end)')} as sign_accuracy from d""",
)
def implicit_rm_loss_pairwise(spark, sf):
    df = rollouts(spark, sf).withColumn("score", F.col("score") - 0.5)
    return rounded(preferences.implicit_rm_loss(df, 2.0, "pairwise"))


@query(
    "dpo_batch_metrics",
    f"""{G}, c as (select g.*, row_number() over (partition by uid order by score desc, seq_id) = 1 as chosen from g)
select """
    + ", ".join(
        f"{r(f'avg({x})')} as {x}_mean, {k}(max({x})) as {x}_max, {k}(min({x})) as {x}_min"
        for x, k in [("score", "abs"), ("reward", ""), ("prompt_length", ""), ("response_length", "")]
    )
    + f""", {r('avg(log_prob_sum) filter (where chosen)')} as chosen_logp_mean, {r('avg(log_prob_sum) filter (where not chosen)')} as rejected_logp_mean,
{r('avg(log_prob_sum - ref_log_prob_sum) filter (where chosen) - avg(log_prob_sum - ref_log_prob_sum) filter (where not chosen)')} as logits_mean from c""",
)
def dpo_batch_metrics(spark, sf):
    return rounded(preferences.dpo_metrics(preferences.mark_chosen(rollouts(spark, sf))))


@query(
    "sppo_loss",
    f"{G} select {r('avg((log_prob_sum - ref_log_prob_sum - 2e0 * score) * (log_prob_sum - ref_log_prob_sum - 2e0 * score))')} as loss from g where response_length > 0",
)
def sppo_loss(spark, sf):
    seq = rollouts(spark, sf).withColumn("old_log_prob_sum", F.col("ref_log_prob_sum")).withColumn("n_valid", F.col("response_length"))
    return rounded(preferences.sppo_loss(seq, 2.0))


# validation ------------------------------------------------------------------


@query(
    "mean_score_by_source",
    f"{G}, w as (select data_source, cast(floor(seq_id / 4) as bigint) as row_id, avg(score) as s from g group by 1, 2) select data_source, {r('avg(s)')} as test_score, count(*) as n_rows from w group by 1",
)
def mean_score_by_source(spark, sf):
    df = rollouts(spark, sf).withColumn("row_id", F.floor(F.col("seq_id") / 4))
    return rounded(validation.score_by_source(df))


VAL = f"""{G}, l as (select data_source, uid, 'score' as var, score as v from g union all select data_source, uid, 'acc', acc from g),
o as (select *, count(*) over w as n, row_number() over (partition by data_source, uid, var order by v) as i from l window w as (partition by data_source, uid, var)),
ks as (select o.*, k.k from o, (select 1 << i as k from range(1, 12) x(i)) k where k.k < o.n union all select o.*, n as k from o where n > 1),
b as (select data_source, uid, var, k,
  sum(v * (pow(i / n, k) - pow((i - 1) / n, k))) as bm, sum(v * v * (pow(i / n, k) - pow((i - 1) / n, k))) as bs,
  sum(v * (pow(1 - (i - 1) / n, k) - pow(1 - i / n, k))) as wm, sum(v * v * (pow(1 - (i - 1) / n, k) - pow(1 - i / n, k))) as ws from ks group by 1, 2, 3, 4),
m as (select data_source, uid, var, count(*) as n, avg(v) as m, avg(v * v) as s from l group by 1, 2, 3),
u as (select data_source, var, 'mean@' || n as metric, m as value from m
  union all select data_source, var, 'std@' || n, sqrt(greatest(s - m * m, 0)) from m where n > 1
  union all select data_source, var, 'best@' || k || '/mean', bm from b union all select data_source, var, 'best@' || k || '/std', sqrt(greatest(bs - bm * bm, 0)) from b
  union all select data_source, var, 'worst@' || k || '/mean', wm from b union all select data_source, var, 'worst@' || k || '/std', sqrt(greatest(ws - wm * wm, 0)) from b),
f as (select data_source, var, metric, avg(value) as value from u group by 1, 2, 3)"""


@query("validation_metrics", f"{VAL} select data_source, var, metric, {r('value', 9)} as value from f")
def validation_metrics(spark, sf):
    return rounded(validation.validation_metrics(rollouts(spark, sf), ["score", "acc", "pred"]), 9)


@query(
    "name_val_metrics",
    f"""{VAL}, t as (select *, cast(regexp_extract(metric, '@(\\d+)', 1) as int) as n from f),
x as (select t.*, max(n) over (partition by data_source, var) as top from t)
select case when var = 'acc' and (metric like 'mean%' or metric like 'maj%' or metric like 'best%') and contains(metric, '@' || top) then 'val-core' else 'val-aux' end
  || '/' || data_source || '/' || var || '/' || metric as name, {r('value', 9)} as value from x""",
)
def name_val_metrics(spark, sf):
    metrics = validation.validation_metrics(rollouts(spark, sf), ["score", "acc"])
    return rounded(validation.val_metric_names(metrics), 9)


def multinomial_sql(name: str, names: str, places: int, seed: int = 42) -> str:
    """CTEs that chain binomials over the values (place i, weight c, rest from there on) of each request.

    Needs ``{name}_v(names of the group, i, v, c, rest)`` and ``{name}_r(names, n)``
    joined as ``{name}_m(names, n, i, v, c, rest)``; gives ``{name}(names, v, x)``.
    The distribution function is summed from logarithms of factorials, once for each
    number of draws and weight that can occur.
    """
    u = f"{hash48(names, 0, 0, seed, 'i')} / 281474976710656e0"
    stages = [f"{name}_0 as (select {names}, n as rem, cast(null as bigint) as x, -1 as i from {name}_r)"]
    for i in range(places):
        stages.append(
            f"""{name}_{i + 1} as (select p.{names.replace(', ', ', p.')}, p.rem - q.x as rem, q.x, {i} as i
  from {name}_{i} p join {name}_m m on m.i = {i} and {' and '.join(f'm.{c} is not distinct from p.{c}' for c in names.split(', '))}
  join {name}_q q on q.n = p.rem and q.c = m.c and q.rest = m.rest and m.u >= q.lo and m.u < q.hi)"""
        )
    every = " union all ".join(f"select {names}, x, i from {name}_{i + 1}" for i in range(places))
    return f"""{name}_m as (select *, {u} as u from {name}_w),
{name}_p as (select distinct n, c, rest, least(c, rest - c) / rest as p, 2 * c > rest as flip from (select distinct c, rest from {name}_m), range(0, (select max(n) + 1 from {name}_r)) t(n)),
{name}_f as (select *, case when p = 0 then case when y = 0 then 1e0 else 0e0 end
    else exp(lgamma(n + 1) - lgamma(y + 1) - lgamma(n - y + 1) + y * ln(p) + (n - y) * ln(1 - p)) end as mass from {name}_p, range(0, (select max(n) + 1 from {name}_r)) t(y) where y <= n),
{name}_c as (select *, sum(mass) over (partition by n, c, rest order by y) as f from {name}_f),
{name}_q as (select n, c, rest, cast(case when flip then n - y else y end as bigint) as x, coalesce(lag(f) over w, -1) as lo, case when y = n then 2 else f end as hi from {name}_c window w as (partition by n, c, rest order by y)),
{', '.join(stages)},
{name} as (select e.*, m.v from ({every}) e join {name}_m m on m.i = e.i and {' and '.join(f'm.{c} is not distinct from e.{c}' for c in names.split(', '))} where e.x > 0)"""


def requests_sql(group: str, draws: int) -> str:
    """Requests for every draw of every subset size below and at a group's size."""
    return f"""z as (select {group}, count(*) as size from g group by {group}),
k as (select {group}, 1 << i as k from z, range(1, 20) t(i) where 1 << i < size union all select {group}, size from z where size > 1),
d as (select {group}, k, draw, k as n from k, range(1, {draws + 1}) t(draw))"""


@query(
    "bootstrap_metric",
    f"""{G}, {requests_sql('uid', 20)}, b_r as (select * from d),
b_w as (select d.*, i, v, c, rest from d join (select uid, score as v, count(*) as c, row_number() over (partition by uid order by score) - 1 as i,
  cast(sum(count(*)) over (partition by uid order by score desc) as bigint) as rest from g group by 1, 2) using (uid)),
{multinomial_sql('b', 'uid, k, draw', 5)},
p as (select uid, k, draw, max(v) as best, min(v) as worst, sum(v * x) / sum(x) as mean from b group by 1, 2, 3)
select uid, k, {', '.join(f"{r(f'avg({c})', 9)} as {c}_mean, {r(f'stddev_pop({c})', 9)} as {c}_std" for c in ('best', 'worst', 'mean'))} from p group by 1, 2""",
)
def bootstrap_metric(spark, sf):
    return rounded(validation.bootstrap(rollouts(spark, sf), "score", draws=20, keys=["uid"]), 9)


@query(
    "maj_at_n",
    f"""{G}, {requests_sql('data_source, uid', 10)}, b_r as (select * from d),
b_w as (select d.*, i, v, c, rest from d join (select data_source, uid, pred as v, count(*) as c, row_number() over (partition by data_source, uid order by pred) - 1 as i,
  cast(sum(count(*)) over (partition by data_source, uid order by pred desc) as bigint) as rest from g group by 1, 2, 3) using (data_source, uid)),
{multinomial_sql('b', 'data_source, uid, k, draw', 4)},
won as (select data_source, uid, k, draw, v as vote from (select *, row_number() over (partition by data_source, uid, k, draw
  order by x desc, {hash48('data_source', 'uid', 'k', 'draw', 'v', 42, "'tie'")} desc) as rn from b) where rn = 1),
e_r as (select data_source, uid, vote, k, draw, cast(1 as bigint) as n from won),
e_w as (select e_r.*, i, v, c, rest from e_r join (select data_source, uid, pred as vote, acc as v, count(*) as c, row_number() over (partition by data_source, uid, pred order by acc) - 1 as i,
  cast(sum(count(*)) over (partition by data_source, uid, pred order by acc desc) as bigint) as rest from g group by 1, 2, 3, 4) using (data_source, uid, vote)),
{multinomial_sql('e', 'data_source, uid, vote, k, draw', 2)},
s as (select data_source, uid, k, avg(v) as m, stddev_pop(v) as s from e group by 1, 2, 3)
select data_source, uid, 'maj@' || k || '/mean' as metric, {r('m', 9)} as value from s union all select data_source, uid, 'maj@' || k || '/std', {r('s', 9)} from s""",
)
def maj_at_n(spark, sf):
    return rounded(validation.majority_at(rollouts(spark, sf), "acc", "pred", draws=10, seed=42), 9)


@query(
    "majority_value",
    f"""{G}, t as (select uid, pred, count(*) as n, min(seq_id) as f, arg_min(score, seq_id) as v from g group by 1, 2),
q as (select *, row_number() over (partition by uid order by n desc, f) as rn from t) select uid, pred as vote, {r('v')} as value, n from q where rn = 1""",
)
def majority_value(spark, sf):
    return rounded(validation.majority_value(rollouts(spark, sf), ["uid"], "pred", "score", "seq_id"))


@query(
    "turn_stats",
    f"{G} select min(num_turns) as num_turns_min, max(num_turns) as num_turns_max, {r('avg(num_turns)')} as num_turns_mean from g",
)
def turn_stats(spark, sf):
    return rounded(validation.turn_stats(rollouts(spark, sf), ["num_turns"]))


REDUCE = f"""{G}, m as (select 'score/max' as metric, score as value from g union all select 'len/min', response_length * 1e0 from g
union all select 'max_min', reward from g union all select 'acc', acc from g)"""


def metric_rows(df):
    return df.select(
        F.inline(
            F.array(
                F.struct(F.lit("score/max").alias("metric"), F.col("score").alias("value")),
                F.struct(F.lit("len/min").alias("metric"), F.col("response_length").cast("double").alias("value")),
                F.struct(F.lit("max_min").alias("metric"), F.col("reward").alias("value")),
                F.struct(F.lit("acc").alias("metric"), F.col("acc").alias("value")),
            )
        )
    )


@query(
    "reduce_metrics",
    f"{REDUCE} select metric, {r('''case when metric like '%max%' then max(value) when metric like '%min%' then min(value) else avg(value) end''')} as value from m group by 1",
)
def reduce_metrics(spark, sf):
    return rounded(validation.reduce_metrics(metric_rows(rollouts(spark, sf))))


@query("merge_metric_lists", f"{REDUCE} select metric, count(*) as n, {r('sum(value)')} as total from m group by 1")
def merge_metric_lists(spark, sf):
    df = rollouts(spark, sf).withColumn("temperature", F.lit(1.0))
    halves = [metric_rows(df.where(F.col("step") < 3)), metric_rows(df.where(F.col("step") >= 3))]
    merged = validation.merge_metrics([h.withColumn("temperature", F.lit(1.0)) for h in halves], ["temperature"])
    return rounded(merged.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query(
    "flatten_metrics",
    f"{G} select 'run/' || data_source || '/' || step || '/best_at_2_mean' as metric, {r('avg(score)')} as value from g group by data_source, step",
)
def flatten_metrics(spark, sf):
    from plumbline.operators.rows import flatten_metrics as flatten

    per = rollouts(spark, sf).groupBy("data_source", "step").agg(F.avg("score").alias("s"))
    mapped = per.select(F.lit("run//").alias("run"), "data_source", "step", F.create_map(F.lit("best@2 mean"), F.col("s")).alias("metrics"))
    return rounded(flatten(mapped, ["run", "data_source", "step"]))


@query(
    "best_logged_reward",
    f"{G}, x as (select {r('score')} as s from g) select max(s) as best, max(s) > 0.2 as passed from x",
)
def best_logged_reward(spark, sf):
    lines = rollouts(spark, sf).select(
        F.concat(F.lit("step:"), F.col("step").cast("string"), F.lit(" - critic/rewards/mean:"), F.col("score").cast("string"), F.lit(" - x:1")).alias("value")
    )
    return rounded(validation.best_logged_value(lines, target=0.2))


# training metrics --------------------------------------------------------------


def three(name: str, expr: str) -> str:
    return f"{r(f'avg({expr})')} as {name}_mean, max({expr}) as {name}_max, min({expr}) as {name}_min"


@query(
    "timing_metrics",
    f"""{G}, t as (select sum(response_length) as rl, sum(prompt_length + response_length) as al from g),
st as (select 'gen' as stage, sum(generate_seconds) as seconds from g union all select 'adv', sum(tool_seconds) from g union all select 'other', sum(tool_seconds) from g)
select stage, {r('seconds')} as seconds, {r('''case when stage = 'gen' then seconds * 1000 / rl when stage = 'adv' then seconds * 1000 / al end''')} as per_token_ms from st, t""",
)
def timing_metrics(spark, sf):
    df = rollouts(spark, sf)
    sums = df.agg(F.sum("generate_seconds").alias("g"), F.sum("tool_seconds").alias("t"))
    stages = sums.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("stage"), F.col(c).alias("seconds"))
                    for s, c in [("gen", "g"), ("adv", "t"), ("other", "t")]
                ]
            )
        )
    )
    return rounded(training.timing_metrics(stages, df))


@query(
    "throughput_metrics",
    f"{G} select cast(sum(prompt_length + response_length) as bigint) as total_num_tokens, 12.5e0 as time_per_step, {r('sum(prompt_length + response_length) / (12.5e0 * 8)')} as throughput from g",
)
def throughput_metrics(spark, sf):
    return rounded(training.throughput(rollouts(spark, sf), 12.5, 8))


@query(
    "agent_loop_metrics",
    f"""{G}, s as (select * from g order by generate_seconds + tool_seconds desc, seq_id limit 1),
a as (select {three('generate', 'generate_seconds')}, {three('tool', 'tool_seconds')} from g)
select a.*, s.seq_id as slowest_seq_id, s.generate_seconds as slowest_generate_seconds, s.tool_seconds as slowest_tool_seconds,
s.prompt_length as slowest_prompt_length, s.response_length as slowest_response_length from a, s""",
)
def agent_loop_metrics(spark, sf):
    return rounded(training.agent_metrics(rollouts(spark, sf)))


@query(
    "flops_estimate",
    f"{G}, l as (select (prompt_length + response_length) * 1e0 as n from g) select {r('(6 * 4e9 * sum(n) + 12 * sum(n * n) * 128 * 32 * 36) / 10 / 1e12')} as tflops from l",
)
def flops_estimate(spark, sf):
    df = rollouts(spark, sf).withColumn("length", F.col("prompt_length") + F.col("response_length"))
    return rounded(training.flops(df, 4e9, 36, 32, 128, 10.0))


@query(
    "length_stats",
    f"{G} select data_source, {r('avg(response_length)')} as mean, max(response_length) as max, min(response_length) as min, {r('median(response_length)')} as median, {r('stddev_pop(response_length)')} as std from g group by 1",
)
def length_stats(spark, sf):
    return rounded(training.length_stats(rollouts(spark, sf), "response_length", ["data_source"]))


@query(
    "length_histogram",
    f"""with d as (select n_chars as n from documents), b as (select case when n <= 100 then '0-100' when n <= 200 then '101-200' when n <= 300 then '201-300'
when n <= 400 then '301-400' when n <= 500 then '401-500' when n <= 1000 then '501-1000' else '1001+' end as bucket from d)
select bucket, count(*) as n, {r('count(*) * 100e0 / (select count(*) from d)')} as percent from b group by 1""",
)
def length_histogram(spark, sf):
    return rounded(training.length_histogram(spark.read.parquet(f"{sf}/documents.parquet"), "n_chars"))


# balancing -------------------------------------------------------------------

PLACES = f"""{G}, p as (select seq_id, response_length as length, step, row_number() over (order by response_length desc, seq_id) - 1 as i from g)"""


def snake(k: str, i: str = "i") -> str:
    return f"cast(case when ({i} // {k}) % 2 = 0 then {i} % {k} else {k} - 1 - {i} % {k} end as bigint)"


@query(
    "balanced_partitions",
    f"{PLACES} select seq_id, length, {snake('8')} as part, cast(case when (i // 8) % 2 = 0 then -(i // 8) else i // 8 end as bigint) as slot, 24576 * length + length * length as workload from p",
)
def balanced_partitions(spark, sf):
    df = rollouts(spark, sf).select("seq_id", F.col("response_length").alias("length"))
    return balancing.balance(df, 8).select("seq_id", "length", "part", "slot", "workload")


@query(
    "balanced_partitions_by_minibatch",
    f"{G}, p as (select seq_id, step, row_number() over (partition by step order by response_length desc, seq_id) - 1 as i from g) select seq_id, step, {snake('4')} as part from p",
)
def balanced_partitions_by_minibatch(spark, sf):
    df = rollouts(spark, sf).select("seq_id", "step", F.col("response_length").alias("length"))
    return balancing.balance(df, 4, minibatch="step").select("seq_id", "step", "part")


@query(
    "micro_batches",
    f"{PLACES}, k as (select ceil(greatest(least(count(*), ceil(sum(length) / 30000e0)), 2) / 4e0) * 4 as k from p) select seq_id, {snake('cast(k as bigint)')} as micro_batch from p, k",
)
def micro_batches(spark, sf):
    df = rollouts(spark, sf).select("seq_id", F.col("response_length").alias("length"))
    return balancing.micro_batches(df, 30000, 2, 4).select("seq_id", "micro_batch")


def held_sql(budget: int, rounds: int) -> str:
    """Number of batches raised until no batch of the deal is over the budget."""
    stages = [f"k0 as (select cast(least(count(*), ceil(sum(length) / {budget}e0)) as bigint) as k from p)"]
    for i in range(rounds):
        stages.append(f"m{i} as (select max(s) as most from (select sum(length) as s from p, k{i} group by {snake('k')}))")
        stages.append(f"k{i + 1} as (select case when most > {budget} then greatest(k + 1, cast(ceil(k * most / {budget}e0) as bigint)) else k end as k from k{i}, m{i})")
    return f"{PLACES}, {', '.join(stages)}, k as (select k from k{rounds})"


@query(
    "micro_batches_held",
    f"{held_sql(1500, 4)} select {snake('k')} as micro_batch, count(*) as n, cast(sum(length) as bigint) as tokens, true as within from p, k group by 1",
)
def micro_batches_held(spark, sf):
    """A budget the first deal overruns: tokens of every batch."""
    df = rollouts(spark, sf).select("seq_id", F.col("response_length").alias("length"))
    dealt = balancing.micro_batches(df, 1500).groupBy("micro_batch").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"))
    return dealt.withColumn("within", F.col("tokens") <= 1500)


@query(
    "balanced_loads",
    f"""{PLACES}, w as (select seq_id, 24576 * length + length * length as load, i from p),
c as (select *, sum(load) over (order by i) - load as before, sum(load) over () / 8e0 as share from w)
select seq_id, cast(least(7, floor((before + load / 2e0) / share)) as bigint) as part, load as workload from c""",
)
def balanced_loads(spark, sf):
    df = rollouts(spark, sf).select("seq_id", F.col("response_length").alias("length"))
    return balancing.balance_loads(df, 8).select("seq_id", "part", "workload")


@query(
    "seqlen_imbalance",
    f"""{PLACES}, q as (select length, seq_id % 8 as b, {snake('8')} as a from p), x as (select b, sum(length) as s from q group by 1), y as (select a, sum(length) as s from q group by 1)
select cast(min(x.s) as bigint) as min, cast(max(x.s) as bigint) as max, cast(max(x.s) - min(x.s) as bigint) as minmax_diff,
  (select cast(min(s) as bigint) from y) as balanced_min, (select cast(max(s) as bigint) from y) as balanced_max, {r('avg(x.s)')} as mean from x""",
)
def seqlen_imbalance(spark, sf):
    df = rollouts(spark, sf).select("seq_id", F.col("response_length").alias("length"))
    balanced = balancing.balance(df, 8).withColumn("block", F.col("seq_id") % 8)
    return rounded(training.seqlen_imbalance(balanced, "block", "part"))


@query("workload", f"{G} select seq_id, 24576 * response_length + response_length * response_length as workload from g")
def workload(spark, sf):
    return rollouts(spark, sf).select("seq_id", balancing.workload(F.col("response_length")).alias("workload"))


# sampling --------------------------------------------------------------------


@query("sample_n", "select event_id from events order by event_id limit 500")
def sample_n(spark, sf):
    return sampling.sample_n(derive(spark, sf, PREDICTIONS), 500, "event_id").select("event_id")


@query(
    "sample_n_shuffled",
    f"with p as {plain(PREDICTIONS)} select * from p order by {hash48('event_id', 3)}, event_id limit 500",
)
def sample_n_shuffled(spark, sf):
    return sampling.sample_n(derive(spark, sf, PREDICTIONS), 500, "event_id", shuffle=True, seed=3)


@query(
    "seeded_preview",
    f"select doc_id, text from documents order by {hash48('text', 42)}, text limit 10",
)
def seeded_preview(spark, sf):
    return sampling.preview(spark.read.parquet(f"{sf}/documents.parquet"), 10, "text").select("doc_id", "text")


@query(
    "train_val_split_random",
    f"select case when {hash48('event_id', 7)} / 281474976710656e0 < 0.1e0 then 'test' else 'train' end as split, count(*) as count from events group by 1",
)
def train_val_split_random(spark, sf):
    return sampling.split_random(derive(spark, sf, PREDICTIONS), 0.1, "event_id", 7).groupBy("split").count()


@query(
    "shuffled_order",
    f"select event_id, {hash48('event_id', 1, 2)} as order_key from events",
)
def shuffled_order(spark, sf):
    return sampling.epoch_order(derive(spark, sf, PREDICTIONS).select("event_id"), "event_id", 1, 2)


@query(
    "curriculum_order",
    "select event_id, coalesce(case when event_id % 3 > 0 then cast(value as double) end, cast('inf' as double)) as order_key from events",
)
def curriculum_order(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    scores = events.where(F.col("event_id") % 3 > 0).select("event_id", F.col("value").alias("curriculum_score"))
    return sampling.curriculum_order(events.select("event_id"), scores, "event_id").select("event_id", "order_key")


@query(
    "mini_batches",
    f"with k as (select e.event_id, ep, row_number() over (partition by ep order by {hash48('event_id', 5, 'ep')}, event_id) - 1 as i from events e, (values (0), (1)) as v(ep)) select ep as epoch, i // 100 as batch, count(*) as n, cast(sum(event_id) as bigint) as ids from k group by 1, 2",
)
def mini_batches(spark, sf):
    """Size and members of every batch."""
    df = derive(spark, sf, PREDICTIONS).select("event_id")
    dealt = sampling.mini_batches(df, 100, 2, "event_id", 5)
    return dealt.groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "reweighted_resample",
    f"""{G}, w as (select seq_id, score, greatest(pow(abs(score), 2) + 1e-8, 1e-8) as w from g),
t as (select seq_id, score, coalesce(sum(w) over (order by seq_id rows between unbounded preceding and 1 preceding), 0) / (select sum(w) from w) as at from w),
u as (select i as draw, {hash48('0', 'i', '0')} / 281474976710656e0 as at from range(0, (select count(*) from g)) x(i))
select draw, seq_id, score from u asof join t on u.at >= t.at""",
)
def reweighted_resample(spark, sf):
    return sampling.pf_resample(rollouts(spark, sf).select("seq_id", "score"), "pow", 2.0)


@query(
    "assign_risk_t",
    f"select event_id, round({hash48('event_id', 11)} / 281474976710656e0, 3) as risk_t from events",
)
def assign_risk_t(spark, sf):
    df = derive(spark, sf, PREDICTIONS).select("event_id")
    return sampling.assign_risk_t(df, "event_id", seed=11)


@query(
    "assign_risk_t_override",
    f"with p as {plain(PREDICTIONS)} select event_id, {r('''case when event_id % 5 = 0 then 0.5 else least(1, greatest(0, risk_t * 2 - 0.5)) end''')} as risk_t from p",
)
def assign_risk_t_override(spark, sf):
    given = F.when(F.col("event_id") % 5 == 0, F.lit("bad")).otherwise((F.col("risk_t") * 2 - 0.5).cast("string"))
    df = derive(spark, sf, PREDICTIONS).select("event_id", given.alias("given"))
    return rounded(sampling.assign_risk_t(df, "event_id", "given").select("event_id", "risk_t"))
