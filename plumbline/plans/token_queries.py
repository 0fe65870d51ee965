"""Queries over token tables: masks, advantages, off-policy, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import advantages as A
from plumbline.operators import losses as L
from plumbline.operators import offpolicy as O
from plumbline.operators import tokens as K
from plumbline.operators import training
from plumbline.plans.carriers import ROLLOUTS, TOKENS, derive, hash48, plain, r, rounded, table
from plumbline.plans.registry import query

T = f"with recursive k as {plain(TOKENS)}"
T1 = f"with k as {plain(TOKENS)}"


#: Rows of lineitem one task sums up to tokens.
TASK_ROWS = 1 << 18


def tokens(spark, sf):
    """The token table; tasks that sum up lines grow in number with them, not in size."""
    lines = table(spark, sf, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_ROWS))
    dealt = lines.repartition(parts, "l_orderkey")
    return spark.sql(TOKENS, lineitem=dealt, orders=table(spark, sf, "orders")).withColumnRenamed("ret", "return")


def by_token(df, *cols):
    return rounded(df.select("seq_id", "pos", *cols))


# masks and rewards -----------------------------------------------------------


@query(
    "place_terminal_reward",
    f"""{T1}, z as (select seq_id, max(case when mask = 1 then pos end) as last, max(ret) as score from k group by 1)
select seq_id, pos, {r('case when pos = last then score else 0 end')} as reward from k join z using (seq_id)""",
)
def place_terminal_reward(spark, sf):
    df = tokens(spark, sf)
    rollouts = df.groupBy("seq_id").agg(F.max("return").alias("score"))
    return by_token(K.place_terminal_reward(df.drop("reward"), rollouts), "reward")


@query(
    "response_mask_eos",
    f"""{T1}, z as (select seq_id, min(pos) as e from k where token_id in (3, 7, 11) group by 1)
select seq_id, pos, case when e is null or pos <= e then 1 else 0 end as mask from k left join z using (seq_id)""",
)
def response_mask_eos(spark, sf):
    return K.eos_mask(tokens(spark, sf).drop("mask"), [3, 7, 11]).select("seq_id", "pos", "mask")


@query(
    "position_ids",
    f"{T1} select seq_id, pos, cast(greatest(sum(mask) over (partition by seq_id order by pos) - 1, 0) as bigint) as position_id from k",
)
def position_ids(spark, sf):
    return K.position_ids(tokens(spark, sf), chunk=4).select("seq_id", "pos", "position_id")


@query("kl_estimate", f"{T1} select seq_id, pos, {r('exp(ref_log_prob - log_prob) - (ref_log_prob - log_prob) - 1')} as k3, {r('0.5e0 * (log_prob - ref_log_prob) * (log_prob - ref_log_prob)')} as k2, {r('abs(log_prob - ref_log_prob)')} as k_abs, {r('log_prob - ref_log_prob')} as k1 from k")
def kl_estimate(spark, sf):
    a, b = F.col("log_prob"), F.col("ref_log_prob")
    kinds = [K.kl(a, b, kind).alias(name) for kind, name in [("k3+", "k3"), ("k2", "k2"), ("abs", "k_abs"), ("k1", "k1")]]
    return by_token(tokens(spark, sf), *kinds)


KLR = "(old_log_prob - ref_log_prob) * mask"


@query("kl_in_reward", f"{T1} select seq_id, pos, {r(f'reward - 0.05e0 * {KLR}')} as reward from k")
def kl_in_reward(spark, sf):
    return by_token(K.apply_kl_penalty(tokens(spark, sf), 0.05, score="reward"), "reward")


@query("kl_in_reward_mean", f"{T1}, q as (select seq_id, sum({KLR} * mask) / (sum(mask) + 1e-8) as m from k group by 1) select {r('avg(m)')} as mean_kl from q")
def kl_in_reward_mean(spark, sf):
    return rounded(K.mean_sequence_kl(K.apply_kl_penalty(tokens(spark, sf), 0.05, score="reward")))


@query(
    "masked_stats",
    f"{T1} select token_id, {r('coalesce(sum(value) filter (where mask = 1), 0)')} as masked_sum, {r('sum(value) filter (where mask = 1) / (sum(mask) + 1e-8)')} as masked_mean, {r('var_samp(value) filter (where mask = 1)')} as masked_var from k group by 1",
)
def masked_stats(spark, sf):
    """Token ids divisible by five are never valid: no mean and no variance."""
    return rounded(K.masked_stats(tokens(spark, sf), "value", ["token_id"], strict=False))


@query("batch_mean_std", f"{T1} select {r('avg(value)')} as mean, {r('max(value)')} as max, {r('min(value)')} as min, {r('stddev_samp(value)')} as std from k")
def batch_mean_std(spark, sf):
    return rounded(K.group_moments(tokens(spark, sf), "value"))


MOM = """mu as (select sum(mask * {c}) / sum(mask) as mu, sum(mask) as w from {f}),
vv as (select sum(mask * ({c} - mu) * ({c} - mu)) / (max(w) - 1) as v from {f}, mu)"""


def whiten_sql(c: str, f: str) -> str:
    return MOM.format(c=c, f=f)


@query("whiten", f"{T1}, {whiten_sql('value', 'k')} select seq_id, pos, {r('(value - mu) / sqrt(v + 1e-8)')} as white from k, mu, vv")
def whiten(spark, sf):
    return by_token(A.whiten(tokens(spark, sf), "value", "white"), "white")


# recurrences -----------------------------------------------------------------

ORDERED = "o as (select k.*, row_number() over (partition by seq_id order by pos desc) as rn from k)"
GAE = f"""{T}, {ORDERED},
a as (select o.*, 0e0 as nv, mask * (reward - value) as g, mask * value as carry from o where rn = 1
  union all
  select o.*, a.carry, mask * (o.reward + 0.99e0 * a.carry - o.value) + (mask_f) * a.g, o.mask * o.value + (1 - o.mask) * a.carry
  from o join a on o.seq_id = a.seq_id and o.rn = a.rn + 1)""".replace(
    "mask * (o.reward + 0.99e0 * a.carry - o.value) + (mask_f) * a.g",
    "o.mask * (o.reward + 0.99e0 * a.carry - o.value) + (o.mask * 0.99e0 * 0.97e0 + (1 - o.mask)) * a.g",
)


@query(
    "adv_gae",
    f"{GAE}, {whiten_sql('g', 'a')} select seq_id, pos, {r('(g - mu) / sqrt(v + 1e-8)')} as advantage, {r('g + value')} as ret from a, mu, vv",
)
def adv_gae(spark, sf):
    out = A.advantage(tokens(spark, sf).drop("advantage", "return"), "gae", gamma=0.99, lam=0.97)
    return by_token(out, "advantage", F.col("return").alias("ret"))


RPP = f"""{T}, {ORDERED},
a as (select o.*, reward as ret2, mask * reward as u from o where rn = 1
  union all select o.*, o.reward + 0.99e0 * a.u, o.mask * (o.reward + 0.99e0 * a.u) from o join a on o.seq_id = a.seq_id and o.rn = a.rn + 1)"""


@query(
    "adv_reinforce_pp",
    f"{RPP}, {whiten_sql('ret2', 'a')} select seq_id, pos, {r('mask * (ret2 - mu) / sqrt(v + 1e-8)')} as advantage, {r('ret2')} as ret from a, mu, vv",
)
def adv_reinforce_pp(spark, sf):
    out = A.advantage(tokens(spark, sf).drop("advantage", "return"), "reinforce_plus_plus", gamma=0.99)
    return by_token(out, "advantage", F.col("return").alias("ret"))


@query(
    "adv_remax",
    f"""{T1}, b as (select uid, max(value) as base from k group by 1)
select seq_id, pos, {r('sum(reward * mask) over (partition by seq_id order by pos desc) - base * mask')} as advantage from k join b using (uid)""",
)
def adv_remax(spark, sf):
    df = tokens(spark, sf).drop("advantage", "return")
    greedy = df.groupBy("uid").agg(F.max("value").alias("reward_baseline"))
    return by_token(A.remax(df, greedy), "advantage")


PRIME = f"""{T1}, q as (select uid, seq_id, avg(value) as rm, max(acc) as acc, max(pos) as last from (select k.*, seq_id % 2 as acc from k) x where mask = 1 group by 1, 2),
g as (select uid, count(*) as n, sum(rm) as rms, sum(acc) as accs from q group by 1),
z as (select k.*, n, case when mask = 1 and n > 1 then 2e0 * (k.value * n / (n - 1) - rms / (n - 1))
   + case when pos = last then 3e0 * ((k.seq_id % 2) * n / (n - 1e0) - accs / (n - 1e0)) else 0 end else 0 end as rr
   from k left join g using (uid) left join q using (uid, seq_id)),
a as (select z.*, sum(rr) over (partition by uid, seq_id order by pos desc) as ret2 from z)"""


@query(
    "adv_prime_rloo",
    f"{PRIME}, {whiten_sql('ret2', 'a')} select seq_id, pos, {r('(ret2 - mu) / sqrt(v + 1e-8)')} as advantage, {r('ret2', 9)} as ret from a, mu, vv",
)
def adv_prime_rloo(spark, sf):
    """Prompts without any valid token have no baseline: their rewards are zero."""
    df = tokens(spark, sf).drop("advantage", "return").withColumn("rm_score", F.col("value"))
    df = df.withColumn("acc", (F.col("seq_id") % 2).cast("double"))
    out = A.prime_rloo(df, 2.0, 3.0)
    return rounded(out.select("seq_id", "pos", F.round("advantage", 6).alias("advantage"), F.col("return").alias("ret")), 9)


# off-policy ------------------------------------------------------------------

LR = "(old_log_prob - rollout_log_prob)"
W = f"exp(greatest(-20, least(20, {LR})))"


@query("is_weights_token", f"{T1} select seq_id, pos, {r(f'least({W} * mask, 1.05e0)')} as is_weight from k")
def is_weights_token(spark, sf):
    return by_token(K.is_weights(tokens(spark, sf), "token", 1.05), "is_weight")


SEQ = f"q as (select seq_id, coalesce(sum({LR}) filter (where mask = 1), 0) as lr, sum(mask) as n from k group by 1)"


@query(
    "is_weights_sequence",
    f"""{T1}, {SEQ}, w as (select k.*, least(exp(greatest(-20, least(20, lr))) * mask, 1.1e0) as w from k join q using (seq_id)),
m as (select avg(sw) as m from (select sum(w) / (sum(mask) + 1e-8) as sw, sum(mask) as n from w group by seq_id) where n > 0)
select seq_id, pos, {r('w / m')} as is_weight from w, m""",
)
def is_weights_sequence(spark, sf):
    return by_token(K.is_weights(tokens(spark, sf), "sequence", 1.1, normalize=True), "is_weight")


@query("reject_offpolicy_tokens", f"{T1} select seq_id, pos, mask * case when {W} between 0.95e0 and 1.05e0 then 1 else 0 end as kept_mask from k")
def reject_offpolicy_tokens(spark, sf):
    return K.rejection_mask(tokens(spark, sf), "token", 1.05, 0.95).select("seq_id", "pos", "kept_mask")


@query(
    "reject_offpolicy_geometric",
    f"{T1}, {SEQ} select seq_id, pos, mask * case when exp(lr / (n + 1e-8)) between 0.97e0 and 1.031e0 then 1 else 0 end as kept_mask from k join q using (seq_id)",
)
def reject_offpolicy_geometric(spark, sf):
    return K.rejection_mask(tokens(spark, sf), "geometric", 1.031, 0.97).select("seq_id", "pos", "kept_mask")


VETO = f"z as (select seq_id, max(case when mask = 1 and {LR} < ln(0.9e0) then 1 else 0 end) as v from k group by 1)"


@query("veto_sequences", f"{T1}, {VETO} select seq_id, pos, mask * (1 - v) as kept_mask from k join z using (seq_id)")
def veto_sequences(spark, sf):
    return K.veto_sequences(tokens(spark, sf), 0.9).select("seq_id", "pos", "kept_mask")


@query(
    "rollout_correction",
    f"""{T1}, {VETO} select seq_id, pos, {r(f'least({W} * mask, 1.05e0)')} as is_weight,
mask * (mask * case when {W} between 0.95e0 and 1.05e0 then 1 else 0 end) * (mask * (1 - v)) as kept_mask from k join z using (seq_id)""",
)
def rollout_correction(spark, sf):
    out = O.rollout_correction(tokens(spark, sf), "token", 1.05, "token", 1.05, 0.95, 0.9)
    return by_token(out, "is_weight", "kept_mask")


OFF = f"""q as (select seq_id, coalesce(sum(old_log_prob) filter (where mask = 1), 0) / (sum(mask) + 1e-8) as tr,
  coalesce(sum(rollout_log_prob) filter (where mask = 1), 0) / (sum(mask) + 1e-8) as ro, sum(mask) as n,
  coalesce(sum({LR}) filter (where mask = 1), 0) as lr, sum(exp({LR}) - {LR} - 1) filter (where mask = 1) as k3,
  sum({W} * {W}) filter (where mask = 1) as rho from k group by 1)"""
OFF_COLS = {
    "training_ppl": "avg(exp(-tr))",
    "training_log_ppl": "avg(-tr)",
    "kl": "-sum(lr) / (sum(n) + 1e-8)",
    "k3_kl": "sum(k3) / (sum(n) + 1e-8)",
    "rollout_ppl": "avg(exp(-ro))",
    "rollout_log_ppl": "avg(-ro)",
    "log_ppl_diff": "avg(ro - tr)",
    "log_ppl_abs_diff": "avg(abs(ro - tr))",
    "log_ppl_diff_max": "max(ro - tr)",
    "log_ppl_diff_min": "min(ro - tr)",
    "ppl_ratio": "avg(exp(ro - tr))",
    "chi2_token": "sum(rho) / (sum(n) + 1e-8) - 1",
    "chi2_seq": "avg(exp(2 * greatest(-20, least(20, lr)))) - 1",
}


@query("offpolicy_metrics", f"{T1}, {OFF} select " + ", ".join(f"{r(e)} as {n}" for n, e in OFF_COLS.items()) + " from q")
def offpolicy_metrics(spark, sf):
    return rounded(O.offpolicy_metrics(tokens(spark, sf)))


CUT = f"greatest(1 / 1.05e0, least(1.05e0, {W}))"
ISM = f"""q as (select seq_id, sum({W} * mask) as w, sum(mask) as n, sum({CUT} * mask) as wc, sum({CUT} * {CUT} * mask) as wc2,
  sum(case when {W} > 1.05e0 then mask else 0 end) as hi, sum(case when {W} < 1 / 1.05e0 then mask else 0 end) as lo,
  max({W}) filter (where mask = 1) as mx, min({W}) filter (where mask = 1) as mn from k group by 1),
s as (select *, w / (n + 1e-8) as sm from q)"""
N = "(sum(n) + 1e-8)"


def ratio_cols(prefix: str) -> dict[str, str]:
    return {
        f"{prefix}_mean": f"sum(w) / {N}",
        f"{prefix}_max": "max(mx)",
        f"{prefix}_min": "min(mn)",
        f"{prefix}_std": f"sqrt(greatest(sum(wc2) / {N} - (sum(wc) / {N}) * (sum(wc) / {N}), 0))",
        f"{prefix}_ratio_fraction_high": f"sum(hi) / {N}",
        f"{prefix}_ratio_fraction_low": f"sum(lo) / {N}",
        f"{prefix}_eff_sample_size": f"(sum(wc) / {N} + 1e-8) * (sum(wc) / {N} + 1e-8) / (sum(wc2) / {N})",
        f"{prefix}_seq_mean": "avg(sm)",
        f"{prefix}_seq_std": "stddev_samp(sm)",
        f"{prefix}_seq_max": "max(sm)",
        f"{prefix}_seq_min": "min(sm)",
        f"{prefix}_seq_max_deviation": "max(abs(sm - 1))",
        f"{prefix}_seq_fraction_high": "avg(case when sm > 1.05e0 then 1e0 else 0e0 end)",
        f"{prefix}_seq_fraction_low": "avg(case when sm < 1 / 1.05e0 then 1e0 else 0e0 end)",
    }


def ratio_sql(prefix: str) -> str:
    return ", ".join(f"{r(e)} as {n}" for n, e in ratio_cols(prefix).items())


@query("is_weight_metrics", f"{T1}, {ISM} select {ratio_sql('rollout_is')} from s")
def is_weight_metrics(spark, sf):
    return rounded(O.is_metrics(tokens(spark, sf), "token", 1.05))


@query(
    "rs_metrics",
    f"""{T1}, {ISM}, b as (select {ratio_sql('rollout_rs')} from s),
kk as (select seq_id, sum(mask) as n, sum(mask * case when {W} between 1 / 1.05e0 and 1.05e0 then 1 else 0 end) as kept from k group by 1)
select b.*, c.* from b, (select {r('1 - sum(kept) / sum(n)')} as rollout_rs_masked_fraction, {r('avg(case when kept < n then 1e0 else 0e0 end)')} as rollout_rs_seq_masked_fraction from kk) c""",
)
def rs_metrics(spark, sf):
    return rounded(O.rs_metrics(tokens(spark, sf), "token", 1.05))


@query(
    "rollout_correction_metrics",
    f"{T1}, {OFF}, {ISM.replace('q as', 'iq as').replace('from q', 'from iq')}, x as (select "
    + ", ".join(f"{e} as {n}" for n, e in OFF_COLS.items())
    + " from q), y as (select "
    + ", ".join(f"{e} as {n}" for n, e in ratio_cols("rollout_is").items())
    + " from s), z as (select name, value from (unpivot x on "
    + ", ".join(OFF_COLS)
    + " into name name value value) union all select name, value from (unpivot y on "
    + ", ".join(ratio_cols("rollout_is"))
    + " into name name value value)) select 'rollout_corr/' || name as metric, "
    + r("value")
    + " as value from z",
)
def rollout_correction_metrics(spark, sf):
    return rounded(O.rollout_correction_metrics(tokens(spark, sf), "token", 1.05))


@query(
    "logprob_drift",
    f"{T1}, g as (select abs(exp(old_log_prob) - exp(rollout_log_prob)) as d, exp(old_log_prob) as p, exp(rollout_log_prob) as q from k where mask = 1) select {r('max(d)')} as diff_max, {r('avg(d)')} as diff_mean, {r('stddev_samp(d)')} as diff_std, {r('corr(p, q)')} as pearson from g",
)
def logprob_drift(spark, sf):
    return rounded(K.logprob_drift(tokens(spark, sf)))


@query("token_mismatch_count", f"{T1} select seq_id, count(*) filter (where mask = 1 and token_id <> other_token_id) as n_diff from k group by 1")
def token_mismatch_count(spark, sf):
    return K.token_mismatch(tokens(spark, sf), "token_id", "other_token_id")


@query("sequence_logprob", f"{T1} select seq_id, {r('coalesce(sum(log_prob) filter (where mask = 1), 0)')} as logp from k group by 1")
def sequence_logprob(spark, sf):
    return rounded(K.sequence_logprob(tokens(spark, sf)))


COV = "c as (select k.*, (advantage - avg(advantage) over ()) * (log_prob - avg(log_prob) over ()) as cov, count(*) over () as n from k where mask = 1)"


@query(
    "topk_covariance",
    f"{T1}, {COV}, o as (select c.*, row_number() over (order by round(cov, 10) desc, seq_id, pos) as rn from c) select {r('sum(cov)', 4)} as total, count(*) as n_tokens, {r('min(cov)')} as cut from o where rn <= greatest(1, floor(n * 0.02e0))",
)
def topk_covariance(spark, sf):
    top = K.topk_covariance(tokens(spark, sf), 0.02)
    out = top.agg(F.round(F.sum("cov"), 4).alias("total"), F.count(F.lit(1)).alias("n_tokens"), F.min("cov").alias("cut"))
    return rounded(out)


# losses ----------------------------------------------------------------------

NM = "(sum(n) + 1e-8)"
MODE_SQL = {
    "token-mean": f"sum(s) / {NM}",
    "seq-mean-token-sum": "sum(s) filter (where n > 0) / count(*) filter (where n > 0)",
    "seq-mean-token-mean": "sum(s / (n + 1e-8)) filter (where n > 0) / count(*) filter (where n > 0)",
    "seq-mean-token-sum-norm": "sum(s) / (max(last) + 1)",
}


def loss_sql(loss: str, mode: str = "token-mean", extra: dict[str, str] | None = None, source: str = "k", pre: str = "", scale: str = "") -> str:
    extra = extra or {}
    xs = "".join(f", sum(({e}) * mask) as x_{n}" for n, e in extra.items())
    outs = "".join(f", {r(f'sum(x_{n}) / {NM}')} as {n}" for n in extra)
    return f"""{T1}{pre}, q as (select seq_id, sum(({loss}) * mask) as s, sum(mask) as n, max(pos) as last{xs} from {source} group by 1)
select {r(scale + MODE_SQL[mode])} as loss{outs} from q"""


for _mode in L.MODES:

    @query(f"aggregate_loss_{_mode.replace('-', '_')}", loss_sql("value", _mode))
    def aggregate_loss(spark, sf, mode=_mode):
        return rounded(L.aggregate_loss(tokens(spark, sf), mode, col="value"))


D = "(log_prob - old_log_prob)"
RATIO = f"exp({D})"
P1 = f"(-advantage * {RATIO})"
P2 = f"(-advantage * greatest(0.9e0, least(1.1e0, {RATIO})))"
UP = f"greatest({P1}, {P2})"
DUAL = "(-advantage * 1.2e0)"
PPO = f"case when advantage < 0 then least({DUAL}, {UP}) else {UP} end"
PPO_EXTRA = {
    "pg_clipfrac": f"case when {P2} > {P1} then 1e0 else 0e0 end",
    "ppo_kl": f"-{D}",
    "pg_clipfrac_lower": f"case when {UP} > {DUAL} and advantage < 0 then 1e0 else 0e0 end",
}


@query("ppo_loss", loss_sql(PPO, extra=PPO_EXTRA))
def ppo_loss(spark, sf):
    return rounded(L.policy_loss(tokens(spark, sf), "vanilla", clip_lo=0.1, clip_hi=0.1, clip_c=1.2))


GS = ", gs as (select seq_id, sum((log_prob - old_log_prob) * mask) / greatest(sum(mask), 1) as d from k group by 1), kk as (select k.*, exp(least(gs.d, 10)) as rt from k join gs using (seq_id))"
G1, G2 = "(-advantage * rt)", "(-advantage * greatest(0.95e0, least(1.05e0, rt)))"


@query(
    "gspo_loss",
    loss_sql(f"greatest({G1}, {G2})", "seq-mean-token-mean", {"pg_clipfrac": f"case when {G2} > {G1} then 1e0 else 0e0 end", "ppo_kl": f"-{D}"}, "kk", GS),
)
def gspo_loss(spark, sf):
    return rounded(L.policy_loss(tokens(spark, sf), "gspo", clip_lo=0.05, clip_hi=0.05))


CC2 = f"(-advantage * greatest(0.8e0, least(1.2e0, {RATIO})))"


@query("gpg_loss", loss_sql("-log_prob * advantage"))
def gpg_loss(spark, sf):
    return rounded(L.policy_loss(tokens(spark, sf), "gpg"))


CC = f""", {COV}, d as (select seq_id, pos, n, {hash48('seq_id', 'pos', 0)} as draw from c where cov > 0.01e0 and cov < 5 and not {CC2} > {P1}),
o as (select d.*, row_number() over (order by draw desc, seq_id, pos) as rn from d),
kk as (select k.*, coalesce(o.rn <= greatest(1, floor(o.n * 0.01e0)), false) as gone from k left join o using (seq_id, pos))"""


@query(
    "clip_cov_loss",
    loss_sql(f"case when gone then 0e0 else greatest({P1}, {CC2}) end", extra={"pg_clipfrac": "case when gone then 1e0 else 0e0 end", "ppo_kl": f"-{D}"}, source="kk", pre=CC),
)
def clip_cov_loss(spark, sf):
    return rounded(L.policy_loss(tokens(spark, sf), "clip_cov", ratio=0.01, lb=0.01, ub=5.0))


KC = f""", {COV}, o as (select c.*, row_number() over (order by cov desc, seq_id, pos) as rn from c),
kk as (select k.*, coalesce(o.rn <= greatest(1, floor(o.n * 0.02e0)), false) as top from k left join o using (seq_id, pos))"""


@query("kl_cov_loss", loss_sql(f"{P1} + case when top then 0.5e0 * abs({D}) else 0 end", extra={"ppo_kl": f"abs({D})"}, source="kk", pre=KC))
def kl_cov_loss(spark, sf):
    return rounded(L.policy_loss(tokens(spark, sf), "kl_cov", ratio=0.02, coef=0.5))


BD = f"greatest(-0.05e0, least(0.05e0, {D}))"
SG = "sign(advantage)"


@query(
    "geo_mean_loss",
    f"""{T1}, q as (select seq_id, sum({SG} * least({SG} * {D}, {SG} * {BD}) * mask) as c, sum(advantage * mask) as a, sum(mask) as n, sum({D} * mask) as d,
  sum(case when {D} <> {BD} and advantage > 0 then mask else 0 end) as hi, sum(case when {D} <> {BD} and advantage < 0 then mask else 0 end) as lo from k group by 1)
select {r('avg(-(a / (n + 1e-8)) * exp(c / (n + 1e-8)))')} as loss, {r(f'sum(hi) / {NM}')} as pg_clipfrac, {r(f'-sum(d) / {NM}')} as ppo_kl, {r(f'sum(lo) / {NM}')} as pg_clipfrac_lower from q""",
)
def geo_mean_loss(spark, sf):
    return rounded(L.policy_loss(tokens(spark, sf), "geo_mean", clip_lo=0.05, clip_hi=0.05))


@query("reinforce_loss", loss_sql("-advantage * log_prob", extra={"ppo_kl": "rollout_log_prob - log_prob"}))
def reinforce_loss(spark, sf):
    return rounded(L.policy_loss(tokens(spark, sf), "reinforce"))


BLR = "(log_prob - rollout_log_prob)"
BW = f"exp({BLR})"
BYPASS = f", kk as (select k.* exclude (mask), mask * case when {BW} between 0.9e0 and 1.1e0 then 1 else 0 end as mask, least({BW} * mask, 1.05e0) as iw from k)"


@query("bypass_loss_reinforce", loss_sql("-advantage * log_prob * iw", extra={"ppo_kl": "rollout_log_prob - log_prob"}, source="kk", pre=BYPASS))
def bypass_loss_reinforce(spark, sf):
    out = L.policy_loss(
        tokens(spark, sf), "bypass_mode", loss_type="reinforce", is_level="token", is_threshold=1.05, rs_level="token", rs_upper=1.1, rs_lower=0.9
    )
    return rounded(out)


def swapped(expr: str) -> str:
    return expr.replace("old_log_prob", "rollout_log_prob")


@query("bypass_loss_ppo", loss_sql(swapped(PPO), extra={n: swapped(e) for n, e in PPO_EXTRA.items()}, source="kk", pre=BYPASS))
def bypass_loss_ppo(spark, sf):
    out = L.policy_loss(
        tokens(spark, sf), "bypass_mode", rs_level="token", rs_upper=1.1, rs_lower=0.9, clip_lo=0.1, clip_hi=0.1, clip_c=1.2
    )
    return rounded(out)


VC = "greatest(value - 0.1e0, least(value + 0.1e0, vpred))"
V1, V2 = "((vpred - ret) * (vpred - ret))", f"(({VC} - ret) * ({VC} - ret))"


@query("value_loss", loss_sql(f"greatest({V1}, {V2})", extra={"vf_clipfrac": f"case when {V2} > {V1} then 1e0 else 0e0 end"}, scale="0.5e0 * "))
def value_loss(spark, sf):
    return rounded(L.value_loss(tokens(spark, sf), 0.1))


@query("sft_nll", f"{T1} select {r('-sum(log_prob * mask) / sum(mask)')} as loss from k")
def sft_nll(spark, sf):
    return rounded(L.sft_nll(tokens(spark, sf)))


@query(
    "sft_nll_shifted",
    f"{T1}, a as (select k.log_prob, coalesce(n.mask, 0) as m from k left join k n on k.seq_id = n.seq_id and n.pos = k.pos + 1) select {r('-sum(log_prob * m) / sum(m)')} as loss from a",
)
def sft_nll_shifted(spark, sf):
    return rounded(L.sft_nll(tokens(spark, sf), shift=True))


@query("entropy_mean", loss_sql("entropy", "seq-mean-token-mean").replace("as loss", "as entropy"))
def entropy_mean(spark, sf):
    return rounded(L.entropy_mean(tokens(spark, sf), "seq-mean-token-mean"))


@query(
    "policy_objective",
    f"""{T1}, q as (select seq_id, sum(({P1.replace(P1, UP)}) * mask) as s, sum(entropy * mask) as e, sum((exp(ref_log_prob - log_prob) - (ref_log_prob - log_prob) - 1) * mask) as d, sum(mask) as n from k group by 1),
z as (select sum(s) / {NM} as pg, sum(e) / {NM} as en, sum(d) / {NM} as kl from q)
select {r('pg - 0.01e0 * en + 0.1e0 * kl')} as objective, {r('pg')} as pg_loss, {r('en')} as entropy, {r('kl')} as kl_loss from z""",
)
def policy_objective(spark, sf):
    out = L.policy_objective(tokens(spark, sf), "vanilla", 0.01, 0.1, clip_lo=0.1, clip_hi=0.1, clip_c=1e9)
    return rounded(out)


@query(
    "adaptive_kl",
    f"""with p as (select user_id as run, event_id as step, cast((event_id * 7919) % 101 as double) / 1000 as kl from events),
f as (select *, 1 + greatest(-0.2e0, least(0.2e0, kl / 0.05e0 - 1)) * 8 / 10000e0 as m from p)
select run, step, {r('0.2e0 * exp(sum(ln(m)) over (partition by run order by step))')} as beta from f""",
)
def adaptive_kl(spark, sf):
    steps = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("step"),
        (((F.col("event_id") * 7919) % 101).cast("double") / 1000).alias("kl"),
        F.lit(8).alias("n_steps"),
    )
    return rounded(L.kl_controller(steps, 0.2, 0.05, 10000.0).select("run", "step", "beta"))


def batch_three(name: str, expr: str, where: str = "") -> str:
    f = f" filter (where {where})" if where else ""
    return f"{r(f'avg({expr}){f}')} as {name}_mean, max({expr}){f} as {name}_max, min({expr}){f} as {name}_min"


@query(
    "batch_data_metrics",
    f"""with g as {plain(ROLLOUTS)}, k as {plain(TOKENS)},
a as (select {batch_three('score', 'score', 'response_length > 0')}, {r('avg(reward) filter (where response_length > 0)')} as reward_mean,
  {r('max(reward) filter (where response_length > 0)')} as reward_max, {r('min(reward) filter (where response_length > 0)')} as reward_min,
  {batch_three('response_length', 'response_length')}, {r('avg(case when response_length = 200 then 1e0 else 0e0 end)')} as response_length_clip_ratio,
  {batch_three('response_length_non_aborted', 'response_length', 'response_length > 0')},
  {r('avg(case when response_length = 200 then 1e0 else 0e0 end) filter (where response_length > 0)')} as response_length_non_aborted_clip_ratio,
  {r('avg(case when response_length = 0 then 1e0 else 0e0 end)')} as aborted_ratio,
  {batch_three('prompt_length', 'prompt_length')}, {r('avg(case when prompt_length = 116 then 1e0 else 0e0 end)')} as prompt_length_clip_ratio from g),
b as (select {batch_three('advantage', 'advantage')}, {batch_three('return', 'ret')}, {batch_three('value', 'value')},
  {r('1 - var_samp(ret - value) / (var_samp(ret) + 1e-5)')} as vf_explained_var from k where mask = 1)
select a.*, b.* from a, b""",
)
def batch_data_metrics(spark, sf):
    rollouts = derive(spark, sf, ROLLOUTS)
    return rounded(training.data_metrics(rollouts, tokens(spark, sf), 200, 116))
