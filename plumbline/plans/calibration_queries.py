"""Calibration, risk, vote and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import calibration as C
from plumbline.operators import reports, risk, votes
from plumbline.plans.carriers import PREDICTIONS, RESULTS, SAMPLES, derive, plain, r, rounded
from plumbline.plans.registry import query

P = f"with p as {plain(PREDICTIONS)}"
BY = ["data_source"]


def preds(spark, sf):
    return derive(spark, sf, PREDICTIONS)


@query("brier_score", f"{P} select data_source, {r('avg((confidence - correct) * (confidence - correct))')} as brier from p group by 1")
def brier_score(spark, sf):
    return rounded(C.brier_score(preds(spark, sf), BY))


CLIPPED = "greatest(1e-10, least(1 - 1e-10, confidence))"
NLL = f"avg(-(correct * ln({CLIPPED}) + (1 - correct) * ln(1 - {CLIPPED})))"


@query("nll", f"{P} select data_source, {r(NLL)} as nll from p group by 1")
def nll(spark, sf):
    return rounded(C.nll(preds(spark, sf), BY))


BINS = """b as (select p.*, case when confidence <= 0.1e0 then 0 when confidence <= 2*0.1e0 then 1
  when confidence <= 3*0.1e0 then 2 when confidence <= 4*0.1e0 then 3 when confidence <= 5*0.1e0 then 4
  when confidence <= 6*0.1e0 then 5 when confidence <= 7*0.1e0 then 6 when confidence <= 8*0.1e0 then 7
  when confidence <= 9*0.1e0 then 8 else 9 end as bin from p),
g as (select data_source, bin, count(*) as n, avg(cast(correct as double)) as a, avg(confidence) as c from b group by 1, 2)"""


@query("ece", f"{P}, {BINS} select data_source, {r('sum(n * abs(a - c)) / sum(n)')} as ece from g group by 1")
def ece(spark, sf):
    return rounded(C.ece(preds(spark, sf), BY))


GRID200 = "grid as (select case when i = 199 then 1e0 else i * (1e0 / 199) end as g from range(0, 200) t(i))"
COUNTS = "n as (select data_source, confidence as c, count(*) as n, sum(correct) as pos from p group by 1, 2)"


def smooth_sql(grid: str, eps: str) -> str:
    return f"""{P}, {COUNTS}, {grid},
d as (select data_source, g, sum(n * exp(-((c - g) * (c - g)) / (2 * 0.1e0 * 0.1e0))) as d,
             sum(pos * exp(-((c - g) * (c - g)) / (2 * 0.1e0 * 0.1e0))) as h from n, grid group by 1, 2)
select data_source, {r(f'sum(abs(h / d - g) * d) / (sum(d) + {eps})')} as smooth_ece from d group by 1"""


@query("smoothed_ece", smooth_sql(GRID200, "1e-12"))
def smoothed_ece(spark, sf):
    return rounded(C.smoothed_ece(preds(spark, sf), BY))


@query("smoothed_ece_centers", smooth_sql("grid as (select (i + 0.5e0) / 15 as g from range(0, 15) t(i))", "1e-10"))
def smoothed_ece_centers(spark, sf):
    return rounded(C.smoothed_ece_centers(preds(spark, sf), BY))


AUC = """a as (select data_source, pos, n - pos as neg,
  coalesce(sum(n - pos) over (partition by data_source order by c rows between unbounded preceding and 1 preceding), 0) as below from n)"""


@query("confidence_auc", f"{P}, {COUNTS}, {AUC} select data_source, {r('sum(pos * (below + neg / 2e0)) / (sum(pos) * 1e0 * sum(neg))')} as auc from a group by 1")
def confidence_auc(spark, sf):
    return rounded(C.confidence_auc(preds(spark, sf), BY))


def sweep_sql(steps: int, size: str) -> str:
    return f"""t as (select i * {size} as t from range(0, {steps}) x(i)),
s as (select data_source, t, count(*) as total, sum(correct) as total_pos,
             sum(case when confidence >= t then 1 else 0 end) as answered,
             sum(case when confidence >= t and correct = 1 then 1 else 0 end) as rgt,
             sum(case when confidence >= t and correct = 0 then 1 else 0 end) as wrg from p, t group by 1, 2)"""


SWEEP101 = sweep_sql(101, "0.01e0")
AREA = """v as (select data_source, t, rgt / total as acc, wrg / total as hal,
  lead(t) over (partition by data_source order by t) - t as step,
  lead(rgt / total) over (partition by data_source order by t) as acc1,
  lead(wrg / total) over (partition by data_source order by t) as hal1 from s),
areas as (select data_source, sum((acc + acc1) / 2 * step) as aa, sum((hal + hal1) / 2 * step) as ha,
  max(case when t = 0 then acc end) as a0, max(case when t = 0 then hal end) as h0 from v group by 1)"""
GAIN = "case when h0 > 0 and ha > 0 and a0 > 0 then ln((aa / ha) / (a0 / h0)) else 0 end"


@query("snr_gain", f"{P}, {SWEEP101}, {AREA} select data_source, {r(GAIN)} as snr_gain from areas")
def snr_gain(spark, sf):
    return rounded(C.snr_gain(preds(spark, sf), BY))


@query(
    "abstention_accuracy",
    f"{P} select data_source, {r('avg(case when (confidence >= 0.5) = (correct = 1) then 1e0 else 0e0 end)')} as abstention_accuracy from p group by 1",
)
def abstention_accuracy(spark, sf):
    return rounded(C.abstention_accuracy(preds(spark, sf), BY))


@query("predictive_accuracy", f"{P} select data_source, {r('avg(cast(correct as double))')} as predictive_accuracy from p group by 1")
def predictive_accuracy(spark, sf):
    return rounded(C.predictive_accuracy(preds(spark, sf), BY))


SUMMARY_PARTS = f"""{P}, {COUNTS}, {AUC}, {GRID200}, {SWEEP101}, {AREA},
m1 as (select data_source, count(*) as n_samples, avg((confidence - correct) * (confidence - correct)) as brier, {NLL} as nll,
  avg(case when (confidence >= 0.5) = (correct = 1) then 1e0 else 0e0 end) as abstention_accuracy,
  avg(cast(correct as double)) as predictive_accuracy, avg(confidence) as avg_confidence,
  sum(case when confidence >= 0.5 then 1 else 0 end) as n_answered, sum(case when confidence < 0.5 then 1 else 0 end) as n_abstained
  from p group by 1),
d as (select data_source, g, sum(n * exp(-((c - g) * (c - g)) / (2 * 0.1e0 * 0.1e0))) as d,
             sum(pos * exp(-((c - g) * (c - g)) / (2 * 0.1e0 * 0.1e0))) as h from n, grid group by 1, 2),
m2 as (select data_source, sum(abs(h / d - g) * d) / (sum(d) + 1e-12) as smooth_ece from d group by 1),
m3 as (select data_source, sum(pos * (below + neg / 2e0)) / (sum(pos) * 1e0 * sum(neg)) as auc from a group by 1),
m4 as (select data_source, {GAIN} as snr_gain from areas),
full_ as (select * from m1 join m2 using (data_source) join m3 using (data_source) join m4 using (data_source))"""
SEVEN = ", ".join(f"{r(c)} as {c}" for c in C.REPORT)


@query("calibration_report", f"{SUMMARY_PARTS} select data_source, {SEVEN} from full_")
def calibration_report(spark, sf):
    return rounded(C.calibration_report(preds(spark, sf), BY))


@query(
    "prediction_summary",
    f"{SUMMARY_PARTS} select data_source, {SEVEN}, {r('avg_confidence')} as avg_confidence, n_samples, "
    "cast(n_answered as bigint) as n_answered, cast(n_abstained as bigint) as n_abstained, "
    f"{r('n_abstained * 1e0 / n_samples')} as abstention_rate from full_",
)
def prediction_summary(spark, sf):
    return rounded(C.prediction_summary(preds(spark, sf), BY))


@query(
    "prediction_summary_api_names",
    f"{SUMMARY_PARTS} select data_source, {r('predictive_accuracy')} as pred_acc, {r('smooth_ece')} as \"smECE\", "
    f"{r('brier')} as brier_score, {r('auc')} as conf_auc, {r('abstention_accuracy')} as abst_acc from full_",
)
def prediction_summary_api_names(spark, sf):
    out = C.api_names(C.prediction_summary(preds(spark, sf), BY))
    return rounded(out.select("data_source", *C.API_NAMES.values()))


TENTHS = [i * 0.1 for i in range(11)]
SWEEP11 = sweep_sql(11, "0.1e0")


@query(
    "threshold_sweep",
    f"{P}, {SWEEP11} select data_source, {r('t')} as t, cast(answered as bigint) as answered, cast(rgt as bigint) as right_answers, cast(wrg as bigint) as wrong_answers from s",
)
def threshold_sweep(spark, sf):
    out = C.threshold_sweep(C.collapse(preds(spark, sf), BY), BY, TENTHS)
    return rounded(out.select("data_source", "t", "answered", F.col("right").alias("right_answers"), F.col("wrong").alias("wrong_answers")))


@query(
    "adaptive_risk_curve",
    f"{P}, {SWEEP11} select data_source, {r('t')} as t, {r('(total - answered) * 1e0 / total')} as abstention_rate, {r('wrg * 1e0 / total')} as hallucination_rate from s",
)
def adaptive_risk_curve(spark, sf):
    return rounded(risk.adaptive_risk(preds(spark, sf), TENTHS, BY))


CURVE = f"""{P}, {SWEEP11}, {AREA},
c as (select v.data_source, t, case when hal > 0 then acc / hal else cast('inf' as double) end as snr, {GAIN} as snr_gain
      from v join areas using (data_source))"""


@query("hallucination_curve", f"{CURVE} select data_source, {r('t')} as t, {r('snr')} as snr, {r('snr_gain')} as snr_gain from c")
def hallucination_curve(spark, sf):
    return rounded(risk.hallucination_curve(preds(spark, sf), TENTHS, BY))


TPFN = "coalesce(rgt * 1e0 / nullif(answered, 0), 0)", "coalesce((total_pos - rgt) * 1e0 / nullif(total - answered, 0), 0)"


@query("quantitative_calibration", f"{P}, {SWEEP11} select data_source, {r('t')} as t, {r(TPFN[0])} as tp, {r(TPFN[1])} as fn from s")
def quantitative_calibration(spark, sf):
    return rounded(risk.tp_fn_curve(preds(spark, sf), TENTHS, BY))


@query(
    "behavioral_report",
    f"""{CURVE},
w as (select c.data_source, c.t, (total - answered) * 1e0 / total as abstention_rate, wrg * 1e0 / total as hallucination_rate,
             snr, snr_gain, {TPFN[0]} as tp, {TPFN[1]} as fn from c join s on c.data_source = s.data_source and c.t = s.t),
l as (select data_source, t, 'abstention_rate' as metric, abstention_rate as value from w
      union all select data_source, t, 'hallucination_rate', hallucination_rate from w
      union all select data_source, t, 'snr', snr from w union all select data_source, t, 'snr_gain', snr_gain from w
      union all select data_source, t, 'tp', tp from w union all select data_source, t, 'fn', fn from w
      union all select data_source, null, 'accuracy', avg(cast(correct as double)) from p group by 1)
select data_source, {r('t')} as t, metric, {r('value')} as value from l""",
)
def behavioral_report(spark, sf):
    return rounded(risk.behavioral_report(preds(spark, sf), TENTHS, BY))


RISK = f"""{P}, z as (select * from p where risk_t = 0),
k as (select round(risk_t, 6) as t, count(*) as n, sum(case when not abstained then 1 else 0 end) as ans,
  sum(case when abstained then 1 else 0 end) as abst,
  sum(case when not abstained and correct = 1 then 1 else 0 end) as rgt,
  sum(case when not abstained and correct = 0 then 1 else 0 end) as wrg,
  sum(case when abstained and correct = 0 then 1 else 0 end) as wa from p group by 1),
v as (select t, rgt * 1e0 / n as acc, wrg * 1e0 / n as hal, lead(t) over (order by t) - t as step,
  lead(rgt * 1e0 / n) over (order by t) as acc1, lead(wrg * 1e0 / n) over (order by t) as hal1 from k),
ar as (select sum((acc + acc1) / 2 * step) as aa, sum((hal + hal1) / 2 * step) as ha from v)"""


@query(
    "risk_sweep_metrics",
    f"""{RISK} select {r('ln((aa / ha) / ((z0.rgt * 1e0 / z0.n) / (z0.wrg * 1e0 / z0.n)))')} as snr_gain,
{r('(h.rgt + h.wa) * 1e0 / h.n')} as abstention_accuracy, {r('z0.rgt * 1e0 / z0.n')} as predictive_accuracy,
{r('h.abst * 1e0 / h.n')} as abstention_rate, h.n as n_samples, cast(h.ans as bigint) as n_answered,
cast(h.abst as bigint) as n_abstained, (select count(*) from k) as n_thresholds
from ar, (select * from k where t = 0) z0, (select * from k where t = 0.5) h""",
)
def risk_sweep_metrics(spark, sf):
    df = preds(spark, sf)
    return rounded(risk.risk_sweep(df, df.where(F.col("risk_t") == 0.0)))


POLICY = """count(*) as n_samples, sum(case when not abstained then 1 else 0 end) as n_answered,
sum(case when abstained then 1 else 0 end) as n_abstained,
sum(case when not abstained and correct = 1 then 1 else 0 end) as rgt,
sum(case when not abstained and correct = 0 then 1 else 0 end) as wrg,
sum(case when abstained and correct = 0 then 1 else 0 end) as wa"""


@query(
    "policy_metrics_at_t",
    f"""{P}, k as (select data_source, {POLICY} from p group by 1)
select data_source, {r('rgt * 1e0 / n_samples')} as predictive_accuracy, {r('(rgt + wa) * 1e0 / n_samples')} as abstention_accuracy,
{r('wrg * 1e0 / n_samples')} as hallucination_rate, {r('n_abstained * 1e0 / n_samples')} as abstention_rate,
{r("case when wrg > 0 then rgt * 1e0 / wrg when rgt > 0 then cast('inf' as double) else 0 end")} as snr, n_samples,
cast(n_answered as bigint) as n_answered, cast(n_abstained as bigint) as n_abstained from k""",
)
def policy_metrics_at_t(spark, sf):
    return rounded(risk.policy_metrics(preds(spark, sf), BY))


@query(
    "metric_overlay",
    f"""{P}, c as (select data_source, 'predictive_accuracy' as metric, avg(cast(correct as double)) as value from p group by 1
  union all select data_source, 'brier', avg((confidence - correct) * (confidence - correct)) from p group by 1),
k as (select data_source, {POLICY} from p group by 1),
q as (select data_source, 'predictive_accuracy' as metric, rgt * 1e0 / n_samples as value from k
  union all select data_source, 'abstention_rate', n_abstained * 1e0 / n_samples from k)
select coalesce(c.data_source, q.data_source) as data_source, coalesce(c.metric, q.metric) as metric, {r('coalesce(q.value, c.value)')} as value
from c full join q on c.data_source = q.data_source and c.metric = q.metric""",
)
def metric_overlay(spark, sf):
    df = preds(spark, sf)
    conf = C.predictive_accuracy(df, BY).join(C.brier_score(df, BY), BY).unpivot(BY, ["predictive_accuracy", "brier"], "metric", "value")
    policy = risk.policy_metrics(df, BY).unpivot(BY, ["predictive_accuracy", "abstention_rate"], "metric", "value")
    return rounded(risk.overlay(conf, policy, BY))


@query(
    "key_thresholds",
    f"{CURVE} select data_source, {r('t')} as t, {r('snr')} as snr, {r('snr_gain')} as snr_gain, {r('snr_gain')} as max_snr_gain from c where t in (0, 0.5, 1)",
)
def key_thresholds(spark, sf):
    curve = risk.hallucination_curve(preds(spark, sf), TENTHS, BY)
    return rounded(risk.curve_at(curve, [0.0, 0.5, 1.0], BY))


@query(
    "distinct_thresholds",
    f"{P}, s as (select greatest(0, least(1, risk_t * 1.5e0 - 0.2e0)) as t from p), z as (select t, count(*) as n_rows from s group by 1 union all select 0, 0) select {r('t')} as t, cast(sum(n_rows) as bigint) as n_rows from z group by t",
)
def distinct_thresholds(spark, sf):
    """Stated thresholds of the whole table, clipped, each once, and 0."""
    stated = preds(spark, sf).withColumn("stated", F.col("risk_t") * 1.5 - 0.2)
    return rounded(C.stated_thresholds(stated, "stated"))


@query(
    "weighted_trapezoid",
    f"{P}, {SWEEP101}, {AREA} select data_source, {r('aa')} as acc_area, {r('ha')} as hal_area from areas",
)
def weighted_trapezoid(spark, sf):
    swept = C.threshold_sweep(C.collapse(preds(spark, sf), BY), BY, C.THRESHOLDS)
    rates = swept.select("data_source", "t", (F.col("right") / F.col("total")).alias("a"), (F.col("wrong") / F.col("total")).alias("h"))
    return rounded(C.trapz(rates, "t", {"acc_area": "a", "hal_area": "h"}, BY))


# votes -----------------------------------------------------------------------

S = f"with s as {plain(SAMPLES)}"
KS = "k as (select s.*, k.k from s, (values (1), (2), (4), (8)) k(k) where sample_idx < k.k)"
K_VALUES = [1, 2, 4, 8]


def samples(spark, sf):
    return derive(spark, sf, SAMPLES)


@query("first_k_samples", f"{S}, {KS} select question_id, sample_idx, cast(k as bigint) as k, answer from k")
def first_k_samples(spark, sf):
    return votes.first_k(samples(spark, sf), K_VALUES).select("question_id", "sample_idx", "k", "answer")


def vote_sql(weight: str, source: str = "s", keys: str = "question_id", name: str = "v") -> str:
    """CTEs for the heaviest answer with the first-seen rule."""
    return f"""{name}_t as (select {keys}, answer, {weight} as w, min(sample_idx) as f, arg_min(is_correct, sample_idx) as ok
  from {source} where answer <> '' group by {keys}, answer),
{name}_n as (select {keys}, count(*) as n from {source} group by {keys}),
{name}_r as (select *, row_number() over (partition by {keys} order by w desc, f) as rn from {name}_t),
{name} as (select {name}_n.*, coalesce(answer, '') as answer, coalesce(w / n, 0) as score, coalesce(ok, 0) as is_correct
  from {name}_n left join (select * from {name}_r where rn = 1) using ({keys}))"""


COUNT_W, CONF_W = "count(*) * 1e0", "round(sum(confidence), 9)"


@query("majority_vote", f"{S}, {vote_sql(COUNT_W)} select question_id, 'majority' as strategy, answer, {r('score')} as score, is_correct from v")
def majority_vote(spark, sf):
    return rounded(votes.vote_majority(samples(spark, sf)))


@query("weighted_vote", f"{S}, {vote_sql(CONF_W)} select question_id, 'weighted' as strategy, answer, {r('score')} as score, is_correct from v")
def weighted_vote(spark, sf):
    return rounded(votes.vote_weighted(samples(spark, sf)))


def top_sql(source: str, keys: str, name: str = "x") -> str:
    on = " and ".join(f"{name}_r.{k} = {name}_f.{k}" for k in keys.split(", "))
    return f"""{name}_r as (select *, row_number() over (partition by {keys} order by confidence desc, sample_idx) as rn from {source}),
{name}_f as (select {keys}, answer, arg_min(is_correct, sample_idx) as ok from {source} group by {keys}, answer),
{name} as (select {', '.join(f'{name}_r.{k}' for k in keys.split(', '))}, {name}_r.answer, confidence as score, ok as is_correct
  from {name}_r join {name}_f on {on} and {name}_r.answer = {name}_f.answer where rn = 1)"""


@query("max_confidence_pick", f"{S}, {top_sql('s', 'question_id')} select question_id, 'max_confidence' as strategy, answer, {r('score')} as score, is_correct from x")
def max_confidence_pick(spark, sf):
    return rounded(votes.vote_max_confidence(samples(spark, sf)))


@query(
    "mean_best_at_k",
    f"{S} select question_id, {r('avg(is_correct * 1e0)')} as mean_at_k, {r('max(is_correct * 1e0)')} as best_at_k from s group by 1",
)
def mean_best_at_k(spark, sf):
    return rounded(votes.mean_best_at_k(samples(spark, sf)))


@query(
    "scaling_summary",
    f"""{S}, {KS}, {vote_sql(COUNT_W, 'k', 'question_id, k', 'mv')}, {vote_sql(CONF_W, 'k', 'question_id, k', 'wv')}, {top_sql('k', 'question_id, k', 'xv')},
atk as (select question_id, k, avg(is_correct * 1e0) as m, max(is_correct * 1e0) as b from k group by 1, 2),
u as (select k, 'majority' as strategy, is_correct * 1e0 as a, score as c from mv union all select k, 'weighted', is_correct * 1e0, score from wv
  union all select k, 'max_confidence', is_correct * 1e0, score from xv union all select k, 'mean_at_k', m, m from atk union all select k, 'best_at_k', b, b from atk)
select cast(k as bigint) as k, strategy, {r('avg(a)')} as accuracy, {r('avg(c)')} as mean_score from u group by 1, 2""",
)
def scaling_summary(spark, sf):
    return rounded(votes.scaling_summary(samples(spark, sf), K_VALUES))


# reports ---------------------------------------------------------------------

R = f"with r as {plain(RESULTS)}"
SETS = ["click", "error", "purchase", "signup", "view"]
BASE = "Plain Model (Base)"
SIGNED = ", ".join(f"{'-' if d == 'down' else ''}{m} as {m}" for m, d in reports.DIRECTIONS.items())
UNPIVOT = " union all ".join(f"select method, dataset, '{m}' as metric, {m} as value, {'-' if d == 'down' else ''}{m} as s from r" for m, d in reports.DIRECTIONS.items())


def results(spark, sf):
    return derive(spark, sf, RESULTS)


def pivot_sql(value: str, default: str = "null") -> str:
    return ", ".join(f"coalesce(max(case when dataset = '{d}' then {value} end), {default}) as {d}" for d in SETS)


@query("report_coverage", f"{R} select method, {pivot_sql('1', '0')} from r group by 1")
def report_coverage(spark, sf):
    return reports.coverage(results(spark, sf), SETS)


@query("report_overall", f"{R} select method, " + ", ".join(f"{r(f'avg({m})')} as {m}" for m in reports.DIRECTIONS) + " from r group by 1")
def report_overall(spark, sf):
    return rounded(reports.overall_means(results(spark, sf)))


@query("report_by_dataset", f"{R} select method, " + ", ".join(f"{r(f'''max(case when dataset = '{d}' then brier end)''')} as {d}" for d in SETS) + " from r group by 1")
def report_by_dataset(spark, sf):
    return rounded(reports.metric_table(results(spark, sf), "brier", SETS))


@query(
    "report_by_train_group",
    f"""{R}, g as (select r.*, case when method = '{BASE}' then 'Base' when method like '%)' then regexp_extract(method, '\\(([^(]*)\\)$', 1) else 'Other' end as tg from r),
u as (select * from g where tg not in ('Base', 'Other') union all
      select b.* exclude (tg), l.tg from (select * from g where tg = 'Base') b, (select distinct tg from g where tg not in ('Base', 'Other')) l)
select tg as train_group, method, """ + ", ".join(f"{r(f'''max(case when dataset = '{d}' then nll end)''')} as {d}" for d in SETS) + " from u group by 1, 2",
)
def report_by_train_group(spark, sf):
    return rounded(reports.grouped_metric_table(results(spark, sf), "nll", SETS, BASE))


@query(
    "report_wins",
    f"""{R}, l as ({UNPIVOT}), w as (select l.*, case when s = max(s) over (partition by dataset, metric) then 1 else 0 end as win from l)
select method, """
    + ", ".join(f"cast(sum(case when metric = '{m}' then win else 0 end) as bigint) as {m}" for m in reports.DIRECTIONS)
    + ", cast(sum(win) as bigint) as total from w group by 1",
)
def report_wins(spark, sf):
    return reports.win_counts(results(spark, sf))


@query(
    "report_best_flag",
    f"{R}, l as ({UNPIVOT}) select method, dataset, metric, {r('value')} as value, abs(s - max(s) over (partition by dataset, metric)) < 1e-12 as is_best from l",
)
def report_best_flag(spark, sf):
    return rounded(reports.best_in_column(results(spark, sf)))


@query(
    "report_method_meta",
    f"""{R} select method, case when method = '{BASE}' then 'Base' when method like 'Binary Reward%' then 'Binary Reward'
  when method like 'Verbalized Brier%' then 'Verbalized Brier' when method like 'Verbalized CE%' then 'Verbalized CE' else method end as label,
  case when method = '{BASE}' then '-' when lower(method) like '%triviaqa%' then 'TriviaQA' when lower(method) like '%hotpotqa%' then 'HotpotQA' else 'TriviaQA' end as train_set,
  case when method <> '{BASE}' and method like '%RLOO%' then '10k / 2k' else '-' end as data_size,
  array_to_string(list_sort(list(distinct n_samples)), '/') as test_size from r group by 1""",
)
def report_method_meta(spark, sf):
    return reports.method_meta(results(spark, sf), BASE)


@query(
    "order_by_preference",
    f"""{R} select method, min(method_id) as seen, case when method like 'Verbalized CE%' then 0 when method like 'Binary%' then 1 else 2 end as place
from r group by 1""",
)
def order_by_preference(spark, sf):
    return reports.order_methods(results(spark, sf), ["Verbalized CE", "Binary"], "method_id")
