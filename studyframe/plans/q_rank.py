"""Queries: gaps, verdicts, ranks and sensitivity of leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyframe.functions.columns import round_doubles as rd
from studyframe.operators import diagnose as d, rank as r, ranking, sensitivity as s
from studyframe.plans.fixtures import CLB, KEYS, LB, class_leaderboard, leaderboard
from studyframe.plans.registry import query

K3 = "target, feature_set, model"


def _avg_rank(col: str, up: bool = True, part: str = "target") -> str:
    order = "ASC" if up else "DESC"
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {col} {order} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0)::DOUBLE")


def _min_rank(col: str, up: bool = True, part: str = "target") -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {col} {'ASC' if up else 'DESC'} NULLS LAST) END"


def _score(terms) -> str:
    return "round(" + " + ".join(f"{w}::DOUBLE * {c}" for c, w in terms) + ", 9)"


GAP = """g AS (SELECT *, r2_train - cv_r2_mean AS train_cv_gap, cv_r2_mean - r2_test AS cv_test_gap, abs(r2_train - cv_r2_mean) AS abs_train_cv_gap,
  abs(cv_r2_mean - r2_test) AS abs_cv_test_gap FROM lb)"""
CGAP = """g AS (SELECT *, train_macro_f1 - cv_macro_f1 AS train_cv_gap, abs(train_macro_f1 - cv_macro_f1) AS abs_train_cv_gap, cv_macro_f1 - test_macro_f1 AS cv_test_gap,
  abs(cv_macro_f1 - test_macro_f1) AS abs_cv_test_gap, train_macro_f1 - val_macro_f1 AS train_val_gap, abs(train_macro_f1 - val_macro_f1) AS abs_train_val_gap,
  cv_macro_f1 - val_macro_f1 AS cv_val_gap, abs(cv_macro_f1 - val_macro_f1) AS abs_cv_val_gap, val_macro_f1 - test_macro_f1 AS val_test_gap,
  abs(val_macro_f1 - test_macro_f1) AS abs_val_test_gap FROM clb)"""


def _lb(spark, sf):
    return d.gaps(leaderboard(spark, sf))


def _clb(spark, sf):
    return d.gaps(class_leaderboard(spark, sf), "classification")


def rounded_sql(inner: str, cols: list[str], keep: str = K3) -> str:
    return inner + f" SELECT {keep}, " + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in cols)


GAP_COLS = ["train_cv_gap", "cv_test_gap", "abs_train_cv_gap", "abs_cv_test_gap"]
CGAP_COLS = GAP_COLS + ["train_val_gap", "cv_val_gap", "val_test_gap", "abs_train_val_gap", "abs_cv_val_gap", "abs_val_test_gap"]


@query("gaps", rounded_sql(f"WITH {LB}, {GAP}", GAP_COLS) + " FROM g")
def gaps(spark, sf):
    return rd(_lb(spark, sf).select(*KEYS, *GAP_COLS))


@query("gaps_class", rounded_sql(f"WITH {CLB}, {CGAP}", CGAP_COLS) + " FROM g")
def gaps_class(spark, sf):
    return rd(_clb(spark, sf).select(*KEYS, *CGAP_COLS))


FLAGS = ["possible_underfitting", "possible_overfitting", "high_cv_instability", "split_shift", "stable_generalization", "generalization_diagnosis"]


def _verdict_sql(source: str, profile: str) -> str:
    p = d.PROFILES[profile]
    words = d.NEUTRAL_LABELS if p.neutral else d.PLAIN_LABELS
    low = f"({p.train} < {p.low_train} AND {p.cv} < {p.low_cv}" + (f" AND {p.low_other[0]} < {p.low_other[1]}" if p.low_other else "") + ")"
    shift = f"(abs({p.cv} - {p.shift_against}) >= {p.shift})" if p.shift is not None else "false"
    return f"""fl AS (SELECT *, coalesce({low}, false) AS possible_underfitting, coalesce({p.train} - {p.cv} >= {p.gap}, false) AS possible_overfitting,
      coalesce({p.sd} >= {p.unstable}, false) AS high_cv_instability, coalesce({shift}, false) AS split_shift,
      coalesce(abs({p.train} - {p.cv}) <= {p.stable_gap} AND {p.cv} >= {p.stable_cv} AND {p.sd} < {p.unstable}, false) AS stable_generalization FROM {source}),
    ve AS (SELECT *, CASE WHEN possible_underfitting THEN '{words[0]}' WHEN possible_overfitting AND high_cv_instability THEN '{words[1]}'
      WHEN possible_overfitting THEN '{words[2]}' WHEN high_cv_instability THEN '{words[3]}' WHEN split_shift THEN '{p.shift_label}'
      WHEN stable_generalization THEN '{words[4]}' ELSE '{words[5]}' END AS generalization_diagnosis FROM fl)"""


def _diagnosis(profile):
    regression = profile.startswith("reg")
    sql = f"WITH {LB if regression else CLB}, {_verdict_sql('lb' if regression else 'clb', profile)} SELECT {K3}, {', '.join(FLAGS)} FROM ve"

    def run(spark, sf):
        table = leaderboard(spark, sf) if regression else class_leaderboard(spark, sf)
        return d.diagnose(table, profile).select(*KEYS, *FLAGS)

    query("diagnose" if profile == "reg_eval" else f"diagnose_{profile}", sql)(run)


for _profile in d.PROFILES:
    _diagnosis(_profile)


@query("diagnose_multi", f"""WITH {CLB}, w AS (SELECT {K3}, concat_ws('; ', CASE WHEN train_macro_f1 - cv_macro_f1 >= 0.10 THEN 'possible overfitting' END,
  CASE WHEN train_macro_f1 < 0.55 AND cv_macro_f1 < 0.50 THEN 'possible underfitting' END, CASE WHEN cv_macro_f1_std >= 0.15 THEN 'high CV instability' END,
  CASE WHEN abs(cv_macro_f1 - val_macro_f1) >= 0.15 THEN 'split sensitivity' END) AS x FROM clb)
SELECT {K3}, CASE WHEN x = '' THEN 'acceptable generalization' ELSE x END AS screening FROM w""")
def diagnose_multi(spark, sf):
    return d.diagnose_multi(class_leaderboard(spark, sf)).select(*KEYS, "screening")


@query("over_underfitting", f"""WITH {LB}, {_verdict_sql('lb', 'reg_report')} SELECT target, feature_set, count(*) AS models,
  count(*) FILTER (possible_underfitting) AS n_possible_underfitting, count(*) FILTER (possible_overfitting) AS n_possible_overfitting,
  count(*) FILTER (high_cv_instability) AS n_high_cv_instability, count(*) FILTER (split_shift) AS n_split_shift,
  count(*) FILTER (stable_generalization) AS n_stable_generalization FROM ve GROUP BY ALL""")
def over_underfitting(spark, sf):
    return d.over_underfitting(leaderboard(spark, sf), "reg_report")


# ------------------------------------------------------------------ selection ranks


def selection_sql(profile: str, source: str = "g", out: str = "sel") -> str:
    crit = r.SELECTION[profile]
    ranks = ", ".join(f"{_avg_rank(src, up)} AS {name}" for name, src, up, _ in crit)
    score = _score([(name, w) for name, _, _, w in crit])
    return f"""s1 AS (SELECT *, {ranks} FROM {source}), s2 AS (SELECT *, {score} AS selection_rank_score FROM s1),
    {out} AS (SELECT *, {_min_rank('selection_rank_score')} AS selection_rank FROM s2)"""


def _selection(profile):
    crit = [c[0] for c in r.SELECTION[profile]]
    regression = profile == "reg"
    base = f"WITH {LB}, {GAP}" if regression else f"WITH {CLB}, {CGAP}"
    sql = f"{base}, {selection_sql(profile)} SELECT {K3}, {', '.join(crit)}, selection_rank_score, selection_rank FROM sel"

    def run(spark, sf):
        table = _lb(spark, sf) if regression else _clb(spark, sf)
        return r.rank_selection(table, profile).select(*KEYS, *crit, "selection_rank_score", "selection_rank")

    query("rank_selection" if regression else f"rank_selection_{profile}", sql)(run)


for _profile in r.SELECTION:
    _selection(_profile)

_MIN = [c[0] for c in r.SELECTION["reg"]]


@query("rank_min", f"""WITH {LB}, {GAP}, s1 AS (SELECT *, {', '.join(f'{_min_rank(src, up)} AS {name}' for name, src, up, _ in r.SELECTION['reg'])} FROM g),
s2 AS (SELECT *, {_score([(n, w) for n, _, _, w in r.SELECTION['reg']])} AS selection_rank_score FROM s1)
SELECT {K3}, {', '.join(_MIN)}, selection_rank_score, {_min_rank('selection_rank_score')} AS selection_rank FROM s2""")
def rank_min(spark, sf):
    return r.rank_selection_min(_lb(spark, sf)).select(*KEYS, *_MIN, "selection_rank_score", "selection_rank")


@query("rank_average", f"""WITH {LB} SELECT {K3}, {_avg_rank('round(p20_test, 0)', False)} AS p20_rank FROM lb""")
def rank_average(spark, sf):
    return leaderboard(spark, sf).select(*KEYS, ranking.rank_average(F.round("p20_test", 0), False, ["target"]).alias("p20_rank"))


def _weighted_query(name, table, profile, base, task, func, out):
    terms = table[profile]
    score = _score([(_avg_rank(c, up), w) for c, up, w in terms])
    sql = f"{base}, q AS (SELECT *, {score} AS {out}_score FROM g) SELECT {K3}, {out}_score, {_min_rank(out + '_score')} AS {name} FROM q"

    def run(spark, sf):
        lb = _lb(spark, sf) if task == "regression" else _clb(spark, sf)
        return func(lb, profile).select(*KEYS, f"{out}_score", F.col(name))

    return sql, run


for _name, _table, _profile, _base, _task, _func, _out, _query in [
    ("test_performance_rank", r.TEST, "reg", f"WITH {LB}, {GAP}", "regression", r.rank_test, "test_rank", "rank_test"),
    ("test_performance_rank", r.TEST, "cls", f"WITH {CLB}, {CGAP}", "classification", r.rank_test, "test_rank", "rank_test_class"),
    ("test_performance_rank", r.TEST, "cls_train", f"WITH {CLB}, {CGAP}", "classification", r.rank_test, "test_rank", "rank_test_class_train"),
    ("generalization_rank", r.GENERALIZATION, "reg", f"WITH {LB}, {GAP}", "regression", r.rank_generalization, "generalization_rank", "rank_generalization"),
    ("generalization_rank", r.GENERALIZATION, "cls", f"WITH {CLB}, {CGAP}", "classification", r.rank_generalization, "generalization_rank", "rank_generalization_class"),
]:
    _sql, _run = _weighted_query(_name, _table, _profile, _base, _task, _func, _out)
    query(_query, _sql)(_run)

REG_RANKS = ", ".join(s.REG_CRITERIA)
STAB = f"""st AS (SELECT *, (SELECT CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE 1.0 / (1.0 + stddev_pop(v) / avg(v)) END FROM (SELECT unnest([{REG_RANKS}]) AS v)) AS rank_stability FROM sel)"""


@query("rank_stability", f"WITH {LB}, {GAP}, {selection_sql('reg')}, {STAB} SELECT {K3}, round(rank_stability, 6) AS rank_stability FROM st")
def rank_stability(spark, sf):
    ranked = r.rank_selection(_lb(spark, sf), "reg")
    return rd(r.rank_stability(ranked, s.REG_CRITERIA).select(*KEYS, "rank_stability"))


SCORE01 = """sc1 AS (SELECT *, CASE WHEN max(selection_rank_score) OVER w = min(selection_rank_score) OVER w THEN 1.0 ELSE
  1.0 - (selection_rank_score - min(selection_rank_score) OVER w) / (max(selection_rank_score) OVER w - min(selection_rank_score) OVER w) END AS statistical_score
  FROM sel WINDOW w AS (PARTITION BY target))"""


@query("score_0_1", f"WITH {LB}, {GAP}, {selection_sql('reg')}, {SCORE01} SELECT {K3}, round(statistical_score, 6) + 0.0::DOUBLE AS statistical_score FROM sc1")
def score_0_1(spark, sf):
    return rd(r.score_0_1(r.rank_selection(_lb(spark, sf), "reg")).select(*KEYS, "statistical_score"))


# ------------------------------------------------------------------ pairwise families

_WORSE = " AND ".join([f"b.{c} >= a.{c}" for c in r.HIGHER] + [f"b.{c} <= a.{c}" for c in r.LOWER])
_STRICT = " OR ".join([f"b.{c} > a.{c}" for c in r.HIGHER] + [f"b.{c} < a.{c}" for c in r.LOWER])
_WINS = " + ".join([f"(a.{c} > b.{c})::INTEGER" for c in r.HIGHER] + [f"(a.{c} < b.{c})::INTEGER" for c in r.LOWER])
_LOSS = " + ".join([f"(a.{c} < b.{c})::INTEGER" for c in r.HIGHER] + [f"(a.{c} > b.{c})::INTEGER" for c in r.LOWER])
PAIRS = f"""pc AS (SELECT a.target, a.feature_set, a.model,
  count(*) FILTER (({_WORSE}) AND ({_STRICT})) AS dominators, count(*) FILTER (({_WINS}) > 3.5) AS majority_wins,
  coalesce(sum({_WINS}), 0) AS wins, coalesce(sum({_LOSS}), 0) AS losses
  FROM lb a JOIN lb b ON a.target = b.target GROUP BY a.target, a.feature_set, a.model),
pr AS (SELECT *, greatest(0.1, 1.0 + (wins - losses)::DOUBLE / 7.0) AS alpha FROM pc)"""


@query("pareto_rank", f"WITH {LB}, {PAIRS} SELECT {K3}, dominators, round(1.0::DOUBLE/(1+dominators), 6) AS pareto_score, {_min_rank('dominators')} AS pareto_rank FROM pr")
def pareto_rank(spark, sf):
    return rd(r.pareto_rank(leaderboard(spark, sf)))


@query("dominance_rank", f"WITH {LB}, {PAIRS} SELECT {K3}, majority_wins, {_min_rank('majority_wins', False)} AS dominance_rank FROM pr")
def dominance_rank(spark, sf):
    return r.dominance_rank(leaderboard(spark, sf))


@query("dirichlet_rank", f"""WITH {LB}, {PAIRS} SELECT {K3}, round(alpha, 6) AS alpha, round(alpha / sum(alpha) OVER (PARTITION BY target), 6) AS dirichlet_score,
 {_min_rank('alpha', False)} AS dirichlet_rank FROM pr""")
def dirichlet_rank(spark, sf):
    return rd(r.dirichlet_rank(leaderboard(spark, sf)))


@query("rank_ensemble", f"""WITH {LB}, {GAP}, {selection_sql('reg')}, {SCORE01}, {PAIRS},
four AS (SELECT sc1.target, sc1.feature_set, sc1.model, {_min_rank('statistical_score', False, 'sc1.target')} AS a, {_min_rank('dominators', True, 'sc1.target')} AS b,
  {_min_rank('majority_wins', False, 'sc1.target')} AS c, {_min_rank('alpha', False, 'sc1.target')} AS d FROM sc1 JOIN pr USING (target, feature_set, model)),
en AS (SELECT *, (a + b + c + d) / 4.0::DOUBLE AS ensemble_score FROM four)
SELECT {K3}, a AS score_rank, b AS pareto_rank, c AS dominance_rank, d AS dirichlet_rank, ensemble_score, {_min_rank('ensemble_score')} AS ensemble_rank,
  round((SELECT CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE 1.0 / (1.0 + stddev_pop(v) / avg(v)) END FROM (SELECT unnest([a, b, c, d]) AS v)), 6) AS rank_stability FROM en""")
def rank_ensemble(spark, sf):
    lb = r.score_0_1(r.rank_selection(_lb(spark, sf), "reg"))
    return rd(r.rank_ensemble(lb))


# ------------------------------------------------------------------ weight sensitivity


def _verdict_case(prefix: str = "") -> str:
    p = prefix
    return f"""CASE WHEN {p}first_place_rate >= 0.80 AND {p}rank_range <= 1 THEN 'Highly robust' WHEN {p}first_place_rate >= 0.60 AND {p}rank_range <= 2 THEN 'Moderately robust'
      WHEN {p}first_place_rate >= 0.40 OR {p}rank_sd <= 1.50 THEN 'Weight-sensitive' ELSE 'Unstable selection' END"""


def summary_sql(source: str, prefix: str, top: bool, out: str) -> str:
    top3 = f", count(*) FILTER (rank <= 3) AS {prefix}top3_count, count(*) FILTER (rank <= 3)::DOUBLE / count(*) AS {prefix}top3_rate" if top else ""
    return f"""{out}_0 AS (SELECT {K3}, avg(rank) AS {prefix}mean_rank, quantile_cont(rank::DOUBLE, 0.5) AS {prefix}median_rank, min(rank) AS {prefix}min_rank, max(rank) AS {prefix}max_rank,
      max(rank) - min(rank) AS {prefix}rank_range, round(stddev_samp(rank), 9) AS {prefix}rank_sd, count(*) FILTER (rank = 1) AS {prefix}first_place_count,
      count(*) FILTER (rank = 1)::DOUBLE / count(*) AS {prefix}first_place_rate{top3} FROM {source} GROUP BY {K3}),
    {out} AS (SELECT *, {_verdict_case(prefix)} AS {prefix}verdict FROM {out}_0)"""


def scenario_sql(scenarios, criteria, source="sel") -> str:
    rows = " UNION ALL ".join(
        f"SELECT {K3}, '{name}' AS scenario, {_score(list(zip(criteria, weights)))} AS score FROM {source}" for name, weights in scenarios.items()
    )
    return f"sn0 AS ({rows}), sn AS (SELECT *, rank() OVER (PARTITION BY target, scenario ORDER BY score) AS rank FROM sn0)"


def _final_select(out: str, prefix: str, top: bool) -> str:
    doubles = ["mean_rank", "median_rank", "rank_sd", "first_place_rate"] + (["top3_rate"] if top else [])
    longs = ["min_rank", "max_rank", "rank_range", "first_place_count"] + (["top3_count"] if top else [])
    return (f"SELECT {K3}, " + ", ".join(f"round({prefix}{c}, 6) AS {prefix}{c}" for c in doubles) + ", "
            + ", ".join(f"{prefix}{c}" for c in longs) + f", {prefix}verdict FROM {out}")


@query("scenario_sensitivity", f"""WITH {LB}, {GAP}, {selection_sql('reg')}, {scenario_sql(s.THREE_SCENARIOS, s.REG_CRITERIA)},
{summary_sql('sn', 'sensitivity_', False, 'su')} {_final_select('su', 'sensitivity_', False)}""")
def scenario_sensitivity(spark, sf):
    return rd(s.scenario_sensitivity(r.rank_selection(_lb(spark, sf), "reg"), s.THREE_SCENARIOS, s.REG_CRITERIA))


@query("scenario_sensitivity_class", f"""WITH {CLB}, {CGAP}, {selection_sql('cls_val')}, {scenario_sql(s.FIVE_SCENARIOS, s.CLS_VAL_CRITERIA)},
{summary_sql('sn', 'sensitivity_', False, 'su')} {_final_select('su', 'sensitivity_', False)}""")
def scenario_sensitivity_class(spark, sf):
    return rd(s.scenario_sensitivity(r.rank_selection(_clb(spark, sf), "cls_val"), s.FIVE_SCENARIOS, s.CLS_VAL_CRITERIA))


@query("robustness_verdict", f"""WITH {LB}, {GAP}, {selection_sql('reg')}, {scenario_sql(s.THREE_SCENARIOS, s.REG_CRITERIA)},
{summary_sql('sn', 'v_', False, 'su')} SELECT v_verdict AS verdict, count(*) AS models FROM su GROUP BY v_verdict""")
def robustness_verdict(spark, sf):
    out = s.scenario_sensitivity(r.rank_selection(_lb(spark, sf), "reg"), s.THREE_SCENARIOS, s.REG_CRITERIA)
    verdict = s.robustness_verdict(F.col("sensitivity_first_place_rate"), F.col("sensitivity_rank_range"), F.col("sensitivity_rank_sd"))
    return out.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("models"))


def weights_sql(n: int, k: int, seed: int, perf: list[int], min_perf: float, max_single: float, ids: int) -> str:
    draw = lambda j: f"-ln((CAST('0x' || substr(md5(concat_ws('|', {seed}, id, {j})), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0)"
    total = " + ".join(f"e{j}" for j in range(k))
    return f"""wd AS (SELECT range AS id, {', '.join(f'{draw(j)} AS e{j}' for j in range(k))} FROM range({ids})),
    ww AS (SELECT id, {', '.join(f'round(e{j} / ({total}), 6) AS w{j}' for j in range(k))} FROM wd),
    wk AS (SELECT row_number() OVER (ORDER BY id) AS simulation, {', '.join(f'w{j}' for j in range(k))} FROM ww
      WHERE round({' + '.join(f'w{j}' for j in perf)}, 6) >= {min_perf} AND greatest({', '.join(f'w{j}' for j in range(k))}) <= {max_single} QUALIFY simulation <= {n})"""


def mc_sql(criteria, n=1000, seed=42, perf=(0,), min_perf=0.5, max_single=0.8) -> str:
    score = "round(" + " + ".join(f"w{j} * {c}" for j, c in enumerate(criteria)) + ", 9)"
    return f"""{weights_sql(n, len(criteria), seed, list(perf), min_perf, max_single, 64 * n)},
    sx AS (SELECT simulation, {K3}, {score} AS score FROM sel CROSS JOIN wk),
    rx AS (SELECT *, rank() OVER (PARTITION BY target, simulation ORDER BY score) AS rank FROM sx)"""


REG_MC = f"WITH {LB}, {GAP}, {selection_sql('reg')}, {mc_sql(s.REG_CRITERIA)}"


def _mc_scores(spark, sf):
    lb = r.rank_selection(_lb(spark, sf), "reg")
    weights = s.monte_carlo_weights(spark, 1000, 3, 42, [0], 0.5, 0.8)
    return weights, s.weights_x_models(weights, lb, s.REG_CRITERIA)


@query("monte_carlo_weights", REG_MC + """ SELECT w.simulation, w0, w1, w2, target, count(*) AS models, max(CASE WHEN rank = 1 THEN model || '/' || feature_set END) AS winner
FROM wk w JOIN rx ON w.simulation = rx.simulation GROUP BY ALL""")
def monte_carlo_weights(spark, sf):
    """The accepted vectors, each with the model that it puts first."""
    weights, scores = _mc_scores(spark, sf)
    ranks = ranking.rank_matrix(scores, ["target"])
    best = F.max(F.when(F.col("rank") == 1, F.concat_ws("/", "model", "feature_set"))).alias("winner")
    out = ranks.groupBy("simulation", "target").agg(F.count(F.lit(1)).alias("models"), best)
    return weights.join(out, "simulation")


@query("weights_x_models", REG_MC + f" SELECT simulation, {K3}, round(score, 6) AS score FROM sx")
def weights_x_models(spark, sf):
    return rd(_mc_scores(spark, sf)[1])


@query("rank_matrix", REG_MC + f" SELECT simulation, {K3}, rank FROM rx")
def rank_matrix(spark, sf):
    return ranking.rank_matrix(_mc_scores(spark, sf)[1], ["target"]).drop("score")


@query("monte_carlo_summary", f"{REG_MC}, {summary_sql('rx', 'mc_', True, 'mc')} {_final_select('mc', 'mc_', True)}")
def monte_carlo_summary(spark, sf):
    return rd(s.monte_carlo_summary(ranking.rank_matrix(_mc_scores(spark, sf)[1], ["target"])))


ROBUST = f"""rb0 AS (SELECT *, {_score([(_avg_rank('mc_median_rank'), 0.45), (_avg_rank('mc_first_place_rate', False), 0.25), (_avg_rank('mc_top3_rate', False), 0.20), (_avg_rank('mc_rank_sd'), 0.10)])} AS robustness_rank_score FROM mc),
rb AS (SELECT *, {_min_rank('robustness_rank_score')} AS robustness_rank FROM rb0)"""
RECOM = f"""rc0 AS (SELECT sel.*, rb.* EXCLUDE (target, feature_set, model) FROM sel JOIN rb USING (target, feature_set, model)),
rc1 AS (SELECT *, {_score([(_avg_rank('selection_rank_score'), 0.60), (_avg_rank('robustness_rank_score'), 0.40)])} AS recommended_rank_score FROM rc0),
rc AS (SELECT *, {_min_rank('recommended_rank_score')} AS recommended_rank FROM rc1)"""


@query("rank_robustness", f"{REG_MC}, {summary_sql('rx', 'mc_', True, 'mc')}, {ROBUST} SELECT {K3}, robustness_rank_score, robustness_rank FROM rb")
def rank_robustness(spark, sf):
    mc = s.monte_carlo_summary(ranking.rank_matrix(_mc_scores(spark, sf)[1], ["target"]))
    mc = mc.withColumn("mc_rank_sd", F.round("mc_rank_sd", 9))
    return s.rank_robustness(mc).select(*KEYS, "robustness_rank_score", "robustness_rank")


@query("rank_recommended", f"{REG_MC}, {summary_sql('rx', 'mc_', True, 'mc')}, {ROBUST}, {RECOM} SELECT {K3}, recommended_rank_score, recommended_rank FROM rc")
def rank_recommended(spark, sf):
    lb = r.rank_selection(_lb(spark, sf), "reg")
    return s.monte_carlo(lb).select(*KEYS, "recommended_rank_score", "recommended_rank")


CLS_MC = f"WITH {CLB}, {CGAP}, {selection_sql('cls_val')}, {mc_sql(s.CLS_VAL_CRITERIA, perf=(0, 1), max_single=0.5)}"


@query("monte_carlo_summary_class", f"{CLS_MC}, {summary_sql('rx', 'mc_', True, 'mc')} {_final_select('mc', 'mc_', True)}")
def monte_carlo_summary_class(spark, sf):
    lb = r.rank_selection(_clb(spark, sf), "cls_val")
    weights = s.monte_carlo_weights(spark, 1000, 5, 42, [0, 1], 0.5, 0.5)
    scores = s.weights_x_models(weights, lb, s.CLS_VAL_CRITERIA)
    return rd(s.monte_carlo_summary(ranking.rank_matrix(scores, ["target"])))
