"""The same results as SQL text, to check the Spark queries against another engine.

Common tables are named fragments; ``text`` puts the ones a query needs in front of it.
"""

from __future__ import annotations

import re

from tidewave.functions.scalar import FACTORS, MODULI
from tidewave.sources import survey_tables as S
from tidewave.sources.schema import (
    DROPOUT_PREDICTORS,
    ITEM_COUNTS,
    ITEMS,
    OUTCOME_LABELS,
    OUTCOMES,
    REPORT_ORDER,
    WAVES,
)

PARTS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)::double"


def rs(cols: str, digits: int = 6) -> str:
    """Rounded columns that keep their names."""
    return ", ".join(f"{r(_q(c), digits)} as {_q(c)}" for c in cols.split())


def _q(c: str) -> str:
    return f'"{c}"' if re.search(r"[^a-z0-9_]", c) or c == "year" else c


def text(body: str) -> str:
    need: list[str] = []

    def visit(sql: str) -> None:
        for name, part in PARTS.items():
            if name not in need and re.search(rf"\b{name}\b", sql):
                visit(part)
                if name not in need:
                    need.append(name)

    visit(body)
    if not need:
        return body
    head = ",\n".join(f"{n} as materialized ({PARTS[n]})" for n in need)
    return f"with {head}\n{body}"


def oracle(name: str, body: str) -> None:
    ORACLE[name] = text(body)


def values(names: list, as_text: bool = True) -> str:
    return "[" + ", ".join(f"'{n}'" if as_text else str(n) for n in names) + "]"


def pick_map(codes: dict, source: str) -> tuple[str, str]:
    """CASE expressions for label and level of a code."""
    def lit(c):
        return f"'{c}'" if isinstance(c, str) else str(c)

    label = " ".join(f"when {lit(c)} then '{t}'" for c, t in codes.items())
    level = " ".join(f"when {lit(c)} then {i}" for i, c in enumerate(codes, start=1))
    return f"case {source} {label} end", f"(case {source} {level} end)::int"


# -- panel -------------------------------------------------------------------------------

NAMES = f"({values(OUTCOMES)})[(l_partkey % 8 + 1)::int]"
COUNTS = f"({values([ITEM_COUNTS[o] for o in OUTCOMES], False)})[(l_partkey % 8 + 1)::int]"
WAVE = "(8 + (year(o_orderdate) - 1995) % 5)::int"

PARTS["p_lines"] = f"""
select o_custkey as id, {WAVE} as year, {NAMES} as outcome,
  (l_suppkey % {COUNTS} + 1)::int as item,
  (floor((l_quantity - 1) / 10) + 1)::int as category, l_tax, l_linenumber
from lineitem join orders on l_orderkey = o_orderkey"""
PARTS["p_long"] = """
select l.id, c_nationkey as school, (c_nationkey % 3 + 1)::int as school_involvement,
  l.year, outcome, item, min(case when l_tax <> 0 then category end)::int as response
from p_lines l join customer on c_custkey = l.id group by all"""
PARTS["p_sep"] = f"""
select o_custkey as id, {WAVE} as year,
  max(case o_orderstatus when 'O' then 1 when 'F' then 0 end)::int as sep
from orders group by all"""
PARTS["p_treat_rows"] = """
select s.id, c_nationkey as school, (c_nationkey % 3 + 1)::int as school_involvement,
  s.year, s.sep from p_sep s join customer on c_custkey = s.id"""
PARTS["p_wide"] = (
    """select p.*, s.sep from (select id, school, school_involvement, year, """
    + ", ".join(
        f"max(case when outcome || '_' || item = '{c}' then response end) as {c}" for c in ITEMS
    )
    + """ from p_long group by id, school, school_involvement, year) p
left join p_sep s on s.id = p.id and s.year = p.year"""
)
PARTS["p_dense_items"] = """
select (id // 10)::bigint as id, year, outcome || '_' || item as name,
  min(category) as category, sum(l_linenumber)::bigint as line
from p_lines group by all"""
PARTS["p_dense_waves"] = (
    "select id, year, sum(line) as line, "
    + ", ".join(f"max(case when name = '{c}' and line % 29 <> 0 then category end) as {c}" for c in ITEMS)
    + " from p_dense_items group by id, year"
)
PARTS["p_dense"] = (
    "select id, (id % 25)::int as school, (id % 25 % 3 + 1)::int as school_involvement, year, "
    + ", ".join(f"case when line % 4 <> 0 then {c} end as {c}" for c in ITEMS)
    + " from p_dense_waves"
)
ITEM_LIST = ", ".join(ITEMS)
UNIT_COLS = "id, school, school_involvement, year"

oracle("panel_long", "select id, school, school_involvement, year, outcome, item, response from p_long")
for q in ("panel_wide", "io_panel_csv", "io_panel_parquet", "select_reorder"):
    sep = "" if q == "select_reorder" else "sep, "
    oracle(q, f"select {UNIT_COLS}, {sep}{ITEM_LIST} from p_wide")
oracle("panel_dense", f"select {UNIT_COLS}, {ITEM_LIST} from p_dense")

PARTS["p_items"] = " union all ".join(
    f"select {UNIT_COLS}, sep, '{c[:2]}' as outcome, {c[3:]} as item, {c} as response from p_wide"
    for c in ITEMS
)
oracle("items_to_long", f"select {UNIT_COLS}, sep, outcome, item::int as item, response from p_items")
PARTS["waves"] = f"select unnest({values(WAVES, False)})::int as year"
oracle(
    "complete_waves",
    """select i.id, w.year, s.sep from (select distinct id from p_treat_rows) i cross join waves w
left join p_treat_rows s on s.id = i.id and s.year = w.year""",
)
PARTS["p_treated"] = """
select *, case when y11 + y12 = 0 then 0 when y11 = 1 then 1 when y12 = 1 then 1 end as sep from (
 select id, school, school_involvement, max(case when year = 11 then sep end)::int as y11,
  max(case when year = 12 then sep end)::int as y12 from p_treat_rows group by all)"""
oracle(
    "crossing_arms",
    """select id, sep, x_time::int as x_time, x_sep::int as x_sep from p_treated
cross join (select unnest([2, 4]) as x_time) cross join (select unnest([0, 1]) as x_sep)""",
)


def grid_part(source: str) -> str:
    return f"""
select u.id, u.school, w.year, {', '.join('d.' + c for c in ITEMS)},
  coalesce({', '.join('d.' + c for c in ITEMS)}) is null as missing
from (select distinct id, school from {source}) u cross join waves w
left join {source} d on d.id = u.id and d.year = w.year"""


PARTS["g_raw"] = grid_part("p_wide")
PARTS["g_dense"] = grid_part("p_dense")
ANSWERED = " + ".join(f"({c} is not null)::int" for c in ITEMS)
oracle("expand_grid", f"select id, school, year, missing, ({ANSWERED})::int as answered from g_raw")
oracle(
    "map_item_columns",
    "select id, year::bigint as year, " + ", ".join(f"6 - {c} as {c}" for c in ITEMS) + " from p_wide",
)
LABEL, LEVEL = pick_map(OUTCOME_LABELS, "outcome")
oracle(
    "recode_outcomes",
    f"""select outcome, n, {LABEL} as name, {LEVEL} as name_level from (
select outcome, count(response) as n from p_long group by outcome)""",
)

# -- index and windows -------------------------------------------------------------------

PARTS["p_resp"] = """
select *, row_number() over (partition by outcome order by id, year, item) as ii,
  dense_rank() over (partition by outcome order by id) as jj,
  dense_rank() over (partition by outcome order by school) as kk
from p_long where response is not null"""
for q in ("row_and_dense_index", "row_and_dense_index_ranged"):
    oracle(q, "select id, year, outcome, item, ii, jj, kk from p_resp")
oracle(
    "student_row_number",
    "select id, year, sep, row_number() over (partition by id order by year) as ii from p_treat_rows",
)
oracle(
    "lags_within_student",
    "select id, year, sep, "
    + ", ".join(f"lag(sep, {k}) over (partition by id order by year) as sep_lag{k}" for k in range(1, 5))
    + " from p_treat_rows",
)
oracle(
    "previous_wave",
    "select id, year, sep, lag(sep) over (partition by id order by year) as sep_prev from p_treat_rows",
)


def lag_chain(c: str, fill: str) -> str:
    """Last known value by looking back one to four waves, then the fill."""
    back = ", ".join(f"lag({c}, {k}) over w" for k in range(1, 5))
    return f"coalesce({c}, {back}, {fill})"


def not_leading() -> str:
    """Rows that are not in a run of missing waves from the first wave on."""
    rules = []
    for i, w in enumerate(WAVES):
        parts = [f"year = {w}", "missing"] + [f"lag(missing, {k}) over w" for k in range(1, i + 1)]
        rules.append("(" + " and ".join(parts) + ")")
    return "not (" + " or ".join(rules) + ")"


oracle(
    "trim_leading",
    f"""select id, year, missing from (select *, {not_leading()} as kept from g_raw
window w as (partition by id order by year)) where kept""",
)
FIRST = [f"{o}_1" for o in ITEM_COUNTS]
oracle(
    "carry_forward",
    "select id, year, "
    + ", ".join(f"{lag_chain(c, '0')} as {c}" for c in FIRST)
    + " from g_raw window w as (partition by id order by year)",
)

# -- summaries ---------------------------------------------------------------------------

oracle(
    "mean_sd_by_school",
    f"""select school, outcome, year, count(response) as n, {r('avg(response)')} as mean,
{r('stddev_samp(response)')} as sd from p_long group by school, outcome, year""",
)
oracle(
    "strict_mean",
    f"""select id, year, outcome, case when count(*) = count(response) then {r('avg(response)')} end as m
from p_long group by id, year, outcome""",
)
SCORES = {
    o: "(" + " + ".join(f"{o}_{i}" for i in range(1, n + 1)) + f")::double / {n}"
    for o, n in ITEM_COUNTS.items()
}
SCORE_COLS = ", ".join(f"{e} as {o}" for o, e in SCORES.items())
PARTS["d_scores"] = f"select id, year, {SCORE_COLS} from p_dense"
oracle("scale_scores_wide", f"select id, year, {rs(' '.join(ITEM_COUNTS))} from d_scores")


def z_sql(c: str, source: str) -> str:
    return f"(({c} - (select avg({c}) from {source})) / (select stddev_samp({c}) from {source}))"


oracle(
    "zscore_scales",
    "select id, year, " + ", ".join(f"{r(z_sql(c, 'd_scores'))} as {c}" for c in ITEM_COUNTS)
    + " from d_scores",
)
oracle(
    "center_response",
    f"""select id, year, sep, {r('sep - (select avg(sep) from p_treat_rows)')} as sep_c
from p_treat_rows""",
)

# -- correlations ------------------------------------------------------------------------

PARTS["s_long"] = """
select id, school, year, outcome, avg(response) as score from p_long where response is not null
group by id, school, year, outcome"""
oracle("scale_scores_long", f"select id, school, year, outcome, {rs('score')} from s_long")


def corr_sql(x: str, y: str) -> str:
    """Correlation on complete pairs, null where it is not defined."""
    both = f"{x} is not null and {y} is not null"
    sx, sy = f"stddev_samp(case when {both} then {x} end)", f"stddev_samp(case when {both} then {y} end)"
    return f"case when {sx} > 0 and {sy} > 0 then corr({x}, {y}) end"


PARTS["r_within"] = f"""
select x_outcome, y_outcome, case when count(*) = count(r) then avg(r) end as r from (
 select a.year, a.outcome as x_outcome, b.outcome as y_outcome, {corr_sql('a.score', 'b.score')} as r
 from s_long a join s_long b on a.id = b.id and a.school = b.school and a.year = b.year
 group by all) group by all"""
oracle("corr_within", f"select x_outcome, y_outcome, {rs('r')} from r_within")
PARTS["r_between"] = f"""
select x_outcome, y_outcome, case when count(*) = count(r) then avg(r) end as r from (
 select a.year, a.outcome as x_outcome, b.outcome as y_outcome, {corr_sql('a.score', 'b.score')} as r
 from s_long a join s_long b on a.id = b.id and a.school = b.school and a.year + 1 = b.year
 where a.year <= 11 group by all) group by all"""
oracle("corr_between", f"select x_outcome, y_outcome, {rs('r')} from r_between")
PARTS["s_index"] = """
select jj, kk, year, outcome, avg(response) as score from p_resp group by all"""
oracle(
    "corr_within_by_index",
    f"""select x_outcome, y_outcome, {r('case when count(*) = count(r) then avg(r) end')} as r from (
 select a.year, a.outcome as x_outcome, b.outcome as y_outcome, {corr_sql('a.score', 'b.score')} as r
 from s_index a join s_index b on a.jj = b.jj and a.kk = b.kk and a.year = b.year
 group by all) group by all""",
)
oracle(
    "corr_matrix",
    "select x_outcome, "
    + ", ".join(f"max(case when y_outcome = '{o}' then {r('r')} end) as {o}" for o in OUTCOMES)
    + " from r_within group by x_outcome",
)


def fmt_sql(e: str) -> str:
    t = rf"regexp_replace(printf('%.2f', {e}), '^1\.00$', '-')"
    return rf"regexp_replace({t}, '^(-?)0\.', '\1.')"


for q in ("corr_report", "io_report_csv"):
    oracle(
        q,
        "select x_outcome, "
        + ", ".join(f"max(case when y_outcome = '{o}' then {fmt_sql('r')} end) as {o}" for o in REPORT_ORDER)
        + " from r_within group by x_outcome",
    )
PARTS["m_sd"] = """
select year, outcome, count(score) as n, avg(score) as mean, stddev_samp(score) as sd
from s_long group by year, outcome"""
oracle("m_sd_by_wave", f"select year, outcome, n, {rs('mean sd')} from m_sd")
CELL_TEXT = "printf('%.2f', round(mean, 2)) || ',' || printf('%.2f', round(sd, 2))"
oracle(
    "m_sd_report",
    "select year, "
    + ", ".join(f"max(case when outcome = '{o}' then {CELL_TEXT} end) as {o}" for o in REPORT_ORDER)
    + " from m_sd group by year",
)

# -- draw tables -------------------------------------------------------------------------

PARTS["v_draws"] = f"""
select (vec_id % {S.N_CHAINS} + 1)::int as chain, (vec_id // {S.N_CHAINS} + 1)::int as iteration,
 (vec_id + 1)::int as draw, [x::double * 8.0 for x in embedding] as e0 from embeddings"""
PARTS["v_out"] = f"""
select chain, iteration, draw, ({values(OUTCOMES)})[o + 1] as outcome,
 list_concat(e0[8 * o + 1:], e0[:8 * o]) as e
from v_draws cross join (select unnest(range(8)) as o)"""
SIMPLEX = "[exp(e[i]) / (exp(e[5]) + exp(e[6]) + exp(e[7]) + exp(e[8])) for i in [5, 6, 7, 8]]"
PARTS["st"] = f"""
select outcome, chain, iteration, draw, list_sort(e[1:4]) as c, {SIMPLEX} as z_time, e[9] as b_time,
 e[10:14] as b_sep, [exp(e[15]), exp(e[16])] as sigma_j, tanh(e[17]) as rho, exp(e[18]) as sigma_k,
 e[19:36] as z1, e[37:54] as z2, e[55:64] as b_k_z from v_out"""
PARTS["sc"] = f"""
select outcome, chain, iteration, draw, list_sort(e[1:4]) as c, {SIMPLEX} as z_time,
 e[10:11] as b_sep_free, [0.0, e[10], e[11]] as b_sep, e[12:14] as b_sep_time,
 [exp(e[15]), exp(e[16])] as sigma_j, tanh(e[17]) as rho, [exp(e[18]), exp(e[19])] as sigma_k,
 tanh(e[20]) as rho_k, e[23:32] as zk1, e[33:42] as zk2, e[43:53] as zj1, e[54:64] as zj2 from v_out"""
OD = "outcome, draw"


# scalar-indexed parameters of the student model, in long form
PARTS["st_long"] = " union all ".join(
    f"select {OD}, chain, iteration, '{p}' as parameter, i::int as i1, {e} as estimate from st "
    f"cross join (select unnest(range(1, {n + 1})) as i)"
    for p, e, n in [
        ("c", "c[i]", 4), ("z_time", "z_time[i]", 4), ("b_sep", "b_sep[i]", 5),
        ("sigma_j", "sigma_j[i]", 2), ("b_k_z", "b_k_z[i]", 10),
    ]
)
for q in ("interval_by_parameter", "interval_by_rank"):
    oracle(
        q,
        f"""select outcome, parameter, i1, {r('q[1]')} as median, {r('q[2]')} as lower, {r('q[3]')} as upper
from (select outcome, parameter, i1, quantile_cont(estimate, [0.5, 0.025, 0.975]) as q
from st_long group by all)""",
    )
oracle(
    "log_sum_exp",
    f"""select outcome, parameter, i1, {r('max(m) + ln(sum(exp(x - m)))')} as lse from (
select *, estimate * 100 as x, max(estimate * 100) over (partition by outcome, parameter, i1) as m
from st_long) group by outcome, parameter, i1""",
)
oracle(
    "draws_selected",
    f"select {OD}, "
    + ", ".join(f"{r(f'c[{i}]')} as \"c[{i}]\"" for i in range(1, 5)) + ", "
    + ", ".join(f"{r(f'b_sep_time[{i}]')} as \"b_sep_time[{i}]\"" for i in range(1, 4))
    + " from sc",
)
oracle(
    "draws_numbered",
    f"""select chain, iteration, {r('e0[1]')} as b, ((chain - 1) *
(select (count(*) + {S.N_CHAINS - 1}) // {S.N_CHAINS} from embeddings) + iteration)::int as draw from v_draws""",
)
oracle(
    "draws_long",
    f"""select {OD}, chain, iteration, parameter, i1, {rs('estimate')} from st_long
where parameter in ('c', 'z_time', 'b_sep', 'sigma_j')""",
)
oracle(
    "draws_spread",
    f"""select chain, iteration, draw, x::int as x, {r('e0[2 + x]')} as b_x from v_draws
cross join (select unnest(range(1, 9)) as x)""",
)
oracle(
    "draws_array",
    f"select {OD}, " + ", ".join(f"{r(f'z_time[{i}]')} as z{i}" for i in range(1, 5)) + " from st",
)
Y5 = "cross join (select unnest(range(1, 6))::int as y)"
X5 = "cross join (select unnest(range(5))::int as x_time)"
PARTS["st_y"] = f"select {OD}, y, case when y > 1 then c[y - 1] end as c, b_time from st {Y5}"
PARTS["sc_y"] = f"select {OD}, y, case when y > 1 then c[y - 1] end as c from sc {Y5}"
oracle("ps_y_students", f"select {OD}, y, {rs('c b_time')} from st_y")
oracle("io_draws_partitioned", f"select {OD}, y, {rs('c b_time')} from st_y where outcome = 'em'")
oracle("ps_y_schools", f"select {OD}, y, {rs('c')} from sc_y")
oracle(
    "stack_models",
    f"""select {OD}, y, {rs('c b_time')}, 'students' as model from st_y union all
select {OD}, y, {rs('c')}, null, 'schools' from sc_y""",
)
oracle("stack_outcomes", f"select outcome, y, {r('avg(c)')} as c_mean from st_y group by outcome, y")
oracle(
    "nesting_schools",
    f"select {OD}, {rs('sigma_k')}, kk from st cross join (select unnest(range(1, 11))::int as kk)",
)
oracle(
    "ps_x_students",
    f"""select {OD}, x_time, {r('b_sep[x_time + 1]')} as b_sep,
case when x_time > 0 then {r('z_time[x_time]')} end as z_time from st {X5}""",
)
oracle(
    "ps_x_time_schools",
    f"select {OD}, x_time, case when x_time > 0 then {r('z_time[x_time]')} end as z_time from sc {X5}",
)
oracle(
    "ps_x_sep_schools",
    f"""select {OD}, x_sep, {r('b_sep[x_sep]')} as b_sep, {r('b_sep_time[x_sep]')} as b_sep_time
from sc cross join (select unnest([1, 2, 3])::int as x_sep)""",
)


def two(sig: str, rho: str, a: str, b: str) -> tuple[str, str]:
    return f"{sig}[1] * {a}", f"{sig}[2] * ({rho} * {a} + sqrt(1 - {rho} * {rho}) * {b})"


B1, B2 = two("sigma_j", "rho", "z1[j]", "z2[j]")
K1, K2 = two("sigma_k", "rho_k", "zk1[j]", "zk2[j]")
S1, S2 = two("sigma_j", "rho", "zj1[j]", "zj2[j]")


def upto(n: int) -> str:
    return "[" + ", ".join(str(i) for i in range(1, n + 1)) + "]"


PARTS["st_eff"] = f"""
select *, [{B1} for j in {upto(18)}] as b_j_1, [{B2} for j in {upto(18)}] as b_j_2,
 [1 / (1 + exp(-(z1[j] + z2[j]))) for j in {upto(18)}] as x_sep,
 [sigma_k * b_k_z[j] for j in {upto(10)}] as b_k_1,
 [0.0, 4 * z_time[1], 4 * (z_time[1] + z_time[2]), 4 * (z_time[1] + z_time[2] + z_time[3]),
  4 * (z_time[1] + z_time[2] + z_time[3] + z_time[4])] as mo from st"""
PARTS["sc_eff"] = f"""
select *, [{S1} for j in {upto(11)}] as b_j_1, [{S2} for j in {upto(11)}] as b_j_2,
 [{K1} + b_sep[(j - 1) % 3 + 1] for j in {upto(10)}] as b_k_1,
 [{K2} + b_sep_time[(j - 1) % 3 + 1] for j in {upto(10)}] as b_k_2,
 [0.0, 4 * z_time[1], 4 * (z_time[1] + z_time[2]), 4 * (z_time[1] + z_time[2] + z_time[3]),
  4 * (z_time[1] + z_time[2] + z_time[3] + z_time[4])] as mo from sc"""


def slots(n: int, name: str) -> str:
    return f"cross join (select unnest(range(1, {n + 1}))::int as {name})"


oracle(
    "ps_jj_students",
    f"""select {OD}, jj, {r('b_j_1[jj]')} as b_j_1, {r('b_j_2[jj]')} as b_j_2, {r('x_sep[jj]')} as x_sep
from st_eff {slots(18, 'jj')}""",
)
oracle("ps_kk_students", f"select {OD}, kk, {r('b_k_1[kk]')} as b_k_1 from st_eff {slots(10, 'kk')}")
oracle(
    "ps_kk_schools",
    f"select {OD}, kk, {r('b_k_1[kk]')} as b_k_1, {r('b_k_2[kk]')} as b_k_2 from sc_eff {slots(10, 'kk')}",
)
oracle(
    "ps_jj_schools",
    f"select {OD}, jj, {r('b_j_1[jj]')} as b_j_1, {r('b_j_2[jj]')} as b_j_2 from sc_eff {slots(11, 'jj')}",
)


def logistic(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def p_sql(eta: str, y: str = "y", c: str = "c") -> str:
    lo, hi = logistic(f"{eta} - {c}[{y} - 1]"), logistic(f"{eta} - {c}[{y}]")
    return f"case when {y} = 1 then 1 - {hi} when {y} < 5 then {lo} - {hi} else {lo} end"


PARTS["st_grid"] = f"""
select {OD}, x_sep, x_time, y, {p_sql('eta')} as p from (
 select *, b_time * mo[x_time + 1] + b_sep[x_time + 1] * x_sep as eta
 from (select outcome, draw, c, b_time, b_sep, mo from st_eff) {X5}
 cross join (select unnest([0, 1])::int as x_sep) {Y5})"""
PARTS["sc_grid"] = f"""
select {OD}, x_sep, x_time, y, {p_sql('eta')} as p from (
 select *, b_sep[x_sep] + b_sep_time[x_sep] * mo[x_time + 1] as eta
 from (select outcome, draw, c, b_sep, b_sep_time, mo from sc_eff) {X5}
 cross join (select unnest([1, 2, 3])::int as x_sep) {Y5})"""
for q in ("ps_p_students", "predict_grid_students"):
    oracle(q, f"select {OD}, x_sep, x_time, y, {rs('p')} from st_grid")
PARTS["all_outcomes"] = "select outcome, count(*) as n from st group by outcome"
TABLE_ROWS = {"students_y": 5, "students_x": 5, "students_jj": 18, "students_kk": 10, "students_p": 50,
              "schools_y": 5, "schools_x_time": 5, "schools_x_sep": 3, "schools_jj": 11, "schools_kk": 10, "schools_p": 75}
oracle(
    "io_draws_all",
    " union all ".join(f"select '{t}' as source, outcome, n * {k} as n, n as draws from all_outcomes" for t, k in TABLE_ROWS.items()),
)
oracle("ps_p_schools", f"select {OD}, x_sep, x_time, y, {rs('p')} from sc_grid")
oracle("predict_grid_schools", f"select {OD}, x_sep, x_time, y, {rs('p')} from sc_grid")
oracle(
    "to_wide_composite",
    f"select {OD}, x_sep, "
    + ", ".join(
        f"max(case when x_time = {t - 8} and y = {y} then {r('p')} end) as p_{t}_{y}"
        for t in (10, 12) for y in range(1, 6)
    )
    + " from st_grid group by outcome, draw, x_sep",
)
PARTS["chol"] = f"""
select {OD}, i::int as i, k::int as k, case when i = 1 and k = 1 then 1.0 when i = 1 then 0.0
 when k = 1 then rho else sqrt(1 - rho * rho) end as v
from st cross join (select unnest([1, 2]) as i) cross join (select unnest([1, 2]) as k)"""
PARTS["rho_rows"] = f"""
select a.outcome, a.draw, a.i, b.i as j, sum(a.v * b.v) as r from chol a
join chol b on a.outcome = b.outcome and a.draw = b.draw and a.k = b.k group by all"""
oracle("corr_from_cholesky", f"select {OD}, i, j, {rs('r')} from rho_rows")
oracle(
    "covariance",
    f"""select r.outcome, r.draw, i, j, {r('sigma_j[i] * r.r * sigma_j[j]')} as cov
from rho_rows r join st on st.outcome = r.outcome and st.draw = r.draw""",
)
oracle(
    "reference_level",
    f"""select {OD}, x_sep, {r('b_sep[x_sep]')} as b_sep_free from sc
cross join (select unnest([1, 2, 3])::int as x_sep)""",
)
for q in ("monotonic_running", "monotonic_vector"):
    oracle(q, f"select {OD}, x_time, {r('mo[x_time + 1]')} as mo from st_eff {X5}")
oracle("category_probability_rows", f"select {OD}, y, {r(p_sql('b_time * 2'))} as p from st {Y5}")

# -- ordinal models ----------------------------------------------------------------------

PARTS["st_resp"] = """
select r.outcome, r.ii, r.jj, r.kk, (r.year - 8)::int as x_time, r.response as y, r.item, t.sep,
 (r.jj - 1) % 18 + 1 as jj_slot, (r.kk - 1) % 10 + 1 as kk_slot
from p_resp r left join p_treated t on t.id = r.id"""
PARTS["st_cells"] = """
select outcome, jj_slot, kk_slot, x_time, y, sep, count(*) as n from st_resp group by all"""
oracle("response_cells", "select outcome, jj_slot, kk_slot, x_time, y, sep, n from st_cells")
PARTS["st_eta"] = """
select s.outcome, s.jj_slot, s.x_time, s.y, s.sep, s.n, e.draw, e.c, e.b_sep, e.x_sep[jj_slot] as w,
 e.b_j_1[jj_slot] + e.b_k_1[kk_slot] + (e.b_time + e.b_j_2[jj_slot]) * e.mo[x_time + 1] as eta_0
from st_cells s join (select outcome, draw, c, b_sep, x_sep, b_j_1, b_j_2, b_k_1, b_time, mo
 from st_eff) e on e.outcome = s.outcome"""
oracle(
    "linear_predictor_students",
    f"""select {OD}, sum(n)::bigint as n, {r('sum(n * eta_0) / sum(n)')} as eta_0,
{r('sum(n * (eta_0 + b_sep[x_time + 1])) / sum(n)')} as eta_1,
{r('sum(n * coalesce(sep, w)) / sum(n)')} as x_sep from st_eta group by {OD}""",
)
ORACLE["linear_predictor_students_tiled"] = ORACLE["linear_predictor_students"]


def softplus(x: str) -> str:
    return f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


def ll_sql(eta: str) -> str:
    """Log-probability of category y, without the cancellation of a difference."""
    below, above = softplus(f"c[y - 1] - ({eta})"), softplus(f"({eta}) - c[y]")
    gap = "ln(1 - exp(c[y - 1] - c[y]))"
    return f"(case when y = 1 then -{above} when y = 5 then -{below} else {gap} - {below} - {above} end)"


PARTS["st_ab"] = f"""
select {OD}, n, sep, ln(w) + {ll_sql('eta_0 + b_sep[x_time + 1]')} as a,
 ln(1 - w) + {ll_sql('eta_0')} as b,
 {ll_sql('eta_0 + b_sep[x_time + 1] * coalesce(sep, 0)')} as k from st_eta"""
PARTS["st_ll"] = f"""
select {OD}, n, case when sep is null
 then greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) else k end as llk from st_ab"""
oracle("loglik_students_pointwise", f"select outcome, {r('sum(n * llk) / sum(n)')} as llk, sum(n)::bigint as n from st_ll group by outcome")
oracle("loglik_students", f"select {OD}, {r('sum(n * llk) / sum(n)')} as llk from st_ll group by {OD}")
ORACLE["loglik_students_tiled"] = ORACLE["loglik_students"]
PARTS["sc_cells"] = """
select outcome, (jj - 1) % 11 + 1 as jj_slot, (kk - 1) % 10 + 1 as kk_slot,
 (year - 8)::int as x_time, response as y, count(*) as n from p_resp group by all"""
PARTS["sc_eta"] = """
select s.outcome, s.y, s.n, e.draw, e.c, e.b_j_1[jj_slot] + e.b_k_1[kk_slot]
 + (e.b_j_2[jj_slot] + e.b_k_2[kk_slot]) * e.mo[x_time + 1] as eta
from sc_cells s join (select outcome, draw, c, b_j_1, b_j_2, b_k_1, b_k_2, mo from sc_eff) e
on e.outcome = s.outcome"""
oracle(
    "loglik_schools",
    f"select {OD}, {r(f"sum(n * {ll_sql('eta')}) / sum(n)")} as llk from sc_eta group by {OD}",
)

# -- effects -----------------------------------------------------------------------------

PARTS["st_mean"] = f"select {OD}, x_sep, x_time, sum(y * p) as m from st_grid group by all"
PARTS["sc_mean"] = f"select {OD}, x_sep, x_time, sum(y * p) as m from sc_grid group by all"
oracle("expected_mean", f"select {OD}, x_sep, x_time, {rs('m')} from st_mean")
for q, src, arms in (
    ("mean_interval_students", "st_mean", {1: "Yes", 0: "No"}),
    ("mean_interval_schools", "sc_mean",
     {3: "Current involvement", 2: "Past involvement", 1: "No involvement"}),
):
    arm, arm_level = pick_map(arms, "x_sep")
    oracle(
        q,
        f"""select outcome, x_sep, {r('q[1]')} as m_est, {r('q[2]')} as lower, {r('q[3]')} as upper,
{LABEL} as name, {LEVEL} as name_level, {arm} as arm, {arm_level} as arm_level, x_time + 8 as year
from (select outcome, x_sep, x_time, quantile_cont(m, [0.5, 0.025, 0.975]) as q from {src} group by all)""",
    )
PARTS["sds"] = """
select outcome, stddev_samp(m) as sd from (select outcome, id, avg(response) as m from p_long
where year = 10 and response is not null group by all) group by outcome"""
oracle("baseline_sd", f"select outcome, {rs('sd')} from sds")
D_LABEL, D_LEVEL = pick_map(
    {"d_10": "Year 10", "d_11": "Year 11 (adjusted)", "d_12": "Year 12 (adjusted)"}, "comparison"
)


def cohens(q: str, src: str, contrasts: dict[str, tuple[int, int]]) -> None:
    parts = []
    for label, (arm, ref) in contrasts.items():
        def gap(t):
            return (f"(max(case when x_sep = {arm} and x_time = {t} then m end) - "
                    f"max(case when x_sep = {ref} and x_time = {t} then m end))")
        for t in (2, 3, 4):
            d = gap(2) if t == 2 else f"{gap(t)} - {gap(2)}"
            parts.append(
                f"select {OD}, '{label}' as contrast, 'd_{t + 8}' as comparison, {d} as d "
                f"from {src} group by {OD}"
            )
    oracle(
        q,
        f"""select outcome, contrast, comparison, {r('q[1]')} as d_est, {r('q[2]')} as lower,
{r('q[3]')} as upper, {LABEL} as name, {LEVEL} as name_level, {D_LABEL} as label,
{D_LEVEL} as label_level, sign(q[2]) = sign(q[3]) as p from (
select g.outcome, contrast, comparison, quantile_cont(d / sd, [0.5, 0.025, 0.975]) as q
from ({' union all '.join(parts)}) g left join sds on sds.outcome = g.outcome group by all)""",
    )


cohens("cohens_d_students", "st_mean", {"1": (1, 0)})
cohens("cohens_d_schools", "sc_mean", {"3": (3, 1), "2": (2, 1)})

# -- posterior predictive ----------------------------------------------------------------


def uniform_sql(keys: list[str], seed: int) -> str:
    h = f"{seed % MODULI[0]}::bigint"
    for k, factor in zip(keys, FACTORS):
        h = f"(({h} * {factor} + ({k})::bigint * {factor}) % {MODULI[0]})"
    for i in (1, 2):
        h = f"(({h} * {h} % {MODULI[i]} * {FACTORS[i]} + 12345) % {MODULI[i + 1]})"
    return f"(({h}::double + 0.5) / {MODULI[3]}.0)"


def sampled(u: str, p: list[str]) -> str:
    run = ["0.0 + " + " + ".join(p[: i + 1]) for i in range(5)]
    cases = " ".join(f"when {run[i]} >= {u} * ({run[4]}) then {i + 1}" for i in range(4))
    return f"(case {cases} else 5 end)::int"


PARTS["pp_eta"] = """
select s.outcome, s.ii, s.jj, s.kk, s.x_time, s.y, s.sep, e.draw, e.c, coalesce(s.sep, e.x_sep[jj_slot]) as w,
 e.b_j_1[jj_slot] + e.b_k_1[kk_slot] + (e.b_time + e.b_j_2[jj_slot]) * e.mo[x_time + 1] as eta_0,
 e.b_sep[x_time + 1] as b
from st_resp s join (select outcome, draw, c, b_sep, x_sep, b_j_1, b_j_2, b_k_1, b_time, mo
 from st_eff) e on e.outcome = s.outcome"""
PARTS["pp_p"] = (
    f"select outcome, ii, jj, kk, x_time, sep, draw, {uniform_sql(['draw', 'ii'], 20)} as u, "
    + ", ".join(
        f"w * ({p_sql('(eta_0 + b)', str(y))}) + (1 - w) * ({p_sql('eta_0', str(y))}) as p{y}"
        for y in range(1, 6)
    )
    + " from pp_eta"
)
ARM, ARM_LEVEL = pick_map({1.0: "Yes", 0.0: "No"}, "sep")
def predictive_sql(where: str = "") -> str:
    return f"""select q.outcome, q.jj, q.kk, q.x_time, sep::double as sep, {r('q.q[1]')} as m_pred, {r('q.q[2]')} as lower,
{r('q.q[3]')} as upper, {r('o.m_obs')} as m_obs, {ARM} as arm_name, {ARM_LEVEL} as arm_name_level from (
 select outcome, jj, kk, x_time, sep, quantile_cont(m, [0.5, 0.025, 0.975]) as q from (
  select outcome, draw, jj, kk, x_time, sep, avg({sampled('u', ['p1', 'p2', 'p3', 'p4', 'p5'])}) as m
  from pp_p {where} group by all) group by all) q
left join (select outcome, jj, kk, x_time, avg(y) as m_obs from st_resp group by all) o
on o.outcome = q.outcome and o.jj = q.jj and o.kk = q.kk and o.x_time = q.x_time"""


oracle("posterior_predictive_summary", predictive_sql())
oracle("posterior_predictive_cases", predictive_sql("where jj in (1, 2, 3)"))
CODE = f"list_position({values(OUTCOMES)}, outcome)"
oracle(
    "sample_category_rows",
    f"""select {OD}, x_sep, x_time, {sampled(uniform_sql([CODE, 'draw', 'x_sep', 'x_time'], 21),
    ['p1', 'p2', 'p3', 'p4', 'p5'])} as y_pred from (select {OD}, x_sep, x_time, """
    + ", ".join(f"max(case when y = {y} then p end) as p{y}" for y in range(1, 6))
    + f" from st_grid group by {OD}, x_sep, x_time)",
)

# -- imputation --------------------------------------------------------------------------

oracle("treatment", "select id, school, school_involvement, y11, y12, sep from p_treated")
oracle(
    "units_without_late_wave",
    """select distinct id, school, school_involvement from p_treat_rows
where id not in (select id from p_treat_rows where year >= 11)""",
)
PARTS["i_design"] = """
select id, dense_rank() over (order by id) as jj, dense_rank() over (order by school) as kk,
 coalesce(y11 - (select avg(y11) from p_treated), -1)::double as y11_c,
 coalesce(y12 - (select avg(y12) from p_treated), -1)::double as y12_c,
 coalesce(y11, -1)::int as y11, coalesce(y12, -1)::int as y12, (y11 is null)::int as m11,
 (y12 is null)::int as m12, school_involvement, sep from p_treated"""
oracle(
    "impute_design",
    f"select id, jj, kk, {rs('y11_c y12_c')}, y11, y12, m11, m12, school_involvement, sep from i_design",
)
PARTS["i_cells"] = """
select (kk - 1) % 7 + 1 as kk_slot, school_involvement, y11, y12, m11, m12, y11_c, y12_c, sep,
 count(*) as n from i_design group by all"""
CID = "kk_slot, school_involvement, y11, y12"


def lin(own: str, at: int, other: str, school: int, sig: int) -> str:
    def k(i):
        return f"e0[{school} + 6 * (kk_slot - 1) + {i}] * exp(e0[{sig + i}])"

    return (
        f"e0[{at}] + {k(0)} + (e0[{at + 1}] + {k(1)}) * (1 - m{other}) * y{other}_c"
        f" + (e0[{at + 2}] + {k(2)}) * m{other} + e0[{at + 2} + school_involvement]"
    )


PARTS["i_lin"] = f"""
select c.*, d.draw, d.chain, d.iteration, {lin('11', 1, '12', 19, 13)} as l11,
 {lin('12', 7, '11', 22, 16)} as l12 from i_cells c cross join v_draws d"""
oracle("impute_linear_predictor", f"select {CID}, draw, {rs('l11 l12')} from i_lin")


PARTS["i_score"] = f"""
select {CID}, draw, case when y11 <> -1 then y11 else {logistic('l11')} end as p11,
 case when y12 <> -1 then y12 else {logistic('l12')} end as p12,
 case when y11 <> -1 then y11 * l11 - {softplus('l11')} end as llk11,
 case when y12 <> -1 then y12 * l12 - {softplus('l12')} end as llk12 from i_lin"""
EITHER = "1 - (1 - p11) * (1 - p12)"
oracle(
    "impute_score",
    f"select {CID}, draw, {rs('p11 p12')}, {r(EITHER)} as sep_draw, {rs('llk11 llk12')} from i_score",
)
NEITHER = f"(-{softplus('l11')} - {softplus('l12')})"
ON, OFF_ON = f"-{softplus('-l11')}", f"(-{softplus('l11')} - {softplus('-l12')})"
ANY = f"(greatest({ON}, {OFF_ON}) + ln(1 + exp(-abs(({ON}) - ({OFF_ON})))))"
PARTS["i_llk"] = f"""
select *, case sep when 1 then {ANY} when 0 then {NEITHER} end as sep_llk
from i_lin where sep is not null"""
oracle("impute_sep_loglik", f"select {CID}, draw, sep, n, {rs('sep_llk')} from i_llk")
PARTS["i_elpd"] = f"""
select {CID}, sep, n, ln(count(*)) - (max(m) + ln(sum(exp(-sep_llk - m)))) as elpd_loo from (
select *, max(-sep_llk) over (partition by {CID}) as m from i_llk) group by {CID}, sep, n"""
oracle(
    "is_loo",
    f"""select d.id, d.jj, d.sep, {r('e.elpd_loo')} as elpd_loo from i_design d join i_elpd e
on (d.kk - 1) % 7 + 1 = e.kk_slot and d.school_involvement = e.school_involvement
and d.y11 = e.y11 and d.y12 = e.y12 where d.sep is not null""",
)
PARTS["cmat"] = """
select predicted, sum(case when sep = 0 then q * n end) as observed_0,
 sum(case when sep = 1 then q * n end) as observed_1 from (
 select *, case when predicted = sep then exp(elpd_loo) else 1 - exp(elpd_loo) end as q
 from i_elpd cross join (select unnest([0, 1])::int as predicted)) group by predicted"""
oracle("loo_confusion", f"select predicted, {rs('observed_0 observed_1')} from cmat")
oracle(
    "loo_prf",
    f"""select {rs('precision recall')}, {r('2 * precision * recall / (precision + recall)')} as f1 from (
select sum(case when predicted = 1 then observed_1 end) / sum(case when predicted = 1
 then observed_0 + observed_1 end) as precision,
 sum(case when predicted = 1 then observed_1 end) / sum(observed_1) as recall from cmat)""",
)
oracle(
    "confusion_labels",
    f"""select predicted, {r('sum(case when quality = 0 then q end)')} as observed_0,
{r('sum(case when quality = 1 then q end)')} as observed_1 from (
 select *, case when predicted = quality then p else 1 - p end as q from (
  select quality, avg(quality) over (partition by toxic) as p from labels
  where quality is not null and toxic is not null)
 cross join (select unnest([0, 1])::int as predicted)) group by predicted""",
)
PARTS["i_sep"] = f"select {CID}, draw, {EITHER} as s from i_score"
PARTS["i_beta"] = f"""
select {CID}, case when n >= 2 and v > 1e-12 then m * (m * (1 - m) / v - 1) end as sep_alpha,
 case when n >= 2 and v > 1e-12 then (1 - m) * (m * (1 - m) / v - 1) end as sep_beta,
 case when n < 2 then 'fewer than two draws inside' when v <= 1e-12 then 'no spread' end as reason
from (select {CID}, count(s) as n, avg(s) as m, var_samp(s) as v from (
 select {CID}, case when s > 0 and s < 1 then s end as s from i_sep) group by {CID})"""
oracle("beta_moments", f"select {CID}, {rs('sep_alpha sep_beta')}, reason from i_beta")
oracle(
    "merge_fitted",
    f"""select p.id, p.year, p.school, p.school_involvement, d.sep, {r('b.sep_alpha', 4)} as sep_alpha,
{r('b.sep_beta', 4)} as sep_beta, {', '.join('p.' + c for c in ITEMS)} from p_wide p
left join i_design d on d.id = p.id left join i_beta b on (d.kk - 1) % 7 + 1 = b.kk_slot
and d.school_involvement = b.school_involvement and d.y11 = b.y11 and d.y12 = b.y12""",
)



def digamma_sql(x: str) -> str:
    back = " + ".join(f"1 / ({x} + {i})" for i in range(8))
    z = f"({x} + 8)"
    return f"(ln{z} - 0.5 / {z} - 1 / (12 * {z}^2) + 1 / (120 * {z}^4) - 1 / (252 * {z}^6) + 1 / (240 * {z}^8) - ({back}))"


def trigamma_sql(x: str) -> str:
    back = " + ".join(f"1 / ({x} + {i})^2" for i in range(8))
    z = f"({x} + 8)"
    return f"(1 / {z} + 0.5 / {z}^2 + 1 / (6 * {z}^3) - 1 / (30 * {z}^5) + 1 / (42 * {z}^7) - 1 / (30 * {z}^9) + {back})"


PARTS["i_beta_start"] = f"""
select *, case when n >= 2 and v > 1e-12 then m * greatest(m * (1 - m) / v - 1, 1e-3) end as a0,
 case when n >= 2 and v > 1e-12 then (1 - m) * greatest(m * (1 - m) / v - 1, 1e-3) end as b0,
 case when n < 2 then 'fewer than two draws inside' when v <= 1e-12 then 'no spread' end as reason
from (select {CID}, count(s) as n, avg(s) as m, var_samp(s) as v, avg(ln(s)) as g1, avg(ln(1 - s)) as g2 from (
 select {CID}, case when s > 0 and s < 1 then s end as s from i_sep) group by {CID})"""
PARTS["i_beta_newton"] = f"""
with recursive newton as (
 select {CID}, g1, g2, a0 as a, b0 as b, 0 as step from i_beta_start where reason is null
 union all
 select {CID}, g1, g2, case when da < a then a - da else a / 2 end, case when db < b then b - db else b / 2 end, step + 1 from (
  select *, (fa * (tb - ts) + fb * ts) / ((ta - ts) * (tb - ts) - ts * ts) as da,
   (fb * (ta - ts) + fa * ts) / ((ta - ts) * (tb - ts) - ts * ts) as db from (
   select *, {digamma_sql('a')} - {digamma_sql('(a + b)')} - g1 as fa, {digamma_sql('b')} - {digamma_sql('(a + b)')} - g2 as fb,
    {trigamma_sql('a')} as ta, {trigamma_sql('b')} as tb, {trigamma_sql('(a + b)')} as ts from newton where step < 60))
) select * from newton where step = 60"""
PARTS["i_beta_ml"] = f"""
select {CID}, a as sep_alpha, b as sep_beta, reason from i_beta_start left join i_beta_newton using ({CID})"""
oracle("beta_fit", f"select {CID}, {rs('sep_alpha sep_beta', 4)}, reason from i_beta_ml")
oracle(
    "merge_fitted_ml",
    " union all ".join(
        f"""select p.id, p.year, p.school, p.school_involvement, d.sep, {r('b.sep_alpha', 4)} as sep_alpha, {r('b.sep_beta', 4)} as sep_beta,
'{c[:2]}' as outcome, {c[3:]} as item, p.{c} as response from p_wide p left join i_design d on d.id = p.id
left join i_beta_ml b on (d.kk - 1) % 7 + 1 = b.kk_slot and d.school_involvement = b.school_involvement and d.y11 = b.y11 and d.y12 = b.y12"""
        for c in ITEMS
    ),
)
PARTS["i_merged"] = f"""
select p.*, d.sep as d_sep, b.sep_alpha, b.sep_beta from p_wide p
left join i_design d on d.id = p.id left join i_beta b on (d.kk - 1) % 7 + 1 = b.kk_slot
and d.school_involvement = b.school_involvement and d.y11 = b.y11 and d.y12 = b.y12"""
oracle(
    "io_panel_derived",
    " union all ".join(
        f"""select id, year, school, school_involvement, d_sep as sep, {rs('sep_alpha sep_beta', 4)},
'{c[:2]}' as outcome, {c[3:]} as item, {c} as response from i_merged""" for c in ITEMS
    ),
)

oracle(
    "impute_fit_scores",
    " union all ".join(
        f"""select {own} as wave, unnest(['intercept', '_y{other}', 'm{other}', '_s2', '_s3']) as term, 0.0::double as score
union all select distinct {own}, 'kk_slot=' || kk_slot, 0.0::double from i_cells where m{own} = 0""" for own, other in ((11, 12), (12, 11))),
)

# -- dropout -----------------------------------------------------------------------------

DP = DROPOUT_PREDICTORS
PARTS["d_grid"] = "select id, school, year, missing, " + ", ".join(
    f"{SCORES[o]} as {o}" for o in DP
) + " from g_dense"
PARTS["d_z"] = "select id, school, year, missing, " + ", ".join(
    f"{z_sql(o, 'd_grid')} as {o}" for o in DP
) + " from d_grid"
PARTS["d_trim"] = f"""
select * exclude (kept) from (select *, {not_leading()} as kept from d_z
window w as (partition by id order by year)) where kept"""
PARTS["d_panel"] = (
    "select id, school, year, missing, " + ", ".join(f"{lag_chain(o, '0')} as {o}" for o in DP)
    + """, (row_number() over w) as ii, dense_rank() over (order by id) as jj,
 dense_rank() over (order by school) as kk, missing::int as y
from d_trim window w as (partition by id order by year)"""
)
DPS = " ".join(DP)
oracle("dropout_panel", f"select id, school, year, missing, {rs(DPS)}, ii, jj, kk, y from d_panel")
PARTS["d_design"] = (
    "select * from (select id, year, jj, kk, y, ii, lag(y) over w as y_prev, "
    + ", ".join(f"lag({o}) over w as {o}_prev" for o in DP)
    + " from d_panel window w as (partition by id order by year)) where ii > 1"
)
PREV = " ".join(f"{o}_prev" for o in DP)
oracle(
    "dropout_fit_scores",
    f"select unnest({values(['intercept', 'y_prev', *DP, *[f'wave_{w}' for w in WAVES[2:]]])}) as term, 0.0::double as score",
)
oracle("dropout_design", f"select id, year, jj, kk, y, y_prev, {rs(PREV)} from d_design")
EFFECT = " + ".join(f"e0[{3 + i}] * {o}_prev" for i, o in enumerate(DP))
PARTS["d_score"] = f"""
select id, year, draw, y, e0[1] + exp(e0[14]) * e0[39 + (jj - 1) % 12]
 + case year when 9 then 0 when 10 then e0[11] when 11 then e0[12] else e0[13] end
 + exp(e0[15 + year - 9]) * e0[19 + 4 * ((kk - 1) % 5) + year - 9]
 + e0[2] * y_prev + ({EFFECT}) * (1 - y_prev) as alpha
from d_design cross join v_draws"""
oracle(
    "dropout_loglik_by_draw",
    f"""select draw, count(*) as n, {r(f"avg(y * alpha - {softplus('alpha')})")} as llk
from d_score group by draw""",
)
oracle(
    "dropout_risk_by_row",
    f"""select id, year, {r(f"avg({logistic('alpha')})")} as p, {r('avg(alpha)')} as alpha
from d_score group by id, year""",
)
XORD = {i: OUTCOME_LABELS[DP[i - 1]] for i in (1, 2, 3, 4, 6, 5, 7, 8)}
X_LABEL, X_LEVEL = pick_map(XORD, "x")
oracle(
    "dropout_odds_ratios",
    f"""select x, {r('q[1]')} as odds_ratio, {r('q[2]')} as lower, {r('q[3]')} as upper,
{X_LABEL} as name, {X_LEVEL} as name_level from (
select x::int as x, quantile_cont(exp(e0[2 + x]), [0.5, 0.025, 0.975]) as q from v_draws
cross join (select unnest(range(1, 9)) as x) group by x)""",
)

# -- counterfactual ----------------------------------------------------------------------

SIM_SEED, SIM_STUDENTS, SIM_SCHOOLS = 20_240_917, 1000, 10


def normals(a: str, b: str) -> tuple[str, str]:
    rad = f"sqrt(-2.0 * ln({a}))"
    return f"{rad} * cos(6.283185307179586 * {b})", f"{rad} * sin(6.283185307179586 * {b})"


Z1, Z2 = normals(uniform_sql(["draw", "jj"], SIM_SEED + 1), uniform_sql(["draw", "jj"], SIM_SEED + 2))
ZK, _ = normals(uniform_sql(["draw", "kk"], SIM_SEED + 3), uniform_sql(["draw", "kk"], SIM_SEED + 4))
PARTS["sim_jj"] = f"""
select jj, (floor({uniform_sql(['jj'], SIM_SEED)} * {SIM_SCHOOLS}) + 1)::int as kk
from (select unnest(range(1, {SIM_STUDENTS + 1}))::int as jj)"""
PARTS["sim_kk"] = f"""
select outcome, draw, kk, sigma_k * {ZK} as b_k_1 from st
cross join (select unnest(range(1, {SIM_SCHOOLS + 1}))::int as kk)"""
PARTS["sim_z"] = f"select draw, jj, kk, {Z1} as z1, {Z2} as z2 from v_draws cross join sim_jj"
PARTS["sim"] = """
select s.outcome, z.draw, z.jj, z.kk, sigma_j[1] * z.z1 as b_j_1,
 sigma_j[2] * (rho * z.z1 + sqrt(1 - rho * rho) * z.z2) as b_j_2, k.b_k_1, s.c, s.b_time, s.b_sep,
 4 * (z_time[1] + z_time[2]) as mo2, 4 * (z_time[1] + z_time[2] + z_time[3] + z_time[4]) as mo4
from sim_z z join (select outcome, draw, sigma_j, rho, c, b_time, b_sep, z_time from st) s on s.draw = z.draw
join sim_kk k on k.outcome = s.outcome and k.draw = z.draw and k.kk = z.kk"""
oracle(
    "simulated_effects",
    f"""select {OD}, kk, count(*) as n, {r('avg(b_j_1)')} as b_j_1, {r('avg(b_j_2)')} as b_j_2,
{r('max(b_k_1)')} as b_k_1 from sim group by outcome, draw, kk""",
)


def vec(arm: int, w: int) -> str:
    eta = f"(b_j_1 + b_k_1 + (b_time + b_j_2) * mo{w} + {arm} * b_sep[{w + 1}])"
    return "[" + ", ".join(p_sql(eta, str(y)) for y in range(1, 6)) + "]"


PARTS["sim_p"] = (
    "select outcome, draw, jj, kk, "
    + ", ".join(f"{vec(a, w)} as p_{a}_{w}" for a in (0, 1) for w in (2, 4))
    + " from sim"
)
oracle(
    "counterfactual_probs",
    "select outcome, draw, "
    + ", ".join(
        f"{r(f'avg(p_{a}_{w}[{y}])')} as p_{a}_{w}_{y}"
        for a in (0, 1) for w in (2, 4) for y in range(1, 6)
    )
    + " from sim_p group by outcome, draw",
)


def moved(arm: int, keep) -> str:
    return " + ".join(
        f"p_{arm}_2[{i}] * p_{arm}_4[{j}]" for i in range(1, 6) for j in range(1, 6) if keep(i, j)
    )


PARTS["sim_c"] = (
    "select outcome, draw, "
    + ", ".join(
        f"{moved(a, k)} as {n}_{a}"
        for a in (0, 1)
        for n, k in (("higher", lambda i, j: j > i), ("same", lambda i, j: j == i),
                     ("lower", lambda i, j: j < i))
    )
    + " from sim_p"
)
oracle(
    "counterfactual_change",
    "select outcome, draw, "
    + ", ".join(f"{r(f'avg({n}_{a})')} as {n}_{a}" for a in (0, 1) for n in ("higher", "same", "lower"))
    + " from sim_c group by outcome, draw",
)
PARTS["sim_d"] = """
select outcome, draw, avg(higher) as higher, avg(same) as same, avg(lower) as lower,
 avg(higher - lower) as improved from (
 select outcome, draw, higher_1 * (same_0 + lower_0) + same_1 * lower_0 as higher,
  higher_1 * higher_0 + same_1 * same_0 + lower_1 * lower_0 as same,
  lower_1 * (same_0 + higher_0) + same_1 * higher_0 as lower from sim_c) group by outcome, draw"""
oracle("counterfactual_by_draw", f"select {OD}, {rs('higher same lower improved')} from sim_d")
oracle(
    "counterfactual_summary",
    """select outcome, counterfactual, ceil(q[1] * 1000)::double as d_est, ceil(q[2] * 1000)::double as lower,
ceil(q[3] * 1000)::double as upper from (
 select outcome, counterfactual, quantile_cont(estimate, [0.5, 0.025, 0.975]) as q from (
  unpivot sim_d on higher, same, lower, improved into name counterfactual value estimate)
 group by outcome, counterfactual)""",
)

# -- diagnostics -------------------------------------------------------------------------

N_ITER = f"(select count(*) // {S.N_CHAINS} from embeddings)"


def rhat_sql(source: str, keys: str) -> str:
    return f"""
select {keys}, sqrt((avg(v) * (avg(n) - 1) / avg(n) + coalesce(var_samp(m), 0)) / avg(v)) as rhat from (
 select {keys}, chain * 2 + (iteration > {N_ITER} // 2)::int as half, count(*) as n,
  avg(estimate) as m, var_samp(estimate) as v from {source} group by all) group by {keys}"""


oracle(
    "split_rhat",
    f"select outcome, parameter, i1, {rs('rhat')} from ({rhat_sql('st_long', 'outcome, parameter, i1')})",
)


def ess_sql(source: str, keys: str) -> str:
    """Effective size from all lag products of the centred chains."""
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ka = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
select {keys}, {N_ITER} * {S.N_CHAINS} / greatest(-1 + 2 * coalesce(sum(case when ok then mono end), 0)
  + greatest(coalesce(min_by(even, k) filter (where not ok), 0), 0),
  1 / log10({N_ITER} * {S.N_CHAINS})) as n_eff from (
 select *, min(pair > 0) over w as ok, min(pair) over w as mono from (
  select {keys}, k, sum(rho) as pair, max(case when lag % 2 = 0 then rho end) as even from (
   select {keys}, lag, lag // 2 as k, case when lag = 0 then 1 else
    1 - (acov0 * {N_ITER} / ({N_ITER} - 1) - acov) / (acov0 + between_v) end as rho from (
    select *, max(case when lag = 0 then acov end) over (partition by {keys}) as acov0 from (
     select {keys}, lag, avg(acov) as acov, max(between_v) as between_v from (
      select {ka}, a.chain, b.iteration - a.iteration as lag, sum(a.d * b.d) / {N_ITER} as acov,
       any_value(a.between_v) as between_v from centred a join centred b
      on {on} and a.chain = b.chain and b.iteration >= a.iteration group by all) group by all)))
  group by {keys}, k having count(*) = 2)
 window w as (partition by {keys} order by k rows unbounded preceding)) group by {keys}""".replace(
        "centred", f"{source}_c"
    )


def centred(source: str, keys: str, value: str) -> str:
    on = " and ".join(f"s.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    onb = on.replace("m.", "t.")
    return f"""
select {', '.join('s.' + k.strip() for k in keys.split(','))}, s.chain, s.iteration,
 s.{value} - m.mean as d, t.between_v from {source} s
join (select {keys}, chain, avg({value}) as mean from {source} group by all) m on {on} and s.chain = m.chain
join (select {keys}, coalesce(var_samp(mean), 0) as between_v from (
 select {keys}, chain, avg({value}) as mean from {source} group by all) group by {keys}) t on {onb}"""


PARTS["em_long"] = """
select * from st_long where parameter in ('c', 'z_time', 'b_sep', 'sigma_j')"""
OPI = "outcome, parameter, i1"
PARTS["em_long_c"] = centred("em_long", OPI, "estimate")
PARTS["em_ess"] = ess_sql("em_long", OPI)
oracle("effective_size", f"select {OPI}, {rs('n_eff', 4)} from em_ess")
oracle(
    "parameter_summary",
    f"""select s.outcome, s.parameter, s.i1, {rs('mean sd', 4)}, {r('q[1]', 4)} as q2_5, {r('q[2]', 4)} as q25,
{r('q[3]', 4)} as q50, {r('q[4]', 4)} as q75, {r('q[5]', 4)} as q97_5, {rs('n_eff rhat', 4)} from (
select {OPI}, avg(estimate) as mean, stddev_samp(estimate) as sd,
 quantile_cont(estimate, [0.025, 0.25, 0.5, 0.75, 0.975]) as q from em_long group by all) s
join em_ess e on e.outcome = s.outcome and e.parameter = s.parameter and e.i1 = s.i1
join ({rhat_sql('em_long', OPI)}) h on h.outcome = s.outcome and h.parameter = s.parameter and h.i1 = s.i1""",
)
PARTS["i_llk_c"] = centred("i_llk", CID, "sep_llk")
oracle(
    "relative_efficiency",
    f"""select {CID}, {r(f'n_eff / ({N_ITER} * {S.N_CHAINS})')} as r_eff from ({ess_sql('i_llk', CID)})""",
)
# smoothed tails: ratios of a cell by rank, the profile over a grid of theta, and the expected order statistics
PARTS["ps_lik"] = "select *, exp(sep_llk) as lik from i_llk"
PARTS["ps_lik_c"] = centred("ps_lik", CID, "lik")
PARTS["ps_size"] = f"""
select *, ceil(least(0.2 * s, 3 * sqrt(s / r_eff)))::int as m from (
select {CID}, n_eff / ({N_ITER} * {S.N_CHAINS}) as r_eff, {N_ITER} * {S.N_CHAINS} as s from ({ess_sql('ps_lik', CID)}))"""
PARTS["ps_ratio"] = f"""
select *, max(lr) over (partition by {CID}) as top from (
select {CID}, -sep_llk as lr, row_number() over (partition by {CID} order by -sep_llk desc) as rn, s, m from i_llk join ps_size using ({CID}))"""
PARTS["ps_tail"] = f"""
select {CID}, lr, top, m, m + 1 - rn as i, exp(lr - top) - base as x, base from ps_ratio join (
select {CID}, exp(lr - top) as base from ps_ratio where rn = m + 1) using ({CID}) where rn <= m"""
PARTS["ps_theta"] = f"""
select *, 1 / xmax + (1 - sqrt(g / (j - 0.5))) / (3 * q) as theta from (
select *, unnest(range(1, g + 1)) as j from (
select {CID}, max(x) as xmax, max(m) as m, max(case when i = floor(m / 4.0 + 0.5) then x end) as q, 30 + floor(sqrt(max(m)))::int as g
from ps_tail group by {CID} having max(m) >= 5 and min(lr) < max(lr)) where q > 0)"""
PARTS["ps_best"] = f"""
select {CID}, sum(theta * w) / sum(w) as best from (
select *, exp(l - max(l) over (partition by {CID})) as w from (
select {CID}, j, theta, max(t.m) * (ln(-theta / avg(ln(1 - theta * x))) - avg(ln(1 - theta * x)) - 1) as l
from ps_theta t join ps_tail using ({CID}) group by {CID}, j, theta)) group by {CID}"""
PARTS["ps_shape"] = f"""
select {CID}, -k / best as sigma, (k * m + 5) / (m + 10) as k from (
select {CID}, best, max(m) as m, avg(ln(1 - best * x)) as k from ps_tail join ps_best using ({CID}) group by {CID}, best)"""
PARTS["ps_smooth"] = f"""
select {CID}, lr, coalesce(least(ln(base + sigma * (exp(-k * ln(1 - (i - 0.5) / m)) - 1) / k), 0) + top, lr) as lw
from ps_tail left join ps_shape using ({CID})"""
PARTS["ps_all"] = f"""
select {CID}, lr, lr as lw from ps_ratio where rn > m union all select {CID}, lr, lw from ps_smooth"""
PARTS["ps_elpd"] = f"""
select {CID}, ln(sum(exp(lw - lr))) - max(high) - ln(sum(exp(lw - high))) as elpd_loo from (
select *, max(lw) over (partition by {CID}) as high from ps_all) group by {CID}"""
oracle(
    "psis_loo",
    f"""select {CID}, {r('elpd_loo')} as elpd_loo, {r("coalesce(k, 'infinity'::double)")} as pareto_k
from ps_elpd left join ps_shape using ({CID})""",
)
PARTS["sampler"] = f"""
select (user_id % {S.N_CHAINS} + 1)::int as chain, event_id, (event_type = 'click')::int as divergent,
 (user_id % 11)::int as treedepth, value as energy from events"""
oracle(
    "sampler_health",
    f"""select chain, count(*) as n, sum(divergent)::bigint as divergent,
count(*) filter (where treedepth >= 10) as saturated,
{r('sum(jump * jump) / (count(energy) * var_pop(energy))')} as e_bfmi from (
select *, energy - lag(energy) over (partition by chain order by event_id) as jump from sampler)
group by chain""",
)

# -- model input and checks --------------------------------------------------------------

oracle(
    "design_sizes",
    """select outcome, max(ii) as n, max(response) as m, max(jj) as j, max(kk) as k
from p_resp group by outcome""",
)
oracle("design_schools", "select outcome, ii, jj, kk, (year - 8)::int as x_time, response as y from p_resp")
oracle("design_school_levels", "select distinct outcome, kk, school_involvement as x_sep from p_resp")
oracle(
    "design_students",
    "select outcome, ii, jj, kk, x_time, y, item, sep, (sep is null)::int as mis from st_resp",
)
PARTS["st_units"] = """
select distinct r.outcome, r.jj, coalesce(t.sep, -1)::int as sep_obs, (t.sep is null)::int as mis
from p_resp r left join p_treated t on t.id = r.id"""
oracle("design_student_units", "select outcome, jj, sep_obs, mis from st_units")
oracle(
    "design_student_shapes",
    f"""select distinct r.outcome, r.jj, coalesce(m.d_sep, -1)::int as sep_obs, (m.d_sep is null)::int as mis,
case when m.d_sep is null then {r('m.sep_alpha', 4)} end as sep_alpha,
case when m.d_sep is null then {r('m.sep_beta', 4)} end as sep_beta
from p_resp r left join i_merged m on m.id = r.id""",
)
oracle(
    "design_student_sizes",
    """select a.outcome, n_mis, n_obs, j_mis, j_obs from (select outcome,
 sum((sep is null)::int)::bigint as n_mis, sum((sep is not null)::int)::bigint as n_obs
 from st_resp group by outcome) a join (select outcome, sum(mis)::bigint as j_mis,
 sum(1 - mis)::bigint as j_obs from st_units group by outcome) b on a.outcome = b.outcome""",
)


def rules(source: str, bad: dict[str, str]) -> str:
    return " union all ".join(
        f"select '{n}' as rule, count(*) filter (where {c}) as violations from {source}"
        for n, c in bad.items()
    )


oracle(
    "check_design",
    rules(
        "p_long",
        {
            "y_in_range": "response not between 1 and 5",
            "year_in_range": "year not between 8 and 12",
            "involvement_in_range": "school_involvement not between 1 and 3",
            "item_in_range": "item not between 1 and 5",
            "id_known": "id is null",
            "y_known": "response is null",
        },
    )
    + """ union all select 'one_school_per_id', count(*) filter (where n > 1) from (
select id, count(distinct school) as n from p_long group by id)
union all select 'one_level_per_school', count(*) filter (where n > 1) from (
select school, count(distinct school_involvement) as n from p_long group by school)
union all select 'key_is_unique', count(*) filter (where n > 1) from (
select id, year, outcome, item, count(*) as n from p_long group by all)""",
)
oracle(
    "check_imputation",
    rules(
        "i_design",
        {
            "y11_in_range": "y11 not between -1 and 1",
            "y12_in_range": "y12 not between -1 and 1",
            "m11_is_flag": "m11 not in (0, 1)",
            "m12_is_flag": "m12 not in (0, 1)",
            "y11_c_in_range": "y11_c not between -1 and 1",
            "y12_c_in_range": "y12_c not between -1 and 1",
            "m11_matches_y11": "(m11 = 1) <> (y11 = -1)",
            "m12_matches_y12": "(m12 = 1) <> (y12 = -1)",
        },
    ),
)
oracle(
    "check_dropout",
    rules(
        "d_panel",
        {
            "ii_in_range": "ii not between 1 and 5",
            "year_in_range": "year not between 8 and 12",
            "y_is_flag": "y not in (0, 1)",
            "jj_positive": "jj < 1",
            "kk_positive": "kk < 1",
        },
    ),
)
oracle(
    "check_draws",
    rules(
        "st",
        {
            "thresholds_ascend": "c[1] > c[2] or c[2] > c[3] or c[3] > c[4]",
            "simplex_sums_to_one": "abs(z_time[1] + z_time[2] + z_time[3] + z_time[4] - 1) > 1e-9",
            "simplex_not_negative": "list_min(z_time) < 0",
            "scales_positive": "list_min(sigma_j) <= 0 or sigma_k <= 0",
            "cholesky_rows_unit_norm": "abs(rho * rho + (1 - rho * rho) - 1) > 1e-9",
            "cholesky_first_row": "false",
        },
    ),
)
oracle(
    "check_school_draws",
    rules(
        "sc",
        {
            "thresholds_ascend": "c[1] > c[2] or c[2] > c[3] or c[3] > c[4]",
            "simplex_sums_to_one": "abs(z_time[1] + z_time[2] + z_time[3] + z_time[4] - 1) > 1e-9",
            "simplex_not_negative": "list_min(z_time) < 0",
            "scales_positive": "list_min(sigma_j) <= 0 or list_min(sigma_k) <= 0",
            "cholesky_rows_unit_norm": "rho not between -1 and 1 or rho_k not between -1 and 1",
            "cholesky_first_row": "false",
        },
    ),
)
VECTOR_RULES = {
    "check_impute_draws": ["b11_sep_has_3", "b12_sep_has_3", "sigma11_has_3", "sigma12_has_3", f"b11_k_has_{S.IMPUTE_SCHOOLS}",
                           f"b12_k_has_{S.IMPUTE_SCHOOLS}", "sigma11_positive", "sigma12_positive", "entries_known"],
    "check_dropout_draws": ["b_x_has_8", "b_year_has_4", f"b_j_has_{S.DROPOUT_STUDENTS}", f"b_k_has_{S.DROPOUT_SCHOOLS}", "entries_known"],
}
for q, names in VECTOR_RULES.items():
    # the vectors are cut from complete ones: a rule breaks where an entry of the source is null
    oracle(q, rules("(select list_bool_or([x is null for x in e0]) as holes from v_draws)", {n: "holes" for n in names}))
oracle(
    "check_student_input",
    rules(
        "st_resp",
        {
            "y_in_range": "y not between 1 and 5", "x_time_in_range": "x_time not between 0 and 4",
            "jj_positive": "jj < 1", "kk_positive": "kk < 1", "mis_matches_sep": "false",
        },
    )
    + " union all "
    + rules(
        "(select distinct r.outcome, r.jj, m.d_sep, m.sep_alpha, m.sep_beta from p_resp r left join i_merged m on m.id = r.id)",
        {
            "sep_obs_in_range": "d_sep not between 0 and 1", "mis_matches_sep_obs": "false",
            "shapes_positive": "d_sep is null and (sep_alpha <= 0 or sep_beta <= 0)",
        },
    ),
)
oracle(
    "check_threshold_rows",
    """select 'thresholds_ascend' as rule, count(*) filter (where c < before) as violations from (
select *, lag(c) over (partition by outcome, draw order by y) as before from st_y)""",
)
oracle(
    "check_imputed_treatment",
    """select 'sep_in_unit_interval' as rule, count(*) filter (where s not between 0 and 1) as violations
from i_sep""",
)
