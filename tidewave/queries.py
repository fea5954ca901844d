"""Registered queries: each takes (session, data folder) and runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions.scalar import either, hash_uniform, inv_logit, plain_uniform, mo, rnd
from tidewave.operators import draws as D
from tidewave.operators import blocks, index, panel, reshape, sizing, stats
from tidewave.plans import (
    corr,
    counterfactual,
    design,
    diag,
    dropout,
    effects,
    fit,
    impute,
    kernels,
    loo,
    ordinal,
    predict,
    quality,
)
from tidewave.sources import io
from tidewave.sources import survey_tables as S
from tidewave.sources.schema import (
    ITEM_COUNTS,
    ITEMS,
    OUTCOME_LABELS,
    OUTCOMES,
    PANEL_LONG,
    PANEL_RAW,
    PANEL_WIDE,
    REPORT_ORDER,
    WAVES,
)

QUERIES: dict = {}
SIM_STUDENTS, SIM_SCHOOLS, SIM_WAVES = 1000, 10, (2, 4)
SIM_SEED = 20_240_917


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double for the report."""
    return df.withColumns({c: rnd(D.column(c), digits) for c, t in df.dtypes if t == "double"})


# -- sources and sinks -------------------------------------------------------------------


@query
def io_panel_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Wide panel written as CSV with a header and read back with its declared schema."""
    path = io.new_folder(spark, "panel-csv")
    io.write_csv(S.panel_raw(spark, sf), path)
    return io.read_panel(spark, path, PANEL_RAW, "csv")


@query
def io_panel_parquet(spark, sf):
    path = io.new_folder(spark, "panel")
    io.write_table(S.panel_raw(spark, sf), path)
    return io.read_panel(spark, path, PANEL_RAW)


@query
def io_draws_partitioned(spark, sf):
    """Draw tables of all outcomes in one write; one outcome read back from its folder."""
    path = io.new_folder(spark, "draws")
    io.write_draws(D.ps_y(S.student_draws(spark, sf), True), path)
    back = io.read_draws(spark, path, "em")
    return rounded(back.select("outcome", "draw", "y", "c", "b_time"))


def _draw_tables(spark, sf):
    """All draw tables of both models, by name."""
    st, sc = S.student_effects(spark, sf), _school_effects(spark, sf)
    return {
        "students_y": D.ps_y(st, True), "students_x": D.ps_x_students(st),
        "students_jj": D.ps_unit(st, ["b_j_1", "b_j_2", "x_sep"], "jj"), "students_kk": D.ps_unit(st, ["b_k_1"], "kk"),
        "students_p": D.ps_p(S.wide_p(spark, sf), True),
        "schools_y": D.ps_y(sc, False), "schools_x_time": D.ps_x_time_schools(sc), "schools_x_sep": D.ps_x_sep(sc),
        "schools_jj": D.ps_unit(sc, ["b_j_1", "b_j_2"], "jj"), "schools_kk": D.ps_unit(sc, ["b_k_1", "b_k_2"], "kk"),
        "schools_p": _schools_p(spark, sf),
    }


@query
def io_draws_all(spark, sf):
    """Every draw table of both models in a folder by outcome; rows and draws as read back."""
    read = {}
    for name, rows in _draw_tables(spark, sf).items():
        path = io.new_folder(spark, f"draws-{name}")
        io.write_draws(rows, path)
        read[name] = io.read_draws(spark, path).groupBy("outcome").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("draw").alias("draws"))
    return reshape.tag_and_stack(read, "source").select("source", "outcome", "n", "draws")


@query
def io_panel_derived(spark, sf):
    """The panel with fitted treatment: written wide, read, made long, written, read."""
    wide, long = io.new_folder(spark, "panel-wide"), io.new_folder(spark, "panel-long")
    merged = _merged(spark, sf, lambda d: fit.beta_moments(d, CELL_ID, "sep_draw"))
    io.write_table(merged.select(*PANEL_WIDE.fieldNames()), wide)
    rows = reshape.items_to_long(io.read_panel(spark, wide, PANEL_WIDE), ITEMS)
    io.write_table(rows.select(*PANEL_LONG.fieldNames()), long)
    return rounded(io.read_panel(spark, long, PANEL_LONG), 4)


@query
def io_report_csv(spark, sf):
    """Correlation report written as one CSV file and read back as text."""
    path = io.new_folder(spark, "report")
    io.write_csv(corr_report(spark, sf), path, one_file=True)
    schema = ", ".join(f"{c} string" for c in ["x_outcome", *REPORT_ORDER])
    return spark.read.schema(schema).option("header", True).csv(path)


# -- panel and reshape -------------------------------------------------------------------


@query
def panel_long(spark, sf):
    return S.panel_long(spark, sf)


@query
def panel_wide(spark, sf):
    return S.panel_raw(spark, sf)


@query
def panel_dense(spark, sf):
    return S.panel_dense(spark, sf)


@query
def items_to_long(spark, sf):
    return reshape.items_to_long(S.panel_raw(spark, sf), ITEMS)


@query
def to_wide_composite(spark, sf):
    """Probabilities with one column per wave and category."""
    wide = S.student_draws(spark, sf)
    grid = ordinal.student_grid(wide, 5)
    rows = ordinal.unfold(ordinal.predict_grid(wide, grid)).where("x_time in (2, 4)")
    rows = rows.withColumn("year", F.col("x_time") + 8)
    levels = [f"{t}_{y}" for t in (10, 12) for y in range(1, 6)]
    ids = ["outcome", "draw", "x_sep"]
    return rounded(reshape.to_wide(rows, ids, ["year", "y"], levels, "p", "p_"))


@query
def complete_waves(spark, sf):
    rows = S.treatment_rows(spark, sf).select("id", "year", "sep")
    return reshape.complete(rows, ["id"], year=WAVES)


@query
def nesting_schools(spark, sf):
    """Every draw's school scale with every simulated school."""
    wide = S.student_draws(spark, sf).select("outcome", "draw", "sigma_k")
    return rounded(reshape.seq_table(wide, "kk", 1, 10))


@query
def crossing_arms(spark, sf):
    """Students crossed with waves and arms."""
    units = impute.treatment(S.treatment_rows(spark, sf)).select("id", "sep")
    return reshape.crossing(units, x_time=[2, 4], x_sep=[0, 1])


@query
def expand_grid(spark, sf):
    """Full student x wave grid with the all-missing flag and the number of answers."""
    grid = dropout.missing_grid(S.panel_raw(spark, sf))
    answered = sum((F.col(c).isNotNull().cast("int") for c in ITEMS), F.lit(0))
    return grid.select("id", "school", "year", "missing", answered.alias("answered"))


@query
def select_reorder(spark, sf):
    return reshape.select_like(S.panel_raw(spark, sf), ["id", "year"], ["school"], ["sep"])


@query
def map_item_columns(spark, sf):
    """Reverse-score all item columns with one expression."""
    items = S.panel_raw(spark, sf).select("id", "year", *ITEMS)
    return reshape.map_columns(
        items.withColumn("year", F.col("year").cast("bigint")), lambda c: 6 - F.col(c), ["int"]
    )


@query
def recode_outcomes(spark, sf):
    """Answers per outcome with label and level."""
    counts = S.panel_long(spark, sf).groupBy("outcome").agg(F.count("response").alias("n"))
    return reshape.recode(counts, "outcome", OUTCOME_LABELS, "name")


@query
def stack_models(spark, sf):
    """Threshold tables of both models tagged and stacked; schools have no time effect."""
    tables = {
        "students": D.ps_y(S.student_draws(spark, sf), True),
        "schools": D.ps_y(S.school_draws(spark, sf), False),
    }
    return rounded(reshape.tag_and_stack(tables, "model"))


@query
def stack_outcomes(spark, sf):
    """Per-outcome tables tagged and stacked, summarised."""
    tables = {
        o: D.ps_y(S.student_draws(spark, sf, [o]), False).drop("outcome") for o in OUTCOMES
    }
    both = reshape.tag_and_stack(tables, "outcome")
    return rounded(stats.mean_by(both, ["outcome", "y"], "c", "c_mean"))


# -- index and windows -------------------------------------------------------------------


def _responses(spark, sf, limit=None):
    bound = S.rows_of(spark, sf, "lineitem")
    return design.indexed_responses(S.panel_long(spark, sf), bound=bound, limit=limit)


INDEXED = ["id", "year", "outcome", "item", "ii", "jj", "kk"]


@query
def row_and_dense_index(spark, sf):
    return _responses(spark, sf).select(*INDEXED)


@query
def row_and_dense_index_ranged(spark, sf):
    """The same indices by range placement, the way used for groups beyond one task."""
    return _responses(spark, sf, limit=0).select(*INDEXED)


@query
def student_row_number(spark, sf):
    rows = S.treatment_rows(spark, sf).select("id", "year", "sep")
    return index.row_index(rows, ["id"], ["year"], "ii", bound=len(WAVES))


@query
def lags_within_student(spark, sf):
    rows = S.treatment_rows(spark, sf).select("id", "year", "sep")
    return panel.lags(rows, "id", "year", ["sep"], 4)


@query
def previous_wave(spark, sf):
    rows = S.treatment_rows(spark, sf).select("id", "year", "sep")
    return panel.previous_wave(rows, "id", "year", ["sep"])


@query
def trim_leading(spark, sf):
    grid = dropout.missing_grid(S.panel_raw(spark, sf)).select("id", "year", "missing")
    return panel.trim_leading(grid, "id", "year", "missing")


@query
def carry_forward(spark, sf):
    """First item of each outcome carried forward over unanswered waves."""
    items = [f"{o}_1" for o in ITEM_COUNTS]
    grid = dropout.missing_grid(S.panel_raw(spark, sf)).select("id", "year", *items)
    return panel.locf(grid, "id", "year", items, empty=0)


# -- summaries ---------------------------------------------------------------------------


def _long_draws(spark, sf):
    return D.to_long(S.student_draws(spark, sf), ["outcome", *D.KEYS])


def _draw_rows(spark, sf):
    return S.rows_of(spark, sf, "embeddings")


@query
def interval_by_parameter(spark, sf):
    out = stats.interval_by(
        _long_draws(spark, sf), ["outcome", "parameter", "i1"], "estimate",
        bound=_draw_rows(spark, sf),
    )
    return rounded(out)


@query
def interval_by_rank(spark, sf):
    """The same intervals by distributed rank selection."""
    keys = ["outcome", "parameter", "i1"]
    return rounded(stats.interval_by(_long_draws(spark, sf), keys, "estimate", limit=0))


@query
def mean_sd_by_school(spark, sf):
    rows = S.panel_long(spark, sf)
    return rounded(stats.m_sd(rows, ["school", "outcome", "year"], "response"))


@query
def strict_mean(spark, sf):
    """Mean response per student and wave, null if any answer is missing."""
    rows = S.panel_long(spark, sf)
    out = rows.groupBy("id", "year", "outcome").agg(stats.strict_mean("response").alias("m"))
    return rounded(out)


@query
def scale_scores_wide(spark, sf):
    scored = panel.scale_scores(S.panel_dense(spark, sf), ITEM_COUNTS)
    return rounded(scored.select("id", "year", *ITEM_COUNTS))


@query
def zscore_scales(spark, sf):
    scored = panel.scale_scores(S.panel_dense(spark, sf), ITEM_COUNTS)
    return rounded(stats.zscore(scored.select("id", "year", *ITEM_COUNTS), list(ITEM_COUNTS)))


@query
def center_response(spark, sf):
    rows = S.treatment_rows(spark, sf).select("id", "year", "sep")
    return rounded(stats.center(rows, ["sep"]))


@query
def log_sum_exp(spark, sf):
    """Log of the mean of exp(x) per parameter."""
    keys = ["outcome", "parameter", "i1"]
    long = _long_draws(spark, sf).withColumn("x", F.col("estimate") * 100)
    return rounded(stats.logsumexp_by(long, keys, "x"))


# -- correlations ------------------------------------------------------------------------


def _wide_scores(spark, sf):
    return corr.wide_scores(S.panel_long(spark, sf), OUTCOMES)


@query
def scale_scores_long(spark, sf):
    return rounded(corr.scale_scores(S.panel_long(spark, sf)))


@query
def corr_within(spark, sf):
    return rounded(corr.within(_wide_scores(spark, sf), OUTCOMES))


@query
def corr_between(spark, sf):
    return rounded(corr.between(_wide_scores(spark, sf), OUTCOMES))


@query
def corr_within_by_index(spark, sf):
    """Within-wave correlations with the per-outcome indices as the student key."""
    wide = corr.wide_scores(_responses(spark, sf), OUTCOMES, ["jj", "kk", "year"])
    return rounded(corr.within(wide, OUTCOMES))


@query
def corr_matrix(spark, sf):
    return rounded(corr.matrix(corr.within(_wide_scores(spark, sf), OUTCOMES), OUTCOMES))


@query
def corr_report(spark, sf):
    m = corr.matrix(corr.within(_wide_scores(spark, sf), OUTCOMES), REPORT_ORDER)
    return corr.format_matrix(m, REPORT_ORDER)


@query
def m_sd_by_wave(spark, sf):
    return rounded(corr.m_sd_by_wave(S.panel_long(spark, sf)))


@query
def m_sd_report(spark, sf):
    return corr.m_sd_table(corr.m_sd_by_wave(S.panel_long(spark, sf)), REPORT_ORDER)


# -- draw tables -------------------------------------------------------------------------


@query
def draws_selected(spark, sf):
    return rounded(D.select_params(S.school_draws(spark, sf), ["c", "b_sep_time"], ["outcome", "draw"]))


@query
def draws_numbered(spark, sf):
    """Draw number from chain and iteration."""
    rows = S.vectors(spark, sf).select("chain", "iteration", F.col("e")[0].alias("b"))
    n_iter = -(-_draw_rows(spark, sf) // S.N_CHAINS)
    return rounded(D.add_draw_id(rows, n_iter))


@query
def draws_long(spark, sf):
    return rounded(_long_draws(spark, sf).where("parameter in ('c', 'z_time', 'b_sep', 'sigma_j')"))


@query
def draws_spread(spark, sf):
    long = D.to_long(S.dropout_b_x(spark, sf))
    return rounded(D.spread(long, ["b_x"], "x"))


@query
def draws_array(spark, sf):
    """Simplex as a vector per draw, shown as its entries."""
    long = D.gather(S.student_draws(spark, sf), ["z_time"], ["i"], ["outcome", "draw"])
    vec = D.to_array(long, ["outcome", "draw"], "i", "z_time", "z")
    return rounded(vec.select("outcome", "draw", *[F.col("z")[i].alias(f"z{i + 1}") for i in range(4)]))


@query
def ps_y_students(spark, sf):
    return rounded(D.ps_y(S.student_draws(spark, sf), True))


@query
def ps_y_schools(spark, sf):
    return rounded(D.ps_y(S.school_draws(spark, sf), False))


@query
def ps_x_students(spark, sf):
    return rounded(D.ps_x_students(S.student_draws(spark, sf)))


@query
def ps_x_time_schools(spark, sf):
    return rounded(D.ps_x_time_schools(S.school_draws(spark, sf)))


@query
def ps_x_sep_schools(spark, sf):
    return rounded(D.ps_x_sep(S.school_draws(spark, sf)))


@query
def ps_jj_students(spark, sf):
    """Student effects and treatment; also the check of effects from standardised ones."""
    return rounded(D.ps_unit(S.student_effects(spark, sf), ["b_j_1", "b_j_2", "x_sep"], "jj"))


@query
def ps_kk_students(spark, sf):
    return rounded(D.ps_unit(S.student_effects(spark, sf), ["b_k_1"], "kk"))


def _school_effects(spark, sf):
    levels = [k % 3 + 1 for k in range(S.SCHOOL_SLOTS)]
    return ordinal.add_school_effects(S.school_draws(spark, sf), levels, S.SCHOOL_MODEL_STUDENTS)


@query
def ps_kk_schools(spark, sf):
    """School effects with the effect of involvement added."""
    return rounded(D.ps_unit(_school_effects(spark, sf), ["b_k_1", "b_k_2"], "kk"))


@query
def ps_jj_schools(spark, sf):
    return rounded(D.ps_unit(_school_effects(spark, sf), ["b_j_1", "b_j_2"], "jj"))


@query
def ps_p_students(spark, sf):
    return rounded(D.ps_p(S.wide_p(spark, sf), True))


def _schools_p(spark, sf):
    wide = S.school_draws(spark, sf)
    return ordinal.unfold(ordinal.predict_grid(wide, ordinal.school_grid(wide, 5)))


@query
def ps_p_schools(spark, sf):
    """Predicted probabilities of the school model; involvement counts from 1, waves from 0."""
    return rounded(_schools_p(spark, sf))


def _chol_rows(spark, sf):
    rows = D.gather(S.student_draws(spark, sf), ["Lcorr_j"], ["i", "k"], ["outcome", "draw"])
    return rows.withColumnRenamed("Lcorr_j", "v")


@query
def corr_from_cholesky(spark, sf):
    return rounded(D.corr_from_chol(_chol_rows(spark, sf), ["outcome", "draw"]))


@query
def covariance(spark, sf):
    keys = ["outcome", "draw"]
    sigma = D.gather(S.student_draws(spark, sf), ["sigma_j"], ["i"], keys)
    r = D.corr_from_chol(_chol_rows(spark, sf), keys)
    return rounded(D.covariance(r, sigma.withColumnRenamed("sigma_j", "sigma"), keys))


@query
def reference_level(spark, sf):
    keys = ["outcome", "draw"]
    free = D.gather(S.school_draws(spark, sf), ["b_sep_free"], ["x_sep"], keys)
    return rounded(D.add_reference_level(free, keys, "x_sep", "b_sep_free"))


@query
def monotonic_running(spark, sf):
    """Monotonic effect at all waves by a running sum."""
    ps_x = D.ps_x_students(S.student_draws(spark, sf))
    return rounded(D.mo_table(ps_x, ["outcome", "draw"], 4).select("outcome", "draw", "x_time", "mo"))


@query
def monotonic_vector(spark, sf):
    """Monotonic effect from the simplex as a list column."""
    keys = ["outcome", "draw"]
    z = D.array_of(S.student_draws(spark, sf), "z_time").alias("z")
    vec = reshape.crossing(S.student_draws(spark, sf).select(*keys, z), x_time=[0, 1, 2, 3, 4])
    return rounded(vec.select(*keys, "x_time", mo("z", "x_time").alias("mo")))


# -- ordinal models ----------------------------------------------------------------------


@query
def predict_grid_students(spark, sf):
    wide = S.student_draws(spark, sf)
    grid = ordinal.predict_grid(wide, ordinal.student_grid(wide, 5))
    return rounded(ordinal.unfold(grid))


@query
def predict_grid_schools(spark, sf):
    wide = S.school_draws(spark, sf)
    grid = ordinal.predict_grid(wide, ordinal.school_grid(wide, 5))
    return rounded(ordinal.unfold(grid))


@query
def category_probability_rows(spark, sf):
    """Category probabilities from threshold rows, the next threshold by window."""
    rows = D.ps_y(S.student_draws(spark, sf), True).withColumn("eta", F.col("b_time") * 2)
    out = ordinal.prob_rows(rows, ["outcome", "draw"], 5)
    return rounded(out.select("outcome", "draw", "y", "p"))


def _student_responses(spark, sf, outcomes=None):
    rows = _responses(spark, sf)
    if outcomes:
        rows = rows.where(F.col("outcome").isin(outcomes))
    treated = impute.treatment(S.treatment_rows(spark, sf))
    out = design.students(rows, treated)
    return out.withColumns(
        {
            "jj_slot": F.pmod(F.col("jj") - 1, F.lit(S.STUDENT_SLOTS)) + 1,
            "kk_slot": F.pmod(F.col("kk") - 1, F.lit(S.SCHOOL_SLOTS)) + 1,
        }
    )


CELL = ["outcome", "jj_slot", "kk_slot", "x_time", "y", "sep"]


# What the predictors of a response depend on.
DESIGN = ["outcome", "jj_slot", "kk_slot", "x_time", "sep"]


def _scored_cells(spark, sf, n_cat=None, **limits):
    """Weighted designs of the responses x draws of their outcome, with predictors; with ``n_cat`` also their counts by category."""
    cells = ordinal.response_cells(_student_responses(spark, sf), DESIGN, n_cat)
    vec = ordinal.draw_vectors(
        S.student_effects(spark, sf), 5, S.STUDENT_SLOTS, S.SCHOOL_SLOTS
    ).withColumnRenamed("outcome", "d_outcome")
    if n_cat:
        vec = ordinal.with_gaps(vec, n_cat)
    n = _draw_rows(spark, sf)
    rows = sizing.with_every_draw(cells, vec, n, DESIGN, on=("outcome", "d_outcome"), **limits)
    rows = ordinal.linear_predictor(rows)
    return ordinal.merge_sep(rows, F.col("x_sep")[F.col("jj_slot") - 1])


@query
def response_cells(spark, sf):
    return ordinal.response_cells(_student_responses(spark, sf), CELL)


def _mean_predictors(rows):
    w = F.col("n")
    out = rows.groupBy("outcome", "draw").agg(
        F.sum(w).alias("n"),
        (F.sum(w * F.col("eta_0")) / F.sum(w)).alias("eta_0"),
        (F.sum(w * F.col("eta_1")) / F.sum(w)).alias("eta_1"),
        (F.sum(w * F.col("x_sep_merged")) / F.sum(w)).alias("x_sep"),
    )
    return rounded(out)


@query
def linear_predictor_students(spark, sf):
    """Mean linear predictors over all responses per draw and outcome."""
    return _mean_predictors(_scored_cells(spark, sf))


@query
def linear_predictor_students_tiled(spark, sf):
    """The same with cells and draws in tiles, as for draws beyond the broadcast limit."""
    return _mean_predictors(_scored_cells(spark, sf, broadcast_limit=0, units_per_tile=10_000))


def _student_vectors(spark, sf):
    return ordinal.draw_vectors(S.student_effects(spark, sf), 5, S.STUDENT_SLOTS, S.SCHOOL_SLOTS)


def _loglik_students(spark, sf, **limits):
    keys = ["outcome", "jj_slot", "kk_slot", "x_time"]
    cells = ordinal.state_cells(_student_responses(spark, sf), keys, 5)
    parts = blocks.over_draws(
        sizing.spread_out(cells, keys), _student_vectors(spark, sf), kernels.student_loglik,
        "outcome string, draw int, llk double, n bigint", on="outcome", sums=["llk", "n"], by="draw", **limits)
    return rounded(parts.groupBy("outcome", "draw").agg((F.sum("llk") / F.sum("n")).alias("llk")))


@query
def loglik_students(spark, sf):
    """Mean log-likelihood of all responses per draw and outcome."""
    return _loglik_students(spark, sf)


@query
def loglik_students_tiled(spark, sf):
    """The same with both sides in tiles and blocks, as for draws beyond the broadcast limit."""
    return _loglik_students(spark, sf, broadcast_bytes=0, block_draws=512)


@query
def loglik_students_pointwise(spark, sf):
    """The same from each category and participation of each cell under each draw, and sums of all rows."""
    rows = ordinal.loglik(_scored_cells(spark, sf, n_cat=5), 5)
    w = F.sum("n")
    out = rows.groupBy("outcome").agg((F.sum("llk") / w).alias("llk"), w.alias("n"))
    return rounded(out)


@query
def loglik_schools(spark, sf):
    """Mean log-likelihood of all responses under the school model per draw and outcome."""
    rows = design.schools(_responses(spark, sf)).withColumns(
        {
            "jj_slot": F.pmod(F.col("jj") - 1, F.lit(S.SCHOOL_MODEL_STUDENTS)) + 1,
            "kk_slot": F.pmod(F.col("kk") - 1, F.lit(S.SCHOOL_SLOTS)) + 1,
        }
    )
    keys = ["outcome", "jj_slot", "kk_slot", "x_time"]
    cells = ordinal.response_cells(rows, keys, 5)
    vec = ordinal.school_vectors(
        _school_effects(spark, sf), 5, S.SCHOOL_MODEL_STUDENTS, S.SCHOOL_SLOTS
    ).withColumnRenamed("outcome", "d_outcome")
    vec, n = ordinal.with_gaps(vec, 5), _draw_rows(spark, sf)
    scored = sizing.with_every_draw(cells, vec, n, keys, on=("outcome", "d_outcome"))
    scored = ordinal.loglik_known(ordinal.linear_predictor_schools(scored), 5)
    return rounded(scored.groupBy("outcome", "draw").agg((F.sum("llk") / F.sum("n")).alias("llk")))


# -- effects -----------------------------------------------------------------------------


def _means(spark, sf, model):
    if model == "students":
        wide = S.student_draws(spark, sf)
        grid = ordinal.student_grid(wide, 5)
    else:
        wide = S.school_draws(spark, sf)
        grid = ordinal.school_grid(wide, 5)
    return effects.expected_mean_vector(ordinal.predict_grid(wide, grid), 5)


@query
def expected_mean(spark, sf):
    """Expected category from probability rows."""
    return rounded(effects.expected_mean(D.ps_p(S.wide_p(spark, sf), True)))


@query
def mean_interval_students(spark, sf):
    return rounded(
        effects.mean_interval(_means(spark, sf, "students"), effects.STUDENT_ARMS, _draw_rows(spark, sf))
    )


@query
def mean_interval_schools(spark, sf):
    return rounded(
        effects.mean_interval(_means(spark, sf, "schools"), effects.SCHOOL_ARMS, _draw_rows(spark, sf))
    )


@query
def baseline_sd(spark, sf):
    return rounded(effects.baseline_sd(S.panel_long(spark, sf)))


@query
def cohens_d_students(spark, sf):
    sds = effects.baseline_sd(S.panel_long(spark, sf))
    means = _means(spark, sf, "students")
    return rounded(effects.cohens_d(means, sds, {"1": (1, 0)}, _draw_rows(spark, sf)))


@query
def cohens_d_schools(spark, sf):
    sds = effects.baseline_sd(S.panel_long(spark, sf))
    means = _means(spark, sf, "schools")
    arms = {"3": (3, 1), "2": (2, 1)}
    return rounded(effects.cohens_d(means, sds, arms, _draw_rows(spark, sf)))


# -- posterior predictive ----------------------------------------------------------------


def _predictive(spark, sf, responses):
    """Sampled against observed means per outcome, student and wave."""
    keys = ["outcome", "jj", "kk", "x_time", "sep"]
    slots = ["jj_slot", "kk_slot"]
    units = predict.unit_waves(responses.withColumn("sep", F.col("sep").cast("double")), [*keys, *slots])
    # equal designs side by side; those of many students spread over several tasks
    same = [*slots, "x_time", "sep"]
    units = units.repartitionByRange(sizing.slots_of(spark), "outcome", *same, "jj").sortWithinPartitions("outcome", *same)
    counts = blocks.over_draws(
        units, _student_vectors(spark, sf), kernels.predictive_counts(keys, seed=20),
        "outcome string, jj bigint, kk bigint, x_time int, sep double, n_items int, total int, n bigint", on="outcome",
        units_at_once=predict.UNITS_AT_ONCE, design=same)
    return rounded(predict.summary(counts, responses, keys[:-1], "sep"))


@query
def posterior_predictive_summary(spark, sf):
    """Sampled against observed means of all students per outcome and wave."""
    return _predictive(spark, sf, _student_responses(spark, sf))


CASES = [1, 2, 3]


@query
def posterior_predictive_cases(spark, sf):
    """Sampled against observed means of a few chosen students per wave, all outcomes."""
    return _predictive(spark, sf, predict.case_filter(_student_responses(spark, sf), "jj", CASES))


@query
def sample_category_rows(spark, sf):
    """Category drawn from probability rows, one per draw, arm and wave."""
    rows = D.ps_p(S.wide_p(spark, sf), True)
    code = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("outcome"))
    u = plain_uniform(code, "draw", "x_sep", "x_time", seed=21)
    return predict.sample_rows(rows, ["outcome", "draw", "x_sep", "x_time"], u)


# -- imputation --------------------------------------------------------------------------


def _impute_design(spark, sf):
    treated = impute.treatment(S.treatment_rows(spark, sf))
    return impute.design(treated, bound=S.rows_of(spark, sf, "customer"))


def _impute_units(spark, sf):
    slot = F.pmod(F.col("kk") - 1, F.lit(S.IMPUTE_SCHOOLS)) + 1
    return _impute_design(spark, sf).withColumn("kk_slot", slot)


def _impute_cells(spark, sf, units=None):
    return impute.design_cells(units if units is not None else _impute_units(spark, sf))


def _impute_draws(spark, sf, units=None):
    cells = _impute_cells(spark, sf, units)
    rows = sizing.with_every_draw(
        cells, S.impute_draws(spark, sf), _draw_rows(spark, sf), impute.CELL
    )
    return impute.linear_predictor(rows)


CELL_ID = ["kk_slot", "school_involvement", "y11", "y12"]


@query
def treatment(spark, sf):
    return impute.treatment(S.treatment_rows(spark, sf))


@query
def units_without_late_wave(spark, sf):
    return impute.units_without_late_wave(S.treatment_rows(spark, sf))


@query
def impute_design(spark, sf):
    return rounded(_impute_design(spark, sf))


@query
def impute_linear_predictor(spark, sf):
    return rounded(_impute_draws(spark, sf).select(*CELL_ID, "draw", "l11", "l12"))


@query
def impute_score(spark, sf):
    scored = impute.score(_impute_draws(spark, sf))
    return rounded(scored.select(*CELL_ID, "draw", "p11", "p12", "sep_draw", "llk11", "llk12"))


@query
def impute_sep_loglik(spark, sf):
    rows = impute.sep_loglik(_impute_draws(spark, sf))
    return rounded(rows.select(*CELL_ID, "draw", "sep", "n", "sep_llk"))


def _elpd_cells(spark, sf, units=None):
    rows = impute.sep_loglik(_impute_draws(spark, sf, units))
    return loo.is_loo(rows, [*CELL_ID, "sep", "n"], "sep_llk")


@query
def is_loo(spark, sf):
    """Leave-one-out elpd of each student's known treatment."""
    # read by the cells and by the students: written once
    units = sizing.cut_lineage(_impute_units(spark, sf))
    elpd = sizing.small(_elpd_cells(spark, sf, units).select(*CELL_ID, "elpd_loo"))
    return rounded(units.where("sep is not null").join(elpd, CELL_ID).select("id", "jj", "sep", "elpd_loo"))


def _confusion(spark, sf):
    cells = _elpd_cells(spark, sf).withColumn("p", F.exp("elpd_loo"))
    return loo.confusion(cells, "p", "sep", "n")


@query
def loo_confusion(spark, sf):
    return rounded(_confusion(spark, sf))


@query
def loo_prf(spark, sf):
    return rounded(loo.prf(_confusion(spark, sf)))


@query
def confusion_labels(spark, sf):
    """Confusion of document quality, predicted by the share of good documents of its toxic label."""
    labels = S.read(spark, sf, "labels").where("quality is not null and toxic is not null")
    shares = sizing.small(labels.groupBy("toxic").agg(F.avg("quality").alias("p")))
    return rounded(loo.confusion(labels.join(shares, "toxic"), "p", "quality"))


def _chains(spark, sf):
    """(iterations, chains) of the draws, as long as the shortest chain."""
    return diag.chain_shape(S.vectors(spark, sf))


def _llk_table(spark, sf):
    """Pointwise log-likelihoods as a written table: several passes read it."""
    rows = impute.sep_loglik(_impute_draws(spark, sf))
    return sizing.cut_lineage(rows.select(*CELL_ID, "chain", "iteration", "draw", "sep_llk"))


@query
def relative_efficiency(spark, sf):
    """Relative effective size of the treatment log-likelihood of each design cell."""
    rows = _llk_table(spark, sf)
    out = diag.relative_eff(rows, CELL_ID, *_chains(spark, sf), "sep_llk")
    return rounded(out)


@query
def psis_loo(spark, sf):
    rows = _llk_table(spark, sf).withColumnRenamed("sep_llk", "llk")
    r_eff = diag.relative_eff(rows, CELL_ID, *_chains(spark, sf), "llk", scale="lik")
    out = loo.psis_loo(rows.select(*CELL_ID, "llk"), CELL_ID, _draw_rows(spark, sf), r_eff)
    return rounded(out)


def _sep_draws(spark, sf, units=None):
    return impute.score(_impute_draws(spark, sf, units)).select(*CELL_ID, "draw", "sep_draw")


@query
def beta_moments(spark, sf):
    return rounded(fit.beta_moments(_sep_draws(spark, sf), CELL_ID, "sep_draw"))


@query
def beta_fit(spark, sf):
    return rounded(fit.beta_by_group(_sep_draws(spark, sf), CELL_ID, "sep_draw"), 4)


def _merged(spark, sf, shapes_of):
    # read by the draws and by the students: written once
    units = sizing.cut_lineage(_impute_units(spark, sf))
    shapes = sizing.small(shapes_of(_sep_draws(spark, sf, units)))
    known = units.select("jj", *CELL_ID).join(shapes, CELL_ID).drop(*CELL_ID)
    return impute.merge_fitted(known, units, S.panel_raw(spark, sf), "jj")


@query
def merge_fitted(spark, sf):
    """Panel with observed treatment and moment beta shapes of the unknown one."""
    return rounded(_merged(spark, sf, lambda d: fit.beta_moments(d, CELL_ID, "sep_draw")), 4)


@query
def merge_fitted_ml(spark, sf):
    """The same with maximum-likelihood shapes, as a long panel."""
    merged = _merged(spark, sf, lambda d: fit.beta_by_group(d, CELL_ID, "sep_draw"))
    return rounded(reshape.items_to_long(merged, ITEMS), 4)


@query
def impute_fit_logit(spark, sf):
    out = fit.fit_logit(_impute_cells(spark, sf))
    scored = out.withColumn("sep_p", either(inv_logit("l11"), inv_logit("l12")))
    return rounded(scored.select(*CELL_ID, "n", "l11", "l12", "sep_p"), 3)


@query
def impute_fit_scores(spark, sf):
    """Penalised score of each wave's terms at the estimates: zero at the optimum."""
    return rounded(fit.fit_scores(_impute_cells(spark, sf)))


# -- dropout -----------------------------------------------------------------------------


def _dropout_panel(spark, sf):
    return dropout.dropout_panel(S.panel_dense(spark, sf), bound=S.rows_of(spark, sf, "customer"))


@query
def dropout_panel(spark, sf):
    return rounded(_dropout_panel(spark, sf))


@query
def dropout_design(spark, sf):
    return rounded(dropout.design(_dropout_panel(spark, sf)))


def _dropout_parts(spark, sf, kernel, schema, **adding):
    rows = dropout.design(_dropout_panel(spark, sf)).withColumns(
        {
            "jj_slot": F.pmod(F.col("jj") - 1, F.lit(S.DROPOUT_STUDENTS)) + 1,
            "kk_slot": F.pmod(F.col("kk") - 1, F.lit(S.DROPOUT_SCHOOLS)) + 1,
        }
    )
    draws = S.dropout_draws(spark, sf)
    return blocks.over_draws(sizing.spread_out(rows, ["id", "year"]), draws, kernel(dropout.SCORES), schema, **adding)


@query
def dropout_loglik_by_draw(spark, sf):
    parts = _dropout_parts(spark, sf, kernels.dropout_by_draw, "draw int, llk double, n bigint", sums=["llk", "n"], by="draw")
    n = F.sum("n")
    return rounded(parts.groupBy("draw").agg(n.alias("n"), (F.sum("llk") / n).alias("llk")))


@query
def dropout_risk_by_row(spark, sf):
    """Posterior mean dropout probability of each student-wave."""
    schema = "id bigint, year int, p double, alpha double, n bigint"
    parts = _dropout_parts(spark, sf, kernels.dropout_by_row, schema, sums=["p", "alpha", "n"], by="unit")
    n = F.sum("n")
    return rounded(parts.groupBy("id", "year").agg((F.sum("p") / n).alias("p"), (F.sum("alpha") / n).alias("alpha")))


@query
def dropout_odds_ratios(spark, sf):
    return rounded(dropout.odds_ratios(S.dropout_b_x(spark, sf), _draw_rows(spark, sf)))


@query
def dropout_fit_logit(spark, sf):
    found = dropout.fit_logit(dropout.design(_dropout_panel(spark, sf)))
    return rounded(found.table(spark).select("term", "estimate"), 3)


@query
def dropout_fit_scores(spark, sf):
    """Penalised score of each term at the estimates: zero at the optimum."""
    found = dropout.fit_logit(dropout.design(_dropout_panel(spark, sf)))
    return rounded(found.table(spark).select("term", "score"))


# -- counterfactual ----------------------------------------------------------------------


def _effects(spark, sf, uniform):
    wide = counterfactual.draw_columns(S.student_draws(spark, sf), SIM_WAVES)
    return counterfactual.effects_table(wide, SIM_STUDENTS, SIM_SCHOOLS, SIM_SEED, uniform)


@query
def simulated_effects(spark, sf):
    """Moments of the simulated effects per outcome, draw and school."""
    rows = _effects(spark, sf, plain_uniform)
    out = rows.groupBy("outcome", "draw", "kk").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("b_j_1").alias("b_j_1"),
        F.avg("b_j_2").alias("b_j_2"),
        F.max("b_k_1").alias("b_k_1"),
    )
    return rounded(out)


def _changes(spark, sf, uniform):
    p = counterfactual.probs(_effects(spark, sf, uniform), SIM_WAVES)
    return counterfactual.changes(p, SIM_WAVES)


@query
def counterfactual_probs(spark, sf):
    """Mean category probabilities per draw under both arms at both waves."""
    p = counterfactual.probs(_effects(spark, sf, plain_uniform), SIM_WAVES)
    names = [f"p_{a}_{w}" for a in (0, 1) for w in SIM_WAVES]
    aggs = [F.avg(F.col(n)[y]).alias(f"{n}_{y + 1}") for n in names for y in range(5)]
    return rounded(p.groupBy("outcome", "draw").agg(*aggs))


@query
def counterfactual_change(spark, sf):
    """Mean change probabilities per draw under both arms."""
    rows = _changes(spark, sf, plain_uniform)
    cols = [f"{n}_{a}" for a in (0, 1) for n in ("higher", "same", "lower")]
    return rounded(rows.groupBy("outcome", "draw").agg(*[F.avg(c).alias(c) for c in cols]))


@query
def counterfactual_by_draw(spark, sf):
    return rounded(counterfactual.mean_by_draw(counterfactual.compare_arms(_changes(spark, sf, plain_uniform))))


@query
def counterfactual_summary(spark, sf):
    by_draw = counterfactual.mean_by_draw(counterfactual.compare_arms(_changes(spark, sf, plain_uniform)))
    return counterfactual.summary(by_draw, _draw_rows(spark, sf))


@query
def counterfactual_summary_fast_hash(spark, sf):
    """The same with Spark's own hash as the source of uniforms."""
    by_draw = counterfactual.mean_by_draw(counterfactual.compare_arms(_changes(spark, sf, hash_uniform)))
    return counterfactual.summary(by_draw, _draw_rows(spark, sf))


# -- diagnostics -------------------------------------------------------------------------

PARAM = ["parameter", "i1"]


def _summary_draws(spark, sf):
    """Draws of the four parameter families of all outcomes, written once."""
    rows = _long_draws(spark, sf).where("parameter in ('c', 'z_time', 'b_sep', 'sigma_j')")
    return sizing.cut_lineage(rows)


@query
def split_rhat(spark, sf):
    keys = ["outcome", *PARAM]
    return rounded(diag.rhat(_long_draws(spark, sf), keys, _chains(spark, sf)[0]))


@query
def effective_size(spark, sf):
    return rounded(diag.effective_size(_summary_draws(spark, sf), ["outcome", *PARAM], *_chains(spark, sf)), 4)


@query
def parameter_summary(spark, sf):
    out = diag.summary(
        _summary_draws(spark, sf), ["outcome", *PARAM], *_chains(spark, sf), _draw_rows(spark, sf)
    )
    return rounded(out, 4)


@query
def sampler_health(spark, sf):
    return rounded(diag.sampler_health(S.sampler_params(spark, sf)))


# -- model input and checks --------------------------------------------------------------


@query
def design_sizes(spark, sf):
    return design.sizes(_responses(spark, sf))


@query
def design_schools(spark, sf):
    return design.schools(_responses(spark, sf))


@query
def design_school_levels(spark, sf):
    return design.school_levels(_responses(spark, sf))


@query
def design_students(spark, sf):
    return design.students(_responses(spark, sf), impute.treatment(S.treatment_rows(spark, sf)))


@query
def design_student_units(spark, sf):
    return design.student_units(_responses(spark, sf), impute.treatment(S.treatment_rows(spark, sf)))


@query
def design_student_shapes(spark, sf):
    """Students of the model input with the beta shapes of an unknown treatment."""
    merged = _merged(spark, sf, lambda d: fit.beta_moments(d, CELL_ID, "sep_draw"))
    shapes = merged.groupBy("id").agg(*[F.max(c).alias(c) for c in ("sep", "sep_alpha", "sep_beta")])
    return rounded(design.student_shapes(_responses(spark, sf), shapes), 4)


@query
def design_student_sizes(spark, sf):
    indexed, treated = _responses(spark, sf), impute.treatment(S.treatment_rows(spark, sf))
    return design.student_sizes(
        design.students(indexed, treated), design.student_units(indexed, treated)
    )


@query
def check_design(spark, sf):
    rows = S.panel_long(spark, sf).withColumnRenamed("response", "y")
    return quality.check_design(rows, 5)


@query
def check_imputation(spark, sf):
    return quality.check_imputation(_impute_design(spark, sf))


@query
def check_dropout(spark, sf):
    return quality.check_dropout(_dropout_panel(spark, sf))


@query
def check_draws(spark, sf):
    return quality.check_draws(S.student_draws(spark, sf))


@query
def check_school_draws(spark, sf):
    return quality.check_draws(S.school_draws(spark, sf))


@query
def check_impute_draws(spark, sf):
    sizes = {"b11_sep": 3, "b12_sep": 3, "sigma11": 3, "sigma12": 3, "b11_k": S.IMPUTE_SCHOOLS, "b12_k": S.IMPUTE_SCHOOLS}
    return quality.check_vector_draws(S.impute_draws(spark, sf), sizes, ["sigma11", "sigma12"])


@query
def check_dropout_draws(spark, sf):
    sizes = {"b_x": 8, "b_year": 4, "b_j": S.DROPOUT_STUDENTS, "b_k": S.DROPOUT_SCHOOLS}
    return quality.check_vector_draws(S.dropout_draws(spark, sf), sizes, [])


@query
def check_student_input(spark, sf):
    merged = sizing.cut_lineage(_merged(spark, sf, lambda d: fit.beta_moments(d, CELL_ID, "sep_draw")))
    shapes = merged.groupBy("id").agg(*[F.max(c).alias(c) for c in ("sep", "sep_alpha", "sep_beta")])
    indexed = _responses(spark, sf)
    return quality.check_student_input(design.students(indexed, shapes), design.student_shapes(indexed, shapes), 5)


@query
def check_threshold_rows(spark, sf):
    return quality.check_threshold_rows(D.ps_y(S.student_draws(spark, sf), False))


@query
def check_imputed_treatment(spark, sf):
    return quality.check_unit_interval(_sep_draws(spark, sf), "sep_draw", "sep_in_unit_interval")

