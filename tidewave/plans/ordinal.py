"""The ordered-logit outcome models: effects, predictors, probabilities, likelihood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions.scalar import inv_logit, log1m_exp, mo_steps, softplus
from tidewave.operators.draws import column, split_name, varying_effects


def cut_columns(wide: DataFrame) -> list[Column]:
    n = sum(1 for c in wide.columns if split_name(c)[0] == "c")
    return [column(f"c[{i}]") for i in range(1, n + 1)]


def chol2(base: str) -> list[list[Column]]:
    return [[column(f"{base}[{i},{k}]") for k in (1, 2)] for i in (1, 2)]


def category_probs(eta: Column, cuts: list[Column]) -> list[Column]:
    """Probabilities of all categories: differences of the logistic at the thresholds."""
    above = [inv_logit(eta - c) for c in cuts]
    inner = [above[k - 1] - above[k] for k in range(1, len(cuts))]
    return [F.lit(1.0) - above[0], *inner, above[-1]]


def probs_array(eta: Column, cuts: Column, n_cat: int) -> Column:
    return F.array(*category_probs(eta, [cuts[i] for i in range(n_cat - 1)]))


def prob_rows(df: DataFrame, keys: list[str], n_cat: int, eta: str = "eta") -> DataFrame:
    """Category probability for rows (keys, y, c, eta), the next threshold by window."""
    upper = F.lead("c").over(W.partitionBy(*keys).orderBy("y"))
    df = df.withColumn("_next", upper)
    eta_ = F.col(eta)
    at, nxt = inv_logit(eta_ - F.col("c")), inv_logit(eta_ - F.col("_next"))
    p = (
        F.when(F.col("y") == 1, F.lit(1.0) - nxt)
        .when(F.col("y") < n_cat, at - nxt)
        .when(F.col("y") == n_cat, at)
    )
    return df.withColumn("p", p).drop("_next")


def log_prob(eta: Column, lower: Column, upper: Column, gap: Column) -> Column:
    """Log-probability of a category between two thresholds, in stable form.

    ``gap`` is log(1 - exp(lower - upper)), the same for every eta; the open ends have
    infinite thresholds, which add nothing.
    """
    return gap - softplus(lower - eta) - softplus(eta - upper)


def add_student_effects(wide: DataFrame, n_students: int, n_schools: int) -> DataFrame:
    """Unit effects from standardised effects, and a treatment probability per student."""
    sigma = [column("sigma_j[1]"), column("sigma_j[2]")]
    effects = {}
    for s in range(1, n_students + 1):
        z = [column(f"b_j_z[1,{s}]"), column(f"b_j_z[2,{s}]")]
        b1, b2 = varying_effects(sigma, chol2("Lcorr_j"), z)
        effects[f"b_j_1[{s}]"] = b1
        effects[f"b_j_2[{s}]"] = b2
        effects[f"x_sep[{s}]"] = inv_logit(z[0] + z[1])
    for s in range(1, n_schools + 1):
        effects[f"b_k_1[{s}]"] = column("sigma_k") * column(f"b_k_z[{s}]")
    return wide.withColumns(effects)


def add_school_effects(wide: DataFrame, involvement: list[int], n_students: int) -> DataFrame:
    """Student effects, and school effects with the effect of involvement added."""
    sigma = [column("sigma_k[1]"), column("sigma_k[2]")]
    effects = {}
    for s, level in enumerate(involvement, start=1):
        z = [column(f"b_k_z[1,{s}]"), column(f"b_k_z[2,{s}]")]
        k1, k2 = varying_effects(sigma, chol2("Lcorr_k"), z)
        effects[f"b_k_1[{s}]"] = k1 + column(f"b_sep[{level}]")
        effects[f"b_k_2[{s}]"] = k2 + column(f"b_sep_time[{level}]")
    scale = [column("sigma_j[1]"), column("sigma_j[2]")]
    for s in range(1, n_students + 1):
        z = [column(f"b_j_z[1,{s}]"), column(f"b_j_z[2,{s}]")]
        b1, b2 = varying_effects(scale, chol2("Lcorr_j"), z)
        effects |= {f"b_j_1[{s}]": b1, f"b_j_2[{s}]": b2}
    return wide.withColumns(effects)


def wide_predictions(wide: DataFrame, n_waves: int) -> DataFrame:
    """Predicted probabilities as wide columns ``p[s,x,m]`` for arms 0 and 1."""
    cuts = cut_columns(wide)
    steps = mo_steps([column(f"z_time[{i}]") for i in range(1, n_waves)], n_waves - 1)
    out = {}
    for s in (1, 2):
        for x in range(1, n_waves + 1):
            eta = column("b_time") * steps[x - 1] + column(f"b_sep[{x}]") * F.lit(float(s - 1))
            for m, p in enumerate(category_probs(eta, cuts), start=1):
                out[f"p[{s},{x},{m}]"] = p
    keys = [c for c in ("outcome", "chain", "iteration", "draw") if c in wide.columns]
    return wide.select(*keys, *[p.alias(n) for n, p in out.items()])


def student_grid(wide: DataFrame, n_waves: int) -> list[tuple[int, int, Column]]:
    """(arm, wave, eta) of the student model, arms 0 and 1."""
    steps = mo_steps([column(f"z_time[{i}]") for i in range(1, n_waves)], n_waves - 1)
    return [
        (s, x, column("b_time") * steps[x] + column(f"b_sep[{x + 1}]") * F.lit(float(s)))
        for s in (0, 1)
        for x in range(n_waves)
    ]


def school_grid(wide: DataFrame, n_waves: int, levels: int = 3) -> list[tuple[int, int, Column]]:
    """(involvement, wave, eta) of the school model."""
    steps = mo_steps([column(f"z_time[{i}]") for i in range(1, n_waves)], n_waves - 1)
    return [
        (s, x, column(f"b_sep[{s}]") + column(f"b_sep_time[{s}]") * steps[x])
        for s in range(1, levels + 1)
        for x in range(n_waves)
    ]


def predict_grid(wide: DataFrame, grid: list[tuple[int, int, Column]]) -> DataFrame:
    """Probabilities per draw, arm and wave as a vector ``p``; nothing is shuffled."""
    cuts = cut_columns(wide)
    points = [
        F.struct(F.lit(s).alias("x_sep"), F.lit(x).alias("x_time"), eta.alias("eta"))
        for s, x, eta in grid
    ]
    rows = wide.select(
        "outcome", "draw", F.array(*cuts).alias("_c"), F.inline(F.array(*points))
    )
    p = probs_array(F.col("eta"), F.col("_c"), len(cuts) + 1)
    return rows.withColumn("p", p).drop("_c", "eta")


def unfold(df: DataFrame) -> DataFrame:
    """Probability vector to rows (…, y, p)."""
    keys = [c for c in df.columns if c != "p"]
    rows = df.select(*keys, F.posexplode("p").alias("_i", "p"))
    return rows.select(*keys, (F.col("_i") + 1).alias("y"), "p")


# -- unit level --------------------------------------------------------------------------


def draw_vectors(effects: DataFrame, n_waves: int, n_students: int, n_schools: int) -> DataFrame:
    """One narrow row per draw: thresholds, effects by wave, student and school as arrays."""

    def arr(base: str, n: int) -> Column:
        return F.array(*[column(f"{base}[{i}]") for i in range(1, n + 1)]).alias(base)

    steps = mo_steps([column(f"z_time[{i}]") for i in range(1, n_waves)], n_waves - 1)
    return effects.select(
        "outcome",
        "draw",
        F.array(*cut_columns(effects)).alias("c"),
        "b_time",
        F.array(*steps).alias("mo"),
        arr("b_sep", n_waves),
        arr("b_j_1", n_students),
        arr("b_j_2", n_students),
        arr("x_sep", n_students),
        arr("b_k_1", n_schools),
    )


def school_vectors(effects: DataFrame, n_waves: int, n_students: int, n_schools: int) -> DataFrame:
    """The same for the school model."""

    def arr(base: str, n: int) -> Column:
        return F.array(*[column(f"{base}[{i}]") for i in range(1, n + 1)]).alias(base)

    steps = mo_steps([column(f"z_time[{i}]") for i in range(1, n_waves)], n_waves - 1)
    return effects.select(
        "outcome", "draw", F.array(*cut_columns(effects)).alias("c"), F.array(*steps).alias("mo"),
        arr("b_j_1", n_students), arr("b_j_2", n_students),
        arr("b_k_1", n_schools), arr("b_k_2", n_schools),
    )


def linear_predictor_schools(df: DataFrame) -> DataFrame:
    """eta of the school model for rows (x_time, jj, kk) x draw."""
    j, k = F.col("jj_slot") - 1, F.col("kk_slot") - 1
    slope = F.col("b_j_2")[j] + F.col("b_k_2")[k]
    eta = F.col("b_j_1")[j] + F.col("b_k_1")[k] + slope * F.col("mo")[F.col("x_time")]
    return df.withColumn("eta", eta)


def linear_predictor(df: DataFrame) -> DataFrame:
    """eta without treatment (eta_0) and with it (eta_1) for rows (x_time, jj, kk) x draw."""
    j, k, t = F.col("jj_slot") - 1, F.col("kk_slot") - 1, F.col("x_time")
    eta_0 = F.col("b_j_1")[j] + F.col("b_k_1")[k] + (
        F.col("b_time") + F.col("b_j_2")[j]
    ) * F.col("mo")[t]
    df = df.withColumn("eta_0", eta_0)
    return df.withColumn("eta_1", F.col("eta_0") + F.col("b_sep")[t])


def response_cells(responses: DataFrame, keys: list[str], n_cat: int | None = None) -> DataFrame:
    """Equal responses of the same design as one weighted cell, before draws are attached.

    With ``n_cat`` the categories stand side by side: ``n_1`` ... count the responses of the design in each."""
    by_category = [F.count_if(F.col("y") == y).alias(f"n_{y}") for y in range(1, (n_cat or 0) + 1)]
    return responses.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *by_category)


STATES = {"0": 0, "1": 1, "u": None}


def state_cells(responses: DataFrame, keys: list[str], n_cat: int) -> DataFrame:
    """One row per design with the counts ``n_y_s`` of its responses by category and participation."""
    def known(s: int | None) -> Column:
        return F.col("sep").isNull() if s is None else F.col("sep") == s

    counts = {f"n_{y}_{k}": F.count_if((F.col("y") == y) & known(s)) for y in range(1, n_cat + 1) for k, s in STATES.items()}
    return responses.groupBy(*keys).agg(*[v.alias(k) for k, v in counts.items()])


def merge_sep(df: DataFrame, imputed: Column) -> DataFrame:
    """Observed participation where known, the draw of it otherwise."""
    return df.withColumn("x_sep_merged", F.coalesce(F.col("sep").cast("double"), imputed))


def with_thresholds(df: DataFrame) -> DataFrame:
    """The thresholds around the observed category, and the log of the gap between them."""
    inf = F.lit(float("inf"))
    ends = F.concat(F.array(-inf), F.col("c"), F.array(inf))
    df = df.withColumns({"_lo": ends[F.col("y") - 1], "_hi": ends[F.col("y")]})
    return df.withColumn("_gap", log1m_exp(F.col("_lo") - F.col("_hi")))


def _log_prob_of(eta: Column) -> Column:
    return log_prob(eta, F.col("_lo"), F.col("_hi"), F.col("_gap"))


def _category_logs(df: DataFrame, eta: Column, n_cat: int, name: str) -> DataFrame:
    """Columns ``{name}1`` ... with the log-probability of each category.

    A softplus at a threshold serves the categories on both sides of it, and the gaps are those of the draw."""
    df = df.withColumn(f"{name}e", eta)
    above = {f"{name}s{i}": softplus(F.col(f"{name}e") - F.col("c")[i - 1]) for i in range(1, n_cat)}
    df = df.withColumns(above)
    logs = {}
    for y in range(1, n_cat + 1):
        # softplus(-x) = softplus(x) - x
        below = F.col(f"{name}s{y - 1}") - (F.col(f"{name}e") - F.col("c")[y - 2]) if y > 1 else None
        over = F.col(f"{name}s{y}") if y < n_cat else None
        if below is None:
            logs[f"{name}{y}"] = -over
        elif over is None:
            logs[f"{name}{y}"] = -below
        else:
            logs[f"{name}{y}"] = F.col("gap")[y - 2] - below - over
    return df.withColumns(logs).drop(f"{name}e", *above)


def _arm_logs(df: DataFrame, eta: Column, log_w: Column, n_cat: int, name: str) -> DataFrame:
    """Columns ``{name}1`` ... as of ``_category_logs``, plus the log-weight of the arm; null where ``eta`` or ``log_w`` is.

    A softplus and what it is beside its argument are columns of one step: used twice there, it becomes a function of its own in the
    generated code. Two arms would else make a function of over 8,000 bytes, which the JVM interprets and never compiles."""
    df = df.withColumns({f"{name}e": eta, f"{name}w": log_w})
    log_w, sides = F.col(f"{name}w"), {}
    for i in range(1, n_cat):
        x = F.col(f"{name}e") - F.col("c")[i - 1]
        # softplus(-x) = softplus(x) - x
        sides |= {f"{name}a{i}": log_w - softplus(x), f"{name}b{i}": softplus(x) - x}
    df = df.withColumns(sides)
    inner = {f"{name}{y}": F.col(f"{name}a{y}") + (F.col("gap")[y - 2] - F.col(f"{name}b{y - 1}")) for y in range(2, n_cat)}
    ends = {f"{name}1": F.col(f"{name}a1"), f"{name}{n_cat}": log_w - F.col(f"{name}b{n_cat - 1}")}
    return df.withColumns(inner | ends).drop(f"{name}e", f"{name}w", *sides)


def with_gaps(vectors: DataFrame, n_cat: int) -> DataFrame:
    """Draws with ``gap``: the log of the room between neighbouring thresholds, once per draw."""
    c = F.col("c")
    return vectors.withColumn("gap", F.array(*[log1m_exp(c[i] - c[i + 1]) for i in range(n_cat - 2)]))


def _with_sum_of_cell(df: DataFrame, logs: list[Column]) -> DataFrame:
    """``llk``: counts times log-probabilities. A category that nobody chose adds nothing, also where it has no room;
    null terms drop out, and a cell without any other is null."""
    df = df.withColumns({f"_t{y}": F.when(F.col(f"n_{y}") > 0, F.col(f"n_{y}") * log) for y, log in enumerate(logs, start=1)})
    terms = [F.col(f"_t{y}") for y in range(1, len(logs) + 1)]
    total = F.coalesce(terms[0], F.lit(0.0))
    for t in terms[1:]:
        total = total + F.coalesce(t, F.lit(0.0))
    return df.withColumn("llk", F.when(F.coalesce(*terms).isNotNull(), total)).drop(*[f"_t{y}" for y in range(1, len(logs) + 1)])


def _either(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)). A null drops out; two arms without room, both minus infinity, leave no room."""
    more = F.log1p(F.exp(-F.abs(a - b)))
    return F.greatest(a, b) + F.coalesce(F.nanvl(more, F.lit(0.0)), F.lit(0.0))


def loglik_known(df: DataFrame, n_cat: int | None = None) -> DataFrame:
    """Pointwise log-likelihood of rows with a complete predictor ``eta``.

    With ``n_cat`` a row is a design with the counts ``n_1`` ... of its responses by category (``response_cells``) and
    the ``gap`` of its draw, and ``llk`` is the sum over these responses."""
    if n_cat:
        df = _category_logs(df, F.col("eta"), n_cat, "_p")
        logs = [f"_p{y}" for y in range(1, n_cat + 1)]
        return _with_sum_of_cell(df, [F.col(c) for c in logs]).drop(*logs)
    df = with_thresholds(df).withColumn("llk", _log_prob_of(F.col("eta")))
    return df.drop("_lo", "_hi", "_gap")


def loglik(df: DataFrame, n_cat: int | None = None) -> DataFrame:
    """Pointwise log-likelihood of each row under each draw.

    Known participation enters the predictor; unknown participation mixes the two arms
    with the drawn probability, on the log scale. With ``n_cat`` a row holds the counts of its responses by category,
    as in ``loglik_known``.
    """
    w = F.col("x_sep_merged")
    unknown = F.col("sep").isNull()
    # with unknown participation the first term is the arm that takes part
    share = F.when(unknown, F.lit(1.0)).otherwise(w)
    first = F.col("eta_0") + (F.col("eta_1") - F.col("eta_0")) * share
    # log of 0 is null: that arm has no weight and drops out, as the second one does with known participation
    on, off = F.when(unknown, F.log(w)).otherwise(F.lit(0.0)), F.when(unknown, F.log(1 - w))
    if n_cat:
        df = _arm_logs(df, first, on, n_cat, "_p")
        df = _arm_logs(df, F.when(unknown, F.col("eta_0")), off, n_cat, "_q")
        ys = range(1, n_cat + 1)
        df = _with_sum_of_cell(df, [_either(F.col(f"_p{y}"), F.col(f"_q{y}")) for y in ys])
        return df.drop(*[f"{c}{y}" for c in ("_p", "_q") for y in ys])
    df = with_thresholds(df).withColumn("_on", on + _log_prob_of(first))
    df = df.withColumn("_off", F.when(unknown, off + _log_prob_of(F.col("eta_0"))))
    df = df.withColumn("llk", _either(F.col("_on"), F.col("_off")))
    return df.drop("_lo", "_hi", "_gap", "_on", "_off")
