"""The panel and draw tables of the analysis, derived from the given tables.

Every rule reads all rows of its source tables. Customers are students, nations are
schools, order years are waves, line items are item responses, embedding vectors are
posterior draws and events are sampler iterations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import index, reshape, sizing
from tidewave.plans import ordinal
from tidewave.sources.schema import ITEM_COUNTS, ITEMS, OUTCOMES

# Units of the wide draws: effect columns for students and schools of each model.
STUDENT_SLOTS = 18
SCHOOL_SLOTS = 10
SCHOOL_MODEL_STUDENTS = 11
IMPUTE_SCHOOLS = 7
DROPOUT_SCHOOLS = 5
DROPOUT_STUDENTS = 12
N_CHAINS = 4


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows_of(spark: SparkSession, sf: str, name: str) -> int:
    """Row count of a given table, from the file footers: an upper bound for its groups."""
    return read(spark, sf, name).count()


# -- panel -------------------------------------------------------------------------------


def wave(date: str) -> Column:
    return (F.lit(8) + F.pmod(F.year(date) - 1995, F.lit(5))).cast("int")


def outcome_of(part: str) -> Column:
    names = F.array(*[F.lit(o) for o in OUTCOMES])
    return names[F.pmod(F.col(part), F.lit(8)).cast("int")]


def item_of(part: str, supplier: str) -> Column:
    counts = F.array(*[F.lit(ITEM_COUNTS[o]) for o in OUTCOMES])
    n = counts[F.pmod(F.col(part), F.lit(8)).cast("int")]
    return (F.pmod(F.col(supplier), n) + 1).cast("int")


def category(quantity: str) -> Column:
    return (F.floor((F.col(quantity) - 1) / 10) + 1).cast("int")


def panel_long(spark: SparkSession, sf: str) -> DataFrame:
    """Responses by student, wave, outcome and item; the lowest where an item repeats."""
    lines = read(spark, sf, "lineitem").select(
        "l_orderkey",
        outcome_of("l_partkey").alias("outcome"),
        item_of("l_partkey", "l_suppkey").alias("item"),
        F.when(F.col("l_tax") != 0, category("l_quantity")).alias("response"),
    )
    orders = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", wave("o_orderdate").alias("year")
    )
    students = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("school"),
        (F.pmod(F.col("c_nationkey"), F.lit(3)) + 1).cast("int").alias("school_involvement"),
    )
    # tasks stay within their rows however many there are; one placement by student serves the items, the join and later steps
    n = rows_of(spark, sf, "lineitem")
    answers = sizing.dealt_by(lines, "l_orderkey", n).join(sizing.dealt_by(orders, "l_orderkey", n), "l_orderkey")
    items = (
        sizing.dealt_by(answers.withColumnRenamed("o_custkey", "id"), "id", n)
        .groupBy("id", "year", "outcome", "item")
        .agg(F.min("response").alias("response"))
    )
    return items.join(sizing.dealt_by(students, "id", n), "id").select(
        "id", "school", "school_involvement", "year", "outcome", "item", "response"
    )


def sep_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Participation per student and wave: 1 and 0 by order status, else unknown."""
    flag = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 0)
    return (
        read(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("id"), wave("o_orderdate").alias("year"))
        .agg(F.max(flag).alias("sep"))
    )


def panel_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Wide panel: one row per student and wave, one column per item."""
    ids = ["id", "school", "school_involvement", "year"]
    wide = reshape.to_wide(panel_long(spark, sf), ids, ["outcome", "item"], ITEMS, "response")
    return wide.join(sep_raw(spark, sf), ["id", "year"], "left").select(*ids, "sep", *ITEMS)


def treatment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Student, school and participation per wave, without the items."""
    students = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("school"),
        (F.pmod(F.col("c_nationkey"), F.lit(3)) + 1).cast("int").alias("school_involvement"),
    )
    return sep_raw(spark, sf).join(students, "id").select(
        "id", "school", "school_involvement", "year", "sep"
    )


def panel_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Wide panel of tenfold customers, so that most scales are complete.

    Item nulls and unanswered waves follow from line numbers; no row is left out.
    """
    lines = read(spark, sf, "lineitem").select(
        "l_orderkey",
        outcome_of("l_partkey").alias("outcome"),
        item_of("l_partkey", "l_suppkey").alias("item"),
        category("l_quantity").alias("category"),
        F.col("l_linenumber").cast("bigint").alias("line"),
    )
    orders = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.floor(F.col("o_custkey") / 10).cast("bigint").alias("id"),
        wave("o_orderdate").alias("year"),
    )
    name = F.concat_ws("_", "outcome", "item")
    items = (
        lines.join(orders, "l_orderkey")
        .groupBy("id", "year", name.alias("name"))
        .agg(F.min("category").alias("category"), F.sum("line").alias("line"))
    )
    kept = F.when(F.col("line") % 29 != 0, F.col("category"))
    picks = [F.max(F.when(F.col("name") == c, kept)).alias(c) for c in ITEMS]
    waves = items.groupBy("id", "year").agg(F.sum("line").alias("_line"), *picks)
    answered = F.col("_line") % 4 != 0
    school = F.pmod(F.col("id"), F.lit(25)).cast("int")
    return waves.select(
        "id",
        school.alias("school"),
        (F.pmod(school, F.lit(3)) + 1).cast("int").alias("school_involvement"),
        "year",
        *[F.when(answered, F.col(c)).alias(c) for c in ITEMS],
    )


# -- draws -------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(chain, iteration, draw, e): one posterior draw per embedding, e of unit scale."""
    v = F.col("vec_id")
    scaled = F.transform("embedding", lambda x: x.cast("double") * 8.0)
    return read(spark, sf, "embeddings").select(
        (v % N_CHAINS + 1).cast("int").alias("chain"),
        (F.floor(v / N_CHAINS) + 1).cast("int").alias("iteration"),
        (v + 1).cast("int").alias("draw"),
        scaled.alias("e"),
    )


def vectors_by_outcome(spark: SparkSession, sf: str, outcomes: list[str] = OUTCOMES) -> DataFrame:
    """The draws of each outcome: the same vectors, turned by 8 positions per outcome."""
    v = vectors(spark, sf)
    which = F.explode(F.array(*[F.lit(OUTCOMES.index(o)) for o in outcomes]))
    v = v.withColumn("_o", which)
    turned = F.concat(
        F.slice("e", F.col("_o") * 8 + 1, F.lit(64)), F.slice("e", F.lit(1), F.col("_o") * 8)
    )
    names = F.array(*[F.lit(o) for o in OUTCOMES])
    return v.select("chain", "iteration", "draw", names[F.col("_o")].alias("outcome"),
                    turned.alias("e"))


def _e(i: int) -> Column:
    return F.col("e")[i - 1]


def _simplex(lo: int, n: int) -> list[Column]:
    parts = [F.exp(_e(lo + i)) for i in range(n)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def _named(base: str, cols: list[Column]) -> list[Column]:
    return [c.alias(f"{base}[{i}]") for i, c in enumerate(cols, start=1)]


def _chol2(base: str, rho: Column) -> list[Column]:
    return [
        F.lit(1.0).alias(f"{base}[1,1]"),
        F.lit(0.0).alias(f"{base}[1,2]"),
        rho.alias(f"{base}[2,1]"),
        F.sqrt(F.lit(1.0) - rho * rho).alias(f"{base}[2,2]"),
    ]


def student_draws(spark: SparkSession, sf: str, outcomes: list[str] = OUTCOMES) -> DataFrame:
    """Wide draws of the student model per outcome."""
    v = vectors_by_outcome(spark, sf, outcomes)
    v = v.withColumn("_c", F.array_sort(F.slice("e", 1, 4)))
    z1 = [_e(18 + s).alias(f"b_j_z[1,{s}]") for s in range(1, STUDENT_SLOTS + 1)]
    z2 = [
        _e(18 + STUDENT_SLOTS + s).alias(f"b_j_z[2,{s}]") for s in range(1, STUDENT_SLOTS + 1)
    ]
    return v.select(
        "outcome", "chain", "iteration", "draw",
        *_named("c", [F.col("_c")[i] for i in range(4)]),
        *_named("z_time", _simplex(5, 4)),
        _e(9).alias("b_time"),
        *_named("b_sep", [_e(9 + i) for i in range(1, 6)]),
        *_named("sigma_j", [F.exp(_e(15)), F.exp(_e(16))]),
        *_chol2("Lcorr_j", F.tanh(_e(17))),
        F.exp(_e(18)).alias("sigma_k"),
        *z1, *z2,
        *_named("b_k_z", [_e(54 + s) for s in range(1, SCHOOL_SLOTS + 1)]),
    )


def student_effects(spark: SparkSession, sf: str, outcomes: list[str] = OUTCOMES) -> DataFrame:
    """Student draws with the unit effects b_j_1, b_j_2, b_k_1 and the treatment x_sep."""
    return ordinal.add_student_effects(student_draws(spark, sf, outcomes), STUDENT_SLOTS, SCHOOL_SLOTS)


def school_draws(spark: SparkSession, sf: str, outcomes: list[str] = OUTCOMES) -> DataFrame:
    """Wide draws of the school model per outcome."""
    v = vectors_by_outcome(spark, sf, outcomes)
    v = v.withColumn("_c", F.array_sort(F.slice("e", 1, 4)))
    zk = [
        _e(22 + 10 * (d - 1) + s).alias(f"b_k_z[{d},{s}]")
        for d in (1, 2)
        for s in range(1, SCHOOL_SLOTS + 1)
    ]
    zj = [_e(42 + 11 * (d - 1) + s).alias(f"b_j_z[{d},{s}]") for d in (1, 2)
          for s in range(1, SCHOOL_MODEL_STUDENTS + 1)]
    return v.select(
        "outcome", "chain", "iteration", "draw",
        *_named("c", [F.col("_c")[i] for i in range(4)]),
        *_named("z_time", _simplex(5, 4)),
        *_named("b_sep_free", [_e(10), _e(11)]),
        *_named("b_sep", [F.lit(0.0), _e(10), _e(11)]),
        *_named("b_sep_time", [_e(12), _e(13), _e(14)]),
        *_named("sigma_j", [F.exp(_e(15)), F.exp(_e(16))]),
        *_chol2("Lcorr_j", F.tanh(_e(17))),
        *_named("sigma_k", [F.exp(_e(18)), F.exp(_e(19))]),
        *_chol2("Lcorr_k", F.tanh(_e(20))),
        *zk, *zj,
    )


def impute_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Draws of the imputation model; vectors per parameter, schools as an array."""
    def arr(lo: int, n: int, fn=lambda x: x) -> Column:
        return F.array(*[fn(_e(lo + i)) for i in range(n)])

    return vectors(spark, sf).select(
        "chain", "iteration", "draw",
        _e(1).alias("a11"), _e(2).alias("b11_y12"), _e(3).alias("b11_m12"),
        arr(4, 3).alias("b11_sep"),
        _e(7).alias("a12"), _e(8).alias("b12_y11"), _e(9).alias("b12_m11"),
        arr(10, 3).alias("b12_sep"),
        arr(13, 3, F.exp).alias("sigma11"), arr(16, 3, F.exp).alias("sigma12"),
        F.array(*[arr(19 + 6 * k, 3) for k in range(IMPUTE_SCHOOLS)]).alias("b11_k"),
        F.array(*[arr(22 + 6 * k, 3) for k in range(IMPUTE_SCHOOLS)]).alias("b12_k"),
    )


def dropout_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Draws of the dropout model; the school effects per wave are held per school."""
    def arr(lo: int, n: int) -> Column:
        return F.array(*[_e(lo + i) for i in range(n)])

    schools = []
    for k in range(DROPOUT_SCHOOLS):
        schools.append(F.array(*[F.exp(_e(15 + t)) * _e(19 + 4 * k + t) for t in range(4)]))
    return vectors(spark, sf).select(
        "chain", "iteration", "draw",
        _e(1).alias("b_0"), _e(2).alias("b_1"), arr(3, 8).alias("b_x"),
        F.array(F.lit(0.0), _e(11), _e(12), _e(13)).alias("b_year"),
        F.array(
            *[F.exp(_e(14)) * _e(39 + s) for s in range(DROPOUT_STUDENTS)]
        ).alias("b_j"),
        F.array(*schools).alias("b_k"),
    )


def dropout_b_x(spark: SparkSession, sf: str) -> DataFrame:
    """Wide draws of the dropout predictors, ``b_x[1]`` to ``b_x[8]``."""
    return vectors(spark, sf).select(
        "chain", "iteration", "draw", *_named("b_x", [_e(2 + i) for i in range(1, 9)])
    )


def sampler_params(spark: SparkSession, sf: str) -> DataFrame:
    """Sampler columns per iteration of each chain, from the event log."""
    events = read(spark, sf, "events").select(
        (F.col("user_id") % N_CHAINS + 1).cast("int").alias("chain"),
        "event_id",
        (F.col("event_type") == "click").cast("int").alias("divergent"),
        (F.col("user_id") % 11).cast("int").alias("treedepth"),
        F.col("value").alias("energy"),
    )
    bound = rows_of(spark, sf, "events")
    return index.row_index(events, ["chain"], ["event_id"], "iteration", bound=bound)


def wide_p(spark: SparkSession, sf: str, outcomes: list[str] = OUTCOMES) -> DataFrame:
    """Student draws with the predicted probabilities as wide columns ``p[s,x,m]``."""
    return ordinal.wide_predictions(student_draws(spark, sf, outcomes), n_waves=5)


