"""Names and declared types of the survey panel."""

from __future__ import annotations

from pyspark.sql import types as T

# Outcome codes, items per outcome, waves and report labels.
OUTCOMES = ["cq", "oa", "tr", "wc", "em", "ia", "dp", "mb"]
ITEM_COUNTS = {"oa": 4, "tr": 2, "em": 4, "ia": 2, "wc": 2, "cq": 5, "dp": 2, "mb": 5}
WAVES = [8, 9, 10, 11, 12]
REPORT_ORDER = ["cq", "wc", "oa", "tr", "em", "ia", "dp", "mb"]
OUTCOME_LABELS = {
    "oa": "Outgroup Attitudes",
    "tr": "Outgroup Trust",
    "em": "Intergroup Empathy",
    "ia": "Intergroup Anxiety",
    "cq": "Intergroup Contact",
    "wc": "Future Contact",
    "dp": "Deprovincialization",
    "mb": "Multicultural Beliefs",
}
# Position of an outcome in the dropout predictor matrix -> outcome code.
DROPOUT_PREDICTORS = ["oa", "tr", "em", "ia", "wc", "cq", "dp", "mb"]
# Report order of these positions: intergroup contact before future contact.
DROPOUT_REPORT_ORDER = [1, 2, 3, 4, 6, 5, 7, 8]
# Fixed values end.

ITEMS = [f"{o}_{i}" for o in ITEM_COUNTS for i in range(1, ITEM_COUNTS[o] + 1)]

UNIT_FIELDS = [
    T.StructField("id", T.LongType()),
    T.StructField("school", T.IntegerType()),
    T.StructField("school_involvement", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("sep", T.IntegerType()),
]
BETA_FIELDS = [
    T.StructField("sep_alpha", T.DoubleType()),
    T.StructField("sep_beta", T.DoubleType()),
]

PANEL_RAW = T.StructType(UNIT_FIELDS + [T.StructField(c, T.IntegerType()) for c in ITEMS])
PANEL_WIDE = T.StructType(
    UNIT_FIELDS + BETA_FIELDS + [T.StructField(c, T.IntegerType()) for c in ITEMS]
)
PANEL_LONG = T.StructType(
    UNIT_FIELDS
    + BETA_FIELDS
    + [
        T.StructField("outcome", T.StringType()),
        T.StructField("item", T.IntegerType()),
        T.StructField("response", T.IntegerType()),
    ]
)
