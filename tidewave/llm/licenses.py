"""License scan by ordered signature rules, built from column functions alone.

A text becomes its lower-case words, each followed by its number. Only rules of which a keyword is among
the words are tried. Every match is a detection, an interval of words; it is suppressed when a
detection of the same or a higher level contains it (of equal intervals the one of the higher
level, then of the earlier rule stays). Detections are sorted by place, and one pass that carries the farthest end
of each level decides on all of them. Rows are never unfolded, so no key or document piles up in a shuffle.

Defined results: null, empty and word-free texts have no detections; each row is scanned on its own,
so repeated rows get equal results; letters other than A-Z keep their case; an empty table gives an
empty one; a column named like an output is replaced, further columns are kept. A whole document is
held by one task, as its row is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm.license_rules import CONFIDENCE, PHRASES, RULES, Rule

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The only letter beyond A-Z whose lower case is one of a-z: it has to stay apart from k.
KELVIN, STAND_IN = "K", "ĸ"
NUMBER = "#[0-9]+"
# Marks around a match; neither is in a word or its number.
OPEN, CLOSE = "<", ">"
# Detections are judged in blocks, as lists grow by copying.
BLOCK = 256
DETECTION = "array<struct<first:int,back:int,level:int,rule:int,last:int>>"
OUTPUTS = ("n_words", "places", "detections")


def numbered(pattern: str) -> str:
    """The pattern over words as one over ``' word#number '`` pieces."""
    return " (?:" + pattern.replace(" ", f"{NUMBER}  ") + f"){NUMBER} "


def rules_by_keyword(rules: list[Rule]) -> Column:
    """A constant map from a keyword to its rules, one a line as ``number, level, pattern`` with tabs between.

    As two split strings it stays a small expression however many rules there are.
    """
    lines: dict[str, list[str]] = {}
    for r in rules:
        for k in r.keywords:
            lines.setdefault(k, []).append(f"{r.number}\t{r.level}\t{numbered(r.pattern)}")
    return F.map_from_arrays(
        F.split(F.lit(" ".join(lines)), " "), F.split(F.lit("\f".join("\n".join(x) for x in lines.values())), "\f"))


def rules_met(table: Column) -> Column:
    every = F.flatten(F.transform("_met", lambda k: F.split(F.coalesce(F.element_at(table, k), F.lit("")), "\n")))
    return F.filter(F.array_distinct(every), lambda r: r != "")


def parts_of(text: Column) -> Column:
    """The words, with an empty part before or after them where the text starts or ends with other characters."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(STAND_IN)))
    return F.split(plain, BETWEEN, -1)


def number_of_words(parts: Column) -> Column:
    empty = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.size(parts) - empty, F.lit(0))


def intervals(pattern: Column, level: Column, rule: Column) -> Column:
    """All matches of a pattern in ``_pieces``: sorted by place, an interval before those it contains."""
    def one(match: Column) -> Column:
        first = F.split_part(F.split_part(match, F.lit("#"), F.lit(2)), F.lit(" "), F.lit(1)).cast("int")
        last = F.rtrim(F.split_part(match, F.lit("#"), F.lit(-1))).cast("int")
        return F.struct(first.alias("first"), (-last).alias("back"), (-level).alias("level"), rule.alias("rule"), last.alias("last"))

    # marking the matches reads the text once; extracting them would copy the text for each match
    marked = F.split(F.regexp_replace(F.col("_pieces"), pattern, F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    return F.transform(F.slice(marked, F.lit(2), F.size(marked)), lambda x: one(F.split_part(x, F.lit(CLOSE), F.lit(1))))


def phrase_places(phrase: str, label: str) -> Column:
    found = intervals(F.lit(numbered(phrase)), F.lit(0), F.lit(0))
    return F.transform(found, lambda d: F.struct(d["first"].alias("first"), F.lit(label).alias("label")))


def uncontained(found: Column, levels: int) -> Column:
    """Detections that none of the same or a higher level contains."""
    def step(state: Column, d: Column) -> Column:
        level = -d["level"]
        ends = F.transform(state["ends"], lambda e, i: F.when(i < level, F.greatest(e, d["last"])).otherwise(e))
        keep = F.element_at(state["ends"], level) < d["last"]
        return F.struct(ends.alias("ends"), F.when(keep, F.concat(state["kept"], F.array(d))).otherwise(state["kept"]).alias("kept"))

    none = F.array().cast(DETECTION)

    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["ends"].alias("ends"), none.alias("kept")), step)
        return F.struct(inner["ends"].alias("ends"), F.concat(state["kept"], inner["kept"]).alias("kept"))

    start = F.struct(F.array_repeat(F.lit(-1), levels).alias("ends"), none.alias("kept"))
    blocks = F.transform(F.sequence(F.lit(0), F.size(found) - 1, F.lit(BLOCK)), lambda a: F.slice(found, a + 1, F.lit(BLOCK)))
    return F.aggregate(blocks, start, block, lambda s: s["kept"])


def scan(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """Add ``n_words``, ``places`` and ``detections``; the text is kept.

    ``places``: (label, first word) of each place of a phrase, in order, whatever the rules say.
    ``detections``: (first, last, rule, label, level, confidence) of each detection that stands, in order.
    """
    rules = RULES if rules is None else rules
    phrases = PHRASES if phrases is None else phrases
    labels = F.split(F.lit(",".join(r.label for r in rules)), ",")
    keys = sorted({k for r in rules for k in r.keywords} | {p.split(" ")[0] for _, p in phrases})
    levels = max((r.level for r in rules), default=1)
    keep = [c for c in df.columns if c not in OUTPUTS]
    # keywords first; everything that costs follows only where one is met
    judged = (
        df.select(*(F.col(f"`{c}`") for c in keep), parts_of(F.col(f"`{text}`")).alias("_parts"))
        .withColumn("_met", F.array_intersect("_parts", F.split(F.lit(" ".join(keys)), " ")))
        .withColumn("_pieces", F.when(F.size("_met") > 0, F.array_join(F.transform(
            F.array_remove("_parts", ""), lambda w, i: F.concat(F.lit(" "), w, F.lit("#"), i.cast("string"), F.lit(" "))), "")))
    )
    def field(rule: Column, k: int) -> Column:
        return F.split_part(rule, F.lit("\t"), F.lit(k))

    found = F.array_sort(F.flatten(F.transform(rules_met(rules_by_keyword(rules)), lambda r: intervals(
        field(r, 3), field(r, 2).cast("int"), field(r, 1).cast("int")))))
    places = F.array_sort(F.concat(*(phrase_places(p, name) for name, p in phrases)))
    # as generated columns they are computed once, whatever is filtered or selected later
    met = F.col("_pieces").isNotNull()
    judged = judged.select(*(F.col(f"`{c}`") for c in keep), F.inline(F.array(F.struct(
        number_of_words(F.col("_parts")).alias("_n"), F.when(met, found).alias("_found"), F.when(met, places).alias("_places")))))
    confidence = F.create_map(*(F.lit(x) for item in CONFIDENCE.items() for x in item))
    named = F.transform(uncontained(F.col("_found"), levels), lambda d: F.struct(
        d["first"].alias("first"), d["last"].alias("last"), d["rule"].alias("rule"),
        F.element_at(labels, d["rule"] + 1).alias("label"), (-d["level"]).alias("level"), confidence[-d["level"]].alias("confidence")))
    nothing = F.array().cast("array<struct<first:int,last:int,rule:int,label:string,level:int,confidence:double>>")
    return judged.select(
        *(F.col(f"`{c}`") for c in keep),
        F.col("_n").cast("long").alias("n_words"),
        F.coalesce("_places", F.array().cast("array<struct<first:int,label:string>>")).alias("places"),
        F.when(F.size("_found") > 0, named).otherwise(nothing).alias("detections"),
    )


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Counts, places, labels and the score (the highest confidence) of each scanned row."""
    places, found = F.col("places"), F.col("detections")
    return scanned.select(
        *(F.col(f"`{c}`") for c in scanned.columns if c not in ("places", "detections")),
        F.size(places).cast("long").alias("n_base"),
        F.get(places, F.lit(0))["first"].cast("long").alias("first_word"),
        F.get(places, F.size(places) - 1)["first"].cast("long").alias("last_word"),
        joined(places["label"]).alias("base_labels"),
        joined(F.concat(places["label"], found["label"])).alias("labels"),
        F.coalesce(F.array_max(found["confidence"]), F.lit(0.0)).alias("score"),
        F.size(found).cast("long").alias("n_detections"),
    )
