"""Feature definitions: names, numbering, defaults, patterns, display and union.

Definitions are tables with a column pos; all operators are expressions or small joins, so
a table of any size works, though ordered numbering brings the definitions of one list together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_case

BATCH = 5

# What a definition's missing fields are filled with.
DEFAULTS = {"feature_group": "Biomarkers", "unit": "N/A", "reference": "summary", "fallback_category_1": "notes", "fallback_category_2": "diagnosis", "double_check": "no", "category": "Clinical category"}


def has_number(name: Column) -> Column:
    """Whether the last part of a name, by underscores, is a number and not the first part too."""
    return name.rlike("_[0-9]+$")


def number_of(name: Column) -> Column:
    """The number that a name ends in, also where it is the whole name; null without."""
    digits = F.nullif(F.regexp_extract(name, "(?:^|_)([0-9]+)$", 1), F.lit(""))
    return digits.try_cast("long")


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, "_[0-9]+$", "")


def highest_number(features: DataFrame) -> DataFrame:
    """One row with the highest number of all names, 0 without any."""
    return features.agg(F.coalesce(F.max(number_of(F.col("name"))), F.lit(0)).cast("long").alias("highest"))


def numbered(features: DataFrame, base: DataFrame, lower: bool = True) -> DataFrame:
    """features with underscores for spaces in the name, and unnumbered names numbered on from base's highest.

    Numbers begin anew above base's highest each time, since only base is looked at.
    """
    name = F.replace(F.coalesce("name", F.lit("")), F.lit(" "), F.lit("_"))
    rows = features.withColumn("name", F.lower(name) if lower else name).withColumn("_has", has_number(F.col("name")))
    ahead = F.sum((~F.col("_has")).cast("long")).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_n", ahead).crossJoin(F.broadcast(highest_number(base)))  # one row
    new = F.concat("name", F.lit("_"), (F.col("highest") + F.col("_n")).cast("string"))
    return rows.withColumn("name", F.when(F.col("_has"), F.col("name")).otherwise(new)).drop("_has", "_n", "highest")


def range_default(name: Column) -> Column:
    """The range that words of a name suggest; the first that fits."""
    low = F.lower(name)
    return F.when(low.contains("status"), "Positive, Negative, Unknown").when(low.contains("mutation"), "Mutated, Not Mutated, Unknown").when(low.contains("level") | low.contains("expression"), "0-100").otherwise("N/A")


def patterns_for(term: Column, categorical: Column, expected_range: Column) -> Column:
    """Two patterns for a term: with a value after it, and as a word; nothing is escaped."""
    values = F.array_join(F.transform(F.split(expected_range, ","), lambda v: F.trim(v)), "|")
    value = F.when(F.coalesce(categorical, F.lit(False)), F.concat(F.lit("("), values, F.lit(")"))).otherwise(F.lit("(.*?)"))
    return F.array(F.concat(F.lit("(?i)"), term, F.lit(r"[:\s]*"), value), F.concat(F.lit(r"(?i)\b"), term, F.lit(r"\b")))


def _filled(rows: DataFrame, value_of: dict[str, Column], falsy: bool) -> DataFrame:
    for column, value in value_of.items():
        now = F.nullif(F.col(column), F.lit("")) if falsy else F.col(column)
        rows = rows.withColumn(column, F.coalesce(now, value))
    return rows


def _spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def _question(name: Column) -> Column:
    return F.concat(F.lit("What is the "), _spaced(name), F.lit(" value?"))


def generated_defaults(features: DataFrame) -> DataFrame:
    """What a generated batch's missing fields become; a missing description stays missing."""
    name = F.lower("name")
    plain = {k: F.lit(v) for k, v in DEFAULTS.items()}
    rows = _filled(features, plain | {"expected_output_type": F.lit("categorical"), "input_prompt": _question(name), "expected_range": range_default(name), "search_everywhere": F.lit(True)}, falsy=False)
    made = patterns_for(_spaced(name), F.col("expected_output_type") == "categorical", F.col("expected_range"))
    return rows.withColumn("regex_patterns", F.coalesce("regex_patterns", made))


def saved_defaults(features: DataFrame) -> DataFrame:
    """What missing fields become when an entity's definitions are saved; names get underscores."""
    unnamed = F.concat(F.lit("unknown_feature_"), (F.col("pos") + 1).cast("string"))
    rows = features.withColumn("name", F.replace(F.coalesce("name", unnamed), F.lit(" "), F.lit("_")))
    plain = {k: F.lit(v) for k, v in DEFAULTS.items()}
    rows = _filled(rows, plain | {"description": F.concat(F.lit("Description for "), F.col("name")), "expected_output_type": F.lit("string"), "input_prompt": _question(F.col("name")), "expected_range": F.lit("N/A"), "search_everywhere": F.lit(True)}, falsy=False)
    return rows.withColumn("regex_patterns", F.coalesce("regex_patterns", patterns_for(_spaced(F.col("name")), F.lit(False), F.lit(""))))


def combined(base: DataFrame, entity: DataFrame) -> DataFrame:
    """base as it is, then entity's definitions numbered and filled; legacy type is parsed and dropped.

    Empty fields count as missing here.  A type such as "Numeric (unit, range)" gives kind, unit and range.
    """
    rows = numbered(entity, base, lower=False)
    kind, low = F.col("type"), F.lower("type")
    of_type = F.when(kind.isNull(), F.lit("string")).when(low.contains("categorical"), "categorical").when(low.contains("numeric"), "numeric").otherwise("string")
    rows = _filled(rows, {"description": F.concat(F.lit("Description for "), F.col("name")), "feature_group": F.lit(DEFAULTS["feature_group"]), "expected_output_type": of_type, "unit": F.lit(DEFAULTS["unit"])}, falsy=True)
    inside = F.when(kind.rlike(r"\((.*?)\)"), F.regexp_extract(kind, r"\((.*?)\)", 1))
    two = F.contains(inside, F.lit(",")) & (F.col("expected_output_type") == "numeric")
    empty = F.coalesce("expected_range", F.lit("")) == ""
    part = lambda i: F.trim(F.get(F.split(inside, ","), F.lit(i)))
    rows = rows.withColumn("_unit", F.when(empty & F.coalesce(two, F.lit(False)), part(0)).otherwise(F.col("unit")))
    rows = rows.withColumn("expected_range", F.when(empty, F.when(two, part(1)).otherwise(F.coalesce(inside, range_default(F.col("name"))))).otherwise(F.col("expected_range"))).withColumn("unit", F.col("_unit")).drop("_unit")
    rows = _filled(rows, {"input_prompt": _question(base_name(F.col("name"))), **{k: F.lit(v) for k, v in DEFAULTS.items() if k not in ("feature_group", "unit")}}, falsy=True)
    rows = rows.withColumn("search_everywhere", F.coalesce("search_everywhere", F.lit(True)))
    made = patterns_for(_spaced(base_name(F.col("name"))), F.col("expected_output_type") == "categorical", F.col("expected_range"))
    rows = rows.withColumn("regex_patterns", F.when(F.coalesce(F.size("regex_patterns"), F.lit(0)) > 0, F.col("regex_patterns")).otherwise(made))
    first = base.withColumn("_part", F.lit(0)).drop("type")
    both = first.unionByName(rows.withColumn("_part", F.lit(1)).drop("type"), allowMissingColumns=True)
    return both.withColumn("pos", (F.row_number().over(Window.orderBy("_part", "pos")) - 1).cast("int")).drop("_part")


def base_names(features: DataFrame) -> DataFrame:
    """kind ("base" or "full") and name: full names and what stands before the first underscore, in lower case."""
    low = F.lower(F.coalesce("name", F.lit("")))
    kinds = F.array(F.struct(F.lit("base").alias("kind"), F.split_part(low, F.lit("_"), F.lit(1)).alias("name")), F.struct(F.lit("full").alias("kind"), low.alias("name")))
    return features.select(F.explode(kinds).alias("x")).select("x.*").distinct()


def suggested_names(features: DataFrame) -> DataFrame:
    """name: base names of features with underscores, and with spaces."""
    low = F.lower(F.coalesce("name", F.lit("")))
    base = F.when(has_number(low), base_name(low)).otherwise(F.split_part(low, F.lit("_"), F.lit(1)))
    forms = F.array(base, F.replace(base, F.lit("_"), F.lit(" ")), F.replace(base, F.lit(" "), F.lit("_")))
    return features.select(F.explode(forms).alias("name")).distinct()


def names_to_avoid(features: DataFrame, suggested: DataFrame) -> DataFrame:
    """name: everything that a new feature shouldn't be called."""
    return base_names(features).select("name").union(suggested_names(features)).union(suggested.select(F.lower("name"))).distinct()


def without_known(new: DataFrame, avoid: DataFrame) -> DataFrame:
    """New features whose base name isn't to be avoided."""
    key = base_name(F.lower(F.replace(F.col("name"), F.lit(" "), F.lit("_"))))
    return new.withColumn("_key", key).join(avoid.select(F.col("name").alias("_key")).distinct(), "_key", "left_anti").select(new.columns)


def sorted_names(names: DataFrame) -> DataFrame:
    """One row: the distinct names in order, joined for a prompt."""
    return names.agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))


def batch_range(batch_number: Column) -> Column:
    """First and last feature number of a batch."""
    start = (batch_number - 1) * BATCH
    return F.struct((start + 1).alias("first"), (start + BATCH).alias("last"))


def batch_of(features: DataFrame, batch_number: int) -> DataFrame:
    """One row: a batch's number, features, count and error."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*[c for c in features.columns if c != "pos"]).alias("f")))), lambda x: x["f"])
    return features.agg(F.lit(batch_number).alias("batch_number"), listed.alias("entity_specific_features"), F.count("*").cast("int").alias("entity_feature_count"), F.lit(None).cast("string").alias("error"))


def batch_names(batches: DataFrame) -> DataFrame:
    """batches with the names of their features."""
    return batches.withColumn("names", F.transform("entity_specific_features", lambda f: F.coalesce(f["name"], F.lit(""))))


def display_name(name: Column) -> Column:
    """A name without its number, with spaces, each word capitalised."""
    bare = F.when(has_number(name), base_name(name)).otherwise(name)
    return title_case(F.trim(F.regexp_replace(_spaced(bare), " +", " ")))


def display_feature(name: Column, description: Column, kind: Column, unit: Column, expected_range: Column) -> Column:
    """The lines in which one feature is shown."""
    low, none = F.lower(kind), F.lit("")
    detail = F.when(low == "categorical", F.concat(F.lit(" ("), F.coalesce(expected_range, none), F.lit(")"))).when((low == "numeric") & (F.coalesce(unit, none) != ""), F.concat(F.lit(" ("), unit, F.lit(", "), F.coalesce(expected_range, none), F.lit(")"))).otherwise(none)
    return F.concat(F.lit("* **"), display_name(F.coalesce(name, none)), F.lit("**\n   * Description: "), F.coalesce(description, none), F.lit("\n   * Type: "), title_case(F.coalesce(kind, none)), F.coalesce(detail, none), F.lit("\n"))


def display_batch(features: DataFrame) -> DataFrame:
    """One row: all features of a list as shown to a reader."""
    one = display_feature(F.col("name"), F.col("description"), F.col("expected_output_type"), F.col("unit"), F.col("expected_range"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("t")))), lambda x: x["t"]), "\n")
    return features.agg(F.when(F.count("*") > 0, text).otherwise("No features available.").alias("shown"))


def config_name(entity: str) -> str:
    """The file name of an entity's definitions."""
    return entity.lower().replace(" ", "_") + "_feature_config.json"
