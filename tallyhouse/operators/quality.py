"""Audits over whole tables: row rules, domains, keys, references, schema drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..functions.fixed_values import MANUAL_GRADES


def validate_rows(df: DataFrame, rules: dict[str, Column], name: str = "reasons") -> DataFrame:
    """Add the names of the rules a row breaks.  A rule is true where broken;
    null counts as not broken, so rules on missing values test for null."""
    broken = [F.when(condition, F.lit(reason)) for reason, condition in rules.items()]
    return df.withColumn(name, F.array_compact(F.array(*broken)))


def quarantine(checked: DataFrame, name: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(valid rows, broken rows)."""
    return checked.filter(F.size(name) == 0).drop(name), checked.filter(F.size(name) > 0)


def review_rules(product: str = "product_id", rating: str = "rating", content: str = "content") -> dict[str, Column]:
    body = F.col(content)
    length = text.utf16_length(text.trimmed(body))
    return {
        "missing": F.col(product).isNull() | F.col(rating).isNull() | text.is_blank(body),
        "rating_range": ~F.col(rating).between(1, 5),
        "too_short": ~text.is_blank(body) & (length < 10),
        "too_long": length > 1000,
    }


def fingerprint_rules(column: str = "fingerprint") -> dict[str, Column]:
    value = F.col(column)
    return {"missing": F.coalesce(value, F.lit("")) == "", "too_long": text.utf16_length(value) > 100}


def product_rules() -> dict[str, Column]:
    return {
        "name": text.is_blank(F.col("name")),
        "price": F.coalesce(F.col("price"), F.lit(0)) == 0,
        "category": F.coalesce(F.col("category"), F.lit("")) == "",
    }


def coupon_event_rules() -> dict[str, Column]:
    return {
        "missing": F.coalesce("name", F.lit("")).eqNullSafe("") | F.col("discount_type").isNull()
        | (F.coalesce("discount_value", F.lit(0)) == 0) | F.col("start_date").isNull() | F.col("end_date").isNull(),
        "discount_type": ~F.col("discount_type").isin("percent", "amount", "fixed"),
        "window": F.col("end_date") < F.col("start_date"),
    }


def registration_rules(login: str = "login_id", password_length: str = "password_length", name: str = "name",
                       email: str = "email") -> dict[str, Column]:
    size = text.utf16_length(text.trimmed(F.col(name)))
    return {
        "missing": text.is_blank(F.col(login)) | text.is_blank(F.col(name)) | text.is_blank(F.col(email)),
        "login_id": ~text.is_login_id(text.trimmed(F.col(login))),
        "password": ~F.col(password_length).between(8, 20),
        "name": ~size.between(2, 40),
    }


def check_domains(df: DataFrame, domains: dict[str, Column]) -> DataFrame:
    """One pass: rows, and rows outside each domain.  A domain is true where allowed."""
    bad = [F.count_if(~F.coalesce(allowed, F.lit(True))).alias(name) for name, allowed in domains.items()]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *bad)


def grade_domain(column: str = "manual_grade") -> Column:
    return F.col(column).isNull() | F.col(column).isin(MANUAL_GRADES)


def ascending_limits(sprout: str = "sprout_max", regular: str = "regular_max", vip: str = "vip_max") -> Column:
    return (F.col(sprout) > 0) & (F.col(sprout) < F.col(regular)) & (F.col(regular) < F.col(vip))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def check_unique(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per declared key: keys that repeat, and rows beyond the first of each."""
    reports = [
        duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("repeated_keys"),
                                     F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_rows"))
        .select(F.lit(name).alias("key_name"), "repeated_keys", "extra_rows")
        for name, (df, keys) in tables.items()]
    return reduce(DataFrame.unionByName, reports)


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent and their rows.  Rows are counted per key
    before the join, so a hot key is one row in it; null keys are no orphans."""
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_key")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))
    return keys.join(parent.select(F.col(parent_key).cast(keys.schema["_key"].dataType).alias("_key")), "_key", "left_anti")


def check_foreign_keys(references: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per declared reference: orphan keys and orphan rows."""
    reports = [
        orphans(*reference).agg(F.count(F.lit(1)).alias("orphan_keys"),
                                F.coalesce(F.sum("n_rows"), F.lit(0)).alias("orphan_rows"))
        .select(F.lit(name).alias("reference"), "orphan_keys", "orphan_rows")
        for name, reference in references.items()]
    return reduce(DataFrame.unionByName, reports)


def schema_drift(df: DataFrame, expected: StructType) -> DataFrame:
    """Per expected or found column: state, types and non-null rows, in one pass over the data."""
    wanted = {f.name: f.dataType.simpleString() for f in expected}
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    names = list(wanted) + [n for n in found if n not in wanted]

    def state(n):
        if n not in found:
            return "missing"
        if n not in wanted:
            return "added"
        return "ok" if wanted[n] == found[n] else "retyped"

    counts = df.agg(*[(F.count(F.col(n)) if n in found else F.lit(0).cast("bigint")).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(state(n)).alias("state"),
                              F.lit(wanted.get(n)).cast("string").alias("expected_type"),
                              F.lit(found.get(n)).cast("string").alias("found_type"),
                              F.col(n).alias("non_null_rows")) for n in names])
    return counts.select(F.inline(rows))
