"""Text of nested values that doesn't depend on the order of keys, its digest, maps merged, and trials grouped by what they try."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .indicators import c


def quoted(x: Column) -> Column:
    """x as a JSON string; letters beyond ASCII stay as they are."""
    whole = F.to_json(F.struct(x.cast("string").alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def canonical_json(x: Column | str, of: T.DataType, item: str = ",", colon: str = ":") -> Column:
    """JSON text of x, whose type is `of`: keys of structs and maps in their order as text, unknown values as null (fields and entries stay), decimals and stamps as text."""
    x = c(x)
    sub = lambda v, t: canonical_json(v, t, item, colon)
    if isinstance(of, T.StructType):
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + colon), sub(x.getField(f.name), f.dataType)) for f in sorted(of.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(item, *parts), F.lit("}"))
    elif isinstance(of, T.MapType):
        entry = lambda k: F.concat(quoted(k), F.lit(colon), sub(F.element_at(x, k), of.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(x)), entry), item), F.lit("}"))
    elif isinstance(of, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: sub(v, of.elementType)), item), F.lit("]"))
    elif isinstance(of, (T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType)):
        text = x.cast("string")
    else:
        text = quoted(x)
    return F.when(x.isNull(), "null").otherwise(text)


def digest(x: Column | str, of: T.DataType) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical_json(x, of), 256)


def merged(a: Column | str, b: Column | str) -> Column:
    """Map of both maps' entries; b's value wins where it is known. An unknown map has none."""
    empty = lambda m, other: F.coalesce(c(m), F.map_filter(c(other), lambda k, v: F.lit(False)))
    return F.when(c(a).isNotNull() | c(b).isNotNull(), F.map_zip_with(empty(a, b), empty(b, a), lambda k, x, y: F.coalesce(y, x)))


def looked_up(m: Column | str, key: str, default: Column) -> Column:
    return F.coalesce(F.try_element_at(c(m), F.lit(key)), default)


def fingerprint(family: Column | str, mechanism: Column | str, features: Column | str, keys: Column | str) -> Column:
    """Twelve digits shared by trials of one family, mechanism, set of features and names of parameters, whatever the parameters' values and the order of both lists."""
    text, names = T.StringType(), T.ArrayType(T.StringType())
    some = lambda x: F.array_sort(F.coalesce(c(x), F.array().cast("array<string>")))
    fields = {"family": F.coalesce(c(family), F.lit("")), "features": some(features), "mechanism": F.coalesce(c(mechanism), F.lit("")), "param_keys": some(keys)}
    parts = [F.concat(F.lit(f'"{n}": '), canonical_json(x, names if n in ("features", "param_keys") else text, ", ", ": ")) for n, x in fields.items()]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 12)


def clusters(trials: DataFrame) -> DataFrame:
    """(fingerprint, trials) of trials (family, mechanism, features, params): variations of one idea are one cluster."""
    f = fingerprint("family", "mechanism", "features", F.map_keys("params"))
    return trials.groupBy(f.alias("fingerprint")).agg(F.count(F.lit(1)).alias("trials"))


def novelty(trials: DataFrame) -> DataFrame:
    """One row (total_trials, distinct_hypotheses, largest_cluster): 0 each for none. Clusters are counted where they are, before one row is left."""
    g = clusters(trials).agg(F.sum("trials").alias("n"), F.count(F.lit(1)).alias("distinct_hypotheses"), F.max("trials").alias("m"))
    return g.select(F.coalesce("n", F.lit(0)).alias("total_trials"), "distinct_hypotheses", F.coalesce("m", F.lit(0)).alias("largest_cluster"))
