"""Rule configuration from files: the class map (CSV) and exclusion lists (text lines)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utilscope.functions.text import normalize_text
from utilscope.rules import COMPONENTS, Combination, ScoreWeights, Term

CLASS_MAP_SCHEMA = T.StructType([
    T.StructField("match_term", T.StringType()),
    T.StructField("component_class", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("notes", T.StringType()),
])


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """Class map rows with an integer priority; a malformed row fails."""
    return (
        spark.read.schema(CLASS_MAP_SCHEMA).option("header", True).option("mode", "FAILFAST")
        .csv(path)
    )


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalized terms of a line list; blank lines and '#' comments are skipped."""
    line = F.trim("value")
    kept = spark.read.text(path).filter((line != "") & ~F.startswith(line, F.lit("#")))
    terms = kept.select(normalize_text(F.col("value")).alias("term"))
    return terms.filter(F.col("term") != "").distinct()


def load_terms(spark: SparkSession, path: str) -> tuple[Term, ...]:
    """Class map as rule terms.  Equal priorities keep the order of the file's lines."""
    rows = read_class_map(spark, path).collect()
    return tuple(Term(r["match_term"], r["component_class"], r["priority"]) for r in rows)


def load_term_list(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(sorted(r["term"] for r in read_term_list(spark, path).collect()))


def load_lines(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Trimmed lines as they stand, such as class names or state codes; blank and '#' lines are skipped."""
    lines = [r["value"].strip() for r in spark.read.text(path).collect()]
    return tuple(line for line in lines if line and not line.startswith("#"))


def load_combinations(spark: SparkSession, path: str) -> tuple[Combination, ...]:
    """CSV of requires (classes joined by '|') and label_class; earlier lines win."""
    schema = "requires string, label_class string"
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
    rows = reader.csv(path).collect()
    return tuple(Combination(tuple(r["requires"].split("|")), r["label_class"]) for r in rows)


def load_weights(spark: SparkSession, path: str) -> ScoreWeights:
    """JSON object of scenarios, each with the weight of every component."""
    scenarios = json.loads(spark.read.text(path, wholetext=True).first()[0])
    for name, weights in scenarios.items():
        if set(weights) != set(COMPONENTS):
            raise ValueError(f"scenario {name!r} needs the weights of {', '.join(COMPONENTS)}")
    return ScoreWeights({name: {c: float(w) for c, w in weights.items()} for name, weights in scenarios.items()})
