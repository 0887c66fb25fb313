"""Checks of a dataset's structure and of attribute conventions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.matrix import COL, MAIN, ROW, AnnotatedMatrix

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def check(self, ok: bool, message: str) -> bool:
        if not ok:
            self.errors.append(message)
        return ok

    def warn(self, ok: bool, message: str) -> None:
        if not ok:
            self.warnings.append(message)


def structure_counts(matrix: AnnotatedMatrix) -> DataFrame:
    """(part, problem, n): numbers of faults in layers, attribute tables and graphs, all in
    one plan; rows with n = 0 are sound."""
    out = []

    def add(part, problem, df):
        out.append(df.select(F.lit(part).alias("part"), F.lit(problem).alias("problem"), F.col("n").cast("long").alias("n")))

    for name, e in matrix.layers.items():
        part = f"layer {name!r}"
        outside = (F.col(ROW) < 0) | (F.col(COL) < 0) | (F.col(ROW) >= matrix.n_rows) | (F.col(COL) >= matrix.n_cols)
        add(part, "outside the shape", e.agg(F.count_if(outside).alias("n")))
        value = F.col("value").cast("double")
        add(part, "not finite", e.agg(F.count_if(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).alias("n")))
        add(part, "repeated coordinates", e.groupBy(ROW, COL).count().agg(F.count_if(F.col("count") > 1).alias("n")))
    for axis in (0, 1):
        ix, table, n = matrix.axis(axis)
        add("rows" if axis == 0 else "columns", "positions not 0..n-1 once", table.agg((F.abs(F.count("*") - n) + F.abs(F.count_distinct(ix) - n) + F.count_if((F.col(ix) < 0) | (F.col(ix) >= n))).alias("n")))
        for name, g in (matrix.row_graphs if axis == 0 else matrix.col_graphs).items():
            add(f"graph {name!r}", "ends outside the axis", g.agg(F.count_if((F.col("a") < 0) | (F.col("b") < 0) | (F.col("a") >= n) | (F.col("b") >= n)).alias("n")))
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union


def validate_schema(matrix: AnnotatedMatrix) -> Report:
    """What the schemas show; reads no data."""
    report = Report()
    report.check(MAIN in matrix.layers, "the main layer is missing")
    for name, e in matrix.layers.items():
        report.check(isinstance(e.schema["value"].dataType, T.NumericType), f"layer {name!r} is not numeric")
    for graphs in (matrix.row_graphs, matrix.col_graphs):
        for name, g in graphs.items():
            good = set(g.columns) >= {"a", "b", "w"} and isinstance(g.schema["a"].dataType, INTEGERS) and isinstance(g.schema["b"].dataType, INTEGERS) and isinstance(g.schema["w"].dataType, (T.FloatType, T.DoubleType))
            report.check(good, f"graph {name!r} needs integers a, b and a float w")
    for axis in (0, 1):
        ix, table, _ = matrix.axis(axis)
        report.check(ix in table.columns and isinstance(table.schema[ix].dataType, INTEGERS), f"{ix} is missing or no integer")
    return report


def validate_spec(matrix: AnnotatedMatrix) -> Report:
    """Types by schema, then one job of counts over all data."""
    report = validate_schema(matrix)
    if not report.errors:
        for r in structure_counts(matrix).where("n > 0").collect():
            report.check(False, f"{r.part}: {r.problem} ({r.n})")
    return report


def convention_counts(matrix: AnnotatedMatrix) -> DataFrame:
    """(attribute, problem, n) of the attributes that exist; n = 0 is sound."""
    out = []

    def add(attribute, problem, df):
        out.append(df.select(F.lit(attribute).alias("attribute"), F.lit(problem).alias("problem"), F.col("n").cast("long").alias("n")))

    cols, rows = matrix.cols, matrix.rows
    if "ClusterID" in cols.columns:
        add("ClusterID", "not 0, 1, 2, ... without gaps", cols.agg((F.abs(F.count_distinct("ClusterID") - F.max("ClusterID") - 1) + F.abs(F.min("ClusterID"))).alias("n")))
        if "ClusterName" in cols.columns:
            pairs = cols.select("ClusterID", "ClusterName").distinct()
            add("ClusterName", "not one to one with ClusterID", pairs.agg((2 * F.count("*") - F.count_distinct("ClusterID") - F.count_distinct("ClusterName")).alias("n")))
    for name, table in (("CellID", cols), ("Accession", rows)):
        if name in table.columns:
            add(name, "repeated values", table.agg((F.count("*") - F.count_distinct(name)).alias("n")))
    for name, table in (("Valid", cols), ("Outliers", cols), ("Valid", rows), ("Selected", rows)):
        if name in table.columns:
            add(name, "values other than 0 and 1", table.agg(F.count_if(~F.coalesce(F.col(name).isin(0, 1), F.lit(False))).alias("n")))
    if not out:
        return matrix.spark.createDataFrame([], "attribute string, problem string, n long")
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union


def validate_conventions(matrix: AnnotatedMatrix) -> Report:
    report = Report()
    for name in ("Description", "Journal", "Authors", "Title", "Year", "CreationDate"):
        report.warn(name in matrix.attrs, f"optional global {name!r} is missing")
    cols, rows = matrix.cols.schema, matrix.rows.schema
    kinds = {"string": T.StringType, "integer": INTEGERS}
    for schema, axis, name, kind, required in (
        (cols, "column", "ClusterID", "integer", True), (cols, "column", "ClusterName", "string", False), (cols, "column", "CellID", "string", True), (cols, "column", "Valid", "integer", False),
        (cols, "column", "Outliers", "integer", False), (rows, "row", "Accession", "string", True), (rows, "row", "Gene", "string", True), (rows, "row", "Valid", "integer", False), (rows, "row", "Selected", "integer", False),
    ):
        if name in schema.names:
            report.check(isinstance(schema[name].dataType, kinds[kind]), f"{axis} attribute {name!r} must be of type {kind}")
        elif required:
            report.check(False, f"{axis} attribute {name!r} is missing")
        else:
            report.warn(False, f"optional {axis} attribute {name!r} is missing")
    if not any("must be" in e for e in report.errors):
        for r in convention_counts(matrix).where("n > 0").collect():
            report.check(False, f"{r.attribute}: {r.problem} ({r.n})")
    return report


def validate(matrix: AnnotatedMatrix, strictness: str = "speconly") -> bool:
    """Is the structure sound and, with "conventions", are the attributes?"""
    report = validate_spec(matrix)
    if strictness == "conventions":
        more = validate_conventions(matrix)
        report.errors += more.errors
    return not report.errors
