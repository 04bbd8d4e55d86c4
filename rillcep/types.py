"""Attribute types and their Spark counterparts."""

from __future__ import annotations

from pyspark.sql import types as T

from rillcep.errors import AnalysisError

#: Attribute type -> Spark type. Every other Spark type is `object`.
SPARK = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType()}
#: Numeric types from narrow to wide.
NUMERIC = ("int", "long", "float", "double")


class TypeRegistry:
    """Attribute type of each Spark type; more can be registered once."""

    def __init__(self):
        self._names = {v.typeName(): k for k, v in SPARK.items()} | {"short": "int", "byte": "int"}

    def register(self, spark_type: T.DataType, name: str) -> None:
        if spark_type.typeName() in self._names:
            raise ValueError(f"{spark_type.typeName()} is registered already")
        if name not in SPARK:
            raise ValueError(f"unknown attribute type {name}")
        self._names[spark_type.typeName()] = name

    def name_of(self, spark_type: T.DataType) -> str:
        return self._names.get(spark_type.typeName(), "object")


REGISTRY = TypeRegistry()


def attribute_type(spark_type: T.DataType) -> str:
    return REGISTRY.name_of(spark_type)


def wider(a: str, b: str) -> str:
    """Type of arithmetic between two types; anything that isn't a number is an error."""
    if a not in NUMERIC or b not in NUMERIC:
        raise AnalysisError(f"arithmetic between {a} and {b}")
    return NUMERIC[max(NUMERIC.index(a), NUMERIC.index(b))]
