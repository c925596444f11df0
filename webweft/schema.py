"""Declared schemas; nothing is inferred."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _fields(**kinds):
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


PAGE = _fields(page_id=LongType(), title=StringType(), is_redirect=BooleanType())
REDIRECT = _fields(rd_from=LongType(), rd_title=StringType())
PAGELINK = _fields(pl_from=LongType(), pl_title=StringType())
VERTEX = _fields(id=LongType(), title=StringType())
EDGE = _fields(src=LongType(), dst=LongType())
TITLE = _fields(title=StringType(), id=LongType(), kind=StringType())
RANK = _fields(id=LongType(), rank=DoubleType())
LEVEL = _fields(id=LongType(), level=IntegerType())
#: A line of the JSON interchange: neighbours as parents only, both, children only; the
#: first ``last_parent`` are parents, those from ``first_child`` on are children.
ADJACENCY = _fields(id=LongType(), title=StringType(), neighbors=ArrayType(LongType(), False), last_parent=LongType(), first_child=LongType())
