"""Schemas of the tables that operators exchange. Positions are unsigned 32-bit numbers kept as LONG."""

from pyspark.sql import types as T

MAX_POSITION = 4294967295


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


EDGES = _struct(loc_a=T.LongType(), loc_b=T.LongType(), r=T.DoubleType())
POSITIONS = _struct(pos=T.LongType())
DEGREE = _struct(pos=T.LongType(), k_norm=T.DoubleType())
VALUE = _struct(value=T.DoubleType())
GENETIC_MAP = _struct(snp=T.StringType(), pos=T.LongType(), cm=T.DoubleType())
CHUNKS = _struct(start_bp=T.LongType(), end_bp=T.LongType(), buffer_end_bp=T.LongType())
OPT_SCORES = _struct(pos=T.LongType(), opt=T.DoubleType())
OPT_BREAKS = _struct(pos=T.LongType(), brk=T.LongType())
BLOCKS = _struct(block_start=T.LongType(), block_end=T.LongType())
PANEL = _struct(sample=T.StringType(), pop=T.StringType(), super_pop=T.StringType())
