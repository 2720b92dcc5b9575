"""Explicit schemas of the document model."""

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("fittable", T.BooleanType()),
        T.StructField("url", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)
TOKEN = T.StructType([T.StructField("form", T.StringType()), T.StructField("lemma", T.StringType()), T.StructField("xpostag", T.StringType())])
KEYWORD = T.StructType([T.StructField("term", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("effect_size", T.DoubleType()), T.StructField("count", T.LongType())])
THEME = T.StructType(
    [
        T.StructField("kulcs", T.StringType(), False),
        T.StructField("nev", T.StringType(), False),
        T.StructField("leiras", T.StringType()),
        T.StructField("allapot", T.StringType()),
        T.StructField("magok", T.ArrayType(T.StringType())),
        T.StructField("korabbi_nevek", T.ArrayType(T.StringType())),
        T.StructField("atiranyitas", T.StringType()),
        T.StructField("eredet", T.MapType(T.StringType(), T.StringType())),
    ]
)
EXTERNAL_ROW = T.StructType([T.StructField("cim", T.StringType()), T.StructField("datum", T.DateType()), T.StructField("link", T.StringType()), T.StructField("lead", T.StringType()), T.StructField("cimkek", T.ArrayType(T.StringType()))])
#: States that a theme can be in: active, proposed, retired.
THEME_STATES = ("aktiv", "javaslat", "megszunt")
