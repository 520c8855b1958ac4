"""Fixed schemas of the data model.

A tensor cell carries four axis ids; an absent leading axis holds -1.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDS = ["id_1", "id_2", "id_3", "id_4"]
ABSENT = -1

MATRIX = T.StructType(
    [T.StructField(c, T.LongType()) for c in IDS] + [T.StructField("value", T.DoubleType())]
)

MATRIX_2D = T.StructType(
    [T.StructField(c, T.LongType()) for c in IDS[2:]] + [T.StructField("value", T.DoubleType())]
)

FEATUREMAP = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("layer_name", T.StringType()),
        T.StructField(
            "feature_map",
            T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
        ),
    ]
)

_LAYER = [
    T.StructField("dataset", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("layer_name", T.StringType()),
]

THRESHOLDS = T.StructType(
    _LAYER + [T.StructField("unit_id", T.IntegerType()), T.StructField("thresh", T.DoubleType())]
)

TALLY_RESULT = T.StructType(
    _LAYER
    + [
        T.StructField("unit_id", T.IntegerType()),
        T.StructField("semantic_label", T.StringType()),
    ]
)


def to_4d(mat_2d: DataFrame) -> DataFrame:
    """2-D cells with the absent leading axes filled in."""
    absent = F.lit(ABSENT).cast("long")
    return mat_2d.select(absent.alias("id_1"), absent.alias("id_2"), "id_3", "id_4", "value")


def to_matrix(cells: DataFrame) -> DataFrame:
    """Unit-map cells ``(img, unit, y, x, v)`` under the generic axis names."""
    return cells.select(
        F.col("img").cast("long").alias("id_1"),
        F.col("unit").cast("long").alias("id_2"),
        F.col("y").cast("long").alias("id_3"),
        F.col("x").cast("long").alias("id_4"),
        F.col("v").cast("double").alias("value"),
    )


def to_cells(mat: DataFrame) -> DataFrame:
    """Inverse of :func:`to_matrix`."""
    return mat.select(
        F.col("id_1").alias("img"),
        F.col("id_2").alias("unit"),
        F.col("id_3").alias("y"),
        F.col("id_4").alias("x"),
        F.col("value").alias("v"),
    )
