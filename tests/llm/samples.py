"""Texts and tables the tests share."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for their own columns.
        *[T.StructField(c, T.StringType()) for c in ("row", "rules_", "id", "th", "gone", "slot", "place", "n", "shard", "comp", "band", "line")],
    ]
)
SENTENCE = "It was a long and quiet evening by the river when the two of them came back from the hills with the old dog."
TEXT = "\n".join([SENTENCE, *(" ".join(f"part{k}of{j * j % 29 + j}" for j in range(20)) + "." for k in range(3))])


def table(spark, texts):
    """texts: (doc_id, text) pairs; other columns are null now and then."""
    rows = [(d, t, None if i % 3 else "en", "web", None if t is None else len(t), *("x",) * 12) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
