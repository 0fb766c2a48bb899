"""Detections as rows: the view over ``events``, the nested document form, and optional scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nested form of one frame of detections.
FRAME = T.StructType(
    [
        T.StructField("frame", T.LongType()),
        T.StructField(
            "boxes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("xyxy", T.ArrayType(T.DoubleType())),
                        T.StructField("class_id", T.LongType()),
                        T.StructField("class_name", T.StringType()),
                        T.StructField("track_id", T.LongType()),
                        T.StructField("conf", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)

#: The same view as ``detections``, for DuckDB.
DET_SQL = """
SELECT event_id, sec, sec // 600 AS frame, k, user_id, event_type,
  CASE WHEN event_type = 'error' THEN 32 ELSE 0 END AS class_id,
  CASE WHEN event_type = 'error' THEN 'puck' WHEN event_type = 'signup' THEN 'goaltender' ELSE 'player' END AS class_name,
  CASE WHEN k % 20 = 0 THEN -1 ELSE user_id * 10 + sec // 432000 END AS track_id,
  user_id % 2 AS team_id, CAST(round(value * 100) AS BIGINT) AS conf_c, user_id % 16 AS run_id,
  k * 10 AS x1, (user_id % 50) * 10 AS y1, k * 10 + 40 + user_id % 20 AS x2, (user_id % 50) * 10 + 80 + k % 40 AS y2,
  CAST(CASE WHEN k % 4 = 0 THEN k ELSE user_id % 40 END AS VARCHAR) AS num
FROM (SELECT event_id, user_id, event_type, value, (epoch_us(ts) - 1704067200000000) // 1000000 AS sec,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
"""


def seconds(ts: str) -> str:
    """Whole seconds since the start of 2024, whatever the session's time zone."""
    return f"datediff(cast({ts} as date), date'2024-01-01') * 86400L + hour({ts}) * 3600L + minute({ts}) * 60L + cast(second({ts}) as bigint)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections view over ``events``; columns and filters reach the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.selectExpr("event_id", "user_id", "event_type", "value", f"{seconds('ts')} as sec", "cast(get_json_object(props, '$.k') as bigint) as k")
    return e.selectExpr(
        "event_id", "sec", "sec div 600 as frame", "k", "user_id", "event_type",
        "case when event_type = 'error' then 32 else 0 end as class_id",
        "case when event_type = 'error' then 'puck' when event_type = 'signup' then 'goaltender' else 'player' end as class_name",
        "case when k % 20 = 0 then -1 else user_id * 10 + sec div 432000 end as track_id",
        "user_id % 2 as team_id", "cast(round(value * 100) as bigint) as conf_c", "user_id % 16 as run_id",
        "k * 10 as x1", "(user_id % 50) * 10 as y1", "k * 10 + 40 + user_id % 20 as x2", "(user_id % 50) * 10 + 80 + k % 40 as y2",
        "cast(case when k % 4 = 0 then k else user_id % 40 end as string) as num",
    )


def tracked(det: DataFrame) -> DataFrame:
    """Persons that have a track."""
    return det.where("class_id = 0 and track_id >= 0")


def to_documents(det: DataFrame) -> DataFrame:
    """One JSON document for each frame, boxes in order of ``event_id``."""
    box = F.struct(
        "event_id", F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("xyxy"),
        "class_id", "class_name", "track_id", (F.col("conf_c") / 100).alias("conf"),
    )
    frames = det.groupBy("frame").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    return frames.select(F.to_json(F.struct("frame", F.transform("boxes", lambda b: b.dropFields("event_id")).alias("boxes"))).alias("doc"))


def from_documents(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Rows of nested documents; the box's place in its frame survives as ``box_pos``."""
    frames = docs.select(F.from_json(column, FRAME).alias("f")).select("f.frame", F.posexplode("f.boxes").alias("box_pos", "b"))
    return frames.select(
        "frame", "box_pos", "b.class_id", "b.class_name", "b.track_id", "b.conf",
        *[F.col("b.xyxy")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
    )


def read_documents(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Detections of a folder of JSON documents: one a file, on any number of lines, or one a line."""
    return from_documents(spark.read.text(path, wholetext=whole).withColumnRenamed("value", "doc"))


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def scan(det: DataFrame, classes: list[int], conf_floor: Column, stride: int) -> DataFrame:
    """A detector's scan options as filters: classes, a floor of the confidence, every ``stride``-th frame."""
    return det.where(F.col("class_id").isin(classes) & (F.col("conf_c") >= conf_floor) & (F.col("frame") % stride == 0))


def needed_frames(frames: DataFrame, needed: DataFrame) -> DataFrame:
    """Frames of a stream that are asked for; the scan ends at the last of them."""
    last = needed.agg(F.max("frame").alias("last"))
    return frames.join(F.broadcast(last), F.col("frame") <= F.col("last")).drop("last").join(needed.select("frame").distinct(), "frame", "left_semi")


def sample_frames(totals: DataFrame, n: int, total: str = "total") -> DataFrame:
    """Numbers ``i`` and indices of ``n`` evenly spaced frames, the first and the last included."""
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col(total) - 1) / max(n - 1, 1)).cast("bigint"))
    return totals.select("*", F.posexplode(at).alias("i", "frame"))
