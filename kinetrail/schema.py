"""Keys and schemas of point tables."""

from pyspark.sql import types as T

ENTITY = ["game_id", "play_id", "nfl_id"]
KEYS = [*ENTITY, "frame_id"]
#: Frames a second.
RATE = 10.0

_long, _double = T.LongType(), T.DoubleType()
KEY_FIELDS = [T.StructField(k, _long) for k in KEYS]
POINTS = T.StructType([*KEY_FIELDS, T.StructField("x", _double), T.StructField("y", _double)])
OBSERVED = T.StructType(
    [
        *POINTS.fields,
        T.StructField("ball_land_x", _double),
        T.StructField("ball_land_y", _double),
        T.StructField("num_frames_output", _long),
        T.StructField("player_role", T.StringType()),
    ]
)
REQUESTS = T.StructType(KEY_FIELDS)
PREDICTIONS = T.StructType([T.StructField("model", T.StringType()), *POINTS.fields])
SPLITS = T.StructType([T.StructField("game_id", _long), T.StructField("partition", T.StringType())])
#: Frames that a forecast can have.
LONGEST = 120
