"""Fixed schemas of the relations this package reads and writes."""

from pyspark.sql import types as T

LINKS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("manual_tags", T.ArrayType(T.StringType())),
    T.StructField("user_id", T.StringType()),
    T.StructField("team_id", T.StringType()),
    T.StructField("channel_id", T.StringType()),
    T.StructField("is_private", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

TEAM_TAGS = T.StructType([
    T.StructField("team_id", T.StringType()),
    T.StructField("tag_name", T.StringType()),
    T.StructField("usage_count", T.LongType()),
    T.StructField("last_used", T.TimestampType()),
])

# A save or search command as it arrives from the chat side.  seq and sent_at give the order and time of arrival.
COMMANDS = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("command", T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("team_id", T.StringType()),
        T.StructField("channel_id", T.StringType()),
        T.StructField("response_url", T.StringType()),
    ])),
    T.StructField("seq", T.LongType()),
    T.StructField("sent_at", T.TimestampType()),
])

REQUESTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("manual_tags", T.ArrayType(T.StringType())),
    T.StructField("user_id", T.StringType()),
    T.StructField("team_id", T.StringType()),
    T.StructField("channel_id", T.StringType()),
    T.StructField("requested_at", T.TimestampType()),
])

PAGES = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("status_text", T.StringType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("fetched_at", T.TimestampType()),
])

REPLIES = T.StructType([
    T.StructField("link_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("reply", T.StringType()),
])

# The columns a lookup or search returns.
LINK_VIEW = ["id", "url", "title", "description", "tags", "user_id", "channel_id", "created_at", "updated_at"]
