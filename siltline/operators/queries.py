"""Queries and oracle SQL of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions.text import WHITE_SPACE, strip_white_space
from siltline.operators.history import instant_column, record_attributes, value_text, version_history
from siltline.operators.shred import KEYED, NESTED, ROOTS, flat_table, nested_rows
from siltline.operators.snapshot_diff import snapshot_changes
from siltline.sources.tables import read_table

#: The numbers of the snapshots that the tables consist of.
SNAPSHOTS = (1, 2, 3, 4)
ATTRIBUTES = ["title", "channel_id", "availability", "duration"]


def record_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the attributes of each video's metadata record."""
    records = record_attributes(read_table(spark, sf_dir, "metadata_records"), ATTRIBUTES, ["video_id", "record_id"])
    return version_history(records, ["video_id"], "at", ATTRIBUTES, ["record_id"])


def acquisition_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each video's acquisition state per provider and group."""
    states = read_table(spark, sf_dir, "acquisition_states").select(
        "video_id", "provider_key", "acquisition_group", F.unix_micros("captured_at").alias("at"), "outcome", instant_column("last_success_at").alias("last_success"), "failure_category"
    )
    return version_history(states, ["video_id", "provider_key", "acquisition_group"], "at", ["outcome", "last_success", "failure_category"])


def _seconds(column: str):
    return F.floor(F.col(column) / 1_000_000).cast("long").alias(column)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = record_versions(spark, sf_dir).select(F.lit("record").alias("track"), "video_id", F.lit("yt-dlp").alias("provider_key"), F.lit("detailed").alias("acquisition_group"), _seconds("valid_from"))
    states = acquisition_versions(spark, sf_dir).select(F.lit("acquisition").alias("track"), "video_id", "provider_key", "acquisition_group", _seconds("valid_from"))
    return records.unionByName(states)


def p2_record_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_versions(spark, sf_dir).select("video_id", *(value_text(a).alias(a) for a in ATTRIBUTES), _seconds("valid_from"), _seconds("valid_to"))


def p2_acquisition_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition_versions(spark, sf_dir).select("video_id", "provider_key", "acquisition_group", "outcome", _seconds("last_success"), "failure_category", _seconds("valid_from"), _seconds("valid_to"))


def entry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed videos that came or went between each snapshot and the one before."""
    entries = read_table(spark, sf_dir, "source_entries").select("snapshot_no", "source_url", strip_white_space("video_id").alias("video_id"))
    return snapshot_changes(entries, "snapshot_no", ["source_url", "video_id"], snapshots=SNAPSHOTS)


def observation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that came, went or changed; of several rows in a snapshot the latest counts, then the fullest."""
    latest = F.max(F.struct(F.col("last_observed_at").isNotNull().alias("known"), "last_observed_at", F.col("observed_entries").isNotNull().alias("counted"), "observed_entries"))
    one = read_table(spark, sf_dir, "source_observations").groupBy("snapshot_no", "source_url").agg(latest.alias("x")).select("snapshot_no", "source_url", "x.last_observed_at", "x.observed_entries")
    return snapshot_changes(one, "snapshot_no", ["source_url"], ["last_observed_at", "observed_entries"], snapshots=SNAPSHOTS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = observation_changes(spark, sf_dir).select("snapshot_no", "source_url", F.lit("").alias("video_id"), "change_kind")
    return entry_changes(spark, sf_dir).unionByName(observed)


def _nested(spark: SparkSession, sf_dir: str, attributes: bool) -> DataFrame:
    return nested_rows(read_table(spark, sf_dir, "metadata_records"), ["record_id"], "raw_json", attributes=attributes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir, False).select("record_id", "member_path", "pos_path")


def p5_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir, True).withColumn("attributes", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attributes")))))


def p5_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"format_id": "string", "ext": "string", "width": "bigint", "height": "bigint", "fps": "double", "vcodec": "string", "acodec": "string", "tbr": "double", "filesize": "bigint"}
    return flat_table(_nested(spark, sf_dir, True), ["record_id"], "formats", columns)


def p5_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_nested(spark, sf_dir, True), ["record_id"], "comments", {"id": "string", "author": "string", "text": "string"})


QUERIES = {
    "p2_found": p2_found,
    "p2_record_periods": p2_record_periods,
    "p2_acquisition_periods": p2_acquisition_periods,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_objects": p5_objects,
    "p5_formats": p5_formats,
    "p5_comments": p5_comments,
}

#: A DuckDB expression for the white space to strip.
SQL_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)

_STATES = """
WITH s AS (
  SELECT video_id, provider_key, acquisition_group, epoch_us(captured_at) AS ts_us, outcome, failure_category,
    epoch_us(CASE WHEN regexp_matches(last_success_at, '(Z|[+-][0-9][0-9]:[0-9][0-9])$')
      THEN CAST(last_success_at AS TIMESTAMPTZ) ELSE CAST(NULLIF(last_success_at, '') || '+00:00' AS TIMESTAMPTZ) END) AS last_success
  FROM acquisition_states),
l AS (SELECT *, lag(ts_us) OVER w AS b, lag(outcome) OVER w AS bo, lag(last_success) OVER w AS bl, lag(failure_category) OVER w AS bf FROM s
  WINDOW w AS (PARTITION BY video_id, provider_key, acquisition_group ORDER BY ts_us, outcome NULLS FIRST, last_success NULLS FIRST, failure_category NULLS FIRST)),
v AS (SELECT * FROM l WHERE b IS NULL OR bo IS DISTINCT FROM outcome OR bl IS DISTINCT FROM last_success OR bf IS DISTINCT FROM failure_category)
"""

_RECORDS = """
r AS (
  SELECT video_id, record_id, raw_json->>'title' AS title, raw_json->>'channel_id' AS channel_id, raw_json->>'availability' AS availability, TRY_CAST(raw_json->>'duration' AS DOUBLE) AS duration,
    epoch_us(CASE WHEN regexp_matches(fetched_at, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN TRY_CAST(fetched_at AS TIMESTAMPTZ) ELSE TRY_CAST(fetched_at || '+00:00' AS TIMESTAMPTZ) END) AS ts_us
  FROM metadata_records WHERE json_valid(raw_json) AND json_type(CASE WHEN json_valid(raw_json) THEN raw_json END) = 'OBJECT'),
rl AS (SELECT *, lag(ts_us) OVER w AS b, lag(title) OVER w AS bt, lag(channel_id) OVER w AS bc, lag(availability) OVER w AS ba, lag(duration) OVER w AS bd FROM r WHERE ts_us IS NOT NULL
  WINDOW w AS (PARTITION BY video_id ORDER BY ts_us, record_id)),
rv AS (SELECT * FROM rl WHERE b IS NULL OR bt IS DISTINCT FROM title OR bc IS DISTINCT FROM channel_id OR ba IS DISTINCT FROM availability OR bd IS DISTINCT FROM duration)
"""

def _listed(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{name}'" for name in names)


#: Members ('m') and slots ('s') of all records, read step by step: text is decoded, keyed members fall into keys, lists into slots, objects into members.
_NESTED = f"""
WITH RECURSIVE t AS (
  SELECT record_id, 'm' AS kind, root AS member_path, '' AS pos_path, '' AS parent_path, '' AS parent_pos, json_extract(j, '$.' || root) AS v
  FROM (SELECT record_id, CASE WHEN json_valid(raw_json) THEN CAST(raw_json AS JSON) END AS j FROM metadata_records) r, (SELECT unnest([{_listed(ROOTS)}]) AS root) n
  WHERE json_type(j) = 'OBJECT' AND json_extract(j, '$.' || root) IS NOT NULL
  UNION ALL
  SELECT record_id, c.kind, c.path, c.pos, c.up_path, c.up_pos, c.v FROM (SELECT record_id, unnest(CASE
    WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(v->>'$') THEN [{{kind: kind, path: member_path, pos: pos_path, up_path: parent_path, up_pos: parent_pos, v: CAST(v->>'$' AS JSON)}}] ELSE [] END
    WHEN kind = 'm' AND member_path IN ({_listed(KEYED)}) AND pos_path = '' AND json_type(v) = 'OBJECT' AND coalesce(list_bool_and([json_type(v, '$."' || x || '"') <> 'VARCHAR' OR json_valid(json_extract_string(v, '$."' || x || '"')) FOR x IN json_keys(v)]), true)
      THEN [{{kind: 'm', path: member_path, pos: x, up_path: parent_path, up_pos: parent_pos, v: json_extract(v, '$."' || x || '"')}} FOR x IN json_keys(v)]
    WHEN kind = 'm' AND json_type(v) = 'ARRAY'
      THEN [{{kind: 's', path: member_path, pos: CASE WHEN pos_path = '' THEN '' ELSE pos_path || '.' END || i, up_path: parent_path, up_pos: parent_pos, v: json_extract(v, '$[' || i || ']')}} FOR i IN range(CAST(json_array_length(v) AS BIGINT))]
    WHEN kind = 'm' AND json_type(v) = 'OBJECT' THEN [{{kind: 's', path: member_path, pos: CASE WHEN pos_path = '' THEN '' ELSE pos_path || '.' END || '0', up_path: parent_path, up_pos: parent_pos, v: v}}]
    WHEN kind = 's' AND json_type(v) = 'OBJECT' THEN [{{kind: 'm', path: member_path || '.' || x, pos: pos_path, up_path: member_path, up_pos: pos_path, v: json_extract(v, '$.' || x)}} FOR x IN [{_listed(NESTED)}] IF json_extract(v, '$.' || x) IS NOT NULL]
    ELSE [] END) AS c FROM t))
"""
_OBJECTS = " FROM t WHERE kind = 's' AND json_type(v) = 'OBJECT'"

ORACLES = {
    "p2_record_periods": "WITH" + _RECORDS
    + """SELECT video_id, title, channel_id, availability, CASE WHEN duration = floor(duration) THEN CAST(CAST(duration AS BIGINT) AS VARCHAR) ELSE CAST(duration AS VARCHAR) END AS duration, CAST(ts_us // 1000000 AS BIGINT) AS valid_from,
  CAST(lead(ts_us) OVER (PARTITION BY video_id ORDER BY ts_us, record_id) // 1000000 AS BIGINT) AS valid_to FROM rv""",
    "p5_found": _NESTED + "SELECT record_id, member_path, pos_path" + _OBJECTS,
    "p5_objects": _NESTED
    + f"""SELECT record_id, member_path, pos_path, parent_path, parent_pos, CAST(to_json(map_from_entries([{{k: x, v: json_extract_string(v, '$."' || x || '"')}} FOR x IN list_sort(json_keys(v)) IF x NOT IN ({_listed(NESTED)})])) AS VARCHAR) AS attributes"""
    + _OBJECTS,
    "p5_formats": _NESTED
    + """SELECT record_id, pos_path, parent_pos, v->>'format_id' AS format_id, v->>'ext' AS ext, TRY_CAST(v->>'width' AS BIGINT) AS width, TRY_CAST(v->>'height' AS BIGINT) AS height, TRY_CAST(v->>'fps' AS DOUBLE) AS fps,
  v->>'vcodec' AS vcodec, v->>'acodec' AS acodec, TRY_CAST(v->>'tbr' AS DOUBLE) AS tbr, TRY_CAST(v->>'filesize' AS BIGINT) AS filesize"""
    + _OBJECTS + " AND member_path = 'formats'",
    "p5_comments": _NESTED + "SELECT record_id, pos_path, parent_pos, v->>'id' AS id, v->>'author' AS author, v->>'text' AS text" + _OBJECTS + " AND member_path = 'comments'",
    "p2_found": _STATES.rstrip() + "," + _RECORDS + """SELECT 'record' AS track, video_id, 'yt-dlp' AS provider_key, 'detailed' AS acquisition_group, CAST(ts_us // 1000000 AS BIGINT) AS valid_from FROM rv
UNION ALL SELECT 'acquisition', video_id, provider_key, acquisition_group, CAST(ts_us // 1000000 AS BIGINT) FROM v""",
    "p2_acquisition_periods": _STATES
    + """SELECT video_id, provider_key, acquisition_group, outcome, CAST(last_success // 1000000 AS BIGINT) AS last_success, failure_category, CAST(ts_us // 1000000 AS BIGINT) AS valid_from,
  CAST(lead(ts_us) OVER (PARTITION BY video_id, provider_key, acquisition_group ORDER BY ts_us, outcome NULLS FIRST, last_success NULLS FIRST, failure_category NULLS FIRST) // 1000000 AS BIGINT) AS valid_to FROM v""",
    "p4_found": f"""
WITH e AS (SELECT DISTINCT snapshot_no, source_url, trim(video_id, {SQL_BLANKS}) AS video_id FROM source_entries),
o AS (SELECT snapshot_no, source_url, last_observed_at, observed_entries FROM source_observations
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, source_url ORDER BY last_observed_at DESC NULLS LAST, observed_entries DESC NULLS LAST) = 1),
n AS (SELECT DISTINCT snapshot_no FROM source_entries), m AS (SELECT DISTINCT snapshot_no FROM source_observations)
SELECT b.snapshot_no, b.source_url, b.video_id, 'added' AS change_kind FROM e b WHERE b.snapshot_no > (SELECT min(snapshot_no) FROM n)
  AND NOT EXISTS (SELECT 1 FROM e a WHERE a.snapshot_no = b.snapshot_no - 1 AND a.source_url = b.source_url AND a.video_id = b.video_id)
UNION ALL SELECT CAST(a.snapshot_no + 1 AS INTEGER), a.source_url, a.video_id, 'removed' FROM e a WHERE a.snapshot_no < (SELECT max(snapshot_no) FROM n)
  AND NOT EXISTS (SELECT 1 FROM e b WHERE b.snapshot_no = a.snapshot_no + 1 AND a.source_url = b.source_url AND a.video_id = b.video_id)
UNION ALL SELECT b.snapshot_no, b.source_url, '', CASE WHEN a.source_url IS NULL THEN 'added' ELSE 'changed' END FROM o b LEFT JOIN o a ON a.snapshot_no = b.snapshot_no - 1 AND a.source_url = b.source_url
  WHERE b.snapshot_no > (SELECT min(snapshot_no) FROM m) AND (a.source_url IS NULL OR a.last_observed_at IS DISTINCT FROM b.last_observed_at OR a.observed_entries IS DISTINCT FROM b.observed_entries)
UNION ALL SELECT CAST(a.snapshot_no + 1 AS INTEGER), a.source_url, '', 'removed' FROM o a WHERE a.snapshot_no < (SELECT max(snapshot_no) FROM m)
  AND NOT EXISTS (SELECT 1 FROM o b WHERE b.snapshot_no = a.snapshot_no + 1 AND a.source_url = b.source_url)""",
}
