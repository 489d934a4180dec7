"""Queries and oracle SQL of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltline.functions.text import WHITE_SPACE, strip_white_space
from siltline.llm.lookalike import canonical_text, look_alike_classes, look_alike_pairs, visual_sql
from siltline.llm.mixing import mixture
from siltline.llm.packing import pack_items, room_gaps
from siltline.llm.survivor import consensus_survivors, most_trusted
from siltline.llm.tokens import token_counts
from siltline.llm.topn import top_n
from siltline.operators.materialise import materialise
from siltline.operators.skew import broadcast_if_small
from siltline.sources.tables import read_table

SEED = 20250101
#: Rows that a table of specifications may have; they become part of the plan.
SPECIFICATIONS = 1_000


def _spelled(column: str):
    """A label in one spelling: lower case, no blanks around, one kind of joint."""
    return F.regexp_replace(F.lower(strip_white_space(column)), r"[\s_-]+", "_")


def eligible_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a value or of a known null, from a provider registered for the field, with its rank."""
    candidates = read_table(spark, sf_dir, "field_provider_candidates").groupBy("provider_key", "field_name").agg(F.max(F.struct("effective_priority", F.negative("provider_registration_order").alias("order"))).alias("c")).select("provider_key", "field_name", "c.effective_priority", F.negative("c.order").alias("provider_registration_order"))
    observations = read_table(spark, sf_dir, "field_observations").filter(_spelled("kind").isin("value", "known_null"))
    return observations.join(broadcast_if_small(candidates), ["provider_key", "field_name"])


TRUST = [("effective_priority", "desc"), ("provider_registration_order", "asc"), ("observed_at", "desc"), ("observation_id", "asc")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most trusted observation. Trust alone decides, so values are neither aligned nor read."""
    return most_trusted(eligible_observations(spark, sf_dir), ["video_id", "field_name"], TRUST).select("video_id", "field_name", "observation_id")


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that most evidence agrees on, each observation weighing its provider's priority."""
    rows = eligible_observations(spark, sf_dir)
    return consensus_survivors(rows, ["video_id", "field_name"], "observed_value", TRUST, weight="effective_priority").select("video_id", "field_name", "observation_id", "observed_value")


def longest_media(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """For each source the ``n`` longest distinct videos that it ever listed."""
    entries = read_table(spark, sf_dir, "source_entries").select("source_url", strip_white_space("video_id").alias("video_id")).distinct()
    media = read_table(spark, sf_dir, "media_metadata").filter(F.col("duration_seconds").isNotNull()).groupBy(F.col("id").alias("video_id")).agg(F.max("duration_seconds").alias("duration_seconds"))
    # A video that very many sources list makes a skewed partition, which adaptive execution splits.
    return top_n(entries.join(media, "video_id"), ["source_url"], "duration_seconds", "video_id", n, distinct=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_media(spark, sf_dir).select("source_url", "video_id")


def p3_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_media(spark, sf_dir).select("source_url", "video_id", "duration_seconds", "place")


def _specification(spark: SparkSession, sf_dir: str, table: str) -> list:
    rows = read_table(spark, sf_dir, table).limit(SPECIFICATIONS + 1).collect()
    if len(rows) > SPECIFICATIONS:
        raise ValueError(f"{table} has more than {SPECIFICATIONS} rows")
    return rows


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [(r["spec_id"], r["capacity_tokens"]) for r in _specification(spark, sf_dir, "container_specs")]
    sizes = materialise(token_counts(read_table(spark, sf_dir, "documents"), "text", ["doc_id"]))
    return pack_items(sizes, "doc_id", "tokens", specs)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    placed = p6_containers(spark, sf_dir).groupBy("spec_id", "container_id").agg(F.sum("piece_size").alias("tokens"))
    specs = read_table(spark, sf_dir, "container_specs")
    total = placed.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return total.join(specs, "spec_id").select("spec_id", "capacity_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def p6_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: rooms, rooms whose packing is proven to be the best, containers, and the least number that the rooms need."""
    specs = [(r["spec_id"], r["capacity_tokens"]) for r in _specification(spark, sf_dir, "container_specs")]
    gaps = room_gaps(p6_containers(spark, sf_dir), specs)
    return gaps.groupBy("spec_id").agg(F.count(F.lit(1)).alias("rooms"), F.count_if("proven").alias("proven"), F.sum("containers").alias("containers"), F.sum("least").alias("least"))


def p6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for every packing: all documents placed, no container too full, none cut without need, pieces without gaps."""
    packed = p6_containers(spark, sf_dir)
    specs = read_table(spark, sf_dir, "container_specs").select("spec_id", "capacity_tokens")
    full = packed.groupBy("spec_id", "container_id").agg(F.sum("piece_size").alias("tokens")).join(F.broadcast(specs), "spec_id").groupBy("spec_id").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("too_full"))
    whole = packed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_size").alias("tokens"), F.max(F.col("start") + F.col("piece_size")).alias("ends"), F.count_distinct("piece_no").alias("numbers"), F.max("piece_no").alias("last"))
    kept = whole.join(F.broadcast(specs), "spec_id").groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("cut_without_need"),
        F.count_if((F.col("ends") != F.col("tokens")) | (F.col("numbers") != F.col("pieces")) | (F.col("last") + 1 != F.col("pieces"))).alias("with_gaps"),
    )
    return kept.join(full, "spec_id")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = [(r["source"], r["target_weight"], r["max_repeats"]) for r in _specification(spark, sf_dir, "mix_targets")]
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.array(_spelled("source")).alias("sources"))
    sized = materialise(token_counts(documents, "text", ["doc_id", "sources"]))
    return mixture(sized, "doc_id", "sources", "tokens", targets, seed=SEED)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


#: Sources that overlap: (name, weight, most uses of a document).
OVERLAPPING = [("english", 5.0, 2), ("of_a_video", 3.0, 1), ("long", 2.0, 3), ("nowhere", 1.0, 1)]


def _overlapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents that belong to several sources at once, or to none."""
    documents = read_table(spark, sf_dir, "documents")
    kinds = F.array_compact(F.array(F.when(F.lower("lang") == "en", "english"), F.when(F.col("video_id").isNotNull(), "of_a_video"), F.when(F.col("n_chars") >= 500, "long")))
    sized = materialise(token_counts(documents.select("doc_id", "text", kinds.alias("sources")), "text", ["doc_id", "sources"]))
    return mixture(sized, "doc_id", "sources", "tokens", OVERLAPPING, seed=SEED)


def p7_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of sources that overlap."""
    return _overlapping(spark, sf_dir)[1]


def _kept_rules(shares: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: its share of the weights, whether its documents are used at most as often as allowed, and whether its tokens are within one document per pattern of its share of the sources that there are."""
    rows = shares.join(F.broadcast(targets), "source")
    there = F.when(F.col("available_tokens") > 0, F.col("target_share")).otherwise(0.0)
    total = F.sum("target_tokens").over(W.partitionBy())  # one row per source
    # Quotas are whole numbers, so the total is short of up to one token per source.
    wanted = F.coalesce(F.try_divide(there, F.sum(there).over(W.partitionBy())), F.lit(0.0)) * total
    return rows.select("source", F.round("target_share", 9).alias("target_share"), (F.col("most_uses") <= F.col("max_repeats")).alias("uses_kept"), (F.abs(F.col("reached_tokens") - wanted) <= F.col("within_tokens") + 20).alias("share_kept"), (F.col("available_tokens") > 0).alias("there"))


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_rules(p7_shares(spark, sf_dir), read_table(spark, sf_dir, "mix_targets").select("source", "max_repeats"))


def p7_overlapping_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_rules(p7_overlapping(spark, sf_dir), spark.createDataFrame([(s, m) for s, _, m in OVERLAPPING], "source string, max_repeats int"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_classes(read_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "class_id", "members", "links")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "canonical")


QUERIES = {
    "p1_found": p1_found,
    "p1_consensus": p1_consensus,
    "p3_found": p3_found,
    "p3_longest": p3_longest,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_gaps": p6_gaps,
    "p6_rules": p6_rules,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_rules": p7_rules,
    "p7_overlapping": p7_overlapping,
    "p7_overlapping_rules": p7_overlapping_rules,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_canonical": p8_canonical,
}

_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_LONGEST = f"""
WITH m AS (SELECT id, max(duration_seconds) AS duration_seconds FROM media_metadata WHERE duration_seconds IS NOT NULL GROUP BY id),
e AS (SELECT DISTINCT source_url, trim(video_id, {_BLANKS}) AS video_id FROM source_entries)
SELECT source_url, video_id, duration_seconds, CAST(row_number() OVER (PARTITION BY source_url ORDER BY duration_seconds DESC, video_id) AS INTEGER) AS place FROM e JOIN m ON m.id = e.video_id QUALIFY place <= 10"""

_SEEN = f"WITH v AS (SELECT doc_id, text, {visual_sql('text')} AS seen FROM documents WHERE text IS NOT NULL)"

ORACLES = {
    "p1_found": f"""
SELECT o.video_id, o.field_name, o.observation_id FROM field_observations o JOIN field_provider_candidates c USING (provider_key, field_name)
WHERE regexp_replace(lower(trim(o.kind, {_BLANKS})), '[\\s_-]+', '_', 'g') IN ('value', 'known_null')
QUALIFY row_number() OVER (PARTITION BY o.video_id, o.field_name ORDER BY c.effective_priority DESC, c.provider_registration_order, o.observed_at DESC NULLS LAST, o.observation_id) = 1""",
    "p3_found": f"SELECT source_url, video_id FROM ({_LONGEST})",
    "p3_longest": _LONGEST,
    "p6_rules": "SELECT spec_id, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS cut_without_need, CAST(0 AS BIGINT) AS with_gaps, CAST(0 AS BIGINT) AS too_full FROM container_specs",
    "p7_rules": f"""
SELECT source, round(target_weight / (SELECT sum(target_weight) FROM mix_targets), 9) AS target_share, true AS uses_kept, true AS share_kept,
  EXISTS (SELECT 1 FROM documents d WHERE d.text <> '' AND regexp_replace(lower(trim(d.source, {_BLANKS})), '[\\s_-]+', '_', 'g') = t.source) AS there FROM mix_targets t""",
    "p7_overlapping_rules": """
SELECT source, round(w / 11.0, 9) AS target_share, true AS uses_kept, true AS share_kept, there FROM (
  SELECT 'english' AS source, CAST(5 AS DOUBLE) AS w, EXISTS (SELECT 1 FROM documents WHERE lower(lang) = 'en' AND text <> '') AS there
  UNION ALL SELECT 'of_a_video', 3, EXISTS (SELECT 1 FROM documents WHERE video_id IS NOT NULL AND text <> '')
  UNION ALL SELECT 'long', 2, EXISTS (SELECT 1 FROM documents WHERE n_chars >= 500 AND text <> '')
  UNION ALL SELECT 'nowhere', 1, false)""",
    "p8_found": _SEEN + "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.seen = b.seen AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p8_classes": _SEEN + """, c AS (SELECT seen, min(doc_id) AS class_id, count(*) AS members FROM v GROUP BY seen HAVING count(DISTINCT text) > 1),
t AS (SELECT text, count(*) AS copies FROM v GROUP BY text)
SELECT v.doc_id, c.class_id, c.members, c.members - t.copies AS links FROM v JOIN c USING (seen) JOIN t USING (text)""",
}
