"""Chat formatting: every participant's perspective on a dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemove.llm.common import join_small, key_partitions, materialise

#: Speakers that set the scene and get no perspective of their own.
SYSTEM = ("system",)
#: Turns that one output row covers, and messages beyond which such a stretch is cut into parts.
STRETCH, MOST_MESSAGES = 64, 1024


def messages(conversations: DataFrame, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """One row per message and perspective: ``role``, ``name``, ``segment``, and where in it lies what is learnt.

    For each participant of a conversation (each distinct ``role`` column value
    outside ``system``) all messages come once: its own with role assistant,
    the others' with role user and the speaker's name, system ones as system. A
    segment is ``<|im_start|>role[ name=speaker]\\n text <|im_end|>\\n``; ``<|`` within a
    text or name is broken up as ``< |``, so that no text can end its segment. ``learn_from`` and ``learn_to``
    bound the text and end mark of an assistant's segment, in code points, and are null otherwise.

    Participants are counted map-side and joined on the conversation, whose
    large partitions adaptive execution can split: a conversation with very
    many messages is never gathered.
    """
    return _rendered(_said(conversations), system)


def _said(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text")
    )


def _rendered(said: DataFrame, system: tuple[str, ...]) -> DataFrame:
    people = said.where(~F.col("speaker").isin(*system)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    people = people.withColumnRenamed("conv_id", "_conv")
    rows = said.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    role = F.when(F.col("speaker") == F.col("perspective"), "assistant").when(F.col("speaker").isin(*system), "system").otherwise("user")
    name = F.when((F.col("speaker") != F.col("perspective")) & ~F.col("speaker").isin(*system), F.col("speaker"))
    rows = rows.withColumn("role", role).withColumn("name", name)
    head = F.concat(F.lit("<|im_start|>"), "role", F.coalesce(F.concat(F.lit(" name="), _safe("name")), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("segment", F.concat(head, _safe("text"), F.lit("<|im_end|>\n")))
    own = F.col("role") == "assistant"
    return rows.withColumn("learn_from", F.when(own, F.char_length(head))).withColumn("learn_to", F.when(own, F.char_length("segment") - 1))


def _safe(column: str) -> Column:
    return F.replace(F.col(column), F.lit("<|"), F.lit("< |"))


def _in_order(spark: SparkSession, said: DataFrame, most: int) -> DataFrame:
    """``said`` with ``part``: each stretch cut after every ``most`` messages, in the order of turn, speaker and text.

    Messages are sorted in ranges, so that a stretch of any size spreads over tasks. A message's place in its
    stretch is its place in the range plus what the ranges before hold of the stretch.
    """
    key = ["conv_id", "first_turn"]
    order = [*key, "turn", "speaker", "text"]
    ranged = said.repartitionByRange(key_partitions(spark), *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(spark, ranged, "chat-ranges")
    held = ranged.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range at most
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    for c in key:
        held = held.withColumnRenamed(c, f"_{c}")
    same = [ranged[c].eqNullSafe(held[f"_{c}"]) for c in key]
    placed = ranged.join(held.withColumnRenamed("_range", "_r"), [*same, F.col("_range") == F.col("_r")])
    part = F.floor((F.col("_at") - F.col("_first") + F.col("_before")) / most).cast("int")
    return materialise(spark, placed.select(*said.columns, part.alias("part")), "chat-parts")


def rotate(
    spark: SparkSession, conversations: DataFrame, *, system: tuple[str, ...] = SYSTEM, stretch: int = STRETCH, most: int = MOST_MESSAGES
) -> DataFrame:
    """Rendered dialogues: one row per conversation, perspective and part of a stretch of ``stretch`` turns.

    Columns: ``conv_id``, ``perspective``, ``first_turn`` (of the stretch) and ``part`` (its
    order: a stretch is cut after every ``most`` messages), ``n_messages``, ``text`` (the segments of :func:`messages`, one after
    the other), ``mask`` (spans ``from-to``, in code points of ``text``, joined by
    commas: what is learnt). Joining a perspective's rows by ``first_turn`` and ``part`` gives the
    whole dialogue in order, whatever its length; no row holds more than ``most`` messages. A system message
    stands where it was said, as a rule in the first row only.

    Messages go by turn, then speaker, then text (ties; null turns first).
    Repeated rows (conversation, turn, speaker and text equal) count once. A
    null speaker is ``unknown``, a null text empty, and a null conversation id a conversation like
    others. Conversations with system messages only have no participants and give no
    rows, nor does an empty table. Other columns are not read.
    """
    said = _said(conversations).withColumn("turn", F.col("turn").cast("long")).distinct()
    said = said.withColumn("first_turn", F.floor(F.col("turn") / stretch) * stretch)
    key = F.xxhash64("conv_id", "first_turn").alias("_key")
    sizes = said.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    crowded = materialise(spark, sizes.where(F.col("_n") > most).select("_key", F.lit(True).alias("_crowded")), "chat-long")
    marked = join_small(said.withColumn("_key", key), crowded, ["_key"]).drop("_key")
    parts = marked.where("_crowded is null").drop("_crowded").withColumn("part", F.lit(0))
    if not crowded.isEmpty():
        parts = parts.unionByName(_in_order(spark, marked.where("_crowded").drop("_crowded"), most))
    rows = _rendered(parts, system)
    one = F.struct("turn", "speaker", F.col("text").alias("said"), "segment", "learn_from", "learn_to")
    got = rows.groupBy("conv_id", "perspective", "first_turn", "part").agg(F.array_sort(F.collect_list(one)).alias("m"))
    spans = F.expr(
        "aggregate(m, named_struct('at', 0, 'spans', cast(array() as array<string>)), (acc, x) -> named_struct("
        "'at', acc.at + char_length(x.segment), 'spans', if(x.learn_from is null, acc.spans, "
        "array_append(acc.spans, concat(acc.at + x.learn_from, '-', acc.at + x.learn_to)))), acc -> array_join(acc.spans, ','))"
    )
    return got.select(
        "conv_id", "perspective", "first_turn", "part", F.size("m").alias("n_messages"),
        F.array_join(F.transform("m", lambda x: x["segment"]), "").alias("text"), spans.alias("mask"),
    )


ORACLE_SQL = """
WITH once AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM once WHERE speaker <> 'system'),
placed AS (
  SELECT *, CAST(floor(turn / 64) * 64 AS BIGINT) AS first_turn, CAST((row_number() OVER (
    PARTITION BY conv_id, CAST(floor(turn / 64) AS BIGINT) ORDER BY turn, speaker, said) - 1) // 1024 AS INT) AS part FROM once),
msg AS (
  SELECT o.*, perspective,
    CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM placed o JOIN people p ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
seg AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || replace(speaker, '<|', '< |') ELSE '' END || chr(10) AS head,
    replace(said, '<|', '< |') || '<|im_end|>' AS body FROM msg),
pos AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER w - length(head) - length(body) - 1 AS ofs FROM seg
  WINDOW w AS (PARTITION BY conv_id, perspective, first_turn, part ORDER BY turn, speaker, said))
SELECT conv_id, perspective, first_turn, part, count(*) AS n_messages,
  string_agg(head || body || chr(10), '' ORDER BY turn, speaker, said) AS text,
  coalesce(string_agg((ofs + length(head)) || '-' || (ofs + length(head) + length(body)), ',' ORDER BY turn, speaker, said)
    FILTER (WHERE role = 'assistant'), '') AS mask
FROM pos GROUP BY conv_id, perspective, first_turn, part
"""
