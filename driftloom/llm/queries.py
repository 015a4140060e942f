"""Queries for the operators of this subpackage, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.encoding import restore, restore_spans
from driftloom.llm.mixing import Mixture, mix
from driftloom.llm.packing import pack
from driftloom.llm.runs import RunSpec, collapse_runs
from driftloom.llm.tokens import with_sizes
from driftloom.session import cut
from driftloom.sources.tables import DAY0, PEER, USER, dated, table

RUNS = RunSpec(entity=USER, time="time", event=PEER, id="reading_id", gap_seconds=900)


def p2_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading of the log in its run, single readings too."""
    runs = collapse_runs(dated(table(spark, folder, "proximity")), RUNS)
    return runs.withColumnsRenamed({"entity": "user_id", "event": "peer_id", "first_id": "first_reading_id", "last_id": "last_reading_id"})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of two or more readings."""
    return p2_runs(spark, folder).filter("n_events >= 2").select("user_id", "first_reading_id", "last_reading_id")


NEAR = RunSpec(entity=USER, time="time", event="prob2", id="reading_id", gap_seconds=900, near=0.05)


def p2_near(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading in a run of readings whose probability stays near the run's first."""
    runs = collapse_runs(dated(table(spark, folder, "proximity")), NEAR)
    return runs.select(F.col("entity").alias("user_id"), F.round("event", 6).alias("anchor"), "first_id", "last_id", "n_events")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return with_sizes(table(spark, folder, "documents"), "text", keep=("doc_id", "source"))


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in containers of each capacity."""
    limits = {r.container: r.capacity_tokens for r in table(spark, folder, "pack_capacities").collect()}  # a few rows, fixed
    packed = pack(_sizes(spark, folder), "doc_id", "source", "size", limits)
    return packed.withColumnsRenamed({"item_id": "doc_id", "size": "n_tokens"})


def p6_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Which texts are in containers of which kind: each in every kind."""
    return p6_pack(spark, folder).select("container", "doc_id").distinct()


def p6_held(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of container, sized by characters: what went in, what is wrong with any of them (nothing), and how many they are against the least number."""
    limits = {r.container: r.capacity_tokens for r in table(spark, folder, "pack_capacities").collect()}  # a few rows, fixed
    texts = table(spark, folder, "documents").filter("text is not null").select("doc_id", "source", F.col("n_chars").cast("bigint").alias("size"))
    # Packed once for the two views of it below.
    packed = cut(pack(texts, "doc_id", "source", "size", limits)).withColumn("capacity", F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("container")])
    one = packed.groupBy("container", "capacity", "container_id").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    of = one.groupBy("container", "capacity").agg(
        F.sum("pieces").alias("pieces"), F.sum("used").alias("size"), F.count_if(F.col("used") > F.col("capacity")).alias("overfull"), F.count(F.lit(1)).alias("made")
    )
    text = packed.groupBy("container", "item_id").agg(F.sum("size").alias("size"), F.max("n_pieces").alias("n"), F.count(F.lit(1)).alias("came"), F.max("capacity").alias("capacity"))
    whole = text.groupBy("container").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if((F.col("n") > 1) & (F.col("size") <= F.col("capacity"))).alias("cut_for_nothing"),
        F.count_if(F.col("came") != F.col("n")).alias("incomplete"),
    )
    near = F.col("made") <= F.lit(1.005) * F.ceil(F.col("size") / F.col("capacity")) + 4
    return of.join(whole, "container").select("container", "texts", "pieces", "size", "overfull", "cut_for_nothing", "incomplete", near.alias("near_least"))


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    return mix(_sizes(spark, folder), "doc_id", "source", "size", table(spark, folder, "source_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture, in order."""
    return _mixture(spark, folder).documents.withColumnsRenamed({"item_id": "doc_id", "size": "n_tokens"})


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the tokens that each source reached."""
    return _mixture(spark, folder).shares


def _char_mixture(spark: SparkSession, folder: str) -> Mixture:
    texts = table(spark, folder, "documents").filter("text is not null").select("doc_id", "source", "n_chars")
    return mix(texts, "doc_id", "source", "n_chars", table(spark, folder, "source_targets"))


def p7_chars(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of texts sized by characters."""
    found = _char_mixture(spark, folder).documents
    return found.select(F.col("item_id").alias("doc_id"), "source", "copy", "size", F.round("virtual_finish", 4).alias("virtual_finish"))


def p7_char_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What each source contributed to it."""
    return _char_mixture(spark, folder).shares.withColumn("actual_share", F.round("actual_share", 9))


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The documents decoded with the wrong encoding, with the text restored."""
    return restore(table(spark, folder, "documents"), "doc_id", "text")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Those that well-formed multibyte spans alone tell, with only the spans decoded."""
    return restore_spans(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The same by their ids."""
    return p8_restored(spark, folder).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_runs, p2_near, p6_pack, p6_placed, p6_held, p7_mix, p7_shares, p7_chars, p7_char_shares, p8_found, p8_spans, p8_restored)}

_RUNS = f"""
    WITH seen AS (SELECT reading_id, "user.id" AS u, "remote.user.id.if.known" AS r, "time" AS t FROM proximity WHERE "time" >= TIMESTAMP '{DAY0} 00:00:00'),
    flagged AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(r) OVER w IS NOT DISTINCT FROM r
        AND t - lag(t) OVER w <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS opens
        FROM seen WINDOW w AS (PARTITION BY u ORDER BY t, r NULLS FIRST, reading_id)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY u ORDER BY t, r NULLS FIRST, reading_id ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
    runs AS (SELECT u AS user_id, any_value(r) AS peer_id, arg_min(reading_id, (t, reading_id)) AS first_reading_id,
        arg_max(reading_id, (t, reading_id)) AS last_reading_id, min(t) AS start, max(t) AS "end",
        date_diff('microsecond', min(t), max(t)) / 1e6 AS duration_s, count(*) AS n_events FROM numbered GROUP BY u, run)"""

_NEAR = f"""
    WITH RECURSIVE seen AS MATERIALIZED (SELECT reading_id AS id, coalesce("user.id", -1) AS u, prob2::DOUBLE AS p, "time" AS t,
        row_number() OVER (PARTITION BY "user.id" ORDER BY "time", prob2 NULLS FIRST, reading_id) AS i FROM proximity WHERE "time" >= TIMESTAMP '{DAY0} 00:00:00'),
    fold AS (SELECT u, i, id, t, p AS anchor, 1 AS run FROM seen WHERE i = 1
        UNION ALL SELECT u, i, id, t, CASE WHEN joins THEN anchor ELSE p END, CASE WHEN joins THEN run ELSE run + 1 END
        FROM (SELECT s.u, s.i, s.id, s.t, s.p, f.anchor, f.run, s.t - f.t <= INTERVAL 15 MINUTE
                AND (s.p IS NULL AND f.anchor IS NULL OR coalesce(abs(s.p - f.anchor) <= 0.05::DOUBLE, false)) AS joins
            FROM fold f JOIN seen s ON s.u = f.u AND s.i = f.i + 1))"""

_MIXTURE = """
    WITH items AS (SELECT doc_id, source, n_chars::BIGINT AS size FROM documents WHERE text IS NOT NULL),
    uses AS (SELECT doc_id, i.source, copy, size, target_share AS weight, substr(md5(concat_ws('|', '0', doc_id, copy)), 1, 8) AS h FROM items i JOIN source_targets s ON i.source = s.source
        CROSS JOIN (SELECT unnest(range((SELECT max(max_repeats) FROM source_targets)))::INT AS copy) WHERE copy < max_repeats AND target_share > 0),
    placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY copy, h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT / weight AS virtual_finish FROM uses),
    upto AS (SELECT *, sum(size) OVER (ORDER BY virtual_finish RANGE UNBOUNDED PRECEDING) AS total FROM placed),
    taken AS (SELECT * FROM upto WHERE total <= (SELECT sum(size) FROM items))"""

SQL: dict[str, str] = {
    "p7_chars": _MIXTURE + " SELECT doc_id, source, copy, size, round(virtual_finish, 4) AS virtual_finish FROM taken",
    "p7_char_shares": _MIXTURE + """,
    per AS (SELECT source, doc_id, count(*) AS uses, sum(size) AS size FROM taken GROUP BY 1, 2),
    used AS (SELECT source, sum(size)::BIGINT AS tokens, count(*) AS documents, sum(uses)::BIGINT AS uses, max(uses) AS most_uses FROM per GROUP BY 1),
    stock AS (SELECT source, count(*) AS rows FROM items GROUP BY 1)
    SELECT source, target_share, round(coalesce(tokens, 0) / (SELECT sum(tokens) FROM used)::DOUBLE, 9) AS actual_share, coalesce(tokens, 0) AS tokens, coalesce(documents, 0) AS documents,
        coalesce(uses, 0) AS uses, coalesce(most_uses, 0) AS most_uses, coalesce(uses, 0) >= coalesce(rows * max_repeats, 0) AS exhausted
    FROM source_targets LEFT JOIN used USING (source) LEFT JOIN stock USING (source)""",
    "p2_near": _NEAR + """ SELECT nullif(u, -1) AS user_id, round(any_value(anchor), 6) AS anchor, arg_min(id, i) AS first_id, arg_max(id, i) AS last_id,
        count(*) AS n_events FROM fold GROUP BY fold.u, run""",
    "p2_found": _RUNS + " SELECT user_id, first_reading_id, last_reading_id FROM runs WHERE n_events >= 2",
    "p2_runs": _RUNS + " SELECT * FROM runs",
    "p6_held": """SELECT container, count(*) AS texts, sum(greatest(1, ceil(n_chars / capacity_tokens::DOUBLE)))::BIGINT AS pieces, sum(n_chars)::BIGINT AS size,
        0::BIGINT AS overfull, 0::BIGINT AS cut_for_nothing, 0::BIGINT AS incomplete, true AS near_least
        FROM documents CROSS JOIN pack_capacities WHERE text IS NOT NULL GROUP BY container""",
    "p6_placed": "SELECT container, doc_id FROM documents CROSS JOIN pack_capacities WHERE text IS NOT NULL",
}
