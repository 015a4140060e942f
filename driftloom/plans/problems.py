"""Queries for the data-preparation operators of the core, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.operators.grid import GridSpec, regular_grid
from driftloom.operators.sessions import SessionSpec, sessionize
from driftloom.operators.skew import fragment_replicate_join, per_key_results, plan_shards
from driftloom.session import cut, width
from driftloom.sources.dsv import parse_lines, with_reason
from driftloom.sources.tables import DAY0, PEER, USER, dated, table

GRID = GridSpec(keys=(USER, "wave"), time="time", value="prob2", origin=DAY0)
SESSIONS = SessionSpec(entity=USER, time="time", id="reading_id", peer=PEER, gap_seconds=1800)
#: A key is frequent from this share of its column's non-null rows.
FREQUENT = 0.025


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user, wave and day between the first and the last day with a reading."""
    grid = regular_grid(table(spark, folder, "proximity"), GRID)
    return grid.withColumnsRenamed({"key_0": "user_id", "key_1": "wave", "period": "day", "value": "mean_prob2"})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The days that had to be filled."""
    return p1_grid(spark, folder).filter("filled").select("user_id", "wave", "day")


def p1_counted(spark: SparkSession, folder: str) -> DataFrame:
    """The same days: what was counted, and whether every estimate is there, settled and within what the series has shown."""
    of = W.partitionBy("user_id", "wave")
    grid = p1_grid(spark, folder).withColumns(
        {
            "most": F.max("n_readings").over(of),
            "least": F.min(F.when(~F.col("value_filled"), F.col("mean_prob2"))).over(of),
            "largest": F.max(F.when(~F.col("value_filled"), F.col("mean_prob2"))).over(of),
        }
    )
    inside = F.col("readings_est").between(-1e-9, F.col("most") + 1e-9) & (F.col("least").isNull() | F.col("mean_prob2").between(F.col("least") - 1e-9, F.col("largest") + 1e-9))
    seen = F.when(~F.col("value_filled"), F.round("mean_prob2", 6)).alias("seen_prob2")
    return grid.select("user_id", "wave", "day", "filled", "n_readings", seen, F.col("value_filled").alias("prob2_filled"), (inside & F.col("converged")).alias("held"))


def p3_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every raw line, typed or with the reason why not."""
    return parse_lines(table(spark, folder, "proximity_raw"), "raw_line", carry=("line_id", "file_name", "line_no"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that aren't valid."""
    return with_reason(p3_lines(spark, folder)).select("line_id")


def p4_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Results per user and per peer."""
    found = per_key_results(table(spark, folder, "proximity"), (USER, PEER), "time", "prob2")
    return found.withColumn("mean_prob2", F.round("mean_value", 9)).drop("mean_value", "share")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The users and peers that hold a large share of the rows."""
    found = per_key_results(table(spark, folder, "proximity"), (USER, PEER), "time", "prob2")
    return found.filter(F.col("share") >= FREQUENT).select("field", "key_id")


def p4_above_peer_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Per peer, how many of its readings lie above that peer's own mean: a join of the whole log on a skewed key."""
    log = table(spark, folder, "proximity").select("reading_id", F.col(PEER).alias("peer"), F.col("prob2").cast("double").alias("p"))
    profile = cut(log.filter("peer is not null").groupBy("peer").agg(F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("load")))
    plan = plan_shards(profile, "peer", "load", width(spark))
    joined = fragment_replicate_join(log.filter("peer is not null"), profile, "peer", ["reading_id"], plan)
    return joined.groupBy(F.col("peer").alias("key_id")).agg(
        F.count(F.lit(1)).alias("readings"), F.count(F.when(F.col("p") > F.col("mean_p") + 1e-9, 1)).alias("above")
    )


def p5_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions per user."""
    return sessionize(dated(table(spark, folder, "proximity")), SESSIONS).withColumnsRenamed(
        {"entity": "user_id", "first_id": "first_reading_id", "last_id": "last_reading_id"}
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every session by its first and last reading."""
    return p5_sessions(spark, folder).select("user_id", "first_reading_id", "last_reading_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_grid, p1_counted, p3_found, p3_lines, p4_found, p4_keys, p4_above_peer_mean, p5_found, p5_sessions)
}

_DATED = f"\"time\" >= TIMESTAMP '{DAY0} 00:00:00'"
_DAYS = f"""
    SELECT "user.id" AS user_id, wave, date_diff('day', DATE '{DAY0}', CAST("time" AS DATE))::INT AS day, count(*) AS n,
        avg(CASE WHEN isfinite(prob2) THEN prob2::DOUBLE END) AS v
    FROM proximity WHERE {_DATED} GROUP BY 1, 2, 3"""
_SPINE = f"""
    WITH days AS ({_DAYS}), spans AS (SELECT user_id, wave, min(day) AS lo, max(day) AS hi FROM days GROUP BY 1, 2),
    spine AS (SELECT user_id, wave, CAST(unnest(range(lo, hi + 1)) AS INT) AS day FROM spans)"""

_BLANKS = "' ' || chr(9)"
_FIELD = r'[ \t]*(?:"((?:[^"]|"")*)"|([^",]*))[ \t]*'
_RECORD = "^" + ",".join([_FIELD] * 4) + "$"


def _field(k: int) -> str:
    return (
        f"trim(replace(coalesce(nullif(regexp_extract(line, '{_RECORD}', {2 * k + 1}, 's'), ''), "
        f"regexp_extract(line, '{_RECORD}', {2 * k + 2}, 's')), '\"\"', '\"'), {_BLANKS})"
    )


_INT = "(regexp_full_match({0}, '[0-9]+') AND coalesce(TRY_CAST({0} AS HUGEINT), 0) BETWEEN 1 AND 2147483647)"
_TIME = (
    "(regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]{{1,6}})?') "
    "AND {0}[12:13] < '24' AND {0}[18:19] < '60' AND TRY_CAST({0} AS TIMESTAMP) IS NOT NULL)"
)
_UNIT = "(regexp_full_match({0}, '([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(TRY_CAST({0} AS DOUBLE), 2) BETWEEN 0 AND 1)"
_CUT = f"""
    WITH trimmed AS (SELECT *, CASE WHEN right(raw_line, 1) = chr(13) THEN left(raw_line, -1) ELSE raw_line END AS line FROM proximity_raw),
    cut AS (SELECT *, coalesce(regexp_matches(line, '{_RECORD}', 's'), false) AS record,
        {_field(0)} AS a, {_field(1)} AS b, {_field(2)} AS c, {_field(3)} AS d FROM trimmed)"""
_P3_FOUND = (
    _CUT
    + f"""
    SELECT line_id FROM cut WHERE NOT coalesce(record
      AND {_INT.format('a')} AND (b = 'NA' OR {_INT.format('b')}) AND {_TIME.format('c')} AND (d = 'NA' OR {_UNIT.format('d')}), false)"""
)
#: A sound field, and the longest beginning of a line made of such fields and their commas.
_SOUND = '[ \\t]*(?:"(?:[^"]|"")*"|[^",]*)[ \\t]*'
_SOUND_FIELDS = f"^(?:{_SOUND},)*"
_P3_LINES = (
    _CUT
    + f""",
    begun AS (SELECT *, regexp_extract(line, '{_SOUND_FIELDS}', 0, 's') AS lead, strlen(regexp_extract(line, '^{_SOUND},', 0, 's')) AS at1,
        strlen(regexp_extract(line, '^(?:{_SOUND},){{2}}', 0, 's')) AS at2, strlen(regexp_extract(line, '^(?:{_SOUND},){{3}}', 0, 's')) AS at3,
        strlen(regexp_extract(line, '^(?:{_SOUND},){{4}}', 0, 's')) AS at4 FROM cut),
    seen AS (SELECT *, substr(line, length(lead) + 1) AS tail FROM begun),
    why AS (SELECT *, CASE
        WHEN raw_line IS NULL THEN 'null line'
        WHEN regexp_matches(tail, '^[ \\t]*"(?:[^"]|"")*$', 's') AND NOT regexp_matches(tail, '^{_SOUND}$', 's') THEN 'unterminated quote'
        WHEN regexp_matches(tail, '^[ \\t]*"(?:[^"]|"")*"[ \\t]*[^, \\t]', 's') THEN 'text after a closing quote'
        WHEN NOT regexp_matches(tail, '^{_SOUND}$', 's') THEN 'quote in a bare field'
        WHEN NOT record THEN 'column count'
        WHEN NOT {_INT.format('a')} THEN 'invalid user.id'
        WHEN NOT (b = 'NA' OR {_INT.format('b')}) THEN 'invalid remote.user.id.if.known'
        WHEN NOT {_TIME.format('c')} THEN 'invalid time'
        WHEN NOT (d = 'NA' OR {_UNIT.format('d')}) THEN 'invalid prob2' END AS reason FROM seen)
    SELECT line_id, file_name, line_no, CASE WHEN reason IS NULL THEN TRY_CAST(a AS INT) END AS "user.id",
        CASE WHEN reason IS NULL AND b <> 'NA' THEN TRY_CAST(b AS INT) END AS "remote.user.id.if.known", CASE WHEN reason IS NULL THEN TRY_CAST(c AS TIMESTAMP) END AS "time",
        CASE WHEN reason IS NULL AND d <> 'NA' THEN TRY_CAST(d AS FLOAT) END AS prob2, reason,
        (CASE reason WHEN 'null line' THEN 0
            WHEN 'unterminated quote' THEN strlen(lead) + strlen(regexp_extract(tail, '^[ \\t]*', 0))
            WHEN 'text after a closing quote' THEN strlen(lead) + strlen(regexp_extract(tail, '^[ \\t]*"(?:[^"]|"")*"[ \\t]*', 0, 's'))
            WHEN 'quote in a bare field' THEN strlen(lead) + strlen(regexp_extract(tail, '^[^"]*', 0, 's'))
            WHEN 'column count' THEN CASE WHEN at4 > 0 THEN at4 - 1 ELSE strlen(line) END
            WHEN 'invalid user.id' THEN 0 WHEN 'invalid remote.user.id.if.known' THEN at1 WHEN 'invalid time' THEN at2 WHEN 'invalid prob2' THEN at3 END)::BIGINT AS reason_offset
    FROM why"""
)

_PER_KEY = """
    SELECT '{0}' AS field, "{0}" AS key_id, count(*) AS readings, count(DISTINCT "{1}") AS partners,
      min("time") AS first_time, max("time") AS last_time, round(avg(CAST(prob2 AS DOUBLE)), 9) AS mean_prob2
    FROM proximity WHERE "{0}" IS NOT NULL GROUP BY 2"""
_FREQUENT = """
    SELECT '{0}' AS field, "{0}" AS key_id FROM proximity WHERE "{0}" IS NOT NULL GROUP BY 2
    HAVING count(*) >= 0.025 * (SELECT count("{0}") FROM proximity)"""
_ENDS = ("user.id", "remote.user.id.if.known")

_SESSIONS = f"""
    WITH flagged AS (SELECT *, "time" - lag("time") OVER w AS since FROM proximity WHERE {_DATED}
        WINDOW w AS (PARTITION BY "user.id" ORDER BY "time", reading_id)),
    numbered AS (SELECT *, sum(CASE WHEN since <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END)
        OVER (PARTITION BY "user.id" ORDER BY "time", reading_id ROWS UNBOUNDED PRECEDING) AS session_no FROM flagged),
    sessions AS (SELECT "user.id" AS user_id, session_no::BIGINT AS session_no, min("time") AS start, max("time") AS "end",
        date_diff('microsecond', min("time"), max("time")) / 1e6 AS duration_s, count(*) AS n_events,
        count(DISTINCT "remote.user.id.if.known") AS n_peers,
        arg_min(reading_id, ("time", reading_id)) AS first_reading_id, arg_max(reading_id, ("time", reading_id)) AS last_reading_id
        FROM numbered GROUP BY 1, 2)"""

SQL: dict[str, str] = {
    "p1_found": _SPINE + " SELECT s.user_id, s.wave, s.day FROM spine s ANTI JOIN days d ON s.user_id = d.user_id AND s.wave = d.wave AND s.day = d.day",
    "p1_counted": _SPINE + """
    SELECT s.user_id, s.wave, s.day, d.n IS NULL AS filled, coalesce(d.n, 0) AS n_readings, round(d.v, 6) AS seen_prob2, d.v IS NULL AS prob2_filled,
        true AS held FROM spine s LEFT JOIN days d ON s.user_id IS NOT DISTINCT FROM d.user_id AND s.wave IS NOT DISTINCT FROM d.wave AND s.day = d.day""",
    "p3_found": _P3_FOUND,
    "p3_lines": _P3_LINES,
    "p4_found": " UNION ALL ".join(_FREQUENT.format(a) for a in _ENDS),
    "p4_keys": " UNION ALL ".join(_PER_KEY.format(a, b) for a, b in (_ENDS, _ENDS[::-1])),
    "p4_above_peer_mean": """
    WITH m AS (SELECT "remote.user.id.if.known" AS key_id, CAST(prob2 AS DOUBLE) AS p,
        avg(CAST(prob2 AS DOUBLE)) OVER (PARTITION BY "remote.user.id.if.known") AS mean_p
        FROM proximity WHERE "remote.user.id.if.known" IS NOT NULL)
    SELECT key_id, count(*) AS readings, count(CASE WHEN p > mean_p + 1e-9 THEN 1 END) AS above FROM m GROUP BY 1""",
    "p5_found": _SESSIONS + " SELECT user_id, first_reading_id, last_reading_id FROM sessions",
    "p5_sessions": _SESSIONS + " SELECT * FROM sessions",
}
