"""URL filters by a temporal join with dated lists.

List changes (a pattern listed or taken off from a day on) become validity intervals. A pattern is
a domain, which holds for all hosts below it, or a domain with leading path segments. Every
capture is compared with the intervals of all patterns its URL falls under and that contain its
fetch time; the most specific active entry decides: more path segments first, then more domain
labels, then ``allow`` before ``block``.

An interval is cut by calendar month, but only into months in which some capture asks for its
pattern. A capture then meets the intervals of one month, at most 31 since lists change by day, so
the join has no more work for a pattern whose entries change often.

Defined results: a NULL URL, or one without a host, falls under no pattern and is kept; a NULL
fetch time meets no interval; list changes with NULL pattern or day are ignored; of changes on the
same day ``listed`` wins; repeated captures are decided each on its own; an empty list keeps
everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import stored, table

NONE, BLOCK, ALLOW = "none", "block", "allow"
_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dot; NULL without one."""
    authority = F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", "")
    name = F.regexp_replace(F.lower(authority), r"[.]?(:[0-9]*)?$", "")
    return F.when(name != "", name)


def patterns(url: Column, deepest: int, longest: int) -> Column:
    """Patterns a URL falls under, with their path segments and labels.

    No more segments than ``deepest`` and no more labels than ``longest``: longer ones are on no list, and
    a URL of very many segments would have a pattern for each.
    """
    name = host(url)
    labels = F.split(name, "[.]")
    segments = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")

    def below(n, number):
        domain = F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n))
        path = F.concat_ws("/", F.slice(segments, 1, number))
        return F.struct(
            F.when(number > 0, F.concat(domain, F.lit("/"), path)).otherwise(domain).alias("pattern"),
            number.alias("segments"), n.alias("labels"),
        )

    each = F.transform(
        F.slice(F.sequence(F.lit(1), F.size(labels)), 1, longest),
        lambda n: F.transform(F.slice(F.sequence(F.lit(0), F.size(segments)), 1, deepest + 1), lambda m: below(n, m)),
    )
    return F.when(name.isNotNull(), F.flatten(each))


def validity(changes: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) in which a pattern is listed; ``valid_to`` NULL: until now.

    ``changes``: pattern, action, day (date), listed (boolean).
    """
    changes = changes.where("pattern IS NOT NULL AND day IS NOT NULL")
    daily = changes.groupBy("pattern", "action", "day").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    order = Window.partitionBy("pattern", "action").orderBy("day")
    return daily.withColumn("valid_to", F.lead("day").over(order)).where("listed").select(
        "pattern", "action", F.col("day").alias("valid_from"), "valid_to"
    )


def _utc_day(moment: Column, kind: T.DataType) -> Column:
    """Day of a fetch time in UTC; one without a zone is taken as it stands."""
    if isinstance(kind, T.TimestampType):
        return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / 86400).cast("int"))
    return moment.cast("date")


def evaluate(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """Every capture (page_id, url, fetched_at) with decision, pattern and listed_on, kept or not.

    Lists change at midnight UTC, whatever the session's zone.
    """
    domain = F.substring_index("pattern", "/", 1)
    deepest, longest = changes.agg(
        F.max(F.size(F.split("pattern", "/")) - 1), F.max(F.size(F.split(domain, "[.]")))).first()
    rows = stored(captures.select(
        F.monotonically_increasing_id().alias("row_id"), "page_id", "url", "fetched_at"
    ), "captures")
    day = _utc_day(F.col("fetched_at"), captures.schema["fetched_at"].dataType)
    asked = rows.where("fetched_at IS NOT NULL").select(
        "row_id", day.alias("day"), F.trunc(day, "month").alias("month"),
        F.explode(patterns(F.col("url"), deepest or 0, longest or 0)).alias("p")
    ).select("row_id", "day", "month", "p.*")
    months = asked.select("pattern", "month").distinct()
    lists = validity(changes)
    entries = lists.join(months, "pattern").where(
        (F.col("valid_from") < F.add_months("month", 1))
        & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("month")))
    )
    # Stored, so that the join below is between plain shuffles and a hot domain can be split.
    entries = stored(entries.select("pattern", "month", "action", "valid_from", "valid_to"), "list-months")
    active = asked.join(entries, ["pattern", "month"]).where(
        (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    )
    rank = F.struct("segments", "labels", (F.col("action") == ALLOW).alias("allow"), "action", "pattern", "valid_from")
    decided = active.groupBy("row_id").agg(F.max(rank).alias("best"))
    return rows.join(decided, "row_id", "left").select(
        "page_id", "url", "fetched_at",
        F.coalesce("best.action", F.lit(NONE)).alias("decision"),
        F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("listed_on"),
        (F.coalesce("best.action", F.lit(NONE)) != BLOCK).alias("kept"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time in 2024 that follows from the page id; the table has none."""
    second = F.pmod(F.col("page_id") * 7919, F.lit(366 * 86400))
    return pages.select("page_id", "url", (F.timestamp_seconds(F.lit(1704067200) + second)).alias("fetched_at"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated list changes derived from the hosts of the pages.

    By the smallest page id of a host: hosts blocked for a while, some blocked again; hosts with an
    English section that is allowed; and parent domains blocked.
    """
    hosts = pages.select(host(F.col("url")).alias("host"), "page_id").where("host IS NOT NULL")
    first = stored(hosts.groupBy("host").agg(F.min("page_id").alias("m")), "hosts")
    parent = F.substring_index("host", ".", -2)
    parents = first.groupBy(parent.alias("host")).agg(F.min("m").alias("m"))

    def change(rows, condition, pattern, action, offset, listed):
        day = F.date_add(F.lit("2024-01-01").cast("date"), offset.cast("int"))
        return rows.where(condition).select(
            pattern.alias("pattern"), F.lit(action).alias("action"), day.alias("day"), F.lit(listed).alias("listed")
        )

    m, name = F.col("m"), F.col("host")
    start, third = m * 13 % 300, m % 3 == 0
    parts = [
        change(first, third, name, BLOCK, start, True),
        change(first, third, name, BLOCK, start + 30 + m % 60, False),
        change(first, third & (m % 2 == 0), name, BLOCK, start + 120, True),
        change(first, m % 4 == 0, F.concat(name, F.lit("/en")), ALLOW, m * 7 % 200, True),
        change(first, m % 4 == 0, F.concat(name, F.lit("/en")), ALLOW, m * 7 % 200 + 100, False),
        change(parents, m >= 0, name, BLOCK, m * 5 % 250, True),
        change(parents, m >= 0, name, BLOCK, m * 5 % 250 + 40, False),
    ]
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part)
    return changes


def op10_url_filters(spark, folder: str) -> DataFrame:
    """Every page decided by the list entries active when it was fetched."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return evaluate(page_captures(pages), page_lists(pages)).select(
        "page_id", "url", F.unix_timestamp("fetched_at").alias("fetched_second"), "decision", "pattern",
        F.col("listed_on").cast("string").alias("listed_on"), "kept",
    )


OP10_SQL = r"""
WITH captures AS (
    SELECT row_number() OVER () AS row_id, page_id, url, page_id * 7919 % (366 * 86400) AS second,
           regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)', 2) AS path,
           regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)),
                          '^.*@', ''), '[.]?(:[0-9]*)?$', '') AS host
    FROM pages
), hosts AS (SELECT host, min(page_id) AS m FROM captures WHERE host <> '' GROUP BY host),
parents AS (
    SELECT array_to_string(string_split(host, '.')[-2:], '.') AS host, min(m) AS m FROM hosts GROUP BY 1
), changes AS (
    SELECT host AS pattern, 'block' AS action, m * 13 % 300 AS day, true AS listed FROM hosts WHERE m % 3 = 0
    UNION ALL SELECT host, 'block', m * 13 % 300 + 30 + m % 60, false FROM hosts WHERE m % 3 = 0
    UNION ALL SELECT host, 'block', m * 13 % 300 + 120, true FROM hosts WHERE m % 6 = 0
    UNION ALL SELECT host || '/en', 'allow', m * 7 % 200, true FROM hosts WHERE m % 4 = 0
    UNION ALL SELECT host || '/en', 'allow', m * 7 % 200 + 100, false FROM hosts WHERE m % 4 = 0
    UNION ALL SELECT host, 'block', m * 5 % 250, true FROM parents
    UNION ALL SELECT host, 'block', m * 5 % 250 + 40, false FROM parents
), daily AS (
    SELECT pattern, action, day, bool_or(listed) AS listed FROM changes GROUP BY ALL
), labels AS (
    SELECT row_id, second, path, n, array_to_string(string_split(host, '.')[-n:], '.') AS domain
    FROM captures, LATERAL (SELECT unnest(range(1, len(string_split(host, '.')) + 1)) AS n) WHERE host <> ''
), asked AS (
    SELECT row_id, second, n, s, action,
           domain || CASE WHEN s = 0 THEN '' ELSE '/' || array_to_string(segments[:s], '/') END AS pattern
    FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments FROM labels),
         LATERAL (SELECT unnest(range(0, len(segments) + 1)) AS s),
         (VALUES ('block'), ('allow')) AS actions(action)
), latest AS (
    SELECT asked.*, daily.listed, daily.day FROM asked ASOF JOIN daily
    ON asked.pattern = daily.pattern AND asked.action = daily.action AND asked.second >= daily.day * 86400
), best AS (
    SELECT row_id, arg_max(row(action, pattern, day), row(s, n, action = 'allow')) AS b
    FROM latest WHERE listed GROUP BY row_id
)
SELECT page_id, url, second + 1704067200 AS fetched_second, coalesce(b[1], 'none') AS decision, b[2] AS pattern,
       strftime(DATE '2024-01-01' + b[3]::INTEGER, '%Y-%m-%d') AS listed_on, coalesce(b[1], 'none') <> 'block' AS kept
FROM captures LEFT JOIN best USING (row_id)
"""
