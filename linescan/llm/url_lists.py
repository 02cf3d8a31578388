"""URL filters: a temporal join of captures with dated list entries.

Dated entries (a key is listed or delisted on a list from some moment on)
become validity intervals; every capture is then judged by the entries that
were active when it was fetched: an as-of join, written as an equality of keys
with a range on time, which Spark can split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and final dot; null if there is none.

    The user ends at the last ``@`` before the path. An address in brackets is
    given without them, and what follows them is no part of it.
    """
    server = F.regexp_extract(F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1), r"([^@]*)$", 1)
    bracketed = F.regexp_extract(server, r"^\[([^\[\]]*)\]", 1)
    host = F.when(server.startswith("["), bracketed).otherwise(F.regexp_extract(server, r"^([^:\[\]]+)(?::.*)?$", 1))
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of a URL without query and fragment, at least ``/``."""
    path = F.regexp_extract(url, _SCHEME + r"[^/?#]*(/[^?#]*)", 1)
    return F.when(path != "", path).otherwise(F.lit("/"))


def is_address(host: Column) -> Column:
    """Is a host a numeric address, which has no suffixes?"""
    return host.contains(":") | host.rlike(r"^[0-9]+(\.[0-9]+){3}$")


def segments_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_keys(url: Column, most_labels: int | None = None, most_segments: int | None = None) -> Column:
    """Everything a list may name a URL by, most general first: the host's suffixes of
    two labels and more, then host and path up to each segment. Null without a host.

    Of a numeric address only the whole is a key. ``most_labels`` and
    ``most_segments`` leave out longer suffixes and paths, which a list without any
    so long cannot name.
    """
    host = host_of(url)
    labels = F.when(is_address(host), F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    upto = n if most_labels is None else F.least(n, F.greatest(F.lit(most_labels), F.least(F.lit(2), n)))
    suffixes = F.transform(F.sequence(F.least(F.lit(2), n), upto), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))
    segments = segments_of(path_of(url))
    if most_segments is not None:
        segments = F.slice(segments, 1, most_segments) if most_segments > 0 else F.array().cast("array<string>")
    prefixes = F.when(
        F.size(segments) > 0,
        F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(suffixes, prefixes)))


def deepest(entries: DataFrame) -> tuple[int, int]:
    """The most labels of a host, and the most segments of a path, that any entry has: two numbers, whatever the list."""
    path = F.instr("key", "/") > 0
    labels = F.when(~path, F.size(F.split("key", r"\.")))
    segments = F.when(path, F.size(segments_of(F.substring("key", F.instr("key", "/"), F.length("key")))))
    found = entries.agg(F.coalesce(F.max(labels), F.lit(0)), F.coalesce(F.max(segments), F.lit(0))).first()
    return found[0], found[1]


def validity(entries: DataFrame) -> DataFrame:
    """list, key, valid_from, valid_to (null: still open) from entries (list, key, listed, since).

    Each entry holds until the next one of its list and key. Of entries with one
    moment, delisting counts. Entries lacking list, key, listed or since are
    passed over; repeated ones change nothing.
    """
    whole = entries.where("list IS NOT NULL AND key IS NOT NULL AND listed IS NOT NULL AND since IS NOT NULL")
    once = whole.groupBy("list", "key", "since").agg(F.min("listed").alias("listed"))
    by_time = Window.partitionBy("list", "key").orderBy("since")
    spans = once.withColumn("valid_to", F.lead("since").over(by_time))
    return spans.where("listed").select("list", "key", F.col("since").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """What the lists said of each capture when it was fetched.

    ``captures`` has page_id, url, fetched; other columns are ignored. Returns
    one row for each distinct (page_id, url, fetched): n_matches (active
    entries), blocked, and the longest matching key with its list (ties: first
    in order) and the start of its interval. A null or hostless URL, or a null
    moment, matches nothing. Intervals include their start, not their end. URLs may
    have any number of labels and segments; those beyond the list's own are
    not spelled out. Ties between entries of one key go to the first list in order.
    """
    # A fixed number of parts: URLs are short, but taking them apart is work, which too few tasks would share.
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.select("page_id", "url", "fetched").repartition(parts, "page_id", "url", "fetched").distinct()
    keyed = rows.where("fetched IS NOT NULL").select("page_id", "url", "fetched", F.explode(url_keys(F.col("url"), *deepest(entries))).alias("key"))
    spans = validity(entries)
    active = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    hits = keyed.join(spans, "key").where(active)
    rank = F.struct(-F.length("key"), "key", "list", "valid_from")
    hits = hits.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n_matches"), F.min(rank).alias("b"))
    hits = hits.toDF("h_page", "h_url", "h_fetched", "n", "b")
    same = F.col("page_id").eqNullSafe(F.col("h_page")) & F.col("url").eqNullSafe(F.col("h_url")) & (F.col("fetched") == F.col("h_fetched"))
    n = F.coalesce("n", F.lit(0))
    return rows.join(hits, same, "left").select(
        "page_id", "url", "fetched", n.alias("n_matches"), (n > 0).alias("blocked"), "b.key", "b.list", "b.valid_from"
    )


def hours(n: Column) -> Column:
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=n.cast("int"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts and first path segments that the pages hold.

    A third of the hosts and a fifth of the first segments are listed at an hour
    that follows from the key, delisted 200 hours later, and some listed again.
    """
    host, first = host_of(F.col("url")), F.get(segments_of(path_of(F.col("url"))), 0)
    keys = pages.select(host.alias("host"), first.alias("segment")).where("host IS NOT NULL")
    keys = keys.select(F.explode(F.array("host", F.concat_ws("/", "host", "segment"))).alias("key")).distinct()
    code = F.conv(F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    path = F.col("key").contains("/")
    listed = keys.withColumn("code", code).where((path & (F.col("code") % 5 == 0)) | (~path & (F.col("code") % 3 == 0)))
    first = F.floor(F.col("code") / 7) % 400
    dates = F.array(
        F.struct(F.lit(True).alias("listed"), hours(first).alias("since")),
        F.struct(F.lit(False).alias("listed"), hours(first + 200).alias("since")),
        F.when(F.col("code") % 2 == 0, F.struct(F.lit(True).alias("listed"), hours(first + 300).alias("since"))),
    )
    name = F.when(path, "paths").otherwise("hosts")
    return listed.select(name.alias("list"), "key", F.explode(F.filter(dates, lambda d: d.isNotNull())).alias("d")).select("list", "key", "d.listed", "d.since")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as fetched in the hour that its page_id gives, against a dated list of the pages' own hosts and paths."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", hours(F.pmod(F.col("page_id") * 37, F.lit(720))))
    return filter_captures(captures, dated_entries(pages))


_KEYS = r"""
  SELECT *, CASE WHEN host IS NULL THEN [] ELSE list_distinct(
      list_transform(range(least(2, len(labels)), len(labels) + 1), lambda i: array_to_string(labels[len(labels) - i + 1:], '.'))
      || list_transform(range(1, len(segments) + 1), lambda i: host || '/' || array_to_string(segments[1:i], '/'))) END AS keys
  FROM (SELECT *, CASE WHEN contains(host, ':') OR regexp_full_match(host, '[0-9]+(\.[0-9]+){3}') THEN [host] ELSE string_split(host, '.') END AS labels FROM (
    SELECT page_id, url, nullif(rtrim(lower(CASE
        WHEN NOT starts_with(server, '[') THEN CASE WHEN regexp_matches(split_part(server, ':', 1), '[\[\]]') THEN '' ELSE split_part(server, ':', 1) END
        WHEN regexp_matches(server, '^\[[^\[\]]*\]') THEN split_part(server[2:], ']', 1) ELSE '' END), '.'), '') AS host, segments
    FROM (SELECT page_id, url, string_split(authority, '@')[-1] AS server, CASE WHEN contains(place, '/') THEN list_filter(string_split(place, '/')[2:], lambda s: s <> '') ELSE [] END AS segments
      FROM (SELECT page_id, url, place, split_part(place, '/', 1) AS authority
        FROM (SELECT page_id, url, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://')
            THEN split_part(split_part(substr(url, position('://' IN url) + 3), '#', 1), '?', 1) ELSE '' END AS place FROM pages)))))
"""
ORACLE_SQL = f"""
WITH k AS ({_KEYS}),
named AS (SELECT host AS key FROM k WHERE host IS NOT NULL UNION SELECT host || '/' || segments[1] FROM k WHERE host IS NOT NULL AND len(segments) > 0),
coded AS (
  SELECT key, contains(key, '/') AS is_path, CAST('0x' || sha256(key)[1:8] AS BIGINT) AS code FROM named
),
listed AS (SELECT *, CAST(floor(code / 7) AS BIGINT) % 400 AS first_hour, CASE WHEN is_path THEN 'paths' ELSE 'hosts' END AS list FROM coded
  WHERE (is_path AND code % 5 = 0) OR (NOT is_path AND code % 3 = 0)),
entries AS (
  SELECT list, key, true AS listed, TIMESTAMP '2024-01-01' + to_hours(first_hour) AS since FROM listed
  UNION ALL SELECT list, key, false, TIMESTAMP '2024-01-01' + to_hours(first_hour + 200) FROM listed
  UNION ALL SELECT list, key, true, TIMESTAMP '2024-01-01' + to_hours(first_hour + 300) FROM listed WHERE code % 2 = 0
),
spans AS (SELECT list, key, since AS valid_from, lead(since) OVER (PARTITION BY list, key ORDER BY since) AS valid_to, listed FROM entries),
captures AS (SELECT DISTINCT page_id, url, keys, TIMESTAMP '2024-01-01' + to_hours(page_id * 37 % 720) AS fetched FROM k),
hits AS (
  SELECT c.page_id, c.url, c.fetched, s.* FROM (SELECT page_id, url, fetched, unnest(keys) AS key FROM captures) c JOIN spans s ON s.key = c.key
  WHERE s.listed AND c.fetched >= s.valid_from AND (s.valid_to IS NULL OR c.fetched < s.valid_to)
),
firsts AS (
  SELECT *, count(*) OVER (PARTITION BY page_id, url, fetched) AS n FROM hits
  QUALIFY row_number() OVER (PARTITION BY page_id, url, fetched ORDER BY length(key) DESC, key, list, valid_from) = 1
)
SELECT c.page_id, c.url, c.fetched, coalesce(f.n, 0) AS n_matches, f.n IS NOT NULL AS blocked, f.key, f.list, f.valid_from
FROM captures c LEFT JOIN firsts f ON f.page_id = c.page_id AND f.url = c.url AND f.fetched = c.fetched
"""
