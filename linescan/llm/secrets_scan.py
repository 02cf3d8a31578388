"""Secret scans with an incremental ledger of scanned blobs.

A blob is a distinct text, addressed by its SHA-256. A ledger table names every
(blob, rule version) pair that has been scanned, with its findings; a scan
reads only the pairs that the ledger lacks and joins findings back to every row
that holds the blob. Positions come from splitting a text at the matches of a
rule: pieces and matches alternate, so their lengths sum up to the starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keep, table

#: kind, version, pattern, and the group whose length must reach a minimum (or None).
#: The order of kinds breaks ties between spans with one start.
RULES = [
    ("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 8)),
    ("access", 1, r"AKIA[A-Z0-9]{12,}", None),
    ("hex", 1, r"[0-9a-f]{32,}", None),
    ("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", None),
]
BASE_KINDS = ["assign", "access", "hex"]

_HEADER, _END = (rf"-----{mark} [A-Z ]*PRIVATE KEY-----" for mark in ("BEGIN", "END"))
#: What follows a header without an END line and is still the key: encryption headers, long runs of base64,
#: lines of nothing else, and what comes behind an escaped line end. Line ends may be escaped or lost.
_KEY_RUN = (
    r"(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+"
    r"|(?:\s|\\[nr])*+(?:[A-Za-z0-9+/]{16,}+=*+|[A-Za-z0-9+/]++=++)"
    r"|[ \t\r]*+\n\s*+[A-Za-z0-9+/]++(?=[ \t\r]*+(?:\n|\z))"
    r"|(?:\\[nr])++[A-Za-z0-9+/]++)*+"
)
#: The rules for redaction: here a private key is all from its header to its END line, not the header alone.
#: RULES, whose header spans are rows of op6_secret_scans, would leave the key's body in the text.
WHOLE_RULES = [r for r in RULES if r[0] != "pem"] + [("pem", 2, rf"{_HEADER}(?:(?:[^-]++|-(?!----))*+{_END}|{_KEY_RUN})", None)]

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Arrays are folded in blocks of so many items, texts are cut in blocks of so many code points.
FOLD_BLOCK, TEXT_BLOCK = 256, 1024
LEDGER_SCHEMA = f"blob string, kind string, version int, spans {SPANS}"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(items: Column, state: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """Array of the states that ``step`` leaves behind blocks of items, the first state in front.

    A state is (at, out); each block begins with an empty out, so that lists grow
    by a block and not by all that came before: time follows the number of items.
    """
    blocks = _let(
        items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / FOLD_BLOCK).cast("int")), lambda b: F.slice(x, b * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)))
    )
    fresh = lambda acc: F.struct(F.element_at(acc, -1)["at"].alias("at"), F.array().cast(kind).alias("out"))
    begin = F.array(F.struct(state.cast("int").alias("at"), F.array().cast(kind).alias("out")))
    return F.aggregate(blocks, begin, lambda acc, block: F.concat(acc, F.array(F.aggregate(block, fresh(acc), step))))


def _spans(text: Column, found: Column, rank: int, rule: tuple) -> Column:
    """Spans of the matches ``found`` in ``text``, in code points, end exclusive."""
    kind, _, pattern, least = rule
    pieces = F.zip_with(F.split(text, pattern), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.coalesce(F.char_length(x["m"]), F.lit(0))
        good = x["m"].isNotNull()
        if least:
            good &= F.char_length(F.regexp_extract(x["m"], pattern, least[0])) >= least[1]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.flatten(_folded(pieces, F.lit(0), SPANS, step)["out"])).otherwise(F.array().cast(SPANS))


def scan_blobs(blobs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """A ledger row for each (blob, rule): ``blobs`` has blob, text and pending,
    the kinds still to be scanned; a text is matched only against those."""
    pending = lambda kind: F.array_contains("pending", kind)
    found = blobs.select("blob", "text", "pending", *(F.when(pending(r[0]), _matches(F.col("text"), r[2])).alias(f"m{i}") for i, r in enumerate(rules)))
    rows = [
        F.when(
            pending(r[0]),
            F.struct(F.lit(r[0]).alias("kind"), F.lit(r[1]).alias("version"), _spans(F.col("text"), F.col(f"m{i}"), i, r).alias("spans")),
        )
        for i, r in enumerate(rules)
    ]
    return found.select("blob", F.filter(F.array(*rows), lambda x: x.isNotNull()).alias("rows")).select("blob", F.inline("rows"))


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, rules: list[tuple] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions``, and the ledger rows that this scan adds.

    ``versions`` has doc_id and text, one row for each historical version of a
    path; other columns are ignored. Null texts count as empty. Repeated rows
    and copies share a blob, which is scanned once, and each row gets its
    findings. ``ledger`` has blob, kind, version, spans; null means none.
    Findings: doc_id, blob, spans (sorted by start, then order of rules). Whole
    texts are scanned, in time that follows their length and the number of spans;
    an empty text has no spans, and no rows give none. Null doc_ids are kept.
    """
    rows = versions.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    asked = F.array(*(F.lit(r[0]) for r in rules))
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        known = None
        todo = blobs.withColumn("pending", asked)
    else:
        current = F.create_map(*(F.lit(x) for r in rules for x in (r[0], r[1])))
        known = ledger.where(F.col("version") == current[F.col("kind")]).dropDuplicates(["blob", "kind"])
        done = known.groupBy("blob").agg(F.collect_set("kind").alias("done"))  # at most a kind for each rule
        pending = F.array_except(asked, F.coalesce("done", F.array().cast("array<string>")))
        todo = blobs.join(done, "blob", "left").select("blob", "text", pending.alias("pending")).where(F.size("pending") > 0)
    added = keep(scan_blobs(todo, rules), "ledger")
    ledger_now = added if known is None else added.unionByName(known.select(*added.columns))
    hits = ledger_now.where(F.size("spans") > 0).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    empty = F.array().cast(SPANS)
    found = rows.select("doc_id", "blob").join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))
    return found, added


def span_string(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``[SECRET]``; ``spans`` are sorted by start.

    Exactly the spans go; scan with WHOLE_RULES, or the bodies of private keys stay.
    """

    def cut_out(blocks: Column) -> Column:
        def part(a: Column, z: Column) -> Column:
            """Code points a to z of the text, from the blocks that hold them."""
            first, last = (F.floor(x / TEXT_BLOCK).cast("int") for x in (a, z - 1))
            held = F.when(first == last, F.element_at(blocks, first + 1)).otherwise(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""))
            return F.when(z > a, F.substring(held, a - first * TEXT_BLOCK + 1, z - a)).otherwise("")

        def step(acc: Column, s: Column) -> Column:
            out = F.concat(acc["out"], F.array(part(acc["at"], s["start"]), F.lit("[SECRET]")))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], out).otherwise(acc["out"]).alias("out"))

        def joined(states: Column) -> Column:
            return F.concat(F.array_join(F.flatten(states["out"]), ""), part(F.element_at(states, -1)["at"], F.char_length(text)))

        return _let(_folded(spans, F.lit(0), "array<string>", step), joined)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(blocks, cut_out)).otherwise(text)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text of ``documents``, scanned blob by blob into a ledger.

    The documents arrive in two deliveries: the first one fills a new ledger, and
    a scan of all of them then reads only the blobs that it lacks.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(True))
    _, ledger = scan_secrets(docs.where(first))
    found, _ = scan_secrets(docs, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    return found.select(
        "doc_id", *(count(k) for k in BASE_KINDS), F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    def spans(rank: int, rule: tuple) -> str:
        kind, _, pattern, least = rule
        p = pattern.replace("'", "''")
        good = f"length(regexp_extract(m[i], '{p}', {least[0]})) >= {least[1]}" if least else "true"
        return (
            f"SELECT doc_id, row_no, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m[i]) AS stop FROM ("
            f"SELECT *, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM ("
            f"SELECT doc_id, row_no, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, row_no, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS p FROM d) WHERE len(m) > 0)"
            f") WHERE {good}"
        )

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row_no FROM documents),
f AS ({' UNION ALL '.join(spans(i, r) for i, r in enumerate(RULES))}),
g AS (
  SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind IN ('assign', 'access', 'hex')) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM f GROUP BY row_no
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_no)
"""


ORACLE_SQL = _oracle()
