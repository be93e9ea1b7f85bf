"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a host if more than `ratio` of the host's pages contain it
(and at least `least_pages` do). Lines are made distinct within their page before
they are exploded, and counted per host and line with map-side partial sums, so the
shuffle holds one row per host, line and task however hot the host is. A host can
have at most (its distinct lines per page) / ratio boilerplate lines, whatever its
number of pages, so they fit one array per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, sized, written

def line_key(line: Column) -> Column:
    """What two copies of a line share: its text without spaces, tabs and returns at the ends."""
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(pages: DataFrame, *, host: str, text: str, ratio: float, least_pages: int) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines; hosts without any have no row."""
    lines = F.array_distinct(F.transform(F.split(F.col(f"`{text}`"), "\n"), line_key))
    lines = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))
    held = pages.select(F.col(f"`{host}`").cast("string").alias("host"), lines.alias("lines"))
    # One scan gives both counts: the null line stands for the page itself.
    counted = held.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce("lines", F.array().cast("array<long>")))).alias("line"))
    counted = written(counted.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(f"line is null or pages >= {int(least_pages)}"), "line-pages")
    totals = counted.where("line is null").select(F.col("host").alias("of"), F.col("pages").alias("total"))
    often = counted.where("line is not null").join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("pages") > F.lit(ratio) * F.col("total"))
    return written(often.groupBy("host").agg(F.collect_list("line").alias("boilerplate")), "boilerplate")


def without_boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = 0.1, least_pages: int = 3, counts: bool = False) -> DataFrame:
    """pages with the boilerplate lines of their host taken out of `text`; rows and other columns stay as they are.

    With counts, n_lines and n_dropped (long) are added (replaced, if there). Lines are
    what stands between newlines, compared without blanks at their ends; blank lines
    are never boilerplate. A null text stays null (n_lines 0), an empty text has one
    blank line. A null host is a host of its own. Repeated rows are pages of their
    own. A page of boilerplate only keeps its row with an empty text."""
    found = boilerplate(pages, host=host, text=text, ratio=ratio, least_pages=least_pages)
    name = fresh(pages)
    of, known, left = name("of_host"), name("boilerplate"), name("kept_lines")
    found = sized(found, 64 + F.octet_length(F.coalesce("host", F.lit(""))) + 8 * F.size("boilerplate")).select(F.col("host").alias(of), F.col("boilerplate").alias(known))
    own, body = F.col(f"`{host}`"), F.col(f"`{text}`")
    joined = pages.join(found, own.cast("string").eqNullSafe(F.col(of)), "left")
    lines = F.split(body, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(known), F.xxhash64(line_key(x))))
    has = F.col(known).isNotNull() & body.isNotNull()
    joined = joined.withColumn(left, F.when(has, kept))
    new = F.when(has, F.array_join(left, "\n")).otherwise(body)
    out = [new.alias(text) if c == text else F.col(f"`{c}`") for c in pages.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        n = F.when(body.isNull(), 0).otherwise(F.size(lines)).cast("long")
        out += [n.alias("n_lines"), F.when(has, n - F.size(left)).otherwise(0).cast("long").alias("n_dropped")]
    return joined.select(*out)


def line_dedup_sql(ratio: float = 0.1, least_pages: int = 3) -> str:
    """DuckDB SQL for the query over documents."""
    return f"""
    WITH lines AS (SELECT doc_id, source, t.pos, t.line, trim(t.line, ' ' || chr(9) || chr(13)) AS key
                   FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) t),
    totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
    often AS (SELECT l.source, l.key FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE l.key <> ''
              GROUP BY l.source, l.key, t.total HAVING count(DISTINCT l.doc_id) >= {least_pages} AND count(DISTINCT l.doc_id) > {ratio}::DOUBLE * t.total),
    marked AS (SELECT l.*, o.key IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.key = o.key)
    SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
           count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped
    FROM marked GROUP BY doc_id, source
    """
