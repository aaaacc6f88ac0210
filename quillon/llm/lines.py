"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Every line is known by a 128-bit hash;
a HyperLogLog sketch of its sites is built for each hash, merged by aggregation (partial
sketches meet, rows don't). Lines whose estimate is clearly below or above the threshold are decided by
it, and those below are not looked at again; those near it get an exact distinct count. Of a boilerplate line one occurrence
stays, the first by document and position, so that no text leaves the corpus altogether and copies
of one document don't wipe each other out.

DataFrame functions only. Texts don't travel with their lines: what goes through the shuffles is a
hash, a site and a position, and at last the positions to drop go to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, spare

LAST = (1 << 63) - 1
#: Tables of lines are broadcast up to so many rows, of under 100 bytes each; beyond that both sides are shuffled.
BROADCAST_ROWS = 1 << 18


def _exploded(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("k1"), F.xxhash64(F.col(text_col).cast("string")).alias("k2"), F.col(site_col).cast("string").alias("site"), text.alias("t"))
    rows = rows.select("k1", "k2", "site", F.posexplode(F.split("t", "\n")).alias("pos", "line")).where("length(trim(line)) > 0")
    return rows.select("k1", "k2", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions `gone`."""
    left = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone)
    # the outer transform binds the lines once
    return F.transform(F.array(F.split(text, "\n")), lambda ls: F.array_join(F.transform(left(ls), lambda i: ls[i]), "\n"))[0]


def boilerplate(rows: DataFrame, min_sites: int, margin: float = 0.1, lg_k: int = 12) -> DataFrame:
    """(k1, k2, pos) of the occurrences, but the first, of lines on at least `min_sites` sites.

    The margin is over six standard errors of a sketch of 2^12 registers.
    """
    low, high = int(min_sites * (1 - margin)) - 1, min_sites * (1 + margin) + 1
    line = ["h1", "h2"]
    spread = F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")
    seen = cut(rows.groupBy(*line).agg(spread, F.min(F.struct("k1", "k2", "pos")).alias("lead")).where(F.col("sites") >= low))
    few = F.broadcast(seen) if seen.count() <= BROADCAST_ROWS else seen
    found = rows.join(few, line).select(*line, "k1", "k2", "pos", "site", (F.col("sites") <= high).alias("near"), (F.struct("k1", "k2", "pos") == F.col("lead")).alias("first"))
    found = cut(found)  # of all lines, those that the sketches don't rule out
    # a line that is everywhere shrinks to its sites before it is dealt out by its hash
    pairs = found.where("near and site is not null").select(*line, "site").distinct()
    exact = cut(pairs.groupBy(*line).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select(*line))
    if exact.count() <= BROADCAST_ROWS:
        exact = F.broadcast(exact)
    again = found.where("not first")
    place = ["k1", "k2", "pos"]
    return again.where("not near").select(*place).union(again.where("near").join(exact, line).select(*place))


def dedup_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: bool = False) -> DataFrame:
    """`docs` with boilerplate lines taken out of `text_col`; every row and every other column stays.

    Lines are split at \\n and compared as they are; lines of spaces only are never boilerplate.
    A null site is no site. A null text stays null. Null ids come last when the first occurrence is sought, and
    rows that repeat id and text count as one document. Texts and lines of any length are taken whole. With `counts`, n_lines and n_removed
    are added (replaced where `docs` has them).
    """
    if min_sites < 2:
        raise ValueError("a line on one site is no boilerplate")
    rows = _exploded(docs, id_col, text_col, site_col)
    k1, k2, gone = spare(docs, "k1", "k2", "gone")
    drop = boilerplate(rows, min_sites).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set("pos").alias(gone))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({k1: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), k2: F.xxhash64(text)})
    out = keyed.join(drop, [k1, k2], "left")
    new = {text_col: F.when(F.col(gone).isNull(), text).otherwise(_without(text, F.col(gone)))}
    if counts:
        new |= {"n_lines": F.coalesce(F.size(F.split(text, "\n")), F.lit(1)).cast("long"), "n_removed": F.coalesce(F.array_size(gone), F.lit(0)).cast("long")}
    names = [*docs.columns, *[c for c in ("n_lines", "n_removed") if counts and c not in docs.columns]]
    return out.withColumns(new).select(*names)


def line_dedup_sql(min_sites: int = 10) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
g AS (SELECT line, min({{'d': doc_id, 'p': pos}}) AS lead FROM l WHERE length(trim(line)) > 0
      GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
r AS (SELECT l.doc_id, l.pos, l.line, g.line IS NOT NULL AND lead != {{'d': l.doc_id, 'p': l.pos}} AS gone
      FROM l LEFT JOIN g ON l.line = g.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM r GROUP BY doc_id"""
