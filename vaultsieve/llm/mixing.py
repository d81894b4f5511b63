"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, word_count

#: Parts into which each size class of a source is dealt, so that no window holds a whole source.
PARTS = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target.

    Sources by code point, null last, take the weights in turn and share `share` of all sizes. A target stops at
    `most` times its source's size; the excess is shared anew by weight until no target is above. In closed form:
    by rising limit / weight, a source is full as long as the level of what is left reaches its limit, and the
    highest level serves all others. Sources of size 0 get 0. The window without a key holds one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rising = Window.orderBy(F.col("ceiling") / F.col("weight"), "rank")
    whole = Window.partitionBy(F.lit(0))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    per = per.withColumn("weight", kinds[F.col("rank") % len(weights)]).withColumn("ceiling", F.col("source_size") * F.lit(most))
    before = F.coalesce(F.sum("ceiling").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - before) / left)
    per = per.withColumn("target", F.least(F.col("ceiling"), F.max("level").over(whole) * F.col("weight")))
    return per.select("source", "source_size", "target")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 1,
    parts: int = PARTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken; with `carry`, also a struct `carried` of these columns of docs.

    Every document of a source is expected target / source_size times. Those expectations are summed along the
    documents of a source by size class, part and size, one offset in [0, 1) per source is added, and a document is
    taken once for each integer that its stretch crosses. As near sizes stand together, the words taken come near the
    target. Offset and order depend on seed, source and doc_id alone, so reruns agree.

    The running place of a document is its place within (source, class, part) plus the counts of the cells before, so
    a source with a third of all rows is dealt over many windows.

    Nulls: a null text has size 0 and its copies take 0 words; a null source is a source, and a null id a document
    like others. Repeated rows are documents of their own; tied ones differ in nothing. No rows give no rows. Other
    columns are left out.
    """
    sizes = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else [])), "mix-sizes")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    cell = ["skey", "kind", "part"]
    sizes = (
        sizes.withColumn("skey", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")))
        .withColumn("kind", F.length(F.bin("size")))
        .withColumn("part", F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % parts)
    )
    per = targets(sizes, weights, share, most)
    per = per.withColumn("skey", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))).drop("source")
    per = per.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "skey")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    cells = sizes.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("skey").orderBy("kind", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).drop("n")
    cells = cells.join(per, "skey").withColumn("u", offset)
    place = F.row_number().over(Window.partitionBy(cell).orderBy("size", F.col("doc_id").asc_nulls_last()))
    out = sizes.withColumn("place", place).join(cells, cell)
    end = F.col("before") + F.col("place")
    crossed = F.floor(end * F.col("rate") + F.col("u")) - F.floor((end - 1) * F.col("rate") + F.col("u"))
    out = out.withColumn("copies", F.least(crossed, F.ceil("rate")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["carried"] if carry else []))


#: The same in one statement, with plain windows over all rows.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS top,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
           - coalesce((SELECT sum(2.0::DOUBLE * b.source_size) FROM s b WHERE 2.0::DOUBLE * b.source_size / b.w < 2.0::DOUBLE * s.source_size / s.w), 0))
         / (SELECT sum(b.w) FROM s b WHERE 2.0::DOUBLE * b.source_size / b.w >= 2.0::DOUBLE * s.source_size / s.w) AS lvl
  FROM s
), t AS (
  SELECT source, source_size, least(top, (SELECT max(lvl) FROM l) * w) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('1/' || CASE WHEN d.source IS NULL THEN '-' ELSE '+' || d.source END), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), ('0x' || substr(md5('1:' || d.doc_id), 1, 6))::BIGINT % {PARTS}, d.size, d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), ceil(rate)) AS BIGINT) * size AS taken
FROM p
"""
