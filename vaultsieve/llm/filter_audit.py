"""Filter interaction audit: what each order of a set of filters removes, from counts of failure masks by a subset-zeta transform."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

FILTERS = "ABCDE"
#: Filters that look at one text; the last one looks at the whole table.
_OWN = 4


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails: bit i for the i-th."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    tests = [
        n < 50,
        F.size(F.array_distinct(words)) * F.lit(100) < n * F.lit(65),
        F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100) > F.length(text) * F.lit(5),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents of a part by the set of filters that they fail, and how many of these are labelled good and toxic.

    Texts travel as their SHA-256. Equal rows are added up before anything is joined on a text, so a text of many copies
    is joined as one row for each part and label, and a document fails the last filter if its text's least id is below its own.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("x")).where("id is not null")
    marks = marks.groupBy("id").agg(F.max(F.coalesce(F.col("q") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("x") == 1, F.lit(False))).alias("toxic"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failures(text).alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    rows = own.groupBy("sha", "id", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # Ids are distinct within (sha, part, labels) now, so the least one's own count is that of the documents that have it.
    kinds = rows.groupBy("sha", "own", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    first = kinds.groupBy("sha").agg(F.min("least.id").alias("first"), F.sum("n").alias("copies")).where("copies > 1").drop("copies")
    kinds = kinds.join(first, "sha", "left")
    # A null id is larger than all others; rows of null ids have no smaller one if no row of the text is named.
    stays = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("own").alias("mask"), stays.alias("n")), F.struct((F.col("own") + (1 << _OWN)).alias("mask"), (F.col("n") - stays).alias("n")))
    split = kinds.select("part", "good", "toxic", F.inline(both))
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def survivors(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part: the counts by mask (`exact`) and, for documents (n), good and toxic ones, an array over all sets of filters of how many documents fail none of the set."""
    size = 1 << len(filters)
    at = lambda c: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(F.lit(0))).cast("long") for m in range(size)])
    names = ("n", "good", "toxic")
    rows = counts.groupBy("part").agg(*[at(c).alias(c) for c in names])
    for b in range(len(filters)):  # one step of the transform a projection: its input is not computed anew
        step = 1 << b
        add = lambda c, step=step: F.transform(F.col(c), lambda x, i: F.when(i.bitwiseAND(F.lit(step)) != 0, x + F.get(F.col(c), i.bitwiseXOR(F.lit(step)))).otherwise(x))
        rows = rows.select("part", *([F.col("n").alias("exact")] if not b else ["exact"]), *[add(c).alias(c) for c in names])
    # The documents that fail none of a set are those whose mask lies in its complement: the array in reverse.
    return rows.select("part", "exact", *[F.reverse(c).alias(c) for c in names])


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each part, order of the filters and step.

    Filters: A under 50 words, B distinct words under 65 % of words, C capitals A-Z over 5 % of code points, D any of
    #$%&*|, E a text that also has a smaller doc_id anywhere in the table. A null text is empty, a null part the empty
    string. Repeated rows of an id count each and are no copies of each other; a null id is larger than all ids, and
    rows of null ids are no copies of each other. Repeated labels of an id: good or toxic if any row says so. Whole
    texts are read. Without documents there are no rows. Other columns are left out.

    A step of an order is the difference of two neighbouring subsets' survivors, and so are the labels lost. shapley is the sum of
    a filter's removals over all orders.
    """
    rows = survivors(mask_counts(docs, labels, **columns))
    steps, times = [], {}
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[i] for i in order), k + 1, 1 << f, before, before | 1 << f))
            times[1 << f, before] = times.get((1 << f, before), 0) + 1
            before |= 1 << f
    table = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","k":{k},"f":{f},"a":{a},"b":{b}}}' for o, k, f, a, b in steps) + "]"), "array<struct<o:string,k:int,f:int,a:int,b:int>>")
    lost = lambda c, a, b: F.get(F.col(c), a) - F.get(F.col(c), b)
    shapley = F.array(*[sum((lost("n", F.lit(a), F.lit(a | g)) * n for (g, a), n in times.items() if g == 1 << i), F.lit(0).cast("long")) for i in range(len(FILTERS))])
    rows = rows.select("*", shapley.alias("shares")).select("*", F.inline(table))
    removed = lost("n", F.col("a"), F.col("b"))
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("k").alias("step"), F.get("n", F.col("b")).alias("kept"), removed.alias("removed"),
        (lost("n", F.lit(0), F.col("f")) - removed).alias("redundant"), F.get("exact", F.col("f")).alias("unique_fails"),
        lost("good", F.col("a"), F.col("b")).alias("good_lost"), lost("toxic", F.col("a"), F.col("b")).alias("toxic_lost"),
        F.get("shares", F.log2(F.col("f").cast("double")).cast("int")).alias("shapley"),
    )


#: The same with a mask for each document and every order walked filter by filter.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 5 * length(d.text), regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS f
  FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN lab ON d.doc_id = lab.doc_id),
kinds AS (SELECT part, good, toxic, f, count(*) AS n FROM fails GROUP BY ALL),
orders AS (SELECT [i] AS o FROM range(1, 6) t(i) UNION ALL SELECT list_append(o, i) FROM orders, range(1, 6) t(i) WHERE NOT list_contains(o, i)),
steps AS (SELECT o, k, o[k] AS own, o[1:k - 1] AS before FROM orders, range(1, 6) t(k) WHERE len(o) = 5),
walked AS (SELECT part, o, k, own, n, good, toxic, f[own] AS failing, len(list_filter(before, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda x: x)) = 1 AS alone FROM kinds, steps),
sums AS (SELECT part, o, k, own, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failing AND alone THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND failing AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing AND toxic THEN n ELSE 0 END) AS toxic_lost FROM walked GROUP BY part, o, k, own)
SELECT part, array_to_string([substr('ABCDE', i::INT, 1) FOR i IN o], '') AS filter_order, k::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums
"""
