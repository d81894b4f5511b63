"""Training records: checks, splits without leaks, and statistics of what could give labels away.

Splits are by the order of a digest of a key and a seed: the same on every run and cluster, and no random state is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultsieve.functions.text import contains_any, entropy, starts_any

#: Tokens that keep their labels and pairs, words that keep a positive label, and prefixes of vendors.
PROTECTED = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghr_", "sk_live_", "rk_live_")
UNPAIRED = (*PROTECTED, "sk-proj-")
CLEAR_WORDS = ("secret", "password", "credential")
VENDORS = ("AKIA", "ghp_", "sk_", "xox")
AUTH_WORDS = ("api", "key", "token", "secret", "password", "auth")
LINE_TOKENS = (r"[\"']([A-Za-z0-9+/=_\-\.]{6,})[\"']", r"=\s*([A-Za-z0-9+/=_\-\.]{6,})", r":\s*([A-Za-z0-9+/=_\-\.]{6,})")
PLACEHOLDER = r"(?i)YOUR_|_HERE\b|CHANGEME|REPLACE_ME|INSERT_|EXAMPLE_|PLACEHOLDER|X{7,}"


def errors(number: Column) -> Column:
    """What is wrong with a record whose fields were read as strings and arrays: an array of messages, empty if valid."""
    line = F.concat(F.lit("Line "), number.cast("string"), F.lit(": "))
    tests = [(F.col(f).isNull(), f"Missing required field '{f}'") for f in ("token", "line_content", "context_before", "context_after", "label")]
    tests.append((F.col("label").isNotNull() & ~F.col("label").isin(0, 1), "'label' must be 0 or 1"))
    return F.filter(F.array(*[F.when(bad, F.concat(line, F.lit(what))) for bad, what in tests]), lambda x: x.isNotNull())


def text_errors(text: Column, number: Column) -> Column:
    """What is wrong with a record that is a line of JSON, types included: an array of messages, empty if valid. A line that can't be parsed, or is no object, has one message of its own."""
    record = F.try_parse_json(text)
    line = F.concat(F.lit("Line "), number.cast("string"), F.lit(": "))
    kind = {f: F.schema_of_variant(F.variant_get(record, f"$.{f}", "variant")) for f in ("token", "line_content", "context_before", "context_after", "label")}
    whole = F.schema_of_variant(record)
    tests = [(kind[f].isNull(), f"Missing required field '{f}'") for f in kind]
    tests += [(kind[f] != "STRING", f"'{f}' must be a string") for f in ("token", "line_content")]
    tests += [(~kind[f].startswith("ARRAY"), f"'{f}' must be a list") for f in ("context_before", "context_after")]
    label = kind["label"]
    one = F.when(label == "BOOLEAN", True).when(label == "BIGINT", F.try_variant_get(record, "$.label", "bigint").isin(0, 1)).otherwise(False)
    tests.append((label.isNotNull() & ~one, "'label' must be 0 or 1"))
    found = F.filter(F.array(*[F.when(bad, F.concat(line, F.lit(what))) for bad, what in tests]), lambda x: x.isNotNull())
    return F.when(whole.isNull() | ~whole.startswith("OBJECT"), F.array(F.concat(line, F.lit("not a JSON object")))).otherwise(found)


def record_key() -> Column:
    return F.sha1(F.concat_ws("|", "token", "line_content"))


def first_of_each(records: DataFrame, order: str) -> DataFrame:
    """The first record of each token and line. The minimum is combined before the shuffle, unlike a window's ranks."""
    names = records.columns
    kept = records.withColumn("key", record_key()).groupBy("key").agg(F.min_by(F.struct(*names), order).alias("r"))
    return kept.select("r.*")


def digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def ranked(rows: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    """_place (from 1) and _n within each stratum, in digest order. A stratum is dealt over 256 digest prefixes, so that a large one is no single window: a row's place is its place in the prefix plus the rows of smaller prefixes."""
    cell = [*strata, "_prefix"]
    rows = rows.withColumn("_digest", digest(key, seed)).withColumn("_prefix", F.substring("_digest", 1, 2))
    sizes = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("_here"))
    of, before = Window.partitionBy(*strata), Window.partitionBy(*strata).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_n": F.sum("_here").over(of), "_before": F.coalesce(F.sum("_here").over(before), F.lit(0))}).drop("_here")
    inner = F.row_number().over(Window.partitionBy(*cell).orderBy("_digest", key))
    return rows.withColumn("_inner", inner).join(sizes, cell).withColumn("_place", F.col("_before") + F.col("_inner")).drop("_inner", "_before", "_prefix", "_digest")


def split(rows: DataFrame, ratios: dict[str, float], strata: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """split by truncated shares of each stratum; the last split takes the rest."""
    name, bound = F.lit(list(ratios)[-1]), 0.0
    cuts = []
    for split_name, ratio in list(ratios.items())[:-1]:
        bound += ratio
        cuts.append((split_name, bound))
    for split_name, cut in reversed(cuts):
        name = F.when(F.col("_place") <= F.floor(F.col("_n") * F.lit(cut)), split_name).otherwise(name)
    return ranked(rows, strata, key, seed).withColumn("split", name).drop("_place", "_n")


def empty_splits(rows: DataFrame, ratios: dict[str, float], strata: Sequence[str]) -> DataFrame:
    """One row for each split that a stratum leaves empty: the strata's columns, n, split, message. A caller who wants an error joins on it or raises; `checked_split` does."""
    counts, ends, bound = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")), [], 0.0
    for name, ratio in list(ratios.items())[:-1]:
        bound += ratio
        ends.append((name, F.floor(F.col("n") * F.lit(bound))))
    ends.append((list(ratios)[-1], F.col("n")))
    sizes = [F.struct(F.lit(name).alias("split"), (end - before).alias("size")) for (name, end), before in zip(ends, [F.lit(0), *(e for _, e in ends[:-1])], strict=True)]
    label = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in strata])
    shares = "/".join(f"{x:g}" for x in ratios.values())
    message = F.concat(F.lit("Stratum '"), label, F.lit("' ("), F.col("n").cast("string"), F.lit(" records) produced an empty '"), F.col("split"), F.lit(f"' split with ratios {shares}. Provide more data for this stratum."))
    return counts.select(*strata, "n", F.inline(F.array(*sizes))).where("size <= 0").select(*strata, "n", "split", message.alias("message"))


def checked_split(rows: DataFrame, ratios: dict[str, float], strata: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """split(), but a ratio of nothing for the last split, or a split that a stratum leaves empty, stops it."""
    if sum(list(ratios.values())[:-1]) >= 1:
        raise ValueError(f"Ratios sum to >= 1.0: {ratios}")
    if first := empty_splits(rows, ratios, strata).select(F.min("message")).first()[0]:
        raise ValueError(first)
    return split(rows, ratios, strata, key, seed)


def folds(rows: DataFrame, k: int, strata: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """fold 0 .. k - 1 within each stratum; the first folds take the remainder."""
    made = ranked(rows, strata, key, seed)
    r, q, m = F.col("_place") - 1, F.floor(F.col("_n") / k), F.col("_n") % k
    fold = F.when(r < m * (q + 1), F.floor(r / (q + 1))).otherwise(m + F.floor((r - m * (q + 1)) / F.greatest(q, F.lit(1))))
    return made.withColumn("fold", fold.cast("long")).drop("_place", "_n")


def folds_in_place(rows: DataFrame, k: int, strata: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """The folds of folds() for few strata, none of them null, without a shuffle of the rows: a fold is a range of its stratum's digests, whose first one is found by counts of prefixes and then in one prefix. The rows are read twice here, so they should be kept."""
    told = rows.select(*strata, F.col(key).alias("key"), digest(key, seed).alias("digest")).withColumn("prefix", F.substring("digest", 1, 2))
    sizes: dict[tuple, list] = {}
    for r in told.groupBy(*strata, "prefix").agg(F.count(F.lit(1)).alias("n")).orderBy("prefix").collect():  # 256 rows a stratum
        sizes.setdefault(tuple(r[: len(strata)]), []).append((r["prefix"], r["n"]))
    of = lambda values: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(strata, values, strict=True)], F.lit(True))
    firsts = []
    for values, cells in sizes.items():
        q, m = divmod(sum(n for _, n in cells), k)
        for place in (f * q + min(f, m) for f in range(1, k)):
            before = 0
            for prefix, n in cells:
                if before <= place < before + n:
                    firsts.append((values, prefix, place - before + 1))
                before += n
    fold = F.lit(0)
    if firsts:
        inner = F.row_number().over(Window.partitionBy(*strata, "prefix").orderBy("digest", "key"))
        few = told.where(reduce(lambda a, b: a | b, [of(v) & (F.col("prefix") == p) for v, p, _ in firsts])).withColumn("place", inner)
        found = few.where(reduce(lambda a, b: a | b, [of(v) & (F.col("prefix") == p) & (F.col("place") == i) for v, p, i in firsts])).collect()  # k - 1 rows a stratum at most
        at = digest(key, seed)
        for r in found:
            fold = fold + (of(r[: len(strata)]) & ((at > r["digest"]) | ((at == r["digest"]) & (F.col(key) >= F.lit(r["key"]))))).cast("long")
    return rows.withColumn("fold", fold.cast("long"))


def without_leaks(splits: dict[str, DataFrame], budget: float = 0.2) -> tuple[dict[str, DataFrame], DataFrame]:
    """Splits in order of priority, later ones without the tokens of earlier ones as filtered so far, and how many rows went. A record in two splits, or a split that loses more than the budget, is an error the caller reads from the second table."""
    kept: dict[str, DataFrame] = {}
    told = None
    for name, rows in splits.items():
        whole = rows
        for earlier in kept.values():
            rows = rows.join(earlier.select("token").distinct(), "token", "left_anti")
        kept[name] = rows
        both = whole.select(F.lit(0).alias("left")).unionByName(rows.select(F.lit(1).alias("left")))
        row = both.agg(F.count_if(F.col("left") == 0).alias("before"), F.count_if(F.col("left") == 1).alias("after"))
        row = row.select(F.lit(name).alias("split"), "before", "after", (F.col("before") - F.col("after") > budget * F.col("before")).alias("over_budget"))
        told = row if told is None else told.unionByName(row)
    return kept, told


def same_records(splits: dict[str, DataFrame]) -> DataFrame:
    """Records that are in more than one split."""
    every = None
    for name, rows in splits.items():
        part = rows.select(record_key().alias("key"), F.lit(name).alias("split"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("key").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def type_key() -> Column:
    return F.when(F.col("label") == 1, F.coalesce("secret_type", F.lit("unknown_positive"))).otherwise(F.coalesce("negative_type", F.lit("unknown_negative")))


def class_weight(factor: float = 1.0) -> Column:
    """Negatives over positives, scaled; 1 without positives."""
    return F.when(F.sum("label") > 0, (F.count(F.lit(1)) - F.sum("label")) / F.sum("label") * factor).otherwise(1.0)


def noisy(records: DataFrame, key: str, rate: float = 0.08, seed: int = 42) -> DataFrame:
    """A share of the labels flipped, chosen by digest; well-known tokens and clear positives keep theirs. Adds flipped."""
    chance = F.conv(F.substring(digest(key, seed), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))
    safe = starts_any(F.col("token"), PROTECTED) | ((F.col("label") == 1) & contains_any(F.lower("line_content"), CLEAR_WORDS))
    flip = (chance <= rate) & ~safe
    return records.withColumn("flipped", flip).withColumn("label", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")))


def contrastive(records: DataFrame, key: str, share: float = 0.1, seed: int = 7) -> DataFrame:
    """For a share of the records, the same token under a name that says the opposite, as a negative; positives in a known format have no pair."""
    chance = F.conv(F.substring(digest(key, seed), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))
    benign = F.array(*[F.lit(x) for x in ("example_key", "placeholder_token", "revoked_token", "mock_credential")])
    grave = F.array(*[F.lit(x) for x in ("api_key", "auth_token", "password", "secret_key")])
    at = (F.conv(F.substring(digest(key, seed), 7, 4), 16, 10).cast("int") % 4).cast("int")
    name = F.when(F.col("label") == 1, F.get(benign, at)).otherwise(F.get(grave, at))
    chosen = records.where((chance < share) & ~((F.col("label") == 1) & starts_any(F.col("token"), UNPAIRED)))
    return chosen.withColumn("line_content", F.concat(name, F.lit(' = "'), "token", F.lit('"'))).withColumn("label", F.lit(0))


def best_token(line: Column) -> Column:
    """The token of the line with the highest entropy (struct of token and entropy): long enough for its entropy, no placeholder; the earliest of equals (to nine places, so that the order of adding up decides nothing)."""
    floor = lambda t: F.when(F.length(t) <= 6, 3.2).when(F.length(t) >= 20, 2.0).otherwise(3.2 - (F.length(t) - 6) * (1.2 / 14))
    found = F.concat(*[F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in LINE_TOKENS])
    good = F.filter(F.transform(found, lambda t: F.struct(t.alias("token"), F.round(entropy(t), 9).alias("entropy"))), lambda x: (x["entropy"] >= floor(x["token"])) & ~x["token"].rlike(PLACEHOLDER))
    none = F.struct(F.lit(None).cast("string").alias("token"), F.lit(0.0).alias("entropy"))
    return F.aggregate(good, none, lambda best, x: F.when(x["entropy"] > best["entropy"], x).otherwise(best))


def truncated(text: Column, most: int = 2048) -> Column:
    return F.substring(text, 1, most)
