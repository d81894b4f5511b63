"""URL filters: rules by host and path first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultsieve.sources.package import ship

from . import hashing
from .common import staged
from .presence import Presence
from .toxicity import fit

# What the labelled URLs are made of.
_BLOCKED = "casino poker slots jackpot roulette betting bets bingo lottery pills viagra pharmacy meds adult porn xxx sex escort dating nude ads adserver adclick banner popunder track tracker tracking clicks affiliate spam malware virus phish warez cracked torrent keygen payday loans replica hacked".split()
_ALLOWED = "news blog wiki docs library museum school college science history health weather recipes garden travel maps sports music books cinema city council parks forum photo design garage kitchen village market bakery river mountain letters studio radio press journal research archive atlas essex sussex middlesex address brackets trackandfield betsy adsorption roads goads heads pillow pillar spamalot exact classic advice adam adriatic adulthood windows winter winner farm farms free cheap".split()
_JOINED = ("home", "24", "daily", "online", "best", "hub", "my", "top")
_SYLLABLES = "ka ri to ben sol mer the ing tion ou har lan vi dor pe nas qui zel fo gra un sha mi ster".split()
_PATHS = ("/", "/index.html", "/en/104.html", "/de/7", "/2020/05/a-story/", "/fr/88/", "/about", "/item/33")
_SUFFIXES = ("com", "org", "info", "co.uk", "io", "net", "test", "de")

#: Lengths of n-grams in bytes, bits of their hash, labelled rows that are learned from at most.
LENGTHS, BITS, SAMPLE = (3, 4, 5), 16, 20_000
#: Weighs half the squared weights against the sum of losses.
DECAY = 0.05
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table, url and label (1: block), by rule from the word lists above: each word as a host's part, joined to a good or neutral one, and in a path. Good words, some of which look like bad ones, come in the same shapes, and so do hosts of mere syllables, so that nothing but the words tells."""
    made = []
    for kind, words in ((1, _BLOCKED), (0, _ALLOWED)):
        for i, w in enumerate(words):
            j, s, p, a = (lambda k, x=x, i=i: x[(i + k) % len(x)] for x in (_JOINED, _SUFFIXES, _PATHS, _ALLOWED))
            made += [(url, kind) for url in (
                f"http://{w}-{j(0)}.{s(0)}{p(0)}", f"https://www.{j(1)}-{w}.{s(1)}{p(3)}", f"https://{w}.{j(2)}.{s(2)}{p(5)}", f"http://m.{w}{j(4)}.{s(4)}{p(6)}",
                f"http://{j(3)}{w}.{s(5)}{p(1)}", f"https://blog.{w}s.{s(3)}{p(2)}", f"http://www.{w}.{s(6)}{p(4)}", f"http://{j(5)}.{s(6)}/{w}/{i}.html", f"https://www.{j(6)}.{s(7)}/en/{w}-{j(7)}",
                f"http://{w}-{a(5)}.{s(0)}{p(2)}", f"https://{w}-{a(-30)}.{s(3)}{p(5)}", f"http://{a(9)}-{w}.{s(0)}{p(7)}", f"https://m.{a(-14)}-{w}.{s(2)}{p(4)}", f"https://{j(1)}.{s(0)}/{w}/", f"http://{j(2)}.{s(1)}/{a(3)}/{w}",
            )]
    n = len(_SYLLABLES)
    for i in range(n * n):
        host = _SYLLABLES[i % n] + _SYLLABLES[i // n] + _SYLLABLES[i * 7 % n] * (i % 3 == 0)
        made.append((f"http{'s' * (i % 2)}://{('', 'www.', 'm.', 'blog.')[i * 5 % 4]}{host}.{_SUFFIXES[i * 3 % 8]}{_PATHS[(i + i // n) % 8]}", 0))
    return made


def split_url(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case. Path: from there up to ?, # or the end. Both are empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule (host, then path from its first /) that fits, and its verdict; null if none does. It fits its host and all hosts below, and paths that start with its own. Of equally long ones the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(host: pa.Array, path: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with the distinct (row, hash) pairs of the n-grams of their hosts, between a dot at each end, and of their paths in lower case. Both are hashed apart from each other."""
    for which, column in enumerate((host, path)):
        edge = b"." if not which else b""
        column = pa.array([edge + (x or "").encode() + edge for x in column.to_pylist()], pa.binary())
        for first, last, data, offsets in hashing.chunks(column, 1 << 20):
            data = hashing.LOWER[data].astype(np.uint32)
            ends = np.repeat(offsets[1:], np.diff(offsets))
            run, pairs = np.zeros(len(data), np.uint32), [np.zeros(0, np.int64)]
            for n in range(1, min(len(data), max(LENGTHS)) + 1):
                run = run[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
                if n in LENGTHS:
                    x = (run ^ (run >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n + 64 * which)
                    at = np.flatnonzero(np.arange(n, len(data) + 1) <= ends[: len(run)])
                    rows = np.searchsorted(offsets, at, "right") - 1
                    pairs.append(rows.astype(np.int64) << BITS | ((x ^ (x >> np.uint32(13))) >> np.uint32(32 - BITS))[at].astype(np.int64))
            found = np.unique(np.concatenate(pairs))
            yield first, last, found >> BITS, found & ((1 << BITS) - 1)


def margins(host: pa.Array, path: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    """The sum of the weights of each row's n-grams: an n-gram that host and path share counts in both."""
    out = np.full(len(host), bias)
    for first, last, row, slot in grams(host, path):
        out[first:last] += np.bincount(row, weight[slot], minlength=last - first)
    return out


def train(urls: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights by hash, and the offset, from (url, label) rows; at most `sample` of them, by the order of a hash. Null labels are left out, repeated rows of a URL count once, as blocked if any row says so. Without rows only an offset below 0."""
    host, path = split_url(F.col("url"))
    rows = urls.where("label is not null and url is not null").groupBy("url").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    few = staged(rows.orderBy(F.xxhash64("url"), "url").limit(sample).select(host.alias("host"), path.alias("path"), "label"), "labelled-urls")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for first, last, row, slot in grams(batch.column(0), batch.column(1)):
                for i, part in enumerate(np.split(slot, np.searchsorted(row, np.arange(1, last - first)))):
                    slots[first + i].append(part)
            rows = [np.unique(np.concatenate(x)).astype(np.int32) for x in slots]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(rows, pa.list_(pa.int32()))], names=["label", "slots"])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        # One group: the sample's size is bounded by a parameter.
        weight, bias = fit(Presence(part["slots"], 1 << BITS), part["label"].to_numpy(float), np.ones(1 << BITS), decay=DECAY)
        at = np.flatnonzero(weight)
        return pd.DataFrame({"slots": [at.tolist()], "weights": [weight[at].tolist()], "bias": [bias]})

    made = few.mapInArrow(present, "label int, slots array<int>").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "slots array<int>, weights array<double>, bias double").collect()
    weight = np.zeros(1 << BITS)
    if not made:
        return weight, float(np.log(0.5))
    weight[made[0]["slots"]] = made[0]["weights"]
    return weight, made[0]["bias"]


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, score, verdict for every row: the longest rule that fits decides, else the classifier, which blocks from a score of 0.5.

    labelled (url, label; 1: block) is learned from, at most `sample` rows; by default the small table of this module.
    Whole hosts and paths are read, whatever their length. A null URL, or one without ://, has an empty host and path: no rule fits, and
    its score is that of no n-grams but the empty host's. An empty path starts with no rule's path. Repeated rows are judged alike, null ids
    stay, other columns are left out, and no rows give none.
    """
    spark = pages.sparkSession
    ship(spark)
    weight, bias = train(labelled_table(spark) if labelled is None else labelled, sample)
    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    held = spark.sparkContext.broadcast((weight, bias))  # 2 ** BITS numbers, whatever is judged

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = held.value
        for batch in batches:
            total = margins(batch.column(1), batch.column(2), weight, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -50, 50))))], names=["page_id", "host", "path", "score"])

    kinds = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())])
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.mapInArrow(apply, kinds).select("page_id", "host", "path", rule.alias("rule"), "score", F.coalesce(said, learned).alias("verdict"))
