"""Column functions that run over Arrow batches in the tasks: entropies of many short texts, and which patterns a text holds.

Both give what Spark's own expressions give, bit by bit. Only the columns that are asked about travel to Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts and bytes that are counted at once, and the length up to which terms are looked up.
ROWS, BYTES, SHORT = 4096, 2**20, 255
_LG = (6.666666666666735130e-01, 3.999999999940941908e-01, 2.857142874366239149e-01, 2.222219843214978396e-01, 1.818357216161805012e-01, 1.531383769920937332e-01, 1.479819860511658591e-01)
_LN2_HIGH, _LN2_LOW = 6.93147180369123816490e-01, 1.90821492927058770002e-10


def natural_log(x: np.ndarray) -> np.ndarray:
    """The logarithm of shares (above 0, up to 1) by the steps that Java's strict mathematics prescribes; numpy's own differs in the last place."""
    bits = np.ascontiguousarray(x, float).view(np.int64)
    high, low = (bits >> 32).astype(np.int64), bits & 0xFFFFFFFF
    k, high = (high >> 20) - 1023, high & 0xFFFFF
    i = (high + 0x95F64) & 0x100000
    f = (((high | (i ^ 0x3FF00000)) << 32) | low).view(float) - 1.0
    k = (k + (i >> 20)).astype(float)
    s = f / (2.0 + f)
    z = s * s
    w = z * z
    r = z * (_LG[0] + w * (_LG[2] + w * (_LG[4] + w * _LG[6]))) + w * (_LG[1] + w * (_LG[3] + w * _LG[5]))
    half = 0.5 * f * f
    middle = ((high - 0x6147A) | (0x6B851 - high)) > 0
    a, b = s * (half + r), s * (f - r)
    out = np.where(middle, k * _LN2_HIGH - ((half - (a + k * _LN2_LOW)) - f), k * _LN2_HIGH - ((b - k * _LN2_LOW) - f))
    out = np.where(k == 0, np.where(middle, f - (half - a), f - b), out)
    small = f * f * (0.5 - 0.33333333333333333 * f)
    near = np.where(k == 0, f - small, k * _LN2_HIGH - ((small - k * _LN2_LOW) - f))
    return np.where((0xFFFFF & (2 + high)) < 3, np.where(f == 0, k * _LN2_HIGH + k * _LN2_LOW, near), out)


def terms(count: np.ndarray, length: np.ndarray) -> np.ndarray:
    p = count / length
    return p * (natural_log(p) / _LN2)


_LN2 = float(natural_log(np.array([2.0]))[0])


@cache
def _table() -> np.ndarray:
    n, c = np.meshgrid(np.arange(SHORT + 1), np.arange(SHORT + 1), indexing="ij")
    known = (c > 0) & (c <= n)
    out = np.zeros(n.shape)
    out[known] = terms(c[known], n[known])
    return out.ravel()


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, and where each begins and ends."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = values.buffers()
    ends = np.frombuffer(at, np.int64 if pa.types.is_large_string(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def spread(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its entropy in bits per character, how often its most frequent character stands in it, and how many different ones it has. Characters count in the order in which they first come, as the sum's last place depends on it."""
    raw, ends = _flat(values)
    bits, most, kinds = np.zeros(len(values)), np.zeros(len(values), np.int32), np.zeros(len(values), np.int32)
    first = 0
    while first < len(values):
        last = min(first + ROWS, len(values), max(first + 1, int(np.searchsorted(ends, ends[first] + BYTES, "right")) - 1))
        text, length = raw[ends[first] : ends[last]] & 127, np.diff(ends[first : last + 1])
        row = np.repeat(np.arange(last - first), length)
        key, place = row * 128 + text, np.arange(len(text))
        counts = np.bincount(key, minlength=(last - first) * 128)
        begins = np.zeros(len(counts), np.int64)
        begins[key[::-1]] = place[::-1]
        new = begins[key] == place
        c, r = counts[key[new]], row[new]
        n = length[r]
        short = n <= SHORT
        found = _table()[np.where(short, n * (SHORT + 1) + c, 0)]
        if not short.all():
            found[~short] = terms(c[~short], n[~short])
        bits[first:last] = np.bincount(r, weights=-found, minlength=last - first)
        most[first:last] = counts.reshape(-1, 128).max(axis=1)
        kinds[first:last] = np.bincount(r, minlength=last - first)
        first = last
    for i in np.unique(np.searchsorted(ends, ends[0] + np.flatnonzero(raw[ends[0] : ends[-1]] > 127), "right") - 1).tolist():
        text = values[i].as_py() or ""
        each: dict[str, int] = {}
        for x in text:
            each[x] = each.get(x, 0) + 1
        if each:
            c = np.array(list(each.values()))
            bits[i], most[i], kinds[i] = np.bincount(np.zeros(len(c), int), weights=-terms(c, np.full(len(c), len(text))))[0], c.max(), len(c)
    return bits, most, kinds


#: Kinds of characters whose number in a text is taken along, as patterns of one ASCII character.
KINDS = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "other": "[^A-Za-z0-9]", "plain64": "[A-Za-z0-9+/=]", "url64": "[A-Za-z0-9_=-]"}
_OF_KIND = {k: np.array([re.fullmatch(p, chr(i), re.S) is not None for i in range(128)] + [False] * 128) for k, p in KINDS.items()}


def of_kinds(values: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """How many characters of each kind a text has, and which texts have others than ASCII, whose numbers say nothing."""
    raw, ends = _flat(values)
    text, at = raw[ends[0] : ends[-1]], ends - ends[0]

    def number(hit: np.ndarray) -> np.ndarray:
        so_far = np.concatenate([[0], np.cumsum(hit)])
        return (so_far[at[1:]] - so_far[at[:-1]]).astype(np.int32)

    return [number(of[text]) for of in _OF_KIND.values()], number(text > 127) > 0


def _bits(texts: pa.Array) -> pa.Array:
    return pa.array(spread(texts)[0], pa.float64(), mask=np.asarray(texts.is_null()))


def _bits_of_each(lists: pa.Array) -> pa.Array:
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    each = lists.flatten().dictionary_encode()  # neighbours in a file share most texts
    return pa.ListArray.from_arrays(at, _bits(each.dictionary).take(each.indices), mask=lists.is_null())


def _near(lists: pa.Array, prefixes: Sequence[str], first: int) -> pa.Array:
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    each = lists.flatten().dictionary_encode()
    known, at = each.dictionary, each.indices.to_numpy(zero_copy_only=False)
    bits = spread(known)[0]
    starts = np.zeros(len(known), bool)
    for prefix in prefixes:
        starts |= pc.starts_with(known, prefix).to_numpy(zero_copy_only=False)
    secret = ((bits > 4.0) & (pc.utf8_length(known).to_numpy(zero_copy_only=False) >= 20)).astype(float) + starts
    row = np.repeat(np.arange(len(lists)), sizes)
    early = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < first

    def mean(values: np.ndarray, of: np.ndarray, count: np.ndarray) -> pa.Array:
        return pa.array(np.bincount(of, weights=values, minlength=len(lists)) / np.maximum(count, 1), pa.float64())  # sums in order

    return pa.StructArray.from_arrays([mean(secret[at], row, sizes), mean(bits[at][early], row[early], np.minimum(sizes, first))], names=["secrets", "bits"])


def _spread(texts: pa.Array) -> pa.Array:
    bits, most, kinds = spread(texts)
    numbers, odd = of_kinds(texts)
    return pa.StructArray.from_arrays([pa.array(bits), pa.array(most), pa.array(kinds), *(pa.array(x, mask=odd) for x in numbers)], names=["bits", "most", "kinds", *KINDS])


def _held(texts: pa.Array, patterns: Sequence[str]) -> pa.Array:
    out = np.zeros(len(texts), np.int64)
    for i, pattern in enumerate(patterns):
        out |= pc.match_substring_regex(texts, pattern).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64) << i
    return pa.array(out, mask=pc.match_substring_regex(texts, r"[^\t\n\x20-\x7e]").fill_null(True).to_numpy(zero_copy_only=False))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string, null for null. Not for use within a lambda, unlike that of `text`."""
    return F.arrow_udf(_bits, T.DoubleType())(text)


def entropies(texts: Column) -> Column:
    """The entropy of each text of an array."""
    return F.arrow_udf(_bits_of_each, T.ArrayType(T.DoubleType()))(texts)


def near(tokens: Column, prefixes: Sequence[str], first: int = 10) -> Column:
    """Of an array of tokens: secrets, the mean number of two marks of a secret (over 4 bits per character in 20 characters or more; one of the prefixes), and bits, the mean entropy of the first ones; 0 without tokens."""
    sent = list(prefixes)
    return F.arrow_udf(lambda lists: _near(lists, sent, first), T.StructType().add("secrets", T.DoubleType()).add("bits", T.DoubleType()))(tokens)


def characters(text: Column) -> Column:
    """bits, most, kinds: see `spread`; and how many characters are of each of `KINDS`, null if the text has others than ASCII."""
    made = T.StructType().add("bits", T.DoubleType()).add("most", T.IntegerType()).add("kinds", T.IntegerType())
    for kind in KINDS:
        made = made.add(kind, T.IntegerType())
    return F.arrow_udf(_spread, made)(text)


def held(text: Column, patterns: Sequence[str]) -> Column:
    """A number whose bit i says whether the text holds pattern i (63 at most). Null if the text has other than printable ASCII, tabs and line feeds, where engines of patterns differ; patterns have no look-around and no back-reference."""
    sent = list(patterns)
    return F.arrow_udf(lambda texts: _held(texts, sent), T.LongType())(text)
