"""URL verdicts: longest fitting rule, else logistic regression on hashed n-grams.

The model sees 3- to 5-grams of the bytes of "host path" in 2^18 buckets. It is fitted
once on a small labelled URL table (``url_labels.table()`` if none is given), of which at
most ``LABELLED`` rows of each class are used, in an order fixed by hash. An n-gram that
the table does not hold says nothing, so a site of unknown words is allowed: the classes
weigh as ``BLOCK_SHARE`` says. All rows are judged.

Nulls: a null url, or one without "://", has empty host and path, fits no rule and gets
the model's verdict for an empty string. Repeated rows are judged each; equal urls get
equal verdicts. An empty table gives an empty table; labels of one class
alone give a model that allows everything (or blocks everything, if all say so).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikegrid.llm import url_labels

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
LABELLED = 4000
STEPS = 500
BLOCK_SHARE = 0.3       # weight of the unwanted class
PENALTY = 1e-5
# (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest fitting rule as text and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of every text."""
    raw = [b"^" + t.encode("utf-8", "surrogatepass") + b"$" for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(raw)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))      # bytes to the end of the text
    rows, found = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k:len(data) - n + 1 + k] + np.uint64(1)
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        inside = left[:len(h)] >= n
        rows.append(row[:len(h)][inside])
        found.append((h[inside] % np.uint64(buckets)).astype(np.int64))
    empty = np.zeros(0, np.int64)
    return np.concatenate(rows or [empty]), np.concatenate(found or [empty])


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Log odds of "block"; the last weight is the intercept. Counts are scaled by the
    root of the number of n-grams."""
    row, bucket = grams(texts)
    counts = np.maximum(np.bincount(row, minlength=len(texts)), 1)
    return np.bincount(row, weights[bucket], minlength=len(texts)) / np.sqrt(counts) + weights[-1]


def fit(texts: list[str], block: np.ndarray, steps: int = STEPS, block_share: float = BLOCK_SHARE) -> np.ndarray:
    """Weights by accelerated gradient descent from zero; the classes weigh ``block_share``
    and the rest, whatever their numbers of rows."""
    block = np.asarray(block, float)
    weights = np.zeros(BUCKETS + 1)
    if not len(texts) or block.min() == block.max():
        weights[-1] = 10.0 if len(texts) and block.min() == 1 else -10.0
        return weights
    row, bucket = grams(texts)
    value = (1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(texts)), 1)))[row]
    share = np.where(block == 1, block_share / block.sum(), (1 - block_share) / (1 - block).sum())
    weights[-1] = np.log(block_share / (1 - block_share))       # stays: a site without known n-grams gets the prior
    ahead, step = weights.copy(), 2.0
    for k in range(steps):
        z = np.bincount(row, ahead[bucket] * value, minlength=len(texts)) + ahead[-1]
        error = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - block)
        new = ahead.copy()
        new[:-1] -= step * (np.bincount(bucket, error[row] * value, minlength=BUCKETS) + PENALTY * ahead[:-1])
        ahead, weights = new + (k / (k + 3)) * (new - weights), new
    return weights


def drawn(labels: list[tuple[str, bool]], most: int = LABELLED) -> list[tuple[str, bool]]:
    """At most ``most`` rows of each class: those with the least hash."""
    order = sorted(set(labels), key=lambda r: (hashlib.sha256(r[0].encode("utf-8", "surrogatepass")).digest(), r))
    return [r for x in (True, False) for r in [r for r in order if r[1] == x][:most]]


def judge(pages: DataFrame, rules=RULES, most: int = LABELLED, labels: list[tuple[str, bool]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``labels`` are (host path, block)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    table = drawn(url_labels.table() if labels is None else labels, most)
    weights = fit([t for t, _ in table], np.array([b for _, b in table], float))

    @F.pandas_udf("boolean")
    def unwanted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sites in parts:
            yield pd.Series(scores(sites.tolist(), weights) > 0)

    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "_by_rule": verdict, "_bad": unwanted(F.concat_ws(" ", "host", "path"))})
    by_model = F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", by_model).alias("verdict"))
