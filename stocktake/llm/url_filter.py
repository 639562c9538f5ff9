"""URL filter: allow and block rules, and logistic regression on hashed character n-grams for the rest.

Rules are (host, path): a rule fits its host and all subdomains when the url's path starts with
the rule's; the longest rule wins. Other urls are judged by a model of the n-grams of host and
path, trained on the labelled urls of ``url_labels``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stocktake.llm.textops import mix
from stocktake.llm.url_labels import labelled_urls

BITS = 16
SIZES = (3, 4, 5)
#: Training tables hold at most so many rows; more are refused.
MOST_LABELLED = 100_000

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text (null if none) and its verdict."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p) for _, h, p in ordered]
    chain = lambda values: reduce(lambda rest, pair: F.when(pair[0], F.lit(pair[1])).otherwise(rest), reversed(list(zip(fits, values))), F.lit(None).cast("string"))
    return chain([h + p for _, h, p in ordered]), chain([v for v, _, _ in ordered])


def ngrams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(url, bin) of each url's distinct hashed n-grams, by url; host and path count apart, with borders."""
    found = []
    for part, texts in enumerate((hosts, paths)):
        column = pa.array([f"^{t}$" for t in texts], pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[:len(texts) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[:offsets[-1]].astype(np.uint64) + np.uint64(1) if len(texts) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        for n in SIZES:
            starts = len(data) - n + 1
            if starts <= 0:
                continue
            gram = np.full(starts, 2 * n + part, np.uint64)
            for k in range(n):
                gram = gram * np.uint64(0x100000001B3) + data[k:k + starts]
            inside = owner[:starts] == owner[n - 1:]
            found.append((owner[:starts][inside].astype(np.uint64) << np.uint64(BITS)) | (mix(gram[inside]) >> np.uint64(64 - BITS)))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


def scores(hosts: list[str], paths: list[str], model: tuple[np.ndarray, float]) -> np.ndarray:
    """The model's log-odds of each url; more than 0 blocks."""
    url, col = ngrams(hosts, paths)
    weights, bias = model
    size = np.bincount(url, minlength=len(hosts))
    return np.bincount(url, weights=weights[col], minlength=len(hosts)) / np.sqrt(np.maximum(size, 1)) + bias


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return rest[:end].lower(), tail[:stop]


def train(rows: list[tuple[str, int]], steps: int = 150, rate: float = 0.5, momentum: float = 0.9, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the 2 ** BITS n-gram bins and the bias, by full-batch gradient descent with momentum on unit-length binary features."""
    if len(rows) > MOST_LABELLED:
        raise ValueError("the labelled table is meant to be small")
    doc, col = ngrams(*map(list, zip(*(_parts(url) for url, _ in rows)))) if rows else (np.zeros(0, np.int64),) * 2
    used, col = np.unique(col, return_inverse=True)
    y, n = np.array([label for _, label in rows], float), max(len(rows), 1)
    value = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(rows)), 1))
    weights, bias = np.zeros(len(used)), 0.0
    push, push_bias = np.zeros(len(used)), 0.0
    for _ in range(steps):
        z = np.bincount(doc, weights=weights[col], minlength=len(rows)) * value + bias
        error = (1 / (1 + np.exp(-z)) - y) / n
        push = momentum * push - rate * n ** 0.5 * (np.bincount(col, weights=(error * value)[doc], minlength=len(used)) + decay * weights / n)
        push_bias = momentum * push_bias - rate * error.sum()
        weights, bias = weights + push, bias + push_bias
    whole = np.zeros(1 << BITS)
    whole[used] = weights
    return whole, bias


def judge_urls(pages: DataFrame, model: tuple[np.ndarray, float] | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) for every row of ``pages`` (page_id, url).

    p_block is the model's figure, whether or not a rule decides. A null url, or one without
    ``://``, has an empty host and path and is judged by the model like any other; equal rows give
    equal results; an empty table gives an empty result; other columns are ignored.
    """
    model = model or train(labelled_urls())

    def run(batches):
        for batch in batches:
            hosts, paths, ruled = (batch.column(k).to_pylist() for k in (1, 2, 4))
            z = scores(hosts, paths, model)
            own = np.where(z > 0, "block", "allow")
            verdict = pa.array([r or o for r, o in zip(ruled, own.tolist())], pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(3), verdict, pa.array(1 / (1 + np.exp(-z)))], names=["page_id", "host", "path", "rule", "verdict", "p_block"])

    parts = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("*", rule.alias("rule"), verdict.alias("ruled")).mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, p_block double")
