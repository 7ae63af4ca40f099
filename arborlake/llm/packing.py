"""Filling containers of fixed capacity with texts measured in tokens.

Texts are measured with a public tokenizer; one that alone exceeds the capacity
is split into full containers and a rest, no other is split. Items are packed in
groups of bounded size, spread by a hash of their id: largest first into the bin
with the tightest residual that is compatible. Bins are kept by residual; the
successor search climbs from the item's size through the residuals in use, and
at each through the bins by the bitmap of frequent sources and duplicate
clusters they carry, until a compatible bin is found. A bin never takes two
copies of one text. It takes no second text of a source while another bin does;
only where every fitting bin has the source already that rule gives way, so that
a source with a third of all rows wastes no space.

Defined results: null and empty texts have no tokens and get no container;
repeated rows of a doc_id are one item.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.core import bucket, scratch

CAPACITY = 2_048
#: Items packed together in one task.
GROUP_ITEMS = 20_000
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def tokenizer(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The public byte-level tokenizer stored in the folder."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers_pattern", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(sizes, sources, clusters, capacity: int = CAPACITY) -> list[int]:
    """The bin of every item: conflict-constrained best fit, largest first."""
    n = len(sizes)
    frequent = max(8, n // 64)
    hot = {k: i for i, k in enumerate([("s", s) for s, c in Counter(sources).items() if s is not None and c >= frequent] + [("c", x) for x, c in Counter(clusters).items() if c >= frequent])}
    order = sorted(range(n), key=lambda i: (-sizes[i], clusters[i], i))
    levels: dict[int, dict[int, list[int]]] = {}
    used = 0  # bitmap of residuals that have bins
    residual, mask, in_sources, in_clusters, out = [], [], [], [], [0] * n

    def place(b: int) -> None:
        nonlocal used
        levels.setdefault(residual[b], {}).setdefault(mask[b], []).append(b)
        used |= 1 << residual[b]

    def search(size: int, source, cluster, smask: int, cmask: int, strict: bool) -> int:
        nonlocal used
        avoid = (smask | cmask) if strict else cmask
        rest = used >> size
        level = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            level += step
            rest >>= step
            group = levels[level]
            for m in sorted(group):
                if m & avoid:
                    continue
                bins = group[m]
                for k in range(len(bins) - 1, -1, -1):
                    b = bins[k]
                    if cluster in in_clusters[b] or (strict and source is not None and source in in_sources[b]):
                        continue
                    bins.pop(k)
                    if not bins:
                        del group[m]
                        if not group:
                            del levels[level]
                            used &= ~(1 << level)
                    return b
            rest >>= 1
            level += 1
        return -1

    for i in order:
        size, source, cluster = sizes[i], sources[i], clusters[i]
        sbit, cbit = hot.get(("s", source)), hot.get(("c", cluster))
        smask, cmask = (0 if sbit is None else 1 << sbit), (0 if cbit is None else 1 << cbit)
        b = search(size, source, cluster, smask, cmask, True)
        if b < 0 and source is not None:
            b = search(size, source, cluster, smask, cmask, False)
        if b < 0:
            b = len(residual)
            residual.append(capacity)
            mask.append(0)
            in_sources.append(set())
            in_clusters.append(set())
        residual[b] -= size
        mask[b] |= smask | cmask
        in_sources[b].add(source)
        in_clusters[b].add(cluster)
        place(b)
        out[i] = b
    return out


def measure(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, tok_start, tok_end, n_tokens, source, cluster): items no larger than the capacity."""

    def run(batches):
        enc = tokenizer(folder, vocabulary)
        for b in batches:
            rows = []
            for d, t, s in zip(b["doc_id"], b["text"], b["source"], strict=True):
                n = len(enc.encode_ordinary(t))
                cluster = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                for k, a in enumerate(range(0, n, capacity)):
                    z = min(n, a + capacity)
                    rows.append((d, k, a, z, z - a, s if isinstance(s, str) else None, cluster ^ k))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "tok_start", "tok_end", "n_tokens", "source", "cluster"])

    docs = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text", "source")
    items = docs.mapInPandas(run, "doc_id long, piece int, tok_start int, tok_end int, n_tokens int, source string, cluster long")
    return items.dropDuplicates(["doc_id", "piece"])


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, doc_id, piece, tok_start, tok_end, n_tokens): every token of every text in one container."""
    items = scratch(measure(documents, capacity, folder, vocabulary), "items")
    groups = max(1, -(-items.count() // group_items))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        bins = pack(pdf["n_tokens"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), capacity)
        pdf["container"] = np.array(bins, dtype=np.int64) + (int(pdf["g"].iloc[0]) << 32)
        return pdf[["container", "doc_id", "piece", "tok_start", "tok_end", "n_tokens"]]

    placed = items.withColumn("g", bucket(F.concat_ws("/", "doc_id", "piece"), groups))
    return placed.groupBy("g").applyInPandas(run, "container long, doc_id long, piece int, tok_start int, tok_end int, n_tokens int")


def container_fill(documents: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """One row: containers, tokens, the lower bound of containers, and the share of space used."""
    return (
        fill_containers(documents, capacity, **how)
        .groupBy("container")
        .agg(F.sum("n_tokens").alias("used"))
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .withColumn("least_containers", F.ceil(F.col("tokens") / capacity))
        .withColumn("share_used", F.col("tokens") / (F.col("containers") * capacity))
    )
