"""Evaluation texts inside documents: rare n-gram seeds, then local alignment.

Texts become words: runs of letters and digits without case, compatibility forms
unified, tags and marks between them skipped, words broken at a line end joined.
Documents are read against all items at once: a table of fixed size says which
n-grams may be the items', so only those leave a task, as counts, and with them
the stretches of a document in which a leak could lie. Rare n-grams of the
items, by these counts, are the seeds; they join stretches to items, and each pair is
aligned by Smith-Waterman on words. The score decides: what does not reach that
of a leak is dropped, and of the rest the longest unbroken run is measured.

Verbatim leaks (leaked): a stretch is a run of n-grams of items at least as long
as a leak, and every window of an item as long as a leak gives its rarest n-gram
as seed, so no leak can be without one; one reading of the documents. Edited
copies (leak_alignments): of each window the WINDOW_SEEDS rarest n-grams that
some document holds are seeds (by default all, since the rarest may be held by
another document only), and a second reading takes the surroundings of
every seed, as wide as the longest item; a copy is aligned if one of its seeds
is unchanged.

Defined results: null or empty texts match nothing; items shorter than a leak
have no window and cannot leak; documents with the same text are each reported;
repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.core import pieces, scratch, small

#: Consecutive words that make a leak, words of a seed, and the rarest held n-grams of each window that are seeds where edited copies are wanted: all of them.
LEAK_WORDS, SEED_WORDS, WINDOW_SEEDS = 12, 5, 8
#: Bits of the table that tells which n-grams may be the items'; its size does not depend on them.
FILTER_BITS = 24
#: Pairs that one task aligns.
PAIRS_TASK = 10_000
#: Alignment: a word equal, another word, a word left out.
MATCH, MISMATCH, GAP = 2, -1, -1

_TAG = re.compile(r"</?[a-z!][^<>\n]{0,200}>|&(?:[a-z]{2,8}|#\d{1,6});")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\r?\n[ \t>/#*;%!-]*(?=[^\W\d_])")
_INVISIBLE = re.compile(r"[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text as the comparison sees them."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "-\n" in text or "-\r" in text or "‐" in text or "‑" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(best local score, words of a inside it is bounded by) of two word-number sequences with linear gaps."""
    if not len(a) or not len(b):
        return 0, 0
    ramp = np.arange(len(b) + 1) * -GAP
    prev = np.zeros(len(b) + 1, dtype=np.int64)
    best = 0
    for x in a:
        cur = np.zeros(len(b) + 1, dtype=np.int64)
        cur[1:] = np.maximum(prev[:-1] + np.where(b == x, MATCH, MISMATCH), prev[1:] + GAP)
        np.maximum(cur, 0, out=cur)
        cur = np.maximum.accumulate(cur + ramp) - ramp
        best = max(best, int(cur.max()))
        prev = cur
    return best, best // MATCH


def smith_waterman_many(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The best local scores of many pairs of sequences of positive (first) and non-negative (second) numbers, those of like length at once."""
    best = np.zeros(len(pairs), dtype=np.int64)
    order = sorted((k for k, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    at = 0
    while at < len(order):
        end, wide = at + 1, len(pairs[order[at]][1])
        while end < len(order) and end - at < 64 and len(pairs[order[end]][1]) <= wide + wide // 4 + 8:
            end += 1
        ks = order[at:end]
        # padding equals nothing, so it can only lower a score
        a = np.full((len(ks), max(len(pairs[k][0]) for k in ks)), -1, dtype=np.int32)
        b = np.full((len(ks), len(pairs[ks[-1]][1])), -2, dtype=np.int32)
        for r, k in enumerate(ks):
            a[r, : len(pairs[k][0])], b[r, : len(pairs[k][1])] = pairs[k]
        kind = np.int16 if MATCH * a.shape[1] + b.shape[1] < 32_000 else np.int32
        ramp = np.arange(b.shape[1] + 1, dtype=kind) * kind(-GAP)
        prev = np.zeros((len(ks), b.shape[1] + 1), dtype=kind)
        most, cur = np.zeros_like(prev), np.zeros_like(prev)
        for j in range(a.shape[1]):
            step = (b == a[:, j : j + 1]).astype(kind)
            step *= MATCH - MISMATCH
            step += MISMATCH
            step += prev[:, :-1]
            prev += GAP
            np.maximum(step, prev[:, 1:], out=cur[:, 1:])
            cur[:, 0] = 0
            np.maximum(cur, 0, out=cur)
            cur += ramp
            np.maximum.accumulate(cur, axis=1, out=cur)
            cur -= ramp
            np.maximum(most, cur, out=most)
            prev, cur = cur, prev
        best[ks] = most.max(axis=1)
        at = end
    return best


def most_score(b: np.ndarray) -> int:
    """No alignment with b scores more: inside its span every word that is none of the other text's (0) costs a gap or a mismatch."""
    total = np.concatenate([[0], np.cumsum(np.where(b > 0, MATCH, max(GAP, MISMATCH)))])
    return int((total - np.minimum.accumulate(total)).max())


def longest_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words of the longest run common to both, where it begins in b)."""
    best, where = 0, 0
    prev = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        cur = np.zeros_like(prev)
        cur[1:] = (prev[:-1] + 1) * (b == x)
        k = int(cur.argmax())
        if cur[k] > best:
            best, where = int(cur[k]), k - int(cur[k])
        prev = cur
    return best, where


class _Hashes(dict):
    """64-bit numbers of words, remembered up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def word_rows(texts, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts one after the other, bounds of each)."""
    ids: list[int] = []
    bounds = [0]
    for t in texts:
        ids += map(hashes.__getitem__, words(t))
        bounds.append(len(ids))
    return np.array(ids, dtype=np.uint64), np.array(bounds, dtype=np.int64)


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """A number for the n words from each position."""
    h = np.zeros(max(len(w) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        h = (h ^ w[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _whole(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the n-grams of concatenated texts lie within one text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    m = max(total - n + 1, 0)
    return owner[:m] == owner[n - 1 : n - 1 + m]


_AT = np.uint64(64 - FILTER_BITS)


def _filter(numbers: DataFrame):
    """A broadcast bit table of fixed size of the n-grams in the column gram."""
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    at = numbers.select(F.shiftrightunsigned("gram", 64 - FILTER_BITS).alias("b")).distinct().toArrow()["b"].to_numpy()  # 2 ** FILTER_BITS rows at most
    bits[at] = True
    return numbers.sparkSession.sparkContext.broadcast(np.packbits(bits))


def _item_words(items: DataFrame, leak: int) -> DataFrame:
    """(item, item_id, w) of the items that can leak; item numbers the row."""

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            w, at = word_rows(b["text"], hashes)
            rows = [(k, i, w[x:z].view(np.int64)) for k, i, x, z in zip(b["item"], b["item_id"], at[:-1], at[1:], strict=True) if z - x >= leak]
            yield pd.DataFrame(rows, columns=["item", "item_id", "w"])

    rows = items.where("item_id is not null and text is not null").select(F.xxhash64(F.col("item_id").cast("long"), "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item"])
    return scratch(rows.mapInPandas(run, "item long, item_id long, w array<long>"), "items")


def _grams_of(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, p, gram) of every n-gram of the word arrays w."""

    def run(batches):
        for b in batches:
            for k, w in zip(b["k"], b["w"], strict=True):
                g = grams(np.asarray(w, dtype=np.int64).view(np.uint64), n)
                yield pd.DataFrame({key: np.full(len(g), k, dtype=np.int64), "p": np.arange(len(g), dtype=np.int32), "gram": g.view(np.int64)})

    return rows.select(F.col(key).alias("k"), "w").mapInPandas(run, f"{key} long, p int, gram long")


_READ = "gram long, n long, doc_id long, at int, w array<long>"


def _read(docs: DataFrame, table, n: int, least: int, margin: int) -> DataFrame:
    """One reading of the documents: counts (gram, n) of the n-grams in the table, and word stretches (doc_id, at, w).

    least > 0: runs of at least that many such n-grams; margin > 0: the words
    around each such n-gram, overlapping stretches as one.
    """

    def run(batches):
        bits = np.unpackbits(table.value).view(bool)
        hashes = _Hashes()
        for b in batches:
            w, bounds = word_rows(b["text"], hashes)
            g = grams(w, n)
            hit = bits[(g >> _AT).astype(np.int64)] & _whole(bounds, n, len(w))
            at = np.nonzero(hit)[0]
            found, k = np.unique(g[at], return_counts=True)
            yield pd.DataFrame({"gram": found.view(np.int64), "n": k, "doc_id": None, "at": None, "w": None}).astype({"n": "int64", "doc_id": "Int64", "at": "Int32"})
            if not len(at) or not (least or margin):
                continue
            owner = np.searchsorted(bounds, at, side="right") - 1
            lo, hi = np.maximum(at - margin, bounds[owner]), np.minimum(at + n + margin, bounds[owner + 1])
            # a stretch goes on while the next n-gram of the document begins inside it
            new = np.ones(len(at), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | ((at[1:] > at[:-1] + 1) if not margin else (lo[1:] > hi[:-1]))
            first = np.nonzero(new)[0]
            last = np.append(first[1:], len(at)) - 1
            if least:
                keep = last - first + 1 >= least
                first, last = first[keep], last[keep]
            rows = [(None, None, b["doc_id"].iloc[owner[x]], lo[x] - bounds[owner[x]], w[lo[x] : hi[z]].view(np.int64)) for x, z in zip(first, last, strict=True)]
            if rows:
                yield pd.DataFrame(rows, columns=["gram", "n", "doc_id", "at", "w"]).astype({"gram": "Int64", "n": "Int64"})

    return scratch(docs.mapInPandas(run, _READ), "read")


def _seeds(item_grams: DataFrame, counts: DataFrame, width: int, each: int) -> DataFrame:
    """(item, gram) of the rarest n-grams that some document holds: of every window of width n-grams one over all its n-grams, or each over those held."""
    known = item_grams.join(counts, "gram", "left").select("item", "p", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    ahead = Window.partitionBy("item").orderBy("p").rowsBetween(0, width - 1)
    if each == 1:
        x = known.select("item", F.min(F.struct("n", "gram")).over(ahead).alias("m"), "p", (F.max("p").over(Window.partitionBy("item")) - width + 1).alias("last"))
        return x.where("p <= last and m.n > 0").select("item", "m.gram").distinct()
    around = known.select("item", F.collect_list(F.struct("n", "gram")).over(ahead).alias("ms"))
    held = F.slice(F.array_sort(F.filter("ms", lambda m: m["n"] > 0)), 1, each)
    return around.select("item", F.explode(held).alias("m")).select("item", "m.gram").distinct()


def _aligned(stretches: DataFrame, item_words: DataFrame, seeds: DataFrame, n: int, least_score: int) -> DataFrame:
    """(item_id, doc_id, longest_run, score, share, doc_word) of every stretch and item that share a seed and align to the score."""
    placed = scratch(stretches.select(F.xxhash64("doc_id", "at").alias("s"), "doc_id", "at", "w").dropDuplicates(["s"]), "stretches")
    pairs = scratch(_grams_of(placed, "s", n).select("s", "gram").distinct().join(small(seeds), "gram").groupBy("s", "item").agg(F.collect_set("gram").alias("seeds")), "pairs")
    # as many tasks as the alignments need, whatever their bytes
    pairs = pairs.repartition(pieces(pairs.count(), PAIRS_TASK, pairs.sparkSession), "s")
    rows = pairs.join(placed, "s").join(small(item_words.withColumnRenamed("w", "v"), 5_000), "item").select("item_id", "doc_id", "at", "w", "v", "seeds")

    def run(batches):
        for b in batches:
            of, pairs, offsets = [], [], []
            for r, (w, v, g) in enumerate(zip(b["w"], b["v"], b["seeds"], strict=True)):
                w, v = np.asarray(w, dtype=np.int64), np.asarray(v, dtype=np.int64)
                keys = np.unique(v)
                x, y = np.searchsorted(keys, v) + 1, np.minimum(np.searchsorted(keys, w), len(keys) - 1)
                y = np.where(keys[y] == w, y + 1, 0)
                own, here = grams(v.view(np.uint64), n).view(np.int64), grams(w.view(np.uint64), n).view(np.int64)
                q = np.nonzero(np.isin(here, np.asarray(g, dtype=np.int64)))[0]
                order = np.argsort(own, kind="stable")
                first, last = (np.searchsorted(own[order], here[q], side=side) for side in ("left", "right"))
                lo = np.maximum(q - order[last - 1] - len(v) // 2, 0)
                hi = np.minimum(q - order[first] + len(v) + len(v) // 2, len(w))
                lo, hi = np.minimum.accumulate(lo[::-1])[::-1], np.maximum.accumulate(hi)
                cut = np.nonzero(np.append(True, lo[1:] > hi[:-1]))[0]
                for c, z in zip(cut, np.append(cut[1:], len(q)) - 1, strict=True):
                    part = y[lo[c] : hi[z]]
                    if most_score(part) >= least_score:
                        of.append(r)
                        pairs.append((x, part))
                        offsets.append(int(lo[c]))
            rows = []
            for r, (x, y), o, score in zip(of, pairs, offsets, smith_waterman_many(pairs), strict=True):
                if score >= least_score:
                    run_, where = longest_run(x, y)
                    rows.append((b["item_id"].iloc[r], b["doc_id"].iloc[r], run_, int(score), int(score) / (MATCH * len(x)), int(b["at"].iloc[r]) + o + where))
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "longest_run", "score", "share", "doc_word"])

    found = rows.mapInPandas(run, "item_id long, doc_id long, longest_run int, score int, share double, doc_word int")
    return found.groupBy("item_id", "doc_id").agg(F.max(F.struct("longest_run", "score", "share", "doc_word")).alias("m"), F.max(F.struct("score", "share")).alias("b")).select("item_id", "doc_id", "m.longest_run", "b.score", "b.share", "m.doc_word")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _counts(read: DataFrame) -> DataFrame:
    return read.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))


def leak_alignments(items: DataFrame, documents: DataFrame, leak_words: int = LEAK_WORDS, seed_words: int = SEED_WORDS, window_seeds: int = WINDOW_SEEDS, least_score: int | None = None) -> DataFrame:
    """(item_id, doc_id, longest_run, score, share, doc_word) of every item and document that share a seed and align to least_score.

    score: of the best local alignment around the seeds, by default at least that of
    a leak of leak_words; longest_run: most consecutive words in common there;
    share: score over that of the whole item; doc_word: word of the document
    where that run begins.
    """
    least = MATCH * leak_words if least_score is None else least_score
    texts, found = _texts(documents), _item_words(items, leak_words)
    item_grams = _grams_of(found, "item", seed_words)
    counts = _counts(_read(texts, _filter(item_grams), seed_words, 0, 0))
    seeds = scratch(_seeds(item_grams, counts, leak_words - seed_words + 1, window_seeds), "seeds")
    longest = found.agg(F.max(F.size("w"))).first()[0] or 1
    read = _read(texts, _filter(seeds), seed_words, 0, longest + longest // 2)
    return _aligned(read.where("doc_id is not null"), found, seeds, seed_words, least)


def leaked(items: DataFrame, documents: DataFrame, leak_words: int = LEAK_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """(item_id, doc_id) where the document holds at least leak_words consecutive words of the item: aligned from rare seeds, then measured."""
    found = _item_words(items, leak_words)
    item_grams = _grams_of(found, "item", seed_words)
    width = leak_words - seed_words + 1
    read = _read(_texts(documents), _filter(item_grams), seed_words, width, 0)
    seeds = scratch(_seeds(item_grams, _counts(read), width, 1), "seeds")
    pairs = _aligned(read.where("doc_id is not null"), found, seeds, seed_words, MATCH * leak_words)
    return pairs.where(F.col("longest_run") >= leak_words).select("item_id", "doc_id")
