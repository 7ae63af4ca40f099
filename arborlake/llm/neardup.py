"""Near-duplicate records with small edits: exact pairs by partition-and-enumerate signatures.

A record is the set of its runs of three consecutive tokens. Sizes are cut into
bands; a pair belongs to the band of its larger set, so a set signs for its own
band and for the next one if a partner there can be alike. In a band the feature
domain is partitioned by a hash into as many parts as the band's plan says, and
of each part the subsets of SUBSET features are enumerated over the rarest
features of the set. Sets that reach the threshold share, by the pigeonhole
principle, (SUBSET - 1) * parts + SHARED of those features, hence at least SHARED
subsets of one part, each of which is one signature (signature_rows). Rarity is
counted over all records in a table of fixed size, so its order is global and
the broadcast has a fixed size; it decides which features sign, never how many.
Bands and parts come from the measured sizes alone (plan_bands), so the
signatures of a set do not depend on how many records there are.

Rows of one signature meet in one sorted pass. A signature that more than
CROWDED sets share is not paired there: its sets sign again by an independent
partition, joined to the first signature, and what is crowded even then (true
clusters) is paired in salted blocks.

Exact copies are one class from the start. Candidate classes of sizes that can
be alike are compared exactly.

Defined results: records without text, or with fewer than three tokens, have no
features and no pair; repeated rows of an id count once (an id with several
texts is compared by each of them).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.core import BROADCAST_ROWS, scratch
from arborlake.operators.components import connected_components

#: Consecutive tokens of a feature, likeness, counters of the rarity table.
RUN, LIKENESS, COUNTERS = 3, 0.6, 1 << 18
#: Features of one part that make a signature, and signatures that similar sets share at least.
SUBSET, SHARED = 2, 2
#: Sets of one signature that are paired where they meet; more are refined. A bound on one group, not on the corpus.
CROWDED = 256
#: Rows of one block of a signature that stays crowded.
BLOCK_ROWS = 1_000

#: Bits of a class number that hold the size of its set; larger sets count as the largest.
SIZE_BITS = 20
_SIZE = (1 << SIZE_BITS) - 1

_TOKEN = re.compile(r"[a-z0-9_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _MIX
    return x ^ (x >> np.uint64(29))


def feature_rows(texts: list, seen: dict[str, int] | None = None, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(features, bounds): the sorted distinct 64-bit hashes of the token runs of each text, one text after the other."""
    seen = {} if seen is None else seen
    if len(seen) > 500_000:
        seen.clear()
    ids, lengths = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        n = len(ids)
        for t in _TOKEN.findall(text.lower()) if text else ():
            h = seen.get(t)
            if h is None:
                h = seen[t] = digest(t)
            ids.append(h)
        lengths.append(len(ids) - n)
    a = np.array(ids, dtype=np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    m = len(a) - run + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(lengths) + 1, dtype=np.int64)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(run):
        h = (h ^ a[k : k + m]) * _MUL
        h ^= h >> np.uint64(29)
    whole = owner[:m] == owner[run - 1 :]
    h, owner = h[whole], owner[:m][whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(lengths) + 1))


def features(text: str | None, seen: dict[str, int] | None = None, run: int = RUN) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of consecutive tokens."""
    return feature_rows([text], seen, run)[0]


def _counter(f: np.ndarray) -> np.ndarray:
    return (f >> np.uint64(46)).astype(np.int64)


def _up(x):
    return np.ceil(x - 1e-9).astype(np.int64)


def prefix_lengths(n: np.ndarray, low: int, parts: int, subset: int, likeness: float = LIKENESS, shared: int = SHARED) -> np.ndarray:
    """Rarest features that a set of size n signs with in the band that begins at low; 0 where no partner of the band can be alike.

    A partner is at least as large as likeness times the set, and one of the two
    reaches low, which bounds the features in common from below.
    """
    n = np.asarray(n, dtype=np.int64)
    need = np.where(n >= low, _up(likeness * n), _up(likeness / (1 + likeness) * (n + low)))
    t = (subset - 1) * parts + shared
    return np.where(need <= n, np.minimum(n, n - need + t), 0)


def plan_bands(sizes: dict[int, int], likeness: float = LIKENESS, subset: int = SUBSET, shared: int = SHARED) -> list[tuple[int, int, int]]:
    """Bands (low, parts, subset) with the fewest signatures over the measured sizes {size: sets}.

    A band spans at least a factor of 1 / likeness, so a set signs in two bands
    at most. Its parts may not ask for more features in common than similar sets of
    its smallest size have; where not even one subset is sure, single features sign.
    """
    if not sizes:
        return []
    top = max(sizes)
    at = np.array(sorted(sizes), dtype=np.int64)
    w = np.array([sizes[int(x)] for x in at], dtype=np.float64)
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, int(edges[-1] * 1.12)))

    def cost(lo: int, hi: int) -> tuple[float, int, int]:
        n = (at < hi) & (at >= likeness * lo)
        common = int(_up(np.float64(likeness * lo)))
        best = None
        most = (common - shared) // max(subset - 1, 1)
        options = sorted({max(1, int(most * s)) for s in (1.0, 0.8, 0.63, 0.5, 0.4, 0.3, 0.2)}) if most >= 1 and subset > 1 else []
        if not options and subset > 1 and hi > 8:
            return np.inf, 1, 1
        for parts, k in [(g, subset) for g in options] or [(1, 1)]:
            p = prefix_lengths(at[n], lo, parts, k, likeness, min(shared, common)).astype(np.float64)
            each = np.ones_like(p)
            for j in range(k):
                each *= np.maximum(p - j, 0) / (j + 1)
            c = float((w[n] * each).sum() / parts ** (k - 1))
            if best is None or c < best[0]:
                best = (c, parts, k)
        return best

    far = len(edges) - 1
    best: list[tuple[float, int, tuple | None]] = [(0.0, -1, None)] + [(np.inf, -1, None)] * far
    for z in range(1, far + 1):
        for a in range(z):
            if z < far and edges[z] * likeness < edges[a] or not np.isfinite(best[a][0]):
                continue
            c, parts, k = cost(edges[a], edges[z])
            if best[a][0] + c < best[z][0]:
                best[z] = (best[a][0] + c, a, (edges[a], parts, k))
    out, z = [], far
    while z > 0:
        out.append(best[z][2])
        z = best[z][1]
    return out[::-1]


def signature_rows(f: np.ndarray, bounds: np.ndarray, counts: np.ndarray, bands: list[tuple[int, int, int]], likeness: float = LIKENESS, shared: int = SHARED, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, set number) of many sets at once; features by set in f, bounds as feature_rows gives them."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((f, counts[_counter(f)], owner))
    f = f[order]
    rank = np.arange(len(f)) - bounds[:-1][owner]
    sigs, owners = [], []
    tops = [b[0] for b in bands[1:]] + [np.inf]
    for band, ((low, parts, k), top) in enumerate(zip(bands, tops, strict=True)):
        p = np.where((size < top) & (size >= likeness * low), prefix_lengths(size, low, parts, k, likeness, shared), 0)
        keep = np.nonzero(rank < p[owner])[0]
        if not len(keep):
            continue
        x = _mix(f[keep], 1 + 2 * seed)
        part = ((x >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)
        group = owner[keep] * parts + part
        o = np.argsort(group, kind="stable")
        group, x = group[o], _mix(x[o], 2)
        end = np.searchsorted(group, group, side="right")
        last, h = np.arange(len(x)), x
        for _ in range(k - 1):
            more = end[last] - last - 1
            base = np.repeat(last + 1, more)
            step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            h = np.repeat(h, more) + x[base + step]
            last = base + step
        sigs.append(_mix(h, 3 + band + 1000 * seed))
        owners.append(group[last] // parts)
    if not sigs:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


class _Memory(dict):
    """Remembers classes a task has met, up to a bound."""

    def first(self, key) -> bool:
        if key in self:
            return False
        if len(self) > 1_000_000:
            self.clear()
        self[key] = None
        return True


def _featured(records: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class, h, f): the class of copies, its number with the size of its set, and its features once a task."""

    def run(batches):
        seen: dict[str, int] = {}
        met = _Memory()
        for b in batches:
            keys, cls, fs, hs = [], [], [], []
            f, at = feature_rows(b["t"].tolist(), seen)
            for i, k in enumerate(b["k"]):
                x = f[at[i] : at[i + 1]]
                if len(x):
                    d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                    keys.append(k)
                    cls.append(d)
                    hs.append((int.from_bytes(d[:8], "big", signed=True) >> SIZE_BITS << SIZE_BITS) | min(len(x), _SIZE))
                    fs.append(x.view(np.int64) if met.first(d) else None)
            yield pd.DataFrame({"id": keys, "class": cls, "h": hs, "f": fs}).astype({"h": "int64"})

    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, "id string, class binary, h long, f array<long>")


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Features of a column of lists one after the other, and the bounds of each."""
    bounds = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    return (np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if len(lists) else np.zeros(0, dtype=np.int64)).view(np.uint64), bounds


def _rarity(sets: DataFrame) -> np.ndarray:
    """Features counted by the upper bits of their hash, over all classes."""

    def run(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            if len(b):
                total += np.bincount(_counter(_flat(b["f"])[0]), minlength=COUNTERS)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"c": at, "n": total[at]}).astype({"c": "int64", "n": "int64"})

    counts = np.zeros(COUNTERS, dtype=np.int64)
    table = sets.select("f").mapInPandas(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    counts[table["c"].to_numpy()] = table["n"].to_numpy()
    return counts


def _alike_sizes(x: np.ndarray, y: np.ndarray, likeness: float) -> np.ndarray:
    nx, ny = x & _SIZE, y & _SIZE
    return np.minimum(nx, ny) >= likeness * np.maximum(nx, ny) - 1e-6


def meet(batches, crowded: int = CROWDED, likeness: float = LIKENESS):
    """Pairs (x, y) of class numbers that meet in a signature, from rows (sig, h) sorted by both; rows of crowded signatures come out as (sig, h, null)."""

    def table(sig, x, y):
        return pa.record_batch([pa.array(sig, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["sig", "x", "y"])

    def pairs(s, h):
        if not len(s):
            return None
        first = np.ones(len(s), dtype=bool)
        first[1:] = (s[1:] != s[:-1]) | (h[1:] != h[:-1])
        s, h = s[first], h[first]
        at = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0]
        n = np.diff(np.append(at, len(s)))
        hot = np.repeat(n > crowded, n)
        hs, hh = s[hot], h[hot]
        s, h = s[~hot], h[~hot]
        xs, ys = [], []
        live = np.arange(len(s))
        for d in range(1, crowded):
            live = live[live + d < len(s)]
            live = live[s[live] == s[live + d]]
            if not len(live):
                break
            x, y = h[live], h[live + d]
            fit = _alike_sizes(x, y, likeness)
            xs.append(x[fit])
            ys.append(y[fit])
        if not xs and not len(hs):
            return None
        x = np.concatenate([*xs, hh])
        y = np.concatenate([*ys, np.zeros(len(hh), dtype=np.int64)])
        mask = np.zeros(len(x), dtype=bool)
        mask[len(x) - len(hh) :] = True
        return table(np.concatenate([np.zeros(len(x) - len(hh), dtype=np.int64), hs]), x, pa.array(y, pa.int64(), mask=mask))

    held_s = held_h = np.zeros(0, dtype=np.int64)
    streaming = None  # the crowded signature whose rows pass through
    for b in batches:
        s, h = b.column("sig").to_numpy(), b.column("h").to_numpy()
        if streaming is not None:
            k = int(np.searchsorted(s != streaming, True))
            if k:
                yield table(s[:k], h[:k], pa.nulls(k, pa.int64()))
            s, h = s[k:], h[k:]
            if not len(s):
                continue
            streaming = None
        s, h = np.concatenate([held_s, s]), np.concatenate([held_h, h])
        if not len(s):
            continue
        cut = int(np.searchsorted(s, s[-1]))
        out = pairs(s[:cut], h[:cut])
        if out is not None:
            yield out
        held_s, held_h = s[cut:], np.unique(h[cut:])
        held_s = held_s[: len(held_h)]
        if len(held_h) > crowded:
            streaming = held_s[0]
            yield table(held_s, held_h, pa.nulls(len(held_s), pa.int64()))
            held_s = held_h = np.zeros(0, dtype=np.int64)
    out = pairs(held_s, held_h)
    if out is not None:
        yield out


def _met(signed: DataFrame, crowded: int, likeness: float, name: str) -> DataFrame:
    """(sig, x, y): pairs counted by the signatures they share in one task (sig is that count), crowded rows with y null."""
    rows = signed.repartition("sig").sortWithinPartitions("sig", "h").mapInArrow(lambda bs: meet(bs, crowded, likeness), "sig long, x long, y long")
    return scratch(rows, name)


def _signed(sets: DataFrame, counts, bands, likeness: float, seed: int = 0) -> DataFrame:
    """(sig, h) of every class of sets (h, f); with a column sig, the new signatures are joined to it."""
    further = "sig" in sets.columns

    def sign(batches):
        c, plan = counts.value, bands
        met = _Memory()
        for b in batches:
            b = b[[met.first((*k,)) for k in zip(*(b[n] for n in b.columns if n != "f"), strict=True)]]
            if not len(b):
                continue
            s, owner = signature_rows(*_flat(b["f"]), c, plan, likeness, SHARED if not further else 1, seed)
            if further:
                s = _mix(s ^ b["sig"].to_numpy().view(np.uint64)[owner], 5)
            yield pd.DataFrame({"sig": s.view(np.int64), "h": b["h"].to_numpy()[owner]})

    return sets.mapInPandas(sign, "sig long, h long")


def _salted_pairs(rows: DataFrame, likeness: float) -> DataFrame:
    """(x, y) of all rows (sig, h) of each signature, a block of rows against all others at a time."""
    n = rows.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("k"))
    r = rows.join(n, "sig")
    a = r.select("sig", F.pmod(F.xxhash64("h"), F.col("k")).cast("int").alias("block"), F.col("h").alias("x"))
    b = r.select("sig", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), F.col("h").alias("y"))
    nx, ny = F.col("x").bitwiseAND(_SIZE), F.col("y").bitwiseAND(_SIZE)
    return a.join(b, ["sig", "block"]).where((F.col("x") < F.col("y")) & (nx >= likeness * ny - 1e-6) & (ny >= likeness * nx - 1e-6)).select("x", "y")


def signature_plan(sets: DataFrame, likeness: float) -> list[tuple[int, int, int]]:
    """The bands for the measured sizes; sizes above 4,096 are measured in steps of 5 percent."""
    n = F.col("h").bitwiseAND(_SIZE)
    coarse = F.when(n <= 4096, n).otherwise(F.floor(F.pow(F.lit(1.05), F.floor(F.log(1.05, n)))).cast("long"))
    return plan_bands({r[0]: r[1] for r in sets.groupBy(coarse.alias("n")).count().collect()}, likeness)  # some 4,200 rows at most


def similar_classes(records: DataFrame, key: str = "id", text: str = "snippet", likeness: float = LIKENESS, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """(members (id, class), pairs (class_a, class_b, likeness) of different classes)."""
    spark = records.sparkSession
    every = scratch(_featured(records, key, text), "sets")
    sets = every.where("f is not null").select("h", "class", "f")
    counts = spark.sparkContext.broadcast(_rarity(sets))
    bands = signature_plan(sets, likeness)
    met = _met(_signed(sets.select("h", "f"), counts, bands, likeness), crowded, likeness, "met")
    near = met.where("y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))
    # sets of one feature share one signature at most
    near = near.where(F.col("shared") >= F.least(F.lit(SHARED), F.ceil(F.least(F.col("x").bitwiseAND(_SIZE), F.col("y").bitwiseAND(_SIZE)) * likeness - 1e-9))).select("x", "y")
    full = met.where("y is null").select("sig", F.col("x").alias("h"))
    if not full.isEmpty():
        # a signature alone stands for the pair here, so what else the pair shares is not asked for
        again = _signed(full.distinct().join(sets.dropDuplicates(["h"]), "h").select("sig", "h", "f"), counts, bands, likeness, seed=1)
        met2 = _met(again, crowded, likeness, "met")
        near = met.where("y is not null").select("x", "y").unionByName(met2.where("y is not null").select("x", "y"))
        near = near.unionByName(_salted_pairs(met2.where("y is null").select("sig", F.col("x").alias("h")).distinct(), likeness)).distinct()
    near = scratch(near.select(F.col("x").alias("ha"), F.col("y").alias("hb")), "near")
    wanted = near.select(F.explode(F.array("ha", "hb")).alias("h")).distinct()
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    arrays = scratch(sets.join(wanted, "h", "left_semi").dropDuplicates(["class"]), "arrays")
    x = arrays.select(F.col("h").alias("ha"), F.col("class").alias("class_a"), F.col("f").alias("fa"))
    y = arrays.select(F.col("h").alias("hb"), F.col("class").alias("class_b"), F.col("f").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    pairs = (
        near.join(x, "ha")
        .join(y, "hb")
        .withColumn("both", both)
        .withColumn("likeness", F.col("both") / (F.size("fa") + F.size("fb") - F.col("both")))
        .where(F.col("both") >= F.lit(likeness) * (F.size("fa") + F.size("fb") - F.col("both")) - 1e-9)
        .select("class_a", "class_b", "likeness")
    )
    return every.select("id", "class"), pairs


def _blocks(n) -> F.Column:
    return F.greatest(F.ceil(F.coalesce(n, F.lit(1)) / BLOCK_ROWS), F.lit(1)).cast("int")


def near_duplicate_pairs(records: DataFrame, key: str = "id", text: str = "snippet", likeness: float = LIKENESS, **how) -> DataFrame:
    """(id_a, id_b), smaller first, of different records alike to at least the likeness, copies included.

    The rows asked for are all pairs of alike records, so a class of many copies
    gives as many rows as it has pairs, written a block of BLOCK_ROWS copies at a
    time; near_duplicate_groups says the same in one row a record.
    """
    members, pairs = similar_classes(records, key, text, likeness, **how)
    pairs = scratch(pairs, "pairs")
    copies = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    asked = copies.select("class", "n").unionByName(pairs.select(F.explode(F.array("class_a", "class_b")).alias("class"), F.lit(1).cast("long").alias("n"))).groupBy("class").agg(F.max("n").alias("n"))
    asked = scratch(asked, "asked")
    m = scratch(members.join(asked, "class").distinct().select("id", "class", _blocks(F.col("n")).alias("k")), "members")
    placed = m.select("class", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("block"), F.col("id").alias("x"))
    spread = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block")
    same = placed.join(m.select("class", spread, F.col("id").alias("y")), ["class", "block"]).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    k = asked.select("class", _blocks(F.col("n")).alias("k"))
    left = pairs.join(k.withColumnRenamed("class", "class_a"), "class_a").select("class_b", F.col("class_a").alias("class"), spread).join(placed, ["class", "block"]).select("x", F.col("class_b").alias("class"))
    cross = left.join(k, "class").select("x", "class", spread).join(placed.withColumnRenamed("x", "y"), ["class", "block"]).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.unionByName(cross).distinct()


def near_duplicate_groups(records: DataFrame, key: str = "id", text: str = "snippet", likeness: float = LIKENESS, **how) -> DataFrame:
    """(id, class, n_links, group_id): each record's class of copies, links of the class to others, and its connected group (smallest class)."""
    members, pairs = similar_classes(records, key, text, likeness, **how)
    name = lambda c: F.lower(F.hex(c)).alias(c)
    pairs = scratch(pairs.select(name("class_a"), name("class_b")), "pairs")
    links = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    groups = connected_components(pairs, "class_a", "class_b").withColumnRenamed("id", "class")
    found = members.select("id", name("class")).distinct()
    return found.join(links, "class", "left").join(groups, "class", "left").select("id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "class").alias("group_id"))


def code_records(nodes: DataFrame) -> DataFrame:
    """Functions and methods with a snippet, repeated rows once."""
    return nodes.where("kind in ('function', 'method') and id is not null and snippet is not null").select("id", "snippet")
