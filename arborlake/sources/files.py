"""Readers: source trees, ledgers, front matter, transcripts, images; all distributed, schemas explicit."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "timestamp long, command string, filter_name string, raw_tokens long, filtered_tokens long, saved_tokens long, exit_code int"
#: A ref that may be handed to a version-control tool.
SAFE_REF = r"^[A-Za-z0-9][A-Za-z0-9_./~^-]{0,199}$"


def read_tree(spark: SparkSession, root: str, max_bytes: int = 2_000_000) -> DataFrame:
    """(abs_path, rel_path, size_bytes, content) of the files under root, oversize ones out before they are read as text."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    path = F.regexp_replace("path", "^file:/*", "/")
    return b.select(path.alias("abs_path"), F.regexp_replace(path, "^" + re.escape("/" + root.strip("/")) + "/", "").alias("rel_path"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows from JSON lines; blank and corrupt lines are skipped."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where it is absent or unreadable."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception:
        return spark.createDataFrame([], schema)


FORBIDDEN_KEYS = ("hooks", "mcp_servers", "permissions", "env")


def front_matter(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(path, meta map, body): the block between the first two --- lines as key: value pairs; malformed blocks give an empty map."""
    block = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), "^[\"']|[\"']$", "").alias("value")))
    unique = F.filter(entries, lambda e, i: ~e["key"].isin(*FORBIDDEN_KEYS) & ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return texts.select(key, F.map_from_entries(unique).alias("meta"), F.regexp_replace(F.col(text), r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "").alias("body"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, body) of Markdown files."""
    return front_matter(spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def changed_files(refs: DataFrame) -> DataFrame:
    """(ref, file_path) of a supplied change list; rows whose ref is not safe are refused."""
    return refs.where(F.col("ref").rlike(SAFE_REF) & ~F.col("ref").contains("..")).select("ref", "file_path").distinct()


def design_tokens(texts: DataFrame) -> DataFrame:
    """(path, token, value): CSS custom properties and $value leaves of token files."""
    css = texts.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(--[\w-]+\s*:\s*[^;}\n]+)"), 1)).alias("x")).select("path", F.trim(F.substring_index("x", ":", 1)).alias("token"), F.trim(F.regexp_extract("x", r":(.*)$", 1)).alias("value"))
    leaf = texts.select("path", F.explode(F.regexp_extract_all("text", F.lit(r'("[\w.-]+"\s*:\s*\{\s*"\$?value"\s*:\s*"[^"]*")'), 1)).alias("x")).select("path", F.regexp_extract("x", r'^"([^"]+)"', 1).alias("token"), F.regexp_extract("x", r':\s*"([^"]*)"$', 1).alias("value"))
    return css.unionByName(leaf).distinct()


def decode_png(data: bytes):
    """8-bit RGB or RGBA PNG bytes to (width, height, array of RGBA)."""
    import struct
    import zlib

    import numpy as np

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, idat, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            idat += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, colour = head[:4]
    if depth != 8 or colour not in (2, 6) or head[6]:
        raise ValueError("only plain 8-bit RGB and RGBA")
    bpp = 4 if colour == 6 else 3
    raw = np.frombuffer(zlib.decompress(idat), dtype=np.uint8).reshape(h, w * bpp + 1)
    out = np.zeros((h, w * bpp), dtype=np.uint8)
    for y in range(h):
        f, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros(w * bpp, dtype=np.int32)
        if f == 2:
            line = line + up
        elif f in (1, 3, 4):
            cur = np.zeros(w * bpp, dtype=np.int32)
            for i in range(w * bpp):
                a = cur[i - bpp] if i >= bpp else 0
                if f == 1:
                    p = a
                elif f == 3:
                    p = (a + up[i]) // 2
                else:
                    c = up[i - bpp] if i >= bpp else 0
                    q = a + up[i] - c
                    pa, pb, pc = abs(q - a), abs(q - up[i]), abs(q - c)
                    p = a if pa <= pb and pa <= pc else up[i] if pb <= pc else c
                cur[i] = (line[i] + p) & 255
            line = cur
        out[y] = line & 255
    px = out.reshape(h, w, bpp)
    return w, h, px if bpp == 4 else np.dstack([px, np.full((h, w), 255, dtype=np.uint8)])


def image_metrics(images: DataFrame) -> DataFrame:
    """(name, width, height, entropy, dominant, mean, p5, p95, transparent) of PNG rows (name, content), by Arrow batches."""

    def run(batches):
        import numpy as np

        for b in batches:
            rows = []
            for name, data in zip(b["name"], b["content"], strict=True):
                try:
                    w, h, px = decode_png(bytes(data))
                except (ValueError, TypeError, IndexError):
                    continue
                rgb = px[..., :3].astype(np.int64)
                code = (rgb[..., 0] >> 4) * 256 + (rgb[..., 1] >> 4) * 16 + (rgb[..., 2] >> 4)
                p = np.unique(code, return_counts=True)[1] / (w * h)
                lum = np.sort((0.2126 * rgb[..., 0] + 0.7152 * rgb[..., 1] + 0.0722 * rgb[..., 2]).ravel())
                rows.append((name, w, h, float(-(p * np.log2(p)).sum()), float(p.max()), float(lum.mean()), float(lum[int(0.05 * len(lum))]), float(lum[int(0.95 * len(lum))]), float((px[..., 3] == 0).mean())))
            yield pd.DataFrame(rows, columns=["name", "width", "height", "entropy", "dominant", "mean", "p5", "p95", "transparent"])

    return images.mapInPandas(run, "name string, width int, height int, entropy double, dominant double, mean double, p5 double, p95 double, transparent double")


def image_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, mae, rmse, over16, over32, over64, mismatch, energy, distance) of images paired by name, worst first."""

    def energy(g):
        import numpy as np

        gx = g[1:-1, 2:] - g[1:-1, :-2]
        gy = g[2:, 1:-1] - g[:-2, 1:-1]
        return np.hypot(gx, gy)

    def run(batches):
        import numpy as np

        for b in batches:
            rows = []
            for name, x, y in zip(b["name"], b["a"], b["b"], strict=True):
                w, h, p = decode_png(bytes(x))
                w2, h2, q = decode_png(bytes(y))
                if (w, h) != (w2, h2):
                    continue
                d = np.abs(p[..., :3].astype(float) - q[..., :3]).max(axis=2)
                ga, gb = (z[..., :3].astype(float) @ np.array([0.2126, 0.7152, 0.0722]) for z in (p, q))
                ea, eb = (energy(z) if min(w, h) > 2 else np.zeros((1, 1)) for z in (ga, gb))
                ratio = (ea.sum() + 1e-9) / (eb.sum() + 1e-9)
                over = [float((d > t).mean()) for t in (16, 32, 64)]
                miss, edge = float((d > 20.4).mean()), float((np.abs(ea - eb) > 32).mean())
                dist = 0.35 * over[1] + 0.25 * miss + 0.25 * edge + 0.15 * min(1.0, abs(float(np.log2(ratio))))
                rows.append((name, float(d.mean()), float(np.sqrt((d**2).mean())), *over, miss, float(ratio), dist))
            yield pd.DataFrame(rows, columns=["name", "mae", "rmse", "over16", "over32", "over64", "mismatch", "energy", "distance"])

    both = left.select("name", F.col("content").alias("a")).join(right.select("name", F.col("content").alias("b")), "name")
    return both.mapInPandas(run, "name string, mae double, rmse double, over16 double, over32 double, over64 double, mismatch double, energy double, distance double").orderBy(F.desc("distance"), "name")
