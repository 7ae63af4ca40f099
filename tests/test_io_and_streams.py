import json
import struct
import zlib

from pyspark.sql import functions as F

from arborlake.functions.redact import card_ok, redact, redact_text
from arborlake.sources import files as R
from arborlake.sources import sinks as K
from arborlake.streaming import ledger as S


def png(w, h, pixels, alpha=True):
    raw = b"".join(b"\0" + bytes(c for x in range(w) for c in pixels[y][x]) for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if alpha else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_tree_and_ledger(spark, tmp_path):
    (tmp_path / "t/a").mkdir(parents=True)
    (tmp_path / "t/a/x.py").write_text("é = 1\n")
    (tmp_path / "t/big.py").write_text("x" * 50)
    rows = {r.rel_path: r.content for r in R.read_tree(spark, f"{tmp_path}/t", 40).collect()}
    assert rows == {"a/x.py": "é = 1\n"}
    p = tmp_path / "l.jsonl"
    p.write_text('{"timestamp":1,"command":"git","raw_tokens":1000,"filtered_tokens":200}\n\nnot json\n{"timestamp":2,"command":"ls","raw_tokens":200,"filtered_tokens":50}\n')
    got = R.read_ledger(spark, str(p)).where("timestamp is not null").agg(F.sum("raw_tokens"), F.sum("filtered_tokens")).first()
    assert tuple(got) == (1200, 250)
    assert R.read_or_empty(spark, f"{tmp_path}/none", "a string").count() == 0


def test_store_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("f", "file")], "id string, kind string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "c", "contains")], "source_id string, target_id string, kind string")
    for _ in range(2):
        K.write_store({"nodes": nodes, "edges": edges}, str(tmp_path))
    store = K.read_store(spark, str(tmp_path))
    assert store["edges"].count() == 2 and store["nodes"].count() == 1
    assert K.capabilities(store) == {"has_communities": False, "has_edge_confidence": False, "has_cache": False}
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, body string")
    new = spark.createDataFrame([("a", "x"), ("c", "z")], "path string, body string")
    assert [r.path for r in K.changed_pages(new, old).collect()] == ["c"] and [r.path for r in K.orphans(new, old).collect()] == ["b"]
    assert json.loads(K.plan_json(new).first().json)["path"]


def test_front_matter_and_refs(spark):
    t = spark.createDataFrame([("a", "---\ntitle: 'T'\nenv: x\ntitle: U\n---\nbody"), ("b", "no block"), ("c", "---\nbroken")], "path string, text string")
    got = {r.path: (r.meta, r.body) for r in R.front_matter(t).collect()}
    assert got["a"] == ({"title": "U"}, "body") and got["b"] == ({}, "no block") and got["c"][0] == {}
    refs = spark.createDataFrame([("HEAD~1", "a.py"), ("--upload", "b"), ("a..b", "c")], "ref string, file_path string")
    assert [r.file_path for r in R.changed_files(refs).collect()] == ["a.py"]


def test_images(spark):
    a = png(2, 2, [[(255, 0, 0, 255), (0, 0, 0, 255)], [(0, 0, 0, 0), (9, 9, 9, 255)]])
    b = png(2, 2, [[(255, 0, 0), (0, 0, 0)], [(0, 0, 0), (255, 9, 9)]], alpha=False)
    w, h, px = R.decode_png(a)
    assert (w, h) == (2, 2) and tuple(px[0, 0]) == (255, 0, 0, 255) and px[1, 0, 3] == 0
    df = spark.createDataFrame([("x", bytearray(a)), ("y", bytearray(b"no"))], "name string, content binary")
    r = R.image_metrics(df).first()
    assert r.name == "x" and r.transparent == 0.25 and r.dominant == 0.75
    other = spark.createDataFrame([("x", bytearray(b))], "name string, content binary")
    p = R.image_parity(df.where("name = 'x'"), other).first()
    assert p.mismatch == 0.25 and abs(p.mae - 246 / 4) < 1e-9


def test_redaction(spark):
    assert card_ok("4539 1488 0343 6467") and not card_ok("4539 1488 0343 6476") and not card_ok("12")
    text, n = redact_text("mail a.b@c.org key AKIA" + "A" * 16 + " card 4539 1488 0343 6467 no 4539 1488 0343 6476")
    assert n == 3 and "a.b@c.org" not in text and "[REDACTED:secret:aws_access_key_id]" in text
    assert redact_text(None) == (None, 0) and redact_text("") == ("", 0)
    df = spark.createDataFrame([(1, "x@y.com"), (2, None)], "id int, text string")
    assert [(r.text, r.redactions) for r in redact(df).orderBy("id").collect()] == [("[REDACTED:pii:email]", 1), (None, 0)]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, "click" if i % 3 else "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(event_id * 60) as ts", "event_id % 4 as user_id", "event_type", "value", "concat('{\"k\": ', event_id % 7, '}') as props")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = S.event_stream(spark, f"{tmp_path}/in")
    want = {tuple(r) for r in S.running_totals(df).collect()}
    assert {tuple(r) for r in S.to_memory(S.running_totals(stream), "totals").collect()} == want
    assert {tuple(r) for r in S.to_memory(S.counters(stream), "counters").collect()} == {tuple(r) for r in S.counters(df).collect()}
    for _ in range(2):
        S.drain(stream, F.col("value") >= 10, f"{tmp_path}/ok", f"{tmp_path}/no", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 50 and spark.read.parquet(f"{tmp_path}/no").count() == 10


def test_cache_upsert(spark, tmp_path):
    schema = "file_path string, updated_at string, sha256 string, payload_json string"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    for k, rows in enumerate(([("a", "2", "s2", "{}")], [("a", "1", "s1", "{}"), ("b", "1", "t1", "{}")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.upsert_cache(src.parquet(f"{tmp_path}/in"), f"{tmp_path}/cache", f"{tmp_path}/cp").awaitTermination()
        last = {r.file_path: r.sha256 for r in spark.read.parquet(f"{tmp_path}/cache").collect()}
    assert last == {"a": "s2", "b": "t1"}
