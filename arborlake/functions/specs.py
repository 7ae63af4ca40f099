"""Filter specs as data: loading, dumping, trust by pinned hash, and the cases each spec carries.

A spec is a JSON object with the fields of FilterSpec and cases, pairs of input
and expected output. Patterns that do not compile are reported and left out; a
spec that is no object or has no name is refused. Only specs whose file has the
pinned hash are used.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.lines import SPECS, FilterSpec

_LISTS = ("strip", "keep", "errors")

#: Cases of our own specs: (spec, input, expected).
CASES = [
    ("build-log", "   Compiling a v1\n   Compiling b v2\nwarning: unused x\n   Checking c\n", "warning: unused x"),
    ("build-log", "Compiling a\nerror: no such crate\n", "error: no such crate"),
    ("build-log", "Downloading x\nDownloading y\n", "build: nothing to report"),
    ("build-log", "", "build: nothing to report"),
    ("build-log", "ok\nok\nok\n", "ok [repeated 3 times]"),
    ("cluster-list", "NAME  STATUS  AGE\na  Running  1d\nb  CrashLoopBackOff  1d\n", "NAME  STATUS  AGE\nb  CrashLoopBackOff  1d"),
    ("cluster-list", "a  Running  1d\n", "pods: all running"),
    ("compose", "web Pulling\nweb Extracting\nweb Started\n", "web Started"),
    ("compose", "db Waiting\n", "containers: done"),
    ("infra-plan", "a: Refreshing state...\nNo changes. Your plan matches.\n", "plan: no changes"),
    ("infra-plan", "a: Refreshing state...\n+ resource b\n", "+ resource b"),
    ("install", "Collecting x\n  Downloading x-1.whl\nSuccessfully installed x-1\n", "Successfully installed x-1"),
    ("install", "npm notice a\n", "install: ok"),
    ("lint", "Checking 9 files\nAll checks passed!\n", "lint: ok"),
    ("lint", "Scanning\na.py:1:1 E1 bad\n", "a.py:1:1 E1 bad"),
    ("repo-status", "On branch main\n\tmodified:   a.py\n", "  a.py"),
    ("repo-status", "On branch main\nnothing to commit, working tree clean\n", "status: clean"),
    ("changelog", "# 1.2\n- Added: x\n- Fixed: y\n", "# 1.2\n- Fixed: y"),
    ("changelog", "nothing here\n", "no fixes"),
    ("service-log", "2024-05-06T07:08:09Z INFO up\n2024-05-06T07:08:10Z WARN slow\n", "2024-05-06 WARN slow"),
    ("service-log", "DEBUG a\nDEBUG b\n", "all quiet"),
    ("test-run", "....\nt.py::a PASSED\nt.py::b FAILED\n", "t.py::b FAILED"),
    ("test-run", "12 passed, 0 failed\n", "tests: ok"),
    ("test-run", "12 passed, 0 failed\nError in teardown\n", "12 passed, 0 failed\nError in teardown"),
]


def load_specs(texts: list[str]) -> tuple[list[FilterSpec], list[str]]:
    """(specs, reports) of JSON texts; unknown fields are ignored."""
    known = {f.name for f in fields(FilterSpec)}
    specs, reports = [], []
    for k, text in enumerate(texts):
        try:
            d = json.loads(text)
        except ValueError as e:
            reports.append(f"text {k}: {e}")
            continue
        if not isinstance(d, dict) or not d.get("name"):
            reports.append(f"text {k}: no spec")
            continue
        d = {a: v for a, v in d.items() if a in known}

        def good(p, name=d["name"]) -> bool:
            try:
                re.compile(p)
                return True
            except (re.error, TypeError) as e:
                reports.append(f"{name}: {p!r}: {e}")
                return False

        for a in _LISTS:
            if a in d:
                d[a] = type(getattr(FilterSpec("x"), a))(p for p in d[a] if good(p))
        for a in ("replace", "short_circuit"):
            if a in d:
                d[a] = [tuple(r) + ((None,) if a == "short_circuit" and len(r) == 2 else ()) for r in d[a] if good(r[0])]
        if "match_command" in d and not good(d["match_command"]):
            del d["match_command"]
        specs.append(FilterSpec(**d))
    return specs, reports


def dump_spec(spec: FilterSpec) -> str:
    """The JSON text of a spec; load_specs gives it back."""
    return json.dumps(asdict(spec), indent=1, sort_keys=True)


def trusted(files: DataFrame, pins: DataFrame) -> DataFrame:
    """(name, text, trusted): spec files (name, text) with whether their hash is the pinned one (name, sha256)."""
    p = pins.groupBy("name").agg(F.max("sha256").alias("pin"))
    return files.join(p, "name", "left").select("name", "text", F.coalesce(F.sha2(F.col("text"), 256) == F.col("pin"), F.lit(False)).alias("trusted"))


def pin(files: DataFrame) -> DataFrame:
    """(name, sha256) pins of spec files as they are."""
    return files.select("name", F.sha2(F.col("text"), 256).alias("sha256"))


def run_cases(spark: SparkSession, specs: list[FilterSpec] = SPECS, cases=CASES) -> DataFrame:
    """(spec, i, got, expected, ok) of every case."""
    rows = spark.createDataFrame([(s, i, x, y) for i, (s, x, y) in enumerate(cases)], "spec string, i int, input string, expected string")
    got = None
    for s in specs:
        got = F.when(F.col("spec") == s.name, s.compile(F.col("input"))) if got is None else got.when(F.col("spec") == s.name, s.compile(F.col("input")))
    return rows.withColumn("got", got).select("spec", "i", "got", "expected", F.col("got").eqNullSafe(F.col("expected")).alias("ok"))
