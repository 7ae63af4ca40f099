"""From extraction payloads to a graph: containment, interval joins and tiered name resolution.

A payload row holds a file's definitions, imports, calls and inheritances as
arrays, so what belongs to one file is matched inside its row, without a
shuffle. Names that cross files meet by equi-joins on names or paths, one per
tier; the tier table is united and the best tier a call is kept by a map-side
minimum. Of several payloads of a file the newest counts; null or unreadable
payloads have no records; repeated rows count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Call names too common to be resolved by being unique.
NOISE_CALLS = "get set run init start stop close open read write main execute handle process update create delete render call build format check setup tearDown setUp test".split()
#: File extension to language, and folders a scan skips.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust", "cs": "csharp", "java": "java", "kt": "kotlin", "kts": "kotlin", "swift": "swift"}
SKIPPED_FOLDERS = ".git .agents temp node_modules __pycache__ .venv venv env dist build target .mypy_cache .pytest_cache .tox .idea .vscode bin obj".split()

PAYLOAD = """definitions array<struct<kind:string,local_name:string,receiver_type:string,start_line:int,end_line:int,start_byte:int,end_byte:int>>,
imports array<struct<path_text:string,start_line:int,imported_names:array<string>>>, calls array<struct<name:string,receiver:string,node_start_byte:int,start_line:int>>,
inheritances array<struct<base_name:string,class_start_byte:int,start_line:int>>, parse_had_errors boolean"""


def language_of(path: Column) -> Column:
    """The language by extension, null for others."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def kept_files(files: DataFrame, max_bytes: int = 2_000_000, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Source files a walk keeps: known language, no skipped folder, not too large, not ignored; a later ! rule takes back."""
    p = F.col("rel_path")
    ok = language_of(p).isNotNull() & ~F.exists(F.split(p, "/"), lambda x: x.isin(*SKIPPED_FOLDERS)) & (F.octet_length(F.coalesce("content", F.lit(""))) <= max_bytes)
    ignored = F.lit(False)
    for rule in ignore:
        hit = p.rlike(glob_regex(rule.lstrip("!")))
        ignored = F.when(hit, F.lit(not rule.startswith("!"))).otherwise(ignored)
    return files.where(p.isNotNull() & ok & ~ignored).select("rel_path", language_of(p).alias("language"), "content").distinct()


def glob_regex(pattern: str) -> str:
    """A path pattern with *, ?, ** and a trailing / as a regular expression."""
    out, i = "", 0
    p = pattern.strip("/")
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (p[i] if p[i].isalnum() or p[i] in "_/" else "\\" + p[i]), i + 1
    return ("^" if "/" in p else "(?:^|/)") + out + "(?:/|$)"


def ancestor_folders(paths: DataFrame, col: str = "rel_path") -> DataFrame:
    """(folder, parent): every folder above a file, once; parent null at the top."""
    parts = F.split(col, "/")
    up = paths.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("folder")).distinct()
    return up.select("folder", F.when(F.instr("folder", "/") > 0, F.regexp_replace("folder", "/[^/]*$", "")).alias("parent"))


def newest_payloads(cache: DataFrame) -> DataFrame:
    """(file_path, sha256, language, p) with p the parsed newest payload of each file."""
    new = cache.where("file_path is not null").groupBy("file_path").agg(F.max(F.struct("updated_at", "sha256", "language", "payload_json")).alias("m"))
    return new.select("file_path", F.col("m.sha256").alias("sha256"), F.col("m.language").alias("language"), F.from_json("m.payload_json", PAYLOAD).alias("p"))


def cache_state(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(rel_path, state): hit if the newest cached row has the file's hash, stale if another, miss if there is none."""
    f = files.where("rel_path is not null").select("rel_path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha")).distinct()
    c = cache.where("file_path is not null").groupBy("file_path").agg(F.max_by("sha256", F.struct("updated_at", "sha256")).alias("cached"))
    return f.join(c, f.rel_path == c.file_path, "left").select("rel_path", F.when(F.col("cached").isNull(), "miss").when(F.col("cached") == F.col("sha"), "hit").otherwise("stale").alias("state"))


def definitions(payloads: DataFrame, with_line: bool = False) -> DataFrame:
    """(file_path, ord, kind, name, start, end, parent_ord[, line]): parent is the innermost definition that encloses it, the earlier one on equal ranges."""
    d = payloads.select("file_path", F.array_sort(F.transform("p.definitions", lambda x: F.struct(x["start_byte"].alias("s"), (-x["end_byte"]).alias("neg"), x["local_name"].alias("name"), x["kind"].alias("kind"), x["start_line"].alias("line")))).alias("ds")).where(F.size("ds") > 0)
    # one sweep in order of start: of the definitions still open the last that encloses the next one
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<int>").alias("out"))

    def step(acc, k):
        x = F.get("ds", k)
        still = F.filter(acc["open"], lambda o: -F.get("ds", o)["neg"] > x["s"])
        around = F.array_max(F.filter(acc["open"], lambda o: F.get("ds", o)["neg"] <= x["neg"]))
        return F.struct(F.concat(still, F.array(k)).alias("open"), F.concat(acc["out"], F.array(around)).alias("out"))

    nested = d.select("file_path", "ds", F.aggregate(F.sequence(F.lit(0), F.size("ds") - 1), start, step, lambda acc: acc["out"]).alias("up"))
    x = nested.select("file_path", F.posexplode(F.arrays_zip(F.col("ds").alias("x"), F.col("up").alias("up"))).alias("ord", "z")).select("file_path", "ord", "z.x", "z.up")
    return x.select("file_path", "ord", F.col("x.kind").alias("kind"), F.col("x.name").alias("name"), F.col("x.s").alias("start"), (-F.col("x.neg")).alias("end"), F.col("up").alias("parent_ord"), *([F.col("x.line").alias("line")] if with_line else []))


def innermost_calls(payloads: DataFrame, with_start: bool = False) -> DataFrame:
    """(file_path, pos, callee, receiver, caller[, caller_start]): the callable definition with greatest start around the call, or null for the file."""
    callables = F.filter("p.definitions", lambda x: x["kind"].isin("function", "method"))
    x = payloads.select("file_path", callables.alias("ds"), F.explode("p.calls").alias("c"))
    hit = F.filter("ds", lambda y: (y["start_byte"] <= F.col("c.node_start_byte")) & (F.col("c.node_start_byte") < y["end_byte"]))
    best = F.array_max(F.transform(hit, lambda y: F.struct(y["start_byte"].alias("s"), y["local_name"].alias("name"))))
    return x.select("file_path", F.col("c.node_start_byte").alias("pos"), F.col("c.name").alias("callee"), F.col("c.receiver").alias("receiver"), best["name"].alias("caller"), *([best["s"].alias("caller_start")] if with_start else []))


_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def _normal(path: Column) -> Column:
    """A path without . and .. steps, as far as they stay inside."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    out = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(out, "/")


def import_candidates(imports: DataFrame) -> DataFrame:
    """(file_path, ord, path_text, rank, candidate): the files an import may mean, in probe order, by language."""
    lang, t, f = language_of(F.col("file_path")), F.col("path_text"), F.col("file_path")
    here = F.when(F.instr(f, "/") > 0, F.regexp_replace(f, "/[^/]*$", "")).otherwise(F.lit(""))
    root = F.substring_index(f, "/", 1)
    dots = F.length(F.regexp_extract(t, r"^(\.*)", 1))
    climb = F.array_join(F.slice(F.split(here, "/"), F.lit(1), F.greatest(F.size(F.split(here, "/")) - dots + 1, F.lit(0))), "/")
    rest = F.replace(F.regexp_replace(t, r"^\.+", ""), F.lit("."), F.lit("/"))
    py = _normal(F.concat_ws("/", F.when(dots > 0, climb).otherwise(root), rest))
    js = _normal(F.concat_ws("/", here, t))
    rs_rest = F.replace(F.regexp_replace(t, "^(?:crate|self|super)(?:::)?", ""), F.lit("::"), F.lit("/"))
    rs = _normal(
        F.when(t.rlike("^crate(::|$)"), F.concat_ws("/", root, F.lit("src"), F.when(rs_rest == "", F.lit("lib")).otherwise(rs_rest)))
        .when(t.rlike("^self::"), F.concat_ws("/", here, rs_rest))
        .when(t.rlike("^super::"), F.concat_ws("/", here, F.lit(".."), rs_rest))
    )
    c = (
        F.when(lang == "python", F.array(F.concat(py, F.lit(".py")), F.concat(py, F.lit("/__init__.py"))))
        .when(lang.isin("javascript", "typescript", "tsx") & t.startswith("."), F.concat(F.when(t.rlike(r"\.\w+$"), F.array(js)).otherwise(F.array().cast("array<string>")), F.array(*(F.concat(js, F.lit(x)) for x in _SUFFIXES), *(F.concat(js, F.lit("/index" + x)) for x in _SUFFIXES))))
        .when((lang == "rust") & rs.isNotNull(), F.array(F.concat(rs, F.lit(".rs")), F.concat(rs, F.lit("/mod.rs"))))
    )
    return imports.select("file_path", "ord", "path_text", F.posexplode(c).alias("rank", "candidate"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, ord, path_text, target, resolved, confidence): first existing candidate, the only file with that stem or folder, or that dotted path; else external."""
    f = files.select(F.col("rel_path").alias("candidate")).distinct()
    direct = import_candidates(imports).join(f, "candidate").groupBy("file_path", "ord").agg(F.min_by("candidate", "rank").alias("target"))
    last = lambda c: F.element_at(F.split(F.element_at(F.split(c, "/"), -1), r"\."), -1)
    named = files.select("rel_path", language_of(F.col("rel_path")).alias("lang"), F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.[^.]*$", "").alias("stem"), F.when(F.size(F.split("rel_path", "/")) > 1, F.element_at(F.split("rel_path", "/"), -2)).alias("folder")).where("lang in ('go', 'csharp', 'swift')").distinct()
    keys = named.select("rel_path", "lang", F.explode(F.array_distinct(F.array("stem", "folder"))).alias("key")).where("key is not null").groupBy("lang", "key").agg(F.min("rel_path").alias("lo"), F.max("rel_path").alias("hi")).where("lo = hi").select("lang", "key", F.col("lo").alias("only"))
    # Java and Kotlin name a file by its dotted path: the only file that ends so
    tail = files.select("rel_path", F.when(F.col("rel_path").endswith(".java"), "java").when(F.col("rel_path").endswith(".kt"), "kotlin").alias("lang")).where("lang is not null").distinct()
    steps = F.split("rel_path", "/")
    tail = tail.select("rel_path", "lang", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda k: F.array_join(F.slice(steps, k, F.size(steps)), "/"))).alias("dotted")).where("dotted <> ''")
    tail = tail.groupBy("lang", "dotted").agg(F.min("rel_path").alias("lo"), F.max("rel_path").alias("hi")).where("lo = hi").select("lang", "dotted", F.col("lo").alias("whole"))
    ending = F.concat(F.replace("path_text", F.lit("."), F.lit("/")), F.when(F.col("lang") == "java", ".java").otherwise(".kt"))
    x = imports.join(direct, ["file_path", "ord"], "left").withColumn("lang", language_of(F.col("file_path"))).withColumn("dotted", ending).join(tail, ["lang", "dotted"], "left")
    x = x.withColumn("lang", language_of(F.col("file_path"))).withColumn("key", last(F.col("path_text"))).join(keys, ["lang", "key"], "left")
    target = F.coalesce("target", "only", "whole")
    return x.select("file_path", "ord", "path_text", F.coalesce(F.concat(F.lit("file:"), target), F.concat(F.lit("external:"), F.col("path_text"))).alias("target"), target.isNotNull().alias("resolved"), F.when(target.isNotNull(), "EXTRACTED").otherwise("AMBIGUOUS").alias("confidence"))


def file_imports(payloads: DataFrame) -> DataFrame:
    """(file_path, ord, path_text, names) of every import."""
    return payloads.select("file_path", F.posexplode("p.imports").alias("ord", "i")).select("file_path", "ord", F.col("i.path_text").alias("path_text"), F.col("i.imported_names").alias("names"))


#: Tier to score in hundredths and confidence.
TIERS = {1: (100, "EXTRACTED"), 2: (100, "EXTRACTED"), 3: (95, "EXTRACTED"), 4: (90, "EXTRACTED"), 5: (80, "INFERRED"), 6: (65, "INFERRED"), 7: (40, "AMBIGUOUS"), 8: (20, "AMBIGUOUS")}


def resolve_calls(calls: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(call_id, target, tier, score, confidence, resolved) by the first tier that has an answer.

    calls: call_id, file_path, class_id (null outside classes), name, receiver.
    defs: id, file_path, name, qualified_name, class_id (null outside classes), seq (order in the file).
    imports: file_path, target_file, names (array), ord; resolved ones only.
    Tiers: 1 own class, 2 last of that name in the file, 3 imported by name, 4 imported
    module named like the receiver, 5 imported receiver, 6 the only one anywhere,
    7 the only one in the folder, 8 external.
    """
    own, no_recv = F.col("receiver").isin("self", "this"), F.col("receiver").isNull()
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    c = calls.select("call_id", "file_path", "class_id", "name", "receiver")
    exports = defs.select("id", "file_path", "seq", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("export")).where("export is not null")
    last = exports.groupBy(F.col("file_path").alias("xf"), F.col("export").alias("xn")).agg(F.max_by("id", F.struct("seq", "id")).alias("target"))
    t1 = c.where(own & F.col("class_id").isNotNull()).join(defs.where("class_id is not null").groupBy("class_id", "name").agg(F.max_by("id", F.struct("seq", "id")).alias("target")), ["class_id", "name"]).select("call_id", F.lit(1).alias("tier"), F.lit(0).alias("ord"), "target")
    t2 = c.where(no_recv).join(last, (F.col("file_path") == F.col("xf")) & (F.col("name") == F.col("xn"))).select("call_id", F.lit(2).alias("tier"), F.lit(0).alias("ord"), "target")
    by_name = imports.select(F.col("file_path").alias("f"), "target_file", "ord", F.explode("names").alias("imported"))
    t3 = c.where(no_recv).join(by_name, (F.col("file_path") == F.col("f")) & (F.col("name") == F.col("imported"))).join(last, (F.col("target_file") == F.col("xf")) & (F.col("name") == F.col("xn"))).select("call_id", F.lit(3).alias("tier"), (-F.col("ord")).alias("ord"), "target")
    stem = F.regexp_replace(F.element_at(F.split("target_file", "/"), -1), r"\.[^.]*$", "")
    modules = imports.select(F.col("file_path").alias("f"), "target_file", "ord", F.explode(F.array_distinct(F.array(stem, F.replace(stem, F.lit("_"), F.lit(""))))).alias("module"))
    t4 = c.where(~no_recv & ~own).join(modules, (F.col("file_path") == F.col("f")) & (F.col("receiver") == F.col("module"))).join(last, (F.col("target_file") == F.col("xf")) & (F.col("name") == F.col("xn"))).select("call_id", F.lit(4).alias("tier"), "ord", "target")
    r = c.where(~no_recv & ~own).join(by_name, (F.col("file_path") == F.col("f")) & (F.col("receiver") == F.col("imported")))
    t5 = r.select("call_id", "target_file", "ord", F.posexplode(F.array(F.concat_ws(".", "receiver", "name"), F.col("name"))).alias("k", "want")).join(last, (F.col("target_file") == F.col("xf")) & (F.col("want") == F.col("xn"))).select("call_id", F.lit(5).alias("tier"), (F.col("k") - F.col("ord") * 2).alias("ord"), "target")
    free = c.where(no_recv & ~F.col("name").isin(NOISE_CALLS))
    anywhere = exports.groupBy(F.col("export").alias("xn")).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("target")).where("k = 1")
    t6 = free.join(anywhere, F.col("name") == F.col("xn")).select("call_id", F.lit(6).alias("tier"), F.lit(0).alias("ord"), "target")
    near = exports.groupBy(folder("file_path").alias("xd"), F.col("export").alias("xn")).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("target")).where("k = 1")
    t7 = free.join(near, (folder("file_path") == F.col("xd")) & (F.col("name") == F.col("xn"))).select("call_id", F.lit(7).alias("tier"), F.lit(0).alias("ord"), "target")
    t8 = c.select("call_id", F.lit(8).alias("tier"), F.lit(0).alias("ord"), F.concat(F.lit("external:"), F.concat_ws(".", "receiver", "name")).alias("target"))
    best = reduce(DataFrame.unionByName, (t1, t2, t3, t4, t5, t6, t7, t8)).groupBy("call_id").agg(F.min(F.struct("tier", "ord", "target")).alias("b"))
    tier = F.col("b.tier")
    pick = lambda k: reduce(lambda acc, t: acc.when(tier == t, TIERS[t][k]), TIERS, F)
    return best.select("call_id", F.col("b.target").alias("target"), tier.alias("tier"), pick(0).alias("score"), pick(1).alias("confidence"), (tier < 8).alias("resolved"))


def symbols(payloads: DataFrame) -> DataFrame:
    """(id, kind, name, qualified_name, file_path, seq, parent_id, class_id): the nodes of all definitions, seq their start.

    Ids are <kind>:<path>::<qualified name>; a repeated one gets the suffix :L<line>.
    A function inside another definition is a method; class_id is the class right around it.
    """
    d = definitions(payloads, with_line=True)
    p = d.select("file_path", F.col("ord").alias("parent_ord"), F.col("name").alias("pn"), F.col("kind").alias("pk"))
    kind = F.when((F.col("kind") == "function") & F.col("pn").isNotNull(), "method").otherwise(F.col("kind"))
    x = d.join(p, ["file_path", "parent_ord"], "left").withColumn("k", kind).withColumn("q", F.concat_ws(".", "pn", "name"))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("file_path", "k", "q").orderBy("start", "ord")))
    node = F.concat("k", F.lit(":"), "file_path", F.lit("::"), "q", F.when(F.col("r") > 1, F.concat(F.lit(":L"), F.col("line").cast("string"))).otherwise(F.lit("")))
    outer = F.concat("pk", F.lit(":"), "file_path", F.lit("::"), "pn")
    parent = F.when(F.col("pn").isNull(), F.concat(F.lit("file:"), "file_path")).otherwise(outer)
    return x.select(node.alias("id"), F.col("k").alias("kind"), "name", F.col("q").alias("qualified_name"), "file_path", F.col("start").alias("seq"), parent.alias("parent_id"), F.when((F.col("pk") == "class") & (F.col("k") == "method"), outer).alias("class_id"))


def payload_calls(payloads: DataFrame, with_source: bool = False) -> tuple[DataFrame, DataFrame]:
    """(calls, defs) of payloads in the shape resolve_calls takes; with_source: calls with the node they lie in."""
    defs = symbols(payloads).select("id", "file_path", "name", "qualified_name", "class_id", "seq", "kind")
    c = innermost_calls(payloads, with_start=True)
    m = defs.where("kind <> 'class'").groupBy("file_path", F.col("name").alias("caller"), F.col("seq").alias("caller_start")).agg(F.min("class_id").alias("class_id"), F.min("id").alias("source"))
    source = [F.coalesce("source", F.concat(F.lit("file:"), "file_path")).alias("source_id")] if with_source else []
    calls = c.join(m, ["file_path", "caller", "caller_start"], "left").select(F.concat_ws("@", "file_path", F.col("pos").cast("string"), "callee").alias("call_id"), "file_path", "class_id", F.col("callee").alias("name"), "receiver", *source).distinct()
    return calls, defs.drop("kind")


#: Tier to score in hundredths and confidence, for base classes.
BASE_TIERS = {1: (100, "EXTRACTED"), 2: (95, "EXTRACTED"), 3: (90, "EXTRACTED"), 4: (75, "INFERRED"), 5: (20, "AMBIGUOUS")}


def resolve_inheritances(bases: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(inh_id, target, tier, score, confidence, resolved) by the first tier that has an answer.

    bases: inh_id, file_path, base_name. defs and imports as for resolve_calls.
    Tiers: 1 the same file has the name as written, or its last part; 2 imported by
    name; 3 the first imported file that has it; 4 the only one anywhere; 5
    external. A null base has no row; repeated rows count once.
    """
    b = bases.where("base_name is not null").select("inh_id", "file_path", "base_name", F.element_at(F.split("base_name", r"\."), -1).alias("raw")).distinct()
    exports = defs.select("id", "file_path", "seq", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("export")).where("export is not null")
    last = exports.groupBy(F.col("file_path").alias("xf"), F.col("export").alias("xn")).agg(F.max_by("id", F.struct("seq", "id")).alias("target"))
    row = lambda t, o: ("inh_id", F.lit(t).alias("tier"), o.cast("long").alias("ord"), "target")
    t1 = b.select("inh_id", "file_path", F.posexplode(F.array_distinct(F.array("base_name", "raw"))).alias("k", "want")).join(last, (F.col("file_path") == F.col("xf")) & (F.col("want") == F.col("xn"))).select(*row(1, F.col("k")))
    i = imports.select(F.col("file_path").alias("f"), "target_file", "ord", "names")
    t2 = b.join(i.select("f", "target_file", "ord", F.explode("names").alias("imported")), (F.col("file_path") == F.col("f")) & (F.col("raw") == F.col("imported"))).join(last, (F.col("target_file") == F.col("xf")) & (F.col("raw") == F.col("xn"))).select(*row(2, -F.col("ord")))
    t3 = b.join(i, F.col("file_path") == F.col("f")).join(last, (F.col("target_file") == F.col("xf")) & (F.col("raw") == F.col("xn"))).select(*row(3, F.col("ord")))
    anywhere = exports.groupBy(F.col("export").alias("xn")).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("target")).where("k = 1")
    t4 = b.join(anywhere, F.col("raw") == F.col("xn")).select(*row(4, F.lit(0)))
    t5 = b.withColumn("target", F.concat(F.lit("external:"), "base_name")).select(*row(5, F.lit(0)))
    best = reduce(DataFrame.unionByName, (t1, t2, t3, t4, t5)).groupBy("inh_id").agg(F.min(F.struct("tier", "ord", "target")).alias("b"))
    tier = F.col("b.tier")
    pick = lambda k: reduce(lambda acc, t: acc.when(tier == t, BASE_TIERS[t][k]), BASE_TIERS, F)
    return best.select("inh_id", F.col("b.target").alias("target"), tier.alias("tier"), pick(0).alias("score"), pick(1).alias("confidence"), (tier < 5).alias("resolved"))


def payload_bases(payloads: DataFrame, defs: DataFrame) -> DataFrame:
    """(inh_id, file_path, base_name, source_id) of the inheritances in payloads; the class is the definition that starts where the row says."""
    x = payloads.select("file_path", F.explode("p.inheritances").alias("i")).select("file_path", F.col("i.base_name").alias("base_name"), F.col("i.class_start_byte").alias("seq"))
    source = defs.groupBy("file_path", "seq").agg(F.min("id").alias("source_id"))
    return x.join(source, ["file_path", "seq"]).select(F.concat_ws("@", "source_id", "base_name").alias("inh_id"), "file_path", "base_name", "source_id").distinct()


def resolved_imports(payloads: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, target_file, names, ord) of the imports that lead to a file."""
    i = file_imports(payloads)
    hit = resolve_imports(i, files).where("resolved")
    return hit.join(i, ["file_path", "ord", "path_text"]).select("file_path", F.regexp_replace("target", "^file:", "").alias("target_file"), "names", "ord")


def extract_python(files: DataFrame) -> DataFrame:
    """(file_path, payload_json): definitions, imports, calls and bases of Python files by the standard parser, in Arrow batches."""
    import ast
    import json

    import pandas as pd

    def one(text: str) -> str:
        out = {"definitions": [], "imports": [], "calls": [], "inheritances": [], "parse_had_errors": False}
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return json.dumps(out | {"parse_had_errors": True})
        starts = [0]
        for line in text.encode().split(b"\n"):
            starts.append(starts[-1] + len(line) + 1)
        at = lambda n: starts[n.lineno - 1] + n.col_offset
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                out["definitions"].append({"kind": kind, "local_name": n.name, "receiver_type": None, "start_line": n.lineno, "end_line": n.end_lineno, "start_byte": at(n), "end_byte": starts[n.end_lineno - 1] + n.end_col_offset})
                for b in getattr(n, "bases", ()):
                    out["inheritances"].append({"base_name": ast.unparse(b), "class_start_byte": at(n), "start_line": n.lineno})
            elif isinstance(n, ast.Import):
                out["imports"] += [{"path_text": a.name, "start_line": n.lineno, "imported_names": []} for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out["imports"].append({"path_text": "." * n.level + (n.module or ""), "start_line": n.lineno, "imported_names": [a.name for a in n.names]})
            elif isinstance(n, ast.Call):
                f = n.func
                name, recv = (f.attr, ast.unparse(f.value)) if isinstance(f, ast.Attribute) else (getattr(f, "id", None), None)
                if name:
                    out["calls"].append({"name": name, "receiver": recv, "node_start_byte": at(n), "start_line": n.lineno})
        return json.dumps(out)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"file_path": b["rel_path"], "payload_json": [one(t) for t in b["content"]]})

    py = files.where("rel_path like '%.py' and content is not null").select("rel_path", "content").distinct()
    return py.mapInPandas(run, "file_path string, payload_json string")
