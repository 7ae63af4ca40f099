"""Files nobody wrote by hand in their repository: minified, generated, data blobs and vendored copies.

Each file is lexed and re-emitted in a canonical layout, one statement a line.
The original is compared with it: a file whose canonical form has several times
its lines is minified; one whose canonical lines nearly all share one shape of
tokens is generated; one whose code is mostly literals is a data blob. The hash
of the canonical tokens, comments aside, is the same for every copy of a file
whatever its layout or licence header, so a text that two repositories hold
under the same extension is a copy of some project; so is one that lies in a
dependency folder or whose opening comment grants another project's licence.
Such files are hashed too: a copy without folder or header is found by them.

Defined results: null, empty and comment-only content is hand-written unless
its folder or licence says otherwise; extensions without a lexer are judged by
folder, licence and copies of equal text; repeated rows count once (of different
texts under one path the smaller verdict counts, none before any); the whole
text is read and no group of copies is collected.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.core import lookup, scratch
from arborlake.llm.lexers import language_of, lex

#: Canonical lines over original non-empty code lines from which a file is squeezed.
EXPANSION = 8.0
#: Share of canonical lines of one shape from which a file is uniform, the share that suffices below a generator's header, and the fewest lines that can tell.
UNIFORM, UNIFORM_BELOW_HEADER, LEAST_LINES = 0.9, 0.6, 10
#: Share of code characters inside literals from which a file is data.
LITERAL, LEAST_LITERAL = 0.5, 400
#: Words in a literal from which it is prose, which people write.
PROSE_WORDS = 6
#: Extensions whose statements end and nest as in a language that has a lexer; used for layout only.
LIKE = {"css": "java", "scss": "java", "less": "java", "c": "java", "h": "java", "cc": "java", "cpp": "java", "hpp": "java", "php": "java", "swift": "kotlin", "scala": "kotlin", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "tsx": "typescript", "kts": "kotlin"}
#: Canonical tokens from which equal copies in two repositories are no chance.
LEAST_TOKENS = 40

#: Folders that hold other projects' code.
_FOLDERS = re.compile(r"/(?:vendor|vendored|third[_-]party|thirdparty|3rdparty|deps|extern|externals?|node_modules|bower_components|site-packages)/")
_BANNER = re.compile(r"(?i)(?:\(c\)|©|copyright)\s*(?:\(c\)\s*)?\d{4}[^\n]*?\bthe\s+([\w.-]+)\s+(?:project|authors|contributors|developers)")
_GRANT = re.compile(r"(?i)distributed under|licen[sc]ed under|permission (?:to use|is hereby granted)|all rights (?:held|reserved) by|spdx-license-identifier")
_HEADER = re.compile(
    r"(?i)^\W*(?:@generated\b|<auto-generated>|auto-?generated (?:file|by|from|code)|(?:this (?:file|code) (?:is|was) )(?:auto\w* )?(?:generated|created automatically)|"
    r"code generated by .{0,80}do not edit|generated by (?:the )?\S+ (?:compiler|tool|from)|do not modify this file directly|automatisch erzeugt)"
)


def _comment_text(t: str) -> str:
    return re.sub(r"(?m)^[ \t]*(?://[/!]?|/?\*+[!/]?|#+)[ \t]?", "", t).strip()


def _code_lines(tokens: list[str], classes: list[str]) -> tuple[list[str], int, int, int, int]:
    """Shapes of the canonical lines, original code lines, literal and code characters, code tokens."""
    shapes, line, depth = [], [], 0
    own = lit = code = n = 0
    dirty = False
    for t, c in zip(tokens, classes, strict=True):
        if c == "" or (c == "\n" and t != "\n"):
            continue
        if c == "\n":
            if dirty:
                own += 1
                dirty = False
            if line and depth <= 0:
                shapes.append("".join(line))
                line = []
            continue
        dirty = True
        n += 1
        if c == "s" and not line and depth <= 0:  # a string that is a statement is documentation, not data
            line.append(c)
            continue
        code += len(t)
        if c in "s0":
            lit += len(t) if c == "0" or len(t.split(None, PROSE_WORDS)) <= PROSE_WORDS else 0
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if c in "s0" and line and line[-1] in "s0," and (len(line) < 2 or line[-1] == ","):
            while line and line[-1] in "s0,":
                line.pop()
        line.append(c)
        if c in ";{}" and depth <= 0:
            shapes.append("".join(line))
            line = []
    if dirty:
        own += 1
    if line:
        shapes.append("".join(line))
    return shapes, own, lit, code, n


def layout(tokens: list[str], classes: list[str]) -> dict:
    """Evidence of one lexed file: expansion, canonical lines, uniform, literal, and the canonical form's hash and length."""
    shapes, own, lit, code, n = _code_lines(tokens, classes)
    body = [s for s in shapes if len(s) > 2]
    top, share = ("", 0.0)
    if len(body) >= LEAST_LINES:
        top, k = Counter(body).most_common(1)[0]
        share = k / len(body)
    if not re.search(r"[=(:]", top):
        share = 0.0
    h = hashlib.blake2b(" ".join(t for t, c in zip(tokens, classes, strict=True) if c not in ("", "\n")).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return {"expansion": len(shapes) / max(own, 1), "lines": len(shapes), "uniform": share, "literal": lit / max(code, 1), "literal_chars": lit, "tokens": n, "canonical": h}


def evidence(path: str, text: str | None) -> tuple:
    """(reason or None, canonical hash or None) from the file alone; it is lexed once."""
    repo = path.split("/", 1)[0]
    folder = "vendored folder" if _FOLDERS.search(path) else None
    if not text:
        return folder, None
    lang = language_of(path) or LIKE.get(path.rpartition(".")[2].lower())
    if lang is None:
        return folder, hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if len(text) >= 200 else None
    tokens, classes = lex(text, lang)
    opening = []
    for t, c in zip(tokens, classes, strict=True):
        if c == "" or (c == "\n" and t != "\n"):
            opening.append(t)
        elif c != "\n":
            break
    head = _comment_text("\n".join(opening))
    m = _BANNER.search(head)
    f = layout(tokens, classes)
    copied = f["canonical"] if f["tokens"] >= LEAST_TOKENS else None
    if folder:
        return folder, copied
    if m and m.group(1).lower() not in repo.lower() and _GRANT.search(head):
        return "licence of another project", copied
    if f["literal"] >= LITERAL and f["literal_chars"] >= LEAST_LITERAL:
        return "data", f["canonical"]
    if f["expansion"] >= EXPANSION and f["lines"] >= LEAST_LINES:
        return "minified", f["canonical"]
    if f["uniform"] >= UNIFORM:
        return "generated", f["canonical"]
    if f["uniform"] >= UNIFORM_BELOW_HEADER and any(_HEADER.search(x) for x in head.split("\n")):
        return "generated header", f["canonical"]
    return None, copied


def classify_origin(files: DataFrame, path: str = "rel_path", text: str = "content") -> DataFrame:
    """(rel_path, reason) one row a different path; reason is null for hand-written files."""

    def run(batches):
        for b in batches:
            rows = []
            for p, t in zip(b["p"], b["t"], strict=True):
                why, h = evidence(p, t if isinstance(t, str) else None)
                rows.append((p, why, None if h is None else p.rpartition(".")[2] + ":" + h))
            yield pd.DataFrame(rows, columns=["rel_path", "own_reason", "canonical"])

    rows = files.where(F.col(path).isNotNull()).select(F.col(path).alias("p"), F.col(text).alias("t"))
    judged = rows.mapInPandas(run, "rel_path string, own_reason string, canonical string")  # texts stay where they were read
    seen = scratch(judged.groupBy("rel_path").agg(F.min(F.struct("own_reason", "canonical")).alias("m")).select("rel_path", "m.*"), "origin")
    repo = F.substring_index("rel_path", "/", 1)
    copies = (
        seen.where("canonical is not null")
        .groupBy("canonical")
        .agg(F.min(repo).alias("lo"), F.max(repo).alias("hi"))
        .where("lo <> hi")
        .select("canonical", F.lit("copy in another repository").alias("copied"))
    )
    rows = seen.count()
    return lookup(seen, copies, "canonical", rows).select("rel_path", F.coalesce("own_reason", "copied").alias("reason"))


def machine_files(files: DataFrame) -> DataFrame:
    """(rel_path) of files that were not written by hand in their repository."""
    return classify_origin(files).where("reason is not null").select("rel_path")
