"""Functions paired with the documentation that belongs to them.

Comment spans and function spans are extracted from a text independently, both
with their lines; an as-of interval join then gives each function its nearest
comment: the last one that ends above the definition, or for Python the first
string that opens the body. The pair is rejected when a blank line, a tool
directive, another comment or a statement lies between, when the comment is not
of the language's documentation form, or when fewer than four words remain
after tags, parameter lines, mark-up, to-do lines, fill-in text and the words
of the function's own name are taken away.

Defined results: null or empty text, unknown languages and texts without a
definition give no pair; repeated rows count once; an id with several different
texts gives a pair for each (its id once in documented()).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.lexers import language_of

#: Words that must remain for documentation to say something.
LEAST_WORDS = 4

_DIRECTIVE = re.compile(
    r"(?i)^(?://|#|/\*)\s*(?:no ?lint\b|go:|\+build|eslint|tslint|jshint|jslint|prettier-|@ts-|ts-|noinspection|noqa|nosec|pylint:|type:\s*ignore|fmt:|mypy:|pragma|rustfmt|clippy|resharper|nosonar|checkstyle|istanbul|c8 |v8 |biome|deno-|#?region|#?endregion|swiftlint|ktlint|detekt|lint:|coverage:|isort:|yapf:|spell-?check|cspell|suppress)"
)
_ATTRIBUTE = re.compile(r"^(?:@\w[\w.]*(?:\(.*\))?|#!?\[.*\]|\[[A-Z]\w*(?:\(.*\))?(?:,.*)?\])\s*$")
_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|wip)\b")
_FILL = re.compile(
    r"(?i)^\W*(?:\[?\s*(?:summary|description|documentation|docs?|text|comment)s? (?:goes|go|to come|comes|follows|here|missing|pending|needed|tbd)\b.*|(?:see|same as) (?:above|below|previous)\W*|lorem ipsum.*|(?:no|missing|empty|placeholder) (?:documentation|description|docs?|summary)\W*|(?:insert|add|write|enter|put) (?:\w+ ){0,3}(?:here|documentation|description|summary|docs?)\W*|to be (?:documented|written|done|defined)\W*|\.\.\.)$"
)
_PARAM = re.compile(
    r"^(?:[@\\:](?:param|arg|argument|key|keyword|type|rtype|return|returns|raise|raises|throws|exception|see|since|author|version|deprecated|todo|template|typeparam|property|yield|yields|var|ivar|cvar|internal|private|public|override|inheritdoc)\b.*|"
    r"[*-]\s*`[^`]*`.*|`[^`]*`\s*[:-].*|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Examples?|Notes?)\s*:?\s*|-{3,}|#+\s*(?:Arguments|Parameters|Returns|Errors|Panics|Safety|Examples?)\s*)$"
)
_NAMED = re.compile(r"^([A-Za-z_$][\w$]*)\s*(?:\([^()]*\))?\s*:(?:\s|$)")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_JOINED = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def clean_documentation(text: str, name: str, parameters: set[str] = frozenset()) -> tuple[str, int]:
    """(description without tags and the like, words left besides those of the name)."""
    kept, dropping = [], False
    text = re.sub(r"(?is)<param\b.*?(?:</param>|/>)|<(?:returns|exception|typeparam|remarks/|seealso|value|example)\b.*?(?:</(?:returns|exception|typeparam|value|example)>|/>)", " ", text)
    for raw in text.split("\n"):
        line = re.sub(r"</?[A-Za-z][^<>]*>", " ", raw).strip()
        line = re.sub(r"^(?:\*+(?!\s*`)\s?|///?!?\s?|#+\s(?!Arg|Par|Ret|Err|Pan|Saf|Exa))", "", line).strip()
        named = _NAMED.match(line)
        if not line:
            dropping = False
            continue
        if _PARAM.match(line) or (named and (named.group(1) in parameters or re.search(r"[a-z][A-Z]|_", named.group(1)))):
            dropping = False
            continue
        if _FILL.match(line):
            dropping = False
            continue
        if _TODO.match(line):
            dropping = not re.search(r"[.!?:]$", line)
            continue
        if dropping and line[:1].islower():
            dropping = not re.search(r"[.!?:]$", line)
            continue
        dropping = False
        if re.fullmatch(r"[=~^\-_*#+.\s]+", line):
            continue
        kept.append(line)
    description = " ".join(kept)
    plain = re.sub(r"\{@\w+\s+([^}]*)\}|`([^`]*)`|\[([^\]]*)\]\([^)]*\)", r" \1\2\3 ", description)
    plain = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", " ", plain) if name else plain
    own = {p.lower() for p in _PART.findall(name or "")} | {(name or "").lower()}
    words = [w for w in _WORDS.findall(plain) if w.lower() not in own]
    n = len(words) + sum(len(_JOINED.findall(w)) // 2 - 1 for w in words if _JOINED.search(w))
    return description, n


def _python_spans(text: str):
    m = re.search(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*(?:\[[^\]]*\])?\(", text)
    if not m:
        return None
    depth, i, n = 1, m.end(), len(text)
    token = re.compile(r"#[^\n]*|\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[()\[\]{}:]|[^\"'#()\[\]{}:]+|.")
    end = None
    while i < n:
        t = token.match(text, i)
        if t is None:
            break
        g, i = t.group(), t.end()
        if g in ("(", "[", "{"):
            depth += 1
        elif g in (")", "]", "}"):
            depth -= 1
        elif g == ":" and depth == 0:
            end = i
            break
    if end is None:
        return None
    params = set(re.findall(r"[A-Za-z_]\w*", text[m.end() : end]))
    line = text.count("\n", 0, end)
    body = re.compile(r"(?:[ \t]*(?:#[^\n]*)?(?:\n|$))*[ \t]*").match(text, end).end()
    doc = re.compile(r"[rRuU]?(?:\"\"\"(?P<a>(?:\\(?s:.)|[^\\])*?)\"\"\"|'''(?P<b>(?:\\(?s:.)|[^\\])*?)'''|\"(?P<c>(?:\\.|[^\"\\\n])*)\"|'(?P<d>(?:\\.|[^'\\\n])*)')[ \t]*(?=[\n;#]|$)").match(text, body)
    comments = []
    at = text.count("\n", 0, body)
    if doc and body > end:
        comments.append((at, at + doc.group().count("\n"), True, next(x for x in (doc["a"], doc["b"], doc["c"], doc["d"]) if x is not None)))
    return line, at, [at], comments, params


_FORM = {"javascript": "/**", "typescript": "/**", "java": "/**", "kotlin": "/**", "rust": "///", "csharp": "///", "go": "//"}


def _brace_spans(text: str, language: str):
    lines = text.split("\n")
    comments, breaks, i = [], [], 0
    form = _FORM[language]
    while i < len(lines):
        t = lines[i].strip()
        if not t:
            breaks.append(i)
            i += 1
        elif t.startswith("/*"):
            j = i
            while j < len(lines) and "*/" not in lines[j][lines[j].find("/*") + 2 if j == i else 0 :]:
                j += 1
            if j >= len(lines):
                return None
            block = "\n".join(lines[i : j + 1])
            inner = block[block.index("/*") :]
            rest = inner[inner.index("*/", 2) + 2 :].strip()
            doc = inner.startswith("/**") and not inner.startswith(("/***", "/**/"))
            if _DIRECTIVE.match(t):
                breaks += list(range(i, j + 1))
            else:
                comments.append((i, j, doc and form == "/**", re.sub(r"(?m)^[ \t]*\*+(?!/)[ \t]?", "", inner[3 if doc else 2 : inner.index("*/", 2)])))
            if rest and not rest.startswith(("/*", "//")):
                return j, j, breaks, comments, set(re.findall(r"[A-Za-z_]\w*", rest))
            i = j + 1
        elif t.startswith("//"):
            kind = "dir" if _DIRECTIVE.match(t) else "///" if t.startswith("///") and not t.startswith("////") else "//"
            j = i
            if kind == "dir":
                breaks.append(i)
            else:
                while j + 1 < len(lines):
                    u = lines[j + 1].strip()
                    k = "" if not u.startswith("//") else "dir" if _DIRECTIVE.match(u) else "///" if u.startswith("///") and not u.startswith("////") else "//"
                    if k != kind:
                        break
                    j += 1
                comments.append((i, j, kind == form or (form == "//" and kind == "///"), "\n".join(re.sub(r"^\s*//[/!]?[ \t]?", "", x) for x in lines[i : j + 1])))
            i = j + 1
        elif _ATTRIBUTE.match(t):
            i += 1
        else:
            head = []  # the whole header, down to its body
            for x in lines[i:]:
                head.append(x.partition("{")[0])
                if "{" in x:
                    break
            return i, i, breaks, comments, set(re.findall(r"[A-Za-z_]\w*", " ".join(head)))
    return None


def spans(text: str | None, language: str | None, name: str | None):
    """Comment and function spans of one text, or None: (forward, line, breaks, [(start, end, form, description, words)])."""
    if not text or language is None:
        return None
    found = _python_spans(text) if language == "python" else _brace_spans(text, language)
    if found is None:
        return None
    line, at, breaks, comments, params = found
    rows = []
    for s, e, form, body in comments:
        description, words = clean_documentation(body, name or "", params) if form else ("", 0)
        rows.append((s, e, form, description, words))
    return language == "python", at if language == "python" else line, breaks, rows


_SPANS = "struct<forward:boolean, line:int, breaks:array<int>, comments:array<struct<s:int, e:int, form:boolean, description:string, words:int>>>"


def _extract(nodes: DataFrame, with_code: bool) -> DataFrame:
    """Spans of every function and method that has a comment; the text itself goes along only where it is wanted."""
    more = ["code", "signature"] if with_code else []
    schema = "id string, name string, " + "".join(f"{c} string, " for c in more) + f"found {_SPANS}"

    def run(batches):
        for b in batches:
            out = []
            for i, n, p, s, g in zip(b["id"], b["name"], b["path"], b["snippet"], b["signature"], strict=True):
                found = spans(s, language_of(p), n)
                if found is not None and found[3]:
                    marks = {"forward": found[0], "line": found[1], "breaks": found[2], "comments": [dict(zip(("s", "e", "form", "description", "words"), c, strict=True)) for c in found[3]]}
                    out.append((i, n, *((s, g) if with_code else ()), marks))
            yield pd.DataFrame(out, columns=["id", "name", *more, "found"])

    path = F.coalesce(F.nullif("file_path", F.lit("")), F.regexp_extract("id", "^[^:]*:(.*?)(?:::|$)", 1))
    rows = nodes.where("kind in ('function', 'method') and id is not null and snippet is not null and snippet <> ''").select("id", "name", path.alias("path"), "snippet", "signature")
    return rows.mapInPandas(run, schema)


def _joined(nodes: DataFrame, least_words: int, with_code: bool) -> DataFrame:
    """Functions with their nearest comment c, those rejected left out."""
    f = F.col("found")
    line = f["line"]
    at = lambda c, k: F.struct(c[k].alias("e"), c["form"].alias("form"), c["description"].alias("description"), c["words"].alias("words"))
    above = F.array_max(F.transform(F.filter(f["comments"], lambda c: c["e"] < line), lambda c: at(c, "e")))
    below = F.array_min(F.transform(F.filter(f["comments"], lambda c: c["s"] >= line), lambda c: at(c, "s")))
    near = _extract(nodes, with_code).withColumn("c", F.when(f["forward"], below).otherwise(above))
    parted = F.exists(f["breaks"], lambda b: (b > F.col("c.e")) & (b < line) | (b < F.col("c.e")) & (b > line))
    return near.where(F.col("c").isNotNull() & F.col("c.form") & (F.col("c.words") >= least_words) & ~parted)


def documented_pairs(nodes: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, name, signature, code, description, n_words) for functions and methods whose documentation says something."""
    rows = _joined(nodes, least_words, True).select("id", "name", "signature", "code", F.col("c.description").alias("description"), F.col("c.words").alias("n_words"))
    return rows.withColumn("_h", F.xxhash64("code")).dropDuplicates(["id", "_h"]).drop("_h")


def documented(nodes: DataFrame) -> DataFrame:
    """(id) of functions and methods with documentation that says something."""
    return _joined(nodes, LEAST_WORDS, False).select("id").distinct()
