"""Source files that do not parse: token classes, a bracket stack and per-language rules.

A file is invalid when its lexer meets an unclosed literal or comment, a stray
character or a merge marker outside comments and literals; when the stack of
brackets does not empty; or when a rule of the language finds two operands side
by side, an operator without operand, a missing terminator or header, or a
top-level form the language does not have. Python files that pass get an exact
parse. Rules know syntax only, not names or types.

Defined results: null content and files of other extensions give null (unknown);
an empty file, or one of comments or imports alone, is valid; repeated rows
count once (of different texts under one path an unknown or invalid one counts);
the whole text is read.
"""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.lexers import language_of, lex

_PAIR = {")": "(", "]": "[", "}": "{"}

#: Runs over the class string without newlines (java, csharp, rust) or with them; any match makes the file invalid.
_RULES = {
    "javascript": [
        r"[a0sv\]][a0sv]", r"[FDC]\{\{", r"F\{", r"(?<![=(R,:d?L])C\{", r"P(?:a|f)(?=\n|;|$|\.)", r"P(?![sa{*(.fvu])", r"@@",
        r"[({\[;,]\n*[b=?%]", r"[b=%+\-.]\n*[;)\]}]", r"[-+*/%b=,\[]\n*[RBK]", r"[-+*/%b=]\n*[ID]", r"D(?![afUyv{\[\n])", r"D[af]\n*[(.]",
        r"^\n*[<=b]", r"\((?:a|v):", r"\):\w+\{", r"Da:", r"h(?![afv({\n])", r"(?:^|\n|;)\n*(?:a|v)\n*\{", r"C[af]+\(", r"b\n*b", r"\{\{\n*a\.", r"~\}", r"\n\n*\)R", r"[=(,R]\{\{",
    ],
    "typescript": [
        r"[a0s\]][a0sv]", r"v[0sv]", r"[FDC]\{\{", r"F\{", r"(?<![=(R,:d?L])C\{", r"P(?:a|f)(?=\n|;|$|\.)", r"P(?![sa{*(.fvu])", r"@@",
        r"[({\[;,]\n*[b=?%]", r"[b=%+\-.]\n*[;)\]}]", r"[-+*/%b=,\[]\n*[RBK]", r"[-+*/%b=]\n*[ID]", r"D(?![afUyvC{\[\n])", r"D[af]\n*[(.]",
        r"^\n*[<=b]", r"h(?![afv({\n])", r"(?:^|\n|;)\n*(?:a|v)\n*\{", r"C[af]+\(", r"b\n*b", r"[=(,R]\{\{",
    ],
    "java": [
        r"[0sv][a0svNT]", r"a[0sv]", r"aaa", r"(?<![Co])aa(?![=;(,):\[<{h.]|L)", r"(?<!C)aa[.{]", r"T[0sv{;]", r"(?<=.)TT", r"x", r"C\{", r"@@", r"P(?![aM])", r"P[aM.*]*[^aM.*;]",
        r"[({\[;,][b=?%]", r"[b=%+\-.&|][;)\]}]", r"[-+*/%b=,\[(][RBK]", r"[-+*/%b=][IE]", r"^[<=b]", r"b[b*/%]", r"\{\{", r"E[a0sv]*\((?!.)", r"R[})\]]",
        r"#", r"\)a\{", r"M[(=]", r"I[^({]", r"s\(", r"0\(",
    ],
    "csharp": [
        r"[0sv][a0svNT]", r"a[0sv]", r"aaa", r"(?<![CP])aa(?![=;(,):\[<{?]|L|h)", r"(?<!:)T[0s{;](?<!T;)", r"(?<=.)TT", r"C\{", r"@@", r"I[a0T](?!.)",
        r"[({\[;,][b=?%]", r"[b=%+\-.][;)\]}]", r"[-+*/%b=,\[(][RBK]", r"[-+*/%b=][E]", r"^[<=b]", r"b[b*/%]", r"[=(,RC]\{\{", r"[a\]]\{\{", r"s\(", r"0\(", r"Ia(?:\.a)*(?![;.a=<])",
        r"M[=]",
    ],
    "kotlin": [
        r"[a0sv\]][a0sv]", r"F(?![aTM(<@{])", r"F\{", r"D(?![aM(])", r"C(?![aM\n{:])", r"@@", r"P(?:[aM]\.?)*[^aM.\n*;o]", r"P\n",
        r"[({\[;,]\n*[b=?%]", r"[b=%+\-.]\n*[;)\]}]", r"[-+*/%b=,\[(]\n*[B]", r"[-+*/%b=,\[(]R", r"^\n*[<=b]", r"b\n*[b*/%]", r"[=(,R]\{\{", r"F[^\n{]*\):\n", r":\n*\n[DRIF}]", r"(?:^|\n)C[^\n{]*:(?=\n|$)", r"E:", r"I[^(\n{:]*:(?:\n|$)", r"I(?![({\n])", r"(?:^|\n)[0s]+(?:\n|$)(?!.)",
        r"(?:^|\n)-[RDIF]", r"D\w\n*[(.]", r"D[aM](?=\n|$|\})",
    ],
    "rust": [
        r"[a0sv\])][a0sv]", r"(?<![=:<(,&LU|])F(?![af])", r"F[af]\{", r"D[^;{}]*(?:D)", r"D(?![afU(v&{\[])", r"D[af](?:\.[af])*\((?:[^()]|\([^()]*\))*\)(?![=:])", r"D[af]\.[af][=;]", r"(?<!a)@", r"[({\[;,][b=?%]", r"[b=%+\-][;)\]}]", r"[-+*/%b=,\[(][B]", r"^[<=b]",
        r"b[b/%]", r"[FMD]?\{\{a[.:]", r"P(?![afvs){*.MFUE])", r"-R", r"\)R", r"[a0sv)]E(?<!U)(?=[^.{])",
    ],
    "go": [
        r"a[0]", r"[0sv][a0v]", r"[0v]s", r"s[s]", r"aaa(?!s?\n)", r"@", r"#", r"F\{\{", r"[FYV]\{", r"[({\[;,]\n*[b=?%]", r"[b=%+\-.]\n*[;)\]}]", r"[-+*/%b=,\[(]\n*[B]", r"[-+*/%b=,\[(]R",
        r"^\n*[^\nQ]", r"b\n*[b/%]", r"[=(,R]\{\{", r"P(?![(sa._])", r"Pa?\n", r"\)R", r"[\])}]a*\n*\n:\n",
    ],
}
_COMPILED = {k: [re.compile(r) for r in v] for k, v in _RULES.items()}
#: What may begin a top-level form.
_TOP = {"java": "PMC@;T", "rust": "FCPMUE#ahf;lvs", "go": "QPFVY;", "csharp": None, "kotlin": "PMFCD@af;"}
_GO_GROUP = re.compile(r"[PVY]\([^()]*\)")
_GO_STRUCT = re.compile(r"S\{[^{}]*\}")


#: Words that stand for something else in these places.
_KEY = re.compile(r"(?<=[{,])(\n*)[A-Zvof](?=\n*:)")
_INFIX = re.compile(r"(?<=[a0sv)\]])a(?=[a0sv])")


def _classes(text: str, language: str) -> str:
    """One class a token, with words read by their place: keys, tagged templates, switch as a value, guards, impl ... for."""
    tokens, classes = lex(text, language)
    if language in ("java", "rust") or "`" in text and language in ("javascript", "typescript"):
        prev, out = "", []
        for t, c in zip(tokens, classes, strict=True):
            if c in ("", "\n"):
                out.append(c)
                continue
            if t == "switch" and language == "java" and prev and prev in "=(,RL?:":
                c = "a"
            elif language == "rust" and t in ("for", "if") and prev and prev in "a0sv)]>":
                c = "o"
            elif t[0] == "`" and prev and prev in "a)]" and language != "rust":
                c = ""
            out.append(c)
            prev = c or prev
        classes = out
    c = "".join(classes)
    if language in ("javascript", "typescript"):
        c = _KEY.sub(r"\1a", c)
    elif language == "kotlin":
        c = _INFIX.sub("o", c)
    return c


def _brackets(c: str, lang: str) -> str | None:
    """The bracket stack, and what may stand around a bracket."""
    stack: list[tuple[str, int, str]] = []
    for m in re.finditer(r"[()\[\]{}]", c):
        t, i = m.group(), m.start()
        if t in "([{":
            before = c[i - 1] if i else ""
            stack.append((t, i, before))
            continue
        if not stack or stack[-1][0] != _PAIR[t]:
            return "unbalanced"
        _, at, before = stack.pop()
        after = c[i + 1] if i + 1 < len(c) else ""
        if t == ")" and after in "a0sv" and after:
            if before == "I" or (before in "fao" and at > 1 and c[at - 2] == "I"):
                continue
            inner = c[at + 1 : i]
            if lang in ("java", "csharp"):
                if before in "aMT" and inner == "" and after != "a":
                    return "adjacent"
                cast = inner and re.fullmatch(r"[aTsv.<>,?\[\]&]+", inner) and before not in ("a", ")", "]", "v")
                note = c.rfind("@", max(0, at - 40), at) >= 0 and re.fullmatch(r"@a(?:\.a)*", c[c.rfind("@", 0, at) : at])
                tup = lang == "csharp" and "," in inner
                if not cast and not note and not tup:
                    return "adjacent"
            elif lang in ("javascript", "typescript", "kotlin"):
                if not (before == "@" or (at > 1 and c[at - 2] == "@")):
                    return "adjacent"
            elif lang == "rust":
                if before != "M":
                    return "adjacent"
            elif lang == "go":
                if before not in "Fa)]" or after not in "a":
                    return "adjacent"
        if t == "]" and after in "0s" and after and lang in ("java",):
            return "adjacent"
        if t == "}" and lang in ("java", "csharp"):
            last = c[i - 1] if i else ""
            block = before in (")", "E", "L") or (before == "a" and lang == "java")
            if block and last not in "{};" and before != "L" and not (before == "a" and not re.search(r"[0sv)]$", c[at + 1 : i])):
                return "unterminated statement"
    return "unbalanced" if stack else None


def _heads(c: str, lang: str) -> bool:
    """False if something stands at top level that the language does not have there."""
    allowed = _TOP.get(lang)
    if not allowed:
        return True
    depth, fresh = 0, True
    for m in re.finditer(r"[({\[]|[)}\]]|[^(){}\[\]]+", c):
        t = m.group()
        if t in "({[":
            if depth == 0 and fresh and not (lang == "rust" and t == "["):
                return False
            depth, fresh = depth + 1, False
        elif t in ")}]":
            depth -= 1
            if depth == 0:
                fresh = t == "}" and lang in ("java", "rust")
        elif depth == 0:
            sep = "\n" if lang in ("go", "kotlin") else ";"
            for k, part in enumerate(t.split(sep)):
                head = part.lstrip("\n;")
                if head and (fresh or k) and head[0] not in allowed:
                    return False
                if head and lang == "kotlin" and (fresh or k) and head[0] in "af" and not head.startswith(("a{", "f{")):
                    return False
                if head:
                    fresh = False
            if t.endswith(sep):
                fresh = True
    return True


def why_invalid(text: str, language: str) -> str | None:
    """None if the text is valid in the language, else a short reason."""
    if language == "python":
        return _why_python(text)
    if text.startswith("\ufeff"):
        text = text[1:]
    if text.startswith("#!"):
        text = "//" + text
    c = _classes(text, language)
    if "\0" in c:
        return "lexical"
    if language in ("java", "csharp", "rust"):
        c = c.replace("\n", "")
    why = _brackets(c, language)
    if why:
        return why
    if language == "go":
        c = _GO_GROUP.sub("", c)
        while True:
            d = _GO_STRUCT.sub("a", c)
            if d == c:
                break
            c = d
        if not c.strip("\n"):
            return None
        if re.search(r"(?:\n|[{;])aa(?![:])", c):
            return "adjacent"
    for r in _COMPILED[language]:
        if r.search(c):
            return "rule " + r.pattern
    if not _heads(c, language):
        return "top level"
    return None


def _why_python(text: str) -> str | None:
    tokens, classes = lex(text, "python")
    if "\0" in classes:
        return "lexical"
    stack: list[str] = []
    for t in tokens:
        if t in ("(", "[", "{"):
            stack.append(t)
        elif t in _PAIR and (not stack or stack.pop() != _PAIR[t]):
            return "unbalanced"
    if stack:
        return "unbalanced"
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return type(e).__name__
    return None


def flag_invalid(files: DataFrame, path: str = "rel_path", text: str = "content") -> DataFrame:
    """(rel_path, repository, language, valid, reason) one row a different path, valid null where it cannot be told."""

    def run(batches):
        for b in batches:
            out = []
            for p, t in zip(b["p"], b["t"], strict=True):
                lang = language_of(p)
                if lang is None or not isinstance(t, str):
                    out.append((p, lang, None, None))
                else:
                    why = why_invalid(t, lang)
                    out.append((p, lang, why is None, why))
            yield pd.DataFrame(out, columns=["rel_path", "language", "valid", "reason"])

    rows = files.where(F.col(path).isNotNull()).select(F.col(path).alias("p"), F.col(text).alias("t"))
    judged = rows.mapInPandas(run, "rel_path string, language string, valid boolean, reason string")  # texts stay where they were read
    once = judged.groupBy("rel_path").agg(F.min(F.struct("valid", "language", "reason")).alias("m")).select("rel_path", "m.*")
    return once.withColumn("repository", F.substring_index("rel_path", "/", 1))


def invalid_files(files: DataFrame) -> DataFrame:
    """(rel_path) of files that are not valid in the language of their extension."""
    return flag_invalid(files).where(~F.col("valid")).select("rel_path")


def invalid_rates(files: DataFrame) -> DataFrame:
    """(repository, language, n_files, n_invalid, rate) over the files whose language is known."""
    known = flag_invalid(files).where(F.col("valid").isNotNull())
    return known.groupBy("repository", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid")).withColumn("rate", F.col("n_invalid") / F.col("n_files"))
