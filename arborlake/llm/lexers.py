"""Lexers of eight languages that turn a file into a string of token classes.

A file becomes one character a token, so that layout, uniformity and grammar
rules are regular expressions and one bracket stack over a short string. All
regular expressions are linear in the text; no file is cut.

Classes: a name, 0 number, s string, v value word, newline, punctuation as
itself, b binary operator, p ++ or --, u ... , L arrow, \\x00 a token that
cannot be (unclosed literal or comment, merge marker, stray character), and the
keyword letters of KEYWORDS.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: File extension to language.
EXTENSIONS = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "java": "java",
    "kt": "kotlin",
    "rs": "rust",
    "go": "go",
    "cs": "csharp",
}

#: Keyword letters by language. F function, C type declaration, D variable, I head with parentheses,
#: E head without, R takes an expression and ends a statement, U prefix word, P import, M modifier, h header word,
#: o infix word, K label word, B bare statement, T built-in type, f word with a meaning only in places.
KEYWORDS = {
    "javascript": {
        "F": "function", "C": "class", "D": "var let const", "I": "if for while switch with catch", "E": "else do try finally",
        "R": "return throw", "U": "typeof void delete new await yield", "P": "import", "M": "export", "h": "extends",
        "o": "in instanceof", "K": "case default", "B": "break continue debugger", "v": "this null true false super",
        "f": "of from as async get set static",
    },
    "typescript": {
        "F": "function", "C": "class interface enum", "D": "var let const", "I": "if for while switch with catch", "E": "else do try finally",
        "R": "return throw", "U": "typeof void delete new await yield keyof infer unique", "P": "import", "M": "export", "h": "extends implements",
        "o": "in instanceof is", "K": "case default", "B": "break continue debugger", "v": "this null true false super",
        "f": "of from as async get set static type namespace module declare abstract readonly public private protected override asserts satisfies global accessor",
    },
    "java": {
        "C": "class interface enum record", "I": "if for while switch catch synchronized", "E": "else do try finally", "R": "return throw assert yield",
        "U": "new", "P": "import package", "M": "public private protected static final abstract native transient volatile strictfp default sealed",
        "h": "extends implements throws permits", "o": "instanceof", "K": "case", "B": "break continue", "v": "this null true false super",
        "T": "int long short byte char boolean float double void var", "x": "const goto",
    },
    "csharp": {
        "C": "class interface enum struct record", "I": "if for foreach while switch catch lock fixed using", "E": "else do try finally unsafe checked unchecked",
        "R": "return throw", "U": "new await ref out in params typeof nameof sizeof stackalloc", "P": "namespace",
        "M": "public private protected internal static readonly abstract sealed virtual override async partial const extern volatile event delegate implicit explicit operator required file",
        "h": "where", "o": "is as", "K": "case default", "B": "break continue", "v": "this null true false base",
        "T": "int long short byte char bool float double decimal void var string object dynamic uint ulong ushort sbyte", "f": "get set init add remove value when yield when global not and or with from select group orderby join let on equals by into ascending descending",
    },
    "kotlin": {
        "F": "fun", "C": "class interface object typealias", "D": "val var", "I": "if for while when catch", "E": "else do try finally",
        "R": "return throw", "P": "import package", "M": "public private protected internal open abstract final override data sealed enum annotation inner companion lateinit const inline suspend operator infix tailrec external vararg noinline crossinline reified expect actual by get set where init constructor out value",
        "o": "in is as to until downTo step shl shr ushr and or xor zip", "B": "break continue", "v": "this null true false super",
    },
    "rust": {
        "F": "fn", "C": "struct enum trait union mod", "D": "let", "E": "if while for match loop else unsafe async move", "R": "return",
        "U": "mut ref dyn impl box await", "P": "use extern crate", "M": "pub const static type", "h": "where", "o": "in as",
        "B": "break continue", "v": "self true false super", "f": "macro_rules",
    },
    "go": {
        "F": "func", "S": "struct interface", "V": "var const", "Y": "type", "E": "if for switch select else", "R": "return go defer goto",
        "U": "range map chan", "P": "import", "Q": "package", "K": "case default", "B": "break continue fallthrough", "v": "nil true false iota",
    },
    "python": {},
}

_NAME = r"[^\W\d][\w$]*"
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?!\.)(?:\d[\d_]*)?(?![^\W\d_]))?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?:[a-zA-Z]\w*)?"
_MARK = r"(?m:^(?:<{7}|>{7}|={7}|\|{7})(?![<>=|]).*)"
_LINE = r"//[^\n]*"
_BLOCK = r"/\*(?s:.*?)\*/"
_NESTED = r"/\*(?>[^*/]++|\*(?!/)|/(?!\*)|/\*(?>(?s:.*?)\*/))*+\*/"
_DQ = r'"(?:\\.|[^"\\\n])*"'
_SQ = r"'(?:\\.|[^'\\\n])*'"
_CHAR = r"'(?:\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\u\{[0-9a-fA-F]+\}|\\.|[^'\\\n])'"
_TICK = r"`(?>\\(?s:.)|[^`\\$]++|\$(?!\{))*+`"
for _ in range(3):  # templates inside the expressions of templates
    _TICK = r"`(?>\\(?s:.)|[^`\\$]++|\$(?!\{)|\$\{(?>[^`{}\"']++|\{[^{}`]*+\}|" + _DQ + "|" + _SQ + "|" + _TICK + r")*+\})*+`"
_REGEX = r"(?:(?<=[=(,:!&|?;{])|(?<=[=(,:!&|?;{] )|(?<=return ))/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_OPS = r"\.\.\.|=>|->|:=|\+\+|--|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|[-+*/%&|^]=|===|!==|==|!=|<=|&&|\|\||\?\?|\?\.|::|\.\.=|\.\.|<-|\*\*"

_TEXT = {
    "javascript": [_LINE, _BLOCK, _REGEX, _DQ, _SQ, _TICK, r"\#" + _NAME],
    "typescript": [_LINE, _BLOCK, _REGEX, _DQ, _SQ, _TICK, r"\#" + _NAME],
    "java": [_LINE, _BLOCK, r'"""(?s:.*?)"""', _DQ, _CHAR],
    "csharp": [_LINE, _BLOCK, r"(?m:^[ \t]*\#[ \t]*(?:region|endregion|if|else|elif|endif|define|undef|pragma|nullable|error|warning|line)\b.*)", r'\$*"""(?s:.*?)"""', r'(?:\$@|@\$|@)"(?:""|[^"])*"', r'\$"(?:\\.|\{\{|\{[^{}"\n]*(?:"[^"\n]*"[^{}"\n]*)*\}|[^"\\\n{])*"', _DQ, _CHAR],
    "kotlin": [_LINE, _NESTED, r'"""(?s:.*?)"""', r'"(?:\\.|\$\{[^{}"\n]*(?:"[^"\n]*"[^{}"\n]*)*\}|[^"\\\n])*"', _CHAR, r"`[^`\n]+`"],
    "rust": [_LINE, _NESTED, r'b?r(\#*)"(?s:.*?)"\1', r'b?"(?:\\(?s:.)|[^"\\])*"', "b?" + _CHAR, r"'[^\W\d]\w*"],
    "go": [_LINE, _BLOCK, _DQ, r"`[^`]*`", _CHAR],
    "python": [r"\#[^\n]*", r'[rRbBuUfF]{0,2}(?:"""(?:\\(?s:.)|[^\\])*?"""|' + r"'''(?:\\(?s:.)|[^\\])*?'''|" + r'"(?:\\(?s:.)|[^"\\\n])*"|' + r"'(?:\\(?s:.)|[^'\\\n])*')"],
}
_SYMBOL = {"...": "u", "=>": "L", "->": "L", ":=": "=", "++": "p", "--": "p", "::": ".", "?.": ".", "..": "u", "..=": "u", "<-": "b", "/*": "\0", '"': "\0", "'": "\0", "`": "\0", "\\": "\0"}


class _Classes(dict):
    """Token to class; names and literals are remembered up to a bound."""

    def __init__(self, language: str):
        super().__init__({w: k for k, ws in KEYWORDS[language].items() for w in ws.split()})
        self.update(_SYMBOL)
        self["\n"] = "\n"
        for op in ("&&", "||", "<<=", ">>=", "==", "!=", "<=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "&&=", "||=", "??=", "===", "!==", "??", "**"):
            self[op] = "b"
        self.language, self.base = language, len(self)

    def __missing__(self, t: str) -> str:
        c, lang = t[0], self.language
        if c == "/" and t[1:2] in ("/", "*"):
            return "\n" if "\n" in t else ""
        if c == "#" and lang == "python":
            return ""
        if c == "#" and lang == "csharp" or (c in " \t" and t.lstrip()[:1] == "#"):
            return ""
        if len(t) >= 7 and c in "<>=|":
            k = "\0"
        elif len(t) > 1 and t[-1] in "\"'`#" and (c in "\"'`$@" or t[-1] != "#" or c in "br"):
            return "a" if lang == "kotlin" and c == "`" else "s"
        elif c == "'":
            k = "l"
        elif c == "/" and len(t) > 1:
            return "s"
        elif c.isdigit() or (c == "." and len(t) > 1):
            k = "0"
        elif c.isalpha() or c in "_$" or (c == "#" and len(t) > 1):
            k = "a"
        elif len(t) == 1 and c in "()[]{}<>;,.:?!=+-*/%&|^~@#":
            k = c
        else:
            return "\0"
        if len(self) > 200_000:
            for key in list(self)[self.base :]:
                del self[key]
        self[t] = k
        return k


@lru_cache(maxsize=None)
def _machine(language: str):
    pattern = "|".join([_MARK, *_TEXT[language], _NUMBER, r"\$?" + _NAME, _OPS, r"/\*", r"[^\s]", r"\n"])
    if language == "rust":  # one group there, so findall would give the group
        compiled = re.compile(pattern)
        return (lambda text: [m.group() for m in compiled.finditer(text)]), _Classes(language)
    return re.compile(pattern).findall, _Classes(language)


def language_of(path: str | None) -> str | None:
    """The language by the path's extension, or None."""
    return EXTENSIONS.get(path.rpartition(".")[2].lower()) if path and "." in path else None


def lex(text: str, language: str) -> tuple[list[str], list[str]]:
    """Tokens with comments and newlines, and the class of each ('' for a comment)."""
    find, classes = _machine(language)
    tokens = find(text)
    return tokens, list(map(classes.__getitem__, tokens))
