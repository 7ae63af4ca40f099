"""Credentials embedded in source text and extraction payloads: find and mask them.

Quoted strings and long tokens are extracted with what stands around them (the
name they are assigned to, the header or call they are passed in, the URL or
connection string they lie in); strings joined by + count as one. A token whose
Shannon entropy, measured in the alphabet it is written in, is above a threshold
adjusted to its length is a candidate. Digests, ids, identifiers, placeholders,
variables, public keys and encoded images are excluded. Passwords, which people
choose and which have little entropy, need a place that says so. A mask covers
the inside of literals only, each escape as a whole, and keeps the length, so
the text around it stays well-formed: quotes, prefixes, operators and line ends
are never touched.

Defined results: null and empty texts hold nothing; repeated rows count once;
texts are read whole; a literal cut off at the end of a text counts if what is
left of it qualifies.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in names and headers that announce a secret; the first group people choose, the second is issued.
_CHOSEN = r"pass(?:word|wd|phrase|code)|passwd|pwd"
_ISSUED = r"secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|credentials?|bearer"
_WORD = rf"{_CHOSEN}|{_ISSUED}"
#: Prefixes that public services give their tokens.
_ISSUER = (
    r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeoprs]-[A-Za-z0-9-]{16,}|(?:AKIA|ASIA)[A-Z0-9]{12,}|"
    r"(?:sk|rk|pk)_(?:live|prod)_[A-Za-z0-9]{12,}|sk-[A-Za-z0-9_-]{20,}|AIza[\w-]{30,}|ya29\.[\w-]{20,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|"
    r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"
)
_PEM = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----END)[^\"'`]){16,}(?:-----END [A-Z0-9 ]*-----)?"
_Q = r"\\?[\"'`]"
_STR = r"(?:[rbuf@$]{0,2})" + _Q + r"{1,3}(?P<%s>(?:(?!\\?[\"'`]).)*)" + _Q

_FIND = re.compile(
    "|".join(
        [
            rf"(?P<pem>{_PEM})",
            r"://[^\s:/@\"'`]+:(?P<url>[^\s/@\"'`]+)@",
            r"(?:-u|--user)\s+[^\s:\"'`]+:(?P<curl>[^\s\"'`\\]+)",
            r"\b[Bb]asic\s+(?P<basic>[A-Za-z0-9+/]{8,}={0,2})",
            rf"(?P<issuer>{_ISSUER})",
            r"\b[Bb]earer\s+(?P<bearer>[A-Za-z0-9._~+/-]{16,}=*)",
            rf"(?i:(?:(?P<chosen_name>{_CHOSEN})|(?:{_ISSUED}))(?P<tail>[\w$]*)){_Q}?\]?\s*(?::\s*[\w&<>\[\]?* ]+?)?\s*(?::=|=>|=(?!=)|:)\s*(?P<joined>{_STR % 'v1'}(?:\s*(?:\+|\.\.|&)\s*{_STR % 'v2'})*)",
            rf"{_Q}(?i:[\w-]*?(?:(?P<chosen_arg>{_CHOSEN})|(?:{_ISSUED})|authorization)[\w-]*){_Q}\s*[,:]\s*{_STR % 'arg'}",
            rf"(?i:(?:log_?in|sign_?in|authenticate)\w*)\(\s*{_Q}[^\"'`\\\n]*{_Q}\s*,\s*{_STR % 'login'}",
            rf"(?i:(?<![\w$])(?:(?P<chosen_key>{_CHOSEN})|{_ISSUED}|key|auth|sig))=(?P<pair>[^\s&;,\"'`\\]{{6,}})",
            rf"{_Q}(?P<alone>[A-Za-z0-9+/_=.-]{{24,}}){_Q}",
        ]
    )
)

_PLACEHOLDER = re.compile(
    r"(?i)^(?:(.)\1*|.*(?<![a-z0-9])(?:your(?:s|api|access|auth|secret|password|passwd|token|key|name|here)*|replace(?:d|me|this)?|change(?:d|me|it|this)?|example|placeholder|dummy|insert|redact(?:ed)?|todo|fixme|not[_-]?set|fill[_-]?in|here)\d*(?![a-z0-9]).*|<.*>|.*\$\{.*|.*\{\{.*|\{.*\}|%\w|\$\w+|%\w+%|\[.*\]|"
    r"(?:pass(?:word|wd|phrase)?|secret|token|key|none|null|nil|true|false|undefined|test|user|admin|n/?a|string|xxx+)[:.!?]*)$"
)
_LABEL = re.compile(r"(?i)^_?(?:s)?_?(?:label|name|names|hint|prompt|field|title|help|text|message|msg|path|file|dir|url|uri|type|kind|id|ref|header|param|policy|regex|pattern|length|len|count|env|var|column|placeholder|error|ttl|age|expiry)$")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|blake2[bs]?|crc32)[-:=]|^data:|^urn:")
_WORDS = re.compile(r"^[A-Za-z]+(?:[._/ -][A-Za-z]+)*$")
_PIECE = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")
_CLUSTER = re.compile(r"(?i)[bcdfghjklmnpqrstvwxz]{4}")
#: Share of letters and digits inside pronounceable words from which a token is a name.
NAME_SHARE = 0.6
#: Share of the highest entropy possible for its length and alphabet that a random token reaches; few letters spread less evenly.
ENTROPY_SHARE, HEX_SHARE = 0.78, 0.66


def entropy(s: str) -> float:
    """Shannon entropy in bits a character; 0 for an empty string."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def alphabet(s: str) -> int:
    """Size of the smallest usual alphabet the token is written in."""
    if _HEX.match(s):
        return 16
    if re.fullmatch(r"[A-Z2-7]+=*", s):
        return 32
    return 62 if s.isalnum() else 66


def random_looking(s: str, least: int = 16) -> bool:
    """Entropy above the length-adjusted threshold, and not words in a row."""
    if len(s) < least or _WORDS.match(s) and not re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", s):
        return False
    if not re.search(r"\d", s) and not (re.search(r"[a-z]", s) and re.search(r"[A-Z]", s)):
        return False
    letters = alphabet(s)
    return entropy(s) >= (HEX_SHARE if letters == 16 else ENTROPY_SHARE) * math.log2(min(len(s), letters))


_PHRASE = re.compile(r"(?!(?i:enter|type|please|invalid|wrong|missing|confirm|repeat|the|no)\b)[^\s.!?:;,]+(?: [^\s.!?:;,]+)+$")


def _placeholder(s: str) -> bool:
    """Filled in later; the words in camel case stand apart as well."""
    return bool(_PLACEHOLDER.match(s) or _PLACEHOLDER.match(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", s)))


def _chosen(s: str, name: str = "") -> bool:
    """May be a password or, of several words where the name says so, a passphrase that somebody chose."""
    if " " in s and not ("passphrase" in name.lower() and _PHRASE.match(s) and re.search(r"[^\W_]", s)):
        return False
    return len(s) >= 6 and not _placeholder(s) and not re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", s) and not (s.count("/") > 1)


def _issued(s: str, least: int = 16) -> bool:
    return not _placeholder(s) and not _UUID.match(s) and not _DIGEST.match(s) and s.count("/") <= max(2, len(s) // 10) and random_looking(s, least)


def _name(s: str) -> bool:
    """Mostly words in a row, as identifiers, paths and keys of settings are."""
    words = (w for w in _PIECE.findall(s) if len(w) > 2 and re.search(r"(?i)[aeiouy]", w) and not _CLUSTER.search(w))
    return sum(map(len, words)) >= NAME_SHARE * max(1, sum(map(str.isalnum, s)))


#: What a match of _FIND cannot be without, in lower case: marks, issuers' prefixes, name words. Texts without any and without a long token are not scanned.
_ANCHORS = (
    *("-----begin", "://", " -u", "\t-u", "\n-u", "--user", "basic", "bearer", "authorization", "authenticate", "login", "log_in", "signin", "sign_in", "key=", "auth=", "sig="),
    *("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "akia", "asia", "_live_", "_prod_", "sk-", "aiza", "ya29.", "npm_", "hf_", "sg.", "eyj"),
    *("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential"),
    *(w + j + "key" for w in ("api", "access", "auth", "private", "signing", "encryption") for j in ("", "_", "-")),
)
_LONG = re.compile(r"[\"'`][A-Za-z0-9+/_=.-]{24,}\\?[\"'`]")
#: Long tokens without quotes, and what is assigned without quotes on a line of its own (settings, shell, comments).
_BARE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_NO_BARE_BEFORE, _NO_BARE_AFTER = frozenset(".=$@%:\\\"'`"), frozenset(".=([$\"'`")
_PLAIN = re.compile(
    rf"(?i:(?P<chosen>{_CHOSEN})|(?:{_ISSUED}))(?P<tail>[\w.-]*)[ \t]*[:=][ \t]*(?P<plain>[^\s\"'`;,()\[\]{{}}<>|&\\]{{6,}})(?=[ \t]*(?:[;,\r\n]|$))"
)
#: Names with a digit inside that are no passwords.
_DIGIT_NAME = re.compile(r"(?i)sha\d|md5|utf\d|base\d\d|int\d|x\d\d|oauth\d|bcrypt|argon\d|scrypt|pbkdf\d|hs\d{3}|rs\d{3}|es\d{3}|v\d|i18n|k8s|h2|s3|p12|pkcs\d|x509|ed25519|secp\d")


def _may_hold(text: str, low: str) -> bool:
    """False only where _FIND has no match; letters outside ASCII may fold to others, so such texts are scanned."""
    if not text.isascii() or _LONG.search(text):
        return True
    return any(a in low for a in _ANCHORS)


#: What lies between two elements of one list of strings.
_BETWEEN = re.compile(r"\\?[\"'`](?:[\s,]|\\[nrt]|\\?[\"'`][^\"'`\\\n]*\\?[\"'`])*\\?[\"'`]")


def _no_tables(text: str, alone: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The bare tokens without those that are three or more elements of one array literal: these are data."""
    groups: list[list[tuple[int, int, str]]] = []
    for a in alone:
        if groups and _BETWEEN.fullmatch(text, groups[-1][-1][1], a[0]):
            groups[-1].append(a)
        else:
            groups.append([a])
    in_call = lambda g: text[: g[0][0]].rstrip("\\\"'` \n\t").endswith("(")
    return [a for g in groups if len(g) < 3 or in_call(g) for a in g]


def _spans(text: str | None) -> list[tuple[int, int, str, tuple[tuple[int, int], ...]]]:
    """(start, end, kind, insides of the literals) of every live credential, in order and apart from each other."""
    if not text:
        return []
    out: list = []
    alone: list = []
    low = text.lower()
    if _may_hold(text, low):
        _scan(text, 0, len(text), out, alone)
    _unquoted(text, low, alone)
    alone.sort()
    out += [(*a, ((a[0], a[1]),)) for a in _no_tables(text, [a for a in alone if a[2] == "token"]) + [a for a in alone if a[2] != "token"] if not any(o[0] < a[1] and a[0] < o[1] for o in out)]
    out.sort()
    return [x for k, x in enumerate(out) if k == 0 or x[0] >= out[k - 1][1]]


def find_credentials(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every live credential, in order and apart from each other."""
    return [x[:3] for x in _spans(text)]


def _unquoted(text: str, low: str, alone: list) -> None:
    """Tokens and assigned values that stand without quotes."""
    for m in _BARE.finditer(text):
        v = m.group()
        if text[m.start() - 1 : m.start()] in _NO_BARE_BEFORE or text[m.end() : m.end() + 1] in _NO_BARE_AFTER or not re.search(r"\d", v):
            continue
        if _issued(v, 24) and not _HEX.match(v) and not v.startswith(("0x", "0X")) and not _name(v) and "base64" not in text[max(0, m.start() - 24) : m.start()]:
            alone.append((m.start(), m.end(), "bare"))
    if not any(w in low for w in ("pass", "pwd", "secret", "token", "key", "credential", "bearer")):
        return
    for m in _PLAIN.finditer(text):
        v = m["plain"]
        if m["tail"] and _LABEL.match(m["tail"].replace("-", "_")) or re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+", v):
            continue
        if m["chosen"]:
            ok = _chosen(v) and re.search(r"[A-Za-z]", v) and re.search(r"\d+[^\W\d_]|\d.*[!@#%^*?~+-]|[!@#%^*?~+].*\d", v) and not _DIGIT_NAME.search(v) and not re.fullmatch(r"[A-Za-z$]\w*_\w*", v)
        else:
            ok = _issued(v) and not _name(v)
        if ok:
            alone.append((*m.span("plain"), "plain"))


def _scan(text: str, at: int, end: int, out: list, alone: list) -> None:
    while (m := _FIND.search(text, at, end)) is not None:
        d = m.groupdict()
        at = max(m.end(), m.start() + 1)
        kind = next(k for k in ("pem", "url", "curl", "basic", "issuer", "bearer", "joined", "arg", "login", "pair", "alone") if d[k] is not None)
        s, e = m.span(kind)
        v = d[kind]
        ok, insides = False, ((s, e),)
        if kind == "pem":
            ok = True
        elif kind in ("url", "curl"):
            ok = not _placeholder(v) and not v.startswith("$") and len(v) >= 4
            if kind == "curl":
                ok = ok and text[m.start() - 1 : m.start()].isspace() and "curl" in text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
                at = at if ok else m.start() + 1
        elif kind == "basic":
            try:
                ok = b":" in base64.b64decode(v + "=" * (-len(v) % 4))
            except ValueError:
                ok = False
        elif kind == "issuer":
            ok = entropy(v) > 3.0 and not re.search(r"(?i)example|xxxx|placeholder", v)
        elif kind == "bearer":
            ok = _issued(v)
        elif kind == "joined":
            parts = list(_PART.finditer(v))
            whole = "".join(x["p"] for x in parts)
            insides = tuple((s + x.start("p"), s + x.end("p")) for x in parts)
            s, e = insides[0][0], insides[-1][1]
            if d["tail"] and _LABEL.match(d["tail"]) or any("{" in x["p"] and re.match(r"\w*f|\$", x.group(), re.I) for x in parts):
                ok = False
            elif d["chosen_name"] or re.search(f"(?i){_CHOSEN}", d["tail"] or ""):
                ok = _chosen(whole, (d["chosen_name"] or "") + (d["tail"] or ""))
            else:
                ok = _issued(whole)
            if not ok:
                at = max(m.start("v1"), m.start() + 1)
        elif kind == "arg":
            inner = re.sub(r"^(?i:basic|bearer|token)\s+", "", v)
            ok = _chosen(inner, d["chosen_arg"]) if d["chosen_arg"] else _issued(inner)
            if not ok:
                at = max(s - 1, m.start() + 1)
        elif kind == "login":
            ok = _chosen(v) and bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v))
        elif kind == "pair":
            ok = _chosen(v) if d["chosen_key"] else _issued(v, 12)
        else:
            if _issued(v, 24) and not _HEX.match(v) and not _name(v) and text[max(0, s - 24) : s].find("base64,") < 0:
                alone.append((s, e, "token"))
            at = s
            continue
        if ok:
            out.append((s, e, kind, insides))


_PART = re.compile(_STR % "p")
#: An escape, however often its backslash is doubled, or any character that is neither white space nor a quote.
_COVERED = re.compile(r"\\+(?:u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|[^\s\"'`])|[^\s\"'`\\]")
_KEY_BODY = re.compile(r"(\\+[nrt])|\\+(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[^\s\"'`])|[A-Za-z0-9]")


def mask_credentials(text: str | None) -> str | None:
    """The text with every credential replaced by * of the same length, white space, quotes and all around it kept."""
    if not text:
        return text
    parts, at = [], 0
    for _, _, kind, insides in _spans(text):
        for s, e in insides:
            body = _KEY_BODY.sub(lambda m: m[1] or "*" * len(m[0]), text[s:e]) if kind == "pem" else _COVERED.sub(lambda m: "*" * len(m[0]), text[s:e])
            parts += [text[at:s], body]
            at = e
    return "".join(parts) + text[at:]


def _records(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    a = nodes.select(F.lit("nodes").alias("table_name"), F.col("id").alias("record_key"), F.col("snippet").alias("text"))
    b = cache.select(F.lit("extract_cache").alias("table_name"), F.col("file_path").alias("record_key"), F.col("payload_json").alias("text"))
    return a.unionByName(b).where("record_key is not null and text is not null and text <> ''")


def scan_records(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    """(table_name, record_key, n_found, kinds, masked) one row a different text of a record that holds a credential."""

    def run(batches):
        for b in batches:
            rows = []
            for t, k, x in zip(b["table_name"], b["record_key"], b["text"], strict=True):
                found = find_credentials(x)
                if found:
                    rows.append((t, k, len(found), sorted({f[2] for f in found}), mask_credentials(x)))
            yield pd.DataFrame(rows, columns=["table_name", "record_key", "n_found", "kinds", "masked"])

    schema = "table_name string, record_key string, n_found int, kinds array<string>, masked string"
    return _records(nodes, cache).mapInPandas(run, schema).dropDuplicates(["table_name", "record_key", "masked"])


def credential_records(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    """(table_name, record_key) of records with at least one live credential."""

    def run(batches):
        for b in batches:
            hit = b["text"].map(lambda x: bool(find_credentials(x))).astype(bool)
            yield b.loc[hit, ["table_name", "record_key"]]

    return _records(nodes, cache).mapInPandas(run, "table_name string, record_key string").distinct()
