"""Sentence boundaries across languages and scripts, by a finite transducer over marks.

Everything local to a mark (the word before it, the next character) is read from
a bounded stretch around it and turned into one input symbol; what is not local
(inside which quotation, how deep in brackets, whether a colon led in) is the
state of a transducer of 16 states compiled into a table. Texts are cut into
chunks behind a word, where no mark and no white space can reach across, so every
chunk has the marks that the whole text has there. Each chunk is a function from
the state at its start to the state at its end. The functions are composed by a
parallel prefix scan: blocks of FAN neighbours become one function, level by
level, and the states come down again from the top; composition is associative,
so no step needs more than one block. Only then each chunk writes its boundaries
from the state it really starts in. A text of one chunk starts in state 0 and is
written where it was read.

Rules: blank lines end a sentence, single line breaks do not, a heading line is
a sentence; nothing inside quotation marks or brackets ends one; a quotation or
bracket that closes after a terminator ends the sentence if a capital, digit or
opening mark follows, or in scripts without case if a colon led in; full stops
after abbreviations, initials, ordinals and inside numbers and names do not; in
Thai a space between two Thai letters does.

Defined results: null, empty and blank texts have no sentence; an unclosed
quotation ends with its paragraph; repeated documents are separate documents,
repeated rows of a doc_id give its sentences once; positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.core import scratch

#: Code points from which a chunk ends behind the next word, what it may look at before and behind it, and functions composed at once.
CHUNK, CONTEXT, AHEAD, FAN = 20_000, 256, 8, 64

#: Abbreviations no sentence ends with before a capital, whatever follows.
_ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof st sr sra srta mme mlle mgr rev hon gen col sgt capt lt jr vs bzw cf approx ca env aprox ggf evtl vgl inkl exkl zzgl sog gem geb usf resp ej ex "
    "hr fr ing dipl др проф им см гр акад тов напр букв сокр ок рис стр ул обл англ डॉ श्री श्रीमती प्रो د أ م ee".split()
)
#: Abbreviations that belong to the number after them.
_BEFORE_NUMBER = frozenset("no nos nr nrn fig figs abb sec sect eq art vol ch chap p pp pag pág págs tab kap bd app ref cap núm num n s z ст гл т п с г рис стр ок approx ca env aprox cca circa st".split())
#: Two-part abbreviations before a capital, and those that may end a sentence.
_OPEN_PAIR = re.compile(r"(?:^|[^\w.])(?:e\.\s?g|i\.\s?e|z\.\s?B|d\.\s?h|u\.\s?a|u\.\s?U|o\.\s?Ä|s\.\s?o|s\.\s?u|i\.\s?d\.\s?R|p\.\s?ex|c\.-à-d|p\.\s?ej|v\.\s?gr|т\.\s?е|т\.\s?к|т\.\s?н|т\.\s?о)$")
_CLOSE_PAIR = re.compile(r"(?:^|[^\w.])(?:a\.\s?m|p\.\s?m|т\.\s?д|т\.\s?п|т\.\s?ч)$", re.I)
#: German words before an ordinal.
_ORDINAL = re.compile(r"(?:^|\W)(?:im|am|der|die|das|dem|den|des|vom|zum|zur|beim|bis|ab|seit|jeder|jedem|jeden|jede|und|ein|eine|einem|einer|ihr|ihrem|sein|seinem|unser|unserem)\s+\d{1,3}$", re.I)

_OPENERS, _CLOSERS = "\"“„«「『(（[¿¡‚‘#*", "\"”“»」』’)）]"
_FULL = "。！？｡।॥۔"
_EVENT = re.compile(r"\n[^\S\n]*\n\s*|\n|[.!?…。！？｡।॥؟۔]+|[\"“”„«»「」『』()（）]|(?<=[ก-ฺเ-๎])[  　  ]+(?=[ก-ฺเ-๎])")
_SPACE = re.compile(r"\s*")
_WORD_END = re.compile(r"(?:^|[^\w./\\@-])[^\W\d_A-Z]{2,}$|\b[A-Z][a-z]{2,}$|[؀-ۿ]{2,}$|\d$|\)$")
_WORD_START = re.compile(r"[\"«„“¿¡(]?(?:[^\W\d_a-z]|[A-Z])[^\W_]*(?!\.?\w|\.\w)")
_LETTER_DOT = re.compile(r"\s?[^\W\d_]\.")
_HEADING = re.compile(r"[^\S\n]*#{1,6}\s")

# states: 0 outside; 1..12 inside quotation kind k (1..6), odd without, even with a colon before; 13..15 in brackets
_QUOTE = {'"': 1, "“": 2, "„": 3, "«": 4, "「": 5, "『": 6}
_STATES = 16


def _kind(ch: str) -> str:
    """l lower case, u anything that may open a sentence in a cased script, x letter without case, '' none."""
    if not ch:
        return ""
    if ch.islower():
        return "l"
    if ch.isupper() or ch.istitle() or ch.isdigit() or not ch.isalpha():
        return "u"
    return "x"


def _next(t: str, j: int) -> tuple[int, str, str]:
    """Position of the next mark or letter, the white space before it, and its kind (looking behind opening marks)."""
    p = _SPACE.match(t, j).end()
    k = p
    while k < len(t) and t[k] in _OPENERS and k - p < 4:
        k += 1
    kind = _kind(t[k : k + 1])
    return p, t[j:p], kind


def _stop(t: str, i: int, j: int, ws: str, kind: str) -> bool:
    """Whether the terminators t[i:j], with no closing mark behind them, end a sentence outside quotations."""
    run = t[i:j]
    if any(c in _FULL for c in run):
        return True
    if "…" in run or (len(run) > 1 and set(run) == {"."}):
        return kind != "l" and (bool(ws) or ("…" not in run and _glued(t, i, j)))
    if kind == "l" or (not ws and not _glued(t, i, j)):
        return False
    if run != ".":
        return True
    m = re.search(r"[\wऀ-ॣ̀-ͯ]+$", t[max(0, i - 40) : i])
    word = m.group() if m else ""
    before = t[max(0, i - 24) : i]
    n = t[j + len(ws) : j + len(ws) + 1]
    low = word.lower()
    if n.isdigit() and (low in _BEFORE_NUMBER or low in _ABBREVIATIONS):
        return False
    if word.isdigit():
        return not (n.isupper() and _ORDINAL.search(before))
    if _CLOSE_PAIR.search(before):
        return True
    if _OPEN_PAIR.search(before):
        return False
    if low in _ABBREVIATIONS or (len(word) == 1 and _LETTER_DOT.match(t, j)):
        return False
    return not (len(word) == 1 and word.isalpha() and (word.isupper() or not word.isascii()) and not n.isdigit())


def _closing(t: str, j: int) -> bool:
    """A mark that closes; the high quotation mark does so only after a low one."""
    if t[j] == "“":
        low = t.rfind("„", max(0, j - CONTEXT + 8), j)
        return low >= 0 and "“" not in t[low + 1 : j]
    return t[j] in _CLOSERS


def _glued(t: str, i: int, j: int) -> bool:
    """A sentence follows without a space: a word, the stop, a capital (or a letter of a script without case), and no dotted name."""
    return bool(_WORD_END.search(t[max(0, i - 40) : i]) and _WORD_START.match(t, j))


def symbols(t: str, lo: int, hi: int, heading: bool = False) -> list[tuple[int, int]]:
    """(symbol, boundary position or -1) of the marks that start in t[lo:hi]; heading: the line t begins in is one.

    Symbols: 0 paragraph end; 1 stop; 2..7 quotation kind opens (+6 after a colon: 8..13);
    14..25 a closing mark of kind k (' " ' and “ also open): see _compile; 26 bracket opens; 27..28 bracket closes.
    """
    out = []
    for m in _EVENT.finditer(t, lo):
        i, j = m.span()
        if i >= hi:
            break
        c = t[i]
        if c == "\n":
            if j - i > 1:
                p = _SPACE.match(t, j).end()
                out.append((0, p if p < len(t) else -1))
            else:
                start = t.rfind("\n", 0, i) + 1
                if (heading if not start and heading is not None else _HEADING.match(t, start, i)) or _HEADING.match(t, j):
                    p = _SPACE.match(t, j).end()
                    out.append((0, p if p < len(t) else -1))
        elif c in "  　  ":
            out.append((1, j))
        elif c in "\"“”„«»「」『』()（）":
            prev = i - 1
            while prev >= 0 and prev > i - 3 and t[prev] in "   ":
                prev -= 1
            while prev >= 0 and i - prev < 5 and t[prev] in _CLOSERS and t[prev] != c:
                prev -= 1
            ended = prev >= 0 and t[prev] in ".!?…。！？｡।॥؟۔"
            k = j
            while k < len(t) and k - j < 4 and _closing(t, k):
                k += 1
            p, ws, kind = _next(t, k)
            after = -1
            verdict = 0  # 0 never, 1 always, 2 only if a colon led in
            if ended and p < len(t) and "\n\n" not in ws:
                if kind == "x" or (kind == "u" and not ws and c in "”」』"):
                    verdict, after = (1 if c in ")）" and kind == "x" else 2), p
                elif kind == "u" and (ws or c in "」』）" or t[p].isupper()):
                    verdict, after = 1, p
            if c in "(（":
                out.append((26, -1))
            elif c in ")）":
                out.append((28 if verdict else 27, after))
            else:
                b = t[max(0, i - 2) : i].rstrip()
                colon = b.endswith((":", "："))
                can_open = j < len(t) and not t[j].isspace() or c in "«"
                out.append((100 + "\"“”„«»「」『』".index(c) * 12 + (6 if colon else 0) + (3 if can_open else 0) + verdict, after))
        else:
            if j < len(t) and _closing(t, j):
                continue  # the closing mark decides
            if j + 1 < len(t) and t[j] in "   " and t[j + 1] == "»":
                continue
            p, ws, kind = _next(t, j)
            if p < len(t) and ws.count("\n") < 2 and _stop(t, i, j, ws, kind):
                out.append((1, p))
    return out


@lru_cache(maxsize=None)
def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The transducer's table: (next state, whether the boundary is written)."""
    if symbol == 0:
        return 0, True
    if symbol == 1:
        return state, state == 0
    if symbol == 26:
        return (13, False) if state == 0 else (min(state + 1, 15), False) if state >= 13 else (state, False)
    if symbol in (27, 28):
        if state == 13:
            return 0, symbol == 28
        return (state - 1 if state > 13 else state), False
    code, rest = divmod(symbol - 100, 12)
    ch = "\"“”„«»「」『』"[code]
    colon, can_open, verdict = rest >= 6, rest % 6 >= 3, rest % 3
    if state >= 13:
        return state, False
    if state == 0:
        if ch in _QUOTE and can_open:
            return 2 * _QUOTE[ch] - (0 if colon else 1), False
        return 0, verdict == 1
    kind, led = (state + 1) // 2, state % 2 == 0
    closes = {'"': (1,), "“": (3,), "”": (2, 3), "»": (4,), "」": (5,), "』": (6,)}.get(ch, ())
    if kind in closes:
        return 0, verdict == 1 or (verdict == 2 and led)
    return state, False


def transition(events: list[tuple[int, int]]) -> list[int]:
    """The state after the events for every state before them."""
    states = list(range(_STATES))
    for s, _ in events:
        states = [_step(x, s)[0] for x in states]
    return states


def write(events: list[tuple[int, int]], state: int) -> list[int]:
    out = []
    for s, p in events:
        state, emit = _step(state, s)
        if emit and p >= 0:
            out.append(p)
    return out


_WORD_LAST = re.compile(r"[^\W_](?![^\W_])")


def pieces(text: str, chunk: int = CHUNK) -> list[tuple[str, int, int, int, bool | None]]:
    """(piece, own_lo, own_hi, base, heading) of every chunk; base: where the piece begins in the text, heading: see symbols, None where the piece begins the text."""
    cuts = [0]
    while len(text) - cuts[-1] > chunk and (m := _WORD_LAST.search(text, cuts[-1] + chunk - 1)) and m.end() < len(text):
        cuts.append(m.end())
    cuts.append(len(text))
    out = []
    line = 0  # start of the line that the piece begins in
    for a, z in zip(cuts, cuts[1:]):
        base = max(0, a - CONTEXT)
        line = max(line, text.rfind("\n", line, base) + 1)
        out.append((text[base : z + AHEAD], a - base, z - base, base, bool(_HEADING.match(text, line)) if base else None))
    return out


def sentence_starts(text: str | None, chunk: int = CHUNK) -> list[int]:
    """Start positions of the sentences of one text, by chunks as the cluster does it."""
    if not text or not text.strip():
        return []
    state, out = 0, {_SPACE.match(text).end()}
    for piece, a, z, base, heading in pieces(text, chunk):
        events = symbols(piece, a, z, heading)
        out.update(p + base for p in write(events, state))
        state = transition(events)[state]
    return sorted(p for p in out if p < len(text))


def _then(first, second):
    """The function that applies first, then second."""
    return F.transform(first, lambda s: F.element_at(second, s + 1))


def scan_states(functions: DataFrame, keys: list[str], last: int, fan: int = FAN) -> DataFrame:
    """(keys, chunk, state): the state each chunk starts in, from (keys, chunk, f) with chunks numbered 0..last at most.

    Up: blocks of fan neighbouring functions are composed to one until a key has
    one block; down: each block hands its chunks their states. No row holds more
    than fan functions.
    """
    identity = F.array(*(F.lit(k) for k in range(_STATES)))
    levels, f = [], functions
    while True:
        block = f.groupBy(*keys, F.floor(F.col("chunk") / fan).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("fs"))
        levels.append(block)
        if last < fan:
            break
        last //= fan
        f = scratch(block.select(*keys, F.col("block").alias("chunk"), F.aggregate("fs", identity, lambda acc, x: _then(acc, x["f"])).alias("f")), "functions")
    states = None
    for block in reversed(levels):
        start = block.withColumn("state", F.lit(0)) if states is None else block.join(states.withColumnRenamed("chunk", "block"), [*keys, "block"])
        run = F.aggregate("fs", F.array("state"), lambda acc, x: F.concat(acc, F.array(F.element_at(x["f"], F.element_at(acc, -1) + 1))))
        pairs = F.arrays_zip(F.transform("fs", lambda x: x["chunk"]).alias("chunk"), F.slice(run, 1, F.size("fs")).alias("state"))
        states = start.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.chunk", "p.state")
    return states


def split_sentences(documents: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(doc_id, sent_start) for every sentence of every document."""
    docs = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")

    def short(batches):
        for b in batches:
            ids, starts = [], []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                s = sentence_starts(t, max(len(t), 1))
                ids += [i] * len(s)
                starts += s
            yield pd.DataFrame({"doc_id": ids, "sent_start": starts}).astype({"doc_id": "int64", "sent_start": "int64"})

    def cut(batches):
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                at = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                first = _SPACE.match(t).end()
                if first < len(t):
                    rows = [(i, at, k, *p, first if k == 0 else -1) for k, p in enumerate(pieces(t, chunk))]
                    yield pd.DataFrame(rows, columns=["doc_id", "of", "chunk", "piece", "own_lo", "own_hi", "base", "heading", "first"])

    def functions(batches):
        for b in batches:
            f = [transition(symbols(p, a, z, h)) for p, a, z, h in zip(b["piece"], b["own_lo"], b["own_hi"], b["heading"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "of": b["of"], "chunk": b["chunk"], "f": f})

    def emit(batches):
        for b in batches:
            ids, starts = [], []
            for i, p, a, z, base, h, first, st in zip(b["doc_id"], b["piece"], b["own_lo"], b["own_hi"], b["base"], b["heading"], b["first"], b["state"], strict=True):
                s = [x + base for x in write(symbols(p, a, z, h), st)] + ([first] if first >= 0 else [])
                ids += [i] * len(s)
                starts += s
            yield pd.DataFrame({"doc_id": ids, "sent_start": starts}).astype({"doc_id": "int64", "sent_start": "int64"})

    out = "doc_id long, sent_start long"
    n = F.length("text")
    small = docs.where(n <= chunk).mapInPandas(short, out)
    cuts = docs.where(n > chunk).mapInPandas(cut, "doc_id long, of long, chunk int, piece string, own_lo int, own_hi int, base int, heading boolean, first int")
    keys = ["doc_id", "of"]
    parts = scratch(cuts.repartition(*keys, "chunk").dropDuplicates([*keys, "chunk"]), "pieces")
    per = scratch(parts.mapInPandas(functions, "doc_id long, of long, chunk int, f array<int>"), "functions")
    last = per.agg(F.max("chunk")).first()[0]
    if last is None:
        return small.dropDuplicates(["doc_id", "sent_start"])
    large = parts.join(scan_states(per, keys, last, fan), [*keys, "chunk"]).mapInPandas(emit, out)
    return small.unionByName(large).dropDuplicates(["doc_id", "sent_start"])


def prose_sentences(documents: DataFrame) -> DataFrame:
    """split_sentences over the kinds article, concept and review."""
    return split_sentences(documents.where("doc_kind in ('article', 'concept', 'review')"))
