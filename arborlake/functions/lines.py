"""Line-oriented text reduction as Column expressions: no shuffle, no UDF.

A text is an array of its lines; every step is a higher-order function over that
array, linear in the lines, so a log of any length stays in its row and its task.
Line breaks are LF and CRLF; one trailing empty line is dropped, as readers do.
Null texts stay null, empty texts have no line.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escape sequences of terminals, and what marks an error line.
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
GENERIC_ERRORS = (r"(?i)\b(error|fatal|fail|failed|failure|panic|exception|traceback|syntaxerror)\b", r'^\s*File\s+".*",\s+line\s+[0-9]+', r"^E\s{3,}.*", r"^>\s{3,}.*")
SPEC_ERRORS = (
    r"(?i)\b(fatal|panic|exception|traceback|syntaxerror)\b", r"(?i)(?:^|:\s*)error:\s*", r"(?i)\berror:\s+", r"(?i)^ERROR\b", r"(?i)\bAssertionError\b", r"(?i)FAILED\s+.*::",
    r'^\s*File\s+".*",\s+line\s+[0-9]+', r"^E\s{3,}.*", r"^>\s{3,}.*",
)
MAX_LINES, HEAD, TAIL = 60, 25, 35


def bind(value: Column, fn) -> Column:
    """fn over the value computed once; without it a higher-order function evaluates its captured arrays for every element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def split_lines(text: Column) -> Column:
    """The lines of a text."""
    cut = bind(F.split(text, "\r?\n"), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def any_of(line: Column, patterns) -> Column:
    """Whether one of the patterns is found in the line."""
    return reduce(lambda a, b: a | b, (line.rlike(p) for p in patterns), F.lit(False))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def truncate_line(line: Column, width: int) -> Column:
    """At most width characters and three dots for the rest."""
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line)


def _blank(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s", " ")) == ""


def collapse_blank(lines: Column) -> Column:
    """Consecutive blank lines become one empty line."""

    def run(ls: Column) -> Column:
        kept = F.filter(ls, lambda x, i: ~(_blank(x) & (i > 0) & _blank(F.get(ls, i - 1))))
        return F.transform(kept, lambda x: F.when(_blank(x), F.lit("")).otherwise(x))

    return bind(lines, run)


def collapse_repeats(lines: Column) -> Column:
    """Runs of one non-blank line become the line with their count."""

    def run(ls: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (F.get(ls, i) != F.get(ls, i - 1)) | _blank(F.get(ls, i)))

        def write(starts: Column) -> Column:
            def one(s: Column, j: Column) -> Column:
                n = F.coalesce(F.get(starts, j + 1), F.size(ls)) - s
                return F.when(n > 1, F.concat(F.get(ls, s), F.lit(" [repeated "), n.cast("string"), F.lit(" times]"))).otherwise(F.get(ls, s))

            return F.transform(starts, one)

        return F.when(F.size(ls) == 0, ls).otherwise(bind(found, write))

    return bind(lines, run)


def head_tail(lines: Column, max_lines: int = MAX_LINES, head: int = HEAD, tail: int = TAIL, errors=GENERIC_ERRORS) -> Column:
    """First and last lines, the number left out, and the error lines of the middle."""

    def run(ls: Column) -> Column:
        n = F.size(ls)
        middle = F.slice(ls, head + 1, F.greatest(n - head - tail, F.lit(0)))
        saved = F.filter(middle, lambda x: any_of(x, errors))
        note = F.array(F.concat(F.lit("... ["), (n - head - tail).cast("string"), F.lit(" lines omitted] ...")))
        last = F.slice(ls, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail))
        return F.when(n > max(max_lines, head + tail), F.concat(F.slice(ls, 1, head), note, saved, last)).otherwise(ls)

    return bind(lines, run)


def generic_filter(text: Column) -> Column:
    """Terminal codes out, blank lines and repeats collapsed, then head and tail with error rescue."""
    return join_lines(head_tail(collapse_repeats(collapse_blank(split_lines(strip_ansi(text))))))


@dataclass
class FilterSpec:
    """A declarative log filter. Keep beats strip and an error line beats both; keep rules without strip rules drop the rest."""

    name: str
    match_command: str = ".*"
    strip: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    replace: list[tuple[str, str]] = field(default_factory=list)
    short_circuit: list[tuple[str, str, str | None]] = field(default_factory=list)
    errors: tuple[str, ...] = SPEC_ERRORS
    max_width: int | None = None
    max_lines: int | None = None
    head: int | None = None
    tail: int | None = None
    on_empty: str = ""

    def compile(self, text: Column) -> Column:
        """The filter as one expression over a text column; replacement groups are written $1."""
        raw = strip_ansi(text)
        body = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), self.replace, raw)
        lines = split_lines(body)
        if self.strip or self.keep:
            error = lambda x: any_of(x, self.errors)
            if self.strip:
                lines = F.filter(lines, lambda x: error(x) | any_of(x, self.keep) | ~any_of(x, self.strip))
            else:
                lines = F.filter(lines, lambda x: error(x) | any_of(x, self.keep))
        if self.max_width:
            lines = F.transform(lines, lambda x: truncate_line(x, self.max_width))
        lines = collapse_repeats(collapse_blank(lines))
        if self.max_lines:
            half = self.max_lines // 2
            lines = head_tail(lines, self.max_lines, self.head or half, self.tail or half, self.errors)
        out = join_lines(lines)
        out = F.when(_blank(out), F.lit(self.on_empty)).otherwise(out)
        for pattern, message, unless in reversed(self.short_circuit):
            hit = raw.rlike(pattern)
            out = F.when(hit & ~raw.rlike(unless) if unless else hit, F.lit(message)).otherwise(out)
        return F.when(_blank(text), F.lit(self.on_empty)).otherwise(out)


#: Our own filter specs, first match by name.
SPECS = [
    FilterSpec("build-log", r"(?:make|cargo|gradle|mvn)\b", strip=[r"^\s*(?:Compiling|Downloading|Checking)\b"], max_width=160, max_lines=80, on_empty="build: nothing to report"),
    FilterSpec("cluster-list", r"kubectl\s+get\b", strip=[r"\s(?:Running|Completed)\s"], max_width=140, max_lines=60, on_empty="pods: all running"),
    FilterSpec("compose", r"docker(?:\s+compose|-compose)\b", strip=[r"\b(?:Pulling|Waiting|Extracting|Download complete)\b"], max_lines=60, on_empty="containers: done"),
    FilterSpec("infra-plan", r"terraform\b", strip=[r"\bRefreshing state\.\.\.", r"\bReading\.\.\."], short_circuit=[(r"No changes\.", "plan: no changes", r"(?i)warning")], max_lines=80),
    FilterSpec("install", r"(?:npm|pnpm|yarn|pip|uv)\s+(?:i|ci|install|add|sync)\b", strip=[r"^\s*(?:Collecting|Downloading|Using cached|npm (?:notice|http))\b", r"^\s*[|/\\-]+\s*$"], max_lines=40, on_empty="install: ok"),
    FilterSpec("lint", r"(?:ruff|eslint|flake8|golangci-lint)\b", strip=[r"^\s*(?:Checking|Scanning)\b"], short_circuit=[(r"All checks passed", "lint: ok", None)], max_lines=80, on_empty="lint: ok"),
    FilterSpec("repo-status", r"git\s+status\b", strip=[r"^\s*\(use \"git", r"^On branch", r"^Your branch is up to date"], replace=[(r"(?m)^\t(?:modified|new file|deleted):\s+", "  ")], short_circuit=[(r"nothing to commit, working tree clean", "status: clean", None)], max_lines=60),
    FilterSpec("changelog", r"changelog\b", keep=[r"^#", r"Fixed:"], max_lines=40, on_empty="no fixes"),
    FilterSpec("service-log", r"(?:journalctl|tail)\b", strip=[r"\b(?:DEBUG|INFO)\b"], replace=[(r"([0-9]{4}-[0-9]{2}-[0-9]{2})T[0-9:]+Z", "$1")], max_width=120, max_lines=60, on_empty="all quiet"),
    FilterSpec("test-run", r"(?:pytest|npm test|go test)\b", strip=[r"^\.+$", r"PASSED"], short_circuit=[(r"0 failed", "tests: ok", r"(?i)error")], max_lines=50),
]


def entropy(s: Column) -> Column:
    """Shannon entropy in bits a character, exact to double rounding; 0 for an empty string."""

    def run(t: Column) -> Column:
        n = F.length(t)
        chars = F.filter(F.array_distinct(F.split(t, "")), lambda c: c != "")
        h = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc + bind((n - F.length(F.replace(t, c, F.lit("")))) / n, _plogp))
        return F.when(n == 0, F.lit(0.0)).otherwise(-h)

    return bind(s, run)


def _plogp(p: Column) -> Column:
    return p * F.log2(p)


def entropy_filter(lines: Column, least: float = 3.0, keep_blank: bool = True, short: int = 10) -> Column:
    """Lines above the entropy; the lenient form keeps blank and short lines."""
    if keep_blank:
        return F.filter(lines, lambda x: (F.length(F.trim(x)) < short) | (entropy(F.trim(x)) >= least))
    return F.filter(lines, lambda x: entropy(F.trim(x)) >= least)
