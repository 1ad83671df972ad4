"""Source files that do not parse in the language their name states.

Method: a file is cut at line starts into chunks. For every state that a lexer can be in at a line start, a
chunk has a summary: the state at its end, its brackets after cancelling matched pairs, and what its lines
violate. Summaries of neighbouring chunks combine associatively, so chunks of one file may lie in different
partitions. Every file takes this way, and the verdict is the same at every chunk size. Lines are held against
small grammars per language; what a line may be depends on its depth, so a summary counts lines by the depth at
which its run starts. Python is cut between top-level statements, and each chunk goes through the standard parser.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.session import spread
from factloom.sources.tables import latest_files

#: Characters of a chunk, few enough that ordinary files have several.
CHUNK = 1_024

CODE, BLOCK, TRIPLE1, TRIPLE2, RAW, TEXT = "code", "block", "'''", '"""', "raw", "text"

#: The states in which a chunk can start, by family of languages. C++ raw strings, which end at their own marks, and Python statements are never parted.
LINE_STATES = {"c": (CODE, BLOCK), "cpp": (CODE, BLOCK), "go": (CODE, BLOCK, RAW), "python": (CODE,), "elisp": (CODE, TEXT)}

_C = r"""//(?:\\\n|[^\n])*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|"(?:\\[\s\S]|[^"\\\n])*(?:"|(?=\n)|\Z)|(?<![0-9A-Za-z_])(?:u8|[uUL])?'(?:\\[\s\S]|[^'\\\n])*(?:'|(?=\n)|\Z)|[(){}\[\]]"""
#: Tokens that matter to the structure; everything between them is passed over at once.
TOKENS = {
    "c": re.compile(_C),
    "cpp": re.compile(r"""(?:u8|[uUL])?R"([^()\\\s]{0,16})\([\s\S]*?(?:\)\1"|\Z)|""" + _C),
    "go": re.compile(r"""//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|`[^`]*(?:`|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|[(){}\[\]]"""),
    "python": re.compile(
        r"""\#[^\n]*|[A-Za-z]{0,2}(?:\"{3}(?:\\[\s\S]|(?!\"{3})[^\\])*(?:\"{3}|\Z)|'{3}(?:\\[\s\S]|(?!'{3})[^\\])*(?:'{3}|\Z)|"(?:\\[\s\S]|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\[\s\S]|[^'\\\n])*(?:'|(?=\n)|\Z))|[(){}\[\]]"""
    ),
    "elisp": re.compile(r""";[^\n]*|"(?:\\[\s\S]|[^"\\])*(?:"|\Z)|\?\\(?:[CMSHAs]-)*\\?[\s\S]|\?[^\s\w]|\\[\s\S]|[()\[\]]"""),
}
#: How each state ends.
STATE_END = {BLOCK: re.compile(r"\*/"), TRIPLE1: re.compile(r"(?:\\[\s\S]|(?!''')[^\\])*'''"), TRIPLE2: re.compile(r'(?:\\[\s\S]|(?!""")[^\\])*"""'), TEXT: re.compile(r'(?:\\[\s\S]|[^"\\])*"')}
_RAW_END = {"go": re.compile("`"), "cpp": re.compile(r'\)[^()\\\s"]{0,16}"')}

_PAIR = {")": "(", "]": "[", "}": "{"}
_HEAD = re.compile(r"[^\S\n]*[^\s][^\n]*\n?")
_MERGE = re.compile(r"^(?:<{7}|>{7}|\|{7})(?:[ \t][^\n]*)?$|^={7}$", re.M)
#: Words that tools put in place of what they cut off.
_CUT_NOTE = re.compile(r"(?:^|\n)[ \t]*(?:\[[^\]\n]*(?:truncated|limit reached|output limit|omitted|cut off|snip)[^\]\n]*\]|<[^>\n]*(?:truncated|snip)[^>\n]*>|\.\.\.|…|\[\.\.\.\])\s*\Z", re.I)
_CUT_HEAD = re.compile(r"\A\s*(?:\[[^\]\n]*(?:truncated|omitted|cut off|snip)[^\]\n]*\]|\.\.\.|…|\[\.\.\.\])[ \t]*\n", re.I)


@dataclass(slots=True)
class Summary:
    """What a run of lines does to the lexer, from one starting state.

    first: closers and openers of the text without all but the first branches of conditional blocks. good and bad count lines as they
    are below the top level; steps: (depth, more good and more bad lines if the run starts at this depth or less). From depth d the run ends
    at max(d + net, floor). fresh: whether a declaration may follow, None without lines that tell; lead: how many more lines are good
    after a run that isn't fresh. head and tail: the first and last line with code. data and dots: for Python, bare data among the
    statements, and whether the last one is an ellipsis.
    """

    end: str
    closers: str = ""
    openers: str = ""
    flags: frozenset = field(default_factory=frozenset)
    good: int = 0
    bad: int = 0
    first: tuple = ("", "")
    steps: tuple = ()
    net: int = 0
    floor: int = 0
    fresh: bool | None = None
    lead: int = 0
    head: str = ""
    tail: str = ""
    other: int = 0
    data: int = 0
    dots: bool = False

    def then(self, other: Summary) -> Summary:
        """The summary of this run followed by another. Associative."""
        closers, openers, wrong = _cancel((self.closers, self.openers), (other.closers, other.openers))
        closers1, openers1, wrong1 = _cancel(self.first, other.first)
        flags = self.flags | other.flags | ({"mismatch"} if wrong else set()) | ({"mismatch1"} if wrong1 else set())
        late = [*other.steps, (0, other.lead, -other.lead)] if self.fresh is False and other.lead else other.steps
        return Summary(
            other.end,
            closers,
            openers,
            flags,
            self.good + other.good,
            self.bad + other.bad,
            (closers1, openers1),
            _steps([*self.steps, *((t - self.net, g, b) for t, g, b in late if self.floor <= t)]),
            self.net + other.net,
            max(self.floor + other.net, other.floor),
            self.fresh if other.fresh is None else other.fresh,
            other.lead if self.fresh is None else self.lead,
            self.head or other.head,
            other.tail or self.tail,
            self.other + other.other,
            self.data + other.data,
            other.dots if other.good else self.dots,
        )


def _cancel(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str, bool]:
    """The closers and openers of one run and the next, and whether pairs of different kinds met."""
    openers, closers, k = a[1], b[0], min(len(a[1]), len(b[0]))
    wrong = any(o != _PAIR[c] for o, c in zip(reversed(openers), closers))
    return a[0] + closers[k:], openers[: len(openers) - k] + b[1], wrong


def _steps(found: list[tuple[int, int, int]]) -> tuple:
    by: dict[int, tuple[int, int]] = {}
    for t, g, b in found:
        x = by.get(t, (0, 0))
        by[t] = x[0] + g, x[1] + b
    return tuple(sorted((t, *x) for t, x in by.items() if any(x)))


def unify(text: str) -> str:
    """Line ends as LF, without byte-order mark or form feeds, which are no damage in any of the languages."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\f" in text:
        text = text.replace("\f", " ")
    return text.lstrip("﻿")


def scan(text: str, lang: str, state: str = CODE) -> tuple[Summary, str]:
    """The summary of ``text`` from ``state``, and the text with comments and strings blanked."""
    closers, openers, flags, out, pos = [], [], set(), [], 0
    end = CODE
    if state != CODE:
        m = _RAW_END[lang].search(text) if state == RAW else STATE_END[state].search(text) if state == BLOCK else STATE_END[state].match(text)
        if not m:
            return Summary(state), "\n" * text.count("\n")
        out.append("\n" * text.count("\n", 0, m.end()))
        pos = m.end()
    at = pos
    for m in TOKENS[lang].finditer(text, pos):
        t = m.group()
        c = t[0]
        if c in "([{":
            openers.append(c)
            continue
        if c in ")]}":
            if openers:
                if openers.pop() != _PAIR[c]:
                    flags.add("mismatch")
            else:
                closers.append(c)
            continue
        s, e = m.span()
        out.append(text[at:s])
        at = e
        if c == "/" or c == "#" or c == ";":  # a comment
            if t.startswith("/*") and (len(t) < 4 or not t.endswith("*/")):
                end = BLOCK
            out.append(" " if "\n" not in t else "\n" * t.count("\n"))
            continue
        if lang == "elisp":
            if c == '"' and (len(t) < 2 or not _closed(t, '"')):
                end = TEXT
            out.append('"s"' + "\n" * t.count("\n") if c == '"' else "?x" if c == "?" else "x")
            continue
        body = t.lstrip("rRbBuUfFtTL8") if lang != "go" else t
        if lang == "python" and body[:3] in (TRIPLE1, TRIPLE2):
            if len(body) < 6 or not _closed(body, body[:3]):
                end = body[:3]
        elif c == "`":
            if len(t) < 2 or t[-1] != "`":
                end = RAW
        elif lang == "cpp" and m.lastindex:
            if not t.endswith(f"){m.group(1)}\""):
                end = RAW
        elif lang == "cpp" and 'R"' in t[:4] and m.group(1) is not None:
            if not t.endswith(')"'):
                end = RAW
        elif len(body) < 2 or body[-1] != body[0] or not _closed(body, body[0]):
            flags.add("string")
        out.append('"s"' + "\n" * t.count("\n") + " " * (lang == "python" and "\n" in t))  # what follows a text over lines starts no statement
    out.append(text[at:])
    return Summary(end, "".join(closers), "".join(openers), frozenset(flags)), "".join(out)


def _closed(token: str, mark: str) -> bool:
    """Whether the mark at the token's end isn't escaped."""
    body = token[: -len(mark)]
    return token.endswith(mark) and (len(body) - len(body.rstrip("\\"))) % 2 == 0


# -- local grammars -------------------------------------------------------------------------------------------------

_C_LINE = re.compile(r"""^\s*(?:\#.*|.*[;{},\\:>]|.*[(|&+\-*/=?<]|[A-Za-z_~][\w\s*&:<>,\[\]~]*(?:\(.*)?|[)\]].*|"s".*|.*"s"|\.\w.*|\w+\)*)\s*$""")
_C_TOP = re.compile(
    r"""^(?:\#|[};]|extern\b|typedef\b|struct\b|union\b|enum\b|static\b|const\b|template\b|class\b|namespace\b|using\b|inline\b|return\b|[A-Za-z_]\w*(?:::\w+)*(?:\s*<.*>)?[\s*&]+[*&\s]*[~\w][\w:~]*\s*(?:[(\[={;,:]|$|\w)|[A-Z_][A-Z0-9_]*\s*\(|[A-Za-z_~][\w:~]*\s*\(|(?:public|private|protected|default|case\b.*|[A-Za-z_]\w*)\s*:|\[\[)"""
)
_GO_TOP = re.compile(r"^(?:package\s+\w+\s*;?$|import\b|func\b|type\b|var\b|const\b|[)}\]])")
_GO_LINE = re.compile(
    r"""^\s*(?:[)}\]].*|.*[{(,\[&|+\-*/=.:]|package\s+\w+|import\s+.*|(?:return|break|continue|goto|fallthrough)\b.*|(?:var|const|type|func|defer|go|case|default|switch|select|for|if)\b.*|.*(?::=|\+=|-=|\*=|/=|\|=|&=|=|<-).*|.*\)|.*(?:\+\+|--)|[\w.*\[\]]+(?:\s+[\w.*\[\]{}]+)*(?:\s*(?:"s"))?|"s".*|\w+:\s*.*|.*[;}])\s*$"""
)
_EL_TOP = re.compile(r"^[('`#\"\[]")
#: Statements by which other kinds of text show themselves, whatever the brackets.
_OTHER_KIND = re.compile(
    r"""^(?:\#!.*\b(?:sh|bash|zsh)\b|[ \t]*(?:fi|esac|done)[ \t]*$|.*;[ \t]*then[ \t]*$
    |[ \t]*<(?:!doctype|html|head|body|\?xml|!--|div|p|li|table|h[1-6])\b
    |diff[ ]--git[ ]|index[ ][0-9a-f]{7,}\.\.|@@[ ]-\d+
    |[ \t]*(?:create[ ]+(?:table|index|view)|insert[ ]+into|drop[ ]+table|alter[ ]+table|select[ ].*[ ]from)\b
    |\d{4}-\d\d-\d\d[ T]\d\d:\d\d)""",
    re.M | re.I | re.X,
)
_KEYWORD_HEAD = {
    "c": re.compile(r"^(?:def|class\s+\w+.*:\s*$|import\s+\w|from\s+\S+\s+import|package\s|func\s|elif|except|@\w)"),
    "go": re.compile(r"^\s*(?:#include|def\s|class\s|from\s+\S+\s+import|elif\b|except\b|static\s|void\s|struct\s+\w+\s*\{|using\s|namespace\s)"),
    "python": re.compile(r"^\s*(?:#include|func\s|package\s+\w+\s*$|function\s|var\s|const\s|let\s|static\s|void\s|struct\s|using\s|namespace\s)"),
}


class _Lines:
    """Counts lines by whether they are plausible at the top level and below it."""

    def __init__(self):
        self.good = self.bad = self.net = self.floor = 0
        self.steps: list[tuple[int, int, int]] = []

    def add(self, top: bool, below: bool | None) -> None:
        """A line at the current depth; below the top level None doesn't count."""
        good, bad = (0, 0) if below is None else (int(below), int(not below))
        self.good += good
        self.bad += bad
        if self.floor == 0:
            self.steps.append((-self.net, top - good, (not top) - bad))

    def move(self, by: int) -> None:
        self.net += by
        self.floor = max(0, self.floor + by)


def _c_lines(taken: str, s: Summary) -> None:
    """Plausible and implausible lines; top-level lines must begin like a declaration."""
    n, before, lead = _Lines(), None, 0
    for line in taken.split("\n"):
        t = line.strip()
        if t:
            ok = bool(_C_LINE.match(line))
            if t[0] == "#":
                ok = ok and bool(re.match(r"#\s*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line|import|\d|$)", t))
                n.add(ok, ok)
                continue
            top = below = ok
            if ok and n.floor == 0 and (before is None or before[-1:] in ";}") and t != '"s"':
                top = bool(_C_TOP.match(t)) and not _KEYWORD_HEAD["c"].match(t)
                if before is None:
                    lead = ok - top
            if ok and t[-1] not in ";{}),:([\\&|+-*/=?<>\"" and not _C_TOP.match(t):
                below = t.replace("_", "").isalnum()
            n.add(top, below)
            before = t
            n.move(t.count("{") + t.count("(") - t.count("}") - t.count(")"))
    _count(s, n)
    s.fresh, s.lead = None if before is None else before[-1:] in ";}", lead


def _count(s: Summary, n: _Lines) -> None:
    s.good, s.bad, s.steps, s.net, s.floor = n.good, n.bad, _steps(n.steps), n.net, n.floor


def _first_branches(masked: str) -> str:
    """The text without all but the first branch of conditional blocks."""
    if "#" not in masked:
        return masked
    out, stack = [], []
    for line in masked.split("\n"):
        m = re.match(r"[ \t]*#[ \t]*(if\w*|elif\w*|else|endif)(\s+0\s*$)?", line)
        if m:
            word = m.group(1)
            if word.startswith("if"):
                stack.append("skip" if m.group(2) else "take")
            elif word == "endif":
                stack and stack.pop()
            elif stack:
                stack[-1] = "skip" if stack[-1] in ("take", "done") else "take"
        out.append("" if "skip" in stack else line)
    return "\n".join(out)


def _go_lines(masked: str, s: Summary) -> None:
    n = _Lines()
    for line in masked.split("\n"):
        t = line.strip()
        if t:
            other = bool(_KEYWORD_HEAD["go"].match(t))
            n.add(not other and bool(_GO_TOP.match(t)), not other and bool(_GO_LINE.match(t)))
            n.move(t.count("{") + t.count("(") - t.count("}") - t.count(")"))
    _count(s, n)


def _el_lines(masked: str, s: Summary) -> None:
    """Only top-level lines count."""
    n = _Lines()
    for line in masked.split("\n"):
        t = line.strip()
        if t:
            if n.floor == 0:
                ok = bool(_EL_TOP.match(t)) and not t.startswith(("#include", "#!", "#define", "[{", "['")) and not ('"s":' in t or t.endswith(("{", ";", "},")))
                n.add(ok, None)
            n.move(t.count("(") + t.count("[") - t.count(")") - t.count("]"))
    _count(s, n)


_NESTED = re.compile(r"""[fF][rR]?["'][^"'\n]*\{[^}"'\n]*["']|[fF][rR]?(?:\"{3}|'{3})""")
_PY_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]")


def statement_starts(text: str) -> list[int]:
    """Where the top-level statements of a whole Python text start; none where f-strings hold quotes like their own, which the lexer doesn't follow."""
    if _NESTED.search(text) and any(t[0] in "fFrR" and "f" in t[:2].lower() and t.count("{") != t.count("}") for t in (m.group() for m in TOKENS["python"].finditer(text))):
        return []
    lines, blank = text.split("\n"), scan(text, "python")[1].split("\n")
    out, depth, decorated, continued, at = [], 0, False, False, 0
    for line, b in zip(lines, blank):
        if depth <= 0 and not continued and b[:1].strip() and not _PY_GOES_ON.match(b):
            if not decorated:
                out.append(at)
            decorated = b[0] == "@"
        if b:
            depth = max(0, depth + b.count("(") + b.count("[") + b.count("{") - b.count(")") - b.count("]") - b.count("}"))
        continued = b.endswith("\\")
        at += len(line) + 1
    return out


def judge(text: str, lang: str, size: int = CHUNK) -> str:
    """What keeps a whole text from being source of ``lang``: merge, kind, statement, unbalanced, cut or string; '' if nothing does."""
    pieces = cut(unify(text), lang, size)
    return verdict(reduce(compose, (state_map(x, lang, k == 0, k == len(pieces) - 1) for k, x in enumerate(pieces)))[CODE], lang)


def summarize(text: str, lang: str, state: str) -> Summary:
    """The summary of a chunk from one state, its lines held against the local grammar."""
    marked = any(mark in text for mark in ("<<<<<<<", ">>>>>>>", "=======", "|||||||"))
    s, masked = scan(text, lang, state) if marked or lang != "python" else (Summary(CODE), "")
    flags = {"merge"} if marked and _MERGE.search(masked) else set()
    if lang == "python":  # open strings and brackets are bad statements already
        s = Summary(CODE, flags=frozenset(flags))
        _py_statements(text, s)
        return s
    s.flags |= flags
    s.other = len(_OTHER_KIND.findall(masked))
    whole = masked.strip()
    if not whole:
        return s
    s.head = _HEAD.search(masked).group()
    s.tail = masked[masked.rfind("\n", 0, masked.rindex(whole[-1])) + 1 :].rstrip()
    if lang == "go":
        _go_lines(masked, s)
    elif lang == "elisp":
        _el_lines(masked, s)
    else:
        taken = _first_branches(masked)
        _c_lines(taken, s)
        again = s if taken == masked else scan(taken, lang)[0]
        s.first = again.closers, again.openers
        s.flags |= {"mismatch1"} if "mismatch" in again.flags else set()
    return s


def _py_statements(text: str, s: Summary) -> None:
    """The statements of a chunk that consists of whole ones, and what they are."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(text).body
    except (SyntaxError, ValueError):
        s.bad = 1
        return
    except (RecursionError, MemoryError):
        s.flags |= {"deep"}
        return
    data = (ast.Dict, ast.List, ast.Name, ast.Tuple, ast.Compare, ast.BinOp, ast.Set)
    s.good = len(body)
    s.data = sum(isinstance(x, (ast.Expr, ast.AnnAssign)) and (isinstance(x, ast.AnnAssign) and x.value is None or isinstance(getattr(x, "value", None), data)) for x in body)
    s.dots = bool(body) and isinstance(body[-1], ast.Expr) and isinstance(body[-1].value, ast.Constant) and body[-1].value.value is Ellipsis


def verdict(s: Summary, lang: str) -> str:
    """The defect that a whole file's summary shows; '' for none."""
    if "merge" in s.flags:
        return "merge"
    if lang == "python":
        if "deep" in s.flags or not s.bad + s.good:
            return ""
        return "statement" if s.bad else "kind" if s.data == s.good else "cut" if s.good > 1 and s.dots else ""  # only bare data, as in JSON or prose
    good, bad = s.good + sum(g for _, g, _ in s.steps), s.bad + sum(b for _, _, b in s.steps)
    if lang == "go" and s.head and not re.match(r"package\s+\w+\s*$", re.search(r"\S[^\n;]*", s.head).group()):
        return "kind"
    if s.other and s.other >= 0.2 * (good + bad):
        bad, good = max(bad, s.other), 0
    if bad and bad >= LEAST_BAD * (good + bad):
        return "kind"
    wrong = s.closers or s.openers or "mismatch" in s.flags
    if wrong and lang in ("c", "cpp"):
        wrong = any(s.first) or "mismatch1" in s.flags
    if wrong or s.end != CODE:
        return "unbalanced"
    if _CUT_NOTE.search(s.tail) or _CUT_HEAD.search(s.head):
        return "cut"
    if s.tail and lang == "go" and not re.search(r"[\w)}\]\"]$|\+\+$|--$", s.tail):
        return "cut"
    if s.tail and lang in ("c", "cpp") and s.tail[-1] not in ";})" and not s.tail.lstrip().startswith("#"):
        return "cut"
    return "string" if "string" in s.flags else ""


#: Share of implausible lines from which a text is of another kind.
LEAST_BAD = 0.2


# -- chunks of one file, and the operator over tables --------------------------------------------------------------


_DIRECTIVE = re.compile(r"(?m)^[ \t]*#[ \t]*(if|elif|else|endif)\w*([ \t]+0[ \t]*$)?[^\n]*\n?")


def _branched(text: str) -> list[tuple[int, int]]:
    """The spans of conditional blocks of which only the first branch counts."""
    spans, stack = [], []
    for m in _DIRECTIVE.finditer(text):
        word = m.group(1)
        if word == "if":
            stack.append([m.start(), bool(m.group(2))])
        elif stack and word == "endif":
            at, alternative = stack.pop()
            if alternative:
                spans.append((at, m.end()))
        elif stack:
            stack[-1][1] = True
    return spans + [(at, len(text)) for at, alternative in stack if alternative]


def cut(text: str, lang: str, size: int = CHUNK) -> list[str]:
    """The text in pieces of about ``size`` characters, each but the first starting at a line that none continues with a
    backslash, in Python at a top-level statement, in C and C++ never within raw strings or between the branches of a conditional block."""
    out, at = [], 0
    if len(text) <= size:
        return [text]
    if lang == "python":
        ends = statement_starts(text)
    else:
        ends = [m.end() for m in re.finditer(r"(?<!\\)\n", text)]
    held = _branched(text) if lang in ("c", "cpp") and "#" in text else []
    if lang == "cpp" and 'R"' in text:
        held += [m.span() for m in TOKENS[lang].finditer(text) if 'R"' in m.group()[:4] and m.group(1) is not None]
    spans = iter(sorted(held))
    span, reach = next(spans, None), 0
    for end in ends:
        while span and span[0] < end:
            reach = max(reach, span[1])
            span = next(spans, None)
        if end - at >= size and end >= reach and end < len(text):
            out.append(text[at:end])
            at = end
    return [*out, text[at:]]


def state_map(chunk: str, lang: str, first: bool, last: bool) -> dict[str, Summary]:
    """A summary for every state in which the chunk may start; the first chunk starts in code."""
    return {s: summarize(chunk, lang, s) for s in ((CODE,) if first else LINE_STATES[lang])}


def compose(a: dict[str, Summary], b: dict[str, Summary]) -> dict[str, Summary]:
    """The map of two neighbouring runs. Associative."""
    return {s: x.then(b[x.end]) for s, x in a.items()}


def _chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    names = ["file_id", "lang", "seq", "last", "chunk"]
    for batch in batches:
        rows = []
        for i, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            pieces = cut(unify(text), lang, size)
            rows += [(i, lang, k, k == len(pieces) - 1, x) for k, x in enumerate(pieces)]
        columns = zip(*rows) if rows else [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()))], names=names)


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    for batch in batches:
        ids, langs, seqs, lasts, chunks = (batch.column(i).to_pylist() for i in range(5))
        maps = [pickle.dumps(state_map(c, lang, k == 0, z)) for lang, k, z, c in zip(langs, seqs, lasts, chunks)]
        yield pa.record_batch([pa.array(ids, pa.string()), pa.array(langs, pa.string()), pa.array(seqs, pa.int32()), pa.array(maps, pa.binary())], names=["file_id", "lang", "seq", "map"])


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    for batch in batches:
        ids, langs, maps = (batch.column(i).to_pylist() for i in range(3))
        found = [verdict(reduce(compose, map(pickle.loads, (m["map"] for m in ms)))[CODE], lang) for ms, lang in zip(maps, langs)]
        yield pa.record_batch([pa.array(ids, pa.string()), pa.array(found, pa.string())], names=["file_id", "defect"])


def defects(files: DataFrame, texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(file_id, project_id, path, language, defect) of every file whose name states one of the languages and that has a text.

    defect is null for valid source, else merge (an unfinished merge outside strings and comments), kind (text of
    another kind), statement (Python that does not parse), unbalanced, cut or string (a literal that doesn't end). The
    latest scan gives the path; analysis_status is not looked at. Null contents and files without a row of texts give
    no row, nor have Org texts, of which only parts are Emacs Lisp; empty and blank texts are valid. Repeated texts of one file_id: the greatest counts. Texts are
    judged in chunks of about ``chunk`` characters that spread over the cluster; what comes back to one task for a file is a small summary per chunk.
    """
    f = latest_files(files).where(F.col("stated").isNotNull() & ~F.lower("path").endswith(".org")).select("file_id", "project_id", "path", F.col("stated").alias("language"))
    t = texts.where(F.col("file_id").isNotNull() & F.col("content").isNotNull()).select("file_id", "content")
    both = spread(f, "file_id").join(spread(t, "file_id"), "file_id").select("file_id", "language", "content")
    pieces = both.mapInArrow(lambda b: _chunked(b, chunk), "file_id string, lang string, seq int, last boolean, chunk string")
    maps = pieces.repartition("file_id", "seq").mapInArrow(_mapped, "file_id string, lang string, seq int, map binary")
    whole = maps.groupBy("file_id", "lang").agg(F.array_sort(F.collect_list(F.struct("seq", "map"))).alias("maps"))
    found = whole.select("file_id", "lang", "maps").mapInArrow(_reduced, "file_id string, defect string").groupBy("file_id").agg(F.max("defect").alias("defect"))
    return f.join(found, "file_id").select("file_id", "project_id", "path", "language", F.when(F.col("defect") != "", F.col("defect")).alias("defect"))


def broken(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id): the files with a defect, each once."""
    return defects(files, texts).where(F.col("defect").isNotNull()).select("file_id")


def rates(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(project_id, language, n_files, n_broken, share): per project and language; files without text are not counted."""
    return (
        defects(files, texts)
        .groupBy("project_id", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("defect").alias("n_broken"))
        .withColumn("share", F.col("n_broken") / F.col("n_files"))
    )
