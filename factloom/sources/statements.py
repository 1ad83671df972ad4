"""Statement trees of functions in C, C++ and Go, and what follows from them: control flow, exits, risks, variables, state, aliases, configuration.

Built from tokens, without types or a preprocessor: both branches of conditional compilation are read, macros are names, and what a name means is
told by the function's own declarations. Facts from here are inferred for that reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|^[ \t]*\#(?:\\\n|[^\n])*)|(?P<s>(?:u8|[uUL])?R"([^()\\\s]{0,16})\([\s\S]*?\)\3"|`[^`]*`|(?:u8|[uUL])?"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?)|(?P<w>[A-Za-z_]\w*)|(?P<n>\.?\d(?:[\w.']|[eEpP][+-])*)|(?P<nl>\n)|(?P<p><<=|>>=|\.\.\.|->|::|:=|\+\+|--|&&|\|\||<<|>>|<=|>=|==|!=|<-|[-+*/%&|^=]=|[^\s\w])""",
    re.M | re.X,
)
_MARK = re.compile(r"\b(TODO|FIXME|XXX|HACK)\b", re.I)

#: Calls by what they do, and their rules where a review should look at them.
TERMINATES = frozenset("exit _exit _Exit abort quick_exit terminate panic Exit Fatal Fatalf Fatalln Goexit".split())
JUMPS = frozenset("longjmp siglongjmp".split())
UNSAFE = frozenset("gets strcpy strcat sprintf vsprintf strtok".split())
SCANS = {"scanf": 0, "sscanf": 1, "fscanf": 1}
COMMANDS = frozenset("system popen execl execlp execle execv execvp execvpe".split())
FORMATS = {"printf": 0, "vprintf": 0, "fprintf": 1, "vfprintf": 1, "dprintf": 1, "sprintf": 1, "vsprintf": 1, "snprintf": 2, "vsnprintf": 2, "syslog": 1}
ALLOCATORS = frozenset("malloc calloc realloc strdup strndup aligned_alloc reallocarray".split())
ASSERTS = frozenset("assert CHECK ASSERT g_assert".split())
_TYPE_WORDS = frozenset("const volatile static extern register unsigned signed int char long short double float void bool size_t auto struct union enum inline constexpr var let".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= :=".split())
_NO_NAME = frozenset("if for while switch return sizeof catch func defer go select case default do else goto break continue throw try new delete true false nil NULL nullptr this range type struct".split()) | _TYPE_WORDS


@dataclass(slots=True)
class Token:
    kind: str  # w word, s text, n number, p mark
    text: str
    line: int


@dataclass(slots=True)
class Statement:
    kind: str
    line: int
    end: int
    head: list[Token] = field(default_factory=list)
    body: list["Statement"] = field(default_factory=list)
    other: list["Statement"] = field(default_factory=list)


def tokens(text: str, lang: str, line: int = 1) -> list[Token]:
    """The tokens of a text; for Go with the semicolons that line ends stand for."""
    out: list[Token] = []
    for m in _TOKEN.finditer(text):
        kind, t = m.lastgroup, m.group()
        if m.group("s") is not None:
            kind = "s"
        if kind in ("nl", "skip"):
            if lang == "go" and out and "\n" in t and (out[-1].kind in "sn" or out[-1].text in (")", "]", "}", "++", "--") or out[-1].kind == "w" and out[-1].text not in ("case", "if", "for", "switch", "func", "else", "range")):
                out.append(Token("p", ";", line))
        else:
            out.append(Token(kind, t, line))
        line += t.count("\n")
    return out


class _Parser:
    def __init__(self, toks: list[Token], lang: str):
        self.t, self.i, self.lang = toks, 0, lang

    def text(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def line(self) -> int:
        return self.t[min(self.i, len(self.t) - 1)].line if self.t else 1

    def group(self, close: str | None = None) -> list[Token]:
        """Tokens up to a closing bracket that matches the one just passed, or up to an end mark outside brackets; the mark is passed."""
        out, depth = [], 0
        while self.i < len(self.t):
            t = self.t[self.i]
            if depth == 0 and (t.text == close or close is None and t.text in (";", "}")):
                if t.text != "}" or close == "}":
                    self.i += 1
                return out
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
            out.append(t)
            self.i += 1
        return out

    def head(self) -> list[Token]:
        """The condition of a statement: in brackets, or in Go up to the block."""
        if self.lang != "go":
            if self.text() in ("constexpr", "consteval"):
                self.i += 1
            if self.text() == "(":
                self.i += 1
                return self.group(")")
            return []
        out, depth = [], 0
        while self.i < len(self.t) and not (depth == 0 and self.text() == "{" and not (out and out[-1].text in ("]", "struct", "interface"))):
            depth += (self.text() in "([") - (self.text() in ")]") if self.text() else 0
            out.append(self.t[self.i])
            self.i += 1
        return out

    def block(self) -> list[Statement]:
        """The statements up to the closing brace, which is passed."""
        out = []
        while self.i < len(self.t) and self.text() != "}":
            out.append(self.statement())
        self.i += 1
        return out

    def part(self) -> list[Statement]:
        if self.text() == "{":
            self.i += 1
            return self.block()
        return [self.statement()] if self.i < len(self.t) and self.text() != "}" else []

    def statement(self) -> Statement:
        line, word = self.line(), self.text()
        s = Statement("expr", line, line)
        if word == "{":
            self.i += 1
            s.kind, s.body = "block", self.block()
        elif word in ("if", "for", "while", "switch", "select", "catch"):
            self.i += 1
            s.kind, s.head, s.body = word, self.head(), self.part()
            if word == "if" and self.text() == "else":
                self.i += 1
                s.other = self.part()
        elif word == "do":
            self.i += 1
            s.kind, s.body = "do", self.part()
            if self.text() == "while":
                self.i += 1
                s.head = self.head()
                self.i += self.text() == ";"
        elif word == "try" and self.text(1) == "{":
            self.i += 2
            s.kind, s.body = "try", self.block()
            while self.text() == "catch":
                s.other.append(self.statement())
        elif word in ("case", "default"):
            self.i += 1
            s.kind, s.head = "case", self.group(":")
        elif word in ("return", "goto", "break", "continue", "throw"):
            self.i += 1
            s.kind, s.head = word, self.group()
        elif self.i + 1 < len(self.t) and self.t[self.i].kind == "w" and self.text(1) == ":" and word not in ("public", "private", "protected"):
            self.i += 2
            s.kind, s.head = "label", [self.t[self.i - 2]]
        else:
            start = self.i
            s.head = self.group()
            if self.i == start:  # a stray closing brace or nothing: always move on
                self.i += 1
        s.end = self.t[min(self.i, len(self.t)) - 1].line if self.t else line
        return s


def parse(body: str, lang: str, line: int) -> list[Statement]:
    """The statements of a function's body, given from after its opening brace."""
    p = _Parser(tokens(body, lang, line), lang)
    try:
        out = []
        while p.i < len(p.t):
            out += p.block()
        return out
    except RecursionError:
        return []


def walk(body: list[Statement], depth: int = 0):
    """(statement, depth) in order of the text."""
    for s in body:
        yield s, depth
        inner = depth + (s.kind in ("if", "for", "while", "do", "switch", "select", "try", "catch"))
        yield from walk(s.body, inner)
        yield from walk(s.other, depth if s.kind == "if" and len(s.other) == 1 and s.other[0].kind == "if" else inner)


def show(toks: list[Token]) -> str:
    return " ".join(t.text for t in toks).replace(" . ", ".").replace(" -> ", "->").replace(" :: ", "::").replace(" ( ", "(").replace(" )", ")").replace(" ,", ",")


def calls(toks: list[Token]):
    """(name, arguments as lists of tokens, line) of the calls among tokens, inner ones too."""
    for k, t in enumerate(toks[:-1]):
        if t.kind == "w" and toks[k + 1].text == "(" and t.text not in _NO_NAME:
            args, depth, cur = [], 0, []
            for x in toks[k + 2 :]:
                if depth == 0 and x.text in (")", ","):
                    if cur or x.text == ",":
                        args.append(cur)
                    cur = []
                    if x.text == ")":
                        break
                    continue
                depth += (x.text in ("(", "[", "{")) - (x.text in (")", "]", "}"))
                cur.append(x)
            yield t.text, args, t.line


# -- what follows ---------------------------------------------------------------------------------------------------------


def metrics(body: list[Statement], first: int, last: int) -> dict:
    """Counts of one function. cyclomatic is 1 and the decisions: if, loops, cases but default, handlers, && and ||, conditional expressions."""
    every = list(walk(body))
    kinds = [s.kind for s, _ in every]
    n = lambda *wanted: sum(k in wanted for k in kinds)
    marks = sum(t.text in ("&&", "||", "?") for s, _ in every for t in s.head)
    handlers = [s for s, _ in every if s.kind == "catch"]
    cases = sum(s.kind == "case" and bool(s.head) for s, _ in every)
    return {
        "branches": n("if", "switch", "select"), "loops": n("for", "while", "do"), "try_blocks": n("try"), "handlers": len(handlers),
        "swallowed": sum(not h.body for h in handlers), "reraises": sum(any(x.kind == "throw" for x, _ in walk(h.body)) for h in handlers),
        "logs": sum(any(c[0].lower() in ("printf", "fprintf", "log", "warn", "error", "syslog", "perror") for x, _ in walk(h.body) for c in calls(x.head)) for h in handlers),
        "raises": n("throw") + sum(c[0] == "panic" for s, _ in every for c in calls(s.head)), "returns": n("return"), "awaits": 0, "yields": 0, "with_blocks": 0,
        "cyclomatic": 1 + n("if", "for", "while", "do", "catch") + cases + marks,
        "max_depth": max((d + (s.kind in ("if", "for", "while", "do", "switch", "select", "try", "catch")) for s, d in every), default=0), "lines": last - first + 1,
    }


def exits(body: list[Statement]) -> list[dict]:
    """Rows (kind, detail, line): terminate, longjmp, throw, errno, and error: a return of NULL, a negative number or a name in capitals that starts with E."""
    out = []
    for s, _ in walk(body):
        if s.kind == "throw":
            out.append({"kind": "throw", "detail": show(s.head), "line": s.line})
        if s.kind == "return" and s.head:
            value = show(s.head)
            if re.fullmatch(r"-\s*\w+|NULL|nullptr|nil|E[A-Z0-9]+", value) or re.search(r"\berr(or)?\b|\b(?:errors\.New|fmt\.Errorf)\b", value):
                out.append({"kind": "error", "detail": value, "line": s.line})
        for name, args, line in calls(s.head):
            if name in TERMINATES:
                out.append({"kind": "terminate", "detail": f"{name}({show(args[0]) if args else ''})", "line": line})
            elif name in JUMPS:
                out.append({"kind": "longjmp", "detail": name, "line": line})
        if len(s.head) > 2 and s.head[0].text == "errno" and s.head[1].text == "=":
            out.append({"kind": "errno", "detail": show(s.head[2:]), "line": s.line})
    return out


def returns(body: list[Statement]) -> list[dict]:
    """Rows (value, constant, line) of the returns; constant: a number, a text or a name in capitals."""
    out = []
    for s, _ in walk(body):
        if s.kind == "return":
            value = show(s.head)
            out.append({"value": value, "constant": bool(re.fullmatch(r"-?\s*[\d.]\w*|\"[^\"]*\"|'[^']*'|[A-Z][A-Z0-9_]*|true|false|nil|nullptr", value)), "line": s.line})
    return out


def _literal_format(arg: list[Token]) -> bool:
    return bool(arg) and (arg[0].kind == "s" or arg[0].text in ("_", "gettext", "ngettext") or len(arg) == 1 and arg[0].text.isupper())


def risks(body: list[Statement], lang: str) -> list[dict]:
    """Rows (rule, level, line, detail): unsafe-libc, command-exec, format-string, unchecked-alloc, fallthrough, swallowed-exception."""
    if lang == "go":
        return []
    out, allocated, conditions = [], {}, []
    add = lambda rule, level, line, detail: out.append({"rule": rule, "level": level, "line": line, "detail": detail})
    for s, _ in walk(body):
        if s.kind in ("if", "while", "for", "do", "switch") or any(t.text == "?" for t in s.head):
            conditions.append({t.text for t in s.head})
        for name, args, line in calls(s.head):
            if name in UNSAFE:
                add("unsafe-libc", "medium", line, name)
            if name in SCANS and len(args) > SCANS[name] and re.search(r"%(?!\*)s", show(args[SCANS[name]])):
                add("unsafe-libc", "medium", line, f"{name} without a width")
            if name in COMMANDS:
                add("command-exec", "high", line, name + (" of a literal" if args and args[0] and args[0][0].kind == "s" else ""))
            if name in FORMATS and len(args) > FORMATS[name] and not _literal_format(args[FORMATS[name]]):
                add("format-string", "medium", line, f"{name}: {show(args[FORMATS[name]])}")
            if name in ASSERTS:
                conditions.append({t.text for a in args for t in a})
        if s.kind == "expr":
            at = next((k for k, t in enumerate(s.head) if t.text == "="), -1)
            if at > 0 and s.head[at - 1].kind == "w" and (c := next((c for c in calls(s.head[at:]) if c[0] in ALLOCATORS), None)):
                allocated.setdefault(s.head[at - 1].text, c[2])
        if s.kind == "catch":
            if not s.body:
                add("swallowed-exception", "medium", s.line, f"catch ({show(s.head)}) is empty")
            elif show(s.head) == "..." and not any(x.kind == "throw" for x, _ in walk(s.body)):
                add("swallowed-exception", "medium", s.line, "catch (...) does not throw again")
        if s.kind == "switch":
            for a, b in zip(s.body, s.body[1:]):
                if b.kind == "case" and a.kind not in ("case", "break", "return", "goto", "continue", "throw") and not (a.kind in ("block", "if") and _leaves(a)) and not any(c[0] in TERMINATES for c in calls(a.head)) and not any(t.text in ("fallthrough", "FALLTHROUGH") for t in a.head):
                    add("fallthrough", "low", b.line, f"into {show(b.head) or 'default'}")
    for name, line in allocated.items():
        if not any(name in c for c in conditions):
            add("unchecked-alloc", "medium", line, name)
    return out


def _leaves(s: Statement) -> bool:
    """Whether control never passes the end of a statement."""
    if s.kind in ("break", "return", "goto", "continue", "throw"):
        return True
    if s.kind == "block":
        return bool(s.body) and _leaves(s.body[-1])
    return s.kind == "if" and bool(s.other) and bool(s.body) and _leaves(s.body[-1]) and _leaves(s.other[-1])


def parameters(head: str, lang: str) -> list[dict]:
    """Rows (position, name, type) of a parameter list as written."""
    toks, out, cur, depth = tokens(head, lang), [], [], 0
    for t in [*toks, Token("p", ",", 0)]:
        if t.text == "," and depth == 0:
            cur = cur[: next((k for k, x in enumerate(cur) if x.text == "="), len(cur))]
            words = [x for x in cur if x.kind == "w"]
            if cur and show(cur) != "void":
                if lang == "go":
                    out.append({"position": len(out), "name": words[0].text if words else "", "type": show(cur[1:])})
                else:
                    named = len(words) > 1 and words[-1].text not in _TYPE_WORDS
                    name = words[-1] if named else None
                    out.append({"position": len(out), "name": name.text if name else "", "type": show([x for x in cur if x is not name])})
            cur = []
            continue
        if t.text != ";":
            depth += (t.text in ("(", "[", "{", "<")) - (t.text in (")", "]", "}", ">"))
            cur.append(t)
    if lang == "go":  # a, b int: the type of the next
        for p, after in zip(reversed(out[:-1]), reversed(out)):
            p["type"] = p["type"] or after["type"]
    return out


def _names(toks: list[Token]) -> list[str]:
    """Names that are read: no calls, fields or types."""
    out = []
    for k, t in enumerate(toks):
        before, after = toks[k - 1].text if k else "", toks[k + 1].text if k + 1 < len(toks) else ""
        if t.kind == "w" and t.text not in _NO_NAME and after not in ("(", "::") and before not in (".", "->", "::"):
            out.append(t.text)
    return list(dict.fromkeys(out))


def _targets(toks: list[Token]):
    """(place as tokens, name declared, mark, value as tokens) of the assignments and declarations in one statement."""
    parts, cur, depth = [], [], 0
    for t in toks:
        if t.text in (",", ";") and depth == 0 and not (t.text == "," and not any(x.text in _ASSIGN for x in cur) and any(x.text == ":=" for x in toks)):
            parts.append(cur)
            cur = []
            continue
        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
        cur.append(t)
    first = True
    declared = False
    for part in [*parts, cur]:
        at, depth = -1, 0
        for k, t in enumerate(part):
            if depth == 0 and t.text in _ASSIGN:
                at = k
                break
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
        left = part[:at] if at >= 0 else part
        words = [x for x in left if x.kind == "w"]
        if first:
            declared = len(words) > 1 and not any(x.text in (".", "->", "(") for x in left) and (len(left) < 2 or left[-1].text != ")")
        first = False
        if at >= 0:
            yield left, declared or part[at].text == ":=", part[at].text, part[at + 1 :]
        elif any(x.text in ("++", "--") for x in part) and words:
            yield [x for x in part if x.text not in ("++", "--")], False, "++", []
        elif declared and words:
            yield left, True, "", []


def variables(body: list[Statement], params: list[dict], line: int) -> list[dict]:
    """Rows (what, name, how, line, to) as those of Python: definitions, uses and flows of a function's variables."""
    out = []
    add = lambda what, name, how, at, to="": out.append({"what": what, "name": name, "how": how, "line": at, "to": to})
    for p in params:
        if p["name"]:
            add("def", p["name"], "param", line, str(p["position"]))
    for s, _ in walk(body):
        if s.kind in ("case", "label", "goto"):
            continue
        for left, declared, mark, value in _targets(s.head) if s.kind in ("expr", "for", "if", "switch") else ():
            words = [x for x in left if x.kind == "w" and x.text not in _NO_NAME]
            if not words or mark == "" and s.kind != "expr":  # a condition
                continue
            plain = not any(x.text in (".", "->", "[", "*") for x in left) or declared
            base = words[-1] if declared else words[0]
            names = [w.text for w in words] if mark == ":=" else [base.text]
            for name in names if plain else ():
                add("def", name, "aug" if len(mark) > 1 and mark != ":=" else "assign" if mark else "declare", base.line)
            for r in _names(value):
                for name in names if plain else [show(left)]:
                    add("flow", r, ("copy" if len(value) == 1 else "derive") if plain else "subscript_store" if left[-1].text == "]" else "attr_store", base.line, name)
        for name, args, at in calls(s.head):
            for k, a in enumerate(args):
                for r in _names(a):
                    add("flow", r, "call_arg", at, f"{name}#{k}")
        if s.kind == "return":
            for r in _names(s.head):
                add("flow", r, "return", s.line)
        for r in _names(s.head):
            add("use", r, "read", s.line)
    return out


def states(body: list[Statement], params: list[dict], rows: list[dict], lang: str) -> list[dict]:
    """Rows (owner, name, access, line): writes beyond the function: globals, statics, what parameters point to, members of this."""
    own = {p["name"] for p in params} | {r["name"] for r in rows if r["what"] == "def" and r["how"] in ("declare",)}
    out = []
    add = lambda owner, name, line: out.append({"owner": owner, "name": name, "access": "write", "line": line})
    local = set(own)
    for s, _ in walk(body):
        if s.kind not in ("expr", "for", "if", "switch"):
            continue
        for left, declared, mark, _value in _targets(s.head):
            words = [x for x in left if x.kind == "w" and x.text not in _NO_NAME]
            if not mark and s.kind != "expr":
                continue
            if declared:
                local |= {w.text for w in words[-1:]} if mark != ":=" else {w.text for w in words}
                if words and s.head[0].text == "static":
                    add("static", words[-1].text, s.line)
                continue
            if any(t.text == "this" for t in left):
                add("this", show([x for x in left if x.text not in ("this", "->")]), s.line)
                continue
            if not words:
                continue
            base, through = words[0].text, any(x.text in ("->", "*", "[") for x in left)
            if base in {p["name"] for p in params}:
                if through or lang == "go" and "." in [x.text for x in left]:
                    add("parameter", show(left), s.line)
            elif base not in local:
                add("global", show(left), s.line)
    return out


def aliases(rows: list[dict], body: list[Statement]) -> list[dict]:
    """Rows (name, target, line): local pointers that are assigned once, the address of something or another pointer."""
    seen: dict[str, list[tuple[str, int]]] = {}
    for s, _ in walk(body):
        if s.kind == "expr":
            for left, declared, mark, value in _targets(s.head):
                words = [x for x in left if x.kind == "w" and x.text not in _NO_NAME]
                if mark and words and (declared or len(left) == 1):
                    seen.setdefault(words[-1].text, []).append((show(value), s.line) if value and (value[0].text == "&" or declared and any(x.text == "*" for x in left) and len(value) == 1) else ("", s.line))
    return [{"name": n, "target": found[0][0].lstrip("& "), "line": found[0][1]} for n, found in seen.items() if len(found) == 1 and found[0][0]]


def config(body: list[Statement]) -> list[dict]:
    """Rows (rule, line, detail): env-read, env-write, cli-option, config-path of getenv, getopt, comparisons with arguments and paths of settings."""
    out = []
    add = lambda rule, line, detail: out.append({"rule": rule, "level": "info", "line": line, "detail": detail.strip('"')})
    for s, _ in walk(body):
        for name, args, line in calls(s.head):
            text = [show(a) for a in args]
            if name in ("getenv", "secure_getenv", "Getenv", "LookupEnv") and text:
                add("env-read", line, text[0])
            elif name in ("setenv", "putenv", "unsetenv", "Setenv") and text:
                add("env-write", line, text[0])
            elif name in ("getopt", "getopt_long") and len(text) > 2:
                for c in re.findall(r"[A-Za-z0-9]", text[2]):
                    add("cli-option", line, f"-{c}")
            elif name in ("strcmp", "strncmp") and len(text) > 1 and any("argv" in x or "arg" == x for x in text):
                for x in text:
                    if x.startswith('"-'):
                        add("cli-option", line, x)
            elif name in ("fopen", "open", "Open", "ReadFile") and text and re.search(r"\.(?:conf|cfg|ini|ya?ml|toml|json|rc)\"$", text[0]):
                add("config-path", line, text[0])
            elif name in ("String", "Int", "Bool", "Duration") and len(text) > 1 and text[0].startswith('"') and any(t.text == "flag" for t in s.head):
                add("cli-option", line, "-" + text[0].strip('"'))
    return out


def blocks(body: list[Statement], first: int) -> list[dict]:
    """The control-flow graph: rows (block, start_line, end_line, to, label); block 0 enters, -1 is the exit, -2 leads nowhere."""
    rows: list[list] = []
    labels: dict[str, int] = {}
    jumps: list[tuple[int, str]] = []

    def new(line: int) -> int:
        rows.append([line, line, []])
        return len(rows) - 1

    def seq(stmts: list[Statement], at: int | None, leave: int | None, again: int | None) -> int | None:
        cur = at
        for s in stmts:
            if s.kind == "label":
                b = new(s.line)
                labels[s.head[0].text] = b
                if cur is not None:
                    rows[cur][2].append((b, ""))
                cur = b
                continue
            if cur is None:
                cur = new(s.line)
            rows[cur][1] = max(rows[cur][1], s.line)
            if s.kind == "block":
                cur = seq(s.body, cur, leave, again)
            elif s.kind == "if":
                after = new(s.end)
                for part, label in ((s.body, "true"), (s.other, "false")):
                    if not part:
                        rows[cur][2].append((after, label))
                        continue
                    b = new(part[0].line)
                    rows[cur][2].append((b, label))
                    end = seq(part, b, leave, again)
                    if end is not None:
                        rows[end][2].append((after, ""))
                cur = after
            elif s.kind in ("for", "while", "do"):
                head, after, b = new(s.line), new(s.end), new(s.body[0].line if s.body else s.line)
                rows[cur][2].append((b if s.kind == "do" else head, ""))
                rows[head][2] += [(b, "loop"), *([(after, "end")] if s.head or s.kind != "for" else [])]
                end = seq(s.body, b, after, head)
                if end is not None:
                    rows[end][2].append((head, "back"))
                cur = after
            elif s.kind in ("switch", "select"):
                after, end, default = new(s.end), None, False
                for part in s.body:
                    if part.kind == "case":
                        b = new(part.line)
                        rows[cur][2].append((b, show(part.head) or "default"))
                        default = default or not part.head
                        if end is not None:
                            rows[end][2].append((b, "falls"))
                        end = b
                    else:
                        end = seq([part], end, after, again)
                if end is not None:
                    rows[end][2].append((after, ""))
                if not default:
                    rows[cur][2].append((after, "none"))
                cur = after
            elif s.kind == "try":
                after, b = new(s.end), new(s.body[0].line if s.body else s.line)
                rows[cur][2].append((b, ""))
                end = seq(s.body, b, leave, again)
                if end is not None:
                    rows[end][2].append((after, ""))
                for h in s.other:
                    e = new(h.line)
                    rows[b][2].append((e, "catch"))
                    end = seq(h.body, e, leave, again)
                    if end is not None:
                        rows[end][2].append((after, ""))
                cur = after
            elif s.kind in ("return", "throw"):
                rows[cur][2].append((-1, s.kind))
                cur = None
            elif s.kind == "goto" and s.head:
                jumps.append((cur, s.head[0].text))
                cur = None
            elif s.kind == "break" and leave is not None or s.kind == "continue" and again is not None:
                rows[cur][2].append((leave if s.kind == "break" else again, s.kind))
                cur = None
            else:
                rows[cur][1] = max(rows[cur][1], s.end)
        return cur

    end = seq(body, new(first), None, None)
    if end is not None:
        rows[end][2].append((-1, "end"))
    for at, name in jumps:
        rows[at][2].append((labels.get(name, -2), "goto"))
    return [{"block": k, "start_line": a, "end_line": b, "to": t, "label": label} for k, (a, b, to) in enumerate(rows) for t, label in (to or [(-2, "none")])]
