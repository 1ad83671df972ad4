"""Emacs Lisp read as nested lists, and what follows from definitions: control flow, signals and handlers, variables, state, risks and a flow graph."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_PART = re.compile(r"""(?P<skip>[\s\f]+|;[^\n]*)|(?P<s>"(?:\\[\s\S]|[^"\\])*"?)|(?P<q>\#?'|`|,@?)|(?P<o>[(\[]|\#s\()|(?P<c>[)\]])|(?P<a>\?\\?(?:\S)(?:[-^]\S)*|(?:\\[\s\S]|[^\s()\[\]"';`,])+|[\s\S])""", re.X)


@dataclass(slots=True)
class Atom:
    kind: str  # symbol, string or number
    text: str
    line: int
    quoted: bool = False


@dataclass(slots=True)
class Form:
    items: list = field(default_factory=list)
    line: int = 1
    end: int = 1
    quoted: bool = False

    @property
    def head(self) -> str:
        return self.items[0].text if self.items and isinstance(self.items[0], Atom) and self.items[0].kind == "symbol" else ""

    @property
    def rest(self) -> list:
        return self.items[1:]


def read(text: str) -> list:
    """The forms of a text; what is never closed ends with the text, and closers without an opener are passed over."""
    top: list = []
    stack: list[Form] = []
    quoted, line = False, 1
    for m in _PART.finditer(text):
        kind, t = m.lastgroup, m.group()
        if kind == "q":
            quoted = quoted or t != ","
        elif kind == "o":
            f = Form([], line, line, quoted)
            (stack[-1].items if stack else top).append(f)
            stack.append(f)
            quoted = False
        elif kind == "c":
            if stack:
                stack.pop().end = line
            quoted = False
        elif kind in ("s", "a"):
            sort = "string" if kind == "s" else "number" if re.fullmatch(r"[-+]?\.?\d[\d.eE]*|\?.*", t, re.S) else "symbol"
            (stack[-1].items if stack else top).append(Atom(sort, t, line, quoted))
            quoted = False
        line += t.count("\n")
    for f in stack:
        f.end = line
    return top


#: Forms by what they do to control flow, variables and errors.
DEFINES = frozenset("defun defsubst defmacro cl-defun cl-defmacro cl-defmethod cl-defgeneric cl-defsubst define-inline".split())
VARIABLES = frozenset("defvar defconst defcustom defvar-local".split())
BRANCHES = frozenset("if if-let if-let* when when-let when-let* unless and-let*".split())
CASES = frozenset("cond pcase cl-case case ecase cl-ecase cl-typecase".split())
LOOPS = frozenset("while dolist dotimes cl-loop cl-dolist cl-dotimes loop mapc mapcar dolist-with-progress-reporter".split())
BINDS = frozenset("let let* letrec if-let if-let* when-let when-let* and-let* cl-flet cl-letf cl-letf*".split())
SIGNALS = frozenset("error user-error signal throw cl-error".split())
HANDLERS = frozenset(["condition-case", "condition-case-unless-debug"])
MUTATES = frozenset("push pop setcar setcdr cl-pushnew add-to-list cl-incf cl-decf aset puthash nconc".split())
SHELL = frozenset("shell-command shell-command-to-string async-shell-command call-process-shell-command process-lines-shell".split())
PROCESSES = frozenset("call-process start-process make-process process-file".split())
BUILT = frozenset("format concat format-message mapconcat string-join".split())
REDEFINES = frozenset("fset advice-add defadvice cl-letf cl-letf* defalias".split())


def walk(node, depth: int = 0):
    """(form, depth) of all forms that are evaluated; quoted lists but functions are not entered."""
    todo = [(node, depth)]
    while todo:
        f, d = todo.pop()
        if not isinstance(f, Form) or f.quoted and f.head not in ("lambda", "function"):
            continue
        yield f, d
        deeper = d + (f.head in BRANCHES or f.head in CASES or f.head in LOOPS or f.head in HANDLERS)
        todo += [(x, deeper) for x in reversed(f.items) if isinstance(x, Form)]


def show(x, most: int = 60) -> str:
    out = x.text if isinstance(x, Atom) else "(" + " ".join(show(i, most) for i in x.items) + ")"
    return ("'" if x.quoted and isinstance(x, Form) else "") + (out if len(out) <= most else out[: most - 1] + "…")


def functions(text: str) -> list[tuple[str, Form, Form, list]]:
    """(name, definition, parameters, body) of the functions and macros in a text, also inside other forms."""
    out = []
    for top in read(text):
        for f, _ in walk(top):
            if f.head in DEFINES and len(f.items) > 2 and isinstance(f.items[1], Atom):
                at = next((k for k in range(2, len(f.items)) if isinstance(f.items[k], Form) or f.items[k].text == "nil"), None)
                params = f.items[at] if at is not None and isinstance(f.items[at], Form) else Form([], f.line, f.line)
                body = f.items[at + 1 :] if at is not None else []
                if body and isinstance(body[0], Atom) and body[0].kind == "string" and len(body) > 1:
                    body = body[1:]
                out.append((f.items[1].text, f, params, body))
    return out


def globals_of(text: str) -> set[str]:
    return {f.items[1].text for top in read(text) for f, _ in walk(top) if f.head in VARIABLES and len(f.items) > 1 and isinstance(f.items[1], Atom)}


def _clauses(f: Form) -> list[Form]:
    return [c for c in (f.rest if f.head == "cond" else f.rest[1:]) if isinstance(c, Form)]


def _nothing(body: list) -> bool:
    return all(isinstance(b, Atom) and b.text == "nil" or isinstance(b, Form) and b.head == "ignore" for b in body)


def _conditions(handler: Form) -> list[str]:
    first = handler.items[0]
    return [first.text] if isinstance(first, Atom) else [i.text for i in first.items if isinstance(i, Atom)]


def handlers(f: Form) -> list[Form]:
    return [h for h in f.rest[2:] if isinstance(h, Form) and h.items]


def metrics(definition: Form, body: list) -> dict:
    """Counts of one function. cyclomatic is 1 and the decisions: branches, clauses of cases but t and _, loops, handlers, further operands of and/or."""
    every = [(f, d) for b in body for f, d in walk(b)]
    heads = [f.head for f, _ in every]
    caught = [h for f, _ in every if f.head in HANDLERS for h in handlers(f)]
    n = lambda wanted: sum(h in wanted for h in heads)
    clauses = sum(1 for f, _ in every if f.head in CASES for c in _clauses(f) if c.items and show(c.items[0]) not in ("t", "_", "otherwise"))
    operands = sum(max(0, len(f.rest) - 1) for f, _ in every if f.head in ("and", "or"))
    return {
        "branches": n(BRANCHES) + n(CASES), "loops": n(LOOPS), "try_blocks": n(HANDLERS) + n(("ignore-errors", "with-demoted-errors")), "handlers": len(caught),
        "swallowed": sum(_nothing(h.items[1:]) for h in caught) + n(("ignore-errors",)), "reraises": sum(any(g.head in SIGNALS for x in h.items[1:] for g, _ in walk(x)) for h in caught),
        "logs": sum(any(g.head in ("message", "warn", "display-warning", "lwarn") for x in h.items[1:] for g, _ in walk(x)) for h in caught),
        "raises": n(SIGNALS), "returns": n(("cl-return", "cl-return-from", "throw")), "awaits": 0, "yields": n(("iter-yield",)), "with_blocks": n(("unwind-protect", "with-current-buffer", "save-excursion", "with-temp-buffer", "save-restriction")),
        "cyclomatic": 1 + n(BRANCHES) + clauses + n(LOOPS) + len(caught) + operands,
        "max_depth": max((d + (f.head in BRANCHES or f.head in CASES or f.head in LOOPS or f.head in HANDLERS) for f, d in every), default=0), "lines": definition.end - definition.line + 1,
    }


def exceptions(body: list) -> list[dict]:
    """Rows (what, name, line, end_line, caught) as those of Python: signals, and handlers as guards of the lines of their body; error and t catch all."""
    out = []

    def go(f, guards: list[list[str]]) -> None:
        if not isinstance(f, Form) or f.quoted and f.head not in ("lambda", "function"):
            return
        if f.head in SIGNALS:
            first = f.rest[0] if f.rest else None
            name = show(first).lstrip("'") if f.head in ("signal", "throw") and first is not None else f.head
            own = any(c in (name, "*") for g in guards for c in g)
            out.append({"what": "raise", "name": name, "line": f.line, "end_line": f.end, "caught": own})
        names: list[str] = []
        protected = f.rest
        if f.head in HANDLERS:
            names = ["*" if c in ("error", "t") else c for h in handlers(f) for c in _conditions(h)]
            protected = f.rest[1:2]
        elif f.head in ("ignore-errors", "with-demoted-errors"):
            names = ["*"]
        elif f.head == "catch" and f.rest:
            names, protected = [show(f.rest[0]).lstrip("'")], f.rest[1:]
        for x in protected:
            if names:
                out.extend({"what": "guard", "name": c, "line": x.line - 1, "end_line": getattr(x, "end", x.line), "caught": True} for c in names)
            go(x, [*guards, names] if names else guards)
        if f.head in HANDLERS:
            for h in handlers(f):
                for x in h.items[1:]:
                    go(x, guards)

    for b in body:
        go(b, [])
    return out


def parameters(params: Form) -> list[dict]:
    """Rows (position, name, type): type is required, optional, rest or key."""
    out, kind = [], "required"
    for x in params.items:
        name = x.text if isinstance(x, Atom) else x.items[0].text if x.items and isinstance(x.items[0], Atom) else ""
        if name.startswith("&"):
            kind = {"&optional": "optional", "&rest": "rest", "&body": "rest", "&key": "key"}.get(name, kind)
        elif name:
            out.append({"position": len(out), "name": name, "type": kind})
    return out


def _names(x) -> list[str]:
    """Variables read in an expression."""
    if isinstance(x, Atom):
        return [x.text] if x.kind == "symbol" and not x.quoted and x.text not in ("nil", "t") and x.text[0] not in ":&" else []
    if x.quoted and x.head != "lambda":
        return []
    return list(dict.fromkeys(n for i in (x.rest if x.head else x.items) for n in _names(i)))


def variables(params: list[dict], body: list, line: int) -> list[dict]:
    """Rows (what, name, how, line, to) as those of Python; the last expression's names flow into the result."""
    out = []
    add = lambda what, name, how, at, to="": out.append({"what": what, "name": name, "how": how, "line": at, "to": to})
    for p in params:
        add("def", p["name"], "param", line, str(p["position"]))

    def assign(name: str, value, at: int, how: str) -> None:
        add("def", name, how, at)
        for r in _names(value) if value is not None else ():
            add("flow", r, "copy" if isinstance(value, Atom) else "derive", at, name)

    for b in body:
        for f, _ in walk(b):
            if f.head in BINDS and f.rest and isinstance(f.rest[0], Form):
                for x in f.rest[0].items:
                    if isinstance(x, Atom):
                        add("def", x.text, "let", x.line)
                    elif x.items and isinstance(x.items[0], Atom):
                        assign(x.items[0].text, x.items[1] if len(x.items) > 1 else None, x.line, "let")
            elif f.head in ("setq", "setq-local", "setf"):
                for k in range(0, len(f.rest) - 1, 2):
                    if isinstance(f.rest[k], Atom):
                        assign(f.rest[k].text, f.rest[k + 1], f.rest[k].line, "assign")
            elif f.head in ("dolist", "dotimes", "cl-dolist", "cl-dotimes") and f.rest and isinstance(f.rest[0], Form) and f.rest[0].items:
                x = f.rest[0]
                assign(show(x.items[0]), x.items[1] if len(x.items) > 1 else None, x.line, "for")
            elif f.head and f.head not in CASES | BRANCHES | LOOPS | HANDLERS and f.head not in ("progn", "and", "or", "not", "lambda", "function", "quote", "let", "let*"):
                for k, a in enumerate(f.rest):
                    for r in _names(a):
                        add("flow", r, "call_arg", f.line, f"{f.head}#{k}")
            for x in f.rest:
                if isinstance(x, Atom):
                    for r in _names(x):
                        add("use", r, "read", x.line)
    last = body[-1] if body else None
    while isinstance(last, Form) and last.head in ("progn", "let", "let*", "when", "unless", "save-excursion", "with-current-buffer") and last.rest:
        last = last.rest[-1]
    for r in _names(last) if last is not None else ():
        add("flow", r, "return", last.line)
    return out


def states(params: list[dict], body: list, shared: set[str]) -> list[dict]:
    """Rows (owner, name, access, line): writes, changes and reads of variables that the function does not bind."""
    own = {p["name"] for p in params}
    for b in body:
        for f, _ in walk(b):
            if f.head in BINDS and f.rest and isinstance(f.rest[0], Form):
                own |= {x.text if isinstance(x, Atom) else show(x.items[0]) for x in f.rest[0].items if isinstance(x, Atom) or x.items}
            elif f.head in ("dolist", "dotimes", "cl-dolist", "cl-dotimes") and f.rest and isinstance(f.rest[0], Form) and f.rest[0].items:
                own.add(show(f.rest[0].items[0]))
    out = []
    for b in body:
        for f, _ in walk(b):
            if f.head in ("setq", "setq-local", "setq-default", "setf"):
                for x in f.rest[::2]:
                    if isinstance(x, Atom) and x.text not in own:
                        out.append({"owner": "dynamic", "name": x.text, "access": "write", "line": x.line})
            elif f.head in MUTATES:
                for x in f.rest:
                    name = x.text.lstrip("'") if isinstance(x, Atom) and x.kind == "symbol" else ""
                    if name in shared and name not in own:
                        out.append({"owner": "dynamic", "name": name, "access": "mutate", "line": x.line})
            for x in f.rest if f.head not in MUTATES else ():
                if isinstance(x, Atom) and not x.quoted and x.text in shared and x.text not in own and not (f.head in ("setq", "setq-local", "setq-default", "setf") and x in f.rest[::2]):
                    out.append({"owner": "dynamic", "name": x.text, "access": "read", "line": x.line})
    return out


def risks(definition: Form, body: list) -> list[dict]:
    """Rows (rule, level, line, detail)."""
    out = []
    add = lambda rule, level, line, detail: out.append({"rule": rule, "level": level, "line": line, "detail": detail})
    for b in body:
        for f, _ in walk(b):
            rest = f.rest
            if f.head == "eval" and rest and not (isinstance(rest[0], Form) and rest[0].quoted or isinstance(rest[0], Atom) and (rest[0].kind != "symbol" or rest[0].quoted)):
                add("eval-exec", "high", f.line, show(rest[0]))
            elif f.head in SHELL and rest:
                add("command-exec", "high", f.line, f"{f.head} {show(rest[0])}" + (" (built)" if isinstance(rest[0], Form) and rest[0].head in BUILT else ""))
            elif f.head in PROCESSES and any(isinstance(a, Atom) and a.text.strip('"') in ("sh", "bash", "zsh", "/bin/sh", "/bin/bash", "-c") for a in rest):
                add("command-exec", "high", f.line, f"{f.head} through a shell")
            elif f.head in REDEFINES and rest:
                add("global-redefinition", "medium", f.line, f"{f.head} {show(rest[0])}")
            elif f.head == "add-hook" and len(rest) > 1 and isinstance(rest[1], Form) and rest[1].head == "lambda":
                add("anonymous-hook", "low", f.line, show(rest[0]))
            elif f.head == "sleep-for":
                add("blocking-call", "low", f.line, show(rest[0]) if rest else "")
            elif f.head == "ignore-errors":
                add("swallowed-exception", "medium", f.line, "ignore-errors")
            elif f.head in HANDLERS:
                for h in handlers(f):
                    names = _conditions(h)
                    if "t" in names:
                        add("bare-except", "medium", h.line, "t")
                    if _nothing(h.items[1:]):
                        add("swallowed-exception", "medium", h.line, ", ".join(names))
    return out


def blocks(body: list, first: int) -> list[dict]:
    """The flow graph: rows (block, start_line, end_line, to, label); block 0 enters, -1 is the exit."""
    rows: list[list] = []
    new = lambda line: (rows.append([line, line, []]), len(rows) - 1)[1]

    def seq(forms: list, at: int) -> int | None:
        cur: int | None = at
        for f in forms:
            if cur is None:
                cur = new(f.line)
            rows[cur][1] = max(rows[cur][1], f.line)
            if not isinstance(f, Form) or f.quoted:
                continue
            if f.head in BRANCHES:
                test, yes, no = f.rest[:1], f.rest[1:2] if f.head.startswith("if") else f.rest[1:], f.rest[2:] if f.head.startswith("if") else []
                after = new(f.end)
                for part, label in ((yes, "true"), (no, "false")) if f.head != "unless" else ((yes, "false"), (no, "true")):
                    b = new(part[0].line) if part else after
                    rows[cur][2].append((b, label))
                    end = seq(part, b) if part else None
                    if end is not None:
                        rows[end][2].append((after, ""))
                del test
                cur = after
            elif f.head in CASES:
                after = new(f.end)
                for c in _clauses(f):
                    b = new(c.line)
                    rows[cur][2].append((b, show(c.items[0], 30) if c.items else "nil"))
                    end = seq(c.items[1:], b)
                    if end is not None:
                        rows[end][2].append((after, ""))
                rows[cur][2].append((after, "none"))
                cur = after
            elif f.head in ("while", "dolist", "dotimes", "cl-dolist", "cl-dotimes"):
                head, after, b = new(f.line), new(f.end), new(f.rest[1].line if len(f.rest) > 1 else f.line)
                rows[cur][2].append((head, ""))
                rows[head][2] += [(b, "loop"), (after, "end")]
                end = seq(f.rest[1:], b)
                if end is not None:
                    rows[end][2].append((head, "back"))
                cur = after
            elif f.head in HANDLERS:
                after, b = new(f.end), new(f.line)
                rows[cur][2].append((b, ""))
                end = seq(f.rest[1:2], b)
                if end is not None:
                    rows[end][2].append((after, ""))
                for h in handlers(f):
                    e = new(h.line)
                    rows[b][2].append((e, "handler"))
                    end = seq(h.items[1:], e)
                    if end is not None:
                        rows[end][2].append((after, ""))
                cur = after
            elif f.head in SIGNALS:
                rows[cur][2].append((-1, "signal"))
                cur = None
            elif f.head in ("progn", "let", "let*", "save-excursion", "with-current-buffer", "with-temp-buffer", "prog1", "unwind-protect"):
                cur = seq(f.rest[1:] if f.head in ("let", "let*", "with-current-buffer") else f.rest, cur)
            else:
                rows[cur][1] = max(rows[cur][1], f.end)
        return cur

    end = seq(body, new(first))
    if end is not None:
        rows[end][2].append((-1, "end"))
    return [{"block": k, "start_line": a, "end_line": b, "to": t, "label": label} for k, (a, b, to) in enumerate(rows) for t, label in (to or [(-2, "none")])]
