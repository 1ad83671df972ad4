"""Lexical facts from C, C++, Go and Emacs Lisp source, where no compiler is at hand: definitions with their ranges, calls, includes and counts.

A compiler front end knows more (types, overloads, macros); these facts are marked inferred for that reason.
"""

from __future__ import annotations

import re

from factloom.sources import lisp, statements

_BLANK = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|R\"([^()\\\s]{0,16})\([\s\S]*?\)\1\"|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_BLANK_EL = re.compile(r";[^\n]*|\"(?:\\[\s\S]|[^\"\\])*\"|\?\\?.")
_DEF_C = re.compile(r"(?m)^([ \t]*)(?!(?:else|return|if|for|while|switch|do|case|goto|typedef|using|new|throw|public|private|protected)\b)((?:[A-Za-z_][\w:<>,]*[\s*&]+)+)((?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*\(([^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)\s*(?:const|noexcept|override|final|\s)*(\{|;)")
_DEF_GO = re.compile(r"(?m)^func\s*(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(([^)]*)\)[^\n{]*\{")
_TYPE = re.compile(r"(?m)^[ \t]*(?:typedef\s+)?(class|struct|namespace|enum|union)\s+([A-Za-z_]\w*)[^;(){}]*\{")
_TYPE_GO = re.compile(r"(?m)^type\s+(\w+)\s+(struct|interface)\s*\{")
_CALL = re.compile(r"([A-Za-z_][\w]*(?:(?:::|\.|->)[A-Za-z_]\w*)*)\s*\(")
_INCLUDE = re.compile(r"(?m)^[ \t]*#[ \t]*include[ \t]*([<\"])([^>\"\n]+)[>\"]")
_IMPORT_GO = re.compile(r"(?m)^import\s+(?:\w+\s+)?\"([^\"]+)\"|^\s+(?:\w+\s+)?\"([\w./-]+)\"\s*$")
#: Words before a parenthesis that are no calls.
_NO_CALL = frozenset("if for while switch return sizeof catch func defer go select case defined static_assert alignof decltype new delete throw".split())
_FIELD = re.compile(r"(?:->|(?<=[\w\])])\.)\s*([A-Za-z_]\w*)\b(?!\s*\()(\s*(?:[-+*/|&^%]|<<|>>)?=(?!=)|\s*(?:\+\+|--))?")
_DEFINE = re.compile(r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(\([^)]*\))?[ \t]*([^\n]*)")
#: Calls that a review should look at in Go.
RISKY = {"command-exec": "exec.Command", "panic": "panic", "exit": "os.Exit log.Fatal"}
_RISK_OF = {name: rule for rule, names in RISKY.items() for name in names.split()}
_COMMENT = re.compile(r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`")
_COMMENT_EL = re.compile(r"(?P<c>;[^\n]*)|\"(?:\\[\s\S]|[^\"\\])*\"|\?\\?.")
_MARK = re.compile(r"\b(?:TODO|FIXME|XXX|HACK)\b", re.I)
#: Facts that need the statements of functions.
_OF_FUNCTIONS = ("flows", "variables", "states", "exits", "returns", "findings", "blocks", "parameters", "aliases", "exceptions")
_EL_DEF = re.compile(r"\((defun|defsubst|defmacro|cl-defun|cl-defmethod|cl-defgeneric|defvar|defconst|defcustom|define-minor-mode)\s+'?([^\s()]+)")
_EL_CALL = re.compile(r"\(([A-Za-z][^\s()\"';]*)")
_EL_REQUIRE = re.compile(r"\(require\s+'([^\s()]+)")


def blank(text: str, lang: str) -> str:
    """The text of the same length and lines with comments and literals blanked."""
    keep = lambda m: re.sub(r"[^\n]", " ", m.group())
    return (_BLANK_EL if lang == "elisp" else _BLANK).sub(keep, text)


def close(text: str, at: int, a: str, b: str) -> int:
    """The offset after the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.finditer(f"[{re.escape(a)}{re.escape(b)}]", text[at:]):
        depth += 1 if m.group() == a else -1
        if depth == 0:
            return at + m.end()
    return len(text)


_ORG_BLOCK = re.compile(r"(?ims)^[ \t]*#\+begin_src[ \t]+(?:emacs-lisp|elisp)\b[^\n]*\n(.*?)^[ \t]*#\+end_src")


def org_source(text: str) -> str:
    """An Org text of the same lines with all but its Emacs Lisp blocks blanked."""
    out, at = [], 0
    for m in _ORG_BLOCK.finditer(text):
        out += [re.sub(r"[^\n]", " ", text[at : m.start(1)]), m.group(1)]
        at = m.end(1)
    return "".join(out) + re.sub(r"[^\n]", " ", text[at:])


def extract(text: str, path: str, lang: str, want: str | None = None) -> dict[str, list[dict]]:
    """All facts of one file, or with ``want`` at least those of one kind."""
    text = text.replace("\r\n", "\n").lstrip("﻿")
    if path.lower().endswith(".org"):
        text = org_source(text)
    code = blank(text, lang)
    line_of = _Lines(text)
    out: dict[str, list[dict]] = {"symbols": [], "refs": [], "deps": [], "flows": [], "fields": [], "macros": [], "findings": []}
    out |= {k: [] for k in _OF_FUNCTIONS}
    spans: list[tuple[int, int, str]] = []

    def symbol(kind: str, name: str, a: int, b: int, parent: str = "") -> None:
        q = f"{parent}::{name}" if parent and lang == "cpp" else f"{parent}.{name}" if parent else name
        out["symbols"].append({"kind": kind, "name": name.rpartition("::")[2], "qname": q, "start_line": line_of(a), "end_line": line_of(max(a, b - 1)), "parent": parent})
        if kind in ("function", "method"):
            spans.append((a, b, q))

    if lang == "elisp":
        for m in _EL_DEF.finditer(code):
            word = m.group(1)
            symbol("macro" if word == "defmacro" else "global_variable" if word in ("defvar", "defconst", "defcustom") else "function", m.group(2), m.start(), close(code, m.start(), "(", ")"))
        for m in _EL_REQUIRE.finditer(code):
            out["deps"].append({"kind": "import", "target": m.group(1), "line": line_of(m.start())})
        calls = _EL_CALL
    elif lang == "go":
        for m in _TYPE_GO.finditer(code):
            symbol("struct", m.group(1), m.start(), close(code, m.end() - 1, "{", "}"))
        for m in _DEF_GO.finditer(code):
            symbol("method" if m.group(1) else "function", m.group(2), m.start(), close(code, m.end() - 1, "{", "}"), m.group(1) or "")
        for m in _IMPORT_GO.finditer(text):
            out["deps"].append({"kind": "import", "target": m.group(1) or m.group(2), "line": line_of(m.start(1) if m.group(1) else m.start(2))})
        calls = _CALL
    else:
        types = []
        for m in _TYPE.finditer(code):
            end = close(code, m.end() - 1, "{", "}")
            types.append((m.start(), end, m.group(2), m.group(1)))
            symbol("class" if m.group(1) == "class" else "namespace" if m.group(1) == "namespace" else "struct", m.group(2), m.start(), end)
        for m in _DEF_C.finditer(code):
            if m.group(3) in _NO_CALL or m.group(2).split()[0] in ("return", "else", "#define"):
                continue
            around = [t for t in types if t[0] < m.start() < t[1]]
            parent = "::".join(t[2] for t in sorted(around))
            method = bool(around) and around[-1][3] in ("class", "struct")
            if m.group(5) == ";":
                if not any(a < m.start() < b for a, b, _ in spans):
                    symbol("function_declaration", m.group(3), m.start() + len(m.group(1)), m.end(), parent)
            else:
                symbol("method" if method or "::" in m.group(3) else "function", m.group(3), m.start() + len(m.group(1)), close(code, m.end() - 1, "{", "}"), parent)
        for m in _INCLUDE.finditer(text):
            out["deps"].append({"kind": "include", "target": m.group(2), "line": line_of(m.start())})
        calls = _CALL
    for a, b, q in spans:
        if lang == "elisp":  # after the argument list
            head = close(code, code.find("(", a + 1, b), "(", ")") if "(" in code[a + 1 : b] else b
        else:  # after the head
            head = max(a, code.find("{", a, b))
        for m in calls.finditer(code, head, b):
            name = m.group(1)
            if name not in _NO_CALL:
                out["refs"].append({"source": q, "kind": "call", "target": name, "line": line_of(m.start()), "note": ""})
                if rule := _RISK_OF.get(name) if lang == "go" else None:
                    out["findings"].append({"qname": q, "rule": rule, "level": "medium", "line": line_of(m.start()), "detail": name})
        if lang in ("c", "cpp", "go"):
            for m in _FIELD.finditer(code, head, b):
                out["fields"].append({"qname": q, "name": m.group(1), "access": "write" if m.group(2) else "read", "line": line_of(m.start())})
    if lang in ("c", "cpp"):
        for m in _DEFINE.finditer(code):
            out["macros"].append({"name": m.group(1), "has_parameters": bool(m.group(2)), "body": text[m.start(3) : m.end(3)].strip(), "line": line_of(m.start())})
    if want is None or want in _OF_FUNCTIONS:
        if lang == "elisp":
            _lisp_functions(text, out)
        else:
            for a, b, q in spans:
                _function(text, code, lang, a, b, q, line_of, out)
    if want in (None, "findings"):
        for m in (_COMMENT_EL if lang == "elisp" else _COMMENT).finditer(text):
            if m.group("c") and _MARK.search(m.group("c")):
                out["findings"].append({"qname": "", "rule": "todo-marker", "level": "low", "line": line_of(m.start()), "detail": " ".join(m.group("c").split())})
    return out


def _function(text: str, code: str, lang: str, a: int, b: int, q: str, line_of, out: dict[str, list[dict]]) -> None:
    """What follows from the statements of the function between two offsets."""
    brace = code.find("{", a, b)
    if brace < 0:
        return
    name = re.split(r"::|\.", q)[-1]
    m = re.search(rf"{re.escape(name)}\s*(?:\[[^\]]*\])?\s*\(", code[a:brace])
    opening = a + m.end() - 1 if m else code.find("(", a, brace)
    params = statements.parameters(text[opening + 1 : close(code, opening, "(", ")") - 1], lang) if 0 <= opening < brace else []
    first, last = line_of(a), line_of(max(a, b - 1))
    body = statements.parse(text[brace + 1 : b], lang, line_of(brace + 1))
    rows = statements.variables(body, params, first)
    tag = lambda found: [{"qname": q, **r} for r in found]
    out["flows"].append({"qname": q, "line": first, **statements.metrics(body, first, last)})
    out["variables"] += tag(rows)
    out["parameters"] += tag(params)
    out["exits"] += tag(statements.exits(body))
    out["returns"] += tag(statements.returns(body))
    out["findings"] += tag(statements.risks(body, lang)) + tag(statements.config(body))
    out["states"] += tag(statements.states(body, params, rows, lang))
    out["aliases"] += tag(statements.aliases(rows, body))
    out["blocks"] += tag(statements.blocks(body, first))


def _lisp_functions(text: str, out: dict[str, list[dict]]) -> None:
    shared = lisp.globals_of(text)
    for q, definition, form, body in lisp.functions(text):
        params = lisp.parameters(form)
        tag = lambda found: [{"qname": q, **r} for r in found]
        signals = lisp.exceptions(body)
        out["flows"].append({"qname": q, "line": definition.line, **lisp.metrics(definition, body)})
        out["variables"] += tag(lisp.variables(params, body, definition.line))
        out["parameters"] += tag(params)
        out["exceptions"] += tag(signals)
        out["exits"] += tag({"kind": "signal", "detail": r["name"], "line": r["line"]} for r in signals if r["what"] == "raise" and not r["caught"])
        out["findings"] += tag(lisp.risks(definition, body))
        out["states"] += tag(lisp.states(params, body, shared))
        out["blocks"] += tag(lisp.blocks(body, definition.line))


class _Lines:
    def __init__(self, text: str):
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def __call__(self, offset: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, offset)
