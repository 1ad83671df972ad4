"""Functions paired with their documentation.

Method: every function, method and declaration becomes a row of a qualified symbol table over all files: its project,
qualified name, normalised signature, own comment and code. Documented declarations are joined with the separate
definitions of the same name and signature, so that overloads are told apart, before rows whose documentation is
missing or says nothing are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.functions.text import clean_id, trim_blanks
from factloom.llm.notices import states_generated
from factloom.session import Scratch, spread
from factloom.sources.tables import latest_files

#: Lines of a file whose symbols are handled together; bounds what is collected for one row.
LINES_TOGETHER = 5_000

# -- finding the comment ---------------------------------------------------------------------------------------------

_PY_SKIP = re.compile(r"(?:[ \t\r\n]|\#[^\n]*|\\\r?\n)*")
_PY_DOC = re.compile(r"""([A-Za-z]{0,2})(\"{3}((?:\\[\s\S]|(?!\"{3})[^\\])*)(?:\"{3}|\Z)|'{3}((?:\\[\s\S]|(?!'{3})[^\\])*)(?:'{3}|\Z)|"((?:\\[\s\S]|[^"\\\n])*)"|'((?:\\[\s\S]|[^'\\\n])*)')""")
_PY_DEF = re.compile(r"[ \t]*(?:async[ \t]+)?def\b[^(\n]*")
_PY_PART = re.compile(r"""\#[^\n]*|"{3}[\s\S]*?"{3}|'{3}[\s\S]*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[()\[\]{}:]""")
_PY_LINE = re.compile(_PY_PART.pattern.removesuffix(":]") + r"]|\n")
_EL_PART = re.compile(r"""(?:\s|;[^\n]*)*(?:(?P<s>"(?:\\[\s\S]|[^"\\])*")|(?P<o>\()|(?P<c>\))|(?P<a>[^\s()";]+))""")
_TEMPLATE = re.compile(r"^\s*(?:template\s*<.*|\[\[.*\]\]|__attribute__\s*\(\(.*\)\)|#\s*(?:if|ifdef|ifndef|endif)\b.*)\s*$")


def python_doc(text: str, at: int) -> tuple[str | None, str]:
    """(docstring, parameters) of the definition that starts at or below offset ``at``."""
    m = _PY_DEF.match(text, at)
    while not m:  # decorators may come first, over several lines
        line_end = text.find("\n", at)
        line = text[at:line_end].lstrip()
        if line_end < 0 or line and line[0] not in "@#)'\"":
            return None, ""
        at = _decorator_end(text, at) if line[:1] == "@" else line_end + 1
        m = _PY_DEF.match(text, at)
    depth, start = 0, m.end()
    for p in _PY_PART.finditer(text, m.end()):
        c = p.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth <= 0:
            body = _PY_SKIP.match(text, p.end()).end()
            d = _PY_DOC.match(text, body)
            args = text[start : p.start()]
            if not d or d.group(1).lower() not in ("", "r", "u"):
                return None, args
            return next((g for g in d.groups()[2:] if g is not None), ""), args
    return None, ""


def _decorator_end(text: str, at: int) -> int:
    """The offset of the line after a decorator, whose brackets may span lines."""
    depth = 0
    for p in _PY_LINE.finditer(text, at):
        c = p.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "\n" and depth <= 0:
            return p.end()
    return len(text)


def elisp_doc(text: str, at: int) -> tuple[str | None, str]:
    """(docstring, parameters): the string after the argument list."""
    depth, seen, pos, args_at, args = 0, 0, at, -1, ""
    while m := _EL_PART.match(text, pos):
        pos = m.end()
        if m.group("o"):
            if args and depth == 1:  # the body has begun
                return None, args
            depth += 1
            if depth == 2 and args_at < 0:
                args_at = m.end()
        elif m.group("c"):
            depth -= 1
            if depth <= 0:
                return None, args
            if depth == 1 and args_at >= 0 and not args:
                args = text[args_at : m.start()] or " "
        elif m.group("s"):
            if depth == 1 and args:
                return m.group("s")[1:-1].replace('\\"', '"'), args
        elif depth == 1:
            seen += 1
            if args or seen > 1 and m.group("a") == "nil":
                if not args:
                    args = " "
                    continue
                return None, args
    return None, args


def comment_above(lines: list[str], line: int) -> str | None:
    """The text of the comment that ends on the line above the 1-based ``line``, without its marks; None if there is none."""
    i = line - 2
    while i >= 0 and lines[i].strip() and _TEMPLATE.match(lines[i]):
        i -= 1
    if i < 0 or i >= len(lines):
        return None
    s = lines[i].strip()
    if s.startswith("//"):
        j = i
        while j >= 0 and lines[j].strip().startswith("//"):
            j -= 1
        got = [re.sub(r"^//[/!]*<?[ \t]?", "", x.strip()) for x in lines[j + 1 : i + 1] if not re.match(r"\s*//(?:go:\w|\s*(?:nolint|NOLINT|clang-format|lint:)\b)", x)]
        return "\n".join(got)
    if not s.endswith("*/"):
        return None
    j = i
    while j >= 0 and "/*" not in lines[j]:
        j -= 1
    if j < 0 or not lines[j].strip().startswith("/*"):
        return None
    body = "\n".join(lines[j : i + 1]).strip()
    if body.count("*/") > 1 or body.count("/*") < 1:
        k = body.rfind("/*")
        if body[:k].strip() and "\n" not in body[:k].strip() and not body.startswith("/*"):
            return None
        body = body[k:]
    body = re.sub(r"^/\*+[!<]*", "", body)
    body = re.sub(r"\*+/$", "", body)
    return "\n".join(re.sub(r"^\s*\*+(?!\w\*)[ \t]?", "", x).rstrip() for x in body.split("\n")).strip()


_SIGNATURE_PART = re.compile(r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[(){;]")
_RECEIVER = re.compile(r"func\s*\([^)]*\)")


def signature(lines: list[str], line: int, lang: str, args: str) -> tuple[str, str]:
    """(parameter types in one notation, without names, default values, qualifiers and blanks; the parameters as written)."""
    if lang in ("python", "elisp"):
        return re.sub(r"\s+", "", args), args
    return _types(_parameters("\n".join(lines[line - 1 :]), lang, 0), lang)


def _parameters(text: str, lang: str, at: int) -> str:
    """What stands between the first bracket at or after offset ``at`` and the one that closes it, without comments; empty if a body or a semicolon comes first."""
    receiver = _RECEIVER.match(text, at) if lang == "go" else None
    out, depth, pos = [], 0, 0
    for m in _SIGNATURE_PART.finditer(text, receiver.end() if receiver else at):
        c = m.group()
        if depth:
            out.append(text[pos : m.start()])
            out.append(" " if c[:2] in ("//", "/*") else c)
            pos = m.end()
        if c == "(":
            depth += 1
            pos = m.end()
        elif c == ")" and depth:
            depth -= 1
            if not depth:
                return "".join(out)[:-1]
        elif c in "{;" and not depth:
            return ""
    return ""


def _types(params: str, lang: str) -> tuple[str, str]:
    """(the types of a parameter list in one notation, the list)."""
    out, depth, cur = [], 0, ""
    for c in params + ",":
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth <= 0:
            out.append(cur)
            cur = ""
        else:
            cur += c
    kinds = []
    for p in out:
        p = re.sub(r"=.*", "", p, flags=re.S).strip()
        if not p or p == "void":
            continue
        p = re.sub(r"\b(?:const|volatile|register|restrict|struct|class|enum|inline)\b", " ", p)
        words = re.findall(r"[\w:]+(?:<[^()]*>)?|[*&]+|\[[^\]]*\]|\.\.\.", p)
        names = [w for w in words if w[0].isalnum() or w[0] in "_:"]
        if lang == "go":
            kinds.append("".join(re.findall(r"\S+", p)[1:]) or p.strip())
        else:
            typed = names[:-1] if len(names) > 1 and names[-1] not in ("int", "char", "long", "short", "unsigned", "double", "float") else names
            kinds.append("".join(typed) + "".join(w.replace("]", "").replace("[", "*") if w[0] == "[" else w for w in words if w[0] in "*&[."))
    return ",".join(kinds), params


# -- does it say something? ------------------------------------------------------------------------------------------

#: Words that hold the place of a description or only restate what a signature says.
EMPTY_WORDS = frozenset(
    """a an the this that of for to in on by with and or is are be it its todo fixme xxx tbd tba wip hack n na none null nil undocumented document documented documentation
    doc docs docstring docstrings description describe desc describes comment comments summary brief details detail placeholder stub dummy template sample example text here goes add write fill me later
    missing pending untitled empty nothing see above below self explanatory obvious function func fn method methods procedure routine subroutine class member helper
    implementation implements implement implemented definition define defines declaration constructor destructor getter setter wrapper main file module code team insert your own
    param params parameter parameters arg args argument arguments return returns returned value values type types rtype raises throws retval tparam var nolint noqa lorem ipsum dolor
    auto generated autogenerated automatically name object instance new old pass rest optional key
    fonction méthode la le les de du des un une à faire description documentation renvoie
    funktion methode die der das den dem eine ein einer beschreibung kommentar noch ausfüllen fehlt folgt siehe zu dokumentieren ergänzen offen
    función metodo método el los las una descripción pendiente documentar por hacer comentario
    未記入 未定 未作成 説明 関数 要説明 後で書く メソッド 説明なし なし 記述 の を する です""".split()
)
_TAG = re.compile(r"(?m)^\s*(?:[@\\](?:param|arg|tparam)\b(?:\s*\[[a-z, ]+\])?(?:[ \t]+[\w*&]+)?|[@\\](?:return|returns|retval|throws|exception|brief|fn|file|author|date|since|version|see|note|type|rtype)\b(?:\s*\[[a-z, ]+\])?|:(?:param|type|return|returns|rtype|raises|arg)\b[^:\n]*:?|(?:Args|Arguments|Parameters|Returns|Return|Raises|Yields|Notes?|Examples?)\s*:?\s*$)")
_NOTICE = re.compile(r"(?i)\bspdx-license|\bcopyright\s*(?:\(c\)|©|\d)|do not edit|@generated|code generated by|^\s*#?line \d+|\blicensed under\b|^-\*-.*-\*-|^\s*(?:pylint|flake8|mypy|ruff|pragma|eslint|clang-format|type|yapf|isort|cppcheck|nolint\w*|noqa|go)\s*:")
_CODE_LINE = re.compile(r"^\s*(?:(?:if|for|while|switch)\s*\(.*|return\b[^.]*;|[\w.>\-\[\]]+\s*(?:[-+*/|&]?=|:=)\s*[^=].*;?|[\w.:>\-]+\(.*\)\s*;?|(?:def|func|class)\s+\w+.*[:{]|[{}]|.*[;{}]|\(\w[\w-]*\b.*\))\s*$")
_WORD = re.compile(r"[^\W_]+", re.U)
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def words_of(name: str) -> list[str]:
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [w.lower() for w in _WORD.findall(re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", name))]


def _stem(w: str) -> str:
    for end in ("ing", "ies", "es", "ed", "s"):
        if len(w) > len(end) + 2 and w.endswith(end):
            return w[: -len(end)].rstrip("ey")
    return w.rstrip("ey") if len(w) > 3 else w


def says_something(doc: str | None, name: str, qualified: str, args: str) -> bool:
    """Whether a documentation comment, read as a whole, tells more than name, signature and placeholders."""
    if not doc:
        return False
    known = {_stem(w) for part in (name, qualified, args) for w in words_of(part)}
    left, cjk = set(), 0
    for line in doc.split("\n"):
        if not line.strip() or _NOTICE.search(line) or states_generated(line):
            continue
        line = _TAG.sub(" ", line)
        if _CODE_LINE.match(line):
            continue
        line = re.sub(r"https?://\S+", " ", line)
        for w in _WORD.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", line)):
            low = w.lower()
            if _CJK.search(low):
                for part in sorted((p for p in EMPTY_WORDS if _CJK.search(p)), key=len, reverse=True):
                    low = low.replace(part, "")
                cjk += len(_CJK.findall(low))
            elif not low.isdigit() and len(low) > 1 and low not in EMPTY_WORDS and _stem(low) not in known:
                left.add(_stem(low))
    return len(left) >= LEAST_WORDS or cjk >= LEAST_CJK


#: Different words beyond name, signature and placeholders from which a comment says something; characters in Japanese and Chinese.
LEAST_WORDS = 2
LEAST_CJK = 4


# -- tables ----------------------------------------------------------------------------------------------------------

_KINDS = ("function", "method", "function_declaration", "method_declaration")
_OUT = "sid string, symbol_id string, project_id string, language string, qualified_name string, kind string, signature string, declares boolean, documentation string, code string, says boolean"


def _extract(text: str, lang: str, s: dict, lines: list[str], offsets: list[int]) -> tuple[str | None, str, str, str]:
    """(documentation, signature, parameters, code) of one symbol."""
    start, end = s["start_line"], s["end_line"]
    if not start or start < 1 or start > len(lines):
        return None, "", "", ""
    at = offsets[start - 1]
    code = text[at : offsets[end] - 1 if end and start <= end < len(lines) else len(text) if end and end >= start else at + len(lines[start - 1])]
    if lang in ("python", "elisp"):
        doc, params = python_doc(text, at) if lang == "python" else elisp_doc(text, at)
        return doc, re.sub(r"\s+", "", params), params, code
    return comment_above(lines, start), *_types(_parameters(text, lang, at), lang), code


def _rows(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 7 + [pa.bool_(), pa.string(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in _OUT.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for project, lang, text, symbols in zip(*(batch.column(i).to_pylist() for i in range(4))):
            lines = text.split("\n")
            offsets = [0, *accumulate(len(x) + 1 for x in lines)]
            for s in symbols:
                doc, types, params, code = _extract(text, lang, s, lines, offsets)
                declares = s["kind"].endswith("declaration")
                name, qualified = s["name"] or "", s["qualified_name"] or ""
                says = says_something(doc, name, qualified, params)
                if not (says or lang in ("c", "cpp")):
                    continue
                doc = doc.replace("\r\n", "\n").replace("\r", "\n").strip() if says and whole else None
                for column, v in zip(out, (s["sid"], s["symbol_id"], project, lang, qualified or name, s["kind"], types, declares, doc, code if whole else None, says)):
                    column.append(v)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def symbol_table(symbols: DataFrame, files: DataFrame, texts: DataFrame, whole: bool = True) -> DataFrame:
    """The functions, methods and declarations of all files with own comment and code; unless ``whole`` without both.

    Of functions that say nothing, only those of C and C++ are kept, as a declaration elsewhere may document them.
    """
    kind = F.lower(trim_blanks(F.col("kind")))
    s = symbols.where(kind.isin(*_KINDS)).select(
        "file_id",
        F.floor(F.coalesce(F.col("start_line"), F.lit(0)) / LINES_TOGETHER).alias("bucket"),
        F.struct(clean_id(F.col("symbol_id")).alias("sid"), "symbol_id", "name", "qualified_name", kind.alias("kind"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line")).alias("s"),
    ).where(F.col("s.sid").isNotNull() & F.col("file_id").isNotNull())
    per_file = spread(s, "file_id").groupBy("file_id", "bucket").agg(F.collect_set("s").alias("symbols"))
    f = latest_files(files)
    lang = F.coalesce(F.col("stated"), F.when(F.lower(trim_blanks(F.col("language"))).isin("c", "cpp", "python", "elisp", "go"), F.lower(trim_blanks(F.col("language")))))
    f = f.select("file_id", "project_id", lang.alias("lang")).where(F.col("lang").isNotNull())
    t = texts.where(F.col("file_id").isNotNull() & F.col("content").isNotNull()).select("file_id", "content")
    rows = per_file.join(spread(f, "file_id"), "file_id").join(spread(t, "file_id"), "file_id").select("project_id", "lang", "content", "symbols")
    return rows.mapInArrow(lambda b: _rows(b, whole), _OUT)


def pairs(symbols: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """(symbol_id, qualified_name, kind, language, documentation, code, doc_from) of each function or method whose documentation says something.

    doc_from is 'own' for the docstring or the comment directly above, or 'declaration' where only a separate declaration
    of the same project with the same qualified name and normalised signature is documented; of several, the least text counts. Symbols
    with null or impossible lines, without text or in other languages have no pair. Declarations are no pairs by themselves. Each symbol once.
    """
    once = _each_once(symbol_table(symbols, files, texts), "qualified_name", "kind", "language", "documentation", "code")
    return once.select("p.*", F.when(F.col("origin") == OWN, "own").otherwise("declaration").alias("doc_from"))


#: Where documentation comes from; of several the least counts.
OWN, DECLARED = 0, 1


def _each_once(table: DataFrame, *columns: str) -> DataFrame:
    """(sid, origin, p): the definitions of a symbol table with documentation that says something, own or of a separate declaration of the same
    project, qualified name and signature; each symbol once, by its own comment if any of its rows has one. p holds symbol_id and ``columns``."""
    key = ["project_id", "qualified_name", "signature"]
    kept = ["sid", "symbol_id", *columns]
    own = table.where(F.col("says") & ~F.col("declares")).select(F.lit(OWN).alias("origin"), *kept)
    declared = table.where(F.col("says") & F.col("declares")).groupBy(*key).agg(F.min("documentation").alias("declared"))
    bare = table.where(~F.col("says") & ~F.col("declares")).drop("documentation").join(declared.withColumnRenamed("declared", "documentation"), key)
    both = own.unionByName(bare.select(F.lit(DECLARED).alias("origin"), *kept))
    one = both.groupBy("sid").agg(F.min(F.struct("origin", F.struct("symbol_id", *columns).alias("p"))).alias("m"))
    return one.select("sid", "m.*")


def documented(symbols: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """(symbol_id): the symbols whose own documentation comment says something, each once.

    The rows of pairs() with doc_from 'own', by the same join of declarations, but without carrying code and text. The table is
    written once, as three branches read it.
    """
    table = Scratch(symbols.sparkSession, "documented").save(symbol_table(symbols, files, texts, whole=False))
    return _each_once(table).where(F.col("origin") == OWN).select("p.symbol_id")
