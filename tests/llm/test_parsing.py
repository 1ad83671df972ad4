from functools import reduce

import pytest

from conftest import FILE
from factloom.llm import parsing as p

PY = 'import os\n\n\n@dec\nclass A:\n    """Doc ( [\n=======\n"""\n    def f(self, x):\n        if x:\n            return {"a": \'(\'}\n        else:\n            return [1,\n2]\n\n\ndef g():\n    pass\n'
C = '#include <a.h>\n/* } ( */\n#ifdef X\nint f(int a) {\n#else\nint f(void) {\n#endif\n    char c = \'{\'; const char *s = "\\"}";\n    // ) <<<<<<< HEAD\n    if (c)\n        return 1;\n    return 0;\n}\n'
CPP = "#include <v>\nnamespace n {\nclass K {\npublic:\n    int f(int x) {\n        auto s = R\"x(raw } \n<<<<<<< HEAD\n)x\";\n        int y = 1'000;\n        return {};\n    }\n};\n}\n"
GO = "package a\n\nimport (\n\t\"fmt\"\n)\n\n// F does }.\nfunc F(x int) {\n\tp := `raw {\n=======\n`\n\tr := '{'\n\tfmt.Println(p, r, \"(\")\n}\n"
EL = ";;; x.el --- t ( -*- lexical-binding: t -*-\n(require 'seq)\n(defun f (x)\n  \"Doc ( here.\n<<<<<<< HEAD\n\"\n  (if (eq x ?\\() (message \"[\") (list ?\\) ?a)))\n(provide 'x)\n"
GOOD = {"python": PY, "c": C, "cpp": CPP, "go": GO, "elisp": EL}
SQL = "-- t\ncreate table x (\n  a integer\n);\ninsert into x values (1);\n"
HTML = "<!doctype html>\n<html><body>\n<p>x</p>\n</body></html>\n"
SHELL = "#!/bin/sh\nset -e\nif [ -z \"$A\" ]; then\n  echo x\nfi\nfor x in *.h; do\n  cp \"$x\" y\ndone\n"
JSON = '{"a": [1, 2],\n "b": {"c": "d"}}\n'
PROSE = "# Title\n\nRun this first:\n\n* keep it open\n* don't skip it\n"
LOG = "2024-04-10 04:16:38 INFO a: b took 72 ms\n2024-08-15 02:50:33 INFO c: d took 46 ms\n"


@pytest.mark.parametrize("lang", GOOD)
def test_valid(lang):
    for text in (GOOD[lang], GOOD[lang].replace("\n", "\r\n"), "\ufeff" + GOOD[lang], "", " \n\n"):
        assert p.judge(text, lang) == "", lang


@pytest.mark.parametrize("lang", GOOD)
def test_cut(lang):
    text = GOOD[lang]
    keep = {"python": "def g():", "c": "    return 0", "cpp": "        return {", "go": "\tr :=", "elisp": "(message"}[lang]
    at = text.index(keep) + len(keep)
    assert p.judge(text[:at], lang) and p.judge(text[:at] + "\n[output limit reached]", lang)
    if lang != "elisp":
        start = {"python": "        if x:", "c": "    if (c)", "cpp": "        int y", "go": "\tr :="}[lang]
        assert p.judge(text[text.index(start) :], lang)


@pytest.mark.parametrize("lang", GOOD)
def test_merge(lang):
    lines = GOOD[lang].split("\n")
    for block in (["<<<<<<< HEAD", *lines[-4:-2], "=======", *lines[-4:-2], ">>>>>>> theirs"], [">>>>>>> feature/x"]):
        assert p.judge("\n".join(lines[:-4] + block + lines[-2:]), lang)
    assert p.judge(GOOD[lang] + ">>>>>>> feature/x\n", lang) in ("merge", "statement")


@pytest.mark.parametrize("lang", GOOD)
def test_other_kind(lang):
    others = [SQL, HTML, SHELL, JSON, PROSE, LOG] + [v for k, v in GOOD.items() if k != lang and {k, lang} != {"c", "cpp"}]
    for text in others:
        assert p.judge(text, lang), (lang, text)


@pytest.mark.parametrize("lang", GOOD)
@pytest.mark.parametrize("size", [1, 30, 90])
def test_chunks_agree(lang, size):
    text = GOOD[lang] * 3 if lang != "go" else GOOD[lang] + GOOD[lang].split("\n", 5)[5] * 3
    pieces = p.cut(p.unify(text), lang, size)
    assert "".join(pieces) == text and len(pieces) > 1
    maps = [p.state_map(c, lang, i == 0, i == len(pieces) - 1) for i, c in enumerate(pieces)]
    left = reduce(p.compose, maps)[p.CODE]
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = p.compose(m, right)
    assert left == right[p.CODE] and p.verdict(left, lang) == ""


NESTED = 'f(\nx[f"{d["]"]}"],\ny)\nz = """a\nb""" + \\\nf(1)\nu = """a\nv""".w\n'


def in_chunks(text, lang, size):
    pieces = p.cut(p.unify(text), lang, size)
    maps = [p.state_map(c, lang, i == 0, i == len(pieces) - 1) for i, c in enumerate(pieces)]
    return p.verdict(reduce(p.compose, maps)[p.CODE], lang)


@pytest.mark.parametrize("lang", GOOD)
@pytest.mark.parametrize("size", [1, 30, 90, 400])
def test_same_verdict_at_every_size(lang, size):
    others = [SQL, HTML, SHELL, JSON, PROSE, LOG, *GOOD.values(), NESTED]
    cuts = [GOOD[lang][:at] for at in range(0, len(GOOD[lang]), 7)] + [GOOD[lang][at:] for at in range(0, len(GOOD[lang]), 7)]
    notes = [GOOD[lang] + "\n[output limit reached]\n\n", "[truncated]\n" + GOOD[lang], GOOD[lang] + "x = 1\n...\n# end\n", GOOD[lang] + "# <<<<<<< HEAD\n>>>>>>> a\n"]
    for text in [x * n for x in others for n in (1, 4)] + cuts + notes:
        assert in_chunks(text, lang, size) == in_chunks(text, lang, 10**9), (lang, size, text)
    if size < 90 and lang == "python":
        assert in_chunks(JSON * 4, lang, size) == "kind" and in_chunks(NESTED, lang, size) == ""
    if size < 90:
        assert len(p.cut(GOOD[lang] * 3, lang, p.CHUNK)) < len(p.cut(GOOD[lang] * 3, lang, size))


def test_ordinary_files_have_several_chunks():
    assert all(len(p.cut(GOOD[lang] * 12, lang)) > 1 for lang in GOOD)


def test_table(spark, make):
    names = {"a": "x.py", "b": "y.py", "c": "z.c", "n": "n.py", "e": "e.go", "t": "t.txt", "big": "big.c", "bigbad": "bigbad.c"}
    files = make(FILE, [{"file_id": i, "relative_path": n, "project_id": "p", "analysis_status": "failed"} for i, n in names.items()])
    big = C + "int k(void) { return 1; }\n" * 3000
    texts = [("a", PY), ("a", PY), ("b", PY + "def z(:\n"), ("c", C), ("n", None), ("e", ""), ("t", SQL), ("big", big), ("bigbad", big.replace("return 1; }", "return 1;", 1)), (None, "x")]
    t = spark.createDataFrame([(i, x, 1) for i, x in texts], "file_id string, content string, defect int")
    for chunk in (p.CHUNK, 2_000):
        got = {r.file_id: r.defect for r in p.defects(files, t, chunk).collect()}
        assert got == {"a": None, "b": "statement", "c": None, "e": None, "big": None, "bigbad": "unbalanced"}
    assert sorted(r.file_id for r in p.broken(files, t).collect()) == ["b", "bigbad"]
    assert {r.language: (r.n_files, r.n_broken) for r in p.rates(files, t).collect()} == {"python": (2, 1), "c": (3, 1), "go": (1, 0)}
    assert p.broken(files.limit(0), t).count() == 0 and p.broken(files, t.limit(0)).count() == 0
