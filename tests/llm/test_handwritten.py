import random

import numpy as np
import pytest

from conftest import FILE
from factloom.llm import handwritten as h
from factloom.llm.notices import states_foreign, states_generated

UP = "upstream_id int, upstream_name string, version string, relative_path string, language string, content_hash string, content string"


@pytest.mark.parametrize("line", ["// Code generated by protoc. DO NOT EDIT.", "# @generated", "/* Autogenerated from a.y by b 1.0 */", "// source: a.proto", "# Automatisch erzeugt aus a.y", "// このファイルは x によって自動生成されました。"])
def test_generated(line):
    assert states_generated(line)


@pytest.mark.parametrize("line", ["// Writes the generated file; the template says DO NOT EDIT.", "# Builds minified bundles from the list below.", "x = generate()", "// Part of a."])
def test_not_generated(line):
    assert not states_generated(line)


def test_foreign():
    assert states_foreign("// Vendored from zl 5.1.") == "zl" and states_foreign("# zl: upstream version 3, do not patch") == "zl" and states_foreign("// zl 1.2 - released under the terms") == "zl"
    assert states_foreign("// Keeps our fork of zl apart from vendor extensions.") is None


def test_shingles_and_bands():
    words = [f"w{i}" for i in range(200)]
    a, b = h.shingles(words), h.shingles(words[:190])
    assert h.similarity(a, b) == len(set(b.tolist())) / len(set(a.tolist())) and set(h.bands(a)) & set(h.bands(b))
    assert h.bands(h.shingles([])) == [] and len(h.shingles(["one", "(", "two"])) == 1
    assert not set(h.bands(a)) & set(h.bands(h.shingles([f"v{i}" for i in range(200)])))


def hand(rng, k):
    body = "".join(f"def {rng.choice(['read', 'store', 'merge'])}_{rng.choice(['row', 'page', 'slot'])}_{i}(items, limit={rng.randrange(9)}):\n    # keep the {rng.choice(['first', 'last', 'old'])} one\n    for item in items:\n        if item.{rng.choice(['size', 'age'])} > limit:\n            return {rng.choice(['item', 'None', 'limit'])}\n    return {rng.randrange(99)}\n\n" for i in range(rng.randrange(3, 9)))
    return (f"# Helpers for part {k}.\n" if k % 2 else "") + "import os\n" + body


def generated(rng, k):
    body = "".join(f"def get_field_{i}(m):\n    return m[{i}]\n\n" for i in range(rng.randrange(20, 60)))
    return ("# Code generated by tool. DO NOT EDIT.\n" if k % 2 else "") + body


def squeezed(rng, k):
    return ";".join(f"a{i}=lambda x,y:x*{rng.randrange(99)}+y" for i in range(60)) + "\n"


def test_table(spark, make):
    rng = random.Random(5)
    rows = [(f"h{k}", f"src/m{k}.py", hand(rng, k)) for k in range(60)] + [(f"g{k}", f"src/g{k}.py", generated(rng, k)) for k in range(24)] + [(f"s{k}", f"src/s{k}{'.min' if k % 2 else ''}.py", squeezed(rng, k)) for k in range(16)]
    rows += [(f"d{k}", f"src/d{k}.py", "table = [\n" + "".join(f"  {rng.randrange(9999)}, {rng.randrange(9999)},\n" for _ in range(80)) + "]\n") for k in range(6)]
    known = hand(rng, 2) * 2
    rows += [("copy", "src/mine.py", "# Part of own.\n" + known.replace("return None", "return -1", 1)), ("notice", "src/n.py", "# Vendored from zlib2 1.0.\n" + hand(rng, 1)), ("dir", "src/vendor/zlib2/x.py", hand(rng, 1)), ("owndir", "src/vendor/own/x.py", hand(rng, 1)), ("own", "src/o.py", "# own: upstream version 2\n" + hand(rng, 1)), ("null", "n.py", None), ("empty", "e.py", "")]
    files = make(FILE, [{"file_id": i, "relative_path": p, "project_id": "1"} for i, p, _ in rows])
    texts = spark.createDataFrame([(i, t, 1) for i, _, t in rows] + [("h0", rows[0][2], 1)], "file_id string, content string, label int")
    up = spark.createDataFrame([(1, "lib", "1", "lib/a.py", "python", "x", known), (2, "lib", "1", "lib/n.py", "python", "x", None)], UP)
    projects = spark.createDataFrame([("own",), (None,)], "name string")
    got = {r.file_id for r in h.not_handwritten(files, texts, up, projects).collect()}
    want = {i for i, _, _ in rows if i[0] in "gsd" and i not in ("dir",)} | {"copy", "notice", "dir"}
    assert got == want, (got - want, want - got)
    assert h.not_handwritten(files.limit(0), texts, up, projects).count() == 0 and h.not_handwritten(files, texts.limit(0), up.limit(0), projects.limit(0)).count() == 0
    few = {r.file_id for r in h.not_handwritten(files.where("file_id IN ('g1', 'h0', 'notice')"), texts, up.limit(0)).collect()}
    assert {"g1", "notice"} <= few


def test_features_are_finite():
    for text in ("", "\n", "x", "1" * 10_000, "'" * 99, '"""' + "a b " * 500):
        for kind in ("hash", "semi", "slash"):
            body = h.ends(text)[1]
            assert np.isfinite(h.features(body, *h.code_of(body, kind))).all() and len(h.features(body, *h.code_of(body, kind))) == len(h.FEATURES)


@pytest.mark.parametrize("path, mark, text", [("a.cc", "//", '"a // x"'), ("a.py", "#", "'''a\n# @generated\n'''"), ("a.el", ";;", '"a\n;; @generated\n"')])
def test_notice_between_lines_of_code(path, mark, text):
    import pyarrow as pa

    body = "".join(f"x{k} = {text}\n" for k in range(30)) + "end = 1\n" * 15
    notice = f"{mark} Code generated by rpcweave. DO NOT EDIT.\n"

    def look(content):
        out = next(h._look(iter([pa.record_batch([pa.array(["1"]), pa.array([path]), pa.array([content])], names=["a", "b", "c"])])))
        return out.to_pylist()[0]

    with_notice, without = look(body + notice + body), look(body + body)
    assert with_notice["notice"] and with_notice["label"] == 1 and not without["notice"]
    assert with_notice["features"] == without["features"]
    assert not look(body + "y = 1 " + notice + body)["notice"]


def test_long_heads_and_tails_are_read_whole():
    import pyarrow as pa

    def look(content):
        return next(h._look(iter([pa.record_batch([pa.array(["1"]), pa.array(["a.c"]), pa.array([content])], names=["a", "b", "c"])]))).to_pylist()[0]

    head = "".join(f"// line {k} of a long licence text\n" for k in range(60))
    code = "int f(int a)\n{\n  return a;\n}\n"
    assert look(head + "// Vendored from zlib2 1.0.\n" + code)["origin"] == "zlib2" and look(head + code)["origin"] is None
    assert look(head + "// @generated\n" + code)["notice"] and look(code + head + "// Code generated by x. DO NOT EDIT.\n")["notice"]
    assert look(head + code)["features"] == look(head[: len(head) // 2] + code)["features"] or look(head + code)["label"] == 0
    assert look("  \n")["blank"] and not look(code)["blank"]


def test_labels_are_hidden_from_the_features():
    import pyarrow as pa

    def look(path, content):
        return next(h._look(iter([pa.record_batch([pa.array(["1"]), pa.array([path]), pa.array([content])], names=["a", "b", "c"])]))).to_pylist()[0]

    data = "x = [\n" + "  1, 2, 3, 4,\n" * 200 + "]\n"
    assert look("a.py", "# Rows.\n" + data)["label"] == 0 and look("a.min.py", data)["label"] == 1 and look("a.py", data)["label"] is None
    assert look("a.min.py", data)["features"] == look("a.py", data)["features"]


def test_faster_ways_see_the_same():
    import re
    from collections import Counter

    slow = re.compile(r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`")
    r = np.random.default_rng(5)
    for chars in ("aZ_09 .\n", "\"'\\`a \n", "a9_.,;:-+\"' \t\n\r\x0b\x0c\x1c\x1f#x/*(", "aé9_日 ²٣.,\"'\n\xa0"):
        for n in r.integers(0, 60, 1500):
            text = "".join(r.choice(list(chars), n))
            form = h._NUMBER.sub("9", h._IDENT.sub("a", text))
            assert h._shaped(text) == form and h._shapes(text.split("\n")) == Counter(map(str.strip, h._RUN.sub(r"\1", form).split("\n")))
            assert h._shapes([]) == Counter([""]) and h._unblank(text) == len("".join(text.split())) and h._LITERAL.findall(text) == slow.findall(text)
            assert not text.isascii() or h._ASCII_TOKEN.findall(text) == h._TOKEN.findall(text)
            tokens = h._TOKEN.findall(text)
            assert h.features([text], text, tokens, Counter(tokens)) == h.features([text], text, tokens) and (h.shingles(tokens, set(tokens)) == h.shingles(tokens)).all()
