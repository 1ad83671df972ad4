"""Analyses of functions in C, C++, Go and Emacs Lisp on planted sources."""

from factloom.operators import functions, questions as qs
from factloom.sources import brace_source, lisp, python_source, statements

C = r"""
static int total;
int check(const char *path, struct box *b, int n)
{
  /* TODO: later */
  static int calls = 0;
  char *buf = malloc(n), *alias = &spare;
  calls++;
  if (n < 0 && path) {
    errno = EINVAL;
    return -1;
  } else if (n == 0) {
    b->size = n;
  }
  for (int i = 0; i < n; i++) {
    if (i % 2) continue;
    total += step(i, n);
  }
  switch (n) {
  case 1: first();
  case 2: second(); break;
  case 3: { return 0; }
  default: abort();
  }
  printf(path);
  printf("%d\n", n);
  sscanf(path, "%s", buf);
  sscanf(path, "%9s", buf);
  strcpy(buf, path);
  system(path);
  if (strcmp(argv[1], "--fast") == 0) { use(getenv("HOME")); }
  do { n--; } while (n > 0);
  goto out;
out:
  return n ? OK : compute(n);
}
"""


def test_c():
    got = brace_source.extract(C, "a.c", "c")
    (flow,) = got["flows"]
    assert (flow["branches"], flow["loops"], flow["returns"], flow["cyclomatic"], flow["max_depth"]) == (5, 2, 3, 12, 2)  # 1, four ifs, two loops, three cases, one && and one ?
    assert [(x["position"], x["name"], x["type"]) for x in got["parameters"]] == [(0, "path", "const char *"), (1, "b", "struct box *"), (2, "n", "int")]
    assert [(x["kind"], x["detail"]) for x in got["exits"]] == [("errno", "EINVAL"), ("error", "- 1"), ("terminate", "abort()")]
    rules = [(x["rule"], x["detail"]) for x in got["findings"]]
    assert set(rules) == {
        ("fallthrough", "into 2"), ("format-string", "printf: path"), ("unsafe-libc", "sscanf without a width"), ("unsafe-libc", "strcpy"), ("command-exec", "system"), ("unchecked-alloc", "buf"), ("cli-option", "--fast"), ("env-read", "HOME"), ("todo-marker", "/* TODO: later */"),
    }
    assert sum(r == ("unsafe-libc", "sscanf without a width") for r in rules) == 1
    assert {(x["owner"], x["name"]) for x in got["states"]} >= {("static", "calls"), ("parameter", "b->size"), ("global", "total"), ("global", "errno")}
    assert [(x["name"], x["target"]) for x in got["aliases"]] == [("alias", "spare")]
    assert [(x["value"], x["constant"]) for x in got["returns"]][:2] == [("- 1", True), ("0", True)] and not got["returns"][2]["constant"]
    flows = {(x["name"], x["how"], x["to"]) for x in got["variables"] if x["what"] == "flow"}
    assert {("i", "call_arg", "step#0"), ("n", "call_arg", "step#1"), ("i", "derive", "total"), ("n", "attr_store", "b->size"), ("path", "call_arg", "strcpy#1"), ("n", "return", "")} <= flows
    labels = {x["label"] for x in got["blocks"]}
    assert {"true", "false", "loop", "back", "return", "goto", "falls", "1", "default", "continue", "break"} <= labels
    nodes = {x["block"] for x in got["blocks"]}
    assert all(x["to"] in nodes | {-1} for x in got["blocks"] if x["label"] != "none")


def test_cpp_and_go():
    got = brace_source.extract("class C {\n  int f() {\n    try { g(); } catch (const E &e) { } catch (...) { log(1); } \n    throw Bad();\n  }\n};\n", "a.cc", "cpp")
    assert [(x["rule"], x["detail"]) for x in got["findings"]] == [("swallowed-exception", "catch (const E & e) is empty"), ("swallowed-exception", "catch (...) does not throw again")]
    assert got["flows"][0]["handlers"] == 2 and got["flows"][0]["swallowed"] == 1 and got["exits"][-1]["kind"] == "throw" and {x["label"] for x in got["blocks"]} >= {"catch", "throw"}
    go = brace_source.extract('package p\nfunc (r *R) Do(a, b int, c *T) error {\n\tif a > b {\n\t\treturn fmt.Errorf("x %d", a)\n\t}\n\tfor i := range c.items {\n\t\tr.total = i\n\t\tx, err := load(i)\n\t\tif err != nil {\n\t\t\tpanic(err)\n\t\t}\n\t\tuse(x)\n\t}\n\tswitch a {\n\tcase 1:\n\t\tb = 2\n\tdefault:\n\t\tos.Exit(3)\n\t}\n\treturn nil\n}\n', "a.go", "go")
    assert [(x["name"], x["type"]) for x in go["parameters"]] == [("a", "int"), ("b", "int"), ("c", "* T")]
    (flow,) = go["flows"]
    assert (flow["branches"], flow["loops"], flow["returns"], flow["cyclomatic"]) == (3, 1, 2, 5)
    assert [x["kind"] for x in go["exits"]] == ["error", "terminate", "terminate", "error"]
    assert {("i", "call_arg", "load#0"), ("x", "call_arg", "use#0"), ("err", "call_arg", "panic#0")} <= {(x["name"], x["how"], x["to"]) for x in go["variables"] if x["what"] == "flow"}


def test_odd_bodies():
    for text in ("", "}", "{{{", "if", "case", "else else", "for (;;", "x = {1, 2, {3}};", "do", "try {", "goto ;", ";;;;", "(", "#define A \\\n b\nx();"):
        body = statements.parse(text, "cpp", 1)
        statements.blocks(body, 1), statements.metrics(body, 1, 1), statements.risks(body, "c"), statements.variables(body, [], 1), statements.exits(body)
    deep = statements.parse("{" * 5_000 + "}" * 5_000, "c", 1)
    assert deep == [] or len(deep) == 1


EL = """
(defvar cache nil)
(defcustom depth 3 "Depth.")
;; FIXME slow
(defun walk (node &optional limit &rest more)
  "Walk NODE."
  (interactive)
  (let ((left (car node)) seen)
    (setq cache (cons left cache))
    (setq outer 1)
    (push left cache)
    (while (and left (< depth 4) t)
      (unless seen (error "Loop in %s" node))
      (setq seen (next left)))
    (condition-case err
        (progn (load-it left) (signal 'my-error nil))
      (file-error (message "no"))
      (my-error nil)
      (t (signal (car err) (cdr err))))
    (ignore-errors (risky))
    (cond ((null limit) 1) ((= limit 2) 2) (t 3))
    (shell-command (concat "rm " left))
    (fset 'old #'new)
    (add-hook 'my-hook (lambda () (eval form)))
    (sleep-for 1)
    left))
(defun caller () (condition-case nil (walk 1) (error 0)))
(defun other () (walk 2))
"""


def test_elisp(spark):
    got = brace_source.extract(EL, "a.el", "elisp")
    flow = next(x for x in got["flows"] if x["qname"] == "walk")
    assert (flow["branches"], flow["loops"], flow["handlers"], flow["swallowed"], flow["reraises"], flow["logs"], flow["cyclomatic"]) == (2, 1, 3, 2, 1, 1, 10)
    assert [(x["name"], x["type"]) for x in got["parameters"] if x["qname"] == "walk"] == [("node", "required"), ("limit", "optional"), ("more", "rest")]
    assert {(x["name"], x["access"]) for x in got["states"] if x["qname"] == "walk"} == {("cache", "write"), ("cache", "mutate"), ("outer", "write"), ("depth", "read"), ("cache", "read")}
    assert {x["rule"] for x in got["findings"]} == {"bare-except", "swallowed-exception", "command-exec", "global-redefinition", "anonymous-hook", "eval-exec", "blocking-call", "todo-marker"}
    raised = {(x["name"], x["caught"]) for x in got["exceptions"] if x["qname"] == "walk" and x["what"] == "raise"}
    assert raised == {("error", False), ("my-error", True), ("(car err)", False)}
    flows = {(x["name"], x["how"], x["to"]) for x in got["variables"] if x["qname"] == "walk" and x["what"] == "flow"}
    assert {("node", "derive", "left"), ("left", "call_arg", "load-it#0"), ("left", "return", ""), ("left", "derive", "seen")} <= flows
    assert {"loop", "back", "handler", "signal", "true", "none"} <= {x["label"] for x in got["blocks"]}
    rows = [(x["qname"], x["what"], x["name"], x["line"], x["end_line"], x["caught"]) for x in got["exceptions"]]
    e = spark.createDataFrame(rows, "qname string, what string, name string, line int, end_line int, caught boolean")
    calls = spark.createDataFrame([(x["source"], x["target"], x["line"]) for x in got["refs"] if x["target"] == "walk"], "source string, target string, line int")
    out = {(r.qname, r.exception, r.distance) for r in functions.exception_flow(e, calls).collect()}
    assert ("other", "error", 1) in out and not any(q == "caller" for q, _, _ in out)


def test_lisp_reader():
    a, b = lisp.read("(a 'b ?\\( \"x)\" [1 .5] #'f) ; c)\n(d")
    assert [lisp.show(i) for i in a.items] == ["a", "b", "?\\(", '"x)"', "(1 .5)", "f"] and a.items[1].quoted and b.items[0].text == "d" and lisp.read(")))") == [] and lisp.read("") == []


def test_python_cards():
    text = "import os, subprocess, shutil\ndef f(a, /, b: int = 1, *rest, key=None, **more):\n    b.x = 1\n    a.append(2)\n    more['k'] = 3\n    del rest[0]\n    a.get(1)\n    home = os.environ['HOME']\n    print(home)\n    if os.name == 'nt' or shutil.which('git'):\n        return subprocess.run(['ls', '-l'])\n    return 1\n"
    got = python_source.extract(text, "m.py")
    assert [(x["position"], x["name"], x["type"]) for x in got.parameters] == [(0, "a", "positional"), (1, "b", "positional: int = 1"), (2, "rest", "*args"), (3, "key", "keyword-only = None"), (4, "more", "**kwargs")]
    assert [(x["value"], x["constant"]) for x in got.returns] == [("subprocess.run(['ls', '-l'])", False), ("1", True)]
    assert [(x["name"], x["how"]) for x in got.mutations] == [("b", "b.x"), ("a", "append()"), ("more", "more['k']"), ("rest", "rest[0]")]
    assert {(x["rule"], x["detail"]) for x in got.findings} >= {("env-platform", "nt"), ("env-executable", "git"), ("env-executable", "ls"), ("env-read", "HOME")}


def test_exits_reach_callers(spark):
    exits = spark.createDataFrame([("die", "terminate"), ("die", "terminate"), ("jump", "longjmp")], "qname string, kind string")
    calls = spark.createDataFrame([("a", "b"), ("b", "die"), ("b", "b"), ("c", "a"), ("a", "jump"), ("die", "a")], "source string, target string")
    got = {tuple(r) for r in qs.exit_reach(exits, calls).collect()}
    assert got == {("die", "terminate", "die", 0), ("b", "terminate", "die", 1), ("a", "terminate", "die", 2), ("c", "terminate", "die", 3), ("jump", "longjmp", "jump", 0), ("a", "longjmp", "jump", 1), ("c", "longjmp", "jump", 2), ("die", "longjmp", "jump", 2), ("b", "longjmp", "jump", 3)}
    assert qs.exit_reach(exits.limit(0), calls).count() == 0


def test_settings_and_catches(spark):
    f = spark.createDataFrame([("x", "f", "env-read", 3, "HOME"), ("x", "f", "bare-except", 3, "")], "file_id string, qname string, rule string, line int, detail string")
    v = spark.createDataFrame([("x", "f", "def", "home", "assign", 3), ("x", "f", "use", "home", "read", 3), ("x", "f", "use", "home", "read", 7), ("x", "g", "use", "home", "read", 9)], "file_id string, qname string, what string, name string, how string, line int")
    assert [tuple(r) for r in qs.config_uses(f, v).collect()] == [("x", "f", "HOME", "home", 7)]
    e = spark.createDataFrame([("low", "raise", "E", 1, 1, False), ("low", "raise", "F", 2, 2, True), ("a", "guard", "E", 4, 6, True), ("b", "guard", "X", 1, 9, True)], "qname string, what string, name string, line int, end_line int, caught boolean")
    c = spark.createDataFrame([("a", "low", 5), ("a", "low", 9), ("b", "low", 5)], "source string, target string, line int")
    assert [tuple(r) for r in qs.caught_by(e, c).collect()] == [("E", "low", 3, 1)]
    p = spark.createDataFrame([("f", "def", "a", "param", 1, "0"), ("g", "def", "p", "param", 1, "0"), ("f", "flow", "a", "call_arg", 2, "g#0")], "qname string, what string, name string, how string, line int, to string")
    al = spark.createDataFrame([("g", "q", "p", 2), ("g", "r", "s[1]", 2)], "qname string, name string, target string, line int")
    assert {tuple(r) for r in functions.pointer_trace(p, al, spark.createDataFrame([("f:a",)], "node string"), 4).collect()} == {("f:a", 0), ("g:p", 1), ("g:q", 2)}


def test_exceptions_pass_bases_and_keywords(spark):
    text = "class Deep(LookupError):\n    pass\ndef low():\n    raise KeyError('x')\ndef own():\n    try:\n        raise KeyError('x')\n    except LookupError:\n        pass\ndef mid():\n    try:\n        low()\n    except LookupError:\n        return 1\ndef top():\n    low()\n"
    got = python_source.extract(text, "m.py")
    e = spark.createDataFrame([(x["qname"], x["what"], x["name"], x["line"], x["end_line"], x["caught"]) for x in got.exceptions], "qname string, what string, name string, line int, end_line int, caught boolean")
    c = spark.createDataFrame([("m.mid", "m.low", 12), ("m.top", "m.low", 16)], "source string, target string, line int")
    b = spark.createDataFrame([("KeyError", x) for x in python_source.builtin_bases("KeyError")[1:]], "name string, base string")
    assert python_source.builtin_bases("KeyError") == ("KeyError", "LookupError", "Exception", "BaseException") and python_source.builtin_bases("Deep") == ("Deep",)
    assert {(r.qname, r.distance) for r in functions.exception_flow(e, c, bases=b).collect()} == {("m.low", 0), ("m.top", 1)}
    assert {(r.qname, r.distance) for r in functions.exception_flow(e, c).collect()} == {("m.low", 0), ("m.top", 1), ("m.mid", 1)}
    text = "class A:\n    def __init__(self, size, label=None):\n        self.size = size\ndef make(n, name):\n    return A(n, label=name)\n"
    rows = [(x["qname"], x["what"], x["name"], x["how"], x["line"], x["to"]) for x in python_source.extract(text, "m.py").variables]
    v = spark.createDataFrame(rows, "qname string, what string, name string, how string, line int, to string")
    assert {("m.make:n", "m.A.__init__:size"), ("m.make:name", "m.A.__init__:label")} <= {tuple(r) for r in functions.value_edges(v).collect()}
