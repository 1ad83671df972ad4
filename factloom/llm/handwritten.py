"""Files that were not written by hand in the project: generated, squeezed, copied from third parties, or data.

Method: a random forest on compression ratio, token entropy, identifier lengths and comment density, with the shape of lines
and the shares of digits and literals beside them. Its labels come from notices in comments, which are removed from the text before the features are
taken, and from names that build tools give to squeezed files, as squeezing drops all notices; the features don't see names. So it learns how such files look
rather than what they say. Copies of third-party files look hand-written; they are
found by shingles shared with the list of known files, by a notice that names a foreign origin, or by a path below a directory of
foreign code named after one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.notices import may_state_generated, states_foreign, states_generated
from factloom.session import Scratch, spread
from factloom.sources.tables import latest_files, normal_path

FEATURES = [
    "compression", "entropy", "ident_mean", "ident_sd", "ident_short", "ident_distinct", "comment_share", "line_mean", "line_sd", "line_max",
    "digit_share", "literal_share", "same_shape", "top_shape", "indent_share", "blank_share", "symbol_share", "data_share", "size",
]

_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|#x[0-9A-Fa-f]+|[^\w\s]")
#: The same for texts of ASCII characters only, of which \x1c to \x1f are blanks too.
_ASCII_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|#x[0-9A-Fa-f]+|[^\w\s\x1c-\x1f]", re.A)
_ASCII_BLANKS = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: ASCII letters and underscores to a, digits to 9.
_ASCII_SHAPE = bytes(97 if chr(i).isalpha() or i == 95 else 57 if chr(i).isdigit() else i for i in range(128)) + bytes(128)
_IDENT = re.compile(r"[A-Za-z_]\w*")
_NUMBER = re.compile(r"\d+")
#: Repeated items of a list, such as numbers with their commas.
_RUN = re.compile(r"([-+]?[\"a9.]+[,;:]? *)\1+")
_COMMENT = {
    "hash": re.compile(r"(?m)^[ \t]*#(?!include|define|if|endif|else|elif|undef|pragma|line|error)[^\n]*|^[ \t]*[rRuU]?(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})"),
    "semi": re.compile(r"\"(?:\\[\s\S]|[^\"\\])*\"|;[^\n]*"),
    "slash": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/"),
}
#: Each branch begins with a single character and no loop has branches, which re runs through several times faster.
_LITERAL = re.compile(r"""\"\"\"[\s\S]*?\"{3}|'''[\s\S]*?'{3}|\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`]*`""")
_HEAD_LINE = re.compile(r"^\s*(?:#(?!include|define|if|endif|pragma|line\b)|//|;|/?\*|\*/|<!--|\"{3}|'{3}|$)")

#: Comments and what may hold their marks without being one.
_LEX = {
    "hash": re.compile(r"#[^\n]*|\"{3}(?:\\[\s\S]|(?!\"{3})[^\\])*(?:\"{3}|\Z)|'{3}(?:\\[\s\S]|(?!'{3})[^\\])*(?:'{3}|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\[\s\S]|[^'\\\n])*'?"),
    "semi": re.compile(r";[^\n]*|\"(?:\\[\s\S]|[^\"\\])*(?:\"|\Z)|\?\\?[^\s\w]"),
    "slash": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|R\"([^()\\\s\"]{0,16})\([\s\S]*?(?:\)\1\"|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*\"?|(?<![0-9A-Za-z_])'(?:\\[\s\S]|[^'\\\n])*'?|`[^`]*(?:`|\Z)"),
}


def family(path: str) -> str:
    ext = path.rsplit(".", 1)[-1].lower()
    return "hash" if ext in ("py", "pyi", "sh", "rb", "yaml", "yml", "toml") else "semi" if ext in ("el", "org", "lisp", "scm") else "slash"


def ends(text: str) -> tuple[list[str], list[str], list[str]]:
    """(comment lines at the start, lines between, comment lines at the end)."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿").split("\n")
    a, b = 0, len(lines)
    while a < b and _HEAD_LINE.match(lines[a]):
        a += 1
    while b > a and _HEAD_LINE.match(lines[b - 1]):
        b -= 1
    return lines[:a], lines[a:b], lines[b:]


def stated(lines: list[str], kind: str) -> set[int]:
    """The lines, of those that are comments as a whole and outside strings, which state that a program wrote the file."""
    near = [i for i, x in enumerate(lines) if states_generated(x)]
    if not near:
        return set()
    text, found, at, line = "\n".join(lines), set(), 0, 0
    for m in _LEX[kind].finditer(text):
        if m.group()[0] not in "#;/":
            continue
        a, b = m.span()
        line, at = line + text.count("\n", at, a), a
        if not text[text.rfind("\n", 0, a) + 1 : a].strip() and not text[b : text.find("\n", b) if "\n" in text[b:] else len(text)].strip():
            found.update(range(line, line + m.group().count("\n") + 1))
    return found & set(near)


def _looks_like_data(literal: str) -> bool:
    """Whether a string holds a payload rather than words: long without a blank, or rows of values."""
    body = literal.strip("\"'`")
    if len(body) < 16:
        return False
    blanks = body.count(" ") + body.count("\n")
    if blanks * 16 <= len(body) and "/" not in body[:8]:
        return not body.replace("_", "").replace("-", "").replace(".", "").isalpha() or len(body) > 120
    return "\n" in body and sum(c.isdigit() for c in body) >= 0.2 * len(body)


def code_of(lines: list[str], kind: str) -> tuple[str, list[str]]:
    """The text of lines without comments, and its tokens."""
    text = "\n".join(lines)
    code = _COMMENT[kind].sub((lambda m: m.group() if m.group()[0] == '"' else " ") if kind == "semi" else " ", text)
    return code, (_ASCII_TOKEN if code.isascii() else _TOKEN).findall(code)


def _shaped(text: str) -> str:
    """The text with every identifier as a and every number outside identifiers as 9."""
    if not text.isascii():
        return _NUMBER.sub("9", _IDENT.sub("a", text))
    x = np.frombuffer(text.encode().translate(_ASCII_SHAPE), np.uint8)
    letter, digit = x == 97, x == 57
    word = letter | digit
    after = np.zeros(len(x), bool)
    after[1:] = word[:-1]
    keep = ~(word & after)
    inner = np.flatnonzero(letter[1:] & digit[:-1]) + 1  # an identifier begins here where only digits come before it
    if len(inner):
        first = np.maximum.accumulate(np.where(word & ~after, np.arange(len(x)), 0))[inner]
        seen = np.cumsum(letter)
        keep[inner[digit[first] & (seen[inner] - seen[first] == 1)]] = True
    return x[keep].tobytes().decode("ascii")


def _shapes(lines: list[str]) -> Counter[str]:
    """How often lines have each shape. No repeated item reaches over a line, so lines of one form are looked at once."""
    plain = [x for x in lines if x.isascii()]
    forms = Counter(_shaped("\n".join(plain)).split("\n")) if plain or not lines else Counter()
    if len(plain) < len(lines):
        forms.update(_shaped("\n".join(x for x in lines if not x.isascii())).split("\n"))
    shapes: Counter[str] = Counter()
    for shape, c in zip(_RUN.sub(r"\1", "\n".join(forms)).split("\n"), forms.values()):
        shapes[shape.strip()] += c
    return shapes


def _unblank(text: str) -> int:
    """The number of characters that are no blanks."""
    return len(text.encode().translate(None, _ASCII_BLANKS)) if text.isascii() else len("".join(text.split()))


def features(lines: list[str], code: str, tokens: list[str], counts: Counter[str] | None = None) -> list[float]:
    """The values of FEATURES for the lines of a file without its notices; code and tokens are theirs without comments, counts the tokens' if known."""
    text = "\n".join(lines)
    n = max(1, len(text))
    m = max(1, len(tokens))
    counts = Counter(tokens) if counts is None else counts
    entropy, distinct, numbers, figures = 0.0, 0, 0, 0
    widths: dict[int, int] = {}
    bits = {c: c * math.log2(c / m) for c in set(counts.values())}
    for t, c in counts.items():
        entropy -= bits[c]
        first = t[0]
        if first.isalpha() or first == "_":
            k = len(t)
            widths[k] = widths.get(k, 0) + c
            distinct += 1
        elif first.isdigit() or t[:2] == "#x":
            numbers += c * len(t)
            figures += c
    total, whole, squares = (sum(c * k**i for k, c in widths.items()) for i in range(3))
    short = widths.get(1, 0) + widths.get(2, 0)
    symbols = m - total - figures
    total = max(1, total)
    mean = whole / total
    raw = text.encode("utf-8", "replace")
    full = [x for x in lines if x.strip()]
    k = max(1, len(full))
    lengths = np.fromiter(map(len, full), np.float64, len(full)) if full else np.zeros(1)
    line_mean = float(lengths.sum()) / k
    shapes = _shapes(full)
    strings = _LITERAL.findall(code)
    data = [x for x in strings if _looks_like_data(x)]
    outside = numbers - sum(map(len, _NUMBER.findall("\n".join(strings))))
    return [
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        entropy / m,
        mean,
        math.sqrt(max(0.0, squares / total - mean**2)),
        short / total,
        distinct / total,
        1 - _unblank(code) / max(1, _unblank(text)),
        math.log1p(line_mean),
        math.log1p(math.sqrt(max(0.0, float((lengths**2).sum()) / k - line_mean**2))),
        math.log1p(float(lengths.max())),
        numbers / n,
        (sum(map(len, strings)) + max(0, outside)) / n,
        len(shapes) / k,
        max(shapes.values(), default=0) / k,
        sum(1 for x in full if x[0] in " \t") / k,
        1 - len(full) / max(1, len(lines)),
        symbols / m,
        (sum(map(len, data)) + max(0, outside)) / max(1, len(code)),
        math.log1p(n),
    ]


# -- shingles of known third-party files -----------------------------------------------------------------------------

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 2
_GOLDEN, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_MIX = np.random.default_rng(20240501).integers(1, 2**63, size=(BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def shingles(tokens: list[str], distinct: Iterable[str] | None = None) -> np.ndarray:
    """Distinct hashes, in order, of the five-word shingles of a text's tokens; of shorter texts, one of all words. distinct: the distinct tokens, if known."""
    # 0 marks what is no word; a word whose hash is 0 counts as 1
    ids = {t: (zlib.crc32(t.encode("utf-8", "replace")) or 1) if t[0].isalnum() or t[0] == "_" else 0 for t in (set(tokens) if distinct is None else distinct)}
    a = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    a = a[a > 0].view(np.uint64)
    if not len(a):
        return np.zeros(0, np.uint64)
    k = min(SHINGLE, len(a))
    h = np.zeros(len(a) - k + 1, np.uint64)
    for i in range(k):
        h *= _GOLDEN
        h += a[i : len(a) - k + 1 + i]
        h ^= h >> _SHIFT
    h.sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def bands(sh: np.ndarray) -> list[int]:
    """Keys of the bands of a MinHash signature: texts of similarity 0.8 share one with probability 1 - (1 - 0.8**2)**16, over 0.9999999."""
    if not len(sh):
        return []
    h, low = sh * _MIX[:, :1], sh * _MIX[:, 1:]
    low >>= np.uint64(31)
    h ^= low
    low = h.min(axis=1).reshape(BANDS, ROWS)
    keys = low[:, 0] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (low[:, 1] + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


# -- the operator ----------------------------------------------------------------------------------------------------

#: Names that build tools give to their output, as a second source of labels: what squeezes a file drops its notices.
_OUTPUT_NAME = re.compile(r"(?i)(?:[.-](?:min|bundle|packed)\.\w+$|\.pb\.\w+$|_pb2\.py$|\.tab\.\w+$|(?:^|/)(?:lex\.|moc_|zz_generated|loaddefs-)[^/]*$|_stubs\.py$|-autoloads\.el$)")
#: Directories that by convention hold foreign code.
_FOREIGN_DIR = re.compile(r"(?i)(?:^|/)(?:(?:_?vendors?|third[_-]?party|3rdparty|external|extern|node_modules|contrib|deps)/)+([^/]+)/")
#: Labelled rows that the forest is fitted on, at most; all files are classified.
LABELLED_ROWS = 20_000
TREES, DEPTH, SEED = 40, 10, 11
LEAST_PROBABILITY = 0.1

_SEEN = "file_id string, features array<double>, bands array<long>, label int, notice boolean, origin string, below string, blank boolean"


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in _SEEN.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for i, path, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            path, kind = path or "", family(path or "")
            head, body, tail = ends(text)
            first = [x for x in head if x.strip()]
            hinted = may_state_generated(text)
            notice = hinted and (any(map(states_generated, first)) or any(map(states_generated, tail)))
            said = stated([*head, *body, *tail], kind) if hinted else set()
            notice = notice or bool(said)
            body = [x for k, x in enumerate(body, len(head)) if k not in said]
            origin = next((o for x in first if (o := states_foreign(x))), None)
            code, tokens = code_of(body, kind)
            counts = Counter(tokens)
            f = features(body, code, tokens, counts)
            m = _FOREIGN_DIR.search(path)
            if notice or _OUTPUT_NAME.search(path):  # neither can be seen in the features
                label = 1
            else:
                label = 0 if first and not origin else None
            for column, v in zip(out, (i, f, bands(shingles(tokens, counts)), label, notice, origin, m.group(1).lower() if m else None, not text.strip())):
                column.append(v)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, known = [], {}
        for i, path, text, ref, ref_path, ref_text in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if ref not in known:
                known[ref] = shingles(code_of(ends(ref_text)[1], family(ref_path or ""))[1])
            if similarity(shingles(code_of(ends(text)[1], family(path or ""))[1]), known[ref]) >= SIMILARITY:
                found.append(i)
        yield pa.record_batch([pa.array(found, pa.string())], names=["file_id"])


def _forest(seen: DataFrame) -> DataFrame:
    """(file_id, squeezed_or_written): the forest's probability for every file; of tables without both labels, the labels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    labelled = seen.where(F.col("label").isNotNull()).select(F.col("label").cast("double").alias("label"), "features", F.xxhash64("file_id").alias("o"))
    sample = labelled.orderBy("o", "label").limit(LABELLED_ROWS)
    both = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(both) < 2:
        return seen.select("file_id", F.coalesce(F.col("label"), F.lit(0)).cast("double").alias("probability"))
    weight = F.when(F.col("label") == 1, F.lit(max(1.0, min(5.0, both[0.0] / both[1.0] / 2)))).otherwise(F.lit(1.0))
    train = sample.select("label", array_to_vector("features").alias("features"), weight.alias("w")).coalesce(4)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=2, seed=SEED, weightCol="w", featureSubsetStrategy="sqrt")
    model = forest.fit(train)
    scored = model.transform(seen.select("file_id", array_to_vector("features").alias("features")))
    return scored.select("file_id", vector_to_array("probability")[1].alias("probability"))


def origins(files: DataFrame, texts: DataFrame, upstream: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(file_id, probability, written_by_program, known_copy, foreign) of every file with a text.

    probability is the forest's, that a file was generated, squeezed or is data; written_by_program is what a notice in any whole-line
    comment states; known_copy, that it has a five-word shingle similarity of 0.8 or more to a file of ``upstream``, comments aside; foreign, that
    a notice names another origin than a project of ``projects``, or that it lies below a directory of foreign code and then one named
    after an origin that such notices or ``upstream`` name. Empty and blank texts are hand-written; null contents have no row.
    """
    scratch = Scratch(files.sparkSession, "handwritten")
    f = latest_files(files).select("file_id", "path")
    t = spread(texts.where(F.col("file_id").isNotNull()).select("file_id", "content"), "file_id").groupBy("file_id").agg(F.max("content").alias("content"))
    both = spread(f, "file_id").join(t.where(F.col("content").isNotNull()), "file_id").select("file_id", "path", "content")
    seen = scratch.save(both.mapInArrow(_look, _SEEN))
    probability = _forest(seen)

    up = upstream.where(F.col("content").isNotNull()).select(F.concat_ws("\u0001", F.col("upstream_id").cast("string"), normal_path(F.col("relative_path"))).alias("ref"), normal_path(F.col("relative_path")).alias("ref_path"), F.col("content").alias("ref_text"), F.lower(F.trim("upstream_name")).alias("name"))
    up = up.dropDuplicates(["ref_text"])
    refs = up.select(F.col("ref").alias("file_id"), F.col("ref_path").alias("path"), F.col("ref_text").alias("content")).mapInArrow(_look, _SEEN).select(F.col("file_id").alias("ref"), F.explode("bands").alias("band"))
    near = scratch.save(seen.select("file_id", F.explode("bands").alias("band")).join(refs, "band").select("file_id", "ref").distinct())
    # only the texts of candidates are read again; their ids come from a written table, whose size decides between broadcast and shuffle
    few = texts.where(F.col("content").isNotNull()).select("file_id", "content").join(near.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.max("content").alias("content"))
    pairs = near.join(f, "file_id").join(few, "file_id").join(up, "ref").select("file_id", "path", "content", "ref", "ref_path", "ref_text")
    copies = pairs.mapInArrow(_compare, "file_id string").distinct().withColumn("known_copy", F.lit(True))

    own = None if projects is None else projects.select(F.lower(F.trim("name")).alias("origin")).where(F.col("origin").isNotNull()).distinct()
    named = seen.where(F.col("origin").isNotNull()).select("origin", "file_id")
    if own is not None:
        named = named.join(own, "origin", "left_anti")
    names = named.select("origin").union(up.select(F.col("name").alias("origin"))).where(F.col("origin").isNotNull()).distinct()
    below = seen.where(F.col("below").isNotNull()).select("file_id", F.col("below").alias("origin")).join(names, "origin", "left_semi").select("file_id")
    foreign = named.select("file_id").union(below).distinct().withColumn("foreign", F.lit(True))

    out = seen.select("file_id", "blank", F.col("notice").alias("written_by_program")).join(probability, "file_id").join(copies, "file_id", "left").join(foreign, "file_id", "left")
    no = F.lit(False)
    return out.select("file_id", F.when(F.col("blank"), 0.0).otherwise(F.col("probability")).alias("probability"), "written_by_program", F.coalesce("known_copy", no).alias("known_copy"), F.coalesce("foreign", no).alias("foreign"))


def not_handwritten(files: DataFrame, texts: DataFrame, upstream: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(file_id): the files that no one wrote by hand in the project, each once."""
    o = origins(files, texts, upstream, projects)
    return o.where((F.col("probability") >= LEAST_PROBABILITY) | F.col("written_by_program") | F.col("known_copy") | F.col("foreign")).select("file_id").distinct()
