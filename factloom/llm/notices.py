"""Notices by which files say how they came about."""

from __future__ import annotations

import re

#: Phrases of notices that a program wrote the file. A line must be the notice itself, not a sentence about such notices.
GENERATED = re.compile(
    r"""(?ix)
    ^\W*(?:code\s+)?(?:auto(?:matically)?[ -]?generated)\b(?!.*\b(?:below|above)\b.*\bsays\b)
    |^\W*code\s+generated\s+by\b
    |^\W*@generated\b
    |^\W*(?:this\s+file\s+(?:is|was)\s+)(?:machine[ -]written|(?:auto(?:matically)?[ -]?)?generated)\b
    |^\W*generated\s+(?:by|from|with)\b
    |^\W*(?:output|produced)\s+(?:of|by)\s+\S+(?:\s+[\d.]+)?(?:\s+\(input:|\s+on\s+each\s+build)
    |^\W*source:\s*\S+\.\w+\s*$
    |^\W*automatisch\s+(?:erzeugt|generiert)\b
    |^\W*fichier\s+(?:produit|généré)\s+(?:par|automatiquement)\b
    |^\W*(?:archivo|fichero)\s+generado\b|^\W*generado\s+(?:por|automáticamente)\b
    |^\W*このファイルは.*自動生成
    |^\W*(?:自動生成|自动生成)
    """
)

#: Parts of words of which each notice above has one.
_HINTS = ("generate", "generado", "erzeugt", "generiert", "machine written", "machine-written", "output", "produ", "source:", "généré", "自動生成", "自动生成")

#: Phrases of notices that a file was taken from elsewhere; the group is the name of the origin, if stated.
FOREIGN = [
    re.compile(r"(?i)^\W*vendored\s+from\s+(?P<of>[\w.+-]+)"),
    re.compile(r"(?i)^\W*this\s+file\s+is\s+part\s+of\s+(?P<of>[\w.+-]+?),?\s+imported\b"),
    re.compile(r"(?i)^\W*(?P<of>[\w.+-]+):\s+upstream\s+version\b"),
    re.compile(r"(?i)^\W*\(c\)\s+the\s+(?P<of>[\w.+-]+)\s+contributors\b"),
    re.compile(r"(?i)^\W*(?P<of>[\w.+-]+)\s+v?\d+(?:\.\d+)+\s+-\s+released\s+under\b"),
    re.compile(r"(?i)^\W*(?:imported|copied|taken|adapted)\s+(?:unchanged\s+|verbatim\s+)?from\s+(?P<of>[\w.+-]+)"),
    re.compile(r"(?i)^\W*(?P<of>[\w.+-]+)\s+v\d+(?:\.\d+)+\b.*\b(?:license|licence)"),
]


def may_state_generated(text: str) -> bool:
    """Whether a text has a line of which states_generated can be true; cheaper than asking it of every line."""
    low = text.lower()
    return any(h in low for h in _HINTS)


def states_generated(line: str) -> bool:
    return bool(GENERATED.search(line.strip()))


def states_foreign(line: str) -> str | None:
    """The origin that a notice names in lower case; None if the line is no such notice."""
    for p in FOREIGN:
        m = p.search(line.strip())
        if m:
            return m.group("of").lower().rstrip(".")
    return None
