"""License scanning: Aho-Corasick for notice phrases and identifier tags, and a
shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from parhelion.llm.decontaminate import words

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices that this scanner knows.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
}
TAG = re.compile(r"(?ai:SPDX-License-Identifier):[^\S\n]*([^\n]*)")
TAG_WORDS = "spdx license identifier"
#: Families of licences that allow everything but the removal of the notice.
PERMISSIVE = ("apache", "mit", "bsd", "isc", "cc0", "cc-by", "zlib", "unlicense", "public-domain", "0bsd")

_PART = re.compile(r"\(|\)|/|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: A family, then versions and clauses: apache-2.0, bsd-3-clause, mit-0, cc-by-4.0, cc0-1.0.
_FAMILY = re.compile(r"({})(?:-v?\d[\d.]*(?:\+|-clause|-only|-or-later)?)*".format("|".join(map(re.escape, PERMISSIVE))))
#: Words beside the base phrase that narrow a Creative Commons licence.
_NARROW = {b"nc", b"nd", b"sa", b"noncommercial", b"noderivatives", b"noderivs", b"sharealike"}
_RANK = {"or": 1, "and": 2, "with": 3}


def _automaton():
    a = ahocorasick.Automaton()
    for i, phrase in enumerate([*BASE, *MORE, TAG_WORDS]):
        a.add_word(f" {phrase} ", (i, len(phrase)))
    a.make_automaton()
    return a


def parse_expression(text: str) -> list[str] | None:
    """Reverse Polish form of the longest leading licence expression; None if there is none.

    ``with`` binds before ``and``, and that before ``or``; operators may have any case, and a
    slash is ``or``.  Text after a complete expression is ignored, also an operator that
    nothing follows; an unclosed bracket makes the whole invalid.
    """
    out: list[str] = []
    stack: list[str] = []
    done: list[str] | None = None
    operand = True
    last = 0
    for m in _PART.finditer(text):
        if text[last : m.start()].strip():
            break
        last, part = m.end(), m.group()
        low = "or" if part == "/" else part.lower()
        if operand:
            if part == "(":
                stack.append(part)
                continue
            if part == ")" or low in _RANK:
                break
            out.append(low)
            operand = False
        elif part == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
            continue
        else:
            break
        if "(" not in stack:
            done = out + stack[::-1]
    return None if "(" in stack else done


def licences(rpn: list[str]) -> set[str]:
    """The licences of an expression, without operators and exceptions."""
    stack: list[set[str]] = []
    for x in rpn:
        if x in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if x == "with" else left | right)
        else:
            stack.append({x})
    return stack.pop()


def evaluate(rpn: list[str], allowed) -> bool:
    """Whether the expression can be met with allowed licences; an exception keeps its licence's answer."""
    stack: list[bool] = []
    for x in rpn:
        if x in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(a if x == "with" else a and b if x == "and" else a or b)
        else:
            stack.append(bool(allowed(x)))
    return stack.pop()


def permissive(name: str) -> bool:
    """Whether an identifier is of a permissive family, whole: cc-by-4.0 is, cc-by-nc-4.0 and mitre are not."""
    return bool(_FAMILY.fullmatch(name))


class Scanner:
    """Holds the automaton of one worker."""

    def __init__(self):
        self.automaton = _automaton()
        self.labels = [*BASE.values(), *MORE.values()]

    def scan(self, text: str | None) -> dict:
        """Words, base places (first words), labels, expressions, allowed and score of a text."""
        w = words(text)
        line = (b" " + b" ".join(w) + b" ").decode("latin-1") if w else ""
        places, labels, expressions, ends = [], set(), [], None
        tagged = False
        for end, (i, size) in self.automaton.iter(line):
            if i == len(self.labels):
                tagged = True
                continue
            if i < len(BASE):
                if ends is None:
                    ends = [k for k, c in enumerate(line) if c == " "]
                places.append((bisect_right(ends, end - size - 1) - 1, self.labels[i]))
            labels.add(self.labels[i])
        base = {x for _, x in places}
        if tagged:
            for m in TAG.finditer(text):
                rpn = parse_expression(m.group(1))
                if rpn:
                    expressions.append(" ".join(rpn))
                    labels |= licences(rpn)
        narrow = any(lab == "cc-by" and _NARROW & set(w[p + 2 : p + 5]) for p, lab in places)
        allowed = [evaluate(e.split(" "), permissive) for e in expressions] or [permissive(x) and not (x == "cc-by" and narrow) for x in sorted(labels)]
        score = 1.0 if expressions else 1 - 0.25 ** len(labels)
        return {"n_words": len(w), "n_base": len(places), "first_word": min((p for p, _ in places), default=None), "last_word": max((p for p, _ in places), default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": score if labels else 0.0, "permissive": all(allowed) if allowed else None, "expressions": expressions}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and the fields of ``Scanner.scan``.

    Null and empty texts have no words and empty labels; ``permissive`` is null without
    a licence; ``expressions`` are the tags' expressions in reverse Polish order.
    """
    fields = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_()), ("expressions", pa.list_(pa.string()))])

    def run(batches):
        scanner = Scanner()
        for b in batches:
            got = pa.RecordBatch.from_pylist([scanner.scan(t) for t in b.column(1).to_pylist()], schema=fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *got.columns], names=["doc_id", *fields.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, expressions array<string>")
