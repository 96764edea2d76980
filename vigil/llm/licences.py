"""Licence scans: phrases and identifier tags by Aho-Corasick, expressions by
a shunting-yard parser.

A text's words (ASCII letters lowered, runs of other ASCII characters between
words) are joined by blanks, and one automaton finds every notice phrase and
every place of an identifier tag in a single pass. For texts with a tag, the
expression that follows it on its line is read from the text itself: operators
WITH, AND, OR (binding in this order) and brackets go through a shunting-yard,
and the postfix form is evaluated to the licences named, and to whether some
choice of licences is permissive throughout. Of a line, the longest well-formed
beginning is the expression: what cannot continue it, or follows a full stop, is
other text. A line without such a beginning is malformed and names nothing.

Score: 1 with a base phrase or a well-formed tag, 0.8 with other notices only,
0.5 with a malformed tag only, else 0.

Defined cases: null text counts as empty; texts of any length are read whole;
repeated rows get equal results; an empty table gives an empty result; further
columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches

# Phrases of the contract and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices of the method.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
_TAG_LINE = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]license[^0-9a-z\x80-\U0010ffff]identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BINDING = {"or": 1, "and": 2, "with": 3}
#: Prefixes of identifiers that ask for little more than a notice.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "cc0", "unlicense", "0bsd", "cc-by-4", "cc-by-3")

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))


def beginning(expression: str) -> tuple[list[str] | None, int]:
    """Shunting-yard: identifiers and operators of the longest well-formed
    beginning in postfix order (None without one), and where it ends."""
    out: list[str] = []
    held: list[str] = []
    whole: list[str] | None = None  # postfix form of what is well-formed so far
    depth, at, until, operand = 0, 0, 0, True
    while m := _TOKEN.match(expression, at):
        word, at = m[1].rstrip(".:-"), m.end()
        low, ends = word.lower(), len(word) < len(m[1])
        if word == "(":
            if not operand:
                break
            held.append(word)
            depth += 1
        elif word == ")":
            if operand or not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        elif low in _BINDING:
            if operand:
                break
            while held and held[-1] != "(" and _BINDING[held[-1]] >= _BINDING[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        else:
            if not operand:
                break
            out.append(low)
            operand = False
        if not operand and not depth:
            whole, until = out + held[::-1], m.start(1) + len(word)
        if ends:
            break
    return whole, until


def postfix(expression: str) -> list[str] | None:
    """The postfix order of an expression that is well-formed as a whole, or None."""
    text = expression.strip().rstrip("*/-> \t")
    rpn, until = beginning(text)
    return rpn if until == len(text) else None


def evaluate(rpn: list[str]) -> tuple[set[str], bool] | None:
    """Licences named, and whether a choice is permissive throughout. The right
    side of WITH is an exception: it names no licence and takes nothing away."""
    stack: list[tuple[set[str], bool, bool]] = []  # licences, permissive, single name
    for word in rpn:
        if word not in _BINDING:
            stack.append(({word}, word.startswith(PERMISSIVE), True))
            continue
        b, a = stack.pop(), stack.pop()
        if word == "with":
            if not (a[2] and b[2]):
                return None
            stack.append((a[0], a[1], False))
        else:
            both = a[1] and b[1] if word == "and" else a[1] or b[1]
            stack.append((a[0] | b[0], both, False))
    return stack[0][:2]


def tags(text: str) -> tuple[set[str], bool, bool, bool]:
    """Of all tags of a text: licences, any well-formed, any malformed, all
    well-formed ones permissive."""
    named: set[str] = set()
    good = bad = False
    free = True
    for m in _TAG_LINE.finditer(text):
        rpn, _ = beginning(m[1])
        found = evaluate(rpn) if rpn else None
        if found is None:
            bad = True
            continue
        good = True
        named |= found[0]
        free &= found[1]
    return named, good, bad, good and free


def automaton():
    """Phrases (blank before and behind) and the tag, over Latin-1 text."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (kind, label, len(phrase.split())))
    a.make_automaton()
    return a


def scan(raw: bytes, a) -> tuple:
    words = raw.translate(_WORDS).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    first = last = None
    base, more = set(), set()
    tagged, n, seen, read = False, 0, 0, 0
    for end, (kind, label, size) in a.iter(line):
        if kind == "tag":
            tagged = True
            continue
        if kind == "base":
            base.add(label)
            seen, read = seen + line.count(" ", read, end + 1), end + 1  # ends only grow
            start = seen - size - 1
            n += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
        more.add(label)
    good = bad = free = False
    if tagged:
        named, good, bad, free = tags(raw.decode("utf-8", "replace"))
        more |= named
    score = 1.0 if base or good else 0.8 if more else 0.5 if bad else 0.0
    return (len(words), n, first, last,
            ",".join(sorted(base)), ",".join(sorted(more)), score, free if good else None)


FOUND = [("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()),
         ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()),
         ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()),
         ("score", T.DoubleType(), pa.float64()), ("tag_permissive", T.BooleanType(), pa.bool_())]


def scan_texts(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) with the columns of FOUND."""
    small_batches(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    inner = [T.StructField(f"c{i}_", docs.schema[c].dataType) for i, c in enumerate(carry)]
    schema = T.StructType(inner + [T.StructField(f"x{i}_", k) for i, (_, k, _) in enumerate(FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            found = [scan(t.as_py() or b"", a) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array([r[i] for r in found], kind)
                                      for i, (_, _, kind) in enumerate(FOUND)], names=schema.names)

    out = docs.select(*[F.col(c).alias(f.name) for c, f in zip(carry, inner)],
                      F.col(text_col).cast("binary").alias("x_text")).mapInArrow(run, schema)
    return out.toDF(*carry, *[free_name(carry, n) for n, _, _ in FOUND])
