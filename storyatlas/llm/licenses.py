"""Licence scans: identifier tags and notice phrases found by Aho-Corasick automata.

Texts are lower-cased (A-Z) and reduced to words.  One pass of an automaton over
the words finds notice phrases and tells whether a tag stands there that announces
a licence expression.  Then a second automaton over the text itself finds the tags
and the identifiers behind them, and a shunting-yard parser evaluates the
expression: what is joined by ``and`` holds together, of what is joined by ``or``
the less restrictive side is taken, and ``with`` adds an exception to a licence,
which makes a copyleft licence a weak one.  The labels are those of the value.

All work is linear in the text, but for merging small sets of names into larger ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import chunks

# Phrases (as words) and the labels they stand for.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license version 2": "epl-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "boost software license version 1 0": "bsl-1",
}
TAG = "spdx license identifier"
# Identifiers in expressions and the labels they stand for; others stand for themselves.
IDENTIFIERS = {
    "mit": "mit",
    "apache-2.0": "apache-2",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-sa-4.0": "cc-by-sa",
    "cc-by-nd-4.0": "cc-by-nd",
    "cc0-1.0": "cc0",
    "gpl-2.0": "gpl-2",
    "gpl-2.0-only": "gpl-2",
    "gpl-2.0-or-later": "gpl-2",
    "gpl-3.0": "gpl-3",
    "gpl-3.0-only": "gpl-3",
    "gpl-3.0-or-later": "gpl-3",
    "lgpl-2.1": "lgpl-2.1",
    "lgpl-3.0": "lgpl-3",
    "agpl-3.0": "agpl-3",
    "mpl-2.0": "mpl-2",
    "epl-2.0": "epl-2",
    "bsd-2-clause": "bsd",
    "bsd-3-clause": "bsd",
    "isc": "isc",
    "bsl-1.0": "bsl-1",
    "unlicense": "public-domain",
}

# Identifiers of the public list that have neither a digit nor a hyphen, as they are written there.
PLAIN_IDENTIFIERS = frozenset(
    [
        "Abstyles", "ADSL", "Afmparse", "AMDPLPA", "AML", "AMPAS", "Artistic", "Bahyph", "Barr", "Beerware", "Borceux", "Caldera", "CATOSL",
        "ClArtistic", "Condor", "Crossword", "CrystalStacker", "Cube", "curl", "diffmark", "DOC", "Dotseqn", "DSDP", "dvipdfm", "eGenix", "Entessa",
        "EUDatagrid", "Eurosym", "Fair", "FSFAP", "FSFUL", "FTL", "Giftware", "Glide", "Glulxe", "gnuplot", "HaskellReport", "HPND", "ICU", "IJG",
        "ImageMagick", "iMatix", "Intel", "IPA", "ISC", "JasPer", "JSON", "Leptonica", "LGPLLR", "Libpng", "libtiff", "MakeIndex", "MirOS", "MIT",
        "Motosoto", "MTLL", "Multics", "Mup", "Naumen", "NCSA", "Newsletr", "NGPL", "NLPL", "Nokia", "NOSL", "Noweb", "NRL", "NTP", "OCLC",
        "OGTSL", "OML", "OpenSSL", "Plexus", "PostgreSQL", "psfrag", "psutils", "Qhull", "Rdisc", "RPSL", "RSCPL", "Ruby", "Saxpath", "SCEA",
        "Sendmail", "SimPL", "SISSL", "Sleepycat", "SMLNJ", "SNIA", "SWL", "TCL", "TMate", "TOSL", "Unlicense", "UPL", "Vim", "VSL", "Wsuipa",
        "WTFPL", "Xerox", "Xnet", "xpp", "XSkat", "Zed", "Zlib",
    ]
)

# How much a licence restricts, by label; other names come last.
TERMS = ("free", "permissive", "weak copyleft", "copyleft", "restricted", "unknown")
_RESTRICTS = {
    "public-domain": 0, "cc0": 0,
    "mit": 1, "apache-2": 1, "bsd": 1, "isc": 1, "bsl-1": 1,
    "lgpl-2.1": 2, "lgpl-3": 2, "mpl-2": 2, "epl-2": 2,
    "gpl-2": 3, "gpl-3": 3, "agpl-3": 3, "cc-by-sa": 3,
    "cc-by-nc": 4, "cc-by-nd": 4,
}

_TAG = "spdx-license-identifier:"
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.+-")
_BINDING = {"or": 1, "and": 2, "with": 3}


def restricts(label: str) -> int:
    """The place of a label in TERMS; an exception behind ``-with-`` makes a copyleft licence a weak one."""
    base, _, exception = label.partition("-with-")
    rank = _RESTRICTS.get(base, len(TERMS) - 1)
    return 2 if exception and rank == 3 else rank


@dataclass
class Value:
    """What an expression comes to: its labels, how much they restrict, and all licences that it names."""

    labels: set[str]
    rank: int
    named: set[str]

    @staticmethod
    def of(label: str) -> Value:
        return Value({label}, restricts(label), {label})


def _joined(a: set[str], b: set[str]) -> set[str]:
    """Their union, in the larger of the two."""
    if len(a) < len(b):
        a, b = b, a
    a |= b
    return a


def _applied(op: str, a: Value, b: Value) -> Value:
    if op == "with":  # the exception is no licence itself
        if len(a.labels) == 1:
            return Value.of(f"{next(iter(a.labels))}-with-{next(iter(b.labels))}")
        return a
    if op == "and":
        return Value(_joined(a.labels, b.labels), max(a.rank, b.rank), _joined(a.named, b.named))
    taken = b if b.rank < a.rank else a
    return Value(taken.labels, taken.rank, _joined(a.named, b.named))


def is_identifier(word: str) -> bool:
    """Whether a word names a licence: by a known name, or as no word of prose is written (a digit, a hyphen inside, two capitals)."""
    name = word.rstrip(".+")
    lower = name.lower()
    if lower in IDENTIFIERS or word in IDENTIFIERS or name in PLAIN_IDENTIFIERS:
        return True
    return any(c.isdigit() for c in name) or "-" in name.strip("-") or sum(c.isupper() for c in name) > 1


def evaluate(tokens: Iterator[str]) -> Value | None:
    """The value of a licence expression, by a shunting-yard parser.

    ``with`` binds most, then ``and``, then ``or``; operands of a kind group from the
    left.  A licence must be an identifier (``is_identifier``); an exception may be
    any word that the expression ends with.  Reading ends before the first token that cannot
    follow, so prose behind the expression does no harm, and an operator without a
    right side is dropped; None if no operand was read.
    """
    out: list[Value] = []
    stack: list[str] = []
    operand_next, depth = True, 0

    def apply() -> None:
        right, left = out.pop(), out.pop()
        out.append(_applied(stack.pop(), left, right))

    words = iter(tokens)
    following = next(words, None)
    while following is not None:
        written, following = following, next(words, None)
        token = written.lower()
        if operand_next and token == "(":
            stack.append(token)
            depth += 1
        elif operand_next:
            closed = following is None or following == ")" or following.lower() in _BINDING
            if token in _BINDING or token == ")" or not (is_identifier(written) or (closed and stack and stack[-1] == "with")):
                break
            name = token.rstrip(".")
            out.append(Value.of(IDENTIFIERS.get(name, IDENTIFIERS.get(name.rstrip("+"), name.rstrip("+")))))
            operand_next = False
        elif token in _BINDING:
            while stack and _BINDING.get(stack[-1], 0) >= _BINDING[token]:
                apply()
            stack.append(token)
            operand_next = True
        elif token == ")" and depth:
            while stack[-1] != "(":
                apply()
            stack.pop()
            depth -= 1
        else:
            break
    if operand_next:  # what is open at the end has no right side
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    while stack:
        if stack[-1] == "(":
            stack.pop()
        else:
            apply()
    return out[0] if out else None


class Scanner:
    """Finds phrases by their words, and tags with their expressions.  Built once per task."""

    def __init__(self) -> None:
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        found: dict[str, tuple[str, bool]] = {p: (label, False) for p, label in NOTICE_PHRASES.items()} | {TAG: ("", False)}
        found |= {p: (label, True) for p, label in BASE_PHRASES.items()}
        for phrase, (label, base) in found.items():
            self.phrases.add_word(f" {phrase} ", (label, base, phrase.count(" ") + 1))
        self.phrases.make_automaton()
        self.marks = ahocorasick.Automaton()
        for mark in (_TAG, *IDENTIFIERS):
            self.marks.add_word(mark, mark)
        self.marks.make_automaton()
        # bytes: A-Z lower, 0-9 a-z and those of other letters kept, all else a blank
        self.table = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

    def expressions(self, data: bytes) -> Iterator[Value]:
        """The values of the expressions behind the tags of a text."""
        written, text = data.decode("latin-1"), data.lower().decode("latin-1")
        known: dict[int, int] = {}  # where an identifier begins, and the end of the longest there
        tags: list[int] = []
        for end, mark in self.marks.iter(text):
            if mark == _TAG:
                tags.append(end + 1)
            elif tags:
                known[end + 1 - len(mark)] = end + 1
        for at, upto in zip(tags, [*(t - len(_TAG) for t in tags[1:]), len(text)], strict=True):
            ends = [e for e in (text.find("\n", at, upto), text.find("\r", at, upto)) if e >= 0]
            value = evaluate(self._tokens(written, text, at, min(ends, default=upto), known))
            if value is not None:
                yield value

    @staticmethod
    def _tokens(written: str, text: str, at: int, upto: int, known: dict[int, int]) -> Iterator[str]:
        """Identifiers as the automaton found them, and other words and brackets, as they are ``written``; ``text`` is in lower case."""
        while True:
            m = _TOKEN.search(text, at, upto)
            if m is None:
                return
            end = known.get(m.start(), m.end())
            at = end if end >= upto or text[end] not in _NAME_CHARS else m.end()
            yield written[m.start() : at]

    def scan(self, text: str) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        words = data.translate(self.table).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        base: list[str] = []
        labels: set[str] = set()
        first = last = None
        tagged = False
        seen = blanks = 0  # characters of the line up to here, and blanks among them
        for end, (label, is_base, size) in self.phrases.iter(line):
            if is_base:
                blanks += line.count(" ", seen, end + 1)
                seen = end + 1
                start = blanks - 1 - size
                first, last = start if first is None else min(first, start), start if last is None else max(last, start)
                base.append(label)
            elif label:
                labels.add(label)
            else:
                tagged = True
        named: set[str] = set()
        parsed = False
        for value in self.expressions(data) if tagged else ():
            parsed = True
            labels |= value.labels
            named |= value.named
        score = 1.0 if parsed else 0.9 if base else 0.7 if labels else 0.0
        labels |= set(base)
        terms = TERMS[max(map(restricts, labels))] if labels else None
        return len(words), len(base), first, last, ",".join(sorted(set(base))), ",".join(sorted(labels)), score, ",".join(sorted(labels | named)), terms


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, named_labels string, terms string"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, named_labels, terms for each row.

    ``labels`` are those of the base phrases, of further notices and of the values of tagged
    expressions; ``named_labels`` also has the sides of an ``or`` that were not taken; ``terms`` is the
    most restrictive kind among the labels.  NULL texts are empty and without licence (empty labels,
    score 0, NULL terms).  ``score`` is 1 where a tag's expression was parsed, .9 with a base phrase,
    .7 with another notice.  Every row of the input, repeated or not, has one row; other columns are
    ignored; an empty table gives an empty result.  No shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "named_labels", "terms"]
        for batch in chunks(batches):
            rows = [scanner.scan(t) for t in pc.fill_null(batch.column("text"), "").to_pylist()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, _OUT)
