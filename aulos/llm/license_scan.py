"""License scans: Aho-Corasick finds tags and phrases, a shunting-yard parser reads expressions.

Words are runs of ASCII letters and digits and of all bytes beyond ASCII, after A-Z are
lower-cased. The automaton runs over the words joined by single spaces, so a phrase matches
only whole consecutive words. A second pattern set in the same style finds the identifier tag in
the raw text; the rest of its line is read as an expression of identifiers, AND, OR, WITH and
brackets, turned to postfix by the shunting-yard method and evaluated against the two lists
below. Every whole text is scanned; nothing is cut or sampled.

Nulls count as empty texts. Texts without words have n_words 0, no labels and score 0. Repeated
rows are scanned one by one, empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed by the contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method itself.
NOTICES = {
    "mit license": "mit", "apache license": "apache", "bsd license": "bsd", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "creative commons": "cc",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
}
TAG = b"spdx-license-identifier:"
#: Identifiers (prefixes, lower case) that allow reuse, and those that restrict it.
OPEN = ("mit", "apache", "bsd", "isc", "cc0", "cc-by-4", "cc-by-3", "unlicense", "zlib", "mpl", "0bsd")
CLOSED = ("cc-by-nc", "cc-by-nd", "proprietary", "licenseref", "gpl", "agpl", "lgpl", "cc-by-sa")

_WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str]:
    """Identifiers and operators in postfix order; raises ValueError when it isn't an expression."""
    out, stack, want = [], [], True
    for token in re.findall(r"[()]|[^\s()]+", expression.lower()):
        if token == "(":
            if not want:
                raise ValueError(expression)
            stack.append(token)
        elif token == ")":
            if want:
                raise ValueError(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError(expression)
            stack.pop()
        elif token in _PRECEDENCE:
            if want:
                raise ValueError(expression)
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            want = True
        else:
            if not want or not re.fullmatch(r"[a-z0-9.+-]+", token):
                raise ValueError(expression)
            out.append(token)
            want = False
    if want or "(" in stack:
        raise ValueError(expression)
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[str, float]:
    """(normalised text, openness): AND takes the least, OR the most, WITH keeps its left side."""
    stack: list[tuple[str, float]] = []
    for token in postfix:
        if token in _PRECEDENCE and len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            value = {"and": min(left[1], right[1]), "or": max(left[1], right[1]), "with": left[1]}[token]
            stack.append((f"({left[0]} {token} {right[0]})" if token != "with" else f"{left[0]} with {right[0]}", value))
        else:
            stack.append((token, 0.0 if token.startswith(CLOSED) else 1.0 if token.startswith(OPEN) else 0.5))
    return stack[-1]


def read_expression(rest: str) -> tuple[str, float] | None:
    """The longest leading run of tokens that is a valid expression."""
    depth, want, end = 0, True, 0
    for found in re.finditer(r"[()]|[^\s()]+", rest):
        token = found[0].lower()
        if token == "(":
            if not want:
                break
            depth += 1
        elif token == ")":
            if want or not depth:
                break
            depth -= 1
        elif token in _PRECEDENCE:
            if want:
                break
            want = True
        elif not want or not re.fullmatch(r"[a-z0-9.+-]+", token):
            break
        else:
            want = False
        if not want and not depth:
            end = found.end()
    return evaluate(to_postfix(rest[:end])) if end else None


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.words, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase in {**BASE, **NOTICES}:
            self.words.add_word(f" {phrase} ", phrase)
        self.tags.add_word(TAG.decode(), 1)
        self.words.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.translate(_WORD_BYTES).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        places, base, labels, openness = [], set(), set(), []
        at = word = 0  # spaces are counted on from the last hit, never again from the start
        for end, phrase in self.words.iter(line):
            if phrase in BASE:
                start = end - len(phrase) - 1
                word += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
                at = start
                places.append(word)
                base.add(BASE[phrase])
            else:
                labels.add(NOTICES[phrase])
        lowered = raw.translate(_LOWER).decode("latin-1")
        ends = [end for end, _ in self.tags.iter(lowered)] if "spdx" in lowered else []
        for end, later in zip(ends, [*ends[1:], len(raw)], strict=False):
            stop = raw.find(b"\n", end, later + 1)  # no expression runs over the next tag
            found = read_expression(raw[end + 1 : stop if stop >= 0 else later + 1].decode("utf-8", "replace"))
            if found:
                labels.add(f"spdx:{found[0]}")
                openness.append(found[1])
        every = sorted(base | labels)
        score = 1.0 - 0.5 ** len(every) if every else 0.0
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(every), score, max(openness, default=None))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, openness double"
COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "openness"]


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document; ``openness`` is the value of its most open identifier expression."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for pdf in batches:
            out = pd.DataFrame([scanner.scan(t) for t in pdf["text"]], columns=COLUMNS, index=pdf.index)
            for c in ("n_words", "n_base", "first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield pd.concat([pdf["doc_id"], out.astype({"score": "float64", "openness": "Float64"})], axis=1)

    return docs.select("doc_id", "text").mapInPandas(scan, SCHEMA)
