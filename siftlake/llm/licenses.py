"""License scans: phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import documents, text_slices, two_columns

#: Phrases, as words, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases of notices that add labels of their own.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "common development and distribution license": "cddl",
    "server side public license": "sspl",
    "european union public licence": "eupl",
    "sil open font license": "ofl",
    "python software foundation license": "psf",
    "open software license": "osl",
    "academic free license": "afl",
    "artistic license": "artistic",
    "postgresql license": "postgresql",
    "openssl license": "openssl",
    "zlib license": "zlib",
    "zlib libpng license": "zlib",
    "the origin of this software must not be misrepresented": "zlib",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "do what the fuck you want to public license": "wtfpl",
    "business source license": "busl",
    "creative commons zero": "cc0",
    "open database license": "odbl",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How sure a base phrase, a notice and a readable expression make a licence.
WEIGHTS = {"base": 0.7, "notice": 0.5, "tag": 0.9}
#: SPDX identifiers by family, as patterns of whole identifiers in lower case; all others are `other`.
FAMILIES = {
    "gpl": r"gpl-(1\.0|2\.0|3\.0)",
    "lgpl": r"lgpl-(2\.0|2\.1|3\.0)",
    "agpl": r"agpl-(1\.0|3\.0)",
    "gfdl": r"gfdl-1\.[123](-invariants|-no-invariants)?",
    "apache": r"apache-(1\.0|1\.1|2\.0)",
    "mit": r"mit|mit-0|mit-advertising|mit-cmu|mit-enna|mit-feh|mit-festival|mit-modern-variant|mit-open-group|mit-wu|mitnfa",
    "bsd": r"0bsd|bsd-[1234]-clause(-[a-z0-9-]+)?|bsd-protection|bsd-source-code",
    "isc": r"isc",
    "mpl": r"mpl-(1\.0|1\.1|2\.0)(-no-copyleft-exception)?",
    "epl": r"epl-(1\.0|2\.0)",
    "eupl": r"eupl-1\.[012]",
    "cddl": r"cddl-1\.[01]",
    "bsl": r"bsl-1\.0",
    "busl": r"busl-1\.1",
    "sspl": r"sspl-1\.0",
    "ofl": r"ofl-1\.[01](-no-rfn|-rfn)?",
    "artistic": r"artistic-(1\.0|2\.0)(-cl8|-perl)?",
    "psf": r"psf-2\.0|python-2\.0(\.1)?",
    "postgresql": r"postgresql",
    "openssl": r"openssl|openssl-standalone",
    "odbl": r"odbl-1\.0",
    "cc0": r"cc0-1\.0",
    "cc-by-nc": r"cc-by-nc(-nd|-sa)?-(1\.0|2\.0|2\.5|3\.0|4\.0)(-[a-z]{2,3})?",
    "cc-by-nd": r"cc-by-nd-(1\.0|2\.0|2\.5|3\.0|4\.0)(-[a-z]{2,3})?",
    "cc-by-sa": r"cc-by-sa-(1\.0|2\.0|2\.1|2\.5|3\.0|4\.0)(-[a-z]{2,3})?",
    "cc-by": r"cc-by-(1\.0|2\.0|2\.5|3\.0|4\.0)(-[a-z]{2,3})?",
    "unlicense": r"unlicense|unlicense-libtelnet|unlicense-libwhirlpool",
    "zlib": r"zlib|zlib-acknowledgement",
    "wtfpl": r"wtfpl",
}
LATER = r"(-only|-or-later|\+)?"
_FAMILY = re.compile("|".join(f"(?P<f{i}>(?:{ids}){LATER})" for i, ids in enumerate(FAMILIES.values())))
#: Families whose terms ask for no more than attribution.
PERMISSIVE = frozenset({"apache", "mit", "bsd", "isc", "bsl", "cc0", "cc-by", "unlicense", "zlib", "psf", "postgresql", "openssl", "wtfpl"})
#: Operators of an expression and how tightly they bind.
BINDING = {"or": 1, "and": 2, "with": 3}
EXPRESSION = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*")
LINE = re.compile(r"[^\r\n]*")
#: The end of a line and what marks the next one as a comment.
NEXT = re.compile(r"\r?\n[ \t]*(?:/\*+|\*+(?!/)|//+|#+|--|;+|%+|<!--|rem\b)?[ \t]*")
LEXEME = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
#: ASCII letters in lower case, other ASCII but digits as spaces, the rest as it is.
FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    entries: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES), ("tag", {TAG: "spdx"})):
        for phrase, label in phrases.items():
            entries.setdefault(f" {phrase} ", []).append((kind, label))
    for text, what in entries.items():
        found.add_word(text, (len(text), what))
    found.make_automaton()
    return found


def expression(text: str, at: int) -> str:
    """The line from `at` on, with the lines after it as long as a bracket is open, without their comment marks. An empty line
    or another tag ends it."""
    found = LINE.match(text, at)
    parts, open_ = [found[0]], found[0].count("(") - found[0].count(")")
    while open_ > 0 and (mark := NEXT.match(text, found.end())):
        found = LINE.match(text, mark.end())
        if not found[0].strip() or "spdx-license-identifier" in found[0]:
            break
        parts.append(found[0])
        open_ += found[0].count("(") - found[0].count(")")
    return " ".join(parts)


def postfix(expression: str) -> list[str] | None:
    """The leading licence expression of a line in postfix order, or None if there is none.

    `with` stands between a single licence and a single exception; anything else there makes the expression unreadable, as
    an unclosed bracket does. What follows a whole expression (the end of a comment, say) is left out.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = single = False  # whether an operand has just ended, and whether it is a single licence
    opened, at, line = 0, 0, expression.lower()
    for m in LEXEME.finditer(line):
        if line[at : m.start()].strip():
            break
        word, after_with = m[0], bool(stack) and stack[-1] == "with" and not operand
        if word == "(":
            if operand:
                break
            if after_with:
                return None
            stack.append(word)
            opened += 1
        elif word == ")":
            if not operand or not opened:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            opened -= 1
            single = False
        elif word in BINDING:
            if not operand or word == "with" and not single:
                return None
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = False
        else:
            if operand:
                break
            out.append(word)
            operand, single = True, not after_with
        at = m.end()
    if opened or not operand:
        return None
    return out + stack[::-1]


def family(identifier: str) -> str:
    """The family of a whole identifier."""
    found = _FAMILY.fullmatch(identifier)
    return list(FAMILIES)[int(found.lastgroup[1:])] if found else "other"


def evaluate(order: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[bool, frozenset[str]]:
    """(whether the expression can be met with licences of allowed families alone, the families that it names).

    `a with x` is as allowed as a: an exception only grants more.
    """
    stack: list[tuple[bool, frozenset[str]]] = []
    for word in order:
        if word in BINDING:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append({"or": (a or b, x | y), "and": (a and b, x | y), "with": (a, x)}[word])  # an exception has no family
        else:
            stack.append((family(word) in allowed, frozenset({family(word)})))
    return stack[0]


def scan(text: str, found: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive)."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    line = f" {b' '.join(words).decode('latin-1')} " if words else ""
    places, base, labels, doubt, tagged = [], set(), set(), 1.0, False
    seen: set[tuple[str, str]] = set()
    at = count = 0
    for end, (size, what) in found.iter(line):
        for kind, label in what:
            if kind == "base":
                start = end + 1 - size
                if start >= at:
                    count += line.count(" ", at, start)
                    at = start
                    places.append(count)
                else:
                    places.append(line.count(" ", 0, start))
                base.add(label)
            tagged |= kind == "tag"
            if (kind, label) not in seen:
                seen.add((kind, label))
                if kind != "tag":
                    labels.add(label)
                    doubt *= 1 - WEIGHTS[kind]
    expressions, permissive = [], None
    low = text.lower() if tagged else ""
    for m in EXPRESSION.finditer(low):
        order = postfix(expression(low, m.end()))
        if order is None:
            continue
        ok, families = evaluate(order)
        permissive = ok if permissive is None else permissive and ok
        labels |= families | {"spdx"}
        expressions.append(" ".join(order))
    if expressions:
        doubt *= 1 - WEIGHTS["tag"]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, expressions, permissive


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts and places of base phrases, labels, score, expressions in postfix order, and whether
    all of them can be met with permissive licences (null without one).

    Null and empty texts have no words, empty labels and score 0; rows that repeat are scanned alike.
    An empty table gives no rows; other columns of docs, whatever their names, are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for b in text_slices(batches):
            rows = [(i, *scan(t, found)) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"
    return two_columns(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """license_scan over all documents; odd rows as told there."""
    return license_scan(documents(spark, sf_dir))
