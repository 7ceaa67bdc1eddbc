"""License detection by ordered signature rules.

Rules are hand-written regular expressions over a text's normalised words (lower-case, punctuation as one space). Each
has a priority and keywords; one Aho-Corasick pass over the text finds the keywords, and only rules whose keywords all
occur are tried. Detections that lie inside a detection of equal or higher priority are suppressed: the text of a
more specific notice hides the generic one inside it. The base phrases are always reported.

score is the largest confidence of a detection that stands, 0 without any. Nulls and empty texts have no words. Rows are
independent of each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that are always reported, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))

#: Families: label, the names it goes by (as patterns over normalised words), and a word that any name contains.
FAMILIES = [
    ("mit", r"mit|expat", ("mit", "expat")),
    ("mit-0", r"mit 0|mit no attribution", ("mit",)),
    ("apache-1", r"apache(?: software)? (?:1(?: [01])?)", ("apache",)),
    ("apache-2", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", ("apache",)),
    ("bsd-2-clause", r"bsd 2 clause|simplified bsd|freebsd|2 clause bsd", ("bsd", "freebsd")),
    ("bsd-3-clause", r"bsd 3 clause|new bsd|modified bsd|revised bsd|3 clause bsd", ("bsd",)),
    ("bsd-4-clause", r"bsd 4 clause|original bsd|4 clause bsd", ("bsd",)),
    ("0bsd", r"0bsd|zero clause bsd", ("0bsd", "bsd")),
    ("isc", r"isc", ("isc",)),
    ("gpl-1", r"gpl(?: v| version)? ?1(?: 0)?", ("gpl",)),
    ("gpl-2", r"gpl(?: v| version)? ?2(?: 0)?|gnu general public license(?: v| version) ?2(?: 0)?", ("gpl", "gnu")),
    ("gpl-3", r"gpl(?: v| version)? ?3(?: 0)?|gnu general public license(?: v| version) ?3(?: 0)?", ("gpl", "gnu")),
    ("lgpl-2-1", r"lgpl(?: v| version)? ?2(?: [01])?|gnu lesser general public license(?: v| version) ?2(?: 1)?", ("lgpl", "lesser")),
    ("lgpl-3", r"lgpl(?: v| version)? ?3(?: 0)?|gnu lesser general public license(?: v| version) ?3(?: 0)?", ("lgpl", "lesser")),
    ("agpl-3", r"agpl(?: v| version)? ?3(?: 0)?|gnu affero general public license(?: v| version) ?3(?: 0)?", ("agpl", "affero")),
    ("mpl-1-1", r"mpl(?: v| version)? ?1(?: 1)?|mozilla public license(?: v| version)? ?1(?: 1)?", ("mpl", "mozilla")),
    ("mpl-2", r"mpl(?: v| version)? ?2(?: 0)?|mozilla public license(?: v| version)? ?2(?: 0)?", ("mpl", "mozilla")),
    ("epl-1", r"epl(?: v| version)? ?1(?: 0)?|eclipse public license(?: v| version)? ?1(?: 0)?", ("epl", "eclipse")),
    ("epl-2", r"epl(?: v| version)? ?2(?: 0)?|eclipse public license(?: v| version)? ?2(?: 0)?", ("epl", "eclipse")),
    ("cddl-1", r"cddl(?: v| version)? ?1(?: [01])?|common development and distribution license", ("cddl", "distribution")),
    ("cpl-1", r"cpl(?: v| version)? ?1(?: 0)?|common public license", ("cpl", "common")),
    ("eupl-1-2", r"eupl(?: v| version)? ?1(?: 2)?|european union public licen[cs]e", ("eupl", "european")),
    ("artistic-1", r"artistic(?: license)?(?: v| version)? ?1(?: 0)?", ("artistic",)),
    ("artistic-2", r"artistic(?: license)?(?: v| version)? ?2(?: 0)?", ("artistic",)),
    ("bsl-1", r"boost software license|bsl 1 0", ("boost", "bsl")),
    ("busl-1-1", r"business source license|busl 1 1", ("business", "busl")),
    ("unlicense", r"unlicense", ("unlicense",)),
    ("wtfpl", r"wtfpl|do what the fuck you want to public license", ("wtfpl", "fuck")),
    ("zlib", r"zlib|zlib libpng", ("zlib",)),
    ("libpng", r"libpng(?: version 2)?", ("libpng",)),
    ("openssl", r"openssl", ("openssl",)),
    ("php-3", r"php(?: license)?(?: version)? ?3(?: 0?1)?", ("php",)),
    ("psf-2", r"psf|python software foundation", ("psf", "python")),
    ("ruby", r"ruby", ("ruby",)),
    ("postgresql", r"postgresql", ("postgresql",)),
    ("ncsa", r"ncsa|university of illinois", ("ncsa", "illinois")),
    ("sissl", r"sissl|sun industry standards source", ("sissl", "industry")),
    ("odbl-1", r"odbl(?: 1 0)?|open database license", ("odbl", "database")),
    ("odc-by-1", r"odc by(?: 1 0)?|open data commons attribution", ("odc", "commons")),
    ("ofl-1-1", r"ofl(?: 1 1)?|sil open font license", ("ofl", "font")),
    ("sspl-1", r"sspl(?: v| version)? ?1?|server side public license", ("sspl", "server")),
    ("elastic-2", r"elastic license(?: 2 0)?", ("elastic",)),
    ("upl-1", r"upl 1 0|universal permissive license", ("upl", "universal")),
    ("ms-pl", r"ms pl|microsoft public license", ("ms", "microsoft")),
    ("ms-rl", r"ms rl|microsoft reciprocal license", ("ms", "microsoft")),
    ("cc0", r"cc0(?: 1 0)?|cc zero|creative commons zero", ("cc0", "cc", "creative")),
    ("cc-by", r"cc by(?! nc| sa| nd)|creative commons attribution(?! non ?commercial| share ?alike| no ?deriv)", ("cc", "creative")),
    ("cc-by-sa", r"cc by sa|creative commons attribution share ?alike", ("cc", "creative")),
    ("cc-by-nd", r"cc by nd|creative commons attribution no ?deriv(?:ative)?s?", ("cc", "creative")),
    ("cc-by-nc", r"cc by nc(?! sa| nd)|creative commons attribution non ?commercial(?! share ?alike| no ?deriv)", ("cc", "creative")),
    ("cc-by-nc-sa", r"cc by nc sa|creative commons attribution non ?commercial share ?alike", ("cc", "creative")),
    ("cc-by-nc-nd", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?", ("cc", "creative")),
]
#: How a family's name stands in a notice: kind, pattern, keyword, priority, confidence.
FORMS = [
    ("tag", r"spdx license identifier (?:{n})", "spdx", 90, 1.0),
    ("grant", r"(?:licensed|released|distributed|available|published|provided|shared) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{n})(?: license| licence)?", "under", 80, 0.95),
    ("named", r"license[ds]? (?:is |as |type |name )?(?:the )?(?:{n})", "license", 60, 0.9),
    ("under", r"under (?:the )?(?:{n}) licen[cs]e", "under", 60, 0.9),
    ("plain", r"(?:the )?(?:{n}) licen[cs]e(?: version [0-9]+(?: [0-9]+)?)?", "licen", 40, 0.8),
]
#: Sentences of license texts and notices: label, pattern, keyword, priority, confidence.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby", 95, 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby", 95, 1.0),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors may be used", "neither", 95, 1.0),
    ("bsd-2-clause", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 70, 0.9),
    ("apache-2", r"licensed under the apache license version 2(?: 0)?", "apache", 95, 1.0),
    ("apache-2", r"apache license version 2(?: 0)?", "apache", 85, 0.95),
    ("apache-2", r"(?:www )?apache org licenses license 2 0", "apache", 90, 1.0),
    ("gpl-2", r"either version 2 of the license or at your option any later version", "option", 95, 1.0),
    ("gpl-3", r"either version 3 of the license or at your option any later version", "option", 95, 1.0),
    ("gpl", r"gnu general public license(?! (?:v|version) ?[0-9])", "gnu", 50, 0.8),
    ("lgpl", r"gnu (?:lesser|library) general public license(?! (?:v|version) ?[0-9])", "gnu", 55, 0.8),
    ("agpl", r"gnu affero general public license(?! (?:v|version) ?[0-9])", "gnu", 55, 0.8),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", 95, 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 95, 1.0),
    ("public-domain", r"(?:dedicated|released|placed) (?:in|into|to) the public domain", "domain", 50, 0.8),
    ("zlib", r"this software is provided as is without any express or implied warranty", "implied", 60, 0.8),
    ("bsl-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby", 95, 1.0),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?", "cc", 87, 0.95),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?", "cc", 87, 0.95),
    ("cc-by-nc", r"cc by nc(?: [1-4] [05])?", "cc", 85, 0.95),
    ("cc-by-sa", r"cc by sa(?: [1-4] [05])?", "cc", 85, 0.95),
    ("cc-by-nd", r"cc by nd(?: [1-4] [05])?", "cc", 85, 0.95),
    ("cc-by", r"cc by [1-4] [05]", "cc", 85, 0.95),
    ("proprietary", r"all rights reserved", "reserved", 10, 0.3),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "proprietary", 45, 0.8),
    ("copyright", r"copyright (?:c )?(?:[0-9]{4}|by )", "copyright", 5, 0.2),
    ("generic", r"licensed under the (?:terms|license)", "licensed", 20, 0.4),
    ("generic", r"see (?:the )?(?:license|copying) (?:file|txt|md)", "see", 20, 0.4),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]  # one of them must occur
    also: str  # and this
    priority: int
    confidence: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first, then as written."""
    found = [Rule(label, p, (k,), k, pr, c) for label, p, k, pr, c in SENTENCES]
    for label, names, keys in FAMILIES:
        found += [Rule(label, form.format(n=names), keys, key, pr, c) for _, form, key, pr, c in FORMS]
    return tuple(sorted(found, key=lambda r: -r.priority))


@cache
def matcher():
    """The keyword automaton and the compiled rules."""
    automaton = ahocorasick.Automaton()
    for word in sorted({k for r in rules() for k in (*r.keywords, r.also)}):
        automaton.add_word(" " + word, word)
    automaton.make_automaton()
    return automaton, [re.compile(r"(?<= )(?:" + r.pattern + r")(?= )") for r in rules()]


def detect(text: str) -> list[tuple[int, int, str, int, float]]:
    """Standing detections (start, end, label, priority, confidence) in normalised words, which a space frames."""
    automaton, compiled = matcher()
    present = {word for _, word in automaton.iter(text)}
    if not present:
        return []
    spans = []
    for rule, pattern in zip(rules(), compiled, strict=True):
        if rule.also in present and not present.isdisjoint(rule.keywords):
            spans += [(m.start(), m.end(), rule.label, rule.priority, rule.confidence) for m in pattern.finditer(text)]
    return standing(spans)


def standing(spans: list[tuple[int, int, str, int, float]]) -> list[tuple[int, int, str, int, float]]:
    """spans without those inside another of equal or higher priority; of equal spans the first rule's stands.

    Spans are swept by start; a span is inside an earlier one if that reaches as far, so for each priority only the
    furthest end so far counts.
    """
    order = {s: i for i, s in reversed(list(enumerate(spans)))}
    ends: dict[int, int] = {}
    out = []
    for s in sorted(set(spans), key=lambda s: (s[0], -s[1], -s[3], order[s])):
        if not any(end >= s[1] for priority, end in ends.items() if priority >= s[3]):
            out.append(s)
        ends[s[3]] = max(ends.get(s[3], -1), s[1])
    return out


def scan(raw: bytes | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int, float]]]:
    """Words, base places (word, label) and standing detections (first word, last word, label, priority, confidence)."""
    words = (raw or b"").translate(TABLE).split()
    text = " " + b" ".join(words).decode("utf-8", "surrogateescape") + " "
    base = []
    for phrase, label in BASE.items():
        at = text.find(f" {phrase} ")
        counted, n = 0, 0
        while at >= 0:
            n += text.count(" ", counted, at)
            counted = at
            base.append((n, label))
            at = text.find(f" {phrase} ", at + 1)
    found = detect(text)
    places = [(text.count(" ", 0, a) - 1, text.count(" ", 0, b) - 1, *rest) for a, b, *rest in found]
    return len(words), base, places


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, spans): base places and standing detections as arrays of structs."""
    schema = (
        "doc_id long, n_words long, base array<struct<word:long,label:string>>, "
        "spans array<struct<first:long,last:long,label:string,priority:int,confidence:double>>"
    )
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span_type = pa.list_(
        pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())])
    )
    span = ("first", "last", "label", "priority", "confidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"word": w, "label": x} for w, x in b] for _, b, _ in found], base_type),
                    pa.array([[dict(zip(span, s, strict=True)) for s in spans] for _, _, spans in found], span_type),
                ],
                names=["doc_id", "n_words", "base", "spans"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "spans.label")).alias("labels"),
        F.coalesce(F.array_max("spans.confidence"), F.when(F.size("base") > 0, 1.0), F.lit(0.0)).alias("score"),
    )
