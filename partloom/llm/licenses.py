"""Licence scan: ordered signature rules behind a keyword prefilter.

Texts are lower-cased (A-Z only) and cut into words; rules are regular expressions
over the words joined by single blanks. A rule runs only where one of its keywords
occurs. Detections are then resolved: one that lies within a detection of higher
priority (or of the same priority and greater length) is suppressed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._util import small_batches
from .license_signatures import SIGNATURES

#: Fixed phrases of the contract and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed word pattern of the contract (after lower-casing A-Z).
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}

#: Fixed list of licence families: label, name as a pattern over words, keyword, versions.
FAMILIES = [
    ("agpl", r"(?:gnu )?(?:affero general public license|agpl)", ("affero", "agpl"), ("3",)),
    ("lgpl", r"(?:gnu )?(?:lesser general public license|library general public license|lgpl)", ("lesser", "library general", "lgpl"), ("2", "2 1", "3")),
    ("gpl", r"(?:gnu )?(?:general public license|gpl)", ("general public", "gpl"), ("1", "2", "3")),
    ("gfdl", r"(?:gnu )?free documentation license", ("free documentation",), ("1 1", "1 2", "1 3")),
    ("apache", r"apache (?:software )?license", ("apache",), ("1 0", "1 1", "2 0")),
    ("mit", r"(?:mit|expat|x11) license", ("mit", "expat", "x11"), ()),
    ("bsd", r"(?:new |modified |simplified |revised |original )?(?:[0234] clause )?bsd(?: [0234] clause)?(?: license)?", ("bsd",), ()),
    ("isc", r"isc license", ("isc license",), ()),
    ("mpl", r"mozilla public license", ("mozilla",), ("1 0", "1 1", "2 0")),
    ("epl", r"eclipse public license", ("eclipse",), ("1 0", "2 0")),
    ("cddl", r"common development and distribution license", ("common development",), ("1 0", "1 1")),
    ("cpl", r"common public license", ("common public",), ("1 0",)),
    ("eupl", r"european union public licen[cs]e", ("european union",), ("1 1", "1 2")),
    ("artistic", r"artistic license", ("artistic",), ("1 0", "2 0")),
    ("boost", r"boost software license", ("boost",), ("1 0",)),
    ("zlib", r"zlib (?:libpng )?license", ("zlib",), ()),
    ("unlicense", r"(?:the )?unlicense", ("unlicense",), ()),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", ("wtfpl", "do what the"), ("2",)),
    ("postgresql", r"postgresql license", ("postgresql",), ()),
    ("python", r"(?:python software foundation|psf) license", ("python software", "psf"), ("2",)),
    ("openssl", r"openssl license", ("openssl",), ()),
    ("ofl", r"(?:sil )?open font license", ("open font",), ("1 0", "1 1")),
    ("odbl", r"open (?:data commons open )?database license", ("database license",), ("1 0",)),
    ("odc-by", r"open data commons attribution license", ("data commons attribution",), ("1 0",)),
    ("ms-pl", r"microsoft public license", ("microsoft public",), ()),
    ("ms-rl", r"microsoft reciprocal license", ("microsoft reciprocal",), ()),
    ("bsl", r"business source license", ("business source",), ("1 1",)),
    ("sspl", r"server side public license", ("server side",), ("1",)),
    ("elastic", r"elastic license", ("elastic license",), ("2 0",)),
    ("polyform", r"polyform (?:noncommercial|strict|shield|small business) license", ("polyform",), ("1 0 0",)),
    ("ncsa", r"(?:university of illinois )?ncsa (?:open source )?license", ("ncsa",), ()),
    ("afl", r"academic free license", ("academic free",), ("2 1", "3 0")),
    ("osl", r"open software license", ("open software",), ("2 1", "3 0")),
    ("qpl", r"q public license", ("q public",), ("1 0",)),
    ("upl", r"universal permissive license", ("universal permissive",), ("1 0",)),
    ("vim", r"vim license", ("vim license",), ()),
    ("php", r"php license", ("php license",), ("3 0", "3 01")),
    ("zope", r"zope public license", ("zope",), ("2 0", "2 1")),
    ("ecl", r"educational community license", ("educational community",), ("2 0",)),
    ("mulan", r"mulan (?:permissive|public) (?:software )?license", ("mulan",), ("1", "2")),
    ("cecill", r"cecill(?: [abc])?(?: license)?", ("cecill",), ("2 0", "2 1")),
    ("json", r"json license", ("json license",), ()),
    ("beerware", r"beer ?ware license", ("beer",), ()),
    ("rail", r"(?:open ?rail|creativeml open rail)(?: m)?(?: license)?", ("rail",), ()),
    ("llama", r"llama [0-9](?: [0-9])? community license", ("community license",), ()),
]

#: Fixed list of wordings: name, priority, weight and pattern; {n} is a family's name, {v} one of its versions.
WORDINGS = [
    ("notice", 90, 1.0, r"(?:this (?:work|software|file|program|document|project) is )?(?:licensed|released|distributed|made available|available|published) under (?:the )?(?:terms of )?(?:the )?{n}(?: version)?(?: v)? ?{v}"),
    ("name-version", 70, 0.9, r"{n}(?: version| v)? ?{v}"),
    ("named", 50, 0.8, r"(?:licensed|released|distributed|made available|available|published) under (?:the )?(?:terms of )?(?:the )?{n}"),
    ("copy-of", 40, 0.7, r"(?:a )?copy of (?:the )?{n}"),
    ("compatible", 30, 0.3, r"compatible with (?:the )?{n}"),
    ("mention", 10, 0.5, r"{n}"),
]

#: Fixed rules that are not made of a family and a wording: rule, label, priority, weight, keywords, pattern.
SINGLE_RULES = [
    ("cc-zero", "cc0", 95, 1.0, ("cc0", "creative commons"), r"(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc-by-nc-nd", 98, 1.0, ("nc nd", "noncommercial noderiv"), r"(?:cc by nc nd|attribution noncommercial noderiv(?:ative)?s)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc-by-nc-sa", 98, 1.0, ("nc sa", "noncommercial sharealike"), r"(?:cc by nc sa|attribution noncommercial sharealike)(?: [1-4] [05])?"),
    ("cc-by-nc", "cc-by-nc", 96, 1.0, ("by nc", "attribution noncommercial"), r"(?:cc by nc|attribution noncommercial)(?: [1-4] [05])?"),
    ("cc-by-nd", "cc-by-nd", 96, 1.0, ("by nd", "attribution noderiv"), r"(?:cc by nd|attribution noderiv(?:ative)?s)(?: [1-4] [05])?"),
    ("cc-by-sa", "cc-by-sa", 96, 1.0, ("by sa", "attribution sharealike"), r"(?:cc by sa|attribution sharealike)(?: [1-4] [05])?"),
    ("cc-by", "cc-by", 60, 0.9, ("cc by", "creative commons attribution"), r"(?:cc by|creative commons attribution)(?: [1-4] [05])?"),
    ("cc-url", "cc", 45, 0.8, ("creativecommons org",), r"creativecommons org licenses [a-z]+(?: [a-z]+)*"),
    ("spdx", "spdx", 20, 0.6, ("spdx license identifier",), r"spdx license identifier [0-9a-z]+"),
    ("mit-text", "mit", 92, 1.0, ("permission is hereby granted",), r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd-text", "bsd", 92, 1.0, ("redistribution and use",), r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc-text", "isc", 92, 1.0, ("permission to use copy modify",), r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("gpl-text", "gpl", 92, 1.0, ("you can redistribute it",), r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-text", "lgpl", 93, 1.0, ("you can redistribute it",), r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("public-domain", "public-domain", 35, 0.7, ("public domain",), r"(?:dedicated to|released into|placed in|in) the public domain"),
    ("all-rights", "proprietary", 25, 0.4, ("all rights reserved",), r"all rights reserved"),
]


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: str


def default_rules() -> list[Rule]:
    """The rule set in order of priority, then of the lists: the hand-written signatures, then those of families and wordings."""
    rules = [Rule(*x) for x in SINGLE_RULES] + [Rule(*x[:4], (x[4],), x[5]) for x in SIGNATURES]
    for label, name, keywords, versions in FAMILIES:
        for kind, priority, weight, pattern in WORDINGS:
            if "{v}" not in pattern:
                rules.append(Rule(f"{label}:{kind}", label, priority, weight, keywords, pattern.replace("{n}", name)))
                continue
            for v in versions:
                rules.append(Rule(f"{label}-{v.replace(' ', '.')}:{kind}", f"{label}-{v.replace(' ', '.')}", priority, weight, keywords, pattern.replace("{n}", name).replace("{v}", v)))
    return sorted(rules, key=lambda r: -r.priority)


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> tuple[list[tuple[Rule, re.Pattern]], ahocorasick.Automaton]:
    """The patterns, and an automaton that finds keywords, each with the places of its rules."""
    compiled = [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in rules]
    by_word: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for k in r.keywords:
            by_word.setdefault(k, []).append(i)
    keywords = ahocorasick.Automaton()
    for k, ids in by_word.items():
        keywords.add_word(k, tuple(ids))
    keywords.make_automaton()
    return compiled, keywords


def scan_text(text: str | None, rules: tuple[Rule, ...], phrases: dict[str, str]) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, str, int, int, int, float]]]:
    """Number of words, places of the phrases (label, start, end) and surviving detections
    (rule, label, start, end, priority, weight); starts and ends count words, ends are exclusive."""
    words = WORDS.findall((text or "").translate(LOWER))
    joined = f" {' '.join(words)} "
    base, raw = [], []
    for phrase, label in phrases.items():
        at, seen, n = joined.find(f" {phrase} "), 0, 0
        while at >= 0:
            n, seen = n + joined.count(" ", seen, at), at
            base.append((label, n, n + phrase.count(" ") + 1))
            at = joined.find(f" {phrase} ", at + 1)
    compiled, keywords = _compiled(rules)
    for i in sorted({i for ids in {ids for _, ids in keywords.iter(joined)} for i in ids}):
        rule, pattern = compiled[i]
        n = seen = 0
        for m in pattern.finditer(joined):
            n, seen = n + joined.count(" ", seen, m.start() - 1), m.start() - 1
            raw.append((rule.name, rule.label, n, n + m[0].strip().count(" ") + 1, rule.priority, rule.weight))
    return len(words), base, resolve(raw)


def resolve(found: list[tuple[str, str, int, int, int, float]]) -> list[tuple[str, str, int, int, int, float]]:
    """Drops a detection that lies within one of higher priority, or of the same priority and
    greater length; of equal ones the first in order of rules stays. Sorted by start."""
    spans: list[tuple[int, int]] = []  # of survivors: nested in none of each other, so both ends rise
    out = []
    for d in sorted(found, key=lambda d: (-d[4], d[2] - d[3], d[2])):
        i = bisect.bisect_right(spans, (d[2], 1 << 60)) - 1
        if i >= 0 and spans[i][1] >= d[3]:
            continue
        out.append(d)
        at = bisect.bisect_left(spans, (d[2], d[3]))
        if not at or spans[at - 1][1] < d[3]:
            while at < len(spans) and spans[at][1] <= d[3]:
                spans.pop(at)
            spans.insert(at, (d[2], d[3]))
    return sorted(out, key=lambda d: (d[2], d[3], d[0]))


SPAN = "struct<rule:string,label:string,start:bigint,end:bigint,priority:int,weight:double>"
_SPAN_TYPE = pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64())])


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, base, found): one row per row of ``docs``.

    ``base`` lists every place of a phrase, ``found`` the detections that resolution
    leaves. Null and empty texts have no words and no places; null doc_ids and repeated
    rows are kept as they are; whole texts are scanned; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    rule_set, phrase_set = tuple(rules or default_rules()), dict(phrases or BASE_PHRASES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            got = [scan_text(t.as_py(), rule_set, phrase_set) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([n for n, _, _ in got], pa.int64()),
                    pa.array([[dict(zip(("label", "start", "end"), x, strict=True)) for x in base] for _, base, _ in got], base_type),
                    pa.array([[dict(zip(("rule", "label", "start", "end", "priority", "weight"), x, strict=True)) for x in found] for _, _, found in got], pa.list_(_SPAN_TYPE)),
                ],
                names=["doc_id", "n_words", "base", "found"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, base array<struct<label:string,start:bigint,end:bigint>>, found array<{SPAN}>")
