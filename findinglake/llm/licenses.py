"""License scans: ordered signature rules over the words of a text.

A rule is a label, a priority, a confidence, a regular expression and the keywords of which one must occur before the
expression is tried.  One Aho-Corasick pass over a text finds all keywords, so most texts try no rule and the others a
few of the hundreds.  Matches are then taken in the order of priority, length and position; a match whose interval
lies within one already taken is suppressed ("general public license" within "gnu lesser general public license").

Texts are lower-cased in A-Z only.  A word is a run of digits, letters a-z and characters over U+007F.
"""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import blocks, spans

# The base phrases and their labels, in the contract's order.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License families as (label, names, versions); a name's words may stand apart by punctuation.
FAMILIES = [
    ("apache", ["apache license", "apache software license", "apache public license"], ["1.0", "1.1", "2.0"]),
    ("gpl", ["gnu general public license", "gnu gpl", "gpl"], ["1.0", "2.0", "3.0"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"],
     ["2.0", "2.1", "3.0"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl"], ["1.0", "3.0"]),
    ("gfdl", ["gnu free documentation license", "gfdl"], ["1.1", "1.2", "1.3"]),
    ("mpl", ["mozilla public license", "mpl"], ["1.0", "1.1", "2.0"]),
    ("epl", ["eclipse public license", "epl"], ["1.0", "2.0"]),
    ("cpl", ["common public license"], ["1.0"]),
    ("cddl", ["common development and distribution license", "cddl"], ["1.0", "1.1"]),
    ("eupl", ["european union public licence", "european union public license", "eupl"], ["1.0", "1.1", "1.2"]),
    ("osl", ["open software license"], ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("afl", ["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("cecill", ["cecill free software license", "cecill"], ["1.0", "1.1", "2.0", "2.1"]),
    ("artistic", ["artistic license", "perl artistic license"], ["1.0", "2.0"]),
    ("bsl", ["boost software license"], ["1.0"]),
    ("busl", ["business source license"], ["1.0", "1.1"]),
    ("sspl", ["server side public license"], ["1.0"]),
    ("zpl", ["zope public license"], ["1.1", "2.0", "2.1"]),
    ("php", ["php license"], ["3.0", "3.01"]),
    ("psf", ["python software foundation license", "psf license"], ["2.0"]),
    ("ofl", ["sil open font license", "open font license"], ["1.0", "1.1"]),
    ("lppl", ["latex project public license"], ["1.0", "1.1", "1.2", "1.3"]),
    ("odbl", ["open database license", "odbl"], ["1.0"]),
    ("odc-by", ["open data commons attribution license"], ["1.0"]),
    ("ms-pl", ["microsoft public license"], []),
    ("ms-rl", ["microsoft reciprocal license"], []),
    ("mit", ["mit license", "mit licence", "the expat license", "x11 license"], []),
    ("isc", ["isc license", "internet systems consortium license"], []),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["1.0", "2.0"]),
    ("unlicense", ["the unlicense", "unlicense org"], []),
    ("bsd", ["bsd license", "bsd licence", "bsd style license"], []),
    ("bsd-2-clause", ["bsd 2 clause", "2 clause bsd", "simplified bsd license", "freebsd license"], []),
    ("bsd-3-clause", ["bsd 3 clause", "3 clause bsd", "new bsd license", "revised bsd license", "modified bsd license"], []),
    ("bsd-4-clause", ["bsd 4 clause", "4 clause bsd", "original bsd license"], []),
    ("cc0", ["cc0", "creative commons zero"], ["1.0"]),
]
# Creative Commons conditions and versions.
CC_CONDITIONS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv[a-z]*"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
# Phrases of license texts and notices as (label, confidence, phrase).
PHRASES = [
    ("mit", 0.95, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 0.95, "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 0.9, "redistribution and use in source and binary forms"),
    ("bsd-3-clause", 0.9, "neither the name of"),
    ("bsd-4-clause", 0.9, "all advertising materials mentioning features or use of this software"),
    ("zlib", 0.9, "this software is provided as is without any express or implied warranty"),
    ("gpl", 0.9, "this program is free software you can redistribute it and or modify it"),
    ("lgpl", 0.9, "this library is free software you can redistribute it and or modify it"),
    ("apache", 0.9, "you may not use this file except in compliance with the license"),
    ("mpl", 0.9, "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", 0.95, "this is free and unencumbered software released into the public domain"),
    ("public-domain", 0.8, "released into the public domain"),
    ("public-domain", 0.6, "in the public domain"),
    ("public-domain", 0.8, "dedicated to the public domain"),
    ("proprietary", 0.8, "proprietary and confidential"),
    ("proprietary", 0.8, "unauthorized copying of this file"),
    ("proprietary", 0.7, "may not be reproduced"),
    ("proprietary", 0.7, "without prior written permission"),
    ("copyright", 0.6, "copyright c"),
    ("copyright", 0.5, "copyright (?:19|20)[0-9][0-9]"),
    ("spdx", 0.9, "spdx license identifier"),
    ("licensed", 0.5, "licensed under"),
    ("licensed", 0.5, "under the terms of the"),
    ("terms", 0.4, "terms of use"),
    ("terms", 0.4, "terms of service"),
    ("mit", 0.9, "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 0.9, "without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", 0.6, "the software is provided as is without warranty of any kind"),
    ("mit-0", 0.9, "mit no attribution"),
    ("isc", 0.9, "the author disclaims all warranties with regard to this software"),
    ("bsd", 0.8, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 0.8, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 0.7, "this software is provided by the copyright holders and contributors as is"),
    ("bsd-3-clause", 0.9, "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 0.9, "this product includes software developed by"),
    ("bsd-0", 0.9, "bsd zero clause license"),
    ("bsd-clear", 0.9, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("zlib", 0.8, "the origin of this software must not be misrepresented"),
    ("zlib", 0.8, "altered source versions must be plainly marked as such"),
    ("libpng", 0.9, "the png reference library is supplied as is"),
    ("apache", 0.9, "licensed to the apache software foundation"),
    ("apache", 0.8, "unless required by applicable law or agreed to in writing software"),
    ("apache", 0.8, "see the license for the specific language governing permissions and limitations"),
    ("apache", 0.9, "grant of patent license subject to the terms and conditions of this license"),
    ("gpl", 0.9, "either version 2 of the license or at your option any later version"),
    ("gpl", 0.9, "either version 3 of the license or at your option any later version"),
    ("gpl", 0.8, "you should have received a copy of the gnu general public license"),
    ("gpl", 0.8, "this program comes with absolutely no warranty"),
    ("gpl", 0.8, "when we speak of free software we are referring to freedom not price"),
    ("gpl", 0.8, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-exception-classpath", 0.95, "as a special exception the copyright holders of this library give you permission to link this library"),
    ("gpl-exception-classpath", 0.9, "classpath exception"),
    ("gpl-exception-gcc", 0.9, "gcc runtime library exception"),
    ("gpl-exception-autoconf", 0.9, "autoconf configure script exception"),
    ("gpl-exception-font", 0.9, "if you embed this font or unaltered portions of this font"),
    ("lgpl", 0.8, "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", 0.8, "this license the lesser general public license applies to some specially designated software"),
    ("agpl", 0.9, "all users interacting with it remotely through a computer network"),
    ("agpl", 0.8, "you should have received a copy of the gnu affero general public license"),
    ("gfdl", 0.9, "permission is granted to copy distribute and or modify this document"),
    ("gfdl", 0.8, "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl", 0.9, "incompatible with secondary licenses"),
    ("mpl", 0.8, "the contents of this file are subject to the mozilla public license"),
    ("epl", 0.9, "this program and the accompanying materials are made available under the terms of the eclipse"),
    ("cpl", 0.9, "accompanying materials are made available under the terms of the common public license"),
    ("cddl", 0.9, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", 0.8, "when distributing covered code include this cddl header"),
    ("artistic", 0.9, "this package is free software you can redistribute it and or modify it under the same terms as perl"),
    ("artistic", 0.8, "the intent of this document is to state the conditions under which a package may be copied"),
    ("bsl", 0.9, "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("busl", 0.9, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("sspl", 0.9, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", 0.9, "elastic license"),
    ("elastic", 0.9, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 0.9, "commons clause license condition"),
    ("commons-clause", 0.9, "the grant of rights under the license will not include the right to sell the software"),
    ("polyform", 0.9, "polyform noncommercial license"),
    ("polyform", 0.9, "polyform small business license"),
    ("polyform", 0.9, "polyform shield license"),
    ("openssl", 0.9, "openssl license"),
    ("openssl", 0.9, "this product includes software developed by the openssl project"),
    ("ssleay", 0.9, "this package is an ssl implementation written by"),
    ("curl", 0.8, "curl license"),
    ("ncsa", 0.9, "university of illinois ncsa open source license"),
    ("w3c", 0.9, "w3c software notice and license"),
    ("w3c", 0.8, "w3c document license"),
    ("unicode", 0.9, "unicode inc license agreement"),
    ("icu", 0.8, "icu license"),
    ("json", 0.9, "the software shall be used for good not evil"),
    ("beerware", 0.9, "the beer ware license"),
    ("beerware", 0.9, "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("wtfpl", 0.9, "you just do what the fuck you want to"),
    ("vim", 0.9, "vim license"),
    ("ruby", 0.7, "ruby license"),
    ("tcl", 0.8, "tcl tk license"),
    ("postgresql", 0.9, "postgresql license"),
    ("postgresql", 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("hpnd", 0.9, "historical permission notice and disclaimer"),
    ("imagemagick", 0.9, "imagemagick license"),
    ("freetype", 0.9, "freetype project license"),
    ("ijg", 0.9, "this software is based in part on the work of the independent jpeg group"),
    ("ofl", 0.9, "the fonts and derivatives however cannot be released under any other type of license"),
    ("bitstream-vera", 0.9, "bitstream vera fonts copyright"),
    ("cc", 0.8, "this work is licensed under a creative commons"),
    ("cc", 0.7, "creative commons license"),
    ("cc0", 0.9, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", 0.9, "to the extent possible under law"),
    ("odbl", 0.9, "this database is made available under the open database license"),
    ("odc-by", 0.9, "open data commons"),
    ("pddl", 0.9, "public domain dedication and license"),
    ("ogl", 0.9, "open government licence"),
    ("ogl", 0.9, "contains public sector information licensed under the open government"),
    ("etalab", 0.9, "licence ouverte"),
    ("dl-de", 0.9, "datenlizenz deutschland"),
    ("public-domain", 0.7, "placed in the public domain"),
    ("public-domain", 0.6, "no copyright is claimed"),
    ("reserved", 0.7, "no part of this publication may be reproduced"),
    ("reserved", 0.7, "alle rechte vorbehalten"),
    ("reserved", 0.7, "tous droits reserves"),
    ("reserved", 0.7, "todos los derechos reservados"),
    ("proprietary", 0.8, "this software is the confidential and proprietary information of"),
    ("proprietary", 0.8, "trade secret"),
    ("proprietary", 0.8, "for internal use only"),
    ("proprietary", 0.7, "end user license agreement"),
    ("proprietary", 0.7, "subject to the terms of your license agreement"),
    ("evaluation", 0.8, "for evaluation purposes only"),
    ("non-commercial", 0.8, "for non commercial use only"),
    ("non-commercial", 0.7, "for personal use only"),
    ("academic", 0.8, "for academic and research purposes only"),
    ("patent", 0.7, "patent pending"),
    ("export", 0.6, "export administration regulations"),
    ("permission", 0.6, "used by permission"),
    ("permission", 0.6, "reprinted with permission"),
    ("share", 0.6, "feel free to share"),
]

_SEP = "[^0-9a-z\x80-\xff]+"  # between words, however far a line is indented
_GAP = "[^0-9a-z\x80-\xff]{1,8}"  # before a version's number
_LEFT, _RIGHT = "(?<![0-9a-z\x80-\xff])", "(?![0-9a-z\x80-\xff])"
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern


def _phrase(text: str) -> str:
    return _SEP.join(text.split(" ")) if "?" not in text else text.replace(" ?", "[^0-9a-z]?").replace(" ", _SEP)


def _version(v: str) -> str:
    major, _, minor = v.partition(".")
    return major + ("(?:[.]0)?" if minor == "0" else f"[.]{minor}")


def _rule(label: str, priority: int, confidence: float, pattern: str, keyword: str) -> Rule:
    return Rule(label, priority, confidence, keyword, re.compile(_LEFT + pattern + _RIGHT))


@functools.lru_cache(1)
def rules() -> list[Rule]:
    """All rules, in order: versions before names, names before phrases of license texts, the base phrases last."""
    out = []
    for label, names, versions in FAMILIES:
        for name in names:
            key = max(name.split(" "), key=len)
            for v in versions:
                mid = f"(?:{_SEP}(?:version|v|ver){_GAP[:-5]}{{0,3}}|{_GAP})"
                out.append(_rule(f"{label}-{v}", 10, 0.97, _phrase(name) + mid + _version(v), key))
            out.append(_rule(label, 20, 0.85, _phrase(name), key))
    for c in CC_CONDITIONS:
        short = _SEP.join(["cc", *c.split("-")])
        full = "creative" + _SEP + "commons" + "".join(_SEP + _phrase(CC_WORDS[x]) for x in c.split("-"))
        for v in CC_VERSIONS:
            tail = f"(?:{_SEP}(?:international|unported|generic|license))?{_GAP}{_version(v)}"
            out.append(_rule(f"cc-{c}-{v}", 10, 0.97, short + tail, "cc"))
            out.append(_rule(f"cc-{c}-{v}", 10, 0.97, full + tail, "creative"))
        out.append(_rule(f"cc-{c}", 19 - c.count("-"), 0.85, short, "cc"))
        out.append(_rule(f"cc-{c}", 19 - c.count("-"), 0.85, full, "creative"))
    for label, confidence, text in PHRASES:
        key = max((w for w in text.split(" ") if w.isalpha()), key=len)
        out.append(_rule(label, 30, confidence, _phrase(text), key))
    for text, label in BASE.items():
        out.append(_rule(label, 40, 0.5, _phrase(text), max(text.split(" "), key=len)))
    return out


@functools.lru_cache(1)
def _keywords():
    import ahocorasick

    found = ahocorasick.Automaton()
    by: dict[str, list[Rule]] = {}
    for r in rules():
        by.setdefault(r.keyword, []).append(r)
    for k in by:
        found.add_word(k, k)
    found.make_automaton()
    return found, by


_BASE = [
    (label, text.split(" ")[0], re.compile(f"(?={_LEFT}{_SEP.join(text.split(' '))}{_RIGHT})")) for text, label in BASE.items()
]


def scan(text: str) -> list[tuple[int, int, str, float]]:
    """Detections in a lower-cased text (one character a byte): (start, end, label, confidence)."""
    automaton, by = _keywords()
    hits = []
    for k in {k for _, k in automaton.iter(text)}:
        for r in by[k]:
            hits += [(r.priority, m.start() - m.end(), m.start(), m.end(), r.label, r.confidence) for m in r.pattern.finditer(text)]
    taken: list[tuple[int, int, str, float]] = []
    starts: list[int] = []  # of those taken, the ones that no other contains: both lists rise
    ends: list[int] = []
    for _, _, s, e, label, confidence in sorted(hits):
        i = bisect.bisect_right(starts, s)
        if i and ends[i - 1] >= e:
            continue
        taken.append((s, e, label, confidence))
        i, j = bisect.bisect_left(starts, s), bisect.bisect_right(ends, e)
        starts[i:j], ends[i:j] = [s], [e]
    return sorted(taken)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    n_base counts the places where a base phrase's words stand consecutively; first_word and last_word are the
    smallest and largest word index of such places, or null.  labels are the base labels and those of detections that
    no other contains; detections are their byte spans.  score is 1 - prod(1 - confidence) over the labels.
    A null or empty text has no words, empty label strings and score 0.  One pass, no shuffle.
    """
    names = ["id", "no_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]

    def run(batches):
        for pdf in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in pdf["text"]]
            rows = []
            ids, none = pdf["id"].tolist(), pdf["no_id"].tolist()
            for i, j in blocks(texts):
                buf = np.frombuffer(b" ".join(texts[i:j]) + b" ", np.uint8)
                starts, _ = spans(_WORD[buf])
                bounds = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
                first = np.searchsorted(starts, bounds)
                for d, no, t, at, a, b in zip(ids[i:j], none[i:j], texts[i:j], bounds.tolist(), first[:-1].tolist(), first[1:].tolist()):
                    x = t.decode("latin-1")
                    base, places = set(), []
                    for label, key, pattern in _BASE:
                        if key in x:
                            own = [m.start() for m in pattern.finditer(x)]
                            places += own
                            if own:
                                base.add(label)
                    found = scan(x)
                    best = {label: 0.5 for label in base}
                    for _, _, label, c in found:
                        best[label] = max(c, best.get(label, 0))
                    index = np.searchsorted(starts[a:b], np.array(places, np.int64) + at) if places else None
                    rows.append(
                        (d, no, b - a, len(places), int(index.min()) if places else None, int(index.max()) if places else None,
                         ",".join(sorted(base)), ",".join(sorted(best)),
                         round(1 - float(np.prod([1 - c for c in best.values()])), 6) if best else 0.0,
                         [{"start": s, "end": e, "label": label} for s, e, label, _ in found])
                    )
            yield pd.DataFrame(rows, columns=names).astype({"first_word": "Int64", "last_word": "Int64"})

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")
    out = rows.mapInPandas(
        run,
        "id long, no_id boolean, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, detections array<struct<start:int,end:int,label:string>>",
    )
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), *names[2:])
