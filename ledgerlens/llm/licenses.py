"""License scan: ordered signature rules behind a keyword gate.

Every rule is a regular expression with a priority, a label and literal keywords. A text
runs only the rules whose keywords all occur in it. Overlapping detections are resolved by
interval containment: in order of priority (then length, then position), a detection that
lies inside an accepted one is dropped.

Null text counts as empty; empty text has no words, no detections and score 0. Repeated
rows are scanned each for itself; an empty table gives an empty table. Input columns named
like an added column are replaced.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame

from ledgerlens.llm.common import annotate, lower_ascii, words_of

# Base phrases and their labels; fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

ADDED = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
         "labels string, score double, detections array<struct<label:string,rule:string,"
         "priority:int,start:long,end:long>>")

S = r"[\s#*/;,-]{1,12}"      # a gap between words, comment signs included
THE = rf"(?:the{S})?"
VER = rf"(?:[\s,;(]{{1,4}}(?:version|ver\.?|v\.?)?\s{{0,2}})"


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    keywords: tuple[str, ...]  # all must occur among the words, joined by single spaces
    pattern: str


class Family(NamedTuple):
    label: str
    keyword: str              # literal in every text form of the name
    name: str                 # regular expression of the name
    spdx: str                 # expression of the identifier without version
    versions: tuple[str, ...] = ()
    url: str = ""
    weak: bool = False        # the name alone is an ordinary word


def w(text: str) -> str:
    """Words of a phrase with gaps between them."""
    return S.join(re.escape(x) for x in text.split())


FAMILIES = (
    Family("gpl", "general public", rf"(?:gnu{S})?{w('general public licen')}[cs]e", r"gpl",
           ("1.0", "2.0", "3.0"), r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    Family("lgpl", "general public",
           rf"(?:gnu{S})?(?:lesser|library){S}{w('general public licen')}[cs]e", r"lgpl",
           ("2.0", "2.1", "3.0"), r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    Family("agpl", "affero", rf"(?:gnu{S})?affero{S}{w('general public licen')}[cs]e", r"agpl",
           ("1.0", "3.0"), r"gnu\.org/licenses/agpl"),
    Family("gfdl", "free documentation", rf"(?:gnu{S})?{w('free documentation licen')}[cs]e",
           r"gfdl", ("1.1", "1.2", "1.3"), r"gnu\.org/licenses/fdl"),
    Family("apache", "apache", rf"apache{S}(?:software{S})?licen[cs]e", r"apache",
           ("1.0", "1.1", "2.0"), r"apache\.org/licenses/license"),
    Family("mit", "mit", rf"mit(?:/x11|{S}x11)?{S}licen[cs]e", r"mit", (),
           r"opensource\.org/licen[cs]es?/mit", True),
    Family("bsd", "bsd", rf"(?:(?:original|simplified|modified|new|revised){S})?bsd{S}licen[cs]e",
           r"bsd", ("1-clause", "2-clause", "3-clause", "4-clause"),
           r"opensource\.org/licen[cs]es?/bsd"),
    Family("isc", "isc", rf"isc{S}licen[cs]e", r"isc", (), r"opensource\.org/licen[cs]es?/isc",
           True),
    Family("mpl", "mozilla", rf"mozilla{S}{w('public licen')}[cs]e", r"mpl",
           ("1.0", "1.1", "2.0"), r"mozilla\.org/mpl"),
    Family("epl", "eclipse", rf"eclipse{S}{w('public licen')}[cs]e", r"epl", ("1.0", "2.0"),
           r"eclipse\.org/(?:legal/)?epl"),
    Family("edl", "eclipse", rf"eclipse{S}{w('distribution licen')}[cs]e", r"edl", ("1.0",),
           r"eclipse\.org/org/documents/edl"),
    Family("cddl", "development and distribution",
           rf"{w('common development and distribution licen')}[cs]e", r"cddl", ("1.0", "1.1"),
           r"opensource\.org/licen[cs]es?/cddl"),
    Family("cpl", "common public", rf"{w('common public licen')}[cs]e", r"cpl", ("1.0",),
           r"opensource\.org/licen[cs]es?/cpl"),
    Family("boost", "boost", rf"boost{S}{w('software licen')}[cs]e", r"bsl", ("1.0",),
           r"boost\.org/license"),
    Family("artistic", "artistic", rf"artistic{S}licen[cs]e", r"artistic", ("1.0", "2.0"),
           r"perlfoundation\.org/artistic"),
    Family("zlib", "zlib", rf"zlib(?:/libpng)?{S}licen[cs]e", r"zlib", (),
           r"zlib\.net/zlib_license"),
    Family("unlicense", "unlicense", r"(?:the\s{1,3})?unlicense", r"unlicense", (),
           r"unlicense\.org"),
    Family("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", ("1.0", "2.0"), r"wtfpl\.net"),
    Family("eupl", "european union", rf"{w('european union public licen')}[cs]e", r"eupl",
           ("1.0", "1.1", "1.2"), r"eupl\.eu"),
    Family("osl", "open software", rf"{w('open software licen')}[cs]e", r"osl",
           ("1.0", "2.0", "2.1", "3.0"), r"opensource\.org/licen[cs]es?/osl"),
    Family("afl", "academic free", rf"{w('academic free licen')}[cs]e", r"afl",
           ("1.1", "1.2", "2.0", "2.1", "3.0"), r"opensource\.org/licen[cs]es?/afl"),
    Family("ofl", "open font", rf"(?:sil{S})?{w('open font licen')}[cs]e", r"ofl",
           ("1.0", "1.1"), r"scripts\.sil\.org/ofl"),
    Family("odbl", "open database", rf"{w('open database licen')}[cs]e", r"odbl", ("1.0",),
           r"opendatacommons\.org/licen[cs]es/odbl"),
    Family("odc-by", "open data commons attribution",
           rf"{w('open data commons attribution licen')}[cs]e", r"odc-by", ("1.0",),
           r"opendatacommons\.org/licen[cs]es/by"),
    Family("pddl", "public domain dedication and licen",
           rf"{w('public domain dedication and licen')}[cs]e", r"pddl", ("1.0",),
           r"opendatacommons\.org/licen[cs]es/pddl"),
    Family("psf", "python software foundation",
           rf"{w('python software foundation licen')}[cs]e", r"psf|python", ("2.0",),
           r"docs\.python\.org/\d/license"),
    Family("php", "php", rf"php{S}licen[cs]e", r"php", ("3.0", "3.01"), r"php\.net/license"),
    Family("ruby", "ruby", rf"ruby{S}licen[cs]e|licen[cs]e{S}of{S}ruby", r"ruby", (), "", True),
    Family("postgresql", "postgresql", rf"postgresql{S}licen[cs]e", r"postgresql", (),
           r"postgresql\.org/about/licence"),
    Family("openssl", "openssl", rf"openssl{S}licen[cs]e", r"openssl", (),
           r"openssl\.org/source/license"),
    Family("ncsa", "illinois", rf"university{S}of{S}illinois.{{0,40}}licen[cs]e", r"ncsa",
           (), r"opensource\.org/licen[cs]es?/ncsa"),
    Family("upl", "universal permissive", rf"{w('universal permissive licen')}[cs]e", r"upl",
           ("1.0",), r"opensource\.org/licen[cs]es?/upl"),
    Family("ms-pl", "microsoft public", rf"{w('microsoft public licen')}[cs]e", r"ms-pl", (),
           r"opensource\.org/licen[cs]es?/ms-pl"),
    Family("ms-rl", "microsoft reciprocal", rf"{w('microsoft reciprocal licen')}[cs]e", r"ms-rl",
           (), r"opensource\.org/licen[cs]es?/ms-rl"),
    Family("sspl", "server side public", rf"{w('server side public licen')}[cs]e", r"sspl",
           ("1.0",), r"mongodb\.com/licensing/server-side"),
    Family("busl", "business source", rf"{w('business source licen')}[cs]e", r"busl", ("1.1",),
           r"mariadb\.com/bsl11"),
    Family("elastic", "elastic", rf"elastic{S}licen[cs]e", r"elastic", ("1.0", "2.0"),
           r"elastic\.co/licensing", True),
    Family("cecill", "cecill", r"cecill", r"cecill(?:-[bc])?", ("1.0", "1.1", "2.0", "2.1"),
           r"cecill\.info"),
    Family("vim", "vim", rf"vim{S}licen[cs]e", r"vim", (), "", True),
    Family("openrail", "openrail", r"(?:bigscience|creativeml)?\s{0,2}openrail(?:-m|\+\+)?",
           r"openrail", (), r"huggingface\.co/spaces/[a-z]{1,40}/license"),
    Family("cc0", "cc0", rf"cc0(?:{S}universal)?", r"cc0", ("1.0",),
           r"creativecommons\.org/publicdomain/zero"),
)

# Creative Commons terms: identifier tail and its words; fixed values.
CC_TERMS = {
    "by": "attribution",
    "by-sa": "attribution sharealike",
    "by-nd": "attribution noderivatives",
    "by-nc": "attribution noncommercial",
    "by-nc-sa": "attribution noncommercial sharealike",
    "by-nc-nd": "attribution noncommercial noderivatives",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Statements that name no family; fixed values.
STATEMENTS = (
    Rule("mit-grant", "mit", 80, ("permission is hereby granted",),
         rf"{w('permission is hereby granted')},?\s{{1,4}}{w('free of charge')}"),
    Rule("bsd-redistribution", "bsd", 80, ("redistribution and use",),
         rf"{w('redistribution and use in source and binary forms')}"),
    Rule("isc-grant", "isc", 80, ("permission to use",),
         rf"{w('permission to use')},?{S}{w('copy')},?{S}{w('modify')}"),
    Rule("public-domain", "public-domain", 60, ("public domain",),
         rf"(?:dedicated{S}to|released{S}into|in){S}{w('the public domain')}"),
    Rule("all-rights-reserved", "proprietary", 40, ("all rights reserved",),
         w("all rights reserved")),
    Rule("proprietary", "proprietary", 60, ("proprietary",),
         rf"proprietary{S}(?:and{S}confidential|licen[cs]e)"),
    Rule("unnamed-notice", "unknown", 10, ("licen",), rf"licen[cs]ed{S}under\b"),
    Rule("unnamed-release", "unknown", 10, ("released under",), rf"released{S}under\b"),
    Rule("unnamed-distribution", "unknown", 10, ("distributed under",), rf"distributed{S}under\b"),
)

# Short forms as people write them; each with its own keyword, tried beside the rules of the
# families. L: the word licence; D: what may stand before a version.
L = r"licen[cs]e"
D = r"[\s-]{0,2}(?:version[\s-]{0,2}|v(?:er)?\.?\s?)?"
LATER = r"(?:-only|-or-later|\+)?(?![\w.]*\d)"
SHORT = (
    Rule("gpl-1.0:short", "gpl-1.0", 82, ("gpl",), rf"\b(?:gnu[\s-])?gpl{D}1(?:\.0)?{LATER}"),
    Rule("gpl-2.0:short", "gpl-2.0", 82, ("gpl",), rf"\b(?:gnu[\s-])?gpl{D}2(?:\.0)?{LATER}"),
    Rule("gpl-3.0:short", "gpl-3.0", 82, ("gpl",), rf"\b(?:gnu[\s-])?gpl{D}3(?:\.0)?{LATER}"),
    Rule("gpl:short", "gpl", 48, ("gpl",), r"\b(?:gnu[\s-])?gpl\b"),
    Rule("lgpl-2.0:short", "lgpl-2.0", 82, ("lgpl",), rf"\b(?:gnu[\s-])?lgpl{D}2(?:\.0)?{LATER}"),
    Rule("lgpl-2.1:short", "lgpl-2.1", 82, ("lgpl",), rf"\b(?:gnu[\s-])?lgpl{D}2\.1{LATER}"),
    Rule("lgpl-3.0:short", "lgpl-3.0", 82, ("lgpl",), rf"\b(?:gnu[\s-])?lgpl{D}3(?:\.0)?{LATER}"),
    Rule("lgpl:short", "lgpl", 48, ("lgpl",), r"\b(?:gnu[\s-])?lgpl\b"),
    Rule("agpl-3.0:short", "agpl-3.0", 82, ("agpl",), rf"\b(?:gnu[\s-])?agpl{D}3(?:\.0)?{LATER}"),
    Rule("agpl:short", "agpl", 48, ("agpl",), r"\b(?:gnu[\s-])?agpl\b"),
    Rule("gfdl:short", "gfdl", 48, ("gfdl",), r"\bgfdl\b"),
    Rule("gfdl-1.3:short", "gfdl-1.3", 82, ("gfdl",), rf"\bgfdl{D}1\.3{LATER}"),
    Rule("apache-1.1:short", "apache-1.1", 82, ("apache 1 1",), r"\bapache[\s-]1\.1(?![\w.]*\d)"),
    Rule("apache-2.0:short", "apache-2.0", 82, ("apache 2",),
         rf"\bapache[\s-]2(?:\.0)?(?![\w.]*\d)(?:{S}{L})?"),
    Rule("apache-2.0:version", "apache-2.0", 82, ("apache v",),
         rf"\bapache[\s-]v(?:ersion\s)?\.?2(?:\.0)?(?![\w.]*\d)(?:{S}{L})?"),
    Rule("apache-2.0:asl", "apache-2.0", 78, ("asl 2",), r"\basl[\s-]2(?:\.0)?(?![\w.]*\d)"),
    Rule("mit:expat", "mit", 60, ("expat",), rf"\bexpat{S}{L}\b"),
    Rule("mit:style", "mit", 55, ("mit style",), rf"\bmit[\s-]style{S}{L}\b"),
    Rule("mit:licensed", "mit", 55, ("mit licensed",), r"\bmit[\s-]licen[cs]ed\b"),
    Rule("mit-0:short", "mit-0", 82, ("mit 0",), r"\bmit-0\b"),
    Rule("bsd-1-clause:short", "bsd-1-clause", 84, ("bsd 1 clause",),
         rf"\bbsd[\s-]1[\s-]clause\b(?:{S}{L})?"),
    Rule("bsd-2-clause:short", "bsd-2-clause", 84, ("bsd 2 clause",),
         rf"\bbsd[\s-]2[\s-]clause\b(?:{S}{L})?"),
    Rule("bsd-3-clause:short", "bsd-3-clause", 84, ("bsd 3 clause",),
         rf"\bbsd[\s-]3[\s-]clause\b(?:{S}{L})?"),
    Rule("bsd-4-clause:short", "bsd-4-clause", 84, ("bsd 4 clause",),
         rf"\bbsd[\s-]4[\s-]clause\b(?:{S}{L})?"),
    Rule("bsd-2-clause:front", "bsd-2-clause", 84, ("2 clause bsd",),
         rf"\b2[\s-]clause[\s-]bsd\b(?:{S}{L})?"),
    Rule("bsd-3-clause:front", "bsd-3-clause", 84, ("3 clause bsd",),
         rf"\b3[\s-]clause[\s-]bsd\b(?:{S}{L})?"),
    Rule("bsd-4-clause:front", "bsd-4-clause", 84, ("4 clause bsd",),
         rf"\b4[\s-]clause[\s-]bsd\b(?:{S}{L})?"),
    Rule("bsd-2-clause:words", "bsd-2-clause", 84, ("two clause bsd",),
         rf"\btwo[\s-]clause[\s-]bsd\b(?:{S}{L})?"),
    Rule("bsd-3-clause:words", "bsd-3-clause", 84, ("three clause bsd",),
         rf"\bthree[\s-]clause[\s-]bsd\b(?:{S}{L})?"),
    Rule("bsd:style", "bsd", 55, ("bsd style",), rf"\bbsd[\s-]style{S}{L}\b"),
    Rule("bsd:licensed", "bsd", 55, ("bsd licensed",), r"\bbsd[\s-]licen[cs]ed\b"),
    Rule("bsd-0-clause:short", "0bsd", 82, ("0bsd",), r"\b0bsd\b"),
    Rule("mpl-1.1:short", "mpl-1.1", 82, ("mpl",), rf"\bmpl{D}1\.1{LATER}"),
    Rule("mpl-2.0:short", "mpl-2.0", 82, ("mpl",), rf"\bmpl{D}2(?:\.0)?{LATER}"),
    Rule("epl-1.0:short", "epl-1.0", 82, ("epl",), rf"\bepl{D}1(?:\.0)?{LATER}"),
    Rule("epl-2.0:short", "epl-2.0", 82, ("epl",), rf"\bepl{D}2(?:\.0)?{LATER}"),
    Rule("cddl-1.0:short", "cddl-1.0", 82, ("cddl",), rf"\bcddl{D}1(?:\.0)?{LATER}"),
    Rule("cddl-1.1:short", "cddl-1.1", 82, ("cddl",), rf"\bcddl{D}1\.1{LATER}"),
    Rule("cddl:short", "cddl", 48, ("cddl",), r"\bcddl\b"),
    Rule("eupl-1.2:short", "eupl-1.2", 82, ("eupl",), rf"\beupl{D}1\.2{LATER}"),
    Rule("eupl:short", "eupl", 48, ("eupl",), r"\beupl\b"),
    Rule("sspl-1.0:short", "sspl-1.0", 82, ("sspl",), rf"\bsspl{D}1(?:\.0)?{LATER}"),
    Rule("busl-1.1:short", "busl-1.1", 82, ("busl",), rf"\bbusl{D}1\.1{LATER}"),
    Rule("boost-1.0:short", "boost-1.0", 82, ("bsl 1 0",), r"\bbsl[\s-]1\.0\b"),
    Rule("osl-3.0:short", "osl-3.0", 82, ("osl 3",), rf"\bosl{D}3(?:\.0)?{LATER}"),
    Rule("afl-3.0:short", "afl-3.0", 82, ("afl 3",), rf"\bafl{D}3(?:\.0)?{LATER}"),
    Rule("ofl-1.1:short", "ofl-1.1", 82, ("ofl 1 1",), r"\b(?:sil[\s-])?ofl[\s-]1\.1\b"),
    Rule("odbl-1.0:short", "odbl-1.0", 82, ("odbl 1 0",), r"\bodbl[\s-]1\.0\b"),
    Rule("odbl:short", "odbl", 48, ("odbl",), r"\bodbl\b"),
    Rule("psf-2.0:short", "psf-2.0", 82, ("psf 2 0",), r"\bpsf[\s-]2\.0\b"),
    Rule("artistic-2.0:short", "artistic-2.0", 82, ("artistic 2 0",), r"\bartistic[\s-]2\.0\b"),
    Rule("ncsa:short", "ncsa", 60, ("ncsa",), rf"\bncsa{S}(?:open{S}source{S})?{L}\b"),
    Rule("ms-pl:short", "ms-pl", 60, ("ms pl",), r"\bms-pl\b"),
    Rule("upl-1.0:short", "upl-1.0", 82, ("upl 1 0",), r"\bupl[\s-]1\.0\b"),
    Rule("isc:licensed", "isc", 55, ("isc licensed",), r"\bisc[\s-]licen[cs]ed\b"),
    Rule("zlib:style", "zlib", 55, ("zlib style",), rf"\bzlib[\s-]style{S}{L}\b"),
    Rule("cc0-1.0:short", "cc0-1.0", 84, ("cc0 1 0",), r"\bcc0[\s-]1\.0\b"),
    Rule("copyleft", "copyleft", 30, ("copyleft",), r"\bcopyleft\b"),
    Rule("fair-source", "fair-source", 60, ("fair source",), rf"\bfair{S}source{S}{L}\b"),
    Rule("polyform", "polyform", 60, ("polyform",),
         rf"\bpolyform{S}(?:noncommercial|shield|strict|perimeter|small{S}business)\b"),
    Rule("commons-clause", "commons-clause", 60, ("commons clause",), rf"\bcommons{S}clause\b"),
    Rule("beerware", "beerware", 60, ("beerware",), r"\bbeerware\b"),
    Rule("no-license", "proprietary", 40, ("no part of this",),
         rf"no{S}part{S}of{S}this.{{0,60}}may{S}be{S}reproduced"),
)


def build_rules() -> list[Rule]:
    """The ordered rules: for each family tag, notice, link and name, each with versions."""
    rules: list[Rule] = []
    grant = rf"(?:licen[cs]ed|released|distributed|available|published){S}(?:under|by)" \
            rf"{S}(?:{w('the terms of')}{S})?"
    for f in FAMILIES:
        keys = ("licen", f.keyword) if f.weak else (f.keyword,)
        for v in f.versions:
            number = re.escape(v).replace(r"\.0", r"(?:\.0)?")
            label = f"{f.label}-{v}"
            rules.append(Rule(f"{label}:tag", label, 100, ("spdx license identifier",),
                              rf"spdx-license-identifier:\s{{0,4}}(?:{f.spdx})-{re.escape(v)}"
                              rf"(?:-only|-or-later|\+)?(?![\w.])"))
            rules.append(Rule(f"{label}:notice", label, 90, (*keys, "under"),
                              rf"{grant}{THE}(?:{f.name}){VER}{number}(?![\w.]*\d)"))
            rules.append(Rule(f"{label}:name", label, 70, keys,
                              rf"\b(?:{f.name}){VER}{number}(?![\w.]*\d)"))
        rules.append(Rule(f"{f.label}:tag", f.label, 95, ("spdx license identifier",),
                          rf"spdx-license-identifier:\s{{0,4}}(?:{f.spdx})\b"))
        rules.append(Rule(f"{f.label}:notice", f.label, 75, (*keys, "under"),
                          rf"{grant}{THE}(?:{f.name})"))
        rules.append(Rule(f"{f.label}:name", f.label, 50, keys,
                          rf"\b(?:{f.name})\b"))
        if f.url:
            rules.append(Rule(f"{f.label}:link", f.label, 65, ("http",),
                              rf"https?://(?:www\.)?{f.url}"))
    for tail, meaning in CC_TERMS.items():
        short = rf"cc[\s-]{{1,2}}{tail.replace('-', '[- ]')}(?![\w-])"
        long = rf"creative{S}commons{S}{w(meaning)}(?![\w-])(?:{S}international|{S}licen[cs]e)?"
        for v in CC_VERSIONS:
            label = f"cc-{tail}-{v}"
            rules.append(Rule(f"{label}:tag", label, 100, ("spdx license identifier",),
                              rf"spdx-license-identifier:\s{{0,4}}{label}"))
            rules.append(Rule(f"{label}:short", label, 85, ("cc by",),
                              rf"(?:{grant}{THE})?\b{short}[\s-]{{1,3}}{re.escape(v)}"))
            rules.append(Rule(f"{label}:long", label, 85, ("creative commons",),
                              rf"{long}{VER}{re.escape(v)}"))
        rules.append(Rule(f"cc-{tail}:short", f"cc-{tail}", 60, ("cc by",),
                          rf"(?:{grant}{THE})?\b{short}"))
        rules.append(Rule(f"cc-{tail}:long", f"cc-{tail}", 60, ("creative commons",), long))
        rules.append(Rule(f"cc-{tail}:link", f"cc-{tail}", 65, ("creativecommons",),
                          rf"creativecommons\.org/licen[cs]es/{tail}/"))
        rules.append(Rule(f"cc-{tail}:named", f"cc-{tail}", 66, ("creative commons",),
                          rf"creative{S}commons{S}{tail.replace('-', '[- ]')}(?![\w-])"))
        for v in CC_VERSIONS:
            rules.append(Rule(f"cc-{tail}-{v}:named", f"cc-{tail}-{v}", 86, ("creative commons",),
                              rf"creative{S}commons{S}{tail.replace('-', '[- ]')}[\s-]{{1,3}}"
                              rf"{re.escape(v)}(?![\w.]*\d)"))
    rules.extend(STATEMENTS + SHORT)
    return sorted(rules, key=lambda r: (-r.priority, r.name))


def resolve(found: list[tuple]) -> list[tuple]:
    """Drops every detection inside one of higher rank; rank: priority, length, rule name.

    ``found``: (priority, start, end, label, rule). Whatever lies inside a dropped one also
    lies inside the one that dropped it, so the furthest end so far of each priority, in
    order of start, is all that has to be known.
    """
    kept: list[tuple] = []
    furthest: dict[int, int] = {}
    for hit in sorted(found, key=lambda h: (h[1], -h[2], -h[0], h[4])):
        if all(end < hit[2] for priority, end in furthest.items() if priority >= hit[0]):
            kept.append(hit)
        furthest[hit[0]] = max(hit[2], furthest.get(hit[0], 0))
    return sorted(kept, key=lambda h: (h[1], h[2], h[4]))


def base_places(words: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
    """All places of the base phrases: count, first and last start word, labels."""
    joined = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in BASE.items():
        wanted = b" " + phrase.encode() + b" "
        at, seen, word = joined.find(wanted), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            seen = at
            starts.append(word)
            labels.add(label)
            at = joined.find(wanted, at + 1)
    return len(starts), min(starts, default=None), max(starts, default=None), labels


def scanner(rules: list[Rule] | None = None):
    """Function from texts to the tuples of ``ADDED``."""
    gated: dict[tuple[str, ...], list[Rule]] = {}
    for r in build_rules() if rules is None else rules:
        gated.setdefault(r.keywords, []).append(r)
    gate = ahocorasick.Automaton()
    for keys in gated:
        gate.add_word(keys[0], keys[0])
    gate.make_automaton()
    compiled = functools.cache(re.compile)  # most rules never run

    def scan(text: str) -> tuple:
        words = words_of(text)
        n_base, first, last, base = base_places(words)
        joined = b" ".join(words).decode("latin-1")
        present = {key for _, key in gate.iter(joined)}
        run = [r for keys, group in gated.items()
               if keys[0] in present and all(k in joined for k in keys[1:]) for r in group]
        low = lower_ascii(text) if run else ""
        found = [(r.priority, m.start(), m.end(), r.label, r.name)
                 for r in run for m in compiled(r.pattern).finditer(low)]
        hits = resolve(found)
        labels = base | {h[3] for h in hits}
        score = max([h[0] / 100 for h in hits] + [0.5] * bool(n_base), default=0.0)
        return (len(words), n_base, first, last, ",".join(sorted(base)),
                ",".join(sorted(labels)), score,
                [(h[3], h[4], h[0], h[1], h[2]) for h in hits])

    return lambda texts: [scan(t) for t in texts]


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with word count, base phrase places, labels, score and detections."""
    return annotate(df, text, ADDED, scanner)
