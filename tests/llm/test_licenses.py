import re

from ledgerlens.llm.licenses import SHORT, build_rules, resolve, scan_licenses, scanner


def brute_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"),
                          ("cc by", "cc-by"), ("mit license", "mit")):
        parts = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def test_hundreds_of_rules_with_unique_names():
    rules = build_rules()
    assert len(rules) > 300 and len({r.name for r in rules}) == len(rules)
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def test_labels_of_typical_statements():
    scan = scanner()
    for text, labels in (
            ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
            ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
            ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
            ("see https://www.mozilla.org/MPL/", "mpl"),
            ("Permission is hereby granted, free of charge", "mit"),
            ("BSD 3-Clause License", "bsd-3-clause"), ("BSD-3-Clause", "bsd-3-clause"),
            ("the three-clause BSD licence", "bsd-3-clause"), ("Apache-2.0", "apache-2.0"),
            ("the Apache 2.0 License", "apache-2.0"), ("LGPL-2.1", "lgpl-2.1"),
            ("LGPLv2.1+", "lgpl-2.1"), ("MPL 2.0", "mpl-2.0"), ("NCSA License", "ncsa"),
            ("GNU GPL version 3", "gpl-3.0"), ("Licensed under GPLv3", "gpl-3.0,unknown"),
            ("released under nothing known", "unknown"), ("Creative Commons BY-NC 4.0", "cc-by-nc-4.0"),
            ("AGPL-3.0-or-later", "agpl-3.0"), ("gpl 3.5 and GPL", "gpl"),
            ("the house of mit is not licensed", "")):
        assert scan([text])[0][5] == labels, text


def test_every_hand_written_rule_passes_its_gate():
    """An example of each rule, made from its keyword, is found through the gate."""
    examples = {
        "gpl-1.0:short": "GPL-1.0", "gpl-2.0:short": "GPLv2", "gpl-3.0:short": "GNU GPL version 3",
        "gpl:short": "the GPL", "lgpl-2.0:short": "LGPL 2.0", "lgpl-2.1:short": "LGPL-2.1",
        "lgpl-3.0:short": "LGPLv3", "lgpl:short": "GNU LGPL", "agpl-3.0:short": "AGPL v3",
        "agpl:short": "AGPL", "gfdl:short": "GFDL", "gfdl-1.3:short": "GFDL-1.3",
        "apache-1.1:short": "Apache-1.1", "apache-2.0:short": "Apache-2.0",
        "apache-2.0:version": "Apache v2", "apache-2.0:asl": "ASL 2.0", "mit:expat": "Expat License",
        "mit:style": "MIT-style license", "mit:licensed": "MIT licensed", "mit-0:short": "MIT-0",
        "bsd-1-clause:short": "BSD-1-Clause", "bsd-2-clause:short": "BSD 2-Clause",
        "bsd-3-clause:short": "BSD-3-Clause", "bsd-4-clause:short": "BSD-4-Clause",
        "bsd-2-clause:front": "2-clause BSD", "bsd-3-clause:front": "3-Clause BSD License",
        "bsd-4-clause:front": "4-clause BSD", "bsd-2-clause:words": "two-clause BSD",
        "bsd-3-clause:words": "three clause BSD", "bsd:style": "BSD-style license",
        "bsd:licensed": "BSD-licensed", "bsd-0-clause:short": "0BSD", "mpl-1.1:short": "MPL 1.1",
        "mpl-2.0:short": "MPLv2", "epl-1.0:short": "EPL-1.0", "epl-2.0:short": "EPL 2.0",
        "cddl-1.0:short": "CDDL 1.0", "cddl-1.1:short": "CDDL-1.1", "cddl:short": "CDDL",
        "eupl-1.2:short": "EUPL v1.2", "eupl:short": "EUPL", "sspl-1.0:short": "SSPL v1",
        "busl-1.1:short": "BUSL-1.1", "boost-1.0:short": "BSL-1.0", "osl-3.0:short": "OSL 3.0",
        "afl-3.0:short": "AFL-3.0", "ofl-1.1:short": "SIL OFL 1.1", "odbl-1.0:short": "ODbL-1.0",
        "odbl:short": "ODbL", "psf-2.0:short": "PSF-2.0", "artistic-2.0:short": "Artistic-2.0",
        "ncsa:short": "NCSA Open Source License", "ms-pl:short": "MS-PL", "upl-1.0:short": "UPL-1.0",
        "isc:licensed": "ISC licensed", "zlib:style": "zlib-style license", "cc0-1.0:short": "CC0 1.0",
        "copyleft": "copyleft", "fair-source": "Fair Source License",
        "polyform": "PolyForm Noncommercial", "commons-clause": "Commons Clause",
        "beerware": "Beerware", "no-license": "no part of this book may be reproduced"}
    assert set(examples) == {r.name for r in SHORT}
    for rule in SHORT:
        found = scanner([rule])([f"x {examples[rule.name]}, y"])[0][7]
        assert [d[1] for d in found] == [rule.name], (rule, found)


def test_the_gate_hides_nothing():
    """With the gate and without it the same is found, on statements of every kind."""
    rules = build_rules()
    texts = ["GPLv3 or NCSA License", "distributed under the MIT/X11 license, see LICENSE",
             "SPDX-License-Identifier: BSD-3-Clause", "BSD 2-Clause License and Apache 2.0",
             "Creative Commons Attribution-ShareAlike 4.0 International",
             "University of Illinois/NCSA Open Source License", "CC-BY-SA-3.0, CC BY 4.0",
             "Eclipse Public License - v 2.0", "the mozilla public licence, version 1.1",
             "Permission to use, copy, modify", "All rights reserved. (proprietary license)",
             "https://creativecommons.org/licenses/by-nc/4.0/ https://opensource.org/licenses/MIT"]
    for text in texts:
        low = text.lower()
        every = resolve([(r.priority, m.start(), m.end(), r.label, r.name)
                         for r in rules for m in re.finditer(r.pattern, low)])
        gated = scanner(rules)([text])[0][7]
        assert gated == [(h[3], h[4], h[0], h[1], h[2]) for h in every], text


def test_containment_against_pairwise_rule():
    found = [(90, 0, 10, "a", "r1"), (50, 2, 8, "b", "r2"), (50, 2, 12, "c", "r3"),
             (95, 3, 5, "d", "r4"), (50, 3, 9, "e", "r5"), (50, 2, 12, "f", "r6")]
    rank = lambda h: (-h[0], h[1] - h[2], h[4])
    want = [h for h in found if not any(
        o is not h and o[1] <= h[1] and h[2] <= o[2] and rank(o) < rank(h) for o in found)]
    assert sorted(resolve(found)) == sorted(want)


def test_edge_rows_and_base_counts(spark):
    texts = [None, "", "CC BY cc by\tMIT   License", "café mit license é cc-by x", "a " * 50000,
             "GNU GENERAL public license" * 3, "gnu general public license\x00", "cc by", "cc by"]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, LABELS string, n_words int")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"],
                r["base_labels"]) == brute_base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert scan_licenses(df.limit(0)).count() == 0


def test_long_runs_are_linear():
    scan = scanner()
    scan(["licensed under" + " " * 300000 + "gnu general public"])
    scan(["licensed under the terms of " * 20000])
