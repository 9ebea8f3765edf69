import random
import re
import sys

from pyspark.sql import functions as F

from braidwork.llm import license

RULES = license.default_rules()
COMPILED = [re.compile(f"(?<= )(?:{r.pattern})(?= )") for r in RULES]


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license.BASE.items():
        p = phrase.split()
        at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    low = re.sub(r"([0-9])\+(?![0-9a-z+])", r"\1 or later ", low)
    w = " " + "".join(x + " " for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    found = sorted((m.start(), -m.end(), r.priority, i) for i, r in enumerate(RULES) if r.keyword in w for m in COMPILED[i].finditer(w))
    kept = []
    for k, (_, e, p, i) in enumerate(found):
        if not any(-f[1] >= -e and f[2] <= p for f in kept):
            kept.append(found[k])
    every = labels | {RULES[f[3]].label for f in kept}
    score = max([0.0] + [license.WEIGHTS[f[2]] for f in kept] + [license.BASE_SCORE] * bool(labels))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score


LINES = ["This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Copyright (c) 2019 2020 Someone", "CC-BY CC BY", "GPLv2 or later", "the public domain", "KCC BY", "Licenİed gpl"]


def texts():
    rng = random.Random(5)
    filler = ["foo", "Bar", "é", "licen", "copyrights", "1999", "cc", "by", "K", "mit", "_", "\x00"]
    out = [None, "", " .", "cc by", "CC  BY!cc;by", "all rights reserved all rights reserved", "word " * 30000 + "cc by", "Copyright. " * 2500]
    for _ in range(60):
        out.append(" ".join(rng.choice([rng.choice(LINES), *(rng.choice(filler) for _ in range(6))]) for _ in range(rng.randrange(40))))
    return out


def test_scan_is_the_plain_scan(spark):
    rows = list(enumerate(texts())) + [(None, LINES[0]), (4, texts()[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit("clash")).withColumn("kept", F.lit("clash"))
    got = sorted(map(tuple, license.scan(docs).collect()), key=repr)
    assert got == sorted(((d, *plain(t)) for d, t in rows), key=repr)


#: Sentences and the labels that a reader would give them, written without a look at the rules.
WANTED = {
    "Distributed under a GPL v3 or later licence.": "gpl-3.0-or-later",
    "It runs behind Apache 2.4 as web server.": "",
    "Licensed under the Apache License, Version 2.0 (the License).": "apache-2.0,licensed",
    "This file is Apache-2.0 code.": "apache-2.0",
    "Under the Common Development and Distribution License.": "cddl",
    "Under the Common Development and Distribution License, Version 1.1.": "cddl-1.1",
    "The Academic Free License applies.": "afl",
    "The Academic Free License v. 3.0 applies.": "afl-3.0",
    "Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported": "cc-by-nc-nd-3.0",
    "Creative Commons Attribution-Non-Commercial-No-Derivs 3.0": "cc-by-nc-nd-3.0",
    "Creative Commons Attribution Non-Commercial Share-Alike": "cc-by-nc-sa",
    "GNU General Public License, version 3, 29 June 2007": "gpl,gpl-3.0",
    "the AGPLv3 or any later version": "agpl-3.0-or-later",
    "a Mozilla Public License 2.0 project": "mpl-2.0",
    "SIL Open Font License 1.1": "ofl-1.1",
    "a copy of the MIT licence": "mit",
    "This gadget needs no permit at all.": "",
    "It is under the GNU GPL v3 now.": "gpl-3.0",
    "It is under GNU LGPL version 2.1.": "lgpl-2.1",
    "License: GPL-2.0+": "gpl-2.0-or-later",
    "This library is LGPLv2.1+.": "lgpl-2.1-or-later",
    "SPDX-License-Identifier: GPL-2.0+": "gpl-2.0-or-later",
    "SPDX-License-Identifier: LGPL-3.0-only": "lgpl-3.0",
    "Licensed under the EUPL v1.2": "eupl-1.2,licensed",
    "License: Apache-2.0 OR MIT": "apache-2.0,mit",
    "MIT or Apache 2.0, as you like": "apache-2.0,mit",
    "He went to MIT or Harvard.": "",
    "either version 3 of the License, or (at your option) any later version of the GNU General Public License": "gpl",
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3.0-or-later",
    "the terms of version 2 of the GNU General Public License": "gpl,gpl-2.0",
}


def test_labels_that_a_reader_would_give(spark):
    docs = spark.createDataFrame(list(enumerate(WANTED)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license.scan(docs).collect()}
    assert {t: got[k] for k, t in enumerate(WANTED)} == WANTED


def test_only_two_letters_gain_ascii_when_lower_cased():
    gain = {chr(c) for c in range(0x80, sys.maxunicode + 1) if any(ord(x) < 128 for x in chr(c).lower())}
    assert gain == {"K", "İ"}


def test_rules_compile_and_contain_their_keyword():
    assert len(RULES) > 200
    for rule in RULES:
        stem = rule.pattern.replace("[sc]", "s").replace("(?:", "").replace(")?", "").replace(")", "")
        assert rule.keyword.split()[0][:3] in stem


def test_empty_table(spark):
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
