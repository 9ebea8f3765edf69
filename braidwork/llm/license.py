"""License scans: ordered signature rules with keyword gates, natively in SQL.

A text is first put in a normal form: A-Z lower-cased, words joined by single
spaces.  Base phrases are counted there.  Signature rules are regular
expressions over the normal form; a rule runs only if its keyword occurs, and a
text without any keyword costs a few substring searches; there "+" behind a
version reads "or later".  Every match is an
interval.  Sweeping them by start (longer first, better priority first), a
match is suppressed if one of a better or equal priority that came before
contains it, so "general public license" inside "gnu general public license
version 3" is not reported beside it.

Everything is one projection of one row: no shuffle, no Python, and a lost task
repeats its own rows only.

Defined results: a null text is an empty one; without words n_words and n_base
are 0, first_word and last_word null, labels empty and the score 0.  Rows do
not depend on each other; only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_SCORE = 0.5
#: Words are runs of anything but these.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Score of a match by its rule's priority: named with a version, named, family, mere notice.
WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.6, 4: 0.3}
#: Hits of a rule that one step gathers.
STEP = 1000


class Rule(NamedTuple):
    keyword: str
    pattern: str
    priority: int
    label: str


#: (keyword, pattern, priority, label, versions); {v} is a version in the pattern ("3 0", the zero optional) and the label.
#: Patterns are over the normal form, between spaces.
SIGNATURES = [
    # Creative Commons
    ("creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? {v}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", 1, "cc-by-nc-nd-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("creative commons", r"creative commons attribution non ?commercial share ?alike {v}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", 1, "cc-by-nc-sa-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("creative commons", r"creative commons attribution non ?commercial {v}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", 1, "cc-by-nc-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)? {v}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", 1, "cc-by-nd-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("creative commons", r"creative commons attribution share ?alike {v}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", 1, "cc-by-sa-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("creative commons", r"creative commons attribution {v}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", 1, "cc-by-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?", 2, "cc-by-nc-nd", ""),
    ("creative commons", r"creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?", 2, "cc-by-nc-sa", ""),
    ("creative commons", r"creative commons attribution non ?commercial(?: licen[sc]e)?", 2, "cc-by-nc", ""),
    ("creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?", 2, "cc-by-nd", ""),
    ("creative commons", r"creative commons attribution share ?alike(?: licen[sc]e)?", 2, "cc-by-sa", ""),
    ("creative commons", r"creative commons attribution(?: licen[sc]e)?", 2, "cc-by", ""),
    ("creative commons", r"creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?", 1, "cc0-1.0", ""),
    ("creative commons", r"creative commons(?: public)? licen[sc]e", 3, "cc", ""),
    ("cc by", r"cc by nc nd {v}", 1, "cc-by-nc-nd-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("cc by", r"cc by nc sa {v}", 1, "cc-by-nc-sa-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("cc by", r"cc by nc {v}", 1, "cc-by-nc-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("cc by", r"cc by nd {v}", 1, "cc-by-nd-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("cc by", r"cc by sa {v}", 1, "cc-by-sa-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("cc by", r"cc by {v}", 1, "cc-by-{v}", "1.0 2.0 2.5 3.0 4.0"),
    ("cc by", r"cc by nc nd", 2, "cc-by-nc-nd", ""),
    ("cc by", r"cc by nc sa", 2, "cc-by-nc-sa", ""),
    ("cc by", r"cc by nc", 2, "cc-by-nc", ""),
    ("cc by", r"cc by nd", 2, "cc-by-nd", ""),
    ("cc by", r"cc by sa", 2, "cc-by-sa", ""),
    ("cc by", r"cc by", 3, "cc-by", ""),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", 2, "cc0-1.0", ""),
    ("creativecommons", r"creativecommons org licenses by nc nd {v}", 1, "cc-by-nc-nd-{v}", "2.0 2.5 3.0 4.0"),
    ("creativecommons", r"creativecommons org licenses by nc sa {v}", 1, "cc-by-nc-sa-{v}", "2.0 2.5 3.0 4.0"),
    ("creativecommons", r"creativecommons org licenses by nc {v}", 1, "cc-by-nc-{v}", "2.0 2.5 3.0 4.0"),
    ("creativecommons", r"creativecommons org licenses by sa {v}", 1, "cc-by-sa-{v}", "2.0 2.5 3.0 4.0"),
    ("creativecommons", r"creativecommons org licenses by nd {v}", 1, "cc-by-nd-{v}", "2.0 2.5 3.0 4.0"),
    ("creativecommons", r"creativecommons org licenses by {v}", 1, "cc-by-{v}", "2.0 2.5 3.0 4.0"),
    ("creativecommons", r"creativecommons org publicdomain zero 1 0", 1, "cc0-1.0", ""),
    ("creativecommons", r"creativecommons org publicdomain mark 1 0", 1, "public-domain-mark", ""),
    # GNU
    ("general public licen", r"(?:gnu )?affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?{v}(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)?", 1, "agpl-{v}-or-later", "1.0 3.0"),
    ("general public licen", r"(?:gnu )?lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?{v}(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)?", 1, "lgpl-{v}-or-later", "2.1 3.0"),
    ("general public licen", r"(?:gnu )?library general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?{v}(?: or (?:any )?later(?: version)?)?", 1, "lgpl-{v}", "2.0 2.1"),
    ("general public licen", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?{v}(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)?", 1, "gpl-{v}-or-later", "1.0 2.0 3.0"),
    ("general public licen", r"(?:gnu )?affero general public licen[sc]e v(?:ersion)? ?{v}", 1, "agpl-{v}", "1.0 3.0"),
    ("general public licen", r"(?:gnu )?lesser general public licen[sc]e v(?:ersion)? ?{v}", 1, "lgpl-{v}", "2.1 3.0"),
    ("general public licen", r"(?:gnu )?general public licen[sc]e v(?:ersion)? ?{v}", 1, "gpl-{v}", "1.0 2.0 3.0"),
    ("general public licen", r"v(?:ersion)? ?{v} of the (?:gnu )?affero general public licen[sc]e", 1, "agpl-{v}", "1.0 3.0"),
    ("general public licen", r"v(?:ersion)? ?{v} of the (?:gnu )?lesser general public licen[sc]e", 1, "lgpl-{v}", "2.1 3.0"),
    ("general public licen", r"v(?:ersion)? ?{v} of the (?:gnu )?general public licen[sc]e", 1, "gpl-{v}", "1.0 2.0 3.0"),
    ("general public licen", r"(?:gnu )?affero general public licen[sc]e", 2, "agpl", ""),
    ("general public licen", r"(?:gnu )?lesser general public licen[sc]e", 2, "lgpl", ""),
    ("general public licen", r"gnu general public licen[sc]e", 2, "gpl", ""),
    ("general public licen", r"general public licen[sc]e", 3, "gpl", ""),
    ("gpl", r"(?:gnu )?agpl ?(?:v(?:ersion)? ?)?{v} or (?:any )?later", 1, "agpl-{v}-or-later", "3.0"),
    ("gpl", r"(?:gnu )?lgpl ?(?:v(?:ersion)? ?)?{v} or (?:any )?later", 1, "lgpl-{v}-or-later", "2.1 3.0"),
    ("gpl", r"(?:gnu )?gpl ?(?:v(?:ersion)? ?)?{v} or (?:any )?later", 1, "gpl-{v}-or-later", "1.0 2.0 3.0"),
    ("gpl", r"(?:gnu )?agpl ?(?:v(?:ersion)? ?)?{v}(?: only)?", 1, "agpl-{v}", "1.0 3.0"),
    ("gpl", r"(?:gnu )?lgpl ?(?:v(?:ersion)? ?)?{v}(?: only)?", 1, "lgpl-{v}", "2.0 2.1 3.0"),
    ("gpl", r"(?:gnu )?gpl ?(?:v(?:ersion)? ?)?{v}(?: only)?", 1, "gpl-{v}", "1.0 2.0 3.0"),
    ("gpl", r"(?:gnu )?agpl", 3, "agpl", ""),
    ("gpl", r"(?:gnu )?lgpl", 3, "lgpl", ""),
    ("gpl", r"(?:gnu )?gpl", 3, "gpl", ""),
    ("free documentation licen", r"(?:gnu )?free documentation licen[sc]e v(?:ersion)? ?{v}", 1, "gfdl-{v}", "1.1 1.2 1.3"),
    ("free documentation licen", r"(?:gnu )?free documentation licen[sc]e", 2, "gfdl", ""),
    # Permissive
    ("mit licen", r"(?:the )?mit licen[sc]e", 2, "mit", ""),
    (" mit ", r"(?<=(?: 2 0| gpl| isc| bsd|ause|zlib) or )mit", 2, "mit", ""),
    (" mit ", r"mit(?= (?:or|and) (?:apache|bsd|0bsd|gpl|lgpl|mpl|isc|zlib|unlicen[sc]e|cc0) )", 2, "mit", ""),
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 2, "mit", ""),
    ("permission is hereby granted", r"permission is hereby granted without written agreement", 3, "permissive", ""),
    ("permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 2, "isc", ""),
    ("permission to use copy modify", r"permission to use copy modify and distribute this software", 3, "hpnd", ""),
    ("apache", r"apache(?: software)? licen[sc]e v(?:ersion)? ?{v}", 1, "apache-{v}", "1.0 1.1 2.0"),
    ("apache", r"apache(?: software)? licen[sc]e {v}", 1, "apache-{v}", "1.0 1.1 2.0"),
    ("apache", r"apache 2 0(?: licen[sc]e)?", 1, "apache-2.0", ""),
    ("apache", r"apache org licenses license {v}", 1, "apache-{v}", "1.1 2.0"),
    ("apache", r"apache(?: software)? licen[sc]e", 2, "apache", ""),
    ("bsd", r"bsd (?:2|two) clause(?: licen[sc]e)?", 1, "bsd-2-clause", ""),
    ("bsd", r"bsd (?:3|three) clause(?: licen[sc]e)?", 1, "bsd-3-clause", ""),
    ("bsd", r"bsd (?:4|four) clause(?: licen[sc]e)?", 1, "bsd-4-clause", ""),
    ("bsd", r"(?:2|two) clause bsd(?: licen[sc]e)?", 1, "bsd-2-clause", ""),
    ("bsd", r"(?:3|three) clause bsd(?: licen[sc]e)?", 1, "bsd-3-clause", ""),
    ("bsd", r"(?:new|modified|revised) bsd(?: licen[sc]e)?", 2, "bsd-3-clause", ""),
    ("bsd", r"(?:simplified|free) ?bsd(?: licen[sc]e)?", 2, "bsd-2-clause", ""),
    ("bsd", r"(?:the )?bsd licen[sc]e", 2, "bsd", ""),
    ("bsd", r"0bsd", 1, "0bsd", ""),
    ("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 2, "bsd", ""),
    ("isc licen", r"(?:the )?isc licen[sc]e", 2, "isc", ""),
    ("zlib", r"zlib libpng licen[sc]e", 2, "zlib", ""),
    ("zlib", r"(?:the )?zlib licen[sc]e", 2, "zlib", ""),
    ("boost software", r"boost software licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?", 1, "bsl-1.0", ""),
    ("unlicen", r"(?:the )?unlicen[sc]e", 2, "unlicense", ""),
    ("wtfpl", r"wtfpl", 2, "wtfpl", ""),
    ("public domain", r"(?:released|placed|dedicated|put) (?:in)?to the public domain", 2, "public-domain", ""),
    ("public domain", r"public domain dedication and licen[sc]e", 1, "pddl-1.0", ""),
    ("public domain", r"(?:in )?the public domain", 3, "public-domain", ""),
    # Weak copyleft and others
    ("mozilla", r"mozilla public licen[sc]e v(?:ersion)? ?{v}", 1, "mpl-{v}", "1.0 1.1 2.0"),
    ("mozilla", r"mozilla public licen[sc]e {v}", 1, "mpl-{v}", "1.0 1.1 2.0"),
    ("mozilla", r"mozilla public licen[sc]e", 2, "mpl", ""),
    ("mpl", r"mpl ?v?{v}", 1, "mpl-{v}", "1.0 1.1 2.0"),
    ("eclipse", r"eclipse public licen[sc]e v(?:ersion)? ?{v}", 1, "epl-{v}", "1.0 2.0"),
    ("eclipse", r"eclipse public licen[sc]e {v}", 1, "epl-{v}", "1.0 2.0"),
    ("eclipse", r"eclipse public licen[sc]e", 2, "epl", ""),
    ("eclipse", r"eclipse distribution licen[sc]e(?: v(?:ersion)? ?1 0)?", 1, "edl-1.0", ""),
    ("european union", r"european union public licen[sc]e v(?:ersion)? ?{v}", 1, "eupl-{v}", "1.0 1.1 1.2"),
    ("european union", r"european union public licen[sc]e", 2, "eupl", ""),
    ("eupl", r"eupl ?(?:v(?:ersion)? ?)?{v}", 1, "eupl-{v}", "1.0 1.1 1.2"),
    ("eupl", r"eupl", 3, "eupl", ""),
    ("common development", r"common development and distribution licen[sc]e (?:v(?:ersion)? ?)?{v}", 1, "cddl-{v}", "1.0 1.1"),
    ("common development", r"common development and distribution licen[sc]e", 2, "cddl", ""),
    ("common public", r"common public licen[sc]e (?:v(?:ersion)? ?)?{v}", 1, "cpl-{v}", "1.0"),
    ("common public", r"common public licen[sc]e", 2, "cpl", ""),
    ("artistic", r"artistic licen[sc]e v(?:ersion)? ?{v}", 1, "artistic-{v}", "1.0 2.0"),
    ("artistic", r"artistic licen[sc]e {v}", 1, "artistic-{v}", "1.0 2.0"),
    ("artistic", r"artistic licen[sc]e", 2, "artistic", ""),
    ("open font", r"(?:sil )?open font licen[sc]e (?:v(?:ersion)? ?)?{v}", 1, "ofl-{v}", "1.0 1.1"),
    ("open font", r"(?:sil )?open font licen[sc]e", 2, "ofl", ""),
    ("open database", r"open database licen[sc]e(?: v(?:ersion)? ?1 0)?", 1, "odbl-1.0", ""),
    ("open data commons", r"open data commons attribution licen[sc]e", 1, "odc-by-1.0", ""),
    ("open government", r"open government licen[sc]e v(?:ersion)? ?{v}", 1, "ogl-{v}", "1.0 2.0 3.0"),
    ("open government", r"open government licen[sc]e", 2, "ogl", ""),
    ("python software", r"python software foundation licen[sc]e(?: v(?:ersion)? ?2)?", 2, "psf-2.0", ""),
    ("academic free", r"academic free licen[sc]e (?:v(?:ersion)? ?)?{v}", 1, "afl-{v}", "1.1 2.0 2.1 3.0"),
    ("academic free", r"academic free licen[sc]e", 2, "afl", ""),
    ("open software licen", r"open software licen[sc]e (?:v(?:ersion)? ?)?{v}", 1, "osl-{v}", "1.0 2.0 2.1 3.0"),
    ("open software licen", r"open software licen[sc]e", 2, "osl", ""),
    ("microsoft", r"microsoft public licen[sc]e", 2, "ms-pl", ""),
    ("microsoft", r"microsoft reciprocal licen[sc]e", 2, "ms-rl", ""),
    ("business source", r"business source licen[sc]e(?: 1 1)?", 1, "busl-1.1", ""),
    ("server side public", r"server side public licen[sc]e(?: v(?:ersion)? ?1)?", 1, "sspl-1.0", ""),
    ("elastic licen", r"elastic licen[sc]e(?: v?2(?: 0)?)?", 1, "elastic-2.0", ""),
    ("openrail", r"(?:creativeml |bigscience )?openrail(?: m| s)?(?: licen[sc]e)?", 2, "openrail", ""),
    ("commons clause", r"commons clause(?: licen[sc]e)?(?: condition)?", 2, "commons-clause", ""),
    # Notices
    ("rights reserved", r"all rights reserved", 3, "reserved", ""),
    ("rights reserved", r"some rights reserved", 3, "some-rights", ""),
    ("rights reserved", r"no rights reserved", 3, "no-rights", ""),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])*", 4, "copyright", ""),
    ("copyright", r"copyright", 4, "copyright", ""),
    ("proprietary", r"proprietary and confidential", 3, "proprietary", ""),
    ("unauthorized", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this (?:file|work|document))?", 3, "proprietary", ""),
    ("without permission", r"may not be (?:reproduced|copied|distributed|used) without permission", 3, "proprietary", ""),
    ("licen", r"(?:re)?licen[sc]ed under(?: the)?(?: terms of)?(?: the)?", 4, "licensed", ""),
    ("licen", r"released under(?: the)?(?: terms of)?(?: the)? [a-z0-9]+ licen[sc]e", 4, "licensed", ""),
    ("licen", r"see (?:the )?licen[sc]e(?: file)? for (?:details|more information)", 4, "licensed", ""),
]
#: Identifiers that follow "SPDX-License-Identifier:" or stand as a package's license field.
SPDX = "mit isc zlib unlicense 0bsd wtfpl apache-2.0 bsd-2-clause bsd-3-clause bsd-4-clause gpl-2.0 gpl-3.0 lgpl-2.1 lgpl-3.0 agpl-3.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 eupl-1.2 cddl-1.0 bsl-1.0 artistic-2.0 ofl-1.1 cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 odbl-1.0 ms-pl psf-2.0 afl-3.0 osl-3.0 busl-1.1 sspl-1.0"


def _version(v: str) -> str:
    """Words of a version; the zero is optional unless another digit stands there ("2 4" is no 2.0)."""
    major, _, minor = v.partition(".")
    return (f"{major}(?: 0)?" if minor == "0" else f"{major} {minor}") + "(?! [0-9] )"


def default_rules() -> list[Rule]:
    """All signatures, versions filled in, and one rule for each SPDX identifier."""
    out = []
    for keyword, pattern, priority, label, versions in SIGNATURES:
        for v in versions.split() or [""]:
            out.append(Rule(keyword, pattern.replace("{v}", _version(v) if v else ""), priority, label.replace("{v}", v)))
    for prefix, name in product(("spdx license identifier ",), SPDX.split()):
        words = prefix + name.replace("-", " ").replace(".", " ")
        if "gpl-" in name:
            out.append(Rule("spdx", words + " or later", 1, f"{name}-or-later"))
        out.append(Rule("spdx", words + "(?: only| or later)?", 1, name))
    return out


def normal_form(text):
    """Column: the words with one space before, between and after them; one space if there is none."""
    # Of all non-ASCII letters only these two have a lower case with an ASCII letter in it; they stay as they are.
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001"))
    return F.regexp_replace(F.concat(F.lit("."), F.lower(kept), F.lit(".")), NOT_WORD, " ")


def signed_form(text, w):
    """Column: the normal form w, but with a plus behind a version ("2.0+") as the words it stands for."""
    return F.when(F.contains(text, F.lit("+")), normal_form(F.regexp_replace(text, r"([0-9])\+(?![0-9A-Za-z+])", "$1 or later "))).otherwise(w)


def _spaces(column: str) -> str:
    return f"(length({column}) - length(replace({column}, ' ', '')))"


def _base_columns() -> dict[str, str]:
    """SQL over the normal form w."""
    gate = {p: f"contains(w, ' {p} ')" for p in BASE}
    count = " + ".join(f"if({gate[p]}, regexp_count(w, ' {p}(?= )'), 0)" for p in BASE)
    first = [f"if({gate[p]}, {_spaces(f'''left(w, instr(w, ' {p} '))''')} - 1, null)" for p in BASE]
    last = [f"if({gate[p]}, {_spaces(f'''left(w, length(w) - length(substring_index(w, ' {p} ', -1)) - {len(p) + 1})''')} - 1, null)" for p in BASE]
    labels = ", ".join(f"if({gate[p]}, '{label}', null)" for p, label in BASE.items())
    return {
        "n_words": f"cast({_spaces('w')} - 1 as bigint)",
        "n_base": f"cast({count} as bigint)",
        "first_word": f"cast(least({', '.join(first)}) as bigint)",
        "last_word": f"cast(greatest({', '.join(last)}) as bigint)",
        "base": f"array_compact(array({labels}))",
    }


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def _detections(rules: list[Rule]) -> str:
    """SQL: sorted array of (start, minus_end, priority, rule) of all matches in v."""
    # Arrays of literals are folded into one constant when the query is planned.
    listed = _array(f"named_struct('k', {_quoted(r.keyword)}, 'x', {_quoted(f'(?<= ){r.pattern}(?= )')}, 'p', {r.priority}, 'i', {i})" for i, r in enumerate(rules))
    keywords = _array(map(_quoted, sorted({r.keyword for r in rules})))
    step = f"""aggregate(slice(sequence(1, size(m.h)), b, {STEP}), named_struct('at', a.at, 'out', cast(array() as array<struct<s:int,e:int,p:int,i:int>>)),
        (c, k) -> named_struct('at', c.at + length(m.t[k - 1]) + length(m.h[k - 1]), 'out', concat(c.out, array(named_struct(
            's', c.at + length(m.t[k - 1]), 'e', -(c.at + length(m.t[k - 1]) + length(m.h[k - 1])), 'p', r.p, 'i', r.i)))))"""
    hits = f"""aggregate(sequence(1, greatest(size(m.h), 1), {STEP}), named_struct('at', 0, 'all', cast(array() as array<array<struct<s:int,e:int,p:int,i:int>>>)),
        (a, b) -> transform(array({step}), d -> named_struct('at', d.at, 'all', concat(a.all, array(d.out))))[0],
        a -> flatten(a.all))"""
    matched = f"transform(array(named_struct('h', regexp_extract_all(v, r.x, 0), 't', split(v, r.x, -1))), m -> if(size(m.h) = 0, null, {hits}))[0]"
    found = f"transform(filter({keywords}, k -> contains(v, k)), k -> k)"
    return f"""transform(array({found}), ks -> if(size(ks) = 0, cast(array() as array<struct<s:int,e:int,p:int,i:int>>),
        sort_array(flatten(array_compact(transform(filter({listed}, r -> array_contains(ks, r.k)), r -> {matched}))))))[0]"""


def _kept(priorities: int) -> str:
    """SQL over the sorted detections: rules that keep a match which nothing contains."""
    start = f"named_struct('ends', array_repeat(0, {priorities}), 'kept', cast(array() as array<int>))"
    return f"""aggregate(found, {start}, (a, d) -> if(exists(slice(a.ends, 1, d.p), x -> x >= -d.e), a,
        named_struct('ends', transform(a.ends, (x, q) -> if(q + 1 = d.p, greatest(x, -d.e), x)), 'kept', array_union(a.kept, array(d.i)))), a -> a.kept)"""


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    rules = default_rules() if rules is None else rules
    names = F.expr(_array(_quoted(r.label) for r in rules))
    weights = F.expr(_array(f"{WEIGHTS[r.priority]}D" for r in rules))
    words = docs.select(F.col(key).alias("key"), normal_form(F.col(text)).alias("w"), F.col(text).alias("text")).withColumn("v", signed_form(F.col("text"), F.col("w")))
    found = words.select("key", *(F.expr(sql).alias(name) for name, sql in _base_columns().items()), F.expr(_detections(rules)).alias("found"))
    kept = found.withColumn("kept", F.expr(_kept(len(WEIGHTS))))
    of_rules = lambda table: F.transform("kept", lambda i: F.get(table, i))
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    score = F.coalesce(F.array_max(F.concat(of_rules(weights), F.transform("base", lambda _: F.lit(BASE_SCORE)))), F.lit(0.0))
    return kept.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", of_rules(names))).alias("labels"), score.alias("score"))
