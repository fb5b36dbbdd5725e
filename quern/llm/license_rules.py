"""License scans by ordered signature rules.

Method
    Texts become words with one space between them. Each rule is a regex over words with a label, a priority and
    keywords; an automaton finds all keywords in one pass, and only rules whose keywords occur are tried. A detection is an interval of
    words. Of overlapping detections, one contained in another of the same or a higher priority is suppressed; equal intervals keep the first rule.
    CLAUSES and NOTICES are rules for sentences of license texts and headers; and every name in NAMES makes one rule for each of FORMS, in which
    a text can refer to it, and for expressions of identifiers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_batches, prepare, texts

#: Contract of the base labels: phrase and label (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, keyword that must occur, regex of the name in words.
NAMES = [
    ("mit", "mit", r"mit"), ("mit-0", "mit", r"mit (?:0|no attribution)"), ("x11", "x11", r"x11"), ("isc", "isc", r"isc"),
    ("bsd", "bsd", r"bsd(?: style)?"), ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"), ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd|bsd 0 clause)"),
    ("apache", "apache", r"apache(?: software)?"), ("apache-1.1", "apache", r"apache(?: software)?(?: license)? (?:version )?1 1"), ("apache-2.0", "apache", r"apache(?: software)?(?: license)? (?:version )?(?:2 0|2|v2|v2 0)"),
    ("gpl", "gpl", r"(?:gnu )?gpl"), ("gpl", "general public", r"(?:gnu )?general public"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl (?:version )?v?2(?: 0)?"), ("gpl-2.0", "general public", r"(?:gnu )?general public license (?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?(?:gplv3|gpl (?:version )?v?3(?: 0)?)"), ("gpl-3.0", "general public", r"(?:gnu )?general public license (?:version |v)?3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"), ("lgpl", "lesser general", r"(?:gnu )?lesser general public"), ("lgpl", "library general", r"(?:gnu )?library general public"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl (?:version )?v?2 1"), ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license (?:version )?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl (?:version )?v?3(?: 0)?"), ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license (?:version )?3"),
    ("agpl", "agpl", r"(?:gnu )?agpl"), ("agpl", "affero", r"(?:gnu )?affero general public"), ("agpl-3.0", "affero", r"(?:gnu )?affero general public license (?:version )?3"), ("agpl-3.0", "agpl", r"agpl (?:version )?v?3(?: 0)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation"), ("mpl", "mozilla", r"mozilla public"), ("mpl-1.1", "mozilla", r"mozilla public license (?:version )?1 1"), ("mpl-2.0", "mozilla", r"mozilla public license (?:version )?2(?: 0)?"), ("mpl-2.0", "mpl", r"mpl (?:version )?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public"), ("epl-2.0", "eclipse", r"eclipse public license (?:version )?2(?: 0)?"), ("cddl", "common development", r"common development and distribution"), ("cpl", "common public", r"common public"),
    ("eupl", "european union public", r"european union public"), ("artistic", "artistic", r"artistic"), ("artistic-2.0", "artistic", r"artistic license (?:version )?2(?: 0)?"), ("ofl", "open font", r"(?:sil )?open font"),
    ("zlib", "zlib", r"zlib(?: libpng)?"), ("boost", "boost", r"boost software"), ("unlicense", "unlicense", r"unlicense"), ("wtfpl", "wtfpl", r"wtfpl"), ("python", "python", r"python software foundation"), ("php", "php", r"php"),
    ("postgresql", "postgresql", r"postgresql"), ("openssl", "openssl", r"openssl"), ("ruby", "ruby", r"ruby"), ("unicode", "unicode", r"unicode"), ("vim", "vim", r"vim"), ("w3c", "w3c", r"w3c(?: software)?"), ("ms-pl", "microsoft public", r"microsoft public"),
    ("odbl", "open data", r"open (?:data )?database"), ("odc-by", "open data commons", r"open data commons attribution"), ("pddl", "public domain dedication", r"public domain dedication and"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"), ("cc0", "cc zero", r"cc zero"), ("cc-by", "cc by", r"cc by"), ("cc-by", "creative commons", r"creative commons attribution"),
    ("cc-by-sa", "cc by", r"cc by sa"), ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike"), ("cc-by-nc", "cc by", r"cc by nc"), ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "cc by", r"cc by nd"), ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv[a-z]*"), ("cc-by-nc-sa", "cc by", r"cc by nc sa"), ("cc-by-nc-nd", "cc by", r"cc by nc nd"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv[a-z]*"),
]
#: How a text refers to a name: regex, what it adds to the priority, confidence, keywords of which one must occur as well.
FORMS = [
    (r"(?:re|dual )?licen[sc]ed (?:to you )?under (?:the |a )?(?:terms of the )?{}(?: licen[sc]e)?", 30, 0.95, ("licensed", "licenced")),
    (r"(?:released|distributed|available|published|provided|covered|governed|made available) (?:under|by) (?:the |a )?(?:terms of the )?{}(?: licen[sc]e)?", 25, 0.9, (" under ", " by ")),
    (r"(?:terms|conditions) of (?:the )?{}(?: licen[sc]e)?", 20, 0.85, ("terms", "conditions")),
    (r"spdx licen[sc]e identifier (?:(?:NAMES) (?:or later |only )?(?:or|and|with) )*(?P<at>{})", 40, 0.99, ("spdx",)),
    (r"(?:gnu )?{} licen[sc]e", 10, 0.75, ("license", "licence")),
]
#: Rules that name no license: label, keyword, regex, priority, confidence.
NOTICES = [
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 15, 0.8), ("copyright", "copyright", r"copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", 12, 0.8), ("copyright", "copyright", r"copyright (?:by|holders?|notice|owner|reserved)", 8, 0.6),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 14, 0.8), ("public-domain", "public domain", r"dedicated to the public domain", 18, 0.9), ("warranty", "warranty", r"without warranty of any kind", 9, 0.7), ("warranty", "as is", r"provided (?:on an )?as is", 8, 0.6),
    ("permission", "permission", r"permission is hereby granted(?: free of charge)?", 16, 0.9), ("permission", "permission", r"permission to use copy modify and or distribute", 16, 0.9), ("redistribution", "redistribution", r"redistribution and use in source and binary forms", 18, 0.9),
    ("proprietary", "proprietary", r"proprietary and confidential", 12, 0.8), ("proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution) (?:of this file )?is (?:strictly )?prohibited", 12, 0.8), ("gpl", "free software", r"this (?:program|library) is free software you can redistribute it", 18, 0.85),
    ("no-ai", "train", r"(?:may not|must not|not) be used (?:for|to) (?:train|training)[a-z ]{0,20}(?:models?|ai)", 14, 0.8), ("cc", "creative commons", r"creative commons", 5, 0.6), ("license-file", " see ", r"see (?:the )?(?:file )?(?:license|copying)(?: file)?", 6, 0.5),
]


#: Sentences of license texts and file headers: label, keyword, regex, priority, confidence.
CLAUSES = [
    ("mit", "obtaining a copy", r"permission is hereby granted free of charge to any person obtaining a copy", 26, 0.95), ("mit", "deal in the", r"to deal in the (?:software|materials) without restriction", 24, 0.9), ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software", 24, 0.9),
    ("mit", "copyright holders be liable", r"in no event shall the authors or copyright holders be liable for any claim", 22, 0.85), ("x11", "except as contained in this notice", r"except as contained in this notice the names? of", 26, 0.9), ("mit-0", "without restriction", r"without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", 20, 0.6),
    ("isc", "with or without fee", r"for any purpose with or without fee is hereby granted", 24, 0.9), ("isc", "permission notice appear", r"copyright notice and this permission notice appear in all copies", 24, 0.85), ("isc", "the author disclaims", r"provided as is and the author disclaims all warranties", 22, 0.85),
    ("bsd", "with or without modification", r"in source and binary forms with or without modification are permitted", 24, 0.95), ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice", 24, 0.9), ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice", 24, 0.9),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software", 26, 0.9), ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software", 28, 0.95), ("bsd-2-clause", "views and conclusions", r"the views and conclusions contained in the software and documentation", 20, 0.7),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the license", 26, 0.95), ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing", 22, 0.8), ("apache-2.0", "apache org licenses", r"apache org licenses license 2 0", 30, 0.97), ("apache-2.0", "perpetual worldwide", r"each contributor hereby grants to you a perpetual worldwide non exclusive", 24, 0.85),
    ("apache-1.1", "developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)", 28, 0.9), ("apache", "apache license", r"apache license version [12] [01]", 22, 0.9),
    ("gpl", "you can redistribute it", r"this (?:program|library|file) is free software you can redistribute it and or modify it", 24, 0.9), ("gpl", "in the hope that", r"distributed in the hope that it will be useful but without any warranty", 22, 0.85), ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness", 20, 0.7), ("gpl", "received a copy of the gnu", r"received a copy of the gnu general public license", 24, 0.9),
    ("gpl", "verbatim copies", r"permitted to copy and distribute verbatim copies of this license document", 26, 0.9), ("gpl-2.0", "take away your freedom", r"the licenses for most software are designed to take away your freedom", 28, 0.9), ("gpl-2.0-or-later", "any later version", r"either version 2 of the license or at your option any later version", 30, 0.95), ("gpl-3.0-or-later", "any later version", r"either version 3 of the license or at your option any later version", 30, 0.9),
    ("gpl-2.0", "june 1991", r"version 2 june 1991", 24, 0.85), ("gpl-3.0", "june 2007", r"version 3 29 june 2007", 24, 0.85), ("gpl-classpath", "classpath", r"classpath exception", 22, 0.8), ("linking-exception", "special exception", r"as a special exception [a-z0-9 ]{0,80}permission to link", 24, 0.85), ("gpl", "gnu org licenses", r"gnu org licenses (?:old licenses )?gpl", 24, 0.9),
    ("lgpl", "received a copy of the gnu", r"received a copy of the gnu (?:lesser|library) general public license", 26, 0.9), ("lgpl-2.1-or-later", "any later version", r"either version 2 1 of the license or at your option any later version", 32, 0.95), ("lgpl-2.1", "february 1999", r"version 2 1 february 1999", 26, 0.85), ("lgpl", "gnu org licenses", r"gnu org licenses (?:old licenses )?lgpl", 26, 0.9),
    ("agpl", "received a copy of the gnu", r"received a copy of the gnu affero general public license", 26, 0.9), ("agpl-3.0", "november 2007", r"version 3 19 november 2007", 26, 0.85), ("agpl", "remote network interaction", r"remote network interaction use with the gnu general public license", 24, 0.85), ("agpl", "gnu org licenses", r"gnu org licenses agpl", 26, 0.9),
    ("gfdl", "invariant sections", r"with (?:no|the) invariant sections", 22, 0.85), ("gfdl", "modify this document", r"copy distribute and or modify this document under the terms of the gnu free documentation", 28, 0.95), ("gfdl", "gnu org", r"gnu org (?:licenses|copyleft) fdl", 24, 0.9),
    ("mpl-2.0", "source code form is subject", r"this source code form is subject to the terms of the mozilla public license", 30, 0.95), ("mpl-2.0", "copy of the mpl", r"if a copy of the mpl was not distributed with this file", 28, 0.95), ("mpl-1.1", "contents of this file", r"the contents of this file are (?:subject to|used with permission subject to) the mozilla public license", 28, 0.9), ("mpl", "mozilla org mpl", r"mozilla org mpl", 22, 0.85),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse", 28, 0.95), ("epl", "eclipse org", r"eclipse org (?:legal|org documents) epl", 26, 0.9), ("cddl", "opensource sun com", r"opensource sun com cddl", 24, 0.85), ("cddl", "cddl", r"terms of the cddl", 18, 0.75), ("cpl", "common public", r"common public license version 1 0", 24, 0.9),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented", 26, 0.95), ("zlib", "plainly marked", r"altered source versions must be plainly marked as such", 26, 0.95), ("zlib", "source distribution", r"may not be removed or altered from any source distribution", 24, 0.9), ("zlib", "held liable", r"in no event will the authors be held liable for any damages", 22, 0.85),
    ("boost", "execute and transmit", r"use reproduce display distribute execute and transmit the software", 26, 0.95), ("boost", "boost org", r"boost org license 1 0", 26, 0.9), ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 30, 0.97), ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute", 26, 0.95), ("wtfpl", "you want to public", r"do what the [a-z]+ you want to public license", 28, 0.97),
    ("cc0", "related or neighboring", r"waived all copyright and related or neighboring rights", 28, 0.95), ("cc0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0", 30, 0.97), ("public-domain-mark", "publicdomain mark", r"creativecommons org publicdomain mark 1 0", 30, 0.95), ("cc-by", "appropriate credit", r"you must give appropriate credit provide a link to the license", 22, 0.85), ("cc-by-sa", "contributions under the same", r"you must distribute your contributions under the same license", 24, 0.85),
    ("cc-by-nc", "the material for commercial", r"you may not use the material for commercial purposes", 24, 0.85), ("cc-by-nd", "modified material", r"you may not distribute the modified material", 24, 0.85), ("cc-by", "creativecommons org licenses", r"creativecommons org licenses by [1-4] [05]", 30, 0.97), ("cc-by-sa", "creativecommons org licenses", r"creativecommons org licenses by sa [1-4] [05]", 31, 0.97), ("cc-by-nc", "creativecommons org licenses", r"creativecommons org licenses by nc [1-4] [05]", 31, 0.97),
    ("cc-by-nd", "creativecommons org licenses", r"creativecommons org licenses by nd [1-4] [05]", 31, 0.97), ("cc-by-nc-sa", "creativecommons org licenses", r"creativecommons org licenses by nc sa [1-4] [05]", 32, 0.97), ("cc-by-nc-nd", "creativecommons org licenses", r"creativecommons org licenses by nc nd [1-4] [05]", 32, 0.97),
    ("ofl", "reserved font name", r"with reserved font names?", 24, 0.9), ("ofl", "font software", r"the font software may be (?:sold|bundled|modified|redistributed)", 22, 0.85), ("ofl", "scripts sil org", r"scripts sil org ofl", 26, 0.9), ("php", "may not be called php", r"products derived from this software may not be called php", 28, 0.95), ("openssl", "openssl", r"software developed by the openssl project", 28, 0.95), ("ssleay", "cryptographic software", r"includes cryptographic software written by", 24, 0.8),
    ("artistic", "state the conditions", r"the intent of this document is to state the conditions under which a package may be copied", 28, 0.95), ("ms-pl", "patent claim against", r"if you bring a patent claim against any contributor over patents", 26, 0.85), ("eupl", "eupl", r"(?:licensed under|terms of) the eupl", 24, 0.9), ("python", "psf is making", r"psf is making python available", 26, 0.9), ("ijg", "independent jpeg", r"based in part on the work of the independent jpeg group", 26, 0.9),
    ("sspl", "server side public", r"server side public license", 24, 0.9), ("busl", "business source", r"business source license", 22, 0.85), ("elastic", "elastic license", r"elastic license(?: 2 0)?", 20, 0.8), ("commons-clause", "commons clause", r"commons clause(?: license condition)?", 22, 0.9), ("polyform", "polyform", r"polyform (?:noncommercial|shield|small business|strict)", 22, 0.9), ("cdla", "community data license", r"community data license agreement", 24, 0.9),
    ("odbl", "open database license", r"open database license", 22, 0.9), ("ogl", "open government licence", r"open government licence", 24, 0.9), ("etalab", "licence ouverte", r"licence ouverte", 22, 0.85), ("rail", "responsible ai", r"responsible ai license", 24, 0.9), ("llama-community", "community license agreement", r"llama [0-9 ]{0,4}community license agreement", 26, 0.9), ("cecill", "cecill", r"cecill(?: [abc])?(?: licen[sc]e)?", 16, 0.8),
    ("reserved", "alle rechte vorbehalten", r"alle rechte vorbehalten", 15, 0.8), ("reserved", "droits réservés", r"tous droits réservés", 15, 0.8), ("reserved", "derechos reservados", r"todos los derechos reservados", 15, 0.8), ("written-permission", "written", r"without (?:the )?(?:express |prior )+written (?:permission|consent)", 14, 0.8), ("no-reproduction", "reproduced", r"may (?:not )?be reproduced (?:stored |copied |distributed |or |transmitted )*(?:without|in any form)", 12, 0.75),
    ("non-commercial", "commercial use only", r"for (?:personal |private |and |or )*non ?commercial use only", 16, 0.85), ("research-only", "only", r"for (?:academic|research|educational|evaluation) (?:and [a-z]+ )?(?:use|purposes) only", 16, 0.85), ("internal-only", "internal use only", r"(?:for )?internal use only", 12, 0.7), ("no-mining", "data mining", r"(?:no|not be used for|prohibits?|excluding) text and data mining", 16, 0.85), ("trade-secret", "trade secret", r"(?:contains|constitutes?) trade secrets?", 12, 0.7),
    ("by-permission", "permission", r"(?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission", 10, 0.65), ("trademark", "trademark", r"registered trademarks? of", 8, 0.55), ("patent", "patent", r"(?:patents? pending|covered by one or more patents)", 8, 0.55), ("no-resale", "resale", r"not for resale", 10, 0.65), ("terms-of-use", "terms of", r"subject to (?:the |our )?terms of (?:use|service)", 10, 0.65),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    regex: re.Pattern
    priority: int
    confidence: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first; a longer name goes before its own beginning."""
    every = "|".join(sorted({name for _, _, name in NAMES}, key=len, reverse=True))
    made = lambda label, keys, regex, priority, sure: Rule(label, keys, re.compile(f" {regex}(?= )".encode()), priority, sure)
    weight = lambda label, name: name.count(" ") + 2 * bool(re.search(r"\d|sa|nc|nd", label))
    out = [made(label, (key, *more), form.replace("NAMES", every).replace("{}", f"(?:{name})"), base + weight(label, name), sure) for label, key, name in NAMES for form, base, sure, more in FORMS]
    out += [made(label, (key,), regex, base, sure) for label, key, regex, base, sure in [*NOTICES, *CLAUSES]]
    # names of Creative Commons, and names with a version and the word license or GNU's abbreviations, are found by themselves
    out += [made(label, (key,), f"{name}(?: [1-4] 0)?", 9 + name.count(" "), 0.7) for label, key, name in NAMES if key in ("cc by", "cc0", "creative commons")]
    out += [made(label, (key,), name, 11 + name.count(" "), 0.8) for label, key, name in NAMES if re.search(r"\d", label) and ("gpl" in label or "license (?:version" in name)]
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def gates() -> tuple[ahocorasick.Automaton, dict[str, tuple[Rule, ...]]]:
    """An automaton of all keywords, and the rules by their first one. A byte of a text is one character of the automaton."""
    by: dict[str, list[Rule]] = {}
    found = ahocorasick.Automaton()
    for r in rules():
        keys = [k.encode().decode("latin-1") for k in r.keywords]
        by.setdefault(keys[0], []).append(r)
        for k in keys:
            found.add_word(k, k)
    found.make_automaton()
    return found, {k: tuple(v) for k, v in by.items()}


def candidates(norm: bytes) -> list[Rule]:
    """The rules whose first keyword occurs and, where there are others, one of these as well."""
    automaton, by = gates()
    seen = {k for _, k in automaton.iter(norm.decode("latin-1"))}
    return [r for k in by if k in seen for r in by[k] if len(r.keywords) == 1 or any(x in seen for x in r.keywords[1:])]


#: Words have bytes other than these; what lies between becomes one space.
_SPACES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())


def normalized(text: str) -> tuple[bytes, int]:
    """Lower-case words, each between single spaces, and their number."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()
    return b" " + b" ".join(words) + b" ", len(words)


def starts(norm: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the words of a phrase stand."""
    out, at, word, last = [], norm.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += norm.count(b" ", last, at)
        out.append(word)
        last, at = at, norm.find(b" " + phrase + b" ", at + 1)
    return out


def unsuppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections in order of place without those that lie in another of the same or a higher priority.

    Of equal ones the longer goes first, then the one before, then the label. Kept intervals that lie in no other kept one are held in
    order, so that their ends are in order, too, and one look says whether an interval lies in any of them.
    """
    kept, starts, ends = [], [], []
    for a, b, r in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label)):
        k = bisect_right(starts, a)
        if k and ends[k - 1] >= b:
            continue
        kept.append((a, b, r))
        last = k
        while last < len(ends) and ends[last] <= b:
            last += 1
        first = k - (k > 0 and starts[k - 1] == a)
        starts[first:last], ends[first:last] = [a], [b]
    return sorted(kept, key=lambda x: x[:2])


def word_numbers(norm: bytes, places: list[int]) -> dict[int, int]:
    """The number of the word that begins, or of words that end, at each place; one pass over the text."""
    out, word, last = {}, 0, 0
    for at in sorted(set(places)):
        word += norm.count(b" ", last, at)
        out[at], last = word, at
    return out


def detections(norm: bytes) -> list[tuple[int, int, Rule]]:
    """Intervals of words (end exclusive) that are left after suppression, with their rules."""
    found = []
    for r in candidates(norm):
        at = "at" if "at" in r.regex.groupindex else 0
        found += [(m.start(at) - bool(at), m.end(at), r) for m in r.regex.finditer(norm)]
    kept = unsuppressed(found)
    word = word_numbers(norm, [x for a, b, _ in kept for x in (a, b)])
    return [(word[a], word[b], r) for a, b, r in kept]


def scan(text: str) -> dict:
    norm, n = normalized(text)
    base = {label: at for phrase, label in BASE.items() if (at := starts(norm, phrase.encode()))}
    found = detections(norm)
    places = [x for at in base.values() for x in at]
    miss = 1.0
    for *_, r in found:
        miss *= 1 - r.confidence
    return {
        "n_words": n, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted({*base, *(r.label for *_, r in found)})),
        "score": max(1 - miss, 0.5 * bool(base)), "found": ",".join(f"{r.label}:{a}:{b}" for a, b, r in found),
    }


COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, found string"


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [scan(t) for t in texts(batch)]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    cols = [(c.split()[0], kinds[c.split()[1]]) for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[c] for r in rows], k) for c, k in cols)], ["doc_id", *(c for c, _ in cols)])


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id and COLUMNS for each row of docs (columns doc_id, text; others are ignored).

    Null text is empty: no words, no labels (empty strings), score 0. Texts are scanned whole; time grows in proportion to a text's length and
    the detections in it. An empty table gives an empty result. score is the chance that at least one detection is right by
    the rules' confidences, 0.5 at least with a base phrase. found lists label:start:end in words. Repeated rows are judged alike.
    """
    prepare(docs.sparkSession)
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), _scan, f"doc_id bigint, {COLUMNS}")
