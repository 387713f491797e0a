"""License scans by ordered signature rules.

Texts are folded to words (A-Z lower-cased, everything but ASCII letters, digits and non-ASCII characters is a
separator), and rules are regular expressions over the words joined by single spaces. A rule runs only if the text has
all of its keywords ("licence" counts as "license"). Where detections overlap, one whose words lie within those of a detection of higher priority, or of
a longer one of the same priority, is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreef.llm.common import folded_words, map_rows

#: Phrases that are always reported, with their labels (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Priorities: whole license texts and tags before names, names before families, families before hints.
TAG, TEXT, NAME, FAMILY, HINT = 50, 40, 30, 20, 10
_CONFIDENCE = {TAG: 1.0, TEXT: 0.95, NAME: 0.9, FAMILY: 0.7, HINT: 0.4}


@dataclass(frozen=True)
class Signature:
    """label, priority, and a pattern over folded words. keywords: words without which the pattern cannot match."""

    label: str
    priority: int
    pattern: str
    keywords: tuple[str, ...]


_V = r"(?:version |v ?)?"  # "v2.0" is folded to "v2 0"

#: label: names of a license in folded words. Versions are spelled as words: "2 0".
_NAMES = {
    "apache-1.0": (r"apache (?:software )?license " + _V + r"1 0",),
    "apache-1.1": (r"apache (?:software )?license " + _V + r"1 1",),
    "apache-2.0": (r"apache (?:software )?license " + _V + r"2(?: 0)?", r"asl ?2 0", r"apache version 2(?: 0)?", r"apache v ?2(?: 0)?", r"apache 2 0"),
    "mit": (r"(?:the )?mit license", r"(?:the )?expat license", r"mit x11 license", r"licensed under mit"),
    "mit-0": (r"mit no attribution(?: license)?",),
    "bsd-2-clause": (r"(?:simplified|freebsd) bsd license", r"bsd 2 clause(?: license)?", r"two clause bsd license"),
    "bsd-3-clause": (r"(?:new|modified|revised) bsd license", r"bsd 3 clause(?: license)?", r"three clause bsd license"),
    "bsd-4-clause": (r"(?:original|old) bsd license", r"bsd 4 clause(?: license)?", r"four clause bsd license"),
    "0bsd": (r"zero clause bsd license", r"bsd zero clause license"),
    "gpl-1.0": (r"(?:gnu )?general public license " + _V + r"1(?: 0)?", r"gpl " + _V + r"1(?: 0)?", r"gplv1", r"gpl1"),
    "gpl-2.0": (r"(?:gnu )?general public license " + _V + r"2(?: 0)?", r"gnu gpl " + _V + r"2", r"gpl " + _V + r"2(?: 0)?", r"gplv2", r"gpl2"),
    "gpl-3.0": (r"(?:gnu )?general public license " + _V + r"3(?: 0)?", r"gnu gpl " + _V + r"3", r"gpl " + _V + r"3(?: 0)?", r"gplv3", r"gpl3"),
    "lgpl-2.0": (r"(?:gnu )?library general public license(?: " + _V + r"2(?: 0)?)?", r"lgpl " + _V + r"2(?: 0)?", r"lgplv2"),
    "lgpl-2.1": (r"(?:gnu )?lesser general public license " + _V + r"2 1", r"lgplv2 1", r"lgpl " + _V + r"2 1"),
    "lgpl-3.0": (r"(?:gnu )?lesser general public license " + _V + r"3(?: 0)?", r"lgpl " + _V + r"3(?: 0)?", r"lgplv3", r"lgpl3"),
    "agpl-3.0": (r"(?:gnu )?affero general public license(?: " + _V + r"3(?: 0)?)?", r"agpl " + _V + r"3(?: 0)?", r"agplv3", r"agpl3"),
    "gfdl-1.1": (r"(?:gnu )?free documentation license " + _V + r"1 1", r"gfdl " + _V + r"1 1"),
    "gfdl-1.2": (r"(?:gnu )?free documentation license " + _V + r"1 2", r"gfdl " + _V + r"1 2"),
    "gfdl-1.3": (r"(?:gnu )?free documentation license " + _V + r"1 3", r"gfdl " + _V + r"1 3"),
    "mpl-1.0": (r"mozilla public license " + _V + r"1 0", r"mpl " + _V + r"1 0"),
    "mpl-1.1": (r"mozilla public license " + _V + r"1 1", r"mpl " + _V + r"1 1"),
    "mpl-2.0": (r"mozilla public license " + _V + r"2(?: 0)?", r"mpl " + _V + r"2(?: 0)?", r"mplv2(?: 0)?"),
    "epl-1.0": (r"eclipse public license (?:" + _V + r"1 0)", r"epl " + _V + r"1 0"),
    "epl-2.0": (r"eclipse public license (?:" + _V + r"2 0)", r"epl " + _V + r"2 0"),
    "edl-1.0": (r"eclipse distribution license(?: " + _V + r"1 0)?",),
    "cpl-1.0": (r"common public license(?: " + _V + r"1 0)?",),
    "cddl-1.0": (r"common development and distribution license(?: " + _V + r"1 0)?", r"cddl " + _V + r"1 0"),
    "cddl-1.1": (r"common development and distribution license " + _V + r"1 1", r"cddl " + _V + r"1 1"),
    "eupl-1.1": (r"european union public license " + _V + r"1 1", r"eupl " + _V + r"1 1"),
    "eupl-1.2": (r"european union public license " + _V + r"1 2", r"eupl " + _V + r"1 2"),
    "osl-3.0": (r"open software license(?: " + _V + r"3 0)?",),
    "afl-3.0": (r"academic free license(?: " + _V + r"3 0)?",),
    "artistic-1.0": (r"artistic license " + _V + r"1 0", r"the artistic license"),
    "artistic-2.0": (r"artistic license " + _V + r"2 0",),
    "bsl-1.0": (r"boost software license(?: " + _V + r"1 0)?",),
    "busl-1.1": (r"business source license(?: " + _V + r"1 1)?",),
    "sspl-1.0": (r"server side public license(?: " + _V + r"1)?",),
    "elastic-2.0": (r"elastic license(?: " + _V + r"2(?: 0)?)?",),
    "polyform-nc-1.0": (r"polyform noncommercial license(?: 1 0 0)?",),
    "isc": (r"(?:the )?isc license",),
    "zlib": (r"(?:the )?zlib(?: libpng)? license",),
    "libpng": (r"(?:the )?libpng license",),
    "openssl": (r"openssl license", r"ssleay license"),
    "curl": (r"curl license",),
    "python-2.0": (r"python software foundation license(?: " + _V + r"2)?", r"psf license"),
    "ruby": (r"ruby license",),
    "php-3.0": (r"php license(?: " + _V + r"3 0)",),
    "php-3.01": (r"php license(?: " + _V + r"3 01)?",),
    "unlicense": (r"(?:the )?unlicense",),
    "wtfpl": (r"wtfpl", r"do what the \w+ you want to public license"),
    "beerware": (r"beer ware license", r"beerware license"),
    "ms-pl": (r"microsoft public license", r"ms pl"),
    "ms-rl": (r"microsoft reciprocal license", r"ms rl"),
    "ncsa": (r"university of illinois(?: ncsa)? open source license", r"illinois open source license"),
    "upl-1.0": (r"universal permissive license(?: " + _V + r"1 0)?",),
    "cecill-2.1": (r"cecill(?: free software)? license(?: " + _V + r"2 1)?",),
    "mulan-2.0": (r"mulan permissive software license(?: " + _V + r"2)?", r"mulan psl " + _V + r"2"),
    "ofl-1.1": (r"sil open font license(?: " + _V + r"1 1)?", r"open font license"),
    "odbl-1.0": (r"open (?:data commons )?(?:open )?database license(?: " + _V + r"1 0)?", r"odbl"),
    "odc-by-1.0": (r"open data commons attribution license(?: " + _V + r"1 0)?", r"odc by(?: 1 0)?"),
    "pddl-1.0": (r"public domain dedication and license(?: " + _V + r"1 0)?", r"pddl"),
    "ogl-3.0": (r"open government license(?: " + _V + r"3 0)?",),
    "cc0-1.0": (r"cc0(?: 1 0)?(?: universal)?", r"cc zero", r"creative commons (?:zero|cc0)"),
    "json": (r"(?:the )?json license",),
    "vim": (r"vim license",),
    "tcl": (r"tcl tk license", r"tcl license"),
    "w3c": (r"w3c software (?:notice and )?(?:and document )?license",),
    "x11": (r"(?:the )?x11 license", r"x consortium license"),
    "zpl-2.1": (r"zope public license(?: " + _V + r"2 1)?",),
    "sleepycat": (r"sleepycat license",),
    "qpl-1.0": (r"q public license(?: " + _V + r"1 0)?",),
    "lppl-1.3": (r"latex project public license(?: " + _V + r"1 3c?)?",),
    "llama": (r"llama (?:2 |3 )?community license",),
    "openrail": (r"(?:creativeml |bigscience )?openrail(?: m)?(?: license)?", r"(?:creativeml |bigscience )?open rail(?: m)?(?: license)?",),
    "postgresql": (r"(?:the )?postgresql license",),
    "intel": (r"intel open source license",),
    "naist": (r"nara institute of science and technology license",),
    "ubuntu-font": (r"ubuntu font license(?: " + _V + r"1 0)?",),
    "bitstream-vera": (r"bitstream vera (?:fonts )?(?:copyright|license)",),
    "vovida-1.0": (r"vovida software license(?: " + _V + r"1 0)?",),
    "watcom-1.0": (r"sybase open watcom public license(?: " + _V + r"1 0)?",),
    "apsl-2.0": (r"apple public source license(?: " + _V + r"2 0)?",),
    "ipl-1.0": (r"ibm public license(?: " + _V + r"1 0)?",),
    "spl-1.0": (r"sun public license(?: " + _V + r"1 0)?",),
    "rpl-1.5": (r"reciprocal public license(?: " + _V + r"1 5)?",),
    "parity-7.0": (r"parity public license(?: 7 0 0)?",),
    "blueoak-1.0": (r"blue oak model license(?: 1 0 0)?",),
    "hippocratic-2.1": (r"hippocratic license(?: " + _V + r"2 1)?",),
    "anti-996": (r"anti 996 license",),
}

#: Creative Commons: parts in folded words, from the narrowest; each with and without its versions.
_CC = {
    "cc-by-nc-nd": (r"by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    "cc-by-nc-sa": (r"by nc sa", r"attribution non ?commercial share ?alike"),
    "cc-by-nc": (r"by nc", r"attribution non ?commercial"),
    "cc-by-nd": (r"by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    "cc-by-sa": (r"by sa", r"attribution share ?alike"),
    "cc-by": (r"by", r"attribution"),
}
_CC_VERSIONS = {"1.0": "1 0", "2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}

#: Sentences of license texts: label, pattern.
_TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("gpl", r"this program is free software you can redistribute it and or modify it"),
    ("gpl", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", r"under the terms of the gnu (?:lesser|library) general public license as published"),
    ("agpl", r"under the terms of the gnu affero general public license"),
    ("gpl-or-later", r"either version \d(?: \d)? of the license or at your option any later version"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license"),
    ("cc0-1.0", r"has dedicated the work to the public domain"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("x11", r"except as contained in this notice the names? of (?:\S+ ){1,12}shall not be used in advertising"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", r"this software is provided by (?:\S+ ){1,10}as is and any express or implied warranties including but not limited to"),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", r"products derived from this software may not be called apache"),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", r"you must give any other recipients of the work or derivative works a copy of this license"),
    ("apache-2.0", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", r"you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("gpl-2.0", r"activities other than copying distribution and modification are not covered by this license"),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", r"you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", r"no covered work shall be deemed part of an effective technological measure"),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    ("lgpl-2.1", r"this license the lesser general public license applies to some specially designated software packages"),
    ("lgpl-2.1", r"a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", r"the purpose of this license is to make a manual textbook or other functional and useful document free"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", r"the initial developer hereby grants you a world wide royalty free non exclusive license"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", r"covered software is provided under this license on an as is basis"),
    ("epl", r"made available under the terms of the eclipse public license"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-2.0", r"this source code may also be made available under the following secondary licenses"),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", r"licensed under the eupl"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("bsl-1.0", r"the copyright notices in the software and this entire statement including the above license grant"),
    ("psf-2.0", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", r"this product includes php software freely available from"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", r"the ofl allows the licensed fonts to be used studied modified and redistributed freely"),
    ("cc0-1.0", r"has waived all copyright and related or neighbou?ring rights"),
    ("cc", r"you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service"),
)

#: Weaker signs: label, priority, pattern.
_SIGNS = (
    ("apache", FAMILY, r"apache (?:software )?license"),
    ("bsd", FAMILY, r"bsd (?:style )?license"),
    ("bsd", FAMILY, r"bsd licensed"),
    ("gpl", FAMILY, r"gnu (?:general public license|gpl)"),
    ("gpl", FAMILY, r"gnu public license"),
    ("gpl", FAMILY, r"licensed under (?:the )?gpl"),
    ("lgpl", FAMILY, r"lesser general public license"),
    ("lgpl", FAMILY, r"lgpl"),
    ("agpl", FAMILY, r"agpl"),
    ("gfdl", FAMILY, r"free documentation license"),
    ("mpl", FAMILY, r"mozilla public license"),
    ("epl", FAMILY, r"eclipse public license"),
    ("cddl", FAMILY, r"common development and distribution license"),
    ("eupl", FAMILY, r"european union public license"),
    ("cc", FAMILY, r"creative commons(?: \S+){0,3} license"),
    ("public-domain", HINT, r"(?:is|are) (?:in )?the public domain"),
    ("proprietary", HINT, r"proprietary and confidential"),
    ("proprietary", HINT, r"unauthorized (?:copying|reproduction|distribution)"),
    ("proprietary", HINT, r"unauthorised (?:copying|reproduction|distribution)"),
    ("proprietary", HINT, r"may not be (?:reproduced|copied|distributed|redistributed)"),
    ("copyright", HINT, r"copyright (?:c )?(?:19|20)\d\d"),
    ("as-is", HINT, r"provided as is without warrant(?:y|ies)"),
)


def _keywords(pattern: str) -> tuple[str, ...]:
    """Words that every match of a pattern has: the plain ones outside its groups. A group takes its spaces along."""
    flat = re.sub(r"\\S\+", "\0", pattern)
    while (cut := re.sub(r"\(\?:([^()]*)\)(?:[?*+]|\{[^}]*\})?", lambda m: " \0 " if " " in m[1][:1] + m[1][-1:] else "\0", flat)) != flat:
        flat = cut
    flat = re.sub(r"\S+ \?\S*", "\0", flat)  # a space that may be missing
    return tuple(sorted({w for w in flat.split() if re.fullmatch(r"[a-z0-9]+", w)}))


def signatures() -> list[Signature]:
    """All rules, in order of priority."""
    out = []

    def rule(label, priority, pattern):
        out.append(Signature(label, priority, pattern, _keywords(pattern)))

    for label, names in _NAMES.items():
        spdx = re.escape(label.replace("-", " ").replace(".", " ")).replace("\\ ", " ")
        rule(label, TAG, rf"spdx license identifier {spdx}(?: only| or later)?")
        for name in names:
            rule(label, NAME, name)
    for label, (short, long) in _CC.items():
        for version, words in _CC_VERSIONS.items():
            rule(f"{label}-{version}", TAG, rf"spdx license identifier cc {short} {words}")
            rule(f"{label}-{version}", NAME, rf"cc {short} {words}")
            rule(f"{label}-{version}", NAME, rf"creative commons {long} {words}")
            rule(f"{label}-{version}", NAME, rf"creative commons {long}(?: \S+){{0,2}} license {_V}{words}")
            rule(f"{label}-{version}", TAG, rf"creativecommons org licenses {short} {words}")
        rule(label, NAME, rf"cc {short}")
        rule(label, NAME, rf"creative commons {long}")
    for label, pattern in _TEXTS:
        rule(label, TEXT, pattern)
    for label, priority, pattern in _SIGNS:
        rule(label, priority, pattern)
    return sorted(out, key=lambda r: -r.priority)




class Scanner:
    """The rules, compiled once a task."""

    def __init__(self, rules: list[Signature] | None = None):
        self.rules = signatures() if rules is None else rules
        self.by_word: dict[bytes, list[int]] = {}
        self.always: list[int] = []
        self.needs, self.patterns = [], []
        for i, r in enumerate(self.rules):
            self.needs.append(frozenset(w.encode() for w in r.keywords))
            self.patterns.append(re.compile(rb"(?<![^ ])" + r.pattern.encode() + rb"(?![^ ])"))
            if r.keywords:  # filed under the longest keyword, the most telling one
                self.by_word.setdefault(max(r.keywords, key=lambda w: (len(w), w)).encode(), []).append(i)
            else:
                self.always.append(i)
        self.gate = frozenset(self.by_word) | ({b"licence"} if b"license" in self.by_word else set())
        self.base_words = [p.encode().split() for p, _ in BASE]

    def base_places(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, last word, label) of every place of a base phrase."""
        out = []
        for phrase, (_, label) in zip(self.base_words, BASE, strict=True):
            n, rare = len(phrase), max(range(len(phrase)), key=lambda i: len(phrase[i]))
            at = -1
            while True:
                try:
                    at = words.index(phrase[rare], at + 1)
                except ValueError:
                    break
                start = at - rare
                if start >= 0 and words[start : start + n] == phrase:
                    out.append((start, start + n - 1, label))
        return sorted(out)

    def detections(self, words: list[bytes]) -> list[tuple[int, int, int, str]]:
        """(first word, last word, priority, label) of the rules' detections that are left, in order of place."""
        found = self.gate.intersection(words)
        if not found and not self.always:
            return []
        have = None
        todo = list(self.always)
        for w in {b"license" if w == b"licence" else w for w in found}:
            todo += self.by_word[w]
        hits = []
        joined = starts = None
        for i in sorted(todo):
            if have is None:
                have = set(words)
                if b"licence" in have:
                    words = [b"license" if w == b"licence" else w for w in words]
                    have.add(b"license")
                joined = b" ".join(words)
                starts = list(accumulate((len(w) + 1 for w in words), initial=0))
            if self.needs[i] <= have:
                r = self.rules[i]
                for m in self.patterns[i].finditer(joined):
                    first = bisect_right(starts, m.start()) - 1
                    hits.append((first, bisect_right(starts, m.end() - 1) - 1, r.priority, r.label))
        return suppressed(hits)

    def scan(self, text: str | None) -> dict:
        words = folded_words(text)
        base, more = self.base_places(words), self.detections(words)
        labels = {x[2] for x in base}
        score = max([_CONFIDENCE[x[2]] for x in more] + [0.8] * bool(base), default=0.0)
        return {
            "n_words": len(words), "n_base": len(base),
            "first_word": min((x[0] for x in base), default=None), "last_word": max((x[0] for x in base), default=None),
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {x[3] for x in more})),
            "score": score, "detections": more,
        }


def suppressed(hits: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections that no better one contains. Better: higher priority, then more words, then earlier in the order of
    labels. Sorted by place, one sweep over the best so far suffices for nested intervals of a priority."""
    ranked = sorted(set(hits), key=lambda h: (-h[2], h[0] - h[1], h[3]))
    kept: list[tuple[int, int, int, str]] = []
    covers: list[tuple[int, int]] = []  # disjoint in no way, sorted by start, ends ascending: the outline of the kept
    for h in ranked:
        at = bisect_right(covers, (h[0], float("inf"))) - 1
        if at >= 0 and covers[at][1] >= h[1]:
            continue
        kept.append(h)
        cut = at + 1
        while cut < len(covers) and covers[cut][1] <= h[1]:
            cut += 1
        covers[at + 1 : cut] = [(h[0], h[1])]
    return sorted(kept)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, and with ``spans`` the
    detections as ``label@first-last``.

    Edge cases: a null or empty text has no words, no labels (empty strings) and score 0; a null key stays; repeated
    rows are scanned each; no rows give no rows; other columns are not read. Whole texts, one narrow pass.
    """
    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    if spans:
        ddl += ", detections array<string>"

    def start():
        scanner = Scanner()

        def row(doc_id, body):
            got = scanner.scan(body)
            out = (doc_id, *(got[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))
            return (*out, [f"{x[3]}@{x[0]}-{x[1]}" for x in got["detections"]]) if spans else out

        return row

    return map_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), ["doc_id", "text"], ddl, start)
