"""License scans by ordered signature rules (operator 6, DataFrame functions only).

A text is brought to words (A-Z lower-cased), each written between its own pair of spaces, so
that a phrase is found whole by plain string search and no two finds share a space. Three base phrases are
looked for in every text. The rules, hand-written signatures of license bodies and headers and several hundred names,
grants and versions of the license families below, are tried only on texts that pass the keyword prefilter, and of these each
rule only where its own keyword and the plain pieces of its pattern stand.

Every find is an interval of words with the rule's priority. A find is suppressed if another one
contains its interval and has a greater priority, or the same priority and more words, or
stands earlier in the rule list with the very same interval. What remains is ``detections``; its
labels join the base labels, and ``score`` is the greatest confidence among both.

All of it happens inside the row, so the plan is one narrow stage without a shuffle; cost follows
the text, and the costly part only the texts that name a license.

Defined results: null and empty texts have no words, no finds, empty labels and score 0. Ties of equal
intervals go to the earlier rule. Repeated rows and null ids are scanned row by row; other columns are
not read. Very long texts are scanned whole, in time that grows with their words and finds; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import lower_ascii, table

#: The phrases and labels of the base scan.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: SPDX identifiers as words, with labels, and family names written with their version. Fixed values.
SPDX = [
    ("0bsd", "0bsd"), ("agpl-3", "agpl 3 0"), ("agpl-3", "agpl 3 0 only"), ("agpl-3+", "agpl 3 0 or later"), ("apache-2", "apache 2 0"), ("artistic-2.0", "artistic 2 0"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"),
    ("bsl-1.0", "bsl 1 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("cc0", "cc0 1 0"), ("cddl-1.0", "cddl 1 0"), ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"),
    ("eupl-1.2", "eupl 1 2"), ("gpl-2", "gpl 2 0"), ("gpl-2", "gpl 2 0 only"), ("gpl-2+", "gpl 2 0 or later"), ("gpl-3", "gpl 3 0"), ("gpl-3", "gpl 3 0 only"), ("gpl-3+", "gpl 3 0 or later"), ("isc", "isc"),
    ("lgpl-2.1", "lgpl 2 1"), ("lgpl-2.1", "lgpl 2 1 only"), ("lgpl-2.1+", "lgpl 2 1 or later"), ("lgpl-3", "lgpl 3 0"), ("lgpl-3", "lgpl 3 0 only"), ("lgpl-3+", "lgpl 3 0 or later"), ("mit", "mit"), ("mpl-2.0", "mpl 2 0"),
    ("python", "psf 2 0"), ("unlicense", "unlicense"), ("zlib", "zlib"),
]
JOINED = [("gpl-2", "gplv2"), ("gpl-3", "gplv3"), ("lgpl-2", "lgplv2"), ("lgpl-2.1", "lgplv2 1"), ("lgpl-3", "lgplv3"), ("agpl-3", "agplv3"), ("apache-2", "apachev2")]

#: License families: label, keyword that must stand in the text, names as word patterns, versions
#: (label suffix, word pattern). Names and versions are public license names.
FAMILIES = [
    ("gpl", "gpl", ["gpl", "gnu gpl"], [("1", "1 0"), ("2", "2 0|2"), ("3", "3 0|3")]),
    ("gpl", "general", ["gnu general public licen[sc]e", "general public licen[sc]e"], [("1", "1 0|1"), ("2", "2 0|2"), ("3", "3 0|3")]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl"], [("2", "2 0|2"), ("2.1", "2 1"), ("3", "3 0|3")]),
    ("lgpl", "lesser", ["gnu lesser general public licen[sc]e", "lesser general public licen[sc]e"], [("2.1", "2 1"), ("3", "3 0|3")]),
    ("agpl", "agpl", ["agpl", "gnu agpl"], [("1", "1 0|1"), ("3", "3 0|3")]),
    ("agpl", "affero", ["gnu affero general public licen[sc]e", "affero general public licen[sc]e"], [("1", "1 0|1"), ("3", "3 0|3")]),
    ("apache", "apache", ["apache licen[sc]e", "apache software licen[sc]e"], [("1.0", "1 0"), ("1.1", "1 1"), ("2", "2 0|2")]),
    ("mpl", "mozilla", ["mozilla public licen[sc]e"], [("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2 0|2")]),
    ("mpl", "mpl", ["mpl"], [("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2 0|2")]),
    ("epl", "eclipse", ["eclipse public licen[sc]e"], [("1.0", "1 0|1"), ("2.0", "2 0|2")]),
    ("eupl", "european", ["european union public licen[sc]e"], [("1.1", "1 1"), ("1.2", "1 2")]),
    ("afl", "academic", ["academic free licen[sc]e"], [("2.1", "2 1"), ("3.0", "3 0|3")]),
    ("osl", "open", ["open software licen[sc]e"], [("2.1", "2 1"), ("3.0", "3 0|3")]),
    ("artistic", "artistic", ["artistic licen[sc]e"], [("1.0", "1 0|1"), ("2.0", "2 0|2")]),
    ("bsl", "boost", ["boost software licen[sc]e"], [("1.0", "1 0|1")]),
    ("cddl", "cddl", ["cddl"], [("1.0", "1 0|1"), ("1.1", "1 1")]),
    ("ofl", "ofl", ["sil ofl", "ofl"], [("1.1", "1 1")]),
    ("gfdl", "documentation", ["gnu free documentation licen[sc]e", "free documentation licen[sc]e"], [("1.2", "1 2"), ("1.3", "1 3")]),
    ("mit", "mit", ["mit licen[sc]e"], []),
    ("mit", "expat", ["expat licen[sc]e"], []),
    ("x11", "x11", ["x11 licen[sc]e"], []),
    ("isc", "isc", ["isc licen[sc]e"], []),
    ("zlib", "zlib", ["zlib licen[sc]e", "zlib libpng licen[sc]e"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], []),
    ("unlicense", "unlicense", ["the unlicense", "unlicense"], []),
    ("python", "python", ["python software foundation licen[sc]e"], []),
    ("python", "psf", ["psf licen[sc]e"], []),
    ("postgresql", "postgresql", ["postgresql licen[sc]e"], []),
    ("bsd", "bsd", ["bsd licen[sc]e", "bsd style licen[sc]e"], []),
    ("bsd-2", "bsd", ["2 clause bsd", "bsd 2 clause", "simplified bsd"], []),
    ("bsd-2", "freebsd", ["freebsd licen[sc]e"], []),
    ("bsd-3", "bsd", ["3 clause bsd", "bsd 3 clause", "new bsd", "modified bsd"], []),
    ("bsd-4", "bsd", ["4 clause bsd", "bsd 4 clause", "original bsd"], []),
    ("odbl", "database", ["open database licen[sc]e"], [("1.0", "1 0|1")]),
]
#: Creative Commons: elements in their usual order, short and long form.
CC = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?derivatives|attribution no derivs"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(ative)?s"),
]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Contexts that name a license as the one granted: label-giving phrases before the name.
GRANTS = ["licen[sc]ed under", "released under", "distributed under", "under the terms of", "available under", "spdx licen[sc]e identifier"]
#: Signatures: (label, keyword, pattern, priority, confidence). Sentences of license bodies and headers, which are public texts and fixed values.
#: A body's own sentence (80) outranks names and grants; a sentence that several licenses share has less priority and confidence.
SIGNATURES = [
    ("0bsd", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 85, 0.95),
    ("afl-3.0", "academic", "licensed under the academic free license version 3 0", 80, 0.95),
    ("agpl-3", "affero", "under the terms of the gnu affero general public license as published by the free software foundation( either version 3)?", 80, 0.95),
    ("agpl-3", "affero", "gnu affero general public license version 3 19 november 2007", 85, 0.97),
    ("agpl-3", "remotely", "all users interacting with it remotely through a computer network", 80, 0.95),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 80, 0.9),
    ("apache-2", "apache", "apache license version 2 0 january 2004", 85, 0.97),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 85, 0.97),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license", 70, 0.85),
    ("apache-2", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 70, 0.85),
    ("apache-2", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable( except as stated in this section)? (copyright|patent) license", 80, 0.95),
    ("apache-2", "derivative", "you must give any other recipients of the work or derivative works a copy of this license", 80, 0.95),
    ("artistic-1.0", "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 80, 0.95),
    ("artistic-2.0", "package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 80, 0.95),
    ("beerware", "beer", "(the )?beer ware license", 60, 0.9),
    ("beerware", "beer", "you can buy me a beer in return", 80, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 75, 0.9),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 70, 0.9),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 70, 0.9),
    ("bsd", "regents", "the regents and contributors be liable for any direct indirect incidental special exemplary or consequential damages", 70, 0.85),
    ("bsd-3", "contributors", "nor the names of (its|his|their) contributors may be used to endorse or promote products derived from this software", 80, 0.95),
    ("bsd-3", "endorse", "may (not )?be used to endorse or promote products derived from this software", 72, 0.85),
    ("bsd-3-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license", 82, 0.95),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 82, 0.95),
    ("bsl-1.0", "boost", "boost software license version 1 0 august 17th 2003", 85, 0.97),
    ("bsl-1.0", "accompanying", "obtaining a copy of the software and accompanying documentation covered by this license", 80, 0.95),
    ("busl-1.1", "business", "business source license 1 1", 60, 0.9),
    ("busl-1.1", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 80, 0.95),
    ("cc0", "cc0", "cc0( 1 0)?( universal)?", 60, 0.9),
    ("cc0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders", 80, 0.95),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights to", 80, 0.95),
    ("cc-by", "appropriate", "you must give appropriate credit provide a link to the license and indicate if changes were made", 70, 0.85),
    ("cc-by-nc", "material", "you may not use the material for commercial purposes", 70, 0.85),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", 70, 0.85),
    ("cc-by-nd", "remix", "if you remix transform or build upon the material you may not distribute the modified material", 70, 0.85),
    ("cddl-1.0", "development", "common development and distribution license (cddl )?version 1 0", 80, 0.95),
    ("cddl", "development", "common development and distribution license", 50, 0.8),
    ("cecill", "cecill", "cecill( free software license agreement)?", 60, 0.85),
    ("cecill", "french", "governed by the cecill( b| c)? license under french law and abiding by the rules of distribution of free software", 80, 0.95),
    ("cpl-1.0", "common", "common public license( version)? (1 0|v1 0)", 60, 0.9),
    ("curl", "fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind", 86, 0.9),
    ("ecl-2.0", "educational", "educational community license version 2 0", 60, 0.9),
    ("elastic-2.0", "elastic", "elastic license (2 0|v2)", 60, 0.9),
    ("elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service", 80, 0.95),
    ("epl-1.0", "eclipse", "accompanying program is provided under the terms of this eclipse public license", 80, 0.95),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 85, 0.97),
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 85, 0.97),
    ("eupl-1.2", "eupl", "licensed under the eupl( version 1 2)?", 75, 0.9),
    ("gfdl-1.3", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 80, 0.95),
    ("gfdl", "invariant", "with no invariant sections( with)? no front cover texts and( with)? no back cover texts", 75, 0.9),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 80, 0.95),
    ("gpl-2", "general", "it under the terms of the gnu general public license as published by the free software foundation version 2", 85, 0.95),
    ("gpl-2+", "general", "gnu general public license as published by the free software foundation either version 2 of the license or (at your option )?any later version", 86, 0.97),
    ("gpl-3+", "general", "gnu general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version", 86, 0.97),
    ("gpl-2", "june", "gnu general public license version 2 june 1991", 85, 0.97),
    ("gpl-3", "june", "gnu general public license version 3 29 june 2007", 85, 0.97),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with this program", 65, 0.85),
    ("gpl-2", "verbatim", "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium", 80, 0.95),
    ("gpl-3", "convey", "you may convey verbatim copies of the program s source code as you receive it in any medium", 80, 0.95),
    ("gpl-classpath", "exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable", 82, 0.95),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose( and without fee)? is hereby granted", 75, 0.85),
    ("icu", "unicode", "unicode inc license agreement data files and software", 80, 0.95),
    ("ijg", "independent", "this software is based in part on the work of the independent jpeg group", 80, 0.9),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 74, 0.9),
    ("isc", "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 74, 0.9),
    ("json", "evil", "the software shall be used for good not evil", 90, 0.97),
    ("lgpl", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation", 78, 0.95),
    ("lgpl-2", "library", "under the terms of the gnu library general public license as published by the free software foundation", 80, 0.95),
    ("lgpl-2.1", "lesser", "gnu lesser general public license version 2 1 february 1999", 85, 0.97),
    ("lgpl-3", "lesser", "gnu lesser general public license version 3 29 june 2007", 85, 0.97),
    ("lgpl-2.1+", "lesser", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (at your option )?any later version", 86, 0.97),
    ("lgpl-3+", "lesser", "gnu lesser general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version", 86, 0.97),
    ("libpng", "png", "the png reference library is supplied as is", 80, 0.95),
    ("llvm-exception", "llvm", "apache license v2 0 with llvm exceptions", 80, 0.95),
    ("lppl-1.3c", "latex", "latex project public license( distributed from ctan archives)?( either)?( version 1 3c?)?", 60, 0.9),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 74, 0.9),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", 80, 0.97),
    ("mit", "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 74, 0.9),
    ("mit-0", "furnished", "to permit persons to whom the software is furnished to do so the software is provided as is without warranty of any kind", 82, 0.9),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 85, 0.97),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 85, 0.97),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 80, 0.95),
    ("mpl-2.0", "secondary", "this source code form is incompatible with secondary licenses", 80, 0.95),
    ("ms-pl", "microsoft", "microsoft public license( ms pl)?", 60, 0.9),
    ("ms-rl", "microsoft", "microsoft reciprocal license( ms rl)?", 60, 0.9),
    ("ncsa", "university", "university of illinois( ncsa)? open source license", 80, 0.95),
    ("odbl-1.0", "database", "made available under the open database license", 80, 0.95),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1", 85, 0.97),
    ("ofl", "font", "sil open font license", 60, 0.9),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 80, 0.95),
    ("osl-3.0", "open", "licensed under the open software license version 3 0", 80, 0.95),
    ("php-3.01", "php", "this source file is subject to version 3 01 of the php license", 85, 0.97),
    ("php", "php", "the php license( version 3 01?)?", 60, 0.85),
    ("postgresql", "postgresql", "postgresql (database management system|is released under the postgresql license)", 70, 0.85),
    ("public-domain", "public", "(released|placed|dedicated) (in|in to|into|to) the public domain", 60, 0.9),
    ("public-domain", "public", "public domain", 20, 0.5),
    ("python", "python", "psf is making python available to licensee on an as is basis", 80, 0.95),
    ("python", "python", "python software foundation license version 2", 80, 0.95),
    ("qpl-1.0", "public", "(the )?q public license version 1 0", 60, 0.9),
    ("ruby", "ruby", "ruby s license", 50, 0.8),
    ("sleepycat", "accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code", 60, 0.7),
    ("sspl-1.0", "server", "server side public license( version 1| v1)?", 60, 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 85, 0.97),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software", 80, 0.95),
    ("upl-1.0", "universal", "universal permissive license( v 1 0| version 1 0)?", 60, 0.9),
    ("vim", "vim", "vim is charityware", 80, 0.95),
    ("w3c", "w3c", "w3c software (notice and license|and document notice and license)", 80, 0.95),
    ("wtfpl", "fuck", "do what the fuck you want to( public license)?", 80, 0.95),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization", 82, 0.95),
    ("zlib", "arising", "in no event will the authors be held liable for any damages arising from the use of this software", 78, 0.9),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 80, 0.95),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 80, 0.95),
    ("zpl-2.1", "zope", "zope public license( zpl)?( version 2 1)?", 60, 0.9),
    ("all-rights-reserved", "rights", "all rights reserved", 50, 0.7),
    ("commercial", "eula", "end user licen[sc]e agreement eula", 50, 0.7),
    ("proprietary", "proprietary", "proprietary and confidential", 50, 0.7),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited", 70, 0.9),
    ("warranty-disclaimer", "warranty", "without warranty of any kind", 10, 0.3),
    ("warranty-disclaimer", "merchantability", "warranties of merchantability fitness for a particular purpose", 10, 0.3),
    ("warranty-disclaimer", "merchantability", "implied warranty of merchantability or fitness for a particular purpose", 10, 0.3),
]


def _start(pattern: str) -> list[str]:
    """The plain words with which a pattern starts, up to the first that may vary."""
    plain = re.split(r"[^a-z0-9 ]", pattern)[0]
    whole = plain == pattern or plain.endswith(" ")
    words = plain.split() if whole else plain.split()[:-1]
    return [" ".join(words)] if len(words) > 1 else []


def _rules() -> list[tuple[str, str, str, int, float, list[str]]]:
    """(label, keyword, word pattern, priority, confidence, needs); a longer context has the greater priority.

    ``needs`` are plain pieces of every text that the pattern hits, in words as the pattern writes them.
    """
    rules = [(*rule, _start(rule[2])) for rule in SIGNATURES]
    rules += [(label, "spdx", f"spdx license identifier {words}", 90, 0.97, ["license identifier"]) for label, words in SPDX]
    for label, word in JOINED:
        rules.append((label, word.split()[0], word, 50, 0.9, [word]))
        rules.append((f"{label}+", word.split()[0], f"{word} (or (any )?later|or newer)( version)?", 60, 0.9, [word, " or "]))
    any_grant, later = f"({'|'.join(GRANTS)})", "(or (any )?later|or newer)( version)?"
    named = [(label, key, name, versions) for label, key, names, versions in FAMILIES for name in names]
    for label, key, name, versions in named:
        plain = name.split("[")[0]
        rules.append((label, key, name, 30, 0.6, [plain]))
        rules += [(label, key, f"({grant}) (the )?{name}", 40, 0.8, [plain, grant.split("]")[-1]]) for grant in GRANTS]
        for suffix, pattern in versions:
            number = f"{pattern.split('|')[0].split()[0]} "
            version = f"{name} (version |v ?)?({pattern})"
            rules += [
                (f"{label}-{suffix}", key, version, 50, 0.9, [plain, number]),
                (f"{label}-{suffix}+", key, f"{version} {later}", 60, 0.9, [plain, number, " or "]),
                (f"{label}-{suffix}", key, f"{any_grant} (the )?{version}", 70, 0.95, [plain, number]),
                (f"{label}-{suffix}+", key, f"{any_grant} (the )?{version} {later}", 75, 0.95, [plain, number, " or "]),
            ]
    for label, short, long in CC:
        rank = len(short.split())
        rules.append((f"cc-{label}", "cc", f"cc {short}", 30 + rank, 0.7, [f"cc {short}"]))
        rules.append((f"cc-{label}", "creative", f"creative commons ({long})", 30 + rank, 0.7, ["creative commons"]))
        for version in CC_VERSIONS:
            dotted, number = version.replace(" ", "."), f" {version.split()[0]} "
            rules.append((f"cc-{label}-{dotted}", "cc", f"cc {short} {version}", 50 + rank, 0.9, [f"cc {short} {version}"]))
            international = f"creative commons ({long})( licen[sc]e)?( international)? {version}"
            rules.append((f"cc-{label}-{dotted}", "creative", international, 50 + rank, 0.9, ["creative commons", number]))
    return rules


RULES = _rules()
#: No rule can hit a text without one of the rules' keywords.
KEYWORDS = sorted({key for _, key, *_ in RULES})


def _spaced(pattern: str) -> str:
    """A word pattern over texts in which each word stands between its own pair of spaces.

    A space of the pattern is the end of one word and the start of the next, two spaces in the text.
    """
    return f" (?:{pattern.replace(' ?', '@').replace(' ', '  ').replace('@', '(?:  )?')}) "


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _needed(needs: list[str]) -> str:
    """SQL: the pieces of spaced text that a rule needs besides its keyword."""
    pieces = [n.replace(" ", "  ") if n == n.strip() else n for n in needs]
    return f"cast(array({', '.join(map(_literal, pieces))}) as array<string>)"


def _words_in(expression: str) -> str:
    """How many words a piece of the spaced text has."""
    return f"((length({expression}) - length(replace({expression}, ' ', ''))) div 2)"


def _finds(pattern: str) -> str:
    """SQL: the word intervals [start, end) of a pattern in the spaced text ``s``, by cutting the text at its finds."""
    pieces, hits = f"split(s, {pattern})", f"regexp_extract_all(s, {pattern}, 0)"
    step = f"struct(a.at + {_words_in('p')} + coalesce({_words_in('get(a.hits, a.k)')}, 0) as at, a.k + 1 as k, a.hits as hits, "
    found = f"if(a.k < size(a.hits), concat(a.found, array(struct(a.at + {_words_in('p')} as start, a.at + {_words_in('p')} + {_words_in('get(a.hits, a.k)')} as stop))), a.found) as found)"
    zero = f"struct(0L as at, 0 as k, {hits} as hits, cast(array() as array<struct<start:bigint,stop:bigint>>) as found)"
    return f"aggregate({pieces}, {zero}, (a, p) -> {step}{found}, a -> a.found)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, base, detections`` per row.

    ``base`` has per base phrase ``label, n, first, last`` (places in words), ``detections`` per surviving find
    ``label, start, stop, priority, confidence`` in the order of their starts.
    """
    lowered = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    parted = F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    parts = docs.select(F.col(id_col).cast("long").alias("doc_id"), parted.alias("s"))
    texts = parts.select("doc_id", F.when(F.col("s") == "", "").otherwise(F.concat(F.lit(" "), "s", F.lit(" "))).alias("s"))
    texts = texts.withColumn("n_words", F.expr(_words_in("s")).cast("long"))

    bases = []
    for phrase, label in BASE:
        cut = _literal(" " + phrase.replace(" ", "  ") + " ")
        size = len(phrase.split())
        pieces = f"split(s, {cut}, -1)"
        bases.append(
            f"if(contains(s, {cut}), named_struct('label', '{label}', 'n', cast(size({pieces}) - 1 as bigint), "
            f"'first', {_words_in(f'element_at({pieces}, 1)')}, 'last', n_words - {size} - {_words_in(f'element_at({pieces}, -1)')}), null)"
        )
    texts = texts.withColumn("base", F.expr(f"filter(array({', '.join(bases)}), x -> x is not null)"))

    # Rules are kept by keyword, so that a text is searched once for each keyword and then for the rules of those it has.
    by_key: dict[str, list[str]] = {}
    for i, (label, key, pattern, priority, confidence, needs) in enumerate(RULES):
        by_key.setdefault(key, []).append(
            f"struct({_literal(label)} as label, {_needed(needs)} as needs, {_literal(_spaced(pattern))} as pattern, {priority} as priority, {confidence}D as confidence, {i} as rule)"
        )
    families = ", ".join(f"struct({_literal(f' {key} ')} as word, array({', '.join(own)}) as rules)" for key, own in by_key.items())
    # A set lookup per word: an alternation of a hundred words would be tried at every word.
    gate = f"arrays_overlap(split(s, '  ?'), array({', '.join(map(_literal, KEYWORDS))}))"
    present = f"flatten(transform(filter(array({families}), f -> contains(s, f.word)), f -> f.rules))"
    hit = "forall(r.needs, k -> contains(s, k)) and s rlike r.pattern"
    tried = texts.withColumn("tried", F.expr(f"if({gate}, filter({present}, r -> {hit}), null)"))
    interval = "struct(r.label as label, x.start as start, x.stop as stop, r.priority as priority, r.confidence as confidence, r.rule as rule)"
    finds = f"flatten(transform(tried, r -> transform({_finds('r.pattern')}, x -> {interval})))"
    found = tried.withColumn("finds", F.expr(f"if(tried is null, null, {finds})"))
    # Finds in order of their starts, of equal ones the longest and strongest first: what contains a find then stands before it, and it is enough to know how far the finds of
    # each priority reach so far. One step per find, whatever their number.
    ranks = sorted({r[3] for r in RULES})
    key = "struct(x.start as a, -x.stop as b, -x.priority as c, x.rule as d, x as x)"
    ordered = f"transform(array_sort(transform(finds, x -> {key})), k -> k.x)"
    place = f"array_position(array({', '.join(map(str, ranks))}), x.priority)"
    held = f"exists(slice(a.reach, cast({place} as int), {len(ranks)}), r -> r >= x.stop)"
    reach = f"transform(a.reach, (r, i) -> if(i + 1 = {place} and r < x.stop, x.stop, r))"
    zero_reach = f"array_repeat(-1L, {len(ranks)})"
    typed = "cast(array() as array<struct<label:string,start:bigint,stop:bigint,priority:int,confidence:double,rule:int>>)"
    step = f"struct({reach} as reach, if({held}, a.kept, concat(a.kept, array(x))) as kept)"
    alive = f"aggregate({ordered}, struct({zero_reach} as reach, {typed} as kept), (a, x) -> {step}, a -> a.kept)"
    order = "struct(x.start as start, x.stop as stop, x.label as label, x.priority as priority, x.confidence as confidence)"
    empty = "cast(array() as array<struct<start:bigint,stop:bigint,label:string,priority:int,confidence:double>>)"
    return found.select(
        "doc_id", "n_words", "base",
        F.expr(f"coalesce(array_sort(array_distinct(transform({alive}, x -> {order}))), {empty})").alias("detections"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base.label", "detections.label")))
    best = F.greatest(F.when(F.size("base") > 0, 0.9).otherwise(0.0), F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words",
        F.expr("aggregate(base, 0L, (a, x) -> a + x.n)").alias("n_base"),
        F.array_min("base.first").alias("first_word"), F.array_max("base.last").alias("last_word"),
        F.array_join(F.array_sort("base.label"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), best.alias("score"),
    )

