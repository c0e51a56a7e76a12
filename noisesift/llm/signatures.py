"""Hand-written license signatures: bodies, headers, notices, compact names and addresses.

A signature is (label, gate, regex, priority) on normalised words, that is lower-cased
words with one space between two. The gate is a word that every match of the regex holds;
the regex is written without the space before it and the one after it.
"""

from __future__ import annotations

_AND_OR = "(?:and|and or|or)"
_FREE = "permission is hereby granted free of charge to any person"
_WITH = "this (?:software|program|file|product|library|code|work)"

# The wording of license texts. Bodies and conditions.
BODIES = (
    ("mit", "obtaining", f"{_FREE} obtaining a copy of this software and associated documentation files(?: the software)?(?: to deal in the software without restriction)?", 4),
    ("mit", "substantial", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 3),
    ("ncsa", "restriction", "to deal with the software without restriction", 4),
    ("x11", "advertising", "except as contained in this notice the names? of (?:[^ ]+ ){1,12}shall not be used in advertising", 4),
    ("boost-1.0", "organization", f"{_FREE} or organization obtaining a copy of the software and accompanying documentation covered by this license", 4),
    ("ofl-1.1", "font", f"{_FREE} obtaining a copy of the font software", 4),
    ("unicode", "unicode", f"{_FREE} obtaining a copy of the unicode data files", 4),
    ("upl-1.0", "condition", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software", 4),
    ("isc", "fee", f"permission to use copy modify {_AND_OR} distribute this software for any purpose with or without fee is hereby granted provided that", 4),
    ("0bsd", "fee", f"permission to use copy modify {_AND_OR} distribute this software for any purpose with or without fee is hereby granted(?! provided)", 4),
    ("hpnd", "fee", f"permission to use copy modify (?:distribute and sell|{_AND_OR} distribute) this software and its documentation for any purpose (?:and )?(?:is hereby granted )?without fee(?: is hereby granted)?(?! and without)", 4),
    ("postgresql", "agreement", f"permission to use copy modify {_AND_OR} distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 4),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 3),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 2),
    ("bsd-2-clause", "materials", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided", 4),
    ("bsd-3-clause", "endorse", "neither the names? of (?:[^ ]+ ){1,16}(?:nor|or) the names of (?:its|any|the|their)? ?(?:[^ ]+ ){0,4}contributors may be used to endorse or promote products derived from this software", 4),
    ("bsd-3-clause", "endorse", "the names? of (?:the )?(?:authors?|[^ ]+ [^ ]+) may not be used to endorse or promote products derived from this software", 3),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license", 4),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 4),
    ("apache-2.0", "compliance", "(?:licensed under the apache license version 2 0 the license )?you may not use this file except in compliance with the license", 5),
    ("apache-2.0", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 4),
    ("apache-2.0", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements", 4),
    ("apache-2.0", "reproduction", "apache license version 2 0 january 2004 (?:http www apache org licenses )?terms and conditions for use reproduction and distribution", 5),
    ("apache-1.1", "appear", "products derived from this software may not be called apache nor may apache appear in their names?", 4),
    ("apache-1.1", "apache", "this product includes software developed by the apache (?:software foundation|group)", 3),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 4),
    ("mpl", "rights", "see the license for the specific language governing rights and limitations", 2),
    ("epl", "accompanying", "the accompanying program is provided under the terms of this eclipse public license", 4),
    ("gpl", "changing", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 2),
    ("gpl-2.0", "freedom", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licenses? (?:is|are) intended to guarantee your freedom", 4),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works", 4),
    ("agpl-3.0", "copyleft", "the gnu affero general public license is a free copyleft license for software and other kinds of works", 4),
    ("lgpl-3.0", "incorporates", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 4),
    ("lgpl-2.1", "designated", "this license the lesser general public license applies to some specially designated software packages", 4),
    ("lgpl-2.0", "designated", "this license the library general public license applies to some specially designated (?:free )?software", 4),
    ("gpl", "proprietary", "this general public license does not permit incorporating your program into proprietary programs", 3),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 4),
    ("cc0-1.0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain", 4),
    ("zlib", "liable", "in no event will the authors? be held liable for any damages arising from the use of this software", 3),
    ("zlib", "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 4),
    ("wtfpl", "changing", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 4),
    ("artistic-1.0", "intent", "the intent of this document is to state the conditions under which a package may be copied", 4),
    ("artistic", "perl", "under the same terms as perl(?: itself)?", 3),
    ("openssl", "toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 4),
    ("php", "php", "this product includes php(?: software)? freely available from", 4),
    ("python-2.0", "psf", "psf is making python(?: [0-9]+)* available to licensee on an as is basis", 4),
    ("w3c", "licensee", "you the licensee agree that you have read understood and will comply with the following terms and conditions", 4),
    ("beerware", "stuff", "as long as you retain this notice you can do whatever you want with this stuff", 4),
    ("json", "evil", "the software shall be used for good not evil", 4),
    ("busl-1.1", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 4),
    ("elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service", 4),
    ("sspl-1.0", "functionality", "if you make the functionality of the program or a modified version available to third parties as a service", 4),
    ("commons-clause", "sell", "does not grant to you the right to sell the software", 4),
    ("ms-pl", "bear", "the software is licensed as is you bear the risk of using it", 3),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim", 4),
    ("lppl", "latex", "(?:conditions of the )?latex project public license", 3),
    ("mulanpsl", "mulan", "mulan (?:psl|permissive software license)(?: v ?[12])?", 3),
    ("blueoak-1.0", "oak", "blue oak model license(?: 1 0 0)?", 3),
    ("public-domain", "disclaims", "the author disclaims copyright to this source code", 4),
    ("public-domain", "domain", f"{_WITH} (?:is|has been placed|was placed) (?:hereby )?(?:in|into) the public domain", 3),
    ("proprietary", "unauthorized", f"unauthorized copying(?: or distribution)? of {_WITH}", 3),
    ("proprietary", "confidential", f"{_WITH} is the confidential and proprietary information of", 4),
    ("proprietary", "reproduced", "no part of this (?:publication|document|book|work|software) may be reproduced", 3),
)

# label, the license a notice names, the publisher's versions
_GNU = (("gpl", "general", ("1", "2", "3")), ("lgpl", "(?:lesser|library) general", ("2", "2 1", "3")), ("agpl", "affero general", ("1", "3")))
# label, compact names, versions
_COMPACT = (("gpl", ("gpl",), ("1.0", "2.0", "3.0")), ("lgpl", ("lgpl",), ("2.0", "2.1", "3.0")), ("agpl", ("agpl",), ("1.0", "3.0")),
            ("apache", ("apache", "apachev"), ("1.1", "2.0")), ("mpl", ("mpl",), ("1.1", "2.0")), ("epl", ("epl",), ("1.0", "2.0")), ("eupl", ("eupl",), ("1.1", "1.2")))
# label, address of its text
_ADDRESSES = (("mit", "mit"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("isc", "isc"), ("zlib", "zlib"), ("apache-2.0", "apache 2 0"),
              ("mpl-2.0", "mpl 2 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3 0"), ("epl-2.0", "epl 2 0"))
_CC = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
# names that are words of other use stand only after a word for license
_AFTER = "(?:licensed? under|licensed? under the|license|licensed|license is|license type|released under|released under the|available under|available under the|under the)"
_BARE = (("mit", "mit"), ("isc", "isc"), ("bsd", "bsd"), ("zlib", "zlib"), ("apache", "apache"), ("artistic", "artistic"), ("unlicense", "unlicense"))


def signatures() -> list[tuple[str, str, str, int]]:
    """All signatures: the bodies above, and those that follow from a family's versions."""
    out = list(BODIES)
    for label, kind, versions in _GNU:
        for v in versions:
            full = f"{label}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            digits = v if " " in v else f"{v}(?: 0)?"
            later = "(?: of the license)?(?: only| (?:or )?(?:at your option )?any later version| or later)?"
            out.append((full, "foundation", f"(?:gnu )?{kind} public license as published by the free software foundation (?:either )?version {digits}{later}", 5))
            out.append((full, "version", f"version {digits} of the (?:gnu )?{kind} public license", 4))
    for label, names, versions in _COMPACT:
        for v in versions:
            major, minor = v.split(".")
            for name in names:
                for gate in dict.fromkeys((f"{name}{major}", f"{name}v{major}" if not name.endswith("v") else f"{name}{major}")):
                    out.append((f"{label}-{v}", gate, gate + ("(?: 0)?" if minor == "0" else f" {minor}") + "(?: only| or later)?", 4))
    for label, place in _ADDRESSES:
        out.append((label, "opensource", f"opensource org licenses? {place}", 4))
    for label, versions in (("gpl", ("2.0", "3.0")), ("lgpl", ("2.1", "3.0")), ("agpl", ("3.0",))):
        out += [(f"{label}-{v}", "gnu", f"gnu org licenses (?:old licenses )?{label} {v.replace('.', ' ')}", 4) for v in versions]
    out += [(f"apache-{v}", "apache", f"apache org licenses license {v.replace('.', ' ')}", 4) for v in ("1.1", "2.0")]
    out += [(f"mpl-{v}", "mozilla", f"mozilla org mpl {v.replace('.', ' ')}", 4) for v in ("1.1", "2.0")]
    for kind in _CC:
        out += [(f"cc-{kind.replace(' ', '-')}-{v}", "creativecommons", f"creativecommons org licenses {kind} {v.replace('.', ' ')}", 4) for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    out.append(("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 4))
    for label, name in _BARE:
        out.append((label, name, f"{_AFTER} {name}", 2))
    out += [("mit", "mit", "mit x11(?: license)?", 3), ("mit", "mit", "mit or apache(?: license)?(?: version)? 2(?: 0)?", 3), ("mit", "mit", "apache(?: license)?(?: version)? 2 0 or mit", 3)]
    return out
