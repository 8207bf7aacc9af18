"""Signature rules of licence notices, over texts reduced to lower-case words with one space between.

``LICENSES`` holds, by licence, a label, words (after ``|`` another choice) of which every match
contains one, and a hand-written pattern of its name. ``FORMS`` puts a name into the sentences in which it is used. ``PHRASES``
holds sentences of licence texts and notices that name no licence.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """``priority`` 1 is the strongest.

    In every match of ``pattern`` a word (or words) begins with one of ``keywords``, and a word
    begins with ``also``, if that is not empty.
    """

    name: str
    label: str
    priority: int
    keywords: tuple[str, ...]
    also: str
    pattern: str
    score: float


#: Places that every user of the scan may rely on: phrase words stand consecutively.
BASE = (
    ("cc-by", "cc", "cc by"),
    ("gpl", "public", "general public license"),
    ("reserved", "reserved", "all rights reserved"),
)

_V = r"(?: v| version| ver)?"
_OR_LATER = r"(?: only| or later| or any later version| or at your option any later version)?"

LICENSES = (
    ("mit", "mit", r"mit(?: x11)?"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("x11", "x11", r"x11"),
    ("expat", "expat", r"expat"),
    ("apache-1.0", "apache", rf"apache(?: software)?(?: license)?{_V} 1 0"),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: license)?{_V} 1 1"),
    ("apache-2.0", "apache", rf"apache(?: software)?(?: license)?{_V} 2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("gpl-1.0", "gpl|general public|gnu public", rf"(?:gnu )?(?:gpl|general public license){_V} ?1(?: 0)?{_OR_LATER}"),
    ("gpl-2.0", "gpl|general public|gnu public", rf"(?:gnu )?(?:gpl|general public license){_V} ?2(?: 0)?{_OR_LATER}"),
    ("gpl-3.0", "gpl|general public|gnu public", rf"(?:gnu )?(?:gpl|general public license){_V} ?3(?: 0)?{_OR_LATER}"),
    ("gpl", "gpl|general public|gnu public", r"(?:gnu gpl|gpl|gnu general public license|gnu public license)"),
    ("lgpl-2.0", "lgpl|general public", rf"(?:gnu )?(?:lgpl|library general public license){_V} ?2(?: 0)?{_OR_LATER}"),
    ("lgpl-2.1", "lgpl|general public", rf"(?:gnu )?(?:lgpl|lesser general public license){_V} ?2 1{_OR_LATER}"),
    ("lgpl-3.0", "lgpl|general public", rf"(?:gnu )?(?:lgpl|lesser general public license){_V} ?3(?: 0)?{_OR_LATER}"),
    ("lgpl", "lgpl|general public", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license)"),
    ("agpl-1.0", "agpl|general public", rf"(?:gnu )?(?:agpl|affero general public license){_V} ?1(?: 0)?{_OR_LATER}"),
    ("agpl-3.0", "agpl|general public", rf"(?:gnu )?(?:agpl|affero general public license){_V} ?3(?: 0)?{_OR_LATER}"),
    ("agpl", "agpl|general public", r"(?:gnu )?(?:agpl|affero general public license)"),
    ("gfdl-1.1", "gnu", rf"gnu free documentation license{_V} 1 1{_OR_LATER}"),
    ("gfdl-1.2", "gnu", rf"gnu free documentation license{_V} 1 2{_OR_LATER}"),
    ("gfdl-1.3", "gnu", rf"gnu free documentation license{_V} 1 3{_OR_LATER}"),
    ("gfdl", "gnu", r"gnu (?:free documentation license|fdl)"),
    ("bsd-2-clause", "bsd|simplified|freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "bsd|0bsd|zero clause", r"(?:0bsd|bsd 0 clause|zero clause bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("isc", "isc", r"isc"),
    ("mpl-1.0", "mpl|mozilla", rf"(?:mpl|mozilla public license){_V} ?1 0"),
    ("mpl-1.1", "mpl|mozilla", rf"(?:mpl|mozilla public license){_V} ?1 1"),
    ("mpl-2.0", "mpl|mozilla", rf"(?:mpl|mozilla public license){_V} ?2(?: 0)?"),
    ("mpl", "mpl|mozilla", r"(?:mpl|mozilla public license)"),
    ("epl-1.0", "epl|eclipse", rf"(?:epl|eclipse public license){_V} ?1 0"),
    ("epl-2.0", "epl|eclipse", rf"(?:epl|eclipse public license){_V} ?2 0"),
    ("edl-1.0", "eclipse", rf"eclipse distribution license{_V} 1 0"),
    ("eupl-1.1", "eupl|european union", rf"(?:eupl|european union public licen[cs]e){_V} ?1 1"),
    ("eupl-1.2", "eupl|european union", rf"(?:eupl|european union public licen[cs]e){_V} ?1 2"),
    ("cddl-1.0", "cddl|common development", rf"(?:cddl|common development and distribution license){_V} ?1 0"),
    ("cddl-1.1", "cddl|common development", rf"(?:cddl|common development and distribution license){_V} ?1 1"),
    ("cpl-1.0", "cpl|common public", rf"(?:cpl|common public license){_V} ?1 0"),
    ("osl-3.0", "open software", rf"open software license{_V} ?3 0"),
    ("afl-3.0", "afl|academic free", rf"(?:afl|academic free license){_V} ?3 0"),
    ("artistic-1.0", "artistic", rf"artistic(?: license)?{_V} 1 0"),
    ("artistic-2.0", "artistic", rf"artistic(?: license)?{_V} 2 0"),
    ("artistic", "artistic", r"(?:perl )?artistic"),
    ("bsl-1.0", "bsl|boost|busl|business source", rf"(?:boost software(?: license)?|bsl){_V} 1 0"),
    ("busl-1.1", "bsl|boost|busl|business source", rf"(?:business source license|busl){_V} ?1 1"),
    ("sspl-1.0", "sspl|server side", rf"(?:sspl|server side public license){_V} ?1(?: 0)?"),
    ("elastic-2.0", "elastic", rf"elastic(?: license)?{_V} 2(?: 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("openssl", "openssl", r"openssl"),
    ("python-2.0", "psf|python", rf"(?:psf|python(?: software foundation)?(?: license)?{_V}) 2(?: 0)?"),
    ("php-3.01", "php", rf"php(?: license)?{_V} 3 01"),
    ("ruby", "ruby", r"ruby"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("w3c", "w3c", r"w3c(?: software(?: notice)?(?: and)?(?: document)?)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("beerware", "beerware", r"beerware"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font license{_V} ?1 1"),
    ("ofl", "open font", r"(?:sil )?open font"),
    ("odbl-1.0", "odbl|open database|odc by|open data commons", r"(?:odbl|open database license)(?: v?1 0)?"),
    ("odc-by-1.0", "odbl|open database|odc by|open data commons", r"(?:odc by|open data commons attribution(?: license)?)(?: v?1 0)?"),
    ("pddl-1.0", "pddl", r"(?:odc )?pddl(?: v?1 0)?"),
    ("cc0-1.0", "cc0|cc zero|creative", r"(?:cc0|cc zero|creative commons zero)(?: v?1 0)?(?: universal)?"),
    ("cc-by-nc-nd-2.0", "cc by nc|creative", r"cc by nc nd 2 0"),
    ("cc-by-nc-nd-3.0", "cc by nc|creative", r"cc by nc nd 3 0"),
    ("cc-by-nc-nd-4.0", "cc by nc|creative", r"cc by nc nd 4 0"),
    ("cc-by-nc-nd", "cc by nc|creative", r"cc by nc nd"),
    ("cc-by-nc-sa-2.0", "cc by nc|creative", r"cc by nc sa 2 0"),
    ("cc-by-nc-sa-3.0", "cc by nc|creative", r"cc by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", "cc by nc|creative", r"cc by nc sa 4 0"),
    ("cc-by-nc-sa", "cc by nc|creative", r"cc by nc sa"),
    ("cc-by-nc-2.0", "cc by nc|creative", r"cc by nc 2 0"),
    ("cc-by-nc-3.0", "cc by nc|creative", r"cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc by nc|creative", r"cc by nc 4 0"),
    ("cc-by-nc", "cc by nc|creative", r"(?:cc by nc|creative commons attribution non ?commercial)"),
    ("cc-by-nd-4.0", "cc by nd|creative", r"cc by nd 4 0"),
    ("cc-by-nd", "cc by nd|creative", r"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))"),
    ("cc-by-sa-2.0", "cc by sa|creative", r"cc by sa 2 0"),
    ("cc-by-sa-3.0", "cc by sa|creative", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa|creative", r"cc by sa 4 0"),
    ("cc-by-sa", "cc by sa|creative", r"(?:cc by sa|creative commons attribution share ?alike)"),
    ("cc-by-2.0", "cc by", r"cc by 2 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by", "cc by", r"cc by"),
    ("cc", "creative", r"creative commons(?: attribution)?(?: \d 0)?(?: international| unported| generic)?"),
    ("proprietary", "proprietary", r"(?:a |the )?(?:proprietary|commercial and proprietary)"),
)

#: Sentence around a name: (suffix of the rule's name, priority, word in every match, sentence, score).
FORMS = (
    ("tag", 1, "spdx", r"spdx license identifier {}", 1.0),
    (
        "notice",
        1,
        "licen",
        r"(?:dual )?(?:licen[cs]ed|released|distributed|available|published|provided|made available)"
        r"(?: to you)? (?:under|on|subject to)(?: the)?(?: terms| conditions| terms and conditions)?(?: of)?"
        r"(?: the)? {}(?: public)?(?: licen[cs]e)?(?:{version})?",
        0.95,
    ),
    ("name", 2, "licen", r"(?:the )?{}(?: software| public)? licen[cs]e(?:{version})?", 0.8),
    ("short", 3, "", r"{}", 0.5),
)
_VERSION = r" v(?:ersion)? ?\d(?: \d)?"
#: Names that are also ordinary words or too short to stand without a sentence around them.
_NOT_ALONE = {
    "mit", "mit-0", "x11", "expat", "apache", "bsd", "isc", "artistic", "ruby", "zlib", "libpng", "openssl", "postgresql",
    "ncsa", "w3c", "ofl", "proprietary", "python-2.0", "cc-by", "apache-1.0", "apache-1.1", "elastic-2.0",
}

PHRASES = (
    ("reserved-notice", "reserved", 4, "reserved", r"all rights (?:are )?reserved", 0.6),
    ("rights-some", "some-rights", 4, "reserved", r"some rights reserved", 0.6),
    ("rights-none", "public-domain", 3, "reserved", r"no rights reserved", 0.7),
    ("copyright-year", "copyright", 4, "copyright", r"copyright(?: c| ©)? (?:19|20)\d\d(?: (?:19|20)\d\d)*", 0.6),
    ("copyright-holder", "copyright", 4, "copyright", r"copyright (?:holder|owner|notice)s?", 0.3),
    ("copyright-held", "copyright", 4, "copyright", r"copyright(?:ed)? by", 0.4),
    ("public-domain", "public-domain", 3, "domain", r"(?:in|into|to|released into) the public domain", 0.7),
    ("dedication", "public-domain", 2, "domain", r"public domain (?:dedication|mark)(?: 1 0)?", 0.8),
    ("mit-grant", "mit", 1, "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit-notice", "mit", 2, "notice", r"the above copyright notice and this permission notice shall be included", 0.9),
    ("as-is", "warranty-disclaimer", 4, "warrant", r"(?:is )?provided as is without warranty of any kind", 0.4),
    ("no-warranty", "warranty-disclaimer", 4, "warrant", r"without any (?:express or implied )?warrant(?:y|ies)", 0.4),
    ("fitness", "warranty-disclaimer", 4, "merchantability", r"merchantability (?:and|or) fitness for a particular purpose", 0.4),
    ("bsd-grant", "bsd", 1, "redistribution", r"redistribution and use in source and binary forms with or without modification", 1.0),
    ("bsd-endorse", "bsd-3-clause", 2, "endorse", r"to endorse or promote products derived from this software", 0.9),
    ("isc-grant", "isc", 1, "permission", r"permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("gpl-grant", "gpl", 1, "foundation", r"you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("gpl-published", "gpl", 2, "foundation", r"as published by the free software foundation", 0.8),
    ("apache-except", "apache-2.0", 2, "compliance", r"you may not use this file except in compliance with the license", 0.9),
    ("apache-copy", "apache-2.0", 1, "apache", r"www apache org licenses license 2 0(?: txt| html)?", 1.0),
    ("gnu-site", "gpl", 2, "gnu", r"www gnu org (?:licenses|copyleft)(?: gpl(?: \d 0)?)?(?: html| txt)?", 0.8),
    ("mit-site", "mit", 1, "opensource", r"opensource org licenses mit(?: license)?(?: php)?", 1.0),
    ("bsd-site", "bsd", 1, "opensource", r"opensource org licenses bsd(?: \d clause| license)?(?: php)?", 1.0),
    ("mpl-site", "mpl-2.0", 1, "mozilla", r"mozilla org mpl 2 0", 1.0),
    ("cc-site", "cc", 2, "creativecommons", r"creativecommons org licenses", 0.8),
    ("cc-by-site", "cc-by", 1, "creativecommons", r"creativecommons org licenses by \d 0", 1.0),
    ("cc-by-sa-site", "cc-by-sa", 1, "creativecommons", r"creativecommons org licenses by sa \d 0", 1.0),
    ("cc-by-nc-site", "cc-by-nc", 1, "creativecommons", r"creativecommons org licenses by nc \d 0", 1.0),
    ("cc-by-nd-site", "cc-by-nd", 1, "creativecommons", r"creativecommons org licenses by nd \d 0", 1.0),
    ("cc-by-nc-sa-site", "cc-by-nc-sa", 1, "creativecommons", r"creativecommons org licenses by nc sa \d 0", 1.0),
    ("cc-by-nc-nd-site", "cc-by-nc-nd", 1, "creativecommons", r"creativecommons org licenses by nc nd \d 0", 1.0),
    ("cc0-site", "cc0-1.0", 1, "creativecommons", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("unlicense-site", "unlicense", 1, "unlicense", r"unlicense org", 1.0),
    ("unlicense-grant", "unlicense", 1, "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("mpl-form", "mpl-2.0", 1, "mozilla", r"this source code form is subject to the terms of the mozilla public license", 1.0),
    ("zlib-grant", "zlib", 1, "misrepresented", r"the origin of this software must not be misrepresented", 1.0),
    ("boost-grant", "bsl-1.0", 1, "hereby", r"permission is hereby granted free of charge to any person or organization", 1.0),
    ("confidential", "proprietary", 2, "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 0.8),
    ("unauthorized", "proprietary", 3, "unauthori", r"unauthori[sz]ed (?:copying|reproduction|use|distribution)", 0.6),
    ("no-part", "proprietary", 2, "reproduced", r"no part of this (?:publication|work|document|book) may be reproduced", 0.8),
    ("noncommercial", "non-commercial", 3, "noncommercial|non commercial", r"for non ?commercial (?:use|purposes)(?: only)?", 0.6),
    ("personal", "non-commercial", 3, "personal", r"for personal use only", 0.5),
    ("trademark", "trademark", 4, "trademark", r"(?:registered )?trademarks? of", 0.3),
    ("patent", "patent", 4, "patent", r"(?:patent pending|patents? granted)", 0.3),
    ("terms-use", "terms", 4, "terms", r"terms (?:of (?:use|service)|and conditions)", 0.3),
    ("license-agreement", "license-mention", 4, "licen", r"(?:end user )?licen[cs]e agreement", 0.4),
    ("licensed-under", "license-mention", 4, "licen", r"licen[cs]ed under(?: the)?", 0.2),
    ("see-license", "license-mention", 4, "licen", r"see (?:the )?licen[cs]e(?: file)?(?: for details)?", 0.2),
    ("copyleft", "copyleft", 4, "copyleft", r"copyleft", 0.4),
)


def rules() -> list[Rule]:
    """All rules: every licence name in every sentence, then the phrases."""
    out = []
    for label, keyword, name in LICENSES:
        for suffix, priority, word, sentence, score in FORMS:
            if suffix != "short" or label not in _NOT_ALONE:
                pattern = sentence.replace("{}", f"(?:{name})").replace("{version}", _VERSION)
                out.append(Rule(f"{label}/{suffix}", label, priority, tuple(keyword.split("|")), word, pattern, score))
    for name, label, priority, keyword, pattern, score in PHRASES:
        out.append(Rule(name, label, priority, tuple(keyword.split("|")), "", pattern, score))
    return out
