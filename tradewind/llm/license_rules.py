"""Signature rules of licence notices.

Patterns are regular expressions over lower-case words with one space between them; punctuation is no
word, so "GPL-3.0" reads ``gpl 3 0``. A space is never followed by a quantifier, and nothing is used
beyond what all common engines read alike: groups, alternatives, classes, ``?`` and bounded repeats.
Each rule has a keyword, a part that every match of it contains."""

from __future__ import annotations

import re
from typing import NamedTuple

# Priorities, the strongest first, and how sure a detection of each is.
TAG, GRANT, TITLE, TEXT, LINK, CLUE = range(6)
SURE = (1.0, 0.95, 0.9, 0.8, 0.7, 0.5)


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    pattern: str


# The phrases whose places are counted, with their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

LICENSE = "licen[cs]e"
# Parts that many keywords, or all matches of many rules, have in common.
STEMS = ("licen", "gpl", "mpl", "epl", "apache", "bsd", "copyright", "permission", "rights", "creative", "public domain")


def _at(major: int, minor: int | None = 0) -> str:
    """A version after a name: "version 2.0", "v2", "2"; a minor number that is not 0 is required."""
    if minor is None:
        return f"(?: version| v)? v?{major}"
    return f"(?: version| v)? v?{major}" + (f" {minor}" if minor else "(?: 0)?")


# Label, keyword, identifier in words, name. Each becomes three rules: the identifier in a tag, the
# name in a grant ("released under the ..."), and the name alone.
LICENSES = (
    ("mit", "mit licen", "mit", f"mit {LICENSE}"),
    ("mit-0", "mit no attribution", "mit 0", f"mit no attribution(?: {LICENSE})?"),
    ("x11", "x11 licen", "x11", f"x11 {LICENSE}"),
    ("expat", "expat licen", "expat", f"expat {LICENSE}"),
    ("isc", "isc licen", "isc", f"isc {LICENSE}"),
    ("0bsd", "zero clause bsd", "0bsd", f"zero clause bsd(?: {LICENSE})?"),
    ("bsd-1-clause", "bsd", "bsd 1 clause", f"(?:bsd 1 clause|1 clause bsd)(?: {LICENSE})?"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", f"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: {LICENSE})?(?: clause)?"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", f"(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: {LICENSE})?"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", f"(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: {LICENSE})?"),
    ("bsd", "bsd", "bsd", f"(?:new |modified |revised |original )?bsd(?: style)? {LICENSE}"),
    ("apache-1.0", "apache", "apache 1 0", f"apache (?:software )?{LICENSE}{_at(1)}"),
    ("apache-1.1", "apache", "apache 1 1", f"apache (?:software )?{LICENSE}{_at(1, 1)}"),
    ("apache-2.0", "apache", "apache 2 0", f"apache (?:software )?(?:{LICENSE} )?(?:version )?v?2(?: 0)?(?: {LICENSE})?"),
    ("apache", "apache", "apache", f"apache (?:software )?{LICENSE}"),
    ("gpl-1.0", "general public", "gpl 1 0(?: only| or later)?", f"(?:gnu )?general public {LICENSE}{_at(1)}"),
    ("gpl-2.0", "general public", "gpl 2 0(?: only)?", f"(?:gnu )?general public {LICENSE}{_at(2)}(?: only)?"),
    ("gpl-2.0-or-later", "general public", "gpl 2 0 or later", f"(?:gnu )?general public {LICENSE}{_at(2)} or (?:any )?later(?: version)?"),
    ("gpl-3.0", "general public", "gpl 3 0(?: only)?", f"(?:gnu )?general public {LICENSE}{_at(3)}(?: only)?"),
    ("gpl-3.0-or-later", "general public", "gpl 3 0 or later", f"(?:gnu )?general public {LICENSE}{_at(3)} or (?:any )?later(?: version)?"),
    ("gpl", "general public", "gpl", f"(?:gnu )?general public {LICENSE}"),
    ("lgpl-2.0", "general public", "lgpl 2 0(?: only| or later)?", f"(?:gnu )?(?:library|lesser) general public {LICENSE}{_at(2)}"),
    ("lgpl-2.1", "general public", "lgpl 2 1(?: only| or later)?", f"(?:gnu )?lesser general public {LICENSE}{_at(2, 1)}"),
    ("lgpl-3.0", "general public", "lgpl 3 0(?: only| or later)?", f"(?:gnu )?lesser general public {LICENSE}{_at(3)}"),
    ("lgpl", "general public", "lgpl", f"(?:gnu )?(?:library|lesser) general public {LICENSE}"),
    ("agpl-1.0", "general public", "agpl 1 0(?: only| or later)?", f"(?:affero|gnu affero) general public {LICENSE}{_at(1)}"),
    ("agpl-3.0", "general public", "agpl 3 0(?: only| or later)?", f"(?:gnu )?affero general public {LICENSE}{_at(3)}"),
    ("agpl", "general public", "agpl", f"(?:gnu )?affero general public {LICENSE}"),
    ("gfdl-1.1", "free documentation", "gfdl 1 1(?: only| or later)?", f"(?:gnu )?free documentation {LICENSE}{_at(1, 1)}"),
    ("gfdl-1.2", "free documentation", "gfdl 1 2(?: only| or later)?", f"(?:gnu )?free documentation {LICENSE}{_at(1, 2)}"),
    ("gfdl-1.3", "free documentation", "gfdl 1 3(?: only| or later)?", f"(?:gnu )?free documentation {LICENSE}{_at(1, 3)}"),
    ("gfdl", "free documentation", "gfdl", f"(?:gnu )?free documentation {LICENSE}"),
    ("mpl-1.0", "mozilla", "mpl 1 0", f"mozilla public {LICENSE}{_at(1)}"),
    ("mpl-1.1", "mozilla", "mpl 1 1", f"mozilla public {LICENSE}{_at(1, 1)}"),
    ("mpl-2.0", "mozilla", "mpl 2 0(?: no copyleft exception)?", f"mozilla public {LICENSE}{_at(2)}"),
    ("mpl", "mozilla", "mpl", f"mozilla public {LICENSE}"),
    ("npl", "netscape public", "npl 1 [01]", f"netscape public {LICENSE}"),
    ("epl-1.0", "eclipse", "epl 1 0", f"eclipse public {LICENSE}{_at(1)}"),
    ("epl-2.0", "eclipse", "epl 2 0", f"eclipse public {LICENSE}{_at(2)}"),
    ("epl", "eclipse", "epl", f"eclipse public {LICENSE}"),
    ("edl-1.0", "eclipse", "edl 1 0", f"eclipse distribution {LICENSE}(?:{_at(1)})?"),
    ("cddl-1.0", "common development", "cddl 1 0", f"common development and distribution {LICENSE}{_at(1)}"),
    ("cddl-1.1", "common development", "cddl 1 1", f"common development and distribution {LICENSE}{_at(1, 1)}"),
    ("cddl", "common development", "cddl", f"common development and distribution {LICENSE}"),
    ("cpl-1.0", "common public", "cpl 1 0", f"common public {LICENSE}(?:{_at(1)})?"),
    ("ipl-1.0", "ibm public", "ipl 1 0", f"ibm public {LICENSE}(?:{_at(1)})?"),
    ("eupl-1.1", "european union public", "eupl 1 1", f"european union public {LICENSE}{_at(1, 1)}"),
    ("eupl-1.2", "european union public", "eupl 1 2", f"european union public {LICENSE}{_at(1, 2)}"),
    ("eupl", "european union public", "eupl", f"european union public {LICENSE}"),
    ("artistic-1.0", "artistic", "artistic 1 0(?: perl)?", f"artistic {LICENSE}{_at(1)}"),
    ("artistic-2.0", "artistic", "artistic 2 0", f"artistic {LICENSE}{_at(2)}"),
    ("artistic", "artistic", "artistic", f"artistic {LICENSE}"),
    ("bsl-1.0", "boost", "bsl 1 0", f"boost software {LICENSE}(?:{_at(1)})?"),
    ("zlib", "zlib", "zlib", f"zlib(?: libpng)? {LICENSE}"),
    ("libpng", "libpng", "libpng(?: 2 0)?", f"libpng {LICENSE}"),
    ("unlicense", "unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("ofl-1.0", "open font", "ofl 1 0", f"(?:sil )?open font {LICENSE}{_at(1)}"),
    ("ofl-1.1", "open font", "ofl 1 1", f"(?:sil )?open font {LICENSE}{_at(1, 1)}"),
    ("ofl", "open font", "ofl", f"(?:sil )?open font {LICENSE}"),
    ("python-2.0", "python", "python 2 0", f"python {LICENSE}{_at(2)}"),
    ("psf-2.0", "python software", "psf 2 0", f"python software foundation {LICENSE}(?:{_at(2)})?"),
    ("ruby", "ruby", "ruby", f"ruby (?:s )?{LICENSE}"),
    ("php-3.0", "php", "php 3 0", f"php {LICENSE}{_at(3)}"),
    ("php-3.01", "php", "php 3 01", f"php {LICENSE}(?: version| v)? v?3 01"),
    ("postgresql", "postgresql", "postgresql", f"postgresql {LICENSE}"),
    ("openssl", "openssl", "openssl", f"openssl {LICENSE}"),
    ("ncsa", "ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LICENSE}"),
    ("ms-pl", "microsoft", "ms pl", f"microsoft public {LICENSE}"),
    ("ms-rl", "microsoft", "ms rl", f"microsoft reciprocal {LICENSE}"),
    ("apsl-2.0", "apple public", "apsl 2 0", f"apple public source {LICENSE}(?:{_at(2)})?"),
    ("osl-3.0", "open software licen", "osl 3 0", f"open software {LICENSE}{_at(3)}"),
    ("osl", "open software licen", "osl [12] [01]", f"open software {LICENSE}"),
    ("afl-3.0", "academic free", "afl 3 0", f"academic free {LICENSE}{_at(3)}"),
    ("afl", "academic free", "afl [12] [01]", f"academic free {LICENSE}"),
    ("ecl-2.0", "educational community", "ecl 2 0", f"educational community {LICENSE}(?:{_at(2)})?"),
    ("upl-1.0", "universal permissive", "upl 1 0", f"universal permissive {LICENSE}(?:{_at(1)})?"),
    ("qpl-1.0", "q public", "qpl 1 0", f"q public {LICENSE}(?:{_at(1)})?"),
    ("lppl", "latex project", "lppl 1 (?:0|1|2|3a|3c)", f"latex project public {LICENSE}"),
    ("vim", "vim licen", "vim", f"vim {LICENSE}"),
    ("beerware", "beer", "beerware", f"beer(?: )?ware {LICENSE}"),
    ("cecill", "cecill", "cecill(?: 2 [01]| b| c)?", f"cecill(?: [bc])?(?: free software)?(?: {LICENSE})?"),
    ("mulan-psl-2.0", "mulan", "mulanpsl 2 0", f"mulan (?:permissive software|psl) {LICENSE}"),
    ("blueoak-1.0", "blue oak", "blueoak 1 0 0", f"blue oak model {LICENSE}(?: 1 0 0)?"),
    ("sleepycat", "sleepycat", "sleepycat", f"sleepycat {LICENSE}"),
    ("odbl", "database licen", "odbl 1 0", f"open (?:data commons open )?database {LICENSE}"),
    ("odc-by", "open data commons", "odc by 1 0", f"open data commons attribution {LICENSE}"),
    ("pddl", "public domain dedication", "pddl 1 0", f"(?:open data commons )?public domain dedication and {LICENSE}"),
    ("ogl-uk", "open government", "ogl uk [123] 0", f"open government {LICENSE}"),
    ("sspl-1.0", "server side public", "sspl 1 0", f"server side public {LICENSE}"),
    ("busl-1.1", "business source", "busl 1 1", f"business source {LICENSE}"),
    ("elastic-2.0", "elastic licen", "elastic 2 0", f"elastic {LICENSE}"),
    ("commons-clause", "commons clause", "commons clause", "commons clause(?: license condition)?"),
    ("cc0-1.0", "cc0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
)

# Parts of Creative Commons licences, in code and in words; each becomes a rule for the code with any
# version, the names with a version, and the names alone.
CREATIVE_COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share(?: )?alike"),
    ("cc-by-nd", "by nd", "attribution no(?: )?deriv(?:ative)?s?"),
    ("cc-by-nc", "by nc", "attribution non(?: )?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non(?: )?commercial share(?: )?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non(?: )?commercial no(?: )?deriv(?:ative)?s?"),
)

# Rules by hand: names in short, sentences of licence texts, links, and clues.
SINGLE = (
    Rule(TITLE, "gpl-2.0", "gpl", f"(?:gnu )?gpl{_at(2)}"),
    Rule(TITLE, "gpl-2.0", "gplv2", "gplv2"),
    Rule(TITLE, "gpl-2.0-or-later", "gpl", f"(?:gnu )?gpl{_at(2)} or (?:any )?later"),
    Rule(TITLE, "gpl-3.0", "gpl", f"(?:gnu )?gpl{_at(3)}"),
    Rule(TITLE, "gpl-3.0", "gplv3", "gplv3"),
    Rule(TITLE, "gpl-3.0-or-later", "gpl", f"(?:gnu )?gpl{_at(3)} or (?:any )?later"),
    Rule(TITLE, "gpl", "gnu gpl", "gnu gpl"),
    Rule(TITLE, "gpl", "gpl licen", "gpl licen[cs]ed?"),
    Rule(TITLE, "lgpl-2.1", "lgpl", f"(?:gnu )?lgpl{_at(2, 1)}"),
    Rule(TITLE, "lgpl-3.0", "lgpl", f"(?:gnu )?lgpl{_at(3)}"),
    Rule(TITLE, "lgpl", "lgpl", "gnu lgpl"),
    Rule(TITLE, "agpl-3.0", "agpl", f"(?:gnu )?agpl{_at(3)}"),
    Rule(TITLE, "agpl-3.0", "agplv3", "agplv3"),
    Rule(TITLE, "agpl", "agpl", "gnu agpl"),
    Rule(TITLE, "apache-2.0", "asl 2 0", "asl 2 0"),
    Rule(TITLE, "apache-2.0", "apache2", "apache2"),
    Rule(TITLE, "mpl-2.0", "mpl 2 0", "mpl 2 0"),
    Rule(TITLE, "mpl-1.1", "mpl 1 1", "mpl 1 1"),
    Rule(TITLE, "epl-1.0", "epl 1 0", "epl 1 0"),
    Rule(TITLE, "epl-2.0", "epl 2 0", "epl 2 0"),
    Rule(TITLE, "cddl", "cddl", "cddl(?: 1 [01])?"),
    Rule(TITLE, "eupl-1.2", "eupl", "eupl 1 2"),
    Rule(TITLE, "unlicense", "unlicense", "unlicense org"),
    Rule(TITLE, "wtfpl", "what the fuck", f"do what the fuck you want to public {LICENSE}"),
    Rule(TITLE, "cc0-1.0", "creative commons", "creative commons zero(?: 1 0)?(?: universal)?"),
    Rule(TITLE, "cc0-1.0", "creative commons", "creative commons public domain dedication"),
    Rule(TITLE, "cc-pdm", "public domain mark", "public domain mark(?: 1 0)?"),
    Rule(TITLE, "creative-commons", "creative commons", f"creative commons {LICENSE}"),
    Rule(TITLE, "public-domain", "public domain", "(?:placed|released|dedicated|dedicate this (?:software|work)) (?:in|into|to) the public domain"),
    Rule(TITLE, "dual-license", "dual licen", "dual licen[cs]ed? under"),
    Rule(TITLE, "openrail", "openrail", "(?:big(?:code|science) )?openrail(?: m)?(?: license)?"),
    Rule(TITLE, "llama-community", "llama", f"llama (?:2 |3 |3 1 )?community {LICENSE}(?: agreement)?"),
    Rule(TEXT, "mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Rule(TEXT, "mit", "above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Rule(TEXT, "mit", "without warranty", "the software is provided as is without warranty of any kind express or implied"),
    Rule(TEXT, "isc", "permission to use", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    Rule(TEXT, "bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    Rule(TEXT, "bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    Rule(TEXT, "bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    Rule(TEXT, "bsd-3-clause", "endorse or promote", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products"),
    Rule(TEXT, "bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    Rule(TEXT, "apache-2.0", "you may not use this file", f"you may not use this file except in compliance with the {LICENSE}"),
    Rule(TEXT, "apache-2.0", "distributed on an as is", f"software distributed under the {LICENSE} is distributed on an as is basis"),
    Rule(TEXT, "apache-2.0", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    Rule(TEXT, "gpl", "free software", "this (?:program|library|file) is free software you can redistribute it and or modify it"),
    Rule(TEXT, "gpl", "at your option any later", "either version [123](?: [01])? of the license or at your option any later version"),
    Rule(TEXT, "gpl", "fitness for a particular purpose", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    Rule(TEXT, "gpl", "you should have received", "you should have received a copy of the gnu (?:lesser |affero |library )?general public license"),
    Rule(TEXT, "lgpl", "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"),
    Rule(TEXT, "mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license"),
    Rule(TEXT, "mpl-2.0", "mpl was not distributed", "if a copy of the mpl was not distributed with this file"),
    Rule(TEXT, "zlib", "as is without any express", "this software is provided as is without any express or implied warranty"),
    Rule(TEXT, "zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    Rule(TEXT, "bsl-1.0", "machine executable object code", "machine executable object code generated by a source language processor"),
    Rule(TEXT, "unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    Rule(TEXT, "public-domain", "public domain", "this (?:work|software|text|file|document) is (?:in|part of) the public domain"),
    Rule(TEXT, "ofl", "reserved font name", "with reserved font name"),
    Rule(TEXT, "psf-2.0", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    Rule(TEXT, "cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights"),
    Rule(TEXT, "creative-commons", "creative commons", "this (?:work|article|text|document) is licensed under a creative commons"),
    Rule(TEXT, "gfdl", "invariant sections", "with no invariant sections(?: no front cover texts and no back cover texts)?"),
    Rule(TEXT, "sspl-1.0", "making the functionality", "making the functionality of the program or modified version available to third parties as a service"),
    Rule(TEXT, "commons-clause", "right to sell", "does not include the right to sell the software"),
    Rule(TEXT, "proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)"),
    Rule(TEXT, "proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution)(?: [^ ]+){0,8} (?:is )?(?:strictly )?prohibited"),
    Rule(TEXT, "proprietary", "no part of this", "no part of this (?:publication|book|work|document) may be reproduced"),
    Rule(TEXT, "proprietary", "trade secret", "contains? (?:[^ ]+ ){0,4}trade secrets?"),
    Rule(TEXT, "non-commercial", "commercial", "for (?:personal and )?non(?: )?commercial (?:use|purposes) only"),
    Rule(TEXT, "non-commercial", "commercial", "not for commercial (?:use|purposes|redistribution)"),
    Rule(TEXT, "no-derivatives", "you may not modify", "you may not modify"),
    Rule(TEXT, "no-derivatives", "derivative works", "you may not create derivative works"),
    Rule(TEXT, "eula", "end user licen", f"end user {LICENSE} agreement"),
    Rule(TEXT, "terms-of-use", "terms of", "(?:by using this (?:site|website|service) you agree to|subject to) (?:the |our |these )?terms of (?:use|service)"),
    Rule(TEXT, "no-ai-training", "machine learning", "(?:may|shall|must) not be used (?:for|to train) (?:the training of )?machine learning"),
    Rule(TEXT, "no-ai-training", "artificial intelligence", "(?:may|shall|must) not be used (?:for|to train) (?:the training of )?artificial intelligence"),
    Rule(LINK, "mit", "opensource org", "opensource org licenses mit(?: license)?"),
    Rule(LINK, "bsd", "opensource org", "opensource org licenses bsd(?: [234] clause| license)?"),
    Rule(LINK, "isc", "opensource org", "opensource org licenses isc"),
    Rule(LINK, "apache-2.0", "apache org licenses", "apache org licenses license 2 0"),
    Rule(LINK, "apache", "apache org licenses", "apache org licenses"),
    Rule(LINK, "gpl-2.0", "gnu org licenses", "gnu org licenses (?:old licenses )?gpl 2 0"),
    Rule(LINK, "gpl-3.0", "gnu org licenses", "gnu org licenses gpl 3 0"),
    Rule(LINK, "lgpl", "gnu org licenses", "gnu org licenses (?:old licenses )?lgpl"),
    Rule(LINK, "agpl-3.0", "gnu org licenses", "gnu org licenses agpl 3 0"),
    Rule(LINK, "gfdl", "gnu org licenses", "gnu org licenses fdl"),
    Rule(LINK, "gpl", "gnu org licenses", "gnu org licenses(?: gpl)?"),
    Rule(LINK, "mpl-2.0", "mozilla org mpl", "mozilla org mpl 2 0"),
    Rule(LINK, "mpl", "mozilla org mpl", "mozilla org mpl"),
    Rule(LINK, "epl", "eclipse org legal", "eclipse org legal epl"),
    Rule(LINK, "cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    Rule(LINK, "cc-pdm", "creativecommons org", "creativecommons org publicdomain mark 1 0"),
    Rule(LINK, "cc-by", "creativecommons org", "creativecommons org licenses by(?: [1234] [05])?"),
    Rule(LINK, "cc-by-sa", "creativecommons org", "creativecommons org licenses by sa(?: [1234] [05])?"),
    Rule(LINK, "cc-by-nd", "creativecommons org", "creativecommons org licenses by nd(?: [1234] [05])?"),
    Rule(LINK, "cc-by-nc", "creativecommons org", "creativecommons org licenses by nc(?: [1234] [05])?"),
    Rule(LINK, "cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa(?: [1234] [05])?"),
    Rule(LINK, "cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd(?: [1234] [05])?"),
    Rule(LINK, "bsl-1.0", "boost org", "boost org license 1 0"),
    Rule(LINK, "ofl", "scripts sil org", "scripts sil org ofl"),
    Rule(LINK, "odbl", "opendatacommons org", "opendatacommons org licenses odbl"),
    Rule(CLUE, "copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
    Rule(CLUE, "copyright", "copyright", "copyright ©(?: (?:19|20)[0-9]{2})?"),
    Rule(CLUE, "copyright", "copyright", "copyright (?:owned|held) by"),
    Rule(CLUE, "copyright", "©", "© (?:copyright )?(?:19|20)[0-9]{2}"),
    Rule(CLUE, "all-rights-reserved", "all rights", "all rights (?:are )?reserved"),
    Rule(CLUE, "some-rights-reserved", "rights reserved", "some rights reserved"),
    Rule(CLUE, "no-rights-reserved", "rights reserved", "no rights reserved"),
    Rule(CLUE, "reprinted", "permission", "(?:reprinted|reproduced|used) (?:with|by) permission"),
    Rule(CLUE, "license-reference", "licen", f"see (?:the )?{LICENSE}(?: file)?(?: txt| md)? for (?:details|more information)"),
    Rule(CLUE, "license-reference", "licen", f"{LICENSE} terms and conditions"),
)

_UNDER = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed|redistributed) (?:under|by)(?: the terms of)?(?: the| an| a)?"


def rules() -> list[Rule]:
    """All rules in their order."""
    of_names = []
    for label, keyword, identifier, name in LICENSES:
        of_names += [
            Rule(TAG, label, "spdx licen", f"spdx license identifier {identifier}"),
            Rule(GRANT, label, keyword, f"{_UNDER} {name}"),
            Rule(TITLE, label, keyword, name),
        ]
    for label, code, name in CREATIVE_COMMONS:
        version = "(?:(?: v)? (?:1 0|2 0|2 5|3 0|4 0))"
        of_names += [
            Rule(TAG, label, "spdx licen", f"spdx license identifier cc {code}{version}"),
            Rule(GRANT, label, "cc by", f"{_UNDER} cc {code}{version}?"),
            Rule(TITLE, label, "cc by", f"cc {code}{version}?"),
            Rule(GRANT, label, "creative commons", f"{_UNDER} creative commons {name}{version}?"),
            Rule(TITLE, label, "creative commons", f"creative commons {name}{version}?(?: international| unported)?(?: {LICENSE})?"),
        ]
    return sorted([*of_names, *SINGLE], key=lambda rule: rule.priority)


def gates() -> dict[str, list[str]]:
    """The keywords by what a text must hold for any of them to matter: a stem, or the keyword."""
    named: dict[str, list[Rule]] = {}
    for rule in rules():
        named.setdefault(rule.keyword, []).append(rule)
    found: dict[str, list[str]] = {}
    for keyword in [*(phrase for phrase, _ in BASE), *named]:
        stem = next((s for s in STEMS if s in keyword), keyword)
        if stem == keyword and all(_always(rule.pattern, STEMS[0]) for rule in named.get(keyword, [])):
            stem = STEMS[0]
        if keyword not in found.setdefault(stem, []):
            found[stem].append(keyword)
    return found


def _always(pattern: str, part: str) -> bool:
    """Whether every match has the part, by what is left of the pattern without optional groups."""
    rest = re.sub(r"\(\?:[^()]*\)\?", "", pattern)
    return part in rest if rest == pattern else _always(rest, part)
