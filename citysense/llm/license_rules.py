"""The ordered signature rules of the license scan (operator 11).

Rules are regular expressions over normalised text: lower-case words (runs of
ASCII letters, digits and all beyond ASCII) with one blank between them, so
``CC BY-NC 4.0`` reads ``cc by nc 4 0``. A rule may not span more than
``LONGEST`` words; every repetition is bounded.

Each family of licenses gives its names, short forms, identifiers and addresses;
``FORMS`` says how these stand in a text and with what priority and confidence.
``SENTENCES`` are sentences of the licenses' own texts. A rule is tried only
where one of its ``anchors`` and one word of each of its ``needs`` occur.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

LONGEST = 48

LICENSE = ("license", "licence", "licenses", "licences", "licensed", "licenced")
_L = "licen[cs]e"


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    kind: str
    priority: int
    confidence: float
    pattern: str
    anchors: tuple[str, ...]
    needs: tuple[tuple[str, ...], ...] = ()
    base: bool = False

    @property
    def regex(self) -> re.Pattern:
        return _compiled(self.pattern)


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])")


@dataclass(frozen=True)
class Family:
    """Patterns of one license; ``words``: one of them is in every name, short form, identifier and address."""

    label: str
    words: tuple[str, ...]
    name: str = ""
    short: str = ""
    spdx: str = ""
    url: str = ""


def _version(number: str) -> str:
    """``3``, ``3 0``, ``v3``, ``v 3 0``, ``version 3``; other minor versions written out."""
    major, _, minor = number.partition(" ")
    tail = f" {minor}" if minor and minor != "0" else "(?: 0)?"
    return f"(?:version |v |v)?{major}{tail}"


def _gnu(title: str, letters: str, word: str) -> list[Family]:
    out = []
    for label, number in [(f"{letters}-{x}", x) for x in {"gpl": ("1", "2", "3"), "lgpl": ("2", "2.1", "3"), "agpl": ("1", "3"), "gfdl": ("1.1", "1.2", "1.3")}[letters]]:
        major, _, minor = number.partition(".")
        tail = f" {minor}" if minor else "(?: 0)?(?! 1)"
        at = f"(?: {_L})?(?: \\({letters}\\))?(?: {letters})? (?:as published by the free software foundation (?:either )?)?(?:version |v |v)?{major}{tail}"
        out.append(Family(label, (word, letters, f"{letters}v{major}"), name=f"(?:gnu )?{title}{at}(?: of the {_L})?(?: or (?:at your option )?(?:any )?later(?: version)?)?",
                          short=f"(?:gnu )?(?:{letters} (?:version |v |v)?{major}{tail}|{letters}v{major}{tail})(?: or later| only|\\+)?",
                          spdx=f"{letters} {major}(?: {minor or 0})?(?: only| or later)?",
                          url=f"gnu org licenses (?:old licenses )?{letters} (?:v)?{major}(?: {minor or 0})?(?: en)?(?: html| txt)?"))
    out.append(Family(letters, (word, letters), name=f"(?:gnu )?{title}(?: {_L})?", short=f"gnu {letters}|{letters} {_L}|{letters}ed", spdx=letters, url=f"gnu org licenses {letters}(?: html| txt)?"))
    return out


def _creative() -> list[Family]:
    kinds = [("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
             ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by-sa", "attribution share ?alike"), ("by", "attribution")]
    out = []
    for kind, title in kinds:
        letters = kind.replace("-", " ")
        more = "(?! (?:nc|nd|sa))" if kind in ("by", "by-nc") else ""
        longer = "(?! (?:non ?commercial|no ?deriv|share ?alike))" if kind in ("by", "by-nc") else ""
        version = "(?: (?:version |v |v)?[1-4](?: [0-9])?)?"
        out.append(Family(f"cc-{kind}", ("cc", "creative", "creativecommons"),
                          name=f"creative commons(?: (?:{_L}|public|the|by))? ?{title}{longer}{version}(?: (?:international|unported|generic))?(?: public)?(?: {_L})?",
                          short=f"cc {letters}{more}{version}(?: (?:international|unported|generic))?", spdx=f"cc {letters}{more} [1-4] [0-9]",
                          url=f"creativecommons org licenses {letters}{more}(?: [1-4] [0-9])?(?: (?:deed|legalcode))?"))
    out.append(Family("cc0", ("cc0", "creative", "creativecommons"), name="creative commons (?:zero|cc0)(?: (?:v )?1 0)?(?: universal)?(?: public domain dedication)?",
                      short="cc0(?: 1 0)?(?: universal)?", spdx="cc0 1 0", url="creativecommons org publicdomain zero(?: 1 0)?"))
    out.append(Family("cc-pdm", ("creative", "creativecommons"), name="creative commons public domain mark(?: 1 0)?", url="creativecommons org publicdomain mark(?: 1 0)?"))
    return out


def _numbered(label: str, words: tuple[str, ...], title: str, letters: str, numbers: tuple[str, ...], url: str = "") -> list[Family]:
    """A license with numbered versions, and without a number."""
    out = []
    for number in numbers:
        spoken = number.replace(".", " ")
        out.append(Family(f"{label}-{number}", words, name=f"{title}(?: {_L})?(?: \\(?{letters}\\)?)? {_version(spoken)}", short=f"{letters} {_version(spoken)}",
                          spdx=f"{letters} {spoken}", url=f"{url} {spoken}" if url else f"opensource org licenses {letters} {spoken}"))
    out.append(Family(label, words, name=f"{title} {_L}", short=f"{letters} {_L}", url=url or f"opensource org licenses {letters}"))
    return out


FAMILIES: list[Family] = [
    *_gnu("affero general public", "agpl", "affero"),
    *_gnu("(?:lesser|library) general public", "lgpl", "lesser"),
    *_gnu("(?<!affero )(?<!lesser )(?<!library )general public", "gpl", "general"),
    *_gnu("free documentation", "gfdl", "documentation"),
    *_creative(),
    Family("mit", ("mit", "expat"), name=f"(?:mit|expat)(?: x11)? (?:style )?(?:open source )?(?:software )?{_L}", short="mit licen[cs]ed", spdx="mit", url="opensource org licenses mit(?: license)?(?: php)?"),
    Family("mit-0", ("mit",), name=f"mit no attribution {_L}", spdx="mit 0", url="opensource org licenses mit 0"),
    Family("x11", ("x11",), name=f"x11 {_L}|x consortium {_L}", spdx="x11"),
    Family("apache-2", ("apache", "apache2"), name=f"apache(?: software)? {_L} (?:version |v |v)?2(?: 0)?|apache(?: software foundation)? (?:version |v |v)?2(?: 0)? {_L}",
           short="apache (?:v |v)?2(?: 0)?|apache2|asl 2 0", spdx="apache 2 0", url="apache org licenses license 2 0(?: txt| html)?|opensource org licenses apache 2 0"),
    Family("apache-1.1", ("apache",), name=f"apache(?: software)? {_L} (?:version |v |v)?1 1", spdx="apache 1 1", url="apache org licenses license 1 1"),
    Family("apache-1.0", ("apache",), name=f"apache(?: software)? {_L} (?:version |v |v)?1 0", spdx="apache 1 0", url="apache org licenses license 1 0"),
    Family("apache", ("apache",), name=f"apache(?: software)?(?: foundation)? {_L}", short="apache licen[cs]ed"),
    Family("bsd-2-clause", ("bsd", "freebsd"), name=f"(?:2|two) clause (?:simplified )?bsd(?: {_L})?|(?:simplified|freebsd) (?:bsd )?{_L}|bsd (?:2|two) clause(?: simplified)?(?: {_L})?", spdx="bsd 2 clause",
           url="opensource org licenses bsd 2 clause"),
    Family("bsd-3-clause", ("bsd",), name=f"(?:3|three) clause (?:new |modified |revised )?bsd(?: {_L})?|(?:new|modified|revised) bsd(?: {_L})?|bsd (?:3|three) clause(?: new| revised)?(?: {_L})?", spdx="bsd 3 clause",
           url="opensource org licenses bsd 3 clause"),
    Family("bsd-4-clause", ("bsd",), name=f"(?:4|four) clause (?:original |old )?bsd(?: {_L})?|(?:original|old) bsd {_L}|bsd (?:4|four) clause(?: {_L})?", spdx="bsd 4 clause"),
    Family("0bsd", ("0bsd", "bsd"), name=f"(?:0|zero) clause bsd(?: {_L})?|bsd (?:0|zero) clause(?: {_L})?", spdx="0bsd", url="opensource org licenses 0bsd"),
    Family("bsd", ("bsd", "berkeley"), name=f"bsd (?:style )?{_L}|berkeley software distribution {_L}", short="bsd licen[cs]ed", url="opensource org licenses bsd(?: license)?"),
    Family("isc", ("isc", "internet"), name=f"isc {_L}|internet systems consortium {_L}", spdx="isc", url="opensource org licenses isc"),
    *_numbered("mpl", ("mozilla", "mpl"), "mozilla public", "mpl", ("1.0", "1.1", "2.0"), "mozilla org mpl"),
    *_numbered("epl", ("eclipse", "epl"), "eclipse public", "epl", ("1.0", "2.0"), "eclipse org legal epl"),
    *_numbered("edl", ("eclipse", "edl"), "eclipse distribution", "edl", ("1.0",)),
    *_numbered("cddl", ("cddl", "distribution"), "common development and distribution", "cddl", ("1.0", "1.1")),
    *_numbered("cpl", ("cpl", "common"), "common public", "cpl", ("1.0",)),
    *_numbered("eupl", ("eupl", "european"), "european union public", "eupl", ("1.0", "1.1", "1.2")),
    *_numbered("artistic", ("artistic",), "artistic", "artistic", ("1.0", "2.0")),
    *_numbered("osl", ("osl",), "open software", "osl", ("1.0", "2.1", "3.0")),
    *_numbered("afl", ("afl", "academic"), "academic free", "afl", ("2.1", "3.0")),
    *_numbered("bsl", ("boost",), "boost software", "boost", ("1.0",), "boost org license"),
    *_numbered("busl", ("busl", "business"), "business source", "busl", ("1.1",)),
    *_numbered("sspl", ("sspl", "server"), "server side public", "sspl", ("1",)),
    *_numbered("cecill", ("cecill",), "cecill(?: free software)?", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    *_numbered("lppl", ("lppl", "latex"), "latex project public", "lppl", ("1.2", "1.3"), "latex project org lppl"),
    *_numbered("ofl", ("ofl", "sil"), "sil open font", "ofl", ("1.0", "1.1"), "scripts sil org ofl"),
    *_numbered("zpl", ("zpl", "zope"), "zope public", "zpl", ("1.1", "2.0", "2.1")),
    *_numbered("upl", ("upl", "universal"), "universal permissive", "upl", ("1.0",)),
    *_numbered("python", ("python", "psf"), "(?:python software foundation|psf)", "psf", ("2", "2.0")),
    *_numbered("php", ("php",), "php", "php", ("3.0", "3.01")),
    *_numbered("ecl", ("ecl", "educational"), "educational community", "ecl", ("1.0", "2.0")),
    *_numbered("apsl", ("apsl", "apple"), "apple public source", "apsl", ("1.1", "2.0")),
    *_numbered("ms-pl", ("microsoft",), "microsoft public", "ms pl", ("1.0",)),
    *_numbered("ms-rl", ("microsoft",), "microsoft reciprocal", "ms rl", ("1.0",)),
    *_numbered("ncsa", ("ncsa", "illinois"), "(?:university of illinois )?ncsa open source", "ncsa", ("1.0",)),
    *_numbered("qpl", ("qpl", "qt"), "(?:q|qt) public", "qpl", ("1.0",)),
    *_numbered("rpl", ("rpl", "reciprocal"), "reciprocal public", "rpl", ("1.1", "1.5")),
    *_numbered("vim", ("vim",), "vim", "vim", ("1.0",)),
    *_numbered("w3c", ("w3c",), "w3c software(?: notice and)?", "w3c", ("1.0",), "w3 org consortium legal copyright software"),
    *_numbered("odbl", ("odbl", "database"), "open (?:data commons )?(?:open )?database", "odbl", ("1.0",), "opendatacommons org licenses odbl"),
    *_numbered("odc-by", ("odc", "opendatacommons"), "open data commons attribution", "odc by", ("1.0",), "opendatacommons org licenses by"),
    *_numbered("pddl", ("pddl", "opendatacommons"), "open data commons public domain dedication(?: and)?", "pddl", ("1.0",), "opendatacommons org licenses pddl"),
    *_numbered("cdla-permissive", ("cdla", "community"), "community data(?: agreement)? permissive", "cdla permissive", ("1.0", "2.0")),
    *_numbered("ogl-uk", ("ogl", "government"), "open government", "ogl", ("1.0", "2.0", "3.0"), "nationalarchives gov uk doc open government licence version"),
    *_numbered("openrail", ("openrail", "rail"), "(?:creativeml )?open ?rail(?: [m]{1,2})?", "openrail", ("1.0",)),
    *_numbered("llama", ("llama",), "(?:meta )?llama (?:2 |3 |3 1 )?community", "llama", ("2", "3")),
    *_numbered("mulan", ("mulan",), "mulan permissive software", "mulanpsl", ("1", "2")),
    *_numbered("nasa", ("nasa",), "nasa open source agreement", "nasa", ("1.3",)),
    *_numbered("ipl", ("ipl", "ibm"), "ibm public", "ipl", ("1.0",)),
    *_numbered("watcom", ("watcom",), "sybase open watcom public", "watcom", ("1.0",)),
    *_numbered("naumen", ("naumen",), "naumen public", "naumen", ("1.1",)),
    *_numbered("parity", ("parity",), "parity public", "parity", ("6.0", "7.0")),
    *_numbered("polyform", ("polyform",), "polyform (?:noncommercial|small business|strict|shield|perimeter|internal use)", "polyform", ("1.0",)),
    *_numbered("elastic", ("elastic",), "elastic", "elastic", ("2.0",)),
    Family("unlicense", ("unlicense",), name=f"the unlicense|unlicense {_L}", short="unlicensed? public domain", spdx="unlicense", url="unlicense org"),
    Family("wtfpl", ("wtfpl",), name="do what the fuck you want to public license", short="wtfpl(?: 2 0| v2)?", spdx="wtfpl", url="wtfpl net"),
    Family("zlib", ("zlib", "libpng"), name=f"zlib(?: libpng)? {_L}|libpng {_L}", short="zlib licen[cs]ed", spdx="zlib", url="opensource org licenses zlib"),
    Family("openssl", ("openssl", "ssleay"), name=f"openssl(?: ssleay)? {_L}|ssleay {_L}", spdx="openssl", url="openssl org source license"),
    Family("postgresql", ("postgresql",), name=f"postgresql {_L}", spdx="postgresql", url="opensource org licenses postgresql"),
    Family("beerware", ("beer", "beerware"), name=f"beer ?ware {_L}|the beer ?ware license", spdx="beerware"),
    Family("json", ("json",), name=f"json {_L}", spdx="json", url="json org license"),
    Family("unicode", ("unicode",), name=f"unicode (?:data files and software )?{_L}(?: v3)?", spdx="unicode (?:3 0|dfs 2016)", url="unicode org (?:copyright|license)"),
    Family("ruby", ("ruby",), name=f"ruby (?:s )?{_L}", spdx="ruby"),
    Family("perl", ("perl",), name="same terms as perl(?: itself)?|perl (?:5 )?artistic license", spdx="artistic 1 0 perl"),
    Family("tcl", ("tcl",), name=f"tcl tk {_L}|tcl {_L}", spdx="tcl"),
    Family("hpnd", ("historical",), name="historical permission notice and disclaimer", spdx="hpnd"),
    Family("public-domain", ("domain",), name="(?:in|into|to) the public domain|public domain (?:work|dedication|software)|dedicated to the public domain"),
    Family("proprietary", ("proprietary", "confidential"), name="proprietary and confidential|confidential and proprietary|proprietary licen[cs]e"),
]

_GRANT = "(?:re)?(?:licen[cs]ed|released|distributed|published|available|provided|shared|offered|issued|covered|used|copied|modified)"
_UNDER = "(?: only| freely| here)? (?:under|by|per|according to|subject to|in accordance with)(?: (?:the|a|an))?(?: (?:terms|conditions|provisions))?(?: and conditions)?(?: of)?(?: (?:the|a|an))?"
#: (form, field of the family, template, priority, confidence)
FORMS = [
    ("tag", "spdx", "spdx license identifier (?:{0})", 90, 0.98),
    ("url", "url", "(?:https? )?(?:www )?(?:{0})", 80, 0.9),
    ("notice", "name", f"{_GRANT}{_UNDER} (?:{{0}})", 70, 0.85),
    ("notice-short", "short", f"{_GRANT}{_UNDER} (?:{{0}})", 68, 0.8),
    ("name", "name", "(?:{0})", 50, 0.6),
    ("short", "short", "(?:{0})", 30, 0.4),
]

#: Sentences of the licenses' own texts: (label, pattern, anchors).
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copies",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution",)),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,15}?nor the names of its contributors may be used to endorse or promote products", ("endorse",)),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", ("advertising",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("compliance",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("unless",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("redistribute",)),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
              " as published by the free software foundation either version 2(?: 0)? of the license", ("redistribute",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
              " as published by the free software foundation either version 3(?: 0)? of the license", ("redistribute",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", ("redistribute",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", ("affero",)),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|software|file)", ("received",)),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this (?:library|program|software)", ("received",)),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", ("received",)),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("permission",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla",)),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", ("mozilla",)),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", ("eclipse",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse",)),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("development",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", ("anyone",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("warranty",)),
    ("zlib", "altered source versions must be plainly marked as such", ("altered",)),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ("organization",)),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", ("verbatim",)),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", ("retain",)),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", ("openssl",)),
    ("apache-1.1", "this product includes software developed by the apache software foundation", ("apache",)),
    ("ofl", "this font software is licensed under the sil open font license", ("font",)),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("permission",)),
    ("json", "the software shall be used for good not evil", ("evil",)),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format", ("redistribute",)),
    ("cc-by-nc", "you may not use (?:the|this) (?:material|work) for commercial purposes", ("commercial",)),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", ("remix",)),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license", ("remix",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ("deed",)),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", ("licensor",)),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service", ("functionality",)),
    ("python", "psf is making python available to licensee on an as is basis", ("psf",)),
    ("proprietary", "unauthori[sz]ed copying of this file via any medium is strictly prohibited", ("prohibited",)),
    ("proprietary", "no part of this (?:publication|work|book|document) may be reproduced (?:distributed )?(?:or )?(?:stored|transmitted|copied)?", ("reproduced",)),
    ("proprietary", "(?:redistribution|reproduction|copying) (?:in whole or in part )?(?:without (?:prior )?(?:written )?permission )?is (?:strictly )?(?:prohibited|forbidden)", ("prohibited", "forbidden")),
    ("odbl", "this (?:[^ ]+ ){1,8}?database is made available under the open database license", ("database",)),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
             " the software to deal with the software without restriction", ("permission",)),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", ("permission",)),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", ("governs",)),
    ("artistic", "this package is free software you can redistribute it and or modify it under the terms of the artistic license", ("artistic",)),
    ("perl", "this (?:library|module|program) is free software you can redistribute it and or modify it under the same terms as perl", ("perl",)),
    ("cc-by-nc", "for non ?commercial use only|non ?commercial use only", ("commercial", "noncommercial")),
    ("attribution-required", "(?:attribution|credit) (?:is )?required", ("attribution", "credit")),
    ("all-rights-reserved", "all rights reserved", ("reserved",)),
]

#: Phrases of the contract: (label, phrase, anchor). Their places always stay.
PHRASES = [("mit", "under the mit license", "license"), ("apache-2", "apache license version 2", "license"), ("cc-by-nc", "cc by nc", "cc")]


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at the bars outside of all brackets."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _gates(form: str, family: Family, pattern: str) -> tuple[tuple[str, ...], tuple[tuple[str, ...], ...]]:
    """Anchors, and further words that are needed. Addresses are anchored by their first word, names that
    always have the word license by that, and others by the family's own words."""
    if form == "url":
        return tuple(sorted({x.split(" ")[0] for x in _alternatives(pattern)})), ()
    if form == "tag":
        return ("spdx",), (family.words,)
    if all(re.search("licen", x) and "(?: licen" not in x for x in _alternatives(pattern)):
        return LICENSE, (family.words,)
    return family.words, ()


def _rules() -> list[Rule]:
    out = [Rule(f"phrase/{p}", label, "phrase", 60, 0.7, p, (a,), (), True) for label, p, a in PHRASES]
    for n, (label, pattern, anchors) in enumerate(SENTENCES):
        weak = len(pattern.split()) < 8
        out.append(Rule(f"text/{n}/{label}", label, "text", 40 if weak else 100, 0.5 if weak else 0.99, pattern, anchors))
    for form, part, template, priority, confidence in FORMS:
        for f in FAMILIES:
            pattern = getattr(f, part)
            if pattern:
                out.append(Rule(f"{form}/{f.label}", f.label, form, priority, confidence, template.format(pattern), *_gates(form, f, pattern)))
    return out


RULES: list[Rule] = _rules()
