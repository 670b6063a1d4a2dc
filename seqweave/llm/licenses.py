"""License scans by ordered signature rules.

Rules are regular expressions over normalised text (lower case, words with one blank between, a plus after a digit kept).
Each has keywords of which one must be there before it runs, a priority and a label. Overlapping places are resolved in the
order of priority (then the longer, then the earlier): a place stays unless it lies in, holds or crosses one that stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper-case ASCII is made lower case; ASCII other than digits and letters becomes a blank.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in bytes(range(256)).lower())
_KEPT = bytes(1 if c == 1 else w for c, w in enumerate(_WORDS))
_PLUS = re.compile(rb"(?<=[0-9])\+")

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


#: Notices and typical clauses: label, priority, keywords, pattern.
NOTICES = (
    # Apache
    ("apache-2.0", 96, "apache license", r"licensed under the apache license version 2 0 the license you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2.0", 88, "apache org", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", 60, "without warranties or conditions", r"distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-1.1", 86, "apache software foundation", r"this product includes software developed by the apache software foundation"),
    # GNU
    ("gpl-any", 66, "free software", r"this program is free software you can redistribute it and or modify it"),
    ("gpl-2.0-or-later", 96, "either version 2", r"under the terms of the gnu general public license as published by the free software foundation either version 2(?: 0)? of the license or at your option any later version"),
    ("gpl-3.0-or-later", 96, "either version 3", r"under the terms of the gnu general public license as published by the free software foundation either version 3(?: 0)? of the license or at your option any later version"),
    ("gpl-2.0-only", 96, "version 2", r"under the terms of the gnu general public license version 2(?: 0)? (?:only )?as published by the free software foundation"),
    ("gpl-3.0-only", 96, "version 3", r"under the terms of the gnu general public license version 3(?: 0)? (?:only )?as published by the free software foundation"),
    ("lgpl-2.1-or-later", 96, "version 2 1", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", 96, "version 3", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: 0)? of the license or at your option any later version"),
    ("lgpl-2.0-or-later", 96, "library general public", r"under the terms of the gnu library general public license as published by the free software foundation either version 2(?: 0)? of the license or at your option any later version"),
    ("agpl-3.0-or-later", 96, "affero", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3(?: 0)? of the license or at your option any later version"),
    ("gpl-any", 58, "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses(?: gpl(?: html| txt)?)?"),
    ("gpl-2.0-only", 82, "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses old licenses gpl 2 0(?: html| txt)?"),
    ("lgpl-any", 82, "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses lgpl(?: html| txt)?"),
    ("agpl-3.0-any", 82, "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gfdl-any", 82, "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses fdl(?: html| txt)?"),
    ("gfdl-any", 84, "document under the terms", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-any", 57, "write to the free software foundation", r"write to the free software foundation inc"),
    ("gpl-classpath-exception", 90, "classpath|combined work", r"(?:gnu )?classpath exception|linking this library statically or dynamically with other modules is making a combined work"),
    ("gcc-exception", 90, "gcc runtime library exception", r"gcc runtime library exception(?: version 3 1)?"),
    ("autoconf-exception", 88, "configuration script generated by autoconf", r"contains a configuration script generated by autoconf"),
    ("bison-exception", 88, "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    # BSD clauses
    ("bsd-2-clause", 90, "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", 89, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 91, "endorse or promote", r"neither the names? of .{1,80}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", 90, "endorse or promote", r"the names? of (?:the author|the contributors|.{1,60}?) may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 92, "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-any", 62, "provided by the copyright holders", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-any", 62, "regents and contributors", r"this software is provided by the regents and contributors as is"),
    ("bsd-3-clause-clear", 93, "patent rights", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-any", 60, "bsd style", r"(?:governed by|under) a bsd style license(?: that can be found in the license file)?"),
    # MIT and its kin
    ("mit", 90, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 84, "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", 70, "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 61, "without warranty of any kind", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 80, "opensource org", r"(?:https? )?(?:www )?opensource org licen[sc]es? mit(?: license)?(?: php| html)?"),
    ("mit-0", 92, "mit no attribution", r"mit no attribution(?: license)?"),
    ("isc", 86, "permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("hpnd", 85, "its documentation for any purpose", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("ntp", 84, "no representations about the suitability", r"makes no representations about the suitability (?:of )?this software for any purpose"),
    ("zlib", 86, "in no event will the authors", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 85, "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", 88, "prepare derivative works", r"to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("bsl-1.0", 88, "boost org", r"(?:https? )?(?:www )?boost org license 1 0 txt"),
    ("curl", 84, "curl license", r"curl license"),
    ("x11", 84, "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("unlicense", 88, "unlicense org", r"(?:https? )?unlicense org"),
    ("unlicense", 86, "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 86, "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("beerware", 85, "beer ware|beerware", r"the beer ?ware license(?: revision 42)?|beerware license"),
    ("bsd-0-clause", 87, "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("json", 86, "good not evil", r"the software shall be used for good not evil"),
    ("sleepycat", 85, "sleepycat", r"sleepycat (?:public )?licen[sc]e"),
    ("vim", 82, "vim license", r"vim license"),
    ("tcl", 82, "tcl", r"tcl tk license"),
    ("libpng", 84, "libpng|png reference library", r"(?:the )?(?:png reference library|libpng) license(?: version 2)?"),
    ("ijg", 84, "independent jpeg group", r"based in part on the work of the independent jpeg group"),
    ("freetype", 84, "freetype", r"freetype (?:project )?license"),
    ("icu", 82, "icu license", r"icu license"),
    ("unicode", 84, "unicode inc", r"unicode inc license agreement data files and software"),
    ("w3c", 84, "w3c", r"w3c software (?:notice and|and document|and document notice and) license"),
    ("nasa-1.3", 84, "nasa open source", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("mulanpsl-2.0", 86, "mulan", r"mulan p(?:ermissive )?(?:software license|sl)(?: v| version )?2"),
    # Mozilla, Eclipse and others
    ("mpl-2.0", 96, "mozilla public", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0"),
    ("mpl-1.1", 96, "mozilla public", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 88, "mozilla org", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-any", 64, "mozilla org", r"(?:https? )?(?:www )?mozilla org mpl"),
    ("epl-1.0", 95, "eclipse public", r"made available under the terms of the eclipse public license v(?:ersion)? ?1 0 which accompanies this distribution"),
    ("epl-2.0", 95, "eclipse public", r"made available under the terms of the eclipse public license v(?:ersion)? ?2 0(?: which (?:accompanies this distribution|is available at))?"),
    ("epl-any", 64, "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl v10 html|(?:https? )?(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?"),
    ("cddl-1.0", 92, "common development and distribution", r"subject to the terms of the common development and distribution license(?: the license)?(?: you may not use this file except in compliance with the license)?"),
    ("cddl-any", 82, "cddl|opensolaris license", r"cddl(?: license)?|usr src opensolaris license"),
    ("edl-1.0", 86, "eclipse distribution", r"eclipse distribution license(?: v(?:ersion)? ?1 0)?"),
    ("cpal-1.0", 86, "common public attribution", r"common public attribution license(?: version)?(?: 1 0)?"),
    ("rpl-1.5", 86, "reciprocal public", r"reciprocal public license(?: version)?(?: 1 5)?"),
    ("sissl", 84, "sun industry standards", r"sun industry standards source license"),
    ("spl-1.0", 84, "sun public", r"sun public license(?: version)?(?: 1 0)?"),
    ("lpl-1.02", 84, "lucent public", r"lucent public license(?: version)?(?: 1 02)?"),
    ("watcom-1.0", 84, "watcom", r"sybase open watcom public license(?: version)?(?: 1 0)?"),
    ("intel", 82, "intel open source", r"intel open source license"),
    ("nokia", 82, "nokia open source", r"nokia open source license"),
    ("motosoto", 82, "motosoto", r"motosoto open source license"),
    ("ogtsl", 82, "open group test suite", r"open group test suite license"),
    ("eu-datagrid", 82, "datagrid", r"eu datagrid software license"),
    ("fair", 82, "fair license", r"fair license"),
    ("frameworx-1.0", 82, "frameworx", r"frameworx open license(?: 1 0)?"),
    ("hpl", 80, "historical permission notice", r"historical permission notice and disclaimer"),
    ("simpl-2.0", 82, "simple public", r"simple public license(?: 2 0)?"),
    ("ngpl", 82, "nethack", r"nethack general public license"),
    ("xnet", 82, "x net license", r"x net license"),
    ("vsl-1.0", 82, "vovida", r"vovida software license(?: 1 0)?"),
    ("oclc-2.0", 82, "oclc research", r"oclc research public license(?: 2 0)?"),
    ("entessa", 82, "entessa", r"entessa public license"),
    ("multics", 82, "multics", r"multics license"),
    ("naumen", 82, "naumen", r"naumen public license"),
    # Data, media and texts
    ("cc0-1.0", 92, "publicdomain zero", r"(?:https? )?creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", 90, "to the extent possible under law", r"to the extent possible under law .{1,120}? waived all copyright"),
    ("cc-pdm-1.0", 90, "publicdomain mark|public domain mark", r"(?:https? )?creativecommons org publicdomain mark 1 0|public domain mark 1 0"),
    ("cc-by-any", 62, "creative commons attribution", r"(?:licensed|available|released) under (?:a |the )?creative commons attribution(?: license)?"),
    ("cc-any", 52, "creative commons", r"(?:licensed|available|released) under (?:a |the )?creative commons(?: license)?"),
    ("cc-by-any", 63, "redistribute the material", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by-nc-any", 64, "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd-any", 64, "distribute the modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa-any", 64, "same license as the original", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("odbl-1.0", 88, "opendatacommons org|openstreetmap", r"(?:https? )?opendatacommons org licenses odbl(?: 1 0)?|openstreetmap contributors"),
    ("odc-by-1.0", 88, "opendatacommons org", r"(?:https? )?opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1.0", 88, "opendatacommons org", r"(?:https? )?opendatacommons org licenses pddl(?: 1 0)?"),
    ("ogl-uk", 86, "open government", r"open government licen[sc]e(?: v(?:ersion)? ?[123](?: 0)?)?"),
    ("etalab-2.0", 86, "licence ouverte|open licence", r"licence ouverte(?: open licence)?(?: (?:version )?2 0)?"),
    ("dl-de-by-2.0", 86, "datenlizenz", r"datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("cdla-permissive", 86, "community data license", r"community data license agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing", 86, "community data license", r"community data license agreement sharing(?: version)?(?: 1 0)?"),
    ("ofl-1.1", 90, "open font", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-any", 80, "scripts sil org", r"(?:https? )?scripts sil org ofl"),
    ("gutenberg", 84, "project gutenberg|this ebook is for", r"project gutenberg (?:tm )?license|this ebook is for the use of anyone anywhere"),
    # Models and source-available terms
    ("openrail", 84, "openrail|open rail", r"(?:creativeml |bigcode |bigscience )?open ?rail(?: m| \+\+ m)?(?: license)?"),
    ("busl-1.1", 88, "business source", r"business source license(?: version)?(?: 1 1)?"),
    ("sspl-1.0", 88, "server side public", r"server side public license(?: version)?(?: 1(?: 0)?)?"),
    ("elastic-2.0", 88, "elastic license", r"elastic license(?: version)?(?: 2 0)?"),
    ("commons-clause", 86, "commons clause", r"commons clause(?: license)?(?: condition)?"),
    ("polyform", 86, "polyform", r"polyform (?:noncommercial|strict|shield|perimeter|small business|free trial|internal use)(?: license)?(?: 1 0 0)?"),
    ("confluent", 84, "confluent community", r"confluent community license"),
    ("llama", 84, "community license agreement", r"llama (?:\d )*community license agreement"),
    ("gemma", 82, "gemma terms", r"gemma terms of use"),
    # Reservations and proprietary terms
    ("proprietary", 66, "trade secret|and proprietary|and confidential", r"contains? (?:confidential and proprietary|proprietary and confidential) information|trade secrets? of"),
    ("proprietary", 66, "prior written", r"(?:may not be|no part of this .{1,40}? may be) (?:reproduced|copied|distributed).{0,80}? without (?:the )?(?:express )?prior written (?:permission|consent)"),
    ("proprietary", 64, "end user licen", r"end user licen[sc]e agreement"),
    ("proprietary", 62, "personal use only|internal use only", r"for (?:personal|internal) use only"),
    ("noncommercial", 60, "commercial use|commercial purposes", r"for non ?commercial (?:use|purposes) only|not for commercial use|no commercial use"),
    ("noncommercial", 60, "research purposes|research use", r"for (?:academic |scientific )?research (?:purposes|use) only"),
    ("reserved", 42, "some rights reserved", r"some rights reserved"),
    ("reserved", 40, "tutti i diritti", r"tutti i diritti (?:sono )?riservati"),
    ("reserved", 40, "todos os direitos", r"todos os direitos reservados"),
    ("reserved", 40, "alle rechten", r"alle rechten voorbehouden"),
    ("reserved", 40, "wszelkie prawa", r"wszelkie prawa zastrzeżone"),
    ("reserved", 40, "все права", r"все права защищены"),
    ("reserved", 40, "rättigheter", r"alla rättigheter förbehållna"),
    ("public-domain", 64, "public domain", r"(?:this (?:work|file|code|software) is|has been) (?:hereby )?(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 62, "government work", r"(?:u s|united states) government works?(?: not subject to copyright)?"),
)

#: Identifiers as declarations give them, normalised.
SPDX = (
    ("gpl-1.0-only", r"gpl 1 0(?: only)?"), ("gpl-1.0-or-later", r"gpl 1 0(?:\+| or later)"), ("gpl-2.0-only", r"gpl 2 0(?: only)?"), ("gpl-2.0-or-later", r"gpl 2 0(?:\+| or later)"), ("gpl-3.0-only", r"gpl 3 0(?: only)?"), ("gpl-3.0-or-later", r"gpl 3 0(?:\+| or later)"),
    ("lgpl-2.0-only", r"lgpl 2 0(?: only)?"), ("lgpl-2.0-or-later", r"lgpl 2 0(?:\+| or later)"), ("lgpl-2.1-only", r"lgpl 2 1(?: only)?"), ("lgpl-2.1-or-later", r"lgpl 2 1(?:\+| or later)"), ("lgpl-3.0-only", r"lgpl 3 0(?: only)?"), ("lgpl-3.0-or-later", r"lgpl 3 0(?:\+| or later)"),
    ("agpl-3.0-only", r"agpl 3 0(?: only)?"), ("agpl-3.0-or-later", r"agpl 3 0(?:\+| or later)"), ("gfdl-1.3-only", r"gfdl 1 3(?: only)?"), ("gfdl-1.3-or-later", r"gfdl 1 3(?:\+| or later)"),
    ("apache-2.0", r"apache 2 0"), ("apache-1.1", r"apache 1 1"), ("mit", r"mit"), ("mit-0", r"mit 0"), ("x11", r"x11"), ("isc", r"isc"), ("zlib", r"zlib"), ("bsl-1.0", r"bsl 1 0"), ("unlicense", r"unlicense"), ("wtfpl", r"wtfpl"), ("curl", r"curl"), ("ncsa", r"ncsa"), ("postgresql", r"postgresql"),
    ("bsd-0-clause", r"0bsd"), ("bsd-2-clause", r"bsd 2 clause"), ("bsd-3-clause", r"bsd 3 clause"), ("bsd-4-clause", r"bsd 4 clause"), ("mpl-1.1", r"mpl 1 1"), ("mpl-2.0", r"mpl 2 0"), ("epl-1.0", r"epl 1 0"), ("epl-2.0", r"epl 2 0"), ("cddl-1.0", r"cddl 1 0"), ("cddl-1.1", r"cddl 1 1"),
    ("eupl-1.1", r"eupl 1 1"), ("eupl-1.2", r"eupl 1 2"), ("artistic-2.0", r"artistic 2 0"), ("afl-3.0", r"afl 3 0"), ("osl-3.0", r"osl 3 0"), ("ms-pl", r"ms pl"), ("ms-rl", r"ms rl"), ("ofl-1.1", r"ofl 1 1"), ("upl-1.0", r"upl 1 0"), ("cc0-1.0", r"cc0 1 0"),
    ("cc-by-3.0", r"cc by 3 0"), ("cc-by-4.0", r"cc by 4 0"), ("cc-by-sa-3.0", r"cc by sa 3 0"), ("cc-by-sa-4.0", r"cc by sa 4 0"), ("cc-by-nc-4.0", r"cc by nc 4 0"), ("cc-by-nd-4.0", r"cc by nd 4 0"), ("cc-by-nc-sa-4.0", r"cc by nc sa 4 0"), ("cc-by-nc-nd-4.0", r"cc by nc nd 4 0"),
    ("odbl-1.0", r"odbl 1 0"), ("blueoak-1.0", r"blueoak 1 0 0"), ("busl-1.1", r"busl 1 1"), ("sspl-1.0", r"sspl 1 0"), ("elastic-2.0", r"elastic 2 0"), ("cecill-2.1", r"cecill 2 1"), ("python-2.0", r"python 2 0"), ("php-3.01", r"php 3 01"), ("proprietary", r"licenseref proprietary"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    #: The keywords aren't in the match but must be somewhere in the text.
    elsewhere: bool = False


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first. Families of licences are written once and filled with versions and variants."""
    out: list[Rule] = []

    def add(label: str, pattern: str, keywords: str, priority: int, elsewhere: bool = False) -> None:
        out.append(Rule(label, pattern, tuple(keywords.split("|")), priority, elsewhere))

    or_later = r"(?: or (?:\(?at your option\)? )?(?:any )?(?:later|newer)(?: versions?)?)"

    def number(version: str) -> str:
        """2.1 as "2 1"; 2.0 as "2", with or without "0"."""
        return f"{version[:-2]}(?: 0)?" if version.endswith(".0") else version.replace(".", " ")

    # The GNU family: title, abbreviation and identifier forms, each version, with and without later ones.
    for short, title, versions in (("gpl", "general public licen[sc]e", "1.0 2.0 3.0"), ("lgpl", "(?:lesser|library) general public licen[sc]e", "2.0 2.1 3.0"), ("agpl", "affero general public licen[sc]e", "1.0 3.0"), ("gfdl", "free documentation licen[sc]e", "1.1 1.2 1.3")):
        words = "public license|public licence" if short != "gfdl" else "documentation licen"
        for v in versions.split():
            n = number(v)
            add(f"{short}-{v}-or-later", rf"(?:gnu )?{title}(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?{n}{or_later}", words, 95)
            add(f"{short}-{v}-only", rf"(?:gnu )?{title}(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?{n}(?: only)?", words, 90)
            add(f"{short}-{v}-or-later", rf"(?:gnu )?{short} ?(?:v|version )? ?{n}(?:\+| or later|{or_later})", short, 85)
            add(f"{short}-{v}-only", rf"(?:gnu )?{short} ?(?:v|version )? ?{n}(?: only)?", short, 80)
        add(f"{short}-any", rf"gnu {title}", words, 50)
    # Creative Commons: elements by version, as title, abbreviation and deed address.
    names = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for parts in ("by-nc-sa", "by-nc-nd", "by-sa", "by-nd", "by-nc", "by"):
        spelled = " ".join(names[p] for p in parts.split("-"))
        spaced = parts.replace("-", " ")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            n = number(v)
            add(f"cc-{parts}-{v}", rf"cc {spaced} (?:v ?)?{n}", "cc by|cc-by", 90)
            add(f"cc-{parts}-{v}", rf"creative commons {spelled} {n}", "creative commons", 90)
            add(f"cc-{parts}-{v}", rf"creativecommons org licenses {spaced} {n}", "creativecommons", 92)
        add(f"cc-{parts}-any", rf"cc {spaced}", "cc by|cc-by", 60)
        add(f"cc-{parts}-any", rf"creative commons {spelled}(?: licen[sc]e)?", "creative commons", 60)
    add("cc0-1.0", r"cc ?0 (?:1 0 )?universal|cc0(?: 1 0)?", "cc0|cc 0", 80)
    # Families of one title with versions.
    for label, title, keyword, versions in (
        ("apache", "apache(?: software)? licen[sc]e", "apache", "1.0 1.1 2.0"), ("mpl", "mozilla public licen[sc]e", "mozilla", "1.0 1.1 2.0"), ("epl", "eclipse public licen[sc]e", "eclipse", "1.0 2.0"),
        ("cddl", "common development and distribution licen[sc]e", "common development", "1.0 1.1"), ("eupl", "european union public licen[sc]e", "european union", "1.0 1.1 1.2"), ("osl", "open software licen[sc]e", "open software", "1.0 2.0 2.1 3.0"),
        ("afl", "academic free licen[sc]e", "academic free", "1.1 1.2 2.0 2.1 3.0"), ("artistic", "artistic licen[sc]e", "artistic", "1.0 2.0"), ("bsl", "boost software licen[sc]e", "boost", "1.0"), ("zpl", "zope public licen[sc]e", "zope", "1.1 2.0 2.1"),
        ("ofl", "(?:sil )?open font licen[sc]e", "open font", "1.0 1.1"), ("odbl", "open database licen[sc]e", "open database", "1.0"), ("odc-by", "open data commons attribution licen[sc]e", "open data commons", "1.0"), ("pddl", "public domain dedication (?:and|&) licen[sc]e", "public domain dedication", "1.0"),
        ("cecill", "cecill(?: free software licen[sc]e)?", "cecill", "1.0 1.1 2.0 2.1"), ("lppl", "latex project public licen[sc]e", "latex project", "1.0 1.1 1.2 1.3"), ("apsl", "apple public source licen[sc]e", "apple public", "1.0 1.1 1.2 2.0"), ("ecl", "educational community licen[sc]e", "educational community", "1.0 2.0"),
        ("cpl", "common public licen[sc]e", "common public", "1.0"), ("ipl", "ibm public licen[sc]e", "ibm public", "1.0"), ("npl", "netscape public licen[sc]e", "netscape", "1.0 1.1"), ("php", "php licen[sc]e", "php", "3.0 3.01"), ("python", "python(?: software foundation)? licen[sc]e", "python", "2.0"),
        ("ms-pl", "microsoft public licen[sc]e", "microsoft public", "1.0"), ("ms-rl", "microsoft reciprocal licen[sc]e", "microsoft reciprocal", "1.0"), ("qpl", "q public licen[sc]e", "q public", "1.0"), ("upl", "universal permissive licen[sc]e", "universal permissive", "1.0"), ("blueoak", "blue oak model licen[sc]e", "blue oak", "1.0"),
    ):
        for v in versions.split():
            add(f"{label}-{v}-or-later", rf"(?:the )?{title}(?: [a-z]+)?? ?(?:version |v ?)?{number(v)}(?:\+|{or_later})", keyword, 93)
            add(f"{label}-{v}", rf"(?:the )?{title}(?: [a-z]+)?? ?(?:version |v ?)?{number(v)}", keyword, 90)
        add(f"{label}-any", rf"(?:the )?{title}", keyword, 55)
    for v in ("1.1", "2.0"):
        add(f"apache-{v}", rf"apache {number(v)}", "apache", 70)
    # Short permissive licences: title and typical sentence.
    for label, pattern, keyword, priority in (
        ("mit", "(?:under |with )?(?:the )?(?:terms of the )?mit(?: x11| expat)? licen[sc]e", "mit license|mit licence|mit x11|mit expat", 85), ("mit", "licen[sc]ed? under(?: the)? mit", "under mit|under the mit", 80), ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", 88),
        ("bsd-4-clause", "bsd 4 clause(?: licen[sc]e)?|(?:original|old) bsd licen[sc]e", "bsd", 86), ("bsd-3-clause", "bsd 3 clause(?: licen[sc]e)?|(?:new|modified|revised) bsd licen[sc]e", "bsd", 86), ("bsd-2-clause", "bsd 2 clause(?: licen[sc]e)?|(?:simplified|free) bsd licen[sc]e", "bsd", 86), ("bsd-0-clause", "(?:bsd )?0 ?(?:clause )?bsd(?: licen[sc]e)?|zero clause bsd", "bsd", 86), ("bsd-any", "bsd(?: style)? licen[sc]e", "bsd", 55),
        ("bsd-any", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 84), ("isc", "isc licen[sc]e", "isc", 80), ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use", 84), ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib", 80),
        ("unlicense", "the unlicense|this is free and unencumbered software released into the public domain", "unlicense|unencumbered", 84), ("wtfpl", "do what the f\\w+ you want to public licen[sc]e|wtfpl", "you want to public|wtfpl", 84), ("ncsa", "ncsa open source licen[sc]e", "ncsa", 80), ("postgresql", "postgresql licen[sc]e", "postgresql", 80), ("openssl", "openssl licen[sc]e", "openssl", 80), ("ruby", "ruby licen[sc]e", "ruby", 70),
        ("public-domain", "(?:released |placed |is )?(?:in|into|to) the public domain", "public domain", 60), ("public-domain", "no rights reserved", "no rights reserved", 60), ("reserved", "all rights (?:are )?reserved", "rights reserved|rights are reserved", 40), ("reserved", "tous droits reserves|tous droits réservés", "tous droits", 40), ("reserved", "alle rechte vorbehalten", "alle rechte", 40), ("reserved", "todos los derechos reservados", "todos los derechos", 40),
        ("proprietary", "proprietary and confidential|unauthorized copying of this (?:file|work)|not for (?:re)?distribution", "proprietary and|unauthorized copying|not for distribution|not for redistribution", 65), ("copyright", "(?:copyright|©)(?: c)? (?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?", "copyright|©", 30),
    ):
        add(label, pattern, keyword, priority)
    # Notices and clauses as they stand in files, by label and priority.
    for label, priority, keyword, pattern in NOTICES:
        add(label, pattern, keyword, priority)
    # Identifiers of the form that source files declare; further ones of an expression follow "or", "and" or "with".
    header = "spdx license identifier"
    for label, pattern in SPDX:
        add(label, rf"{header} {pattern}", header, 97)
        add(label, rf"(?:(?<= or )|(?<= and )){pattern}", header, 96, elsewhere=True)
    add("spdx", rf"{header} \S+", header, 20)
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def _compiled() -> tuple:
    import ahocorasick

    found = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for word in rule.keywords:
            by.setdefault(normalise(word)[1].decode(), []).append(i)
    for word, ids in by.items():
        found.add_word(word, ids)
    found.make_automaton()
    return found, [re.compile(rf"(?<!\S)(?:{r.pattern})(?!\S)") for r in rules()]


def normalise(text: str | None) -> tuple[int, bytes, bytes]:
    """The number of words; the words with single blanks between, as UTF-8; the same with pluses after digits, for the
    rules. Only A-Z are made lower case."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORDS).split()
    plain = b" ".join(words)
    if b"+" in raw and _PLUS.search(raw):
        # The byte 1, a blank otherwise, stands for the plus until the words are cut.
        return len(words), plain, b" ".join(_PLUS.sub(b"\x01", raw.replace(b"\x01", b" ")).translate(_KEPT).split()).replace(b"\x01", b"+")
    return len(words), plain, plain


def base_places(text: bytes) -> dict[str, list[int]]:
    """For each base phrase that is there: the indices of the words at which it begins."""
    out: dict[str, list[int]] = {}
    framed = b" " + text + b" "
    for phrase in BASE:
        want, at, counted, words = f" {phrase} ".encode(), -1, 0, 0
        while (at := framed.find(want, at + 1)) >= 0:
            words, counted = words + framed.count(b" ", counted, at), at
            out.setdefault(phrase, []).append(words)
    return out


def suppress(places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (begin, end, priority, rule) those that overlap none that goes before: by priority, then length, then begin, then
    the rules' order. They are returned in the order of their begins."""
    taken = bytearray(max((p[1] for p in places), default=0))
    kept = []
    for p in sorted(places, key=lambda p: (-p[2], p[0] - p[1], p[0], p[3])):
        if taken.find(1, p[0], p[1]) < 0:
            taken[p[0] : p[1]] = b"\x01" * (p[1] - p[0])
            kept.append(p)
    return sorted(kept)


def scan(text: str | None, gated: bool = True) -> tuple[int, list[tuple[str, int, int, int]], dict[str, list[int]]]:
    """(number of words, detections (label, first character, end, priority), base places) of a text.

    Characters are those of the normalised text. With ``gated`` false all rules run whose matches hold
    their keywords, whether these are there or not.
    """
    n, words, marked = normalise(text)
    found, patterns = _compiled()
    base = base_places(words)
    plain = marked.decode("utf-8", "replace")
    wanted = sorted({i for _, ids in found.iter(plain) for i in ids}) if gated else [i for i, r in enumerate(rules()) if not r.elsewhere or any(k in plain for k in r.keywords)]
    all_rules = rules()
    places = [(m.start(), m.end(), all_rules[i].priority, i) for i in wanted for m in patterns[i].finditer(plain) if m.end() > m.start()]
    return n, [(all_rules[i].label, a, b, p) for a, b, p, i in suppress(places)], base


SCHEMA = "key string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, begin: int, end: int, priority: int>>"


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: (key, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    ``detections`` are the rules' places (character offsets in the normalised text) that no other place suppressed;
    ``labels`` joins theirs and the base phrases'. ``score`` is 1 - the product of (1 - priority / 100) over the labels'
    best places, base phrases counting 0.9; 0 without any. Null and empty texts have no words and no labels; an empty
    table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    detection = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("priority", pa.int32())]))
    types = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), detection]
    names = ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found, base = scan(t.as_py())
                starts = [i for at in base.values() for i in at]
                best = {BASE[p]: 90 for p in base}
                for label, _, _, priority in found:
                    best[label] = max(best.get(label, 0), priority)
                doubt = float(np.prod([1 - p / 100 for p in best.values()]))
                row = (n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({BASE[p] for p in base})), ",".join(sorted(best)), 1 - doubt)
                out.append((k, *row, [dict(zip(("label", "begin", "end", "priority"), d, strict=True)) for d in found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    out = docs.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, SCHEMA)
    return out.select(F.col("key").cast(kind).alias(key), *names[1:])
