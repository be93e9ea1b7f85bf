"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its words joined by blanks. Rules are regexes over that string, each
with a keyword, a priority and a confidence; a rule runs only on texts that hold its
keyword, and most texts stop at one cheap test for any licence wording at all. A
match is marked in place by two control characters, so its first and last word are
positions in the split string. A detection is dropped if another of better priority
(or as good, and longer or earlier in the table) covers its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower

#: Words of a licence text: everything but ASCII signs, blanks and controls, lower-cased A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, keyword, and how the licence is named in lower-cased words.
FAMILIES = (
    ("mit", "mit", "(?:mit|mit x11|mit expat|expat mit)"),
    ("mit-0", "mit", "mit (?:0|no attribution)"),
    ("x11", "x11", "x11(?: mit)?"),
    ("apache-2", "apache", "apache(?: software)?(?: license| licence)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license| licence)?(?: version| v)? ?1 1"),
    ("apache-1.0", "apache", "apache(?: software)?(?: license| licence)?(?: version| v)? ?1 0"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "bsd", "(?:0bsd|bsd zero clause|zero clause bsd)"),
    ("bsd", "bsd", "(?:bsd style|bsd)"),
    ("bsd", "berkeley", "berkeley software distribution"),
    ("gpl-2-only", "gpl", "(?:gnu )?gpl(?: version)? (?:v2|2)(?: 0)? only"),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?: version)? ?(?:v2|2)(?: 0)?"),
    ("gpl-3", "gpl", "(?:gnu )?gpl(?: version)? ?(?:v3|3)(?: 0)?"),
    ("gpl-2", "general public", "gnu general public license(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "general public", "gnu general public license(?: version| v)? ?3(?: 0)?"),
    ("gpl", "general public", "gnu general public license"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version)? ?(?:v2|2) 1"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?: version)? ?(?:v3|3)(?: 0)?"),
    ("lgpl-2.1", "lesser general", "gnu lesser general public license(?: version| v)? ?2 1"),
    ("lgpl-3", "lesser general", "gnu lesser general public license(?: version| v)? ?3(?: 0)?"),
    ("lgpl", "lesser general", "gnu lesser general public license"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl-3", "agpl", "(?:gnu )?agpl(?: version)? ?(?:v3|3)(?: 0)?"),
    ("agpl-3", "affero", "gnu affero general public license(?: version| v)?(?: 3)?(?: 0)?"),
    ("fdl", "free documentation", "gnu free documentation license(?: version| v)?(?: 1)?(?: [123])?"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? ?1 1"),
    ("mpl-2", "mozilla", "mozilla public license(?: version| v)?(?: 2)?(?: 0)?"),
    ("mpl-2", "mpl", "mpl(?: 2)?(?: 0)?"),
    ("epl-1", "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)?(?: 2)?(?: 0)?"),
    ("cddl", "development and distribution", "common development and distribution license"),
    ("cddl", "cddl", "cddl(?: 1)?(?: [01])?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "(?:zlib libpng|zlib)"),
    ("boost-1", "boost", "boost software license(?: version| v)?(?: 1)?(?: 0)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: version)?(?: 2)?"),
    ("artistic-2", "artistic", "artistic license(?: version)?(?: 2)?(?: 0)?"),
    ("python-2", "python", "(?:python software foundation|python)(?: license)?(?: version)?(?: 2)?"),
    ("python-2", "psf", "psf(?: license)?(?: version)?(?: 2)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("ofl-1.1", "open font", "(?:sil )?open font license(?: version)?(?: 1)?(?: 1)?"),
    ("odbl", "database license", "open (?:data commons open )?database license"),
    ("cc0", "cc0", "cc0(?: 1)?(?: 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1234])?(?: 0)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1234])?(?: 0)?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1234])?(?: 0)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1234])?(?: 0)?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1234])?(?: 0)?"),
    ("cc-by", "cc", "cc by(?: [1234])?(?: 0)?"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike"),
    ("cc-by", "creative commons", "creative commons attribution"),
    ("ms-pl", "microsoft public", "microsoft public license"),
    ("eupl", "european union", "european union public license(?: version| v)?(?: 1)?(?: 2)?"),
    ("eupl", "eupl", "eupl(?: version| v)?(?: 1)?(?: 2)?"),
    ("upl", "universal permissive", "universal permissive license"),
)

#: Priority (less is better), confidence, and the words around a name. "{}" is the name.
FORMS = (
    (1, 1.0, "spdx license identifier {}"),
    (2, 0.95, "(?:licensed|released|distributed|available|published|provided|covered|shared)(?: by us)? under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: public)?(?: license| licence)?"),
    (3, 0.85, "(?:subject to|governed by|in accordance with|compliance with) (?:the )?(?:terms of (?:the )?)?{}(?: license| licence)?"),
    (4, 0.75, "under (?:the )?(?:terms of (?:the )?)?{}(?: license| licence)"),
    (5, 0.6, "{} (?:license|licence)"),
    (6, 0.5, "(?:license|licence|licensed) {}"),
    (7, 0.4, "{}"),
)

#: Sentences that identify a licence by themselves: label, keyword, regex.
SENTENCES = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "without restriction", "deal in the software without restriction including without limitation the rights"),
    ("mit", "substantial portions", "permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "authors or copyright", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}? to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used"),
    ("x11", "x consortium", "x window system is a trademark of x consortium"),
    ("isc", "purpose with or without fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims all warranties", "the author disclaims all warranties with regard to this software including all implied warranties"),
    ("0bsd", "purpose with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause", "freebsd project", "policies either expressed or implied of the freebsd project"),
    ("bsd-3-clause-clear", "patent rights", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-source-code", "source code must", "redistributions of source code must retain the above copyright notice and this license"),
    ("apache-2", "this file except", "you may not use this file except in compliance with the license"),
    ("apache-2", "apache org licenses", "you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0"),
    ("apache-2", "conditions of any kind", "distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", "contributor license agreements", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache group", "this product includes software developed by the apache group"),
    ("apache-2-llvm", "llvm exceptions", "(?:apache license v2 0|under the apache license) with llvm exceptions"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "free software", "is free software (?:you can redistribute it|and comes with absolutely no warranty)"),
    ("gpl", "received a copy", "you should have received a copy of the gnu general public license"),
    ("gpl", "merchantability or fitness", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl-3", "version 3", "either version 3 of the license or at your option any later version"),
    ("gpl-3", "version 3", "gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("gpl-2", "version 2", "either version 2 of the license or at your option any later version"),
    ("gpl-2", "version 2", "gnu general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-2-only", "version 2", "(?:version 2 of the license as published by the free software foundation|version 2 only)"),
    ("gpl-1", "version 1", "either version 1 or at your option any later version"),
    ("gpl-classpath", "classpath exception", "(?:gpl|general public license).{0,40}? with (?:the )?classpath exception"),
    ("gpl-classpath", "linking this library", "linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-autoconf", "configuration script", "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script"),
    ("gpl-bison", "bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-font", "font", "as a special exception if you create a document which uses this font"),
    ("gpl-gcc", "runtime library", "gcc runtime library exception(?: version 3 1)?"),
    ("lgpl", "lesser general", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "library general", "gnu library general public license"),
    ("lgpl-2.1", "lesser general", "gnu lesser general public license as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3", "lesser general", "gnu lesser general public license as published by the free software foundation (?:either )?version 3"),
    ("lgpl-2", "library general", "gnu library general public license as published by the free software foundation (?:either )?version 2"),
    ("agpl-3", "affero", "gnu affero general public license as published by the free software foundation (?:either )?version 3"),
    ("agpl-3", "affero", "you should have received a copy of the gnu affero general public license"),
    ("agpl-3", "interact", "users interacting with it remotely through a computer network"),
    ("fdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("fdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla org mpl", "you can obtain one at (?:http|https) (?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-2-no-copyleft", "secondary licenses", "this source code form is incompatible with secondary licenses"),
    ("npl-1.1", "netscape", "the contents of this file are subject to the netscape public license"),
    ("epl-1", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("cpl-1", "common public", "common public license(?: version| v)?(?: 1)?(?: 0)?"),
    ("ipl-1", "ibm public", "ibm public license(?: version| v)?(?: 1)?(?: 0)?"),
    ("edl-1", "eclipse distribution", "eclipse distribution license(?: version| v)?(?: 1)?(?: 0)?"),
    ("cddl", "development and distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("spl-1", "sun public", "sun public license(?: version| v)?(?: 1)?(?: 0)?"),
    ("sissl", "industry standards", "sun industry standards source license"),
    ("apsl-2", "apple public", "apple public source license(?: version| v)?(?: 2)?(?: 0)?"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("boost-1", "boost", "distributed under the boost software license version 1 0"),
    ("boost-1", "person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", "please refer to (?:http|https) unlicense org"),
    ("wtfpl", "do what the", "do what the fuck you want to public license"),
    ("beerware", "beer", "(?:the )?beer ?ware license"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("artistic-1", "artistic", "artistic license(?: version)? 1(?: 0)?"),
    ("artistic-1-perl", "perl itself", "under the same terms as perl itself"),
    ("artistic-2", "perl foundation", "the artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    ("ruby", "ruby", "(?:under )?(?:the )?(?:same )?(?:terms as ruby|ruby license|ruby s license)"),
    ("php-3.01", "php", "php license(?: version| v)?(?: 3)?(?: 0)?1?"),
    ("php-3.01", "php", "this product includes php software freely available from"),
    ("python-2", "python software foundation", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("python-cnri", "cnri", "cnri open source license agreement"),
    ("zpl-2.1", "zope", "zope public license(?: version| v)?(?: 2)?(?: [01])?"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young"),
    ("curl", "curl", "(?:curl license|licensed under (?:the )?curl)"),
    ("icu", "icu", "icu license"),
    ("unicode", "unicode", "unicode inc license agreement data files and software"),
    ("unicode-3", "unicode", "unicode license v3"),
    ("ncsa", "illinois", "university of illinois ncsa open source license"),
    ("w3c", "w3c", "w3c software (?:notice and license|and document license|and document notice and license)"),
    ("hpnd", "historical permission", "historical permission notice and disclaimer"),
    ("ntp", "purpose with or without fee", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("libpng", "png reference library", "png reference library license(?: version 2)?"),
    ("ijg", "independent jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", "(?:the )?freetype (?:project )?license"),
    ("imagemagick", "imagemagick", "imagemagick license"),
    ("vim", "vim", "vim license"),
    ("tcl", "tcl", "(?:tcl tk license|tcl license)"),
    ("sqlite-blessing", "blessing", "the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("afl-3", "academic free", "academic free license(?: version| v)?(?: 3)?(?: 0)?"),
    ("osl-3", "open software license", "open software license(?: version| v)?(?: 3)?(?: 0)?"),
    ("cecill-2.1", "cecill", "cecill (?:free software )?license(?: agreement)?(?: version)?(?: 2)?(?: [01])?"),
    ("cecill-b", "cecill", "cecill b(?: free software license agreement)?"),
    ("cecill-c", "cecill", "cecill c(?: free software license agreement)?"),
    ("eupl", "eupl", "licensed under the eupl version 1 [12]"),
    ("mulan-psl-2", "mulan", "mulan (?:permissive software license|psl)(?: v2)?"),
    ("ms-pl", "microsoft", "microsoft public license ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license"),
    ("ms-lpl", "limited public", "microsoft limited public license"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "reserved font name", "with reserved font name"),
    ("ubuntu-font", "ubuntu font", "ubuntu font licen[cs]e"),
    ("bitstream-vera", "bitstream vera", "bitstream vera is a trademark of bitstream"),
    ("odbl", "open data commons", "open data commons open database license"),
    ("odc-by", "open data commons", "open data commons attribution license"),
    ("pddl", "open data commons", "open data commons public domain dedication and licen[cs]e"),
    ("cdla-permissive", "community data", "community data license agreement permissive"),
    ("cdla-sharing", "community data", "community data license agreement sharing"),
    ("ogl-uk", "open government", "(?:contains public sector information licensed under the )?open government licen[cs]e(?: v3 0)?"),
    ("etalab-2", "etalab", "(?:licence ouverte|open licence) etalab"),
    ("gfdl-wiki", "attribution sharealike", "text is available under the creative commons attribution sharealike license additional terms may apply"),
    ("cc0", "no rights reserved", "cc0 no rights reserved"),
    ("cc0", "waived all copyright", "waived all copyright and related or neighboring rights"),
    ("cc0", "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons org licenses", "creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creativecommons org licenses", "creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nd", "creativecommons org licenses", "creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-nc", "creativecommons org licenses", "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses", "creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "creativecommons org licenses", "creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by", "some rights reserved", "some rights reserved creative commons"),
    ("openrail", "responsible ai", "(?:creativeml )?open responsible ai license"),
    ("openrail", "openrail", "(?:bigscience |creativeml |bigcode )?openrail(?: m| plus)?(?: license)?"),
    ("llama", "llama", "llama (?:2|3|3 1|3 2) community license(?: agreement)?"),
    ("gemma", "gemma", "gemma terms of use"),
    ("busl-1.1", "business source", "business source license(?: 1 1)?"),
    ("sspl-1", "server side public", "server side public license(?: version 1| v1)?"),
    ("elastic-2", "elastic license", "elastic license(?: 2 0| v2)?"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter) license"),
    ("commons-clause", "commons clause", "commons clause license condition(?: v1 0)?"),
    ("confluent", "confluent", "confluent community license"),
    ("timescale", "timescale", "timescale license agreement"),
    ("public-domain", "public domain", "(?:is|are|placed|released) (?:in|into) the public domain"),
    ("public-domain", "public domain", "dedicate(?:s|d)? (?:any and all copyright interest|this work|it) .{0,40}?to the public domain"),
    ("public-domain", "united states government", "this (?:work|software) is a work of the united states government"),
    ("public-domain", "no copyright", "no copyright (?:is claimed|protection)"),
    ("proprietary", "rights reserved", "all rights reserved"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("proprietary", "confidential", "confidential and proprietary(?: information)?"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|material|document)"),
    ("proprietary", "written permission", "without (?:the )?(?:prior|express) written permission"),
    ("proprietary", "written consent", "without (?:the )?(?:prior|express) written consent"),
    ("proprietary", "trade secret", "contains (?:valuable )?trade secrets"),
    ("proprietary", "end user license", "end user license agreement"),
    ("proprietary", "may not be reproduced", "may not be reproduced (?:distributed )?(?:or )?(?:transmitted )?in any form"),
    ("commercial", "commercial license", "(?:a )?commercial license (?:is required|must be|may be|can be)"),
    ("commercial", "licensed not sold", "(?:the )?software is licensed not sold"),
    ("non-commercial", "commercial", "for non ?commercial (?:use|purposes|research) only"),
    ("non-commercial", "for personal", "for personal (?:and )?non ?commercial use"),
    ("research-only", "research", "for (?:academic )?research (?:use|purposes) only"),
    ("evaluation", "evaluation", "for evaluation purposes only"),
    ("freeware", "freeware", "this (?:software|program) is freeware"),
    ("shareware", "shareware", "this (?:software|program) is shareware"),
    ("dual", "dual licensed", "(?:is )?dual licensed under"),
)

#: Whatever a rule or phrase matches holds one of these words.
GATE = """
license licence licensed licenses licences spdx under subject governed accordance compliance hereby redistribution
redistributions endorse software version unencumbered domain reserved confidential cc merchantability interacting
invariant misrepresented marked cryptographic blessing evil beer perl trademark permission x consortium jpeg
advertising copyright rights unauthorized consent secrets reproduced commercial noncommercial research evaluation
program work creativecommons openrail gemma etalab combined portions liable basis font policies disclaims
restriction ruby cecill historical mozilla apache mulan php without public exception unlicense
""".split()


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    keyword: str
    priority: int
    confidence: float
    pattern: str


def ruled() -> list[Rule]:
    """All rules in order: every form of every family, then the sentences; a bare name must say "license" itself."""
    out = [(label, word, priority, sure, form.replace("{}", name)) for priority, sure, form in FORMS for label, word, name in FAMILIES if form != "{}" or " license" in name.split("(")[0]]
    out += [(label, word, 1, 0.98, text) for label, word, text in SENTENCES]
    return [Rule(i, *x) for i, x in enumerate(out)]


START, END = "\x01", "\x02"


def places(joined: Column, pattern: Column | str) -> Column:
    """(first, last) word numbers of all matches of ' (pattern)(?= )' in the blank-joined words."""
    marked = F.split(F.regexp_replace(joined, pattern, F.lit(f" {START}$1{END}")), " ")
    at = lambda test: F.filter(F.transform(marked, lambda w, i: F.when(test(w), i - 1)), lambda i: i.isNotNull())
    return F.arrays_zip(at(lambda w: F.startswith(w, F.lit(START))).alias("first"), at(lambda w: F.endswith(w, F.lit(END))).alias("last"))


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table_of(rules: list[Rule]) -> Column:
    """The rules by keyword as one constant array: a text's keywords are looked for once, whatever the number of their rules."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.keyword, []).append(r)
    rows = lambda rs: ", ".join(f"struct({r.number} as number, {literal(r.label)} as label, {r.priority} as priority, {r.confidence}D as confidence, {literal(f' ({r.pattern})(?= )')} as pattern)" for r in rs)
    return F.expr("array(" + ", ".join(f"struct({literal(k)} as keyword, array({rows(rs)}) as rules)" for k, rs in by.items()) + ")")


def scanned(documents: DataFrame) -> DataFrame:
    """Per row of documents (doc_id, text): n_words, base places and labels, labels, score, and the detections themselves.

    n_base counts the places of all BASE phrases, first_word and last_word are the
    smallest and largest word (from 0) at which one starts, null without any.
    detections (first, last, label, priority, confidence, number) are what remains of
    the rules' matches; labels are theirs and the base's, distinct, sorted, joined by
    commas, '' if there are none. score is the largest confidence, 0.9 at least if
    there is a base place, and 0 without labels. Equal matches: the rule of better
    priority, then the longer, then the earlier in the table stays. Null, empty and
    blank texts have no words. Null ids and repeated rows are rows like others; other
    columns are not read."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split(F.lower("text"), BETWEEN), ""))
    own = F.array_remove(F.split(ascii_lower(F.col("text")), BETWEEN), "")
    may = F.arrays_overlap("words", F.array(*map(F.lit, GATE)))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(may, F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))).alias("joined"))

    def labelled(label: str):
        return lambda p: F.struct(p["first"].alias("first"), F.lit(label).alias("label"))

    base = [F.transform(places(F.col("joined"), f" ({phrase})(?= )"), labelled(label)) for phrase, label in BASE.items()]
    tests = [F.when(F.col("joined").contains(f" {phrase} "), found).otherwise(F.expr("cast(array() as array<struct<first:int,label:string>>)")) for (phrase, _), found in zip(BASE.items(), base, strict=True)]
    rows = rows.withColumn("base", F.when(F.col("joined").isNotNull(), F.concat(*tests)))

    active = F.flatten(F.transform(F.filter(table_of(ruled()), lambda k: F.col("joined").contains(k["keyword"])), lambda k: k["rules"]))
    hits = F.flatten(F.transform(active, lambda r: F.transform(places(F.col("joined"), r["pattern"]), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), r["number"].alias("number")))))
    rows = rows.withColumn("hits", F.when(F.col("joined").isNotNull(), hits))

    def beaten(d: Column, e: Column) -> Column:
        longer = (e["last"] - e["first"]) > (d["last"] - d["first"])
        same = (e["last"] - e["first"]) == (d["last"] - d["first"])
        better = (e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (longer | (same & (e["number"] < d["number"]))))
        return (e["first"] <= d["first"]) & (e["last"] >= d["last"]) & better

    rows = rows.withColumn("detections", F.filter("hits", lambda d: ~F.exists("hits", lambda e: beaten(d, e))))
    starts = F.transform("base", lambda b: b["first"])
    base_labels = F.coalesce(F.sort_array(F.array_distinct(F.transform("base", lambda b: b["label"]))), F.array().cast("array<string>"))
    own = F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>"))
    n_base = F.coalesce(F.size("base"), F.lit(0)).cast("long")
    sure = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.when(F.col("base").isNull(), 0).otherwise(n_base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.sort_array(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"),
        F.greatest(sure, F.when(F.size(base_labels) > 0, 0.9).otherwise(0.0)).alias("score"), "detections",
    )
