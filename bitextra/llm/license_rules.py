"""License detection by ordered signature rules, in DataFrame functions only.

A text is read as its words (A-Z counted as a-z) with single blanks between.
Signatures are regular expressions over that form, written by family and by
wording; each has keywords, a priority and a weight. The gate is made of these
keywords and reads the same form, so no separator and no name escapes it: a text
without any keyword is not looked at further; of the others only the signatures
of which a keyword occurs are tried. Base phrases do not pass the gate but a
test of their own. Detections are word intervals: one that lies inside an
interval of the same or a higher priority is suppressed. Everything happens
within the row, so nothing is shuffled and no source can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, places, running

# Fixed by the contract: what separates words (A-Z are word characters here), phrases, labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_WEIGHT = 0.6

# label, SPDX-style identifier as words, the license's names as a pattern, keywords of the family
# (every name holds at least one of them).
FAMILIES = (
    ("apache-1.1", "apache 1 1", r"apache (?:software )?license (?:version )?v?1 1", "apache"),
    ("apache-2.0", "apache 2 0", r"apache (?:software )?(?:license )?(?:version )?v?2(?: 0)?", "apache"),
    ("artistic", "artistic [12] 0", r"(?:perl )?artistic license(?: (?:version )?[12] 0)?", "artistic"),
    ("bsd-0", "0bsd", r"(?:zero clause|0 clause) bsd", "bsd"),
    ("bsd-2", "bsd 2 clause", r"(?:2|two) clause bsd|simplified bsd|freebsd", "bsd"),
    ("bsd-3", "bsd 3 clause", r"(?:3|three) clause bsd|(?:new|modified|revised) bsd", "bsd"),
    ("bsd-4", "bsd 4 clause", r"(?:4|four) clause bsd|original bsd", "bsd"),
    ("bsl", "bsl 1 0", r"boost software license", "boost"),
    ("busl", "busl 1 1", r"business source license", "business source"),
    ("cc0", "cc0 1 0", r"cc0|creative commons zero|cc zero", "cc0|cc zero|commons zero"),
    ("cc-by-sa", "cc by sa [1-4] [05]", r"cc by sa|(?:creative commons )?attribution share ?alike", "cc by sa|attribution"),
    ("cc-by-nc", "cc by nc [1-4] [05]", r"cc by nc|(?:creative commons )?attribution non ?commercial", "cc by nc|attribution"),
    ("cc-by-nd", "cc by nd [1-4] [05]", r"cc by nd|(?:creative commons )?attribution no ?deriv(?:ative)?s?(?: works)?", "cc by nd|attribution"),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]", r"cc by nc sa|attribution non ?commercial share ?alike", "cc by nc|attribution"),
    ("cc-by", "cc by [1-4] [05]", r"creative commons attribution(?: [1-4] [05])?", "creative commons"),
    ("cddl", "cddl 1 [01]", r"common development and distribution license|cddl", "cddl|common development"),
    ("cecill", "cecill [12] [01]", r"cecill(?: [abc])?", "cecill"),
    ("cpl", "cpl 1 0", r"common public license", "common public"),
    ("epl", "epl [12] 0", r"eclipse public license|eclipse distribution license", "eclipse"),
    ("eupl", "eupl 1 [012]", r"european union public licen[cs]e|eupl", "eupl|european union"),
    ("fdl", "gfdl 1 [123]", r"(?:gnu )?free documentation license|gfdl", "documentation license|gfdl"),
    ("agpl", "agpl 3 0(?: only| or later)?", r"(?:gnu )?affero general public license|agpl(?: ?v?3)?", "agpl|affero"),
    ("lgpl", "lgpl [23] [01](?: only| or later)?", r"(?:gnu )?(?:lesser|library) general public license|lgpl(?: ?v?[23])?", "lgpl|lesser general|library general"),
    ("gpl-2", "gpl 2 0(?: only| or later)?", r"(?:gnu )?(?:gpl|general public license) ?(?:version |v)?2", "gpl|general public"),
    ("gpl-3", "gpl 3 0(?: only| or later)?", r"(?:gnu )?(?:gpl|general public license) ?(?:version |v)?3", "gpl|general public"),
    ("gpl", "gpl", r"gnu gpl|gnu general public license", "gnu"),
    ("isc", "isc", r"isc license|internet systems consortium license", "isc license|internet systems"),
    ("ms-pl", "ms pl", r"microsoft public license", "microsoft"),
    ("mit", "mit(?: 0)?", r"(?:mit|expat|x11)(?: x11| expat)? licen[cs]e", "mit licen|mit x11|mit expat|expat licen|x11 licen"),
    ("mpl", "mpl [12] [01]", r"mozilla public license|mpl", "mozilla| mpl "),
    ("odbl", "odbl 1 0", r"open (?:data commons )?(?:open )?database license|odbl", "database license|odbl"),
    ("odc-by", "odc by 1 0", r"open data commons attribution(?: license)?", "open data commons"),
    ("ofl", "ofl 1 [01]", r"sil open font license|open font license", "open font"),
    ("ogl", "ogl uk [123] 0", r"open government licen[cs]e", "open government"),
    ("openssl", "openssl", r"openssl license", "openssl"),
    ("osl", "osl [123] [01]", r"open software license", "open software"),
    ("php", "php 3 01?", r"php license", "php license"),
    ("psf", "psf 2 0|python 2 0", r"python (?:software foundation )?license", "python"),
    ("public-domain", "public domain", r"(?:the )?public domain|pddl|public domain dedication", "public domain|pddl"),
    ("qpl", "qpl 1 0", r"q public license", "q public"),
    ("ruby", "ruby", r"ruby license", "ruby license"),
    ("sspl", "sspl 1 0", r"server side public license|sspl", "sspl|server side"),
    ("unlicense", "unlicense", r"unlicen[cs]e", "unlicen"),
    ("wtfpl", "wtfpl", r"do what the f\w+ you want to public license|wtfpl", "wtfpl|want to public license"),
    ("zlib", "zlib", r"zlib(?: libpng)? license|zlib libpng", "zlib"),
    ("zpl", "zpl 2 [01]", r"zope public license", "zope"),
)
# wording ({id} and {name} are the family's), priority, weight, keyword (None: the family's).
WORDINGS = (
    (r"spdx license identifier {id}", 4, 1.0, "spdx"),
    (r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:{name})", 3, 0.9, None),
    (r"(?:{name})", 1, 0.5, None),
)
# Signatures of license texts, by what they are in their license: a grant, a condition, a warranty,
# the header for source files, a title or a notice. Label, pattern, priority, weight, keyword.
TEXTS = (
    # Permissive grants
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 4, 0.97, "hereby granted"),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 3, 0.9, "hereby granted"),
    ("mit", r"to deal in the software without restriction including without limitation the rights", 4, 0.95, "deal in the software"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 4, 0.95, "permission notice shall"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", 3, 0.85, "noninfringement"),
    ("x11", r"except as contained in this notice the names? of .{1,90}? shall not be used in advertising or otherwise", 4, 0.95, "as contained in this notice"),
    ("ncsa", r"neither the names of .{1,160}? nor the names of its contributors may be used to endorse", 4, 0.95, "neither the names"),
    ("ncsa", r"university of illinois ncsa open source license", 3, 0.95, "ncsa"),
    ("json", r"the software shall be used for good not evil", 4, 0.97, "not evil"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies except as contained", 4, 0.9, "permission notice appear"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose", 3, 0.9, "permission to use"),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties", 4, 0.9, "author disclaims"),
    ("0bsd", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 4, 0.97, "permission to use"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?(?:with or )?without fee is hereby granted", 4, 0.95, "and its documentation"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software", 4, 0.95, "authors hereby grant"),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee", 3, 0.85, "and its documentation"),
    ("smlnj", r"names of the copyright holders may not be used in advertising or publicity pertaining to this software", 4, 0.9, "advertising or publicity"),
    ("fsf-all-permissive", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 4, 0.97, "without royalty"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", 4, 0.97, "buy me a beer"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 4, 0.97, "changing it is allowed"),
    ("wtfpl", r"you just do what the f\w+ you want to", 4, 0.97, "you just do what"),
    ("vim", r"vim is charityware you can use and copy it as much as you like", 4, 0.97, "charityware"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 4, 0.97, "unencumbered"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 4, 0.95, "anyone is free to copy"),
    ("unlicense", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate", 4, 0.95, "jurisdictions that recognize"),
    ("cc0", r"to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights", 4, 0.97, "waived all copyright"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", 4, 0.97, "associated a work"),
    ("public-domain", r"(?:has been |is )?(?:placed|dedicated|released) (?:in|to|into) the public domain", 3, 0.9, "public domain"),
    ("public-domain", r"the author disclaims copyright to this source code", 4, 0.95, "disclaims copyright"),
    # Redistribution families
    ("bsd", r"redistribution and use in source and binary forms with or without modification", 3, 0.9, "redistribution"),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions", 3, 0.9, "redistributions of source"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions", 3, 0.9, "redistributions in binary"),
    ("bsd", r"this software is provided by (?:the )?(?:copyright holders|regents|author)(?: and contributors)? as is and any express or implied warranties", 3, 0.85, "is provided by"),
    ("bsd-3", r"neither the names? of .{1,90}? nor the names of (?:its|any|their) contributors may be used to endorse or promote products derived from this software", 4, 0.96, "neither the name"),
    ("bsd-3", r"the names? of (?:the author|.{1,60}?) may not be used to endorse or promote products derived from this software", 4, 0.9, "not be used to endorse"),
    ("bsd-3", r"neither the name of .{1,80}? nor the names of its contributors", 3, 0.9, "neither the name"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 4, 0.97, "advertising materials"),
    ("bsd-3-clear", r"no express or implied licenses to any party s patent rights are granted by this license", 4, 0.97, "party s patent rights"),
    ("bsd-3-no-nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", 4, 0.97, "nuclear facility"),
    ("bsd-2-views", r"those of the authors and should not be interpreted as representing official policies", 4, 0.9, "official policies"),
    ("bsd-2-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide", 4, 0.95, "those receiving rights"),
    ("bsd-source-code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer neither the name", 4, 0.9, "redistributions of source"),
    ("apache-1.1", r"this product includes software developed by the apache (?:software foundation|group)", 4, 0.95, "developed by the apache"),
    ("apache-1.1", r"products derived from this software may not be called apache", 4, 0.95, "not be called apache"),
    ("php", r"products derived from this software may not be called php", 4, 0.97, "not be called php"),
    ("php", r"this product includes php software freely available from", 4, 0.95, "includes php"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 4, 0.97, "openssl project"),
    ("openssl", r"the names openssl toolkit and openssl project must not be used to endorse", 4, 0.97, "openssl toolkit"),
    ("ssleay", r"this package is an ssl implementation written by eric young", 4, 0.97, "ssl implementation"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", 4, 0.92, "provided as is"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 4, 0.97, "origin of this software"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented", 4, 0.97, "plainly marked"),
    ("libpng", r"the origin of this source code must not be misrepresented", 4, 0.95, "origin of this source code"),
    ("bzip2", r"altered source versions must be plainly marked .{1,80}? the name of the author may not be used to endorse", 4, 0.9, "plainly marked"),
    ("bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 4, 0.97, "person or organization"),
    ("icu", r"provided that the above copyright notice s and this permission notice appear in all copies of the software", 4, 0.95, "permission notice appear"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 4, 0.97, "unicode data files"),
    ("afl", r"licensed under the academic free license", 4, 0.97, "academic free"),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct indirect special incidental", 4, 0.93, "university of california"),
    ("w3c", r"this work is being provided by the copyright holders under the following license", 3, 0.9, "this work is being provided"),
    ("w3c", r"w3c software notice and license", 4, 0.95, "w3c software"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", 3, 0.9, "accompanying software"),
    ("ms-rl", r"microsoft reciprocal license", 4, 0.97, "reciprocal license"),
    ("upl", r"the universal permissive license", 4, 0.95, "universal permissive"),
    ("mulan-psl", r"mulan (?:permissive software license|psl)", 4, 0.95, "mulan"),
    ("bluoak", r"blue oak model license", 4, 0.97, "blue oak"),
    ("zpl", r"this software consists of contributions made by zope corporation", 4, 0.95, "zope"),
    ("naist", r"use reproduction and distribution of this software is permitted any copy of this software", 4, 0.9, "reproduction and distribution of this software"),
    # Apache and patents
    ("apache-2.0", r"you may not use this file except in compliance with the license", 4, 0.93, "in compliance with"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 4, 0.93, "agreed to in writing"),
    ("apache-2.0", r"see the license for the specific language governing permissions and limitations under the license", 4, 0.93, "specific language governing"),
    ("apache-2.0", r"apache license version 2 0 january 2004", 4, 0.98, "january 2004"),
    ("apache-2.0", r"terms and conditions for use reproduction and distribution 1 definitions license shall mean", 4, 0.97, "license shall mean"),
    ("apache-2.0", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants", 4, 0.95, "grant of patent license"),
    ("llvm-exception", r"llvm exceptions to the apache 2 0 license", 4, 0.97, "llvm exceptions"),
    ("ecl", r"educational community license", 4, 0.97, "educational community"),
    # General public family
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 3, 0.93, "free software"),
    ("gpl", r"this program is free software you can redistribute it and or modify", 3, 0.85, "free software"),
    ("gpl-2", r"either version 2 of the license or (?:at your option )?any later version", 3, 0.9, "either version 2"),
    ("gpl-3", r"either version 3 of the license or (?:at your option )?any later version", 3, 0.9, "either version 3"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 3, 0.9, "changing it is not allowed"),
    ("gpl-1", r"gnu general public license version 1 february 1989", 4, 0.98, "february 1989"),
    ("gpl-2", r"gnu general public license version 2 june 1991", 4, 0.98, "june 1991"),
    ("gpl-3", r"gnu general public license version 3 29 june 2007", 4, 0.98, "29 june 2007"),
    ("gpl-2", r"this general public license does not permit incorporating your program into proprietary programs", 4, 0.93, "incorporating your program"),
    ("gpl-2", r"activities other than copying distribution and modification are not covered by this license", 4, 0.93, "activities other than copying"),
    ("gpl-3", r"you may convey verbatim copies of the program s source code as you receive it", 4, 0.95, "convey verbatim copies"),
    ("gpl-3", r"no covered work shall be deemed part of an effective technological measure", 4, 0.95, "technological measure"),
    ("gpl-3", r"each contributor grants you a non exclusive worldwide royalty free patent license under the contributor s essential patent claims", 4, 0.95, "essential patent claims"),
    ("lgpl", r"this library is free software you can redistribute it and or modify", 4, 0.95, "free software"),
    ("lgpl-2", r"gnu library general public license version 2 june 1991", 4, 0.98, "library general"),
    ("lgpl-2.1", r"gnu lesser general public license version 2 1 february 1999", 4, 0.98, "february 1999"),
    ("lgpl-3", r"gnu lesser general public license version 3 29 june 2007", 4, 0.98, "lesser general"),
    ("lgpl-2.1", r"either version 2 1 of the license or (?:at your option )?any later version", 4, 0.93, "either version 2 1"),
    ("lgpl-3", r"the library refers to a covered work governed by this license other than an application or a combined work", 4, 0.95, "combined work"),
    ("agpl-3", r"gnu affero general public license version 3 19 november 2007", 4, 0.98, "affero"),
    ("agpl-3", r"your modified version must prominently offer all users interacting with it remotely through a computer network", 4, 0.97, "interacting with it remotely"),
    ("gpl-classpath", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules", 4, 0.97, "independent modules"),
    ("gpl-gcc-exception", r"gcc runtime library exception", 4, 0.97, "runtime library exception"),
    ("gpl-openssl-exception", r"permission to link the code of portions of this program with the openssl library", 4, 0.97, "portions of this program with the openssl"),
    ("gpl-font-exception", r"if you create a document which uses this font and embed this font", 4, 0.95, "embed this font"),
    ("gpl-bison-exception", r"you may create a larger work that contains part or all of the bison parser skeleton", 4, 0.97, "bison parser"),
    ("linux-syscall-note", r"this copyright does not cover user programs that use kernel services by normal system calls", 4, 0.97, "normal system calls"),
    ("fdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 4, 0.97, "modify this document"),
    ("fdl", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts", 4, 0.95, "invariant sections"),
    ("fdl-1.3", r"gnu free documentation license version 1 3 3 november 2008", 4, 0.98, "november 2008"),
    # File-based and network copyleft
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", 4, 0.95, "source code form"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", 4, 0.97, "copy of the mpl"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", 4, 0.98, "contents of this file"),
    ("mpl-1.1", r"the contents of this file may be used under the terms of either the gnu general public license version 2 or later", 3, 0.85, "contents of this file"),
    ("mpl-2.0-no-copyleft", r"this source code form is incompatible with secondary licenses", 4, 0.97, "secondary licenses"),
    ("npl", r"netscape public license", 4, 0.95, "netscape"),
    ("epl-1.0", r"the accompanying program is provided under the terms of this eclipse public license", 4, 0.97, "accompanying program is provided"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0", 4, 0.97, "accompanying materials"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0", 4, 0.97, "accompanying materials"),
    ("edl", r"eclipse distribution license (?:v ?)?1 0", 4, 0.97, "eclipse"),
    ("cpl", r"the accompanying program is provided under the terms of this common public license", 4, 0.97, "common public"),
    ("ipl", r"ibm public license", 4, 0.95, "ibm public"),
    ("cddl", r"the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license", 4, 0.97, "contents of this file"),
    ("apsl", r"apple public source license", 4, 0.97, "apple public"),
    ("rpl", r"reciprocal public license", 4, 0.97, "reciprocal public"),
    ("cpal", r"common public attribution license", 4, 0.97, "public attribution"),
    ("osl", r"licensed under the open software license version", 4, 0.95, "open software"),
    ("eupl", r"licensed under the eupl", 4, 0.95, "under the eupl"),
    ("artistic-1", r"the intent of this document is to state the conditions under which a package may be copied", 4, 0.97, "package may be copied"),
    ("artistic-2", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package", 4, 0.97, "free software package"),
    ("perl", r"this (?:library|program|module) is free software you can redistribute it and or modify it under the same terms as perl itself", 4, 0.97, "as perl itself"),
    ("ruby", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", 4, 0.9, "under either the terms"),
    ("psf", r"psf is making python available to licensee on an as is basis", 4, 0.97, "psf is making"),
    ("psf", r"python software foundation license version 2", 4, 0.97, "python software foundation"),
    ("cnri", r"cnri open source license agreement", 4, 0.97, "cnri"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 4, 0.97, "redistributions in any form"),
    ("qpl", r"you may copy this license but not modify it the intent of this license", 3, 0.85, "intent of this license"),
    ("lppl", r"this work may be distributed and or modified under the conditions of the latex project public license", 4, 0.97, "latex project"),
    ("lppl", r"this work has the lppl maintenance status", 4, 0.97, "lppl"),
    ("ofl", r"this font software is licensed under the sil open font license", 4, 0.97, "font software"),
    ("ofl", r"the font software may be sold as part of a larger software package", 4, 0.93, "font software"),
    ("ofl", r"with reserved font name", 4, 0.9, "reserved font name"),
    # Source-available and restricted
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", 4, 0.97, "as a service"),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 4, 0.97, "non production use"),
    ("busl", r"change date .{1,60}? change license", 3, 0.85, "change license"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", 4, 0.97, "hosted or managed service"),
    ("commons-clause", r"the software is provided to you by the licensor under the license as defined below subject to the following condition", 4, 0.95, "licensor under the license"),
    ("commons-clause", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software", 4, 0.97, "right to sell the software"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) license", 4, 0.97, "polyform"),
    ("rail", r"(?:open ?rail|responsible ai license)", 3, 0.9, "rail|responsible ai"),
    ("llama", r"llama [234](?: [0-9])? community license agreement", 4, 0.97, "community license agreement"),
    ("non-commercial", r"(?:for )?non ?commercial use only", 2, 0.8, "commercial"),
    ("non-commercial", r"you may not use the material for commercial purposes", 4, 0.93, "commercial purposes"),
    ("no-derivatives", r"(?:may not|must not) be (?:reproduced|redistributed|copied)", 2, 0.7, "not be reproduced|not be redistributed|not be copied"),
    ("no-derivatives", r"if you remix transform or build upon the material you may not distribute the modified material", 4, 0.95, "build upon the material"),
    ("evaluation", r"for evaluation purposes only", 2, 0.8, "evaluation purposes"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 2, 0.8, "proprietary"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|distribution) .{0,60}?(?:prohibited|forbidden)", 2, 0.8, "unauthori"),
    ("proprietary", r"this (?:file|software|document) contains (?:proprietary|confidential) information", 3, 0.85, "proprietary|confidential"),
    ("proprietary", r"you may not reverse engineer decompile or disassemble the software", 3, 0.85, "reverse engineer"),
    ("proprietary", r"no part of this (?:publication|book|document|work) may be reproduced", 3, 0.85, "may be reproduced"),
    ("eula", r"by (?:installing|downloading|using|clicking) .{1,80}? you agree to (?:be bound by )?the terms of this (?:license|agreement|eula)", 3, 0.9, "you agree to"),
    ("eula", r"end user license agreement", 3, 0.9, "end user"),
    # Works other than software
    ("cc-by", r"this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international|unported|generic)? ?license", 4, 0.95, "creative commons"),
    ("cc-by-sa", r"you must distribute your contributions under the same license as the original", 4, 0.93, "contributions under the same"),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 3, 0.9, "appropriate credit"),
    ("cc-by-nc", r"you may not exercise any of the rights granted .{1,60}? primarily intended for .{0,30}?commercial advantage", 4, 0.93, "commercial advantage"),
    ("gfdl-cc", r"text is available under the creative commons attribution share ?alike license", 4, 0.95, "text is available under"),
    ("odbl", r"this database is made available under the open database license", 4, 0.97, "this database is made"),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents license", 4, 0.97, "database contents license"),
    ("ogl", r"contains public sector information licensed under the open government licen[cs]e", 4, 0.97, "public sector information"),
    ("us-government", r"this is a work of the (?:u s|united states) government and is not subject to copyright protection", 4, 0.95, "not subject to copyright"),
    ("us-government", r"restricted rights legend use duplication or disclosure by the government", 4, 0.9, "restricted rights legend"),
    ("gutenberg", r"this ebook is for the use of anyone anywhere .{0,80}?at no cost and with almost no restrictions whatsoever", 4, 0.97, "this ebook is for"),
    # Notices
    ("reserved", r"(?:all|some|no) rights (?:are )?reserved", 1, 0.6, "reserved"),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 1, 0.5, "copyright"),
    ("copyright", r"(?:alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)", 1, 0.6, "vorbehalten|droits|derechos"),
    ("see-license", r"see (?:the )?(?:accompanying )?(?:file )?(?:license|copying|licence)(?: txt| md)? (?:file )?for (?:the )?(?:full |more )?(?:details|license|information|terms|copyright)", 2, 0.6, "license|licence|copying"),
    ("see-license", r"use of this source code is governed by an? .{1,40}? license that can be found in the license file", 3, 0.85, "source code is governed"),
)
LEVELS = 4


def signatures() -> list[tuple[str, str, int, float, str]]:
    """All (keyword, pattern, priority, weight, label): families by identifier, grant and name, then the texts."""
    out = []
    for label, spdx, name, keyword in FAMILIES:
        for wording, priority, weight, key in WORDINGS:
            body = wording.replace("{id}", f"(?:{spdx})").replace("{name}", name)
            out.append((key if key == "spdx" else keyword, body, priority, weight, label))
    out += [(key, body, priority, weight, label) for label, body, priority, weight, key in TEXTS]
    return [(k, rf"(?i)(?<= )(?:{body})(?= )", p, w, label) for k, body, p, w, label in out]


def gate() -> str:
    """A pattern over the word form that finds any keyword, grouped by first letters."""
    by_first: dict[str, list[str]] = {}
    for key in sorted({k for keys, *_ in signatures() for k in keys.split("|")}):
        by_first.setdefault(key[0], []).append(key[1:])
    return "(?i)" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())


def word_form(text: Column) -> Column:
    """The words with a blank before, between and after; one blank for none."""
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.trim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" "))))


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """array<struct(start, end)> in words of the leftmost matches."""
    return places(
        words,
        pattern,
        _blanks,
        # The form begins with a blank: the first word has one before it.
        lambda at, length, *_: F.struct((at - 1).alias("start"), (at + length).alias("end")),
    )


_FOUND = "array<struct<start:int,minus_end:int,minus_priority:int,label:string,weight:double>>"


def _base(words: Column) -> Column:
    """Places of the base phrases; their words are disjoint, so one scan finds all."""
    out = []
    for phrase, label in BASE:
        pattern = F.lit(rf"(?i)(?<= ){phrase}(?= )")
        places = F.transform(
            _places(words, pattern),
            lambda x: F.struct(
                x["start"].alias("start"), (-x["end"]).alias("minus_end"), F.lit(-1).alias("minus_priority"),
            ),
        )
        out.append(F.transform(places, _labelled(label)).cast(_FOUND))
    any_ = "(?i)" + "|".join(f" {p} " for p, _ in BASE)
    return F.when(words.rlike(any_), F.array_sort(F.concat(*out))).otherwise(F.array().cast(_FOUND))


def _labelled(label: str):
    return lambda x: F.struct(
        x["start"], x["minus_end"], x["minus_priority"], F.lit(label).alias("label"), F.lit(BASE_WEIGHT).alias("weight")
    )


def _detections(words: Column, low: Column) -> Column:
    rules = signatures()
    by_key: dict[str, list] = {}
    for key, *rest in rules:
        by_key.setdefault(key, []).append(tuple(rest))
    table = F.array(
        *[
            F.struct(
                F.array(*[F.lit(w) for w in key.split("|")]).alias("keys"),
                F.array(
                    *[
                        F.struct(F.lit(p).alias("p"), F.lit(-q).alias("q"), F.lit(w).alias("w"), F.lit(s).alias("s"))
                        for p, q, w, s in members
                    ]
                ).alias("rules"),
            )
            for key, members in by_key.items()
        ]
    )
    due = F.filter(table, lambda k: F.exists(k["keys"], lambda w: F.contains(low, w)))
    tried = F.flatten(F.transform(due, lambda k: k["rules"]))

    def hits(r: Column) -> Column:
        return F.transform(
            _places(words, r["p"]),
            lambda x: F.struct(
                x["start"].alias("start"), (-x["end"]).alias("minus_end"), r["q"].alias("minus_priority"),
                r["s"].alias("label"), r["w"].alias("weight"),
            ),
        )

    return F.array_sort(F.flatten(F.transform(tried, hits))).cast(_FOUND)


def _unsuppressed(found: Column) -> Column:
    """Detections not inside an earlier-sorted one of the same or a higher priority.

    Sorted by start, then longest first: whatever contains a detection stands
    before it, so a running maximum of ends per priority decides in one pass.
    """

    def decide(x: Column) -> Column:
        reach = []
        for level in range(1, LEVELS + 1):
            ends = F.transform(
                x, lambda y: F.when(-y["minus_priority"] >= level, -y["minus_end"]).otherwise(0)
            )
            reach.append(running(ends, F.lit(0), lambda a, b: F.greatest(a, b)))
        return let(
            F.array(*reach),
            lambda r: F.filter(x, lambda y, i: F.get(F.get(r, -y["minus_priority"] - 1), i) < -y["minus_end"]),
        )

    return let(found, decide)


def find_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, base and detections (sorted arrays), labels and score.

    Null texts count as empty; texts without words have no places; repeated
    rows are scanned as they are; an empty table gives an empty result. The
    score is the largest weight of a base place or kept detection, else 0. All
    columns are kept but those named like a result, which are replaced.
    """
    results = ("n_words", "base", "detections", "base_labels", "labels", "score")
    kept = [c for c in docs.columns if c not in results]
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(_FOUND)
    shaped = docs.select(*kept, word_form(body).alias("_words"))
    found = shaped.withColumns(
        {
            "n_words": (_blanks(F.col("_words")) - 1).cast("long"),
            "base": _base(F.col("_words")),
            "detections": F.when(
                F.col("_words").rlike(gate()), _unsuppressed(_detections(F.col("_words"), F.lower(F.col("_words"))))
            ).otherwise(none),
        }
    )
    base_labels = F.transform("base", lambda x: x["label"])
    labels = F.concat(base_labels, F.transform("detections", lambda x: x["label"]))
    weights = F.transform(F.concat("base", "detections"), lambda x: x["weight"])
    return found.withColumns(
        {
            "base_labels": F.array_join(F.array_sort(F.array_distinct(base_labels)), ","),
            "labels": F.array_join(F.array_sort(F.array_distinct(labels)), ","),
            "score": F.coalesce(F.array_max(weights), F.lit(0.0)),
        }
    ).drop("_words")
