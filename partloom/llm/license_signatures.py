"""Signatures of licences, each written by hand for one sentence, notice, identifier or address.

Patterns read words in lower case (A-Z only) joined by single blanks: ``2.0`` reads ``2 0``
and ``as-is`` reads ``as is``. Each rule names a keyword that every match contains.
"""

from __future__ import annotations

#: Fixed rules: rule, label, priority, weight, keyword, pattern.
SIGNATURES = [
    # Sentences of licence texts.
    ("mit-notice-kept", "mit", 91, 0.9, "above copyright notice and this permission notice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit-deal", "mit", 91, 0.9, "to deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit-disclaimer", "mit", 88, 0.7, "the software is provided as is without warranty", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-no-attribution", "mit-0", 94, 1.0, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11-name", "x11", 93, 1.0, "x consortium shall not be used", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-advertising", "mit", 85, 0.7, "advertising materials", r"permission notice shall be included .{0,80}advertising materials"),
    ("json-good-evil", "json", 95, 1.0, "good not evil", r"the software shall be used for good not evil"),
    ("bsd-source", "bsd", 91, 0.9, "redistributions of source code", r"redistributions of source code must retain the (?:above )?copyright notice(?: this list of conditions and the following disclaimer)?"),
    ("bsd-binary", "bsd", 91, 0.9, "redistributions in binary form", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-endorse", "bsd-3-clause", 93, 1.0, "endorse or promote products", r"(?:neither the names? of .{1,120} nor the names of (?:its|their|any) contributors|the names? of .{1,120}) may (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-advertising", "bsd-4-clause", 94, 1.0, "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-patent", "bsd-2-clause-patent", 94, 1.0, "subject to the terms and conditions of this license each copyright holder", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants"),
    ("bsd-clear", "bsd-3-clause-clear", 95, 1.0, "no express or implied licenses to any party s patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-disclaimer", "bsd", 86, 0.7, "this software is provided by the", r"this software is provided by the (?:copyright holders?|author|regents|contributors)(?: and contributors)? as is and any express or implied warranties"),
    ("bsd-zero", "0bsd", 95, 1.0, "with or without fee is hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc-notice-kept", "isc", 90, 0.9, "appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-disclaimer", "isc", 87, 0.7, "disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("ntp-text", "ntp", 90, 0.9, "specific written prior permission", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("hpnd-text", "hpnd", 89, 0.9, "permission to use copy modify and distribute this software and its documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: is hereby granted)? (?:is hereby granted )?without fee"),
    ("zlib-text", "zlib", 92, 1.0, "in no event will the authors be held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-origin", "zlib", 92, 1.0, "must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib-altered", "zlib", 91, 0.9, "altered source versions", r"altered source versions must be plainly marked as such"),
    ("libpng-text", "libpng", 93, 1.0, "png reference library", r"the png reference library is supplied as is"),
    ("ijg-text", "ijg", 93, 1.0, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("openssl-text", "openssl", 94, 1.0, "openssl project", r"this product includes software developed by the openssl project(?: for use in the openssl toolkit)?"),
    ("ssleay-text", "openssl", 94, 1.0, "eric young", r"this product includes (?:cryptographic )?software written by eric young"),
    ("apache-grant", "apache-2.0", 92, 1.0, "each contributor hereby grants to you a perpetual", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except as stated)"),
    ("apache-compliance", "apache-2.0", 94, 1.0, "except in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-as-is", "apache-2.0", 91, 0.9, "distributed on an as is basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-governs", "apache-2.0", 85, 0.6, "governing permissions and limitations", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-notice-file", "apache-2.0", 86, 0.7, "notice text file", r"if the work includes a notice text file as part of its distribution"),
    ("apache-appendix", "apache-2.0", 89, 0.9, "how to apply the apache license", r"how to apply the apache license to your work"),
    ("apache-asf", "apache", 88, 0.9, "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1-ack", "apache-1.1", 93, 1.0, "developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl-share-change", "gpl", 91, 1.0, "freedom to share and change", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("gpl-hope", "gpl", 87, 0.8, "in the hope that it will be useful", r"is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-later", "gpl", 88, 0.9, "at your option any later version", r"either version [123] of the license or at your option any later version"),
    ("gpl-copy-received", "gpl", 90, 1.0, "you should have received a copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with this"),
    ("lgpl-copy-received", "lgpl", 92, 1.0, "you should have received a copy of the gnu l", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this"),
    ("agpl-copy-received", "agpl", 92, 1.0, "you should have received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public license along with this"),
    ("agpl-text", "agpl", 94, 1.0, "gnu affero general public license", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-network", "agpl-3", 93, 1.0, "interacting with it remotely", r"users interacting with it remotely through a computer network"),
    ("gpl-2-only", "gpl-2", 93, 1.0, "version 2", r"under the terms of (?:the gnu general public license version 2|version 2 of the gnu general public license) (?:only )?as published by the free software foundation"),
    ("gpl-3-tivo", "gpl-3", 90, 0.9, "installation information", r"installation information for a user product means"),
    ("gpl-verbatim", "gpl", 80, 0.5, "copy and distribute verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-warranty-notice", "gpl", 84, 0.8, "absolutely no warranty", r"comes with absolutely no warranty"),
    ("gpl-linking", "gpl-linking-exception", 95, 1.0, "as a special exception", r"as a special exception the copyright holders of this (?:library|program) give you permission to link"),
    ("gpl-classpath", "gpl-classpath-exception", 96, 1.0, "classpath", r"(?:gnu )?(?:general public license|gpl)(?: version 2| v2| 2)?(?: only)? with (?:the )?classpath exception"),
    ("gpl-gcc", "gcc-exception", 96, 1.0, "gcc runtime library exception", r"gcc runtime library exception(?: version 3 1)?"),
    ("gpl-bison", "bison-exception", 96, 1.0, "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-font", "font-exception", 95, 1.0, "font exception", r"(?:general public license|gpl) with (?:the )?font exception"),
    ("lgpl-library", "lgpl", 89, 0.9, "work that uses the library", r"a work that uses the library"),
    ("gfdl-invariant", "gfdl", 93, 1.0, "no invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl-text", "gfdl", 94, 1.0, "free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1-notice", "mpl-1.1", 94, 1.0, "subject to the mozilla public license", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2-notice", "mpl-2.0", 95, 1.0, "subject to the terms of the mozilla public license", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-incompatible", "mpl-2.0", 93, 1.0, "incompatible with secondary licenses", r"this source code form is incompatible with secondary licenses"),
    ("mpl-tri", "mpl-1.1", 96, 1.0, "mpl 1 1 gpl 2 0 lgpl 2 1", r"mpl 1 1 gpl 2 0 lgpl 2 1"),
    ("npl-notice", "npl", 94, 1.0, "netscape public license", r"(?:subject to the )?netscape public license(?: version 1 [01])?"),
    ("cddl-notice", "cddl", 94, 1.0, "common development and distribution license", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-notice", "epl", 94, 1.0, "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("edl-notice", "edl-1.0", 94, 1.0, "eclipse distribution license", r"eclipse distribution license(?: v| version)? ?1 0"),
    ("cpl-notice", "cpl", 94, 1.0, "common public license", r"the accompanying materials are made available under the terms of the common public license"),
    ("ipl-name", "ipl", 70, 0.9, "ibm public license", r"ibm public license(?: version)?(?: 1 0)?"),
    ("artistic-package", "artistic", 91, 1.0, "state the conditions under which a package may be copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("perl-same", "artistic", 90, 0.9, "same terms as perl", r"under the same terms as perl(?: 5| itself)?"),
    ("boost-text", "boost-1.0", 94, 1.0, "distributed under the boost software license", r"distributed under the boost software license version 1 0"),
    ("boost-machine-code", "boost", 92, 1.0, "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense-text", "unlicense", 94, 1.0, "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-heirs", "unlicense", 92, 1.0, "detriment of our heirs", r"for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl-text", "wtfpl", 92, 1.0, "do what the fuck you want to", r"you just do what the fuck you want to"),
    ("beerware-text", "beerware", 93, 1.0, "buy me a beer", r"(?:if we meet some day and you think this stuff is worth it )?you can buy me a beer in return"),
    ("postgresql-text", "postgresql", 93, 1.0, "without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("python-psf-text", "python", 92, 1.0, "psf hereby grants licensee", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("python-beopen", "python", 92, 1.0, "beopen", r"beopen(?: python open source license agreement| com hereby grants licensee)"),
    ("python-cnri", "cnri-python", 92, 1.0, "cnri", r"cnri (?:open source )?(?:license agreement|hereby grants licensee)"),
    ("php-text", "php", 94, 1.0, "includes php", r"this product includes php(?: software)? freely available from"),
    ("php-file", "php", 94, 1.0, "subject to version 3", r"this source file is subject to version 3 0?1? ?of the php license"),
    ("ruby-text", "ruby", 90, 0.9, "same terms as ruby", r"under the same terms as ruby(?: itself)?"),
    ("ruby-license", "ruby", 70, 0.9, "ruby license", r"ruby license"),
    ("tcl-text", "tcl", 91, 1.0, "existing copyright notices are retained", r"provided that existing copyright notices are retained in all copies and that this notice is included verbatim"),
    ("curl-text", "curl", 91, 0.9, "permission to use copy modify and distribute this software for any purpose with or without fee", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("unicode-text", "unicode", 92, 1.0, "unicode data files", r"to any person obtaining a copy of the unicode data files"),
    ("icu-license", "icu", 70, 0.9, "icu license", r"icu license"),
    ("w3c-text", "w3c", 92, 1.0, "w3c software", r"w3c software (?:and document )?(?:notice and )?license"),
    ("ofl-text", "ofl-1.1", 94, 1.0, "font software is licensed under the sil", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-reserved", "ofl", 91, 0.9, "reserved font name", r"with reserved font name"),
    ("bitstream-text", "bitstream-vera", 92, 1.0, "bitstream vera", r"bitstream vera (?:fonts copyright|is a trademark of bitstream)"),
    ("ubuntu-font", "ubuntu-font", 70, 0.9, "ubuntu font licence", r"ubuntu font licence(?: version)?(?: 1 0)?"),
    ("ftl-text", "freetype", 93, 1.0, "freetype", r"portions of this software are copyright .{1,40} the freetype project"),
    ("freetype-license", "freetype", 70, 0.9, "freetype", r"(?:the )?freetype (?:project )?licen[cs]e"),
    ("ncsa-text", "ncsa", 92, 1.0, "deal with the software without restriction", r"to deal with the software without restriction"),
    ("llvm-exception", "llvm-exception", 96, 1.0, "llvm exception", r"(?:apache license v2 0 |apache 2 0 )?with llvm exceptions?"),
    ("sleepycat", "sleepycat", 93, 1.0, "sleepycat", r"sleepycat (?:public )?license"),
    ("qpl-text", "qpl", 91, 0.9, "you may copy this software under the terms of the q", r"you may copy this software under the terms of the q public license"),
    ("opl-text", "opl", 91, 0.9, "open publication license", r"open publication license(?: v| version)? ?(?:1 0|0 4)?"),
    ("eupl-notice", "eupl", 94, 1.0, "licensed under the eupl", r"licensed under the eupl(?: version 1 [012])?"),
    ("cecill-notice", "cecill", 93, 1.0, "governed by the cecill", r"this software is governed by the cecill(?: [abc])? license under french law"),
    ("osl-notice", "osl", 94, 1.0, "licensed under the open software license", r"licensed under the open software license version 3 0"),
    ("afl-notice", "afl", 94, 1.0, "licensed under the academic free license", r"licensed under the academic free license version [23] [01]"),
    ("rpl-name", "rpl", 70, 0.9, "reciprocal public license", r"reciprocal public license(?: 1 [15])?"),
    ("apsl-name", "apsl", 70, 0.9, "apple public source license", r"apple public source license(?: version)?(?: [12] [012])?"),
    ("lpl-name", "lucent", 70, 0.9, "lucent public license", r"lucent public license(?: version)?(?: 1 0 ?2?)?"),
    ("lppl-name", "lppl", 70, 0.9, "latex project public license", r"latex project public license(?: version)?(?: 1 [0-3]c?)?"),
    ("lppl-text", "lppl", 93, 1.0, "under the conditions of the latex project", r"may be distributed and or modified under the conditions of the latex project public license"),
    ("spl-name", "spl", 70, 0.9, "sun public license", r"sun public license(?: version)?(?: 1 0)?"),
    ("sissl-name", "sissl", 70, 0.9, "sun industry standards source license", r"sun industry standards source license(?: version)?(?: 1 [12])?"),
    ("cpal-name", "cpal", 70, 0.9, "common public attribution license", r"common public attribution license(?: version)?(?: 1 0)?"),
    ("motosoto-name", "motosoto", 70, 0.9, "motosoto", r"motosoto open source license"),
    ("nokia-name", "nokia", 70, 0.9, "nokia open source license", r"nokia open source license"),
    ("realnetworks-name", "rpsl", 70, 0.9, "realnetworks public source license", r"realnetworks public source license(?: version)?(?: 1 0)?"),
    ("ricoh-name", "ricoh", 70, 0.9, "ricoh source code public license", r"ricoh source code public license"),
    ("sybase-name", "sybase", 70, 0.9, "sybase open watcom", r"sybase open watcom public license"),
    ("nasa-name", "nasa", 70, 0.9, "nasa open source agreement", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("multics-name", "multics", 70, 0.9, "multics license", r"multics license"),
    ("naumen-name", "naumen", 70, 0.9, "naumen public license", r"naumen public license"),
    ("entessa-name", "entessa", 70, 0.9, "entessa public license", r"entessa public license"),
    ("fair-text", "fair", 92, 1.0, "usage of the works is permitted", r"usage of the works is permitted provided that this instrument is retained with the works"),
    ("blueoak-name", "blueoak", 70, 0.9, "blue oak model license", r"blue oak model license(?: 1 0 0)?"),
    ("parity-name", "parity", 70, 0.9, "parity public license", r"(?:the )?parity public license(?: [67] 0 0)?"),
    ("prosperity-name", "prosperity", 70, 0.9, "prosperity public license", r"(?:the )?prosperity public license(?: [23] 0 0)?"),
    ("hippocratic-name", "hippocratic", 70, 0.9, "hippocratic license", r"hippocratic license(?: [123] [01])?"),
    ("anti996-name", "anti-996", 70, 0.9, "anti 996 license", r"anti 996 license"),
    ("commons-clause", "commons-clause", 95, 1.0, "commons clause", r"commons clause(?: license)? condition(?: v1 0)?"),
    ("commons-clause-sell", "commons-clause", 94, 1.0, "does not grant to you the right to sell", r"does not grant to you the right to sell the software"),
    ("sspl-service", "sspl", 93, 1.0, "functionality of the program or a modified version", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("bsl-change", "bsl", 93, 1.0, "change date", r"(?:on the )?change date or the fourth anniversary of the first publicly available distribution"),
    ("bsl-grant", "bsl", 92, 0.9, "additional use grant", r"additional use grant"),
    ("elastic-managed", "elastic", 93, 1.0, "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("confluent-name", "confluent", 70, 0.9, "confluent community license", r"confluent community license(?: agreement)?(?: version 1 0)?"),
    ("timescale-name", "timescale", 70, 0.9, "timescale license", r"timescale license(?: agreement)?"),
    ("redis-name", "rsal", 70, 0.9, "redis source available license", r"redis source available license(?: 2 0)?"),
    ("fsl-name", "fsl", 70, 0.9, "functional source license", r"functional source license(?: version 1 [01])?"),
    # Creative Commons and open data.
    ("cc-human-by", "cc-by", 92, 1.0, "creative commons attribution", r"licensed under (?:a |the )?creative commons attribution (?:[1-4] [05] )?(?:international|unported|generic)(?: license)?"),
    ("cc-human-sa", "cc-by-sa", 97, 1.0, "attribution share", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?"),
    ("cc-human-nc", "cc-by-nc", 97, 1.0, "non commercial", r"creative commons attribution non commercial(?: [1-4] [05])?(?: (?:international|unported|generic))?"),
    ("cc-human-nc-sa", "cc-by-nc-sa", 98, 1.0, "non commercial share", r"creative commons attribution non commercial share ?alike(?: [1-4] [05])?"),
    ("cc-human-nc-nd", "cc-by-nc-nd", 98, 1.0, "non commercial no deriv", r"creative commons attribution non commercial no deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-human-nd", "cc-by-nd", 97, 1.0, "attribution no deriv", r"creative commons attribution no deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-zero-waive", "cc0", 95, 1.0, "waived all copyright", r"waived all copyright and related or neighboring rights"),
    ("cc-zero-dedicate", "cc0", 94, 1.0, "dedicated the work to the public domain", r"has dedicated the work to the public domain"),
    ("cc-mark", "cc-pdm", 93, 1.0, "public domain mark", r"(?:creative commons )?public domain mark(?: 1 0)?"),
    ("cc-sampling", "cc-sampling", 90, 0.9, "sampling plus", r"creative commons sampling plus(?: 1 0)?"),
    ("cc-some-rights", "cc", 44, 0.6, "some rights reserved", r"some rights reserved"),
    ("cc-url-by", "cc-by", 93, 1.0, "creativecommons org licenses by", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-url-by-sa", "cc-by-sa", 94, 1.0, "creativecommons org licenses by sa", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-url-by-nc", "cc-by-nc", 94, 1.0, "creativecommons org licenses by nc", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-url-by-nd", "cc-by-nd", 94, 1.0, "creativecommons org licenses by nd", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-url-by-nc-sa", "cc-by-nc-sa", 95, 1.0, "creativecommons org licenses by nc sa", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-url-by-nc-nd", "cc-by-nc-nd", 95, 1.0, "creativecommons org licenses by nc nd", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-url-zero", "cc0", 94, 1.0, "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero 1 0"),
    ("cc-url-mark", "cc-pdm", 94, 1.0, "creativecommons org publicdomain mark", r"creativecommons org publicdomain mark 1 0"),
    ("odbl-text", "odbl", 94, 1.0, "open database license", r"made available under the open database license"),
    ("odbl-contents", "dbcl", 93, 1.0, "database contents license", r"(?:licensed under the )?database contents license(?: 1 0)?"),
    ("odc-by-text", "odc-by", 94, 1.0, "open data commons attribution license", r"made available under the open data commons attribution license"),
    ("pddl-text", "pddl", 93, 1.0, "public domain dedication and licen", r"public domain dedication and licen[cs]e"),
    ("ogl-uk", "ogl-uk", 92, 1.0, "open government licen", r"open government licen[cs]e(?: v| version)? ?(?:[123] 0)?"),
    ("ogl-crown", "ogl-uk", 80, 0.6, "crown copyright", r"crown copyright"),
    ("etalab", "etalab", 92, 1.0, "licence ouverte", r"licence ouverte(?: open licence)?(?: version)?(?: [12] 0)?"),
    ("dl-de", "dl-de", 92, 1.0, "datenlizenz deutschland", r"datenlizenz deutschland(?: namensnennung| zero)?(?: version)?(?: [12] 0)?"),
    ("cdla-permissive", "cdla-permissive", 92, 1.0, "community data license agreement", r"community data license agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing", "cdla-sharing", 92, 1.0, "community data license agreement", r"community data license agreement sharing(?: version)?(?: 1 0)?"),
    ("gutenberg", "gutenberg", 92, 1.0, "project gutenberg license", r"(?:under the )?terms of the project gutenberg license"),
    ("gutenberg-use", "gutenberg", 93, 1.0, "this ebook is for the use of anyone", r"this ebook is for the use of anyone anywhere"),
    # Models.
    ("rail-use", "rail", 92, 1.0, "use based restrictions", r"use based restrictions(?: set forth| as referenced)?"),
    ("bigscience-rail", "bigscience-rail", 93, 1.0, "bigscience", r"bigscience (?:bloom )?(?:open )?rail(?: m)?(?: license)?(?: v1 0)?"),
    ("bigcode-rail", "bigcode-rail", 93, 1.0, "bigcode", r"bigcode open ?rail m(?: license)?(?: agreement)?"),
    ("gemma-terms", "gemma", 92, 1.0, "gemma terms of use", r"gemma terms of use"),
    ("research-only", "research-only", 60, 0.7, "research purposes only", r"for (?:non commercial |academic )?research purposes only"),
    ("non-commercial-use", "non-commercial", 58, 0.7, "non commercial use only", r"for (?:personal )?(?:and )?non commercial use only"),
    # Identifiers.
    ("spdx-mit", "mit", 97, 1.0, "spdx license identifier mit", r"spdx license identifier mit"),
    ("spdx-apache", "apache-2.0", 97, 1.0, "spdx license identifier apache", r"spdx license identifier apache 2 0"),
    ("spdx-gpl-2", "gpl-2", 97, 1.0, "spdx license identifier gpl", r"spdx license identifier gpl 2 0(?: only| or later)?"),
    ("spdx-gpl-3", "gpl-3", 97, 1.0, "spdx license identifier gpl", r"spdx license identifier gpl 3 0(?: only| or later)?"),
    ("spdx-lgpl", "lgpl", 97, 1.0, "spdx license identifier lgpl", r"spdx license identifier lgpl [23] [01](?: only| or later)?"),
    ("spdx-agpl", "agpl-3", 97, 1.0, "spdx license identifier agpl", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("spdx-bsd-2", "bsd-2-clause", 97, 1.0, "spdx license identifier bsd", r"spdx license identifier bsd 2 clause"),
    ("spdx-bsd-3", "bsd-3-clause", 97, 1.0, "spdx license identifier bsd", r"spdx license identifier bsd 3 clause"),
    ("spdx-0bsd", "0bsd", 97, 1.0, "spdx license identifier 0bsd", r"spdx license identifier 0bsd"),
    ("spdx-isc", "isc", 97, 1.0, "spdx license identifier isc", r"spdx license identifier isc"),
    ("spdx-mpl", "mpl-2.0", 97, 1.0, "spdx license identifier mpl", r"spdx license identifier mpl 2 0"),
    ("spdx-epl", "epl-2.0", 97, 1.0, "spdx license identifier epl", r"spdx license identifier epl 2 0"),
    ("spdx-cc0", "cc0", 97, 1.0, "spdx license identifier cc0", r"spdx license identifier cc0 1 0"),
    ("spdx-cc-by", "cc-by", 97, 1.0, "spdx license identifier cc by", r"spdx license identifier cc by [1-4] 0"),
    ("spdx-unlicense", "unlicense", 97, 1.0, "spdx license identifier unlicense", r"spdx license identifier unlicense"),
    ("spdx-zlib", "zlib", 97, 1.0, "spdx license identifier zlib", r"spdx license identifier zlib"),
    ("spdx-bsl", "boost-1.0", 97, 1.0, "spdx license identifier bsl", r"spdx license identifier bsl 1 0"),
    ("spdx-ref", "other", 97, 0.6, "spdx license identifier licenseref", r"spdx license identifier licenseref(?: [0-9a-z]+)?"),
    # Fields of package descriptions.
    ("field-mit", "mit", 75, 0.9, "license mit", r"license mit"),
    ("field-apache", "apache-2.0", 75, 0.9, "license apache", r"license apache(?: license)? ?2 0"),
    ("field-bsd", "bsd", 75, 0.9, "license bsd", r"license bsd(?: [23] clause)?"),
    ("field-gpl-2", "gpl-2", 75, 0.9, "license gpl", r"license gpl ?v?2(?: 0)?"),
    ("field-gpl-3", "gpl-3", 75, 0.9, "license gpl", r"license gpl ?v?3(?: 0)?"),
    ("field-osi-mit", "mit", 78, 1.0, "osi approved mit", r"license osi approved mit license"),
    ("field-osi-bsd", "bsd", 78, 1.0, "osi approved bsd", r"license osi approved bsd license"),
    ("field-osi-apache", "apache", 78, 1.0, "osi approved apache", r"license osi approved apache software license"),
    ("field-osi-gpl", "gpl", 78, 1.0, "osi approved gnu general", r"license osi approved gnu general public license v[23](?: or later)? gplv[23]"),
    # Addresses.
    ("url-apache", "apache-2.0", 90, 1.0, "apache org licenses", r"(?:www )?apache org licenses license 2 0"),
    ("url-gpl", "gpl", 80, 0.9, "gnu org licenses gpl", r"(?:www )?gnu org licenses gpl(?: 3 0| 2 0)?"),
    ("url-lgpl", "lgpl", 80, 0.9, "gnu org licenses lgpl", r"(?:www )?gnu org licenses lgpl(?: 3 0| 2 1)?"),
    ("url-agpl", "agpl", 80, 0.9, "gnu org licenses agpl", r"(?:www )?gnu org licenses agpl(?: 3 0)?"),
    ("url-fdl", "gfdl", 80, 0.9, "gnu org licenses fdl", r"(?:www )?gnu org licenses fdl(?: 1 3)?"),
    ("url-gnu", "gpl", 45, 0.5, "gnu org licenses", r"see (?:https? )?(?:www )?gnu org licenses"),
    ("url-mpl", "mpl-2.0", 90, 1.0, "mozilla org mpl", r"mozilla org mpl 2 0"),
    ("url-epl", "epl", 90, 1.0, "eclipse org legal epl", r"eclipse org legal epl (?:v10|2 0|v20)"),
    ("url-mit", "mit", 90, 1.0, "opensource org licenses mit", r"opensource org licenses mit(?: license)?"),
    ("url-bsd", "bsd", 90, 1.0, "opensource org licenses bsd", r"opensource org licenses bsd(?: [23] clause| license)?"),
    ("url-osi", "osi", 45, 0.5, "opensource org licenses", r"opensource org licenses [0-9a-z]+"),
    ("url-unlicense", "unlicense", 90, 1.0, "unlicense org", r"unlicense org"),
    ("url-boost", "boost-1.0", 90, 1.0, "boost org license", r"boost org license 1 0 txt"),
    ("url-ofl", "ofl", 90, 1.0, "scripts sil org ofl", r"scripts sil org ofl"),
    ("url-wtfpl", "wtfpl", 90, 1.0, "wtfpl net", r"(?:www )?wtfpl net"),
    ("url-odbl", "odbl", 90, 1.0, "opendatacommons org licenses odbl", r"opendatacommons org licenses odbl(?: 1 0)?"),
    # Notices of owners.
    ("all-rights-owner", "proprietary", 26, 0.5, "all rights reserved", r"copyright (?:c )?(?:[0-9]{4} )(?:[^ ]+ ){1,6}all rights reserved"),
    ("confidential", "proprietary", 60, 0.8, "confidential and proprietary", r"confidential and proprietary(?: information)?(?: of)?"),
    ("unauthorized-copy", "proprietary", 62, 0.9, "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("no-reproduction", "proprietary", 62, 0.9, "may be reproduced", r"no part of this (?:publication|book|work|document|website) may be reproduced"),
    ("reprint-permission", "proprietary", 55, 0.7, "reprinted with", r"reprinted with (?:the )?permission"),
    ("eula", "eula", 55, 0.7, "end user license agreement", r"end user license agreement"),
    ("personal-use", "non-commercial", 55, 0.6, "for personal use only", r"for personal use only"),
    ("dual-license", "dual", 40, 0.5, "dual licensed", r"dual licensed(?: under)?"),
    ("gov-work", "public-domain", 85, 0.9, "work of the united states government", r"(?:this is )?a work of the united states government"),
    ("gov-usc", "public-domain", 84, 0.8, "not subject to copyright protection", r"not subject to copyright protection(?: in the united states)?"),
    ("public-domain-hereby", "public-domain", 86, 0.9, "hereby place", r"hereby placed? (?:this|it|the) ?(?:work|code|file|software)? ?in(?:to)? the public domain"),
]
