"""Signature rules written by hand: bodies, notices, headers, addresses, foreign notices, exclusions.

A pattern is matched against lower-case words with single blanks between them.  ``_`` between two
words stands for a few words of any kind (a holder's name, a title).  The keyword after it occurs
in every text that the pattern accepts; it opens the gate for the rule.
"""

from __future__ import annotations

#: Words that ``_`` may stand for.
GAP = r"(?:[^ ]+ ){0,12}?"

#: form: (priority, confidence).  Exclusions come first: they remove detections that they cover.
FORM = {
    "exclusion": (110, 0.0),
    "body": (95, 0.98),
    "notice": (90, 0.95),
    "header": (75, 0.9),
    "address": (70, 0.85),
    "foreign": (65, 0.8),
}

#: (label, form, pattern, keyword).
SIGNATURES: list[tuple[str, str, str, str]] = [
    # phrases that name a license without granting it
    ("", "exclusion", r"(?:not|never) (?:be )?(?:licensed|released|distributed|covered|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?[^ ]+ (?:general |public |software )*licen[sc]e", " licen"),
    ("", "exclusion", r"(?:incompatible|not compatible|in conflict) with (?:the )?(?:gnu )?[^ ]+ (?:general |public |software )*licen[sc]e", " licen"),
    ("", "exclusion", r"(?:unlike|rather than|instead of|compared (?:to|with)) (?:the )?(?:gnu )?[^ ]+ (?:general |public |software )*licen[sc]e", " licen"),
    ("", "exclusion", r"mit licen[sc]e plates?", " mit licen"),
    ("", "exclusion", r"public domain (?:name|names|suffix|suffixes)", " public domain "),
    # MIT and its relatives
    ("mit", "body", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", " permission is hereby granted free of charge "),
    ("mit", "body", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", " this permission notice "),
    ("mit", "body", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", " software is provided as is "),
    ("mit", "body", r"the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", " copyright holders be liable "),
    ("mit", "address", r"opensource org licenses mit(?: license)?(?: php| html)?", " opensource org licenses mit "),
    ("x11", "body", r"except as contained in this notice the names? of _shall not be used in advertising or otherwise to promote the sale", " except as contained in this notice "),
    ("mit-advertising", "body", r"all advertising materials mentioning _must display the above copyright notice", " all advertising materials "),
    ("json", "body", r"the software shall be used for good not evil", " used for good not evil "),
    ("isc", "body", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", " with or without fee is hereby granted "),
    ("0bsd", "body", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", " with or without fee is hereby granted "),
    ("isc", "body", r"(?:the author|isc|internet systems consortium) disclaims all warranties with regard to this software", " disclaims all warranties "),
    ("curl", "address", r"curl (?:haxx )?se docs copyright(?: html)?", " docs copyright "),
    ("hpnd", "body", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted provided that", " software and its documentation for any purpose "),
    ("hpnd", "header", r"historical permission notice and disclaimer", " historical permission notice "),
    ("ntp", "body", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", " software and its documentation for any purpose "),
    ("postgresql", "body", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", " without a written agreement "),
    ("tcl", "body", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", " authors hereby grant permission "),
    ("unicode", "body", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", " permission is hereby granted free of charge "),
    ("unicode", "header", r"unicode (?:inc )?licen[sc]e (?:agreement|v3)", " unicode "),
    ("w3c", "body", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", " by obtaining using and or copying "),
    ("w3c", "header", r"w3c software (?:and document )?notice and licen[sc]e", " w3c software "),
    ("bsl-1.0", "body", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", " permission is hereby granted free of charge "),
    ("bsl-1.0", "header", r"boost software license version 1 0 august 17th 2003", " boost software "),
    ("bsl-1.0", "address", r"(?:www )?boost org license 1 0(?: txt)?", " boost org license "),
    ("upl-1.0", "header", r"universal permissive license(?: upl)?(?: version| v)? ?1 0", " universal permissive "),
    ("blueoak-1.0.0", "header", r"blue oak model license(?: version)?(?: 1 0 0)?", " blue oak model "),
    ("mulan-2.0", "header", r"mulan (?:psl|permissive software license)(?: version| v)? ?v?2", " mulan "),
    # Apache
    ("apache-2.0", "notice", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", " under the apache license "),
    ("apache-2.0", "notice", r"licensed to the apache software foundation asf under one or more contributor license agreements", " apache software foundation "),
    ("apache-2.0", "body", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", " unless required by applicable law "),
    ("apache-2.0", "body", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", " each contributor hereby grants to you "),
    ("apache-2.0", "body", r"derivative works shall mean any work whether in source or object form that is based on or derived from the work", " derivative works shall mean "),
    ("apache-2.0", "header", r"apache license version 2 0 january 2004", " apache license "),
    ("apache-2.0", "address", r"(?:www )?apache org licenses license 2 0(?: txt| html)?", " apache org licenses "),
    ("apache-1.1", "body", r"the end user documentation included with the redistribution if any must include the following acknowledge?ment", " end user documentation "),
    ("apache-1.0", "body", r"this product includes software developed by the apache (?:group|software foundation)", " includes software developed by the apache "),
    # BSD
    ("bsd", "body", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", " redistribution and use in source "),
    ("bsd", "body", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", " redistributions of source code "),
    ("bsd", "body", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", " redistributions in binary form "),
    ("bsd-3-clause", "body", r"neither the names? of _nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software", " to endorse or promote products "),
    ("bsd-4-clause", "body", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", " all advertising materials "),
    ("bsd-3-clause-clear", "body", r"no express or implied licenses to any party s patent rights are granted by this license", " patent rights are granted "),
    ("bsd", "notice", r"use of this source code is governed by a bsd style license that can be found in the license file", " governed by a bsd style "),
    ("bsd-2-clause", "address", r"opensource org licenses bsd 2 clause", " licenses bsd 2 "),
    ("bsd-3-clause", "address", r"opensource org licenses bsd 3 clause", " licenses bsd 3 "),
    ("bsd-2-clause-views", "body", r"should not be interpreted as representing official policies either expressed or implied of", " representing official policies "),
    # the GNU family
    ("gpl-2.0-or-later", "notice", r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", " general public license as published "),
    ("gpl-3.0-or-later", "notice", r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", " general public license as published "),
    ("gpl-2.0-only", "notice", r"under the terms of the gnu general public license (?:version 2 )?as published by the free software foundation(?: version 2)?(?! either)", " general public license "),
    ("gpl", "notice", r"you should have received a copy of the gnu general public license along with", " copy of the gnu general "),
    ("gpl-1.0", "header", r"gnu general public license version 1 february 1989", " general public license version 1 "),
    ("gpl-2.0", "header", r"gnu general public license version 2 june 1991", " general public license version 2 "),
    ("gpl-3.0", "header", r"gnu general public license version 3 29 june 2007", " general public license version 3 "),
    ("gpl", "body", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change", " take away your freedom "),
    ("gpl", "body", r"this general public license applies to most of the free software foundation s software", " this general public license "),
    ("gpl-3.0", "body", r"you may convey verbatim copies of the program s source code as you receive it", " you may convey verbatim copies "),
    ("gpl-2.0", "body", r"you may copy and distribute verbatim copies of the program s source code as you receive it", " distribute verbatim copies of the program "),
    ("gnu", "body", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", " verbatim copies of this license document "),
    ("gpl-2.0", "address", r"(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html| en html)?", " gpl 2 0 "),
    ("gpl-3.0", "address", r"(?:www )?gnu org licenses gpl 3 0(?: txt| html| en html)?", " gpl 3 0 "),
    ("gpl", "address", r"(?:www )?gnu org (?:licenses|copyleft) gpl(?: txt| html)?", " gpl "),
    ("lgpl-2.0-or-later", "notice", r"under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version", " library general public license "),
    ("lgpl-2.1-or-later", "notice", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", " lesser general public license "),
    ("lgpl-3.0-or-later", "notice", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", " lesser general public license "),
    ("lgpl", "notice", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", " copy of the gnu l"),
    ("lgpl-2.0", "header", r"gnu library general public license version 2 june 1991", " library general public license "),
    ("lgpl-2.1", "header", r"gnu lesser general public license version 2 1 february 1999", " lesser general public license "),
    ("lgpl-3.0", "header", r"gnu lesser general public license version 3 29 june 2007", " lesser general public license "),
    ("lgpl-2.1", "body", r"this is the first released version of the lesser gpl", " version of the lesser gpl "),
    ("lgpl", "address", r"(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: 2 1| 3 0)?(?: txt| html)?", " lgpl "),
    ("agpl-3.0-or-later", "notice", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", " affero general public license "),
    ("agpl-3.0", "header", r"gnu affero general public license version 3 19 november 2007", " affero general public license "),
    ("agpl-3.0", "body", r"your modified version must prominently offer all users interacting with it remotely through a computer network", " users interacting with it remotely "),
    ("agpl", "address", r"(?:www )?gnu org licenses agpl(?: 3 0)?(?: txt| html)?", " agpl "),
    ("gfdl", "notice", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", " free documentation "),
    ("gfdl", "header", r"gnu free documentation license version 1 (?:1 march 2000|2 november 2002|3 3 november 2008)", " free documentation "),
    ("gfdl", "address", r"(?:www )?gnu org (?:licenses|copyleft) fdl(?: 1 3)?(?: txt| html)?", " fdl "),
    ("classpath-exception-2.0", "body", r"linking this library statically or dynamically with other modules is making a combined work based on this library", " linking this library statically "),
    ("gcc-exception-3.1", "header", r"gcc runtime library exception(?: version 3 1)?", " gcc runtime library "),
    ("autoconf-exception", "body", r"if you distribute this file as part of a program that contains a configuration script generated by autoconf", " script generated by autoconf "),
    ("bison-exception", "body", r"you may create a larger work that contains part or all of the bison parser skeleton", " bison parser skeleton "),
    ("libtool-exception", "body", r"if you distribute this file as part of a program or library that is built using gnu libtool", " built using gnu libtool "),
    ("linux-syscall-note", "body", r"this copyright does not cover user programs that use kernel services by normal system calls", " use kernel services "),
    ("openssl-exception", "body", r"permission to link the code of portions of this program with the openssl library", " with the openssl library "),
    # Mozilla, Eclipse, Sun, IBM
    ("mpl-2.0", "notice", r"this source code form is subject to the terms of the mozilla public license v 2 0", " this source code form is subject "),
    ("mpl-2.0", "notice", r"if a copy of the mpl was not distributed with this file you can obtain one at", " copy of the mpl "),
    ("mpl-2.0", "body", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", " incompatible with secondary licenses "),
    ("mpl-2.0", "address", r"(?:www )?mozilla org (?:en us )?mpl 2 0", " mpl 2 0 "),
    ("mpl-1.1", "notice", r"the contents of this file are subject to the mozilla public license version 1 1", " subject to the mozilla public "),
    ("mpl-1.0", "notice", r"the contents of this file are subject to the mozilla public license version 1 0", " subject to the mozilla public "),
    ("mpl-1.1", "address", r"(?:www )?mozilla org mpl(?: mpl 1 1)?(?: html)?(?! 2)", " mozilla org mpl "),
    ("npl-1.1", "header", r"netscape public license(?: version 1 [01])?", " netscape public "),
    ("epl-1.0", "notice", r"made available under the terms of the eclipse public license v ?1 0", " eclipse public license "),
    ("epl-2.0", "notice", r"made available under the terms of the eclipse public license (?:v ?)?2 0", " eclipse public license "),
    ("epl-1.0", "address", r"(?:www )?eclipse org (?:org documents|legal) epl v10(?: html)?", " epl v10 "),
    ("epl-2.0", "address", r"(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?", " eclipse org legal epl "),
    ("edl-1.0", "header", r"eclipse distribution license(?: v)?(?: 1 0)?", " eclipse distribution "),
    ("cddl-1.0", "notice", r"the contents of this file are subject to the terms of the common development and distribution license", " common development and distribution "),
    ("cddl-1.1", "header", r"common development and distribution license cddl version 1 1", " common development and distribution "),
    ("cpl-1.0", "notice", r"made available under the terms of the common public license v ?1 0", " common public license "),
    ("ipl-1.0", "header", r"ibm public license version 1 0", " ibm public "),
    ("sissl", "header", r"sun industry standards source license", " sun industry standards "),
    ("bcl", "header", r"(?:sun microsystems inc|oracle) binary code license agreement", " binary code license agreement "),
    ("otn", "header", r"oracle technology network license agreement", " oracle technology network "),
    ("apsl-2.0", "header", r"apple public source license(?: version)?(?: 2 0)?", " apple public source "),
    ("lpl-1.02", "header", r"lucent public license(?: version)?(?: 1 02)?", " lucent public "),
    ("nokia", "header", r"nokia open source license", " nokia open source "),
    # scripting languages and libraries
    ("artistic-1.0", "body", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", " semblance of artistic control "),
    ("artistic-2.0", "body", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", " given free software package "),
    ("artistic-1.0-perl", "notice", r"(?:redistribute it and or modify it )?under the same terms as perl(?: 5)?(?: itself)?", " same terms as perl "),
    ("python-2.0", "header", r"python software foundation license version 2", " python software foundation "),
    ("python-2.0", "body", r"psf hereby grants licensee a nonexclusive royalty free world wide license", " psf hereby grants licensee "),
    ("cnri-python", "body", r"cnri hereby grants licensee a nonexclusive royalty free world wide license", " cnri hereby grants licensee "),
    ("php-3.01", "notice", r"this source file is subject to version 3 01? of the php license", " of the php license "),
    ("php-3.01", "body", r"this product includes php software freely available from", " includes php software "),
    ("zend-2.0", "header", r"zend (?:engine )?license(?: version 2 00)?", " zend "),
    ("ruby", "notice", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl version 2)", " under either the terms of the "),
    ("vim", "header", r"vim license", " vim license "),
    ("zlib", "body", r"in no event will the authors be held liable for any damages arising from the use of this software", " authors be held liable "),
    ("zlib", "body", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", " must not be misrepresented "),
    ("zlib", "body", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", " altered source versions "),
    ("libpng", "body", r"the png reference library is supplied as is", " png reference library "),
    ("libpng-2.0", "header", r"png reference library license version 2", " png reference library "),
    ("libtiff", "body", r"the names of sam leffler and silicon graphics may not be used in any advertising", " sam leffler "),
    ("ijg", "body", r"this software is based in part on the work of the independent jpeg group", " independent jpeg group "),
    ("ftl", "header", r"(?:the )?freetype (?:project )?license", " freetype "),
    ("openssl", "body", r"this product includes software developed by the openssl project for use in the openssl toolkit", " developed by the openssl project "),
    ("ssleay", "body", r"this product includes cryptographic software written by eric young", " cryptographic software written by eric "),
    ("icu", "header", r"icu license icu 1 8 1 and later", " icu license "),
    ("sleepycat", "header", r"sleepycat (?:public )?license", " sleepycat "),
    ("zpl-2.1", "header", r"zope public license(?: zpl)?(?: version)?(?: 2 [01])?", " zope public "),
    ("qpl-1.0", "header", r"q public license(?: version)?(?: 1 0)?", " q public "),
    ("qt-commercial", "notice", r"licensees holding valid commercial qt licenses may use this file", " valid commercial qt licenses "),
    ("lppl-1.3c", "notice", r"this work may be distributed and or modified under the conditions of the latex project public license", " latex project public "),
    ("lppl", "header", r"latex project public license(?: version)?(?: 1 [0-3]c?)?", " latex project public "),
    ("afl-3.0", "header", r"academic free license(?: version| v)? ?3 0", " academic free "),
    ("afl-2.1", "header", r"academic free license(?: version| v)? ?2 [01]", " academic free "),
    ("osl-3.0", "header", r"open software license(?: version| v)? ?3 0", " open software license"),
    ("ecl-2.0", "header", r"educational community license(?: version)?(?: 2 0)?", " educational community "),
    ("wxwindows", "header", r"wxwindows library licen[sc]e", " wxwindows library "),
    ("rpl-1.5", "header", r"reciprocal public license(?: version)?(?: 1 [15])?", " reciprocal public "),
    ("ncsa", "header", r"university of illinois ncsa open source license", " university of illinois "),
    ("nasa-1.3", "header", r"nasa open source agreement(?: version)?(?: 1 3)?", " nasa open source "),
    ("beerware", "body", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", " buy me a beer "),
    ("beerware", "header", r"the beer ?ware license(?: revision 42)?", " beer"),
    ("wtfpl", "body", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", " verbatim or modified copies "),
    # public domain and creative works
    ("unlicense", "body", r"this is free and unencumbered software released into the public domain", " free and unencumbered software "),
    ("unlicense", "body", r"anyone is free to copy modify publish use compile sell or distribute this software", " anyone is free to copy modify "),
    ("unlicense", "address", r"unlicense org", " unlicense org "),
    ("cc0-1.0", "body", r"the person who associated a work with this deed has dedicated the work to the public domain", " associated a work with this deed "),
    ("cc0-1.0", "body", r"no copyright the laws of most jurisdictions throughout the world automatically confer exclusive copyright", " automatically confer exclusive copyright "),
    ("cc0-1.0", "header", r"cc0 1 0 universal", " cc0 1 0 universal "),
    ("cc0-1.0", "address", r"creativecommons org publicdomain zero 1 0", " creativecommons org publicdomain zero "),
    ("pdm", "address", r"creativecommons org publicdomain mark 1 0", " creativecommons org publicdomain mark "),
    ("public-domain", "notice", r"(?:placed|released|dedicated|put) (?:in|into|to) the public domain", " the public domain "),
    ("cc-by", "address", r"creativecommons org licenses by [1-4] [05]", " creativecommons org licenses by "),
    ("cc-by-sa", "address", r"creativecommons org licenses by sa [1-4] [05]", " creativecommons org licenses by sa "),
    ("cc-by-nd", "address", r"creativecommons org licenses by nd [1-4] [05]", " creativecommons org licenses by nd "),
    ("cc-by-nc", "address", r"creativecommons org licenses by nc [1-4] [05]", " creativecommons org licenses by nc "),
    ("cc-by-nc-sa", "address", r"creativecommons org licenses by nc sa [1-4] [05]", " creativecommons org licenses by nc sa "),
    ("cc-by-nc-nd", "address", r"creativecommons org licenses by nc nd [1-4] [05]", " creativecommons org licenses by nc nd "),
    ("cc-by-4.0", "header", r"creative commons attribution 4 0 international(?: public)?(?: license)?", " creative commons attribution "),
    ("cc-by-sa-4.0", "header", r"creative commons attribution share ?alike 4 0 international(?: public)?(?: license)?", " creative commons attribution share"),
    ("cc-by-sa-3.0", "header", r"creative commons attribution share ?alike 3 0 (?:unported|generic)(?: license)?", " creative commons attribution share"),
    ("cc-by-nd-4.0", "header", r"creative commons attribution no ?deriv(?:ative)?s 4 0 international(?: public)?(?: license)?", " creative commons attribution no"),
    ("cc-by-nc-4.0", "header", r"creative commons attribution non ?commercial 4 0 international(?: public)?(?: license)?", " creative commons attribution non"),
    ("cc-by-nc-sa-4.0", "header", r"creative commons attribution non ?commercial share ?alike 4 0 international(?: public)?(?: license)?", " creative commons attribution non"),
    ("cc-by-nc-nd-4.0", "header", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0 international(?: public)?(?: license)?", " creative commons attribution non"),
    ("cc-by-sa", "notice", r"text is available under the creative commons attribution share ?alike license", " under the creative commons "),
    ("gutenberg", "notice", r"you may copy it give it away or re use it under the terms of the project gutenberg license", " project gutenberg license "),
    ("ofl-1.1", "notice", r"this font software is licensed under the sil open font license version 1 1", " this font software is licensed "),
    ("ofl-1.1", "address", r"scripts sil org ofl", " scripts sil org ofl "),
    ("odbl-1.0", "header", r"open data commons open database license(?: odbl)?(?: version| v)?(?: 1 0)?", " open data commons "),
    ("odc-by-1.0", "header", r"open data commons attribution license(?: odc by)?(?: version| v)?(?: 1 0)?", " open data commons "),
    ("pddl-1.0", "header", r"(?:open data commons )?public domain dedication and licen[sc]e", " public domain dedication "),
    ("odc", "address", r"opendatacommons org licenses (?:odbl|by|pddl)(?: 1 0)?", " opendatacommons org licenses "),
    ("cdla-permissive-2.0", "header", r"community data license agreement permissive(?: version)?(?: [12] 0)?", " community data license "),
    ("cdla-sharing-1.0", "header", r"community data license agreement sharing(?: version)?(?: 1 0)?", " community data license "),
    ("ogl-uk-3.0", "header", r"open government licen[sc]e(?: version| v)?(?: ?[123] 0)?", " open government "),
    ("etalab-2.0", "foreign", r"licence ouverte(?: open licence)?(?: version| v)?(?: ?2 0)?", " licence ouverte"),
    # source-available and model licenses
    ("busl-1.1", "body", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", " non production use "),
    ("busl-1.1", "header", r"business source license 1 1", " business source "),
    ("sspl-1.0", "header", r"server side public license version 1 october 16 2018", " server side public "),
    ("sspl-1.0", "body", r"if you make the functionality of the program or a modified version available to third parties as a service", " to third parties as a service "),
    ("elastic-2.0", "header", r"elastic license(?: version)?(?: 2 0)?", " elastic license "),
    ("elastic-2.0", "body", r"you may not provide the software to third parties as a hosted or managed service", " hosted or managed service "),
    ("commons-clause", "header", r"commons clause license condition(?: v)?(?: ?1 0)?", " commons clause "),
    ("commons-clause", "body", r"without limiting other conditions in the license the grant of rights under the license will not include", " limiting other conditions "),
    ("polyform", "header", r"polyform (?:noncommercial|shield|small business|perimeter|strict|internal use|free trial) license(?: 1 0 0)?", " polyform "),
    ("confluent", "header", r"confluent community license(?: agreement)?(?: version 1 0)?", " confluent community "),
    ("redis-sal", "header", r"redis source available license(?: agreement)?", " redis source available "),
    ("timescale", "header", r"timescale license agreement", " timescale license "),
    ("fsl", "header", r"functional source license(?: version)?(?: 1 1)?", " functional source "),
    ("openrail", "header", r"(?:creativeml |bigscience |bigcode )?openrail(?: [mds])?(?: license)?", " openrail "),
    ("bigscience-rail", "header", r"bigscience rail license(?: v)?(?: ?1 0)?", " bigscience rail "),
    ("llama-2", "header", r"llama [234](?: [0-9])? community license(?: agreement)?", " community license "),
    ("hippocratic", "header", r"hippocratic license(?: version)?(?: [123] [01])?", " hippocratic license "),
    ("anti-996", "header", r"anti 996 license(?: version)?(?: 1 0)?", " anti 996 "),
    ("prosperity", "header", r"prosperity public license(?: 3 0 0)?", " prosperity public "),
    ("parity", "header", r"parity public license(?: 7 0 0)?", " parity public "),
    ("ms-pl", "body", r"this license governs use of the accompanying software if you use the software you accept this license", " governs use of the accompanying software "),
    ("ms-eula", "header", r"microsoft software license terms", " microsoft software license "),
    ("nvidia", "header", r"nvidia software license agreement", " nvidia software license "),
    ("intel-issl", "header", r"intel simplified software license", " intel simplified "),
    ("eula", "header", r"end user licen[sc]e agreement", " end user licen"),
    # European licenses and notices in other languages
    ("eupl-1.2", "notice", r"licensed under the eupl(?: version)?(?: 1 2)?", " licensed under the eupl "),
    ("eupl", "address", r"joinup ec europa eu (?:software page eupl|collection eupl)", " joinup ec europa eu "),
    ("cecill-2.1", "header", r"cecill (?:free software )?license(?: agreement)?(?: version 2 [01])?", " cecill "),
    ("cecill", "foreign", r"(?:contrat de )?licence de logiciel libre cecill(?: [bc])?(?: version 2 [01])?", " logiciel libre cecill "),
    ("d-fsl", "foreign", r"deutsche freie software lizenz", " deutsche freie software "),
    ("gpl", "foreign", r"(?:unter|gemäß) (?:der|den bedingungen der) gnu (?:general public license|gpl)", " gnu g"),
    ("gpl", "foreign", r"sous (?:la )?licence (?:publique générale gnu|gnu gpl|gpl)", " licence "),
    ("gpl", "foreign", r"bajo (?:la )?licencia (?:pública general de gnu|gnu gpl|gpl)", " licencia "),
    ("mit", "foreign", r"unter der mit lizenz", " mit lizenz "),
    ("mit", "foreign", r"sous (?:la )?licence mit", " licence mit "),
    ("mit", "foreign", r"bajo (?:la )?licencia mit", " licencia mit "),
    ("apache-2.0", "foreign", r"(?:unter der apache lizenz|sous (?:la )?licence apache|bajo (?:la )?licencia apache)(?: version)? 2(?: 0)?", " apache"),
    ("cc", "foreign", r"(?:unter (?:einer|der) creative commons lizenz|sous (?:une )?licence creative commons|bajo (?:una )?licencia creative commons)", " creative commons "),
    ("proprietary", "foreign", r"alle rechte vorbehalten", " alle rechte vorbehalten "),
    ("proprietary", "foreign", r"tous droits réservés", " tous droits réservés "),
    ("proprietary", "foreign", r"todos los derechos reservados", " todos los derechos reservados "),
    # no license
    ("proprietary", "notice", r"this software is the confidential and proprietary information of", " confidential and proprietary "),
    ("proprietary", "notice", r"unauthorized (?:copying|use|reproduction|distribution)(?: or (?:copying|use|reproduction|distribution))? of this (?:file|software|document|material) (?:via any medium )?is (?:strictly )?prohibited", " unauthorized "),
    ("proprietary", "notice", r"no part of this (?:publication|book|document|work) may be reproduced (?:stored|distributed|or transmitted|copied)", " no part of this "),
    ("proprietary", "notice", r"licensed materials property of", " licensed materials property "),
    ("proprietary", "notice", r"contains trade secrets (?:of|belonging to)", " contains trade secrets "),
    ("proprietary", "notice", r"contains proprietary information (?:of|belonging to)", " contains proprietary information "),
    ("proprietary", "notice", r"for internal use only", " for internal use only "),
    ("research-only", "notice", r"for (?:non ?commercial )?research purposes only", " research purposes only "),
]
