"""Ordered license signature rules.

Rules see a text as its lower-cased words joined by single spaces, so that case,
punctuation and line breaks do not matter. A rule has a label, a regex, a
priority and a weight; families of rules share keywords that gate them. A
family's keywords are derived from all spellings of its names, so that the gate
never hides a match. There are 83 names, each in five ``FORMS`` of use, and 163
signatures of texts and notices: 246 patterns written by hand, 578 rules.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

# The base phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Per family (label, names of the license as regexes over words).
# More exact names come first. Names use only literals, ``|``, ``(?:)``, ``[]`` and ``?``.
FAMILIES: tuple[tuple[tuple[str, str], ...], ...] = (
    (
        ("mit-0", r"mit no attribution(?: license)?|mit 0"),
        ("mit", r"mit(?: x11)? licen[sc]e|mit x11|expat licen[sc]e|mit style licen[sc]e"),
    ),
    (
        ("apache-2", r"apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?|apache v?2 0|apache 2 licen[sc]e"),
        ("apache-1.1", r"apache(?: software)? licen[sc]e(?: version)? v?1 1|apache v?1 1"),
        ("apache-1.0", r"apache(?: software)? licen[sc]e(?: version)? v?1 0|apache v?1 0"),
    ),
    (
        ("agpl-3", r"(?:gnu )?affero general public licen[sc]e(?: as published by the free software foundation either)?(?: version)? v?3(?: 0)?|agpl(?: version)? ?v?3(?: 0)?"),
        ("agpl-1", r"affero general public licen[sc]e(?: version)? v?1(?: 0)?|agpl(?: version)? ?v?1(?: 0)?"),
    ),
    (
        ("lgpl-3", r"(?:gnu )?lesser general public licen[sc]e(?: as published by the free software foundation either)?(?: version)? v?3(?: 0)?|lgpl(?: version)? ?v?3(?: 0)?"),
        ("lgpl-2.1", r"(?:gnu )?lesser general public licen[sc]e(?: as published by the free software foundation either)?(?: version)? v?2 1|lgpl(?: version)? ?v?2 1"),
        ("lgpl-2", r"(?:gnu )?library general public licen[sc]e(?: as published by the free software foundation either)?(?: version)? v?2(?: 0)?|lgpl(?: version)? ?v?2(?: 0)?"),
    ),
    (
        ("gpl-3", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation either)?(?: version)? v?3(?: 0)?|(?:gnu )?gpl(?: version)? ?v?3(?: 0)?"),
        ("gpl-2", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation either)?(?: version)? v?2(?: 0)?|(?:gnu )?gpl(?: version)? ?v?2(?: 0)?"),
        ("gpl-1", r"(?:gnu )?general public licen[sc]e(?: version)? v?1(?: 0)?|(?:gnu )?gpl(?: version)? ?v?1(?: 0)?"),
    ),
    (
        ("gfdl-1.3", r"(?:gnu )?free documentation licen[sc]e(?: version)? v?1 3|gfdl(?: version)? ?v?1 3"),
        ("gfdl-1.2", r"(?:gnu )?free documentation licen[sc]e(?: version)? v?1 2|gfdl(?: version)? ?v?1 2"),
        ("gfdl", r"(?:gnu )?free documentation licen[sc]e|gfdl"),
    ),
    (
        ("bsd-4-clause", r"bsd 4 clause(?: original| old)?(?: licen[sc]e)?|4 clause bsd(?: licen[sc]e)?|original bsd licen[sc]e"),
        ("bsd-3-clause", r"bsd 3 clause(?: new| revised)?(?: licen[sc]e)?|3 clause bsd(?: licen[sc]e)?|(?:new|modified|revised) bsd licen[sc]e"),
        ("bsd-2-clause", r"bsd 2 clause(?: simplified| freebsd)?(?: licen[sc]e)?|2 clause bsd(?: licen[sc]e)?|(?:simplified|freebsd) bsd licen[sc]e"),
        ("0bsd", r"0bsd|bsd zero clause(?: licen[sc]e)?|zero clause bsd(?: licen[sc]e)?"),
        ("bsd", r"bsd(?: style)? licen[sc]e"),
    ),
    (
        ("mpl-2", r"mozilla public licen[sc]e(?: version)? v?2(?: 0)?|mpl(?: version)? ?v?2(?: 0)?"),
        ("mpl-1.1", r"mozilla public licen[sc]e(?: version)? v?1 1|mpl(?: version)? ?v?1 1"),
        ("mpl-1.0", r"mozilla public licen[sc]e(?: version)? v?1 0|mpl(?: version)? ?v?1 0"),
    ),
    (
        ("epl-2", r"eclipse public licen[sc]e(?: version)? v?2(?: 0)?|epl(?: version)? ?v?2 0"),
        ("epl-1", r"eclipse public licen[sc]e(?: version)? v?1(?: 0)?|epl(?: version)? ?v?1 0"),
        ("edl-1", r"eclipse distribution licen[sc]e(?: version)? v?1(?: 0)?"),
    ),
    (
        ("cddl-1.1", r"common development and distribution licen[sc]e(?: version)? v?1 1|cddl(?: version)? ?v?1 1"),
        ("cddl-1", r"common development and distribution licen[sc]e(?: version)? v?1(?: 0)?|cddl(?: version)? ?v?1(?: 0)?"),
        ("cpl-1", r"common public licen[sc]e(?: version)? v?1(?: 0)?"),
        ("cpal-1", r"common public attribution licen[sc]e(?: version)? v?1(?: 0)?"),
    ),
    (
        ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?"),
        ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
        ("cc-by-nc", r"cc by nc(?: [1-4] [05])?|creative commons attribution non ?commercial(?: [1-4] [05])?"),
        ("cc-by-nd", r"cc by nd(?: [1-4] [05])?|creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?"),
        ("cc-by-sa", r"cc by sa(?: [1-4] [05])?|creative commons attribution share ?alike(?: [1-4] [05])?"),
        ("cc-by", r"cc by(?: [1-4] [05])?|creative commons attribution(?: [1-4] [05])?(?: international)?"),
        ("cc0", r"cc0(?: 1 0)?|creative commons zero|cc zero"),
    ),
    (
        ("bsl-1.0", r"boost software licen[sc]e(?: version)?(?: v?1(?: 0)?)?|bsl 1 0"),
        ("busl-1.1", r"business source licen[sc]e(?: version)?(?: v?1 1)?|busl 1 1"),
    ),
    (("isc", r"isc licen[sc]e|internet systems consortium licen[sc]e"),),
    (
        ("zlib", r"zlib(?: libpng)? licen[sc]e"),
        ("libpng", r"libpng licen[sc]e(?: version 2)?"),
    ),
    (
        ("unlicense", r"the unlicense|unlicense licen[sc]e"),
        ("wtfpl", r"wtfpl(?: version)?(?: 2)?"),
        ("beerware", r"beer ?ware licen[sc]e(?: revision 42)?"),
    ),
    (
        ("artistic-2", r"artistic licen[sc]e(?: version)? v?2(?: 0)?"),
        ("artistic-1", r"artistic licen[sc]e(?: version)? v?1(?: 0)?|perl artistic licen[sc]e"),
        ("artistic", r"artistic licen[sc]e"),
    ),
    (
        ("psf-2", r"python software foundation licen[sc]e(?: version)?(?: 2)?|psf licen[sc]e(?: version)?(?: 2)?"),
        ("python-2", r"python licen[sc]e(?: version)? 2(?: 0)?"),
    ),
    (
        ("php-3.01", r"php licen[sc]e(?: version)? v?3 0?1"),
        ("php-3", r"php licen[sc]e(?: version)? v?3(?: 0)?"),
        ("ruby", r"ruby licen[sc]e"),
        ("postgresql", r"postgresql licen[sc]e"),
        ("openssl", r"openssl licen[sc]e"),
        ("curl", r"curl licen[sc]e"),
        ("ntp", r"ntp licen[sc]e"),
        ("unicode", r"unicode(?: inc)? licen[sc]e(?: agreement)?"),
        ("vim", r"vim licen[sc]e"),
    ),
    (
        ("eupl-1.2", r"european union public licen[sc]e(?: version)? v?1 2|eupl(?: version)? ?v?1 2"),
        ("eupl-1.1", r"european union public licen[sc]e(?: version)? v?1 1|eupl(?: version)? ?v?1 1"),
        ("eupl", r"european union public licen[sc]e|eupl"),
    ),
    (
        ("ms-pl", r"microsoft public licen[sc]e|ms pl"),
        ("ms-rl", r"microsoft reciprocal licen[sc]e|ms rl"),
    ),
    (
        ("afl-3", r"academic free licen[sc]e(?: version)?(?: v?3(?: 0)?)?|afl 3 0"),
        ("osl-3", r"open software licen[sc]e(?: version)?(?: v?3(?: 0)?)?|osl 3 0"),
        ("ecl-2", r"educational community licen[sc]e(?: version)?(?: v?2(?: 0)?)?"),
    ),
    (("ofl-1.1", r"(?:sil )?open font licen[sc]e(?: version)?(?: v?1 1)?|ofl 1 1"),),
    (
        ("odbl-1", r"open database licen[sc]e(?: version)?(?: v?1(?: 0)?)?|odbl(?: v?1(?: 0)?)?"),
        ("odc-by-1", r"open data commons attribution licen[sc]e(?: version)?(?: v?1(?: 0)?)?"),
        ("pddl-1", r"public domain dedication and licen[sc]e|pddl(?: 1 0)?"),
    ),
    (
        ("elastic-2", r"elastic licen[sc]e(?: version)?(?: v?2(?: 0)?)?"),
        ("sspl-1", r"server side public licen[sc]e(?: version)?(?: v?1)?|sspl(?: 1 0)?"),
    ),
    (
        ("cecill-2.1", r"cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: version)? v?2 1"),
        ("cecill", r"cecill(?: [bc])?(?: licen[sc]e)?"),
        ("mulan-psl-2", r"mulan psl v?2|mulan permissive software licen[sc]e(?: version)?(?: v?2)?"),
        ("qpl-1", r"q public licen[sc]e|qpl(?: 1 0)?"),
        ("sleepycat", r"sleepycat(?: software)? licen[sc]e"),
        ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
        ("w3c", r"w3c software(?: notice and)? licen[sc]e"),
        ("zpl-2.1", r"zope public licen[sc]e(?: version)?(?: v?2 1)?|zpl 2 1"),
        ("upl-1", r"universal permissive licen[sc]e(?: version)?(?: v?1(?: 0)?)?|upl 1 0"),
    ),
)

# Signatures of license texts and notices, (label, regex over words), written with the
# same means as names. None has an open gap: a signature is what stands together.
BODIES = (
    # Texts of permissive licenses.
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("hpnd", r"not be used in advertising or publicity pertaining to distribution of the software without specific(?: written)? prior permission"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided"),
    ("bsd-1-clause", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided"),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd-3-clause-clear", r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("bsd-2-clause-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this licen[sc]e a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("bsd-3-clause-no-nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", r"distributed under the boost software licen[sc]e version 1 0"),
    ("bsl-1.0", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("upl-1", r"the universal permissive licen[sc]e upl version 1 0 subject to the condition set forth below"),
    ("ncsa", r"developed by (?:the )?(?:university of illinois|ncsa)"),
    ("w3c", r"by obtaining using and or copying this (?:work|software) you the licensee agree(?: that you have read understood and will comply)?|w3c r? ?mit ercim keio"),
    ("openssl", r"this product includes software developed by the openssl project"),
    ("openssl-ssleay", r"this product includes cryptographic software written by eric young|ssleay licen[sc]e|eay cryptsoft com"),
    ("ftl", r"portions of this software are copyright (?:c )?the freetype project|the freetype project licen[sc]e"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", r"icu licen[sc]e icu 1 8 1 and later|icu licen[sc]e"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies curl"),
    ("coffee-ware", r"coffee ware licen[sc]e|buy me a coffee in return"),
    ("beerware", r"you can buy me a beer in return|buy me a beer in return"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e|you just do what the fuck you want to"),
    ("json", r"the software shall be used for good not evil"),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("psf-2", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e|psf is making python available to licensee on an as is basis"),
    ("python-2", r"beopen python open source licen[sc]e agreement|beopen com licen[sc]e agreement for python"),
    ("cnri-python", r"cnri licen[sc]e agreement|cnri open source licen[sc]e agreement|corporation for national research initiatives cnri"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation for any purpose tcl|tcl tk licen[sc]e"),
    ("ruby", r"you may redistribute and or modify it under either the terms of the (?:gpl|2 clause bsdl|bsdl) or the conditions below ruby|ruby is copyrighted free software"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("php-3.01", r"this product includes php software freely available from"),
    ("zend-2", r"this product includes the zend engine|zend engine licen[sc]e"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2", r"you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at https? www apache org licen[sc]es licen[sc]e 2 0"),
    ("apache-2", r"subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e"),
    ("apache-2-llvm-exception", r"apache licen[sc]e (?:version |v)?2 0 with llvm exceptions?|apache 2 0 with llvm exception|llvm exceptions to the apache 2 0 licen[sc]e"),
    ("apache-2-runtime-exception", r"licensed under apache licen[sc]e v2 0 with runtime library exception swift|runtime library exception to the apache 2 0 licen[sc]e swift"),
    # The GNU licenses and what goes with them.
    ("gpl", r"this (?:program|software|file|library) is free software(?: and)? you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2-or-later", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2"),
    ("gpl-3-or-later", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3"),
    ("gpl-2-only", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e(?: version 2)? as published by the free software foundation(?: version 2)? this program is distributed"),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("lgpl-2-or-later", r"you can redistribute it and or modify it under the terms of the gnu library general public licen[sc]e as published by the free software foundation either version 2"),
    ("lgpl-2.1-or-later", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1"),
    ("lgpl-3-or-later", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3"),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("agpl-3-or-later", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed"),
    ("gpl-3", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
    ("agpl-3", r"the gnu affero general public licen[sc]e is a free copyleft licen[sc]e"),
    ("gfdl", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("gfdl-1.3", r"gnu free documentation licen[sc]e(?: version)? 1 3|gfdl 1 3"),
    ("gfdl-1.2", r"gnu free documentation licen[sc]e(?: version)? 1 2|gfdl 1 2"),
    ("gfdl", r"gnu free documentation licen[sc]e"),
    ("classpath-exception-2", r"(?:with|and) (?:the )?classpath exception(?: 2 0)?|linking this library statically or dynamically with other modules is making a combined work based on this library classpath|gpl 2 0 with classpath exception"),
    ("classpath-exception-2", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable linking|linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception-3.1", r"gcc runtime library exception(?: version)?(?: 3 1)?|with gcc exception(?: 3 1| 2 0)?"),
    ("autoconf-exception", r"configuration script generated by autoconf you may include it under the same distribution terms|with autoconf exception(?: 2 0| 3 0)?"),
    ("bison-exception-2.2", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton|with bison exception(?: 2 2)?"),
    ("libtool-exception", r"distribute this file as part of a program or library that is built using gnu libtool|with libtool exception"),
    ("font-exception-2", r"if you create a document which uses this font and embed this font|with font exception(?: 2 0)?"),
    ("openssl-exception", r"permission to link the code of (?:this program|portions of this program|the program|this software) with the openssl library|with openssl exception"),
    ("linux-syscall-note", r"with linux syscall note|this copyright does not cover user programs that use kernel services by normal system calls linux"),
    # Other reciprocal licenses.
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-2-no-copyleft-exception", r"this source code form is incompatible with secondary licen[sc]es as defined by the mozilla public licen[sc]e v 2 0"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 0"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public licen[sc]e(?: version 1 1)?|netscape public licen[sc]e(?: version)? 1 1"),
    ("epl-1", r"all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e(?: v| version )?2 0"),
    ("ipl-1", r"ibm public licen[sc]e(?: version)?(?: 1 0)?"),
    ("cddl-1", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e cddl|you may not use this file except in compliance with the cddl"),
    ("lpl-1.02", r"lucent public licen[sc]e(?: version)?(?: 1 02| 1 0)?"),
    ("apsl-2", r"apple public source licen[sc]e(?: version)?(?: 2 0)?|this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[sc]e"),
    ("spl-1", r"sun public licen[sc]e(?: version)?(?: 1 0)?"),
    ("sissl", r"sun industry standards source licen[sc]e(?: version)?(?: 1 [12])?"),
    ("nokia", r"nokia open source licen[sc]e(?: version)?(?: 1 0a?)?"),
    ("rpsl-1", r"realnetworks public source licen[sc]e(?: version)?(?: 1 0)?"),
    ("rscpl", r"ricoh source code public licen[sc]e"),
    ("watcom-1", r"sybase open watcom public licen[sc]e(?: version)?(?: 1 0)?"),
    ("intel", r"intel open source licen[sc]e"),
    ("rpl-1.5", r"reciprocal public licen[sc]e(?: version)?(?: 1 5)?"),
    ("ngpl", r"nethack general public licen[sc]e"),
    ("lppl-1.3c", r"latex project public licen[sc]e(?: version)?(?: 1 3c?)?|this work may be distributed and or modified under the conditions of the latex project public licen[sc]e"),
    ("nasa-1.3", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("oclc-2", r"oclc research public licen[sc]e(?: version)?(?: 2 0)?"),
    ("naumen", r"naumen public licen[sc]e"),
    ("motosoto", r"motosoto open source licen[sc]e"),
    ("efl-2", r"eiffel forum licen[sc]e(?: version)?(?: 2)?"),
    ("entessa", r"entessa public licen[sc]e(?: version)?(?: 1 0)?"),
    ("fair", r"fair licen[sc]e"),
    ("miros", r"miros licen[sc]e"),
    ("simpl-2", r"simple public licen[sc]e(?: version)?(?: 2 0)?"),
    ("frameworx-1", r"frameworx open licen[sc]e(?: version)?(?: 1 0)?"),
    ("jabber", r"jabber open source licen[sc]e"),
    ("vsl-1", r"vovida software licen[sc]e(?: version)?(?: 1 0)?"),
    ("wxwindows", r"wxwindows library licen[sc]e|with wxwindows exception(?: 3 1)?"),
    ("xnet", r"x net licen[sc]e|xnet licen[sc]e"),
    ("blueoak-1", r"blue ?oak model licen[sc]e(?: version)?(?: 1 0 0)?"),
    ("parity-7", r"the parity public licen[sc]e(?: version)?(?: 7 0 0)?"),
    ("acsl-1.4", r"anti capitalist software licen[sc]e(?: version)?(?: 1 4)?|cooperative software licen[sc]e"),
    ("hippocratic-2.1", r"hippocratic licen[sc]e(?: version)?(?: 2 1| 3 0)?"),
    ("commons-clause", r"commons clause (?:licen[sc]e condition|restriction)|the software is provided to you by the licensor under the licen[sc]e as defined below subject to the following condition commons"),
    ("polyform-noncommercial-1", r"polyform noncommercial licen[sc]e(?: 1 0 0)?"),
    ("polyform-small-business-1", r"polyform small business licen[sc]e(?: 1 0 0)?"),
    ("polyform-shield-1", r"polyform shield licen[sc]e(?: 1 0 0)?"),
    ("confluent-community-1", r"confluent community licen[sc]e(?: agreement)?(?: version)?(?: 1 0)?"),
    ("prosperity-3", r"the prosperity public licen[sc]e(?: 3 0 0)?"),
    ("sspl-1", r"under the terms of the server side public licen[sc]e version 1 as published by mongodb|sspl v1"),
    ("tsl", r"timescale licen[sc]e(?: agreement)?"),
    ("rsal", r"redis source available licen[sc]e(?: version)?(?: 2| agreement)?"),
    ("busl-1.1", r"hashicorp inc business source licen[sc]e|copyright (?:c )?hashicorp inc spdx licen[sc]e identifier busl 1 1"),
    ("llama-community", r"llama(?: [23](?: [0-9])?)? community licen[sc]e(?: agreement)?"),
    ("openrail", r"(?:bigscience |creativeml )?open ?rail(?: [ms][ms]?)?(?: licen[sc]e)?|bigscience rail licen[sc]e(?: v1 0)?"),
    ("gemma", r"gemma terms of use|gemma licen[sc]e"),
    # Content, data and public domain.
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"we make this dedication for the benefit of the public at large|the author or authors of this software dedicate any and all copyright interest|overt act of relinquish(?:ment)?"),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain-us-gov", r"(?:united states|u s|us) government (?:and is )?(?:not subject to copyright protection )?in the public domain"),
    ("cc0", r"has waived all copyright and related or neighboring rights"),
    ("cc0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", r"creativecommons org licen[sc]es by [1-4] [05]"),
    ("cc-by-sa", r"creativecommons org licen[sc]es by sa [1-4] [05]"),
    ("cc-by-nc", r"creativecommons org licen[sc]es by nc [1-4] [05]"),
    ("cc-by-nd", r"creativecommons org licen[sc]es by nd [1-4] [05]"),
    ("cc-by-nc-sa", r"creativecommons org licen[sc]es by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", r"creativecommons org licen[sc]es by nc nd [1-4] [05]"),
    ("cc-by", r"this work is licensed under a creative commons attribution [1-4] [05] (?:international|generic|unported) licen[sc]e"),
    ("cc-by-sa", r"this work is licensed under a creative commons attribution sharealike [1-4] [05] (?:international|generic|unported) licen[sc]e"),
    ("cc-by-nc", r"this work is licensed under a creative commons attribution noncommercial [1-4] [05] (?:international|generic|unported) licen[sc]e"),
    ("odbl-1", r"opendatacommons org licen[sc]es odbl"),
    ("odc-by-1", r"opendatacommons org licen[sc]es by"),
    ("pddl-1", r"opendatacommons org licen[sc]es pddl"),
    ("cdla-permissive-2", r"cdla permissive(?: 2 0| 1 0)?"),
    ("cdla-sharing-1", r"cdla sharing(?: 1 0)?"),
    ("cdla-permissive-2", r"community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing-1", r"community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?"),
    ("ogl-3", r"open government licen[sc]e(?: v| version )?(?:3 0)?|ogl 3 0|contains public sector information licensed under the open government licen[sc]e"),
    ("etalab-2", r"etalab 2 0|licence ouverte open licence(?: version)? 2 0 etalab"),
    ("etalab-2", r"licence ouverte(?: open licence)?(?: version)?(?: 2 0)?"),
    ("lal-1.3", r"licence art libre(?: 1 3)?|free art licen[sc]e libre"),
    ("dl-de-by-2", r"dl de by(?: version)? 2 0"),
    ("ogl-1.0a", r"open gaming licen[sc]e(?: version)?(?: 1 0a)?|open game licen[sc]e gaming"),
    # Statements that no open license applies.
    ("all-rights-reserved", r"all rights reserved"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary|proprietary licen[sc]e|proprietary software)"),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited|reproduction or distribution is strictly prohibited"),
    ("evaluation", r"for evaluation (?:purposes )?only|evaluation licen[sc]e(?: agreement)?"),
    ("eula", r"end user licen[sc]e agreement eula|eula"),
    ("academic-only", r"for academic (?:and research )?(?:use|purposes) only|academic use only"),
    ("non-commercial", r"(?:for )?non commercial use only|not for commercial use"),
)


#: Words that tell little of a license; a gate only where a name has no other.
FREQUENT = frozenset(("free", "open", "software"))
COMMON = frozenset(("and", "as", "by", "either", "licence", "license", "of", "or", "public", "style", "the", "version"))


@dataclass(frozen=True)
class Rule:
    label: str
    regex: str
    priority: int  # a larger one wins an overlap
    weight: float  # confidence of a detection


#: How a passage of at most five words ends that is but the name of a license.
BARE = re.compile(r"(?:licen[sc]e(?: agreement)?|eula|terms of use)$")

#: Ways a name is used, most telling first: (before the name, after it, priority, weight).
FORMS = (
    (r"spdx licen[sc]e identifier (?:", r")", 90, 1.0),
    (r"(?:dual |re)?(?:licensed|released|distributed|available|published|provided|offered|covered|redistributed) (?:under|by|with|according to) (?:both )?(?:the |an? )?(?:terms (?:and conditions )?of )?(?:the )?(?:", r")", 80, 0.95),
    (r"(?:under|subject to|governed by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:", r") (?:licen[sc]e|agreement|terms)", 75, 0.9),
    (r"licen[sc]e (?:is )?(?:the )?(?:", r")", 70, 0.85),
    (r"(?:", r")(?: or (?:any )?later(?: version)?)?", 50, 0.7),
)


def spellings(regex: str) -> list[str]:
    """Every text that a name's regex matches; names have finitely many."""

    def either(at: int) -> tuple[list[str], int]:
        out, at = row(at)
        while at < len(regex) and regex[at] == "|":
            more, at = row(at + 1)
            out = out + more
        return out, at

    def row(at: int) -> tuple[list[str], int]:
        out = [""]
        while at < len(regex) and regex[at] not in "|)":
            if regex.startswith("(?:", at):
                part, at = either(at + 3)
                at += 1
            elif regex[at] == "[":
                end = regex.index("]", at)
                part = re.sub("(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), regex[at + 1 : end])
                part, at = list(part), end + 1
            elif regex[at] in "()*+{}.\\^$?":
                raise ValueError(f"not a name: {regex!r}")
            else:
                part, at = [regex[at]], at + 1
            if regex[at : at + 1] == "?":
                part, at = ["", *part], at + 1
            out = [a + b for a in out for b in part]
        return out, at

    out, at = either(0)
    if at < len(regex):
        raise ValueError(f"not a name: {regex!r}")
    return list(dict.fromkeys(out))


def gates_of(names: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    """Words of which each spelling of each name holds at least one; telling words first, then those of most spellings."""
    left = [set(s.split()) for _, name in names for s in spellings(name)]
    gates = []
    while left:
        count = Counter(w for s in left for w in s)
        best = min(count, key=lambda w: (2 if w in COMMON or w.isdigit() else w in FREQUENT, -count[w], w))
        gates.append(best)
        left = [s for s in left if best not in s]
    return tuple(gates)


def rules() -> list[tuple[tuple[str, ...], list[Rule]]]:
    """Gated rule families: each name of each license in each form, then the passages."""
    out = []
    for names in FAMILIES:
        own = [
            Rule(label, f"{before}{name}{after}", priority * 100 - i, weight)
            for before, after, priority, weight in FORMS
            for i, (label, name) in enumerate(names)
        ]
        out.append((gates_of(names), own))
    # A longer signature is the more exact one: the scan prefers it at equal priority.
    # A bare name among them counts like any other name that stands alone.
    _, _, priority, weight = FORMS[-1]
    for label, regex in BODIES:
        rank = (priority * 100, weight) if all(BARE.search(x) and len(x.split()) <= 5 for x in spellings(regex)) else (9500, 1.0)
        out.append((gates_of(((label, regex),)), [Rule(label, regex, *rank)]))
    return out
