"""License scan with ordered signature rules, in DataFrame functions only.

A text is lower-cased and reduced to its words with one blank between them.
Every rule is a regular expression over that word string, guarded by a keyword
that its matches must contain; a rule runs only on texts with its keyword, and
keywords are looked for only in texts with a word that many of them need.
Matches become word intervals.  An interval that lies inside another one of the
same or a higher priority is suppressed, so "licensed under the mit license"
wins over the bare "mit license" in it, while a low-priority notice never hides
a specific license.  Everything is a projection over the row: no shuffle, no
Python, memory bounded by the row.

Defined cases: null or empty texts have no words and no labels; repeated rows
are scanned on their own; very long texts are taken whole; of equal intervals
of one priority the label that sorts first stays; extra columns are kept, and
the result is one struct column whose name the caller chooses (a column of that
name is replaced); no rows give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm import storage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str  #: over words joined by single blanks
    keyword: str  #: every match contains it
    priority: int  #: 1 notice, 2 named license, 3 license with its grant


#: The signatures, as label | priority | keyword | pattern over words joined by single blanks.
SIGNATURES = r"""
# Short permissive licenses.
mit | 2 | mit licen | (?:the )?mit licen[cs]e
mit | 3 | mit licen | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 3 | person obtaining | permission is hereby granted free of charge to any person obtaining a copy
mit | 2 | copyright notice and this permission | the above copyright notice and this permission notice shall be included
mit | 3 | identifier mit | spdx licen[cs]e identifier mit
mit | 2 | opensource org | opensource org licenses mit(?: license)?(?: php| html)?
mit-0 | 3 | no attribution | mit no attribution(?: licen[cs]e)?
mit-x11 | 2 | x11 | (?:mit )?x11 licen[cs]e
mit-expat | 2 | expat | expat licen[cs]e
isc | 2 | isc licen | (?:the )?isc licen[cs]e
isc | 3 | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 3 | identifier isc | spdx licen[cs]e identifier isc
0bsd | 2 | zero clause | (?:bsd zero clause|zero clause bsd) licen[cs]e
0bsd | 3 | 0bsd | spdx licen[cs]e identifier 0bsd
bsd | 2 | bsd licen | bsd licen[cs]e
bsd | 2 | bsd style | bsd style licen[cs]e
bsd | 3 | under a bsd | (?:licensed|released|distributed|available) under a bsd(?: style)? licen[cs]e
bsd | 2 | source and binary | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | 3 | clause | (?:2|two) clause bsd licen[cs]e
bsd-2-clause | 3 | bsd 2 | bsd 2 clause(?: simplified)? licen[cs]e
bsd-2-clause | 3 | simplified bsd | simplified bsd licen[cs]e
bsd-2-clause | 3 | freebsd | freebsd licen[cs]e
bsd-2-clause | 3 | identifier bsd 2 | spdx licen[cs]e identifier bsd 2 clause
bsd-3-clause | 3 | clause | (?:3|three) clause bsd licen[cs]e
bsd-3-clause | 3 | bsd 3 | bsd 3 clause(?: new| revised)? licen[cs]e
bsd-3-clause | 3 | new bsd | new bsd licen[cs]e
bsd-3-clause | 3 | modified bsd | modified bsd licen[cs]e
bsd-3-clause | 3 | revised bsd | revised bsd licen[cs]e
bsd-3-clause | 3 | endorse or promote | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 3 | identifier bsd 3 | spdx licen[cs]e identifier bsd 3 clause
bsd-4-clause | 3 | clause | (?:4|four) clause bsd licen[cs]e
bsd-4-clause | 3 | original bsd | original bsd licen[cs]e
bsd-4-clause | 3 | advertising materials | all advertising materials mentioning features or use of this software must display
bsd-patent | 3 | plus patent | bsd (?:2 clause )?plus patent licen[cs]e
zlib | 2 | zlib | zlib(?: libpng)? licen[cs]e
zlib | 3 | express or implied warranty | this software is provided as is without any express or implied warranty
zlib | 3 | origin of this software | the origin of this software must not be misrepresented
libpng | 2 | libpng licen | libpng licen[cs]e(?: version 2)?
boost-1.0 | 2 | boost software | boost software licen[cs]e
boost-1.0 | 3 | boost software | boost software licen[cs]e version 1 0
boost-1.0 | 3 | identifier bsl | spdx licen[cs]e identifier bsl 1 0
unlicense | 2 | unlicense | (?:the )?unlicense
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 2 | wtfpl | wtfpl
wtfpl | 3 | what the fuck | do what the fuck you want to public licen[cs]e
beerware | 2 | beer | (?:the )?beer ?ware licen[cs]e
postgresql | 2 | postgresql licen | postgresql licen[cs]e
ntp | 2 | ntp licen | ntp licen[cs]e
curl | 2 | curl licen | curl licen[cs]e
hpnd | 2 | historical permission | historical permission notice and disclaimer
ncsa | 2 | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
upl-1.0 | 2 | universal permissive | universal permissive licen[cs]e(?: v ?1 0| version 1 0)?
unicode | 2 | unicode | unicode (?:inc )?licen[cs]e agreement
blueoak-1.0 | 2 | blue oak | blue oak model licen[cs]e(?: 1 0 0)?
mulan-2.0 | 2 | mulan | mulan (?:psl|permissive software licen[cs]e)(?: v ?2| version 2)?
afl-2.1 | 3 | academic free | academic free licen[cs]e (?:version |v ?)?2 1
afl-3.0 | 3 | academic free | academic free licen[cs]e (?:version |v ?)?3 0
afl | 2 | academic free | academic free licen[cs]e
ecl-2.0 | 2 | educational community | educational community licen[cs]e(?: version 2 0)?
# Apache.
apache | 2 | apache | apache(?: software)? licen[cs]e
apache-1.0 | 3 | apache | apache(?: software)? licen[cs]e (?:version |v ?)?1 0
apache-1.1 | 3 | apache | apache(?: software)? licen[cs]e (?:version |v ?)?1 1
apache-2.0 | 3 | apache | apache(?: software)? licen[cs]e (?:version |v ?)?2(?: 0)?
apache-2.0 | 3 | apache org | apache org licenses license 2 0
apache-2.0 | 3 | identifier apache | spdx licen[cs]e identifier apache 2 0
apache-2.0 | 2 | express or implied see | without warranties or conditions of any kind either express or implied see the license
# The GNU family.
gpl | 2 | general public | gnu general public licen[cs]e
gpl | 2 | gnu gpl | gnu gpl
gpl | 2 | foundation either version | as published by the free software foundation either version
gpl-1.0 | 3 | general public | gnu general public licen[cs]e (?:version |v ?)?1(?: 0)?
gpl-2.0 | 3 | general public | gnu general public licen[cs]e (?:version |v ?)?2(?: 0)?
gpl-2.0 | 3 | gpl | (?:gnu )?gpl ?v ?2(?: 0)?
gpl-2.0 | 3 | identifier gpl | spdx licen[cs]e identifier gpl 2 0(?: only)?
gpl-2.0-or-later | 3 | later | gnu general public licen[cs]e (?:version |v ?)?2(?: 0)? or (?:any )?later(?: version)?
gpl-2.0-or-later | 3 | later | either version 2 of the licen[cs]e or at your option any later version
gpl-2.0-or-later | 3 | later | spdx licen[cs]e identifier gpl 2 0 or later
gpl-3.0 | 3 | general public | gnu general public licen[cs]e (?:version |v ?)?3(?: 0)?
gpl-3.0 | 3 | gpl | (?:gnu )?gpl ?v ?3(?: 0)?
gpl-3.0 | 3 | identifier gpl | spdx licen[cs]e identifier gpl 3 0(?: only)?
gpl-3.0-or-later | 3 | later | gnu general public licen[cs]e (?:version |v ?)?3(?: 0)? or (?:any )?later(?: version)?
gpl-3.0-or-later | 3 | later | either version 3 of the licen[cs]e or at your option any later version
gpl-3.0-or-later | 3 | later | spdx licen[cs]e identifier gpl 3 0 or later
gpl-classpath | 3 | classpath | classpath exception(?: 2 0)?
gpl-gcc | 3 | runtime library | gcc runtime library exception
lgpl | 2 | lesser general | (?:gnu )?lesser general public licen[cs]e
lgpl | 2 | library general | (?:gnu )?library general public licen[cs]e
lgpl | 2 | lgpl | (?:gnu )?lgpl
lgpl-2.0 | 3 | library general | (?:gnu )?library general public licen[cs]e (?:version |v ?)?2(?: 0)?
lgpl-2.1 | 3 | lesser general | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1
lgpl-2.1 | 3 | lgpl | (?:gnu )?lgpl ?v ?2 1
lgpl-2.1 | 3 | identifier lgpl | spdx licen[cs]e identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | 3 | later | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1 or (?:any )?later(?: version)?
lgpl-3.0 | 3 | lesser general | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?
lgpl-3.0 | 3 | lgpl | (?:gnu )?lgpl ?v ?3(?: 0)?
lgpl-3.0 | 3 | identifier lgpl | spdx licen[cs]e identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later | 3 | later | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)? or (?:any )?later(?: version)?
agpl | 2 | affero | (?:gnu )?affero general public licen[cs]e
agpl | 2 | agpl | (?:gnu )?agpl
agpl-3.0 | 3 | affero | (?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?
agpl-3.0 | 3 | agpl | (?:gnu )?agpl ?v ?3(?: 0)?
agpl-3.0 | 3 | identifier agpl | spdx licen[cs]e identifier agpl 3 0(?: only)?
agpl-3.0-or-later | 3 | later | (?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)? or (?:any )?later(?: version)?
gfdl | 2 | documentation | gnu free documentation licen[cs]e
gfdl-1.2 | 3 | documentation | gnu free documentation licen[cs]e (?:version |v ?)?1 2
gfdl-1.3 | 3 | documentation | gnu free documentation licen[cs]e (?:version |v ?)?1 3
# Weak copyleft and foundations.
mpl | 2 | mozilla | mozilla public licen[cs]e
mpl-1.0 | 3 | mozilla | mozilla public licen[cs]e (?:version |v ?)?1 0
mpl-1.1 | 3 | mozilla | mozilla public licen[cs]e (?:version |v ?)?1 1
mpl-2.0 | 3 | mozilla | mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
mpl-2.0 | 3 | mozilla org | mozilla org mpl 2 0
mpl-2.0 | 3 | identifier mpl | spdx licen[cs]e identifier mpl 2 0
epl | 2 | eclipse | eclipse public licen[cs]e
epl-1.0 | 3 | eclipse | eclipse public licen[cs]e (?:version |v ?)?1 0
epl-2.0 | 3 | eclipse | eclipse public licen[cs]e (?:version |v ?)?2 0
epl-2.0 | 3 | identifier epl | spdx licen[cs]e identifier epl 2 0
edl-1.0 | 2 | eclipse | eclipse distribution licen[cs]e(?: v ?1 0| version 1 0)?
cddl | 2 | development and distribution | common development and distribution licen[cs]e
cddl-1.0 | 3 | development and distribution | common development and distribution licen[cs]e (?:version |v ?)?1 0
cddl-1.1 | 3 | development and distribution | common development and distribution licen[cs]e (?:version |v ?)?1 1
cpl-1.0 | 2 | common public | common public licen[cs]e(?: version 1 0| v ?1 0)?
ipl-1.0 | 2 | ibm public | ibm public licen[cs]e(?: version 1 0)?
spl-1.0 | 2 | sun public | sun public licen[cs]e(?: version 1 0)?
npl-1.1 | 2 | netscape | netscape public licen[cs]e(?: version 1 1)?
apsl-2.0 | 2 | apple public | apple public source licen[cs]e(?: version 2 0)?
osl-3.0 | 3 | open software | open software licen[cs]e (?:version |v ?)?3 0
osl | 2 | open software | open software licen[cs]e
eupl | 2 | european union | european union public licen[cs]e
eupl-1.1 | 3 | european union | european union public licen[cs]e (?:version |v ?)?1 1
eupl-1.2 | 3 | european union | european union public licen[cs]e (?:version |v ?)?1 2
artistic | 2 | artistic | artistic licen[cs]e
artistic-1.0 | 3 | artistic | artistic licen[cs]e (?:version |v ?)?1 0
artistic-2.0 | 3 | artistic | artistic licen[cs]e (?:version |v ?)?2 0
perl | 3 | perl itself | (?:under )?the same terms as perl itself
python | 2 | python software | python software foundation licen[cs]e
python-2.0 | 3 | python software | python software foundation licen[cs]e version 2
php-3.01 | 2 | php licen | (?:the )?php licen[cs]e(?: version 3 01)?
ruby | 2 | ruby licen | ruby licen[cs]e
latex-1.3c | 2 | latex | latex project public licen[cs]e(?: version 1 3c)?
openssl | 2 | openssl licen | openssl licen[cs]e
ms-pl | 2 | microsoft public | microsoft public licen[cs]e
ms-rl | 2 | reciprocal | microsoft reciprocal licen[cs]e
rpl-1.5 | 2 | reciprocal | reciprocal public licen[cs]e(?: 1 5)?
sleepycat | 2 | sleepycat | sleepycat licen[cs]e
qpl-1.0 | 2 | q public | q public licen[cs]e(?: version 1 0)?
vim | 2 | vim licen | vim licen[cs]e
w3c | 2 | w3c | w3c software (?:notice and|and document) licen[cs]e
cecill-2.1 | 2 | cecill | cecill(?: free software)? licen[cs]e(?: agreement)?(?: version 2 1)?
ofl-1.1 | 2 | open font | (?:sil )?open font licen[cs]e
ofl-1.1 | 3 | open font | (?:sil )?open font licen[cs]e version 1 1
# Source available.
bsl-1.1 | 2 | business source | business source licen[cs]e(?: version)?(?: 1 1)?
sspl-1.0 | 2 | server side | server side public licen[cs]e
elastic-2.0 | 2 | elastic licen | elastic licen[cs]e(?: version)?(?: 2 0)?
commons-clause | 2 | commons clause | commons clause(?: license condition)?
polyform-nc | 2 | polyform | polyform noncommercial licen[cs]e(?: 1 0 0)?
polyform-sb | 2 | polyform | polyform small business licen[cs]e(?: 1 0 0)?
prosperity | 2 | prosperity | prosperity public licen[cs]e(?: 3 0 0)?
openrail-m | 2 | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
# Data and content.
cc0-1.0 | 2 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 3 | cc0 | spdx licen[cs]e identifier cc0 1 0
cc0-1.0 | 3 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-by-1.0 | 3 | cc by 1 | cc by 1 0
cc-by-2.0 | 3 | cc by 2 | cc by 2 0
cc-by-2.5 | 3 | cc by 2 | cc by 2 5
cc-by-3.0 | 3 | cc by 3 | cc by 3 0
cc-by-4.0 | 3 | cc by 4 | cc by 4 0
cc-by-sa | 2 | cc by sa | cc by sa
cc-by-sa-2.0 | 3 | cc by sa 2 | cc by sa 2 0
cc-by-sa-2.5 | 3 | cc by sa 2 | cc by sa 2 5
cc-by-sa-3.0 | 3 | cc by sa 3 | cc by sa 3 0
cc-by-sa-4.0 | 3 | cc by sa 4 | cc by sa 4 0
cc-by-nc | 2 | cc by nc | cc by nc
cc-by-nc-2.0 | 3 | cc by nc 2 | cc by nc 2 0
cc-by-nc-3.0 | 3 | cc by nc 3 | cc by nc 3 0
cc-by-nc-4.0 | 3 | cc by nc 4 | cc by nc 4 0
cc-by-nd | 2 | cc by nd | cc by nd
cc-by-nd-3.0 | 3 | cc by nd 3 | cc by nd 3 0
cc-by-nd-4.0 | 3 | cc by nd 4 | cc by nd 4 0
cc-by-nc-sa | 2 | cc by nc sa | cc by nc sa
cc-by-nc-sa-3.0 | 3 | cc by nc sa 3 | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 3 | cc by nc sa 4 | cc by nc sa 4 0
cc-by-nc-nd | 2 | cc by nc nd | cc by nc nd
cc-by-nc-nd-3.0 | 3 | cc by nc nd 3 | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 3 | cc by nc nd 4 | cc by nc nd 4 0
cc | 2 | creative commons | creative commons(?: public)? licen[cs]e
cc-by | 2 | creative commons | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa | 3 | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc | 3 | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nd | 3 | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa | 3 | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
odbl-1.0 | 2 | database licen | (?:odc )?open (?:data commons open )?database licen[cs]e
odc-by-1.0 | 2 | odc | odc attribution licen[cs]e
pddl-1.0 | 2 | public domain dedication | (?:odc )?public domain dedication and licen[cs]e
cdla-permissive | 2 | community data | community data licen[cs]e agreement permissive
cdla-sharing | 2 | community data | community data licen[cs]e agreement sharing
ogl-uk | 2 | open government | open government licen[cs]e(?: v ?[123] 0| version [123] 0)?
etalab-2.0 | 2 | licence ouverte | licence ouverte(?: etalab)?(?: version 2 0)?
# Notices.
public-domain | 1 | public domain | (?:in|into) the public domain
notice-copyright | 1 | copyright | copyright (?:c )?[0-9]{4}
notice-copyright | 1 | copr | copr [0-9]{4}
notice-license | 1 | under | licensed under
notice-terms | 1 | subject to | subject to the terms (?:and conditions )?of
notice-spdx | 1 | spdx | spdx licen[cs]e identifier [a-z0-9]+
notice-warranty | 1 | warrant | without warranty of any kind
notice-permission | 1 | permission | used (?:by|with) (?:kind )?permission
notice-proprietary | 1 | proprietary | proprietary and confidential
notice-no-commercial | 1 | commercial | (?:for )?non ?commercial use only
"""


def _rules() -> tuple[Rule, ...]:
    lines = (line for line in SIGNATURES.strip().splitlines() if not line.startswith("#"))
    fields = ([x.strip() for x in line.split("|", 3)] for line in lines)
    return tuple(Rule(label, pattern, keyword, int(priority)) for label, priority, keyword, pattern in fields)


RULES = _rules()


def word_string(text: Column) -> Column:
    """The words with one blank between, before and after; one blank if there are none."""
    whole = F.coalesce(text, F.lit(""))
    # Lower case is that of A-Z alone; beside these, two other letters have one that is made of ASCII letters.
    plain = F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = F.when(F.contains(whole, F.lit("\u0130")) | F.contains(whole, F.lit("\u212a")), plain).otherwise(F.lower(whole))
    inner = F.trim(F.regexp_replace(low, SEPARATORS, " "))
    return F.when(inner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(norm: Column, n_words: Column, phrase: str) -> Column:
    """How many places a phrase has, and its first and last start."""
    size = phrase.count(" ") + 1
    pieces = F.split(norm, f" {phrase}(?= )", -1)
    count = F.size(pieces) - 1
    found = F.struct(
        count.cast("long").alias("n"),
        F.when(count > 0, _blanks(F.element_at(pieces, 1)).cast("long")).alias("first"),
        F.when(count > 0, n_words - (_blanks(F.element_at(pieces, -1)) - 1) - size).cast("long").alias("last"),
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), found).otherwise(none)


def _intervals(norm: Column, rule: Column) -> Column:
    """A rule's matches as (start, -end, -priority, label), by marking their ends in the word string."""
    marked = F.split(F.regexp_replace(norm, rule["regex"], F.lit(" \u0001$1\u0002")), " ", -1)
    at = lambda test, plus: F.filter(F.transform(marked, lambda w, i: F.when(test(w), i + plus).otherwise(-1)), lambda i: i >= 0)
    starts, ends = at(lambda w: F.startswith(w, F.lit("\u0001")), -1), at(lambda w: F.endswith(w, F.lit("\u0002")), 0)
    return F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda x: F.struct(x["s"].alias("start"), (-x["e"]).alias("neg_end"), (-rule["priority"]).alias("neg_priority"), rule["label"].alias("label")),
    )


#: Words that many signatures need; a text is tried for these first, and for keywords after that.
GATES = ("licen", "cc by", "cc0", "creative commons", "gpl", "copyright", "permi", " version ", "software", "public", " terms ", "warrant")


def gate(rule: Rule) -> str:
    """The first gate that every match of the rule contains, or else its keyword."""
    sign = rule.pattern
    while (cut := re.sub(r"\(\?:[^()]*\)\??", "\0", sign)) != sign:
        sign = cut
    always = re.sub(r".\?|\[[^]]*\](?:\{[0-9]+\}|\+)?", "\0", f" {sign} ")
    return next((g for g in GATES if g in always and "|" not in always), rule.keyword)


def _regex(rule: Rule) -> str:
    return f" ({rule.pattern})(?= )"


def detections(norm: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All matches of all rules whose keyword the text has, by start, longest and highest priority first.

    Keywords and patterns are literals, so each pattern is compiled once; only rules that match are looked at again for places.
    """
    none = F.array().cast("array<int>")
    groups: dict[str, dict[str, list[int]]] = {}
    for k, r in enumerate(rules):
        groups.setdefault(gate(r), {}).setdefault(r.keyword, []).append(k)
    found = lambda own: F.filter(F.array(*[F.when(F.rlike(norm, F.lit(_regex(rules[k]))), F.lit(k)) for k in own]), lambda k: k.isNotNull())
    behind = lambda word, what: F.when(F.contains(norm, F.lit(word)), what).otherwise(none)
    tried = [behind(g, F.flatten(F.array(*[behind(keyword, found(own)) for keyword, own in by_keyword.items()]))) for g, by_keyword in groups.items()]
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(_regex(r)).alias("regex"), F.lit(r.priority).alias("priority")) for r in rules])
    return F.array_sort(F.flatten(F.transform(F.flatten(F.array(*tried)) if tried else none, lambda k: _intervals(norm, F.element_at(table, k + 1)))))


def surviving(found: Column) -> Column:
    """Labels and weight of the intervals that no other one of at least their priority contains."""
    start = F.struct(*[F.lit(-1).alias(f"end{p}") for p in (1, 2, 3)], F.array().cast("array<string>").alias("labels"), F.lit(0).alias("weight"))

    def step(acc: Column, x: Column) -> Column:
        end, priority = -x["neg_end"], -x["neg_priority"]
        hidden = F.when(priority == 1, acc["end1"]).when(priority == 2, acc["end2"]).otherwise(acc["end3"]) >= end
        reach = [F.when(priority >= p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in (1, 2, 3)]
        return F.struct(
            *reach,
            F.when(hidden, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"),
            F.when(hidden, acc["weight"]).otherwise(F.least(acc["weight"] + priority, F.lit(1_000_000))).alias("weight"),
        )

    return F.aggregate(found, start, step, lambda acc: F.struct(acc["labels"], acc["weight"]))


def scan(docs: DataFrame, text: str = "text", out: str = "licenses", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base_labels`` and ``labels`` are sorted arrays; ``score`` is w / (w + 3) for the summed
    priorities w of what survives (base phrases count 2 where no rule does), 0 without labels.
    """
    names = {k: storage.free_name(docs, f"license_{k}") for k in ("norm", "n", "kept", *(f"base{k}" for k in range(len(BASE))))}
    own = {k: F.col(v) for k, v in names.items()}
    at = docs.withColumn(names["norm"], word_string(F.col(text)))
    at = at.withColumn(names["n"], F.when(own["norm"] == " ", 0).otherwise(_blanks(own["norm"]) - 1).cast("long"))
    at = at.withColumns({names[f"base{k}"]: _places(own["norm"], own["n"], phrase) for k, (phrase, _) in enumerate(BASE)})
    at = at.withColumn(names["kept"], surviving(detections(own["norm"], rules)))
    places = [own[f"base{k}"] for k in range(len(BASE))]
    base = F.array_sort(F.filter(F.array(*[F.when(p["n"] > 0, F.lit(label)) for p, (_, label) in zip(places, BASE, strict=True)]), lambda x: x.isNotNull()))
    labels = F.array_sort(F.array_union(base, own["kept"]["labels"]))
    weight = F.greatest(own["kept"]["weight"], 2 * F.size(base))
    result = F.struct(
        own["n"].alias("n_words"),
        sum((p["n"] for p in places[1:]), places[0]["n"]).alias("n_base"),
        F.least(*[p["first"] for p in places]).alias("first_word"),
        F.greatest(*[p["last"] for p in places]).alias("last_word"),
        base.alias("base_labels"),
        labels.alias("labels"),
        (weight / (weight + F.lit(3.0))).alias("score"),
    )
    return at.withColumn(out, result).drop(*names.values())
