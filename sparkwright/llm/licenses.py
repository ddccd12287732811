"""License scan with ordered signature rules, in Spark expressions only.

A text is lower-cased (A-Z only) and cut into words; rules are regular expressions over the words joined by
single spaces. Keywords found in the raw text decide which texts are scanned, and a piece that its rule spells out which rules are tried, so most texts meet no rule.
Detections are ordered by start, longer first, then rule priority; one that lies inside an earlier detection
is suppressed, and one that overlaps an earlier detection of better priority in part is too.

Defined results: a null or empty text has no words, no places and score 0; ``first_word`` and ``last_word``
are null without places; repeated rows give repeated results, rows are never joined or shuffled; an empty table gives no rows; extra columns
are ignored, whatever their names. Work is linear in the length of a text (sorting its detections apart).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of the contract: phrases and labels that are always reported.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
PARTS, PARTS_ANY_CASE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what parts words, once A-Z are lower-cased and before
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: label, regular expression of the name in words
NAMES = (
    ("agpl-3.0", "(?:gnu )?agpl(?: ?v(?:ersion)?)? ?3(?: 0)?"),
    ("agpl-3.0", "(?:gnu )?affero general public license(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("agpl-1.0", "affero general public license(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("agpl", "gnu affero general public license"),
    ("agpl", "gnu agpl"),
    ("lgpl-3.0", "(?:gnu )?lgpl(?: ?v(?:ersion)?)? ?3(?: 0)?"),
    ("lgpl-3.0", "(?:gnu )?lesser general public license(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("lgpl-2.1", "(?:gnu )?lgpl(?: ?v(?:ersion)?)? ?2 1"),
    ("lgpl-2.1", "(?:gnu )?lesser general public license(?: v(?:ersion)?)? ?2 1"),
    ("lgpl-2.0", "(?:gnu )?lgpl(?: ?v(?:ersion)?)? ?2(?: 0)?"),
    ("lgpl-2.0", "(?:gnu )?library general public license(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("lgpl", "gnu lgpl"),
    ("gpl-3.0", "(?:gnu )?gpl(?: ?v(?:ersion)?)? ?3(?: 0)?"),
    ("gpl-3.0", "(?:gnu )?general public license(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("gpl-2.0", "(?:gnu )?gpl(?: ?v(?:ersion)?)? ?2(?: 0)?"),
    ("gpl-2.0", "(?:gnu )?general public license(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("gpl-1.0", "(?:gnu )?gpl(?: ?v(?:ersion)?)? ?1(?: 0)?"),
    ("gpl-1.0", "(?:gnu )?general public license(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("gpl", "gnu gpl"),
    ("gpl-classpath", "gpl (?:v?2 )?with(?: the)? classpath exception"),
    ("gcc-exception", "gcc runtime library exception"),
    ("gfdl-1.3", "gnu free documentation license(?: v(?:ersion)?)? ?1 3"),
    ("gfdl-1.2", "gnu free documentation license(?: v(?:ersion)?)? ?1 2"),
    ("gfdl", "gnu free documentation license"),
    ("apache-2.0", "apache(?: software)? license(?: ?v(?:ersion)?)? ?2(?: 0)?"),
    ("apache-1.1", "apache(?: software)? license(?: ?v(?:ersion)?)? ?1 1"),
    ("apache-1.0", "apache(?: software)? license(?: ?v(?:ersion)?)? ?1 0"),
    ("mit", "(?:the )?mit (?:license|licence)"),
    ("mit-0", "mit no attribution"),
    ("expat", "expat license"),
    ("x11", "x11 license"),
    ("isc", "isc license"),
    ("bsd-4-clause", "(?:4 clause|original|old)(?: style)? bsd license"),
    ("bsd-3-clause", "(?:3 clause|new|modified|revised)(?: style)? bsd license"),
    ("bsd-2-clause", "(?:2 clause|simplified|freebsd)(?: style)? bsd license"),
    ("bsd-3-clause", "bsd 3 clause(?: license)?"),
    ("bsd-2-clause", "bsd 2 clause(?: license)?"),
    ("bsd-0", "zero clause bsd(?: license)?"),
    ("bsd-0", "bsd zero clause(?: license)?"),
    ("bsd", "bsd(?: style)? license"),
    ("mpl-2.0", "mozilla public license(?: ?v(?:ersion)?)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla public license(?: ?v(?:ersion)?)? ?1 1"),
    ("mpl", "mozilla public license"),
    ("epl-2.0", "eclipse public license(?: ?v(?:ersion)?)? ?2(?: 0)?"),
    ("epl-1.0", "eclipse public license(?: ?v(?:ersion)?)? ?1(?: 0)?"),
    ("cddl-1.0", "common development and distribution license(?: version)?(?: 1 0)?"),
    ("cpl-1.0", "common public license(?: version)?(?: 1 0)?"),
    ("ipl-1.0", "ibm public license(?: version)?(?: 1 0)?"),
    ("eupl-1.2", "european union public licen[cs]e(?: ?v(?:ersion)?)? ?1 2"),
    ("eupl", "european union public licen[cs]e"),
    ("artistic-2.0", "artistic license(?: version)? 2(?: 0)?"),
    ("artistic-1.0", "artistic license"),
    ("bsl-1.0", "boost software license(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business source license(?: version)?(?: 1 1)?"),
    ("sspl-1.0", "server side public license(?: version)?(?: 1)?"),
    ("elastic-2.0", "elastic license(?: version)?(?: 2(?: 0)?)?"),
    ("cc-by-4.0", "cc by(?: international)?(?: license)? ?4 0"),
    ("cc-by-4.0", "creative commons attribution(?: international)?(?: public)?(?: license)? ?4 0"),
    ("cc-by-3.0", "cc by(?: unported)?(?: license)? ?3 0"),
    ("cc-by-3.0", "creative commons attribution(?: unported)?(?: license)? ?3 0"),
    ("cc-by-2.0", "cc by(?: generic)?(?: license)? ?2 [05]"),
    ("cc-by-2.0", "creative commons attribution(?: generic)?(?: license)? ?2 [05]"),
    ("cc-by-sa", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?"),
    ("cc0-1.0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "cc zero(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons zero(?: 1 0)?(?: universal)?"),
    ("cc", "creative commons"),
    ("unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("zlib", "zlib(?: libpng)? license"),
    ("libpng", "libpng license"),
    ("openssl", "openssl license"),
    ("ssleay", "ssleay license"),
    ("postgresql", "postgresql licen[cs]e"),
    ("python-2.0", "python(?: software foundation)? license(?: version)?(?: 2(?: 0)?)?"),
    ("php-3.01", "php license(?: version)?(?: 3 0?1)?"),
    ("ruby", "ruby license"),
    ("perl", "same terms as perl itself"),
    ("ofl-1.1", "(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("odbl", "open (?:database license|data commons)"),
    ("ncsa", "(?:university of illinois ncsa|ncsa) open source license"),
    ("json", "the software shall be used for good not evil"),
    ("beerware", "beer ?ware license"),
    ("vim", "vim license"),
    ("curl", "curl license"),
    ("ms-pl", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license"),
    ("apsl-2.0", "apple public source license"),
    ("osl-3.0", "open software license(?: version)?(?: 3 0)?"),
    ("afl-3.0", "academic free license(?: version)?(?: 3 0)?"),
    ("upl-1.0", "universal permissive license"),
    ("mulan-2.0", "mulan (?:psl|permissive software license)(?: version)?(?: ?v?2)?"),
    ("mpl-2.0", "mpl(?: ?v(?:ersion)?)? ?2(?: 0)?"),
    ("mpl-1.1", "mpl(?: ?v(?:ersion)?)? ?1 1"),
    ("mpl-1.0", "mozilla public license(?: v(?:ersion)?)? ?1 0"),
    ("epl-2.0", "epl(?: ?v)? ?2 0"),
    ("epl-1.0", "epl(?: ?v)? ?1 0"),
    ("epl", "eclipse public license"),
    ("edl-1.0", "eclipse distribution license(?: v(?:ersion)?)?(?: 1 0)?"),
    ("apache-2.0", "apache 2 0 licen[cs]e"),
    ("apache-2.0", "asl ?2 0"),
    ("apache-2.0-llvm", "apache license v2 0 with llvm exceptions"),
    ("mit", "mit x11 license"),
    ("mit", "mit style license"),
    ("mit-cmu", "cmu mit license"),
    ("mit-modern", "mit modern variant"),
    ("hpnd", "historical permission notice and disclaimer"),
    ("ntp", "ntp license"),
    ("bsd-1-clause", "bsd 1 clause(?: license)?"),
    ("bsd-4-clause", "bsd 4 clause(?: license)?"),
    ("bsd-3-clause-clear", "clear bsd license"),
    ("bsd-2-clause-patent", "bsd 2 clause plus patent license"),
    ("bsd-protection", "bsd protection license"),
    ("bsd-source-code", "bsd source code attribution"),
    ("aal", "attribution assurance license"),
    ("adobe-glyph", "adobe glyph list license"),
    ("afl-2.1", "academic free license(?: version)? 2 1"),
    ("aladdin", "aladdin free public license"),
    ("apl-1.0", "adaptive public license(?: 1 0)?"),
    ("artistic-clarified", "clarified artistic license"),
    ("blueoak-1.0", "blue oak model license(?: 1 0)?"),
    ("bittorrent", "bittorrent open source license"),
    ("borceux", "borceux license"),
    ("caldera", "caldera license"),
    ("catosl", "computer associates trusted open source license"),
    ("cern-ohl", "cern open hardware licen[cs]e"),
    ("cddl-1.1", "common development and distribution license(?: version)? 1 1"),
    ("cddl", "cddl(?: 1 [01])? license"),
    ("cdla-permissive", "community data license agreement permissive"),
    ("cdla-sharing", "community data license agreement sharing"),
    ("clartistic", "clartistic license"),
    ("condor", "condor public license"),
    ("copyleft-next", "copyleft next license"),
    ("cpal-1.0", "common public attribution license"),
    ("cpol", "code project open license"),
    ("crossword", "crossword license"),
    ("cua-opl", "cua office public license"),
    ("d-fsl", "deutsche freie software lizenz licen[cs]e"),
    ("diffmark", "diffmark license"),
    ("dl-de-by", "data licen[cs]e germany attribution"),
    ("docbook", "docbook schema license"),
    ("drl", "detection rule license"),
    ("ecl-2.0", "educational community license(?: version)?(?: 2 0)?"),
    ("efl-2.0", "eiffel forum license(?: version)?(?: 2)?"),
    ("entessa", "entessa public license"),
    ("etalab-2.0", "etalab open licen[cs]e(?: 2 0)?"),
    ("eudatagrid", "eu datagrid software license"),
    ("fair", "fair license"),
    ("frameworx", "frameworx open license"),
    ("free-image", "freeimage public license"),
    ("ftl", "freetype (?:project )?license"),
    ("fsfap", "fsf all permissive license"),
    ("giftware", "giftware license"),
    ("glide", "3dfx glide license"),
    ("hippocratic", "hippocratic license"),
    ("ijg", "independent jpeg group license"),
    ("imagemagick", "imagemagick license"),
    ("imatix", "imatix standard function library license"),
    ("info-zip", "info zip license"),
    ("intel", "intel open source license"),
    ("interbase", "interbase public license"),
    ("ipa", "ipa font license"),
    ("jasper", "jasper license"),
    ("knuth-ctan", "knuth ctan license"),
    ("lal-1.3", "licence art libre"),
    ("lal-1.3", "free art license"),
    ("latex2e", "latex2e license"),
    ("leptonica", "leptonica license"),
    ("liliq", "licence libre du quebec"),
    ("linux-openib", "openib org bsd license"),
    ("lppl-1.3", "latex project public license(?: v(?:ersion)?)?(?: ?1 3[abc]?)?"),
    ("lucent", "lucent public license"),
    ("miros", "miros licen[cs]e"),
    ("motosoto", "motosoto license"),
    ("mpich2", "mpich2 license"),
    ("ms-lpl", "microsoft limited public license"),
    ("multics", "multics license"),
    ("nasa-1.3", "nasa open source agreement licen[cs]e"),
    ("naumen", "naumen public license"),
    ("netcdf", "netcdf license"),
    ("netscape", "netscape public license"),
    ("ngpl", "nethack general public license"),
    ("nokia", "nokia open source license"),
    ("nposl-3.0", "non profit open software license"),
    ("oclc-2.0", "oclc research public license"),
    ("odc-by", "open data commons attribution license"),
    ("odc-pddl", "public domain dedication and licen[cs]e"),
    ("ogl-uk", "open government licen[cs]e"),
    ("ogl-canada", "open government licen[cs]e canada"),
    ("ogtsl", "open group test suite license"),
    ("oldap", "openldap public license"),
    ("opl", "open publication license"),
    ("open-game", "open game license"),
    ("osl-2.1", "open software license(?: version)? 2 1"),
    ("parity", "parity public license"),
    ("phorum", "phorum license"),
    ("polyform-noncommercial", "polyform noncommercial license"),
    ("polyform-small", "polyform small business license"),
    ("prosperity", "prosperity public license"),
    ("psf", "psf license"),
    ("python-cnri", "cnri python license"),
    ("qhull", "qhull license"),
    ("qpl-1.0", "q public license(?: version)?(?: 1 0)?"),
    ("realnetworks", "realnetworks public source license"),
    ("ricoh", "ricoh source code public license"),
    ("rpl-1.5", "reciprocal public license(?: 1 5)?"),
    ("sax-pd", "sax public domain notice"),
    ("sgi-b", "sgi free software license b"),
    ("simple-2.0", "simple public license(?: 2 0)?"),
    ("sissl", "sun industry standards source license"),
    ("sleepycat", "sleepycat license"),
    ("smlnj", "standard ml of new jersey license"),
    ("spl-1.0", "sun public license(?: v(?:ersion)?)?(?: 1 0)?"),
    ("sugarcrm", "sugarcrm public license"),
    ("tcl", "tcl tk license"),
    ("unicode", "unicode license(?: agreement)?"),
    ("unicode-tou", "unicode terms of use license"),
    ("vostrom", "vostrom public license"),
    ("vsl-1.0", "vovida software license"),
    ("w3c", "w3c software(?: notice and)? license"),
    ("watcom", "sybase open watcom public license"),
    ("x-net", "x net license"),
    ("xfree86", "xfree86 license"),
    ("zend", "zend(?: engine)? license"),
    ("zimbra", "zimbra public license"),
    ("zpl-2.1", "zope public license(?: v(?:ersion)?)?(?: ?2 1)?"),
    ("llama", "llama (?:2 |3 )?community license"),
    ("gemma", "gemma terms of use license"),
    ("bigcode-openrail", "bigcode open ?rail m"),
    ("cecill", "cecill(?: [abc])?(?: free software)?(?: license)?"),
    ("openrail", "open ?rail(?: m)?"),
    ("openrail", "responsible ai license(?: m)?"),
)
#: label, regular expression of sentences that licenses consist of, read without a name
CLAUSES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}?nor the names of its contributors may be used"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "this library is free software you can redistribute it and or modify it"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by", "(?:licensed|available|distributed|released) under(?: the)? cc by"),
    ("public-domain", "released(?: in)?(?:to)? the public domain"),
    ("public-domain", "placed(?: in)?(?:to)? the public domain"),
    ("public-domain", "dedicated(?: in)?(?:to)? the public domain"),
    ("public-domain", "this work is in the public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
    ("unknown-license", "licensed under (?:the )?(?:terms of )?(?:the )?(?:[^ ]+ ){0,3}?licen[cs]e"),
    ("unknown-license", "see (?:the )?licen[cs]e file"),
    ("unknown-license", "spdx license identifier"),
)
#: substrings of one word each, since the words of a rule may be parted by anything; a text without any of them is not scanned
KEYWORDS = (
    "licen", "cc0", "cc", "creative", "gpl", "domain", "rights", "permission", "redistribut", "wtfpl", "classpath", "runtime", "variant",
    "confidential", "advertising", "neither", "warrant", "cecill", "rail", "commons", "good", "perl", "mulan", "attribution", "affero", "clause",
)
#: the same for names that are too short for a substring
SHORT = "(?i)(?<![a-z0-9])(?:mpl|epl|asl)(?![a-uw-z])"
#: how a rule that adds words to a name is written, its priority (less is better) and its confidence
FORMS = (("{}", 2, 0.8), ("licensed under (?:the )?(?:terms of )?(?:the )?{}", 1, 0.95), ("spdx license identifier {}", 0, 1.0))


def fragment_of(pattern: str) -> str:
    """The longest piece that every match of ``pattern`` spells out; the patterns above escape nothing."""
    required = re.sub(r"\[[^]]*\]", "\0", pattern)
    while "(" in required:  # groups may be left out or have alternatives
        start = required.rindex("(")
        end = required.index(")", start) + 1
        required = required[:start] + "\0" + required[end + (required[end : end + 1] in ("?", "*")) :]
    return max(re.sub(r"\{[^}]*\}\??|.\?", "\0", required).split("\0"), key=len)


def word_of(pattern: str) -> str:
    """The longest whole word that every match of ``pattern`` spells out; empty if there is none."""
    piece = fragment_of(pattern)
    words = piece.split(" ")
    inner = words[0 if pattern.startswith(piece) else 1 : None if pattern.endswith(piece) else -1]
    return max(inner, key=len, default="")


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, pattern that has to be found first, regular expression, priority, confidence) of all rules, best first."""
    found = [(label, p, f.format(f"(?:{p})"), prio * 1000 + k, conf) for f, prio, conf in FORMS for k, (label, p) in enumerate(NAMES)]
    found += [(label, p, p, 3000 + k, 0.7) for k, (label, p) in enumerate(CLAUSES)]
    return sorted(((label, p, f"(?<= )(?:{full})(?= )", prio, conf) for label, p, full, prio, conf in found), key=lambda r: r[3])


def count_words(text: Column) -> Column:
    """How many words a text has. (Cutting at what is no word takes time in proportion to a text; extracting all matches copies the text for each.)"""
    def of(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        return F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - ((F.size(parts) > 1) & (last == "")).cast("int")

    return once(F.split(text, PARTS_ANY_CASE), of).cast("long")


def line_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), PARTS, " ")


def places(words: Column, pattern: Column | str) -> Column:
    """Word intervals (start, end) of the matches of a pattern in space-separated words with a space around."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.split(F.trim(F.regexp_replace(words, pattern, F.lit("\x01$0\x02"))), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\x01"), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(marked, lambda w, i: F.when(w.endswith("\x02"), i + 1)), lambda i: i.isNotNull())
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places of base phrases, detections after suppression) of every text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    listed = lambda values: F.split(F.lit("\n".join(values)), "\n")  # noqa: E731  a constant array
    all_rules, firsts = rules(), sorted({p for _, p, _, _, _ in rules()})
    table_of_firsts = F.arrays_zip(listed([f"(?<= )(?:{p})(?= )" for p in firsts]).alias("pattern"), listed(map(fragment_of, firsts)).alias("piece"), listed(map(word_of, firsts)).alias("word"), listed(map(str, range(len(firsts)))).alias("number"))
    words_of_firsts = listed(sorted(set(map(word_of, firsts))))
    number = {p: str(k) for k, p in enumerate(firsts)}
    # Rules are sorted, so that a rule's place is its priority.
    table_of_rules = F.arrays_zip(listed([r[0] for r in all_rules]).alias("label"), listed([number[r[1]] for r in all_rules]).alias("first"), listed([r[2] for r in all_rules]).alias("pattern"), F.sequence(F.lit(0), F.lit(len(all_rules) - 1)).alias("priority"), F.transform(listed([str(r[4]) for r in all_rules]), lambda c: c.cast("double")).alias("confidence"))

    def base(w: Column) -> Column:
        def of(phrase: str, label: str) -> Column:
            found = F.when(F.contains(w, F.lit(f" {phrase} ")), places(w, f"(?<= ){phrase}(?= )")).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
            return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))

        return F.concat(*[of(*x) for x in BASE])

    def detect(w: Column) -> Column:
        # A pattern is compiled and tried only where the text holds its longest word and its piece; few texts match any, and only their rules are looked for.
        known = F.array_union(F.array_intersect(F.split(w, " "), words_of_firsts), F.array(F.lit("")))
        held = once(known, lambda known: F.filter(table_of_firsts, lambda z: F.array_contains(known, z["word"])))
        met = F.transform(F.filter(held, lambda z: F.contains(w, z["piece"]) & F.regexp_like(w, z["pattern"])), lambda z: z["number"])
        tried = once(met, lambda met: F.filter(F.when(F.size(met) > 0, table_of_rules).otherwise(F.slice(table_of_rules, 1, 0)), lambda r: F.array_contains(met, r["first"])))
        found = F.flatten(F.transform(tried, lambda r: F.transform(places(w, r["pattern"]), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus_end"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
        first = F.struct(F.lit(-1).alias("until"), F.lit(0).alias("priority"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("labels"))

        def step(s: Column, d: Column) -> Column:
            kept = (-d["minus_end"] > s["until"]) & ((d["start"] >= s["until"]) | (d["priority"] < s["priority"]))
            after = F.struct((-d["minus_end"]).alias("until"), d["priority"].alias("priority"), F.greatest(s["confidence"], d["confidence"]).alias("confidence"), F.array_union(s["labels"], F.array(d["label"])).alias("labels"))
            return F.when(kept, after).otherwise(s)

        return F.aggregate(F.array_sort(found), first, step)

    gated = once(F.lower("text"), lambda t: reduce(lambda a, k: a | F.contains(t, F.lit(k)), KEYWORDS, F.lit(False))) | F.regexp_like("text", F.lit(SHORT))
    result = once(F.when(gated, line_of(F.col("text"))), lambda w: F.when(w.isNotNull(), F.struct(base(w).alias("base"), detect(w).alias("found"))))
    return src.select("doc_id", count_words(F.col("text")).alias("n_words"), result.alias("r")).select(
        "doc_id",
        "n_words",
        F.coalesce("r.base", F.array().cast("array<struct<start:int,label:string>>")).alias("base"),
        F.coalesce("r.found.labels", F.array().cast("array<string>")).alias("found"),
        F.coalesce("r.found.confidence", F.lit(0.0)).alias("confidence"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document scanned for licenses."""
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.col("found"))), ",").alias("labels"),
        F.greatest(F.col("confidence"), F.when(F.size("base") > 0, 0.6).otherwise(0.0)).alias("score"),
    )
