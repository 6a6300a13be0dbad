"""License scans by sentence rules: normalised sentences become identifiers, identifier sequences match ordered rules.

Everything happens inside a row with built-in functions; there is no shuffle and no user function. A
text falls into pieces at line ends and at . ! ? ; : followed by white space, and is normalised to lower-case
letters and digits parted by one space, so comment leaders go. A known sentence is found where it begins and
ends with a piece; between its words pieces may end, so it may be wrapped over lines, blank ones included. Besides sentences
of fixed words, which may have an optional phrase, there are templates: sentences with a slot for a name (a holder), everyday references
("This project is licensed under the terms of the MIT License (see LICENSE).") and SPDX lines with expressions. Of sentences that begin at
one place fixed words come first, then slots, SPDX lines and references, and of each kind the longest counts. Unknown sentences between known
ones are ignored. Rules are tried along the sequence of identifiers, longest first, and one that fits uses its identifiers up,
so a text of three BSD clauses is not one of two clauses as well; nor is a text with an endorsement clause that no sentence knows.

Defined cases: null and empty texts give no sentences and an empty licence list; a repeated sentence gives
its identifier again; several licences are listed once each in alphabetic order; identifiers must not be empty or hold
white space; input columns keep their values, but the operator's own output columns replace input columns of the same names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import text_table

#: Known sentences (normalised) by identifier.
SENTENCES = {
    "apache_ref": "licensed under the apache license version 2 0",
    "apache_may_not": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_ref": "released under the mit license",
    "mit_lic": "licensed under the mit license",
    "mit_title": "the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software",
    "mit_asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3_ref": "this work is licensed under the gnu general public license version 3",
    "gpl2_ref": "this work is licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "cc_by_sa_4": "licensed under cc by sa 4 0",
    "bsd_redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of <name> nor the names of [its] contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
#: Ordered rules, each a licence and the identifiers that make it out.
RULES = (
    ("Apache-2.0", ("apache_ref",)),
    ("Apache-2.0", ("apache_may_not", "apache_copy", "apache_asis")),
    ("BSD-2-Clause", ("bsd_redist", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",)),
    ("GPL-2.0-only", ("gpl2_ref",)),
    ("GPL-3.0-only", ("gpl3_ref",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope")),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_lic",)),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("MIT", ("mit_title", "mit_grant", "mit_notice")),
)
_GPL = "redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_FREE = "this {} is free software you can " + _GPL
#: Sentences of further licences, notices and of the headings of whole licence texts.
MORE_SENTENCES = {
    "apache_ref_quoted": "licensed under the apache license version 2 0 the license",
    "apache_copy_https": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "gpl2_free": _FREE.format("program", "general public license", "2"),
    "lgpl2_free": _FREE.format("library", "library general public license", "2"),
    "lgpl21_free": _FREE.format("library", "lesser general public license", "2 1"),
    "lgpl3_free": _FREE.format("library", "lesser general public license", "3"),
    "lgpl3_free_program": _FREE.format("program", "lesser general public license", "3"),
    "agpl3_free": _FREE.format("program", "affero general public license", "3"),
    "mpl2_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "boost_ref": "distributed under the boost software license version 1 0",
    "boost_title": "boost software license version 1 0 august 17th 2003",
    "apache_title": "apache license version 2 0 january 2004",
    "mit_word": "mit license",
    "gpl2_title": "gnu general public license version 2 june 1991",
    "gpl3_title": "gnu general public license version 3 29 june 2007",
    "lgpl21_title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3_title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3_title": "gnu affero general public license version 3 19 november 2007",
    "mpl2_title": "mozilla public license version 2 0",
    "epl2_title": "eclipse public license v 2 0",
    "epl2_ref": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "cc0_title": "cc0 1 0 universal",
    "cc0_ref": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc_by_4_title": "attribution 4 0 international",
    "cc_by_sa_4_title": "attribution sharealike 4 0 international",
    "cc_by_nc_4_title": "attribution noncommercial 4 0 international",
    "cc_by_nd_4_title": "attribution noderivatives 4 0 international",
    "cc_by_4_ref": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc_by_sa_4_ref": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc_by_nc_4_ref": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "zlib_asis": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsd_endorse_the": "the name of <name> may not be used to endorse or promote products derived from this software without specific prior written permission",
}
MORE_RULES = (
    ("AGPL-3.0-or-later", ("agpl3_free",)),
    ("Apache-2.0", ("apache_ref_quoted",)),
    ("Apache-2.0", ("apache_may_not", "apache_copy_https", "apache_asis")),
    ("BSL-1.0", ("boost_ref",)),
    ("GPL-2.0-or-later", ("gpl2_free",)),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_grant_and",)),
    ("LGPL-2.0-or-later", ("lgpl2_free",)),
    ("LGPL-2.1-or-later", ("lgpl21_free",)),
    ("LGPL-3.0-or-later", ("lgpl3_free",)),
    ("LGPL-3.0-or-later", ("lgpl3_free_program",)),
    ("MPL-2.0", ("mpl2_subject",)),
    ("Unlicense", ("unlicense_free",)),
    ("MIT", ("mit_word", "mit_grant", "mit_notice")),
    ("MIT", ("mit_word", "mit_grant", "mit_notice", "mit_asis")),
    ("Apache-2.0", ("apache_title",)),
    ("BSL-1.0", ("boost_title",)),
    ("GPL-2.0-only", ("gpl2_title",)),
    ("GPL-3.0-only", ("gpl3_title",)),
    ("LGPL-2.1-only", ("lgpl21_title",)),
    ("LGPL-3.0-only", ("lgpl3_title",)),
    ("AGPL-3.0-only", ("agpl3_title",)),
    ("MPL-2.0", ("mpl2_title",)),
    ("EPL-2.0", ("epl2_title",)),
    ("EPL-2.0", ("epl2_ref",)),
    ("CC0-1.0", ("cc0_title",)),
    ("CC0-1.0", ("cc0_ref",)),
    ("CC-BY-4.0", ("cc_by_4_title",)),
    ("CC-BY-4.0", ("cc_by_4_ref",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4_title",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4_ref",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4_title",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4_ref",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_4_title",)),
    ("Zlib", ("zlib_asis", "zlib_grant")),
    ("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_endorse_the")),
)
#: A licence that a rule gives only if the text holds no such phrase outside of these sentences.
BLOCKED = {"BSD-2-Clause": ("endorse or promote products", ("bsd_endorse", "bsd_endorse_the"))}

#: How licences are called in everyday lines, normalised, by SPDX identifier. A word license may follow.
NAMES = {
    "MIT": ("mit", "mit x11", "x11 mit", "expat"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0", "apache license v2 0", "apache license v2", "apache license 2", "apache license version 2", "apache v2", "apache 2", "apache software license 2 0"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "bsd two clause", "two clause bsd", "simplified bsd", "freebsd"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "bsd three clause", "three clause bsd", "new bsd", "modified bsd", "revised bsd"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mpl 2 0", "mpl v2 0", "mpl2"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "epl 2 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license 1 0", "epl 1 0"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "boost 1 0"),
    "CC0-1.0": ("cc0 1 0 universal", "cc0 1 0", "cc0", "creative commons zero 1 0", "creative commons zero v1 0 universal"),
    "ISC": ("isc",), "Zlib": ("zlib", "zlib libpng"), "Unlicense": ("unlicense",), "WTFPL": ("wtfpl",), "0BSD": ("0bsd", "bsd zero clause", "zero clause bsd"), "PostgreSQL": ("postgresql",),
    "Artistic-2.0": ("artistic license 2 0", "artistic 2 0"), "OFL-1.1": ("sil open font license 1 1", "sil open font license version 1 1", "ofl 1 1"), "Python-2.0": ("psf", "python software foundation"),
}
#: Further SPDX identifiers, which are only known by their own spelling.
IDENTIFIERS = "AFL-3.0 Apache-1.1 APSL-2.0 BlueOak-1.0.0 BSD-4-Clause BUSL-1.1 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EUPL-1.1 EUPL-1.2 HPND MIT-0 MPL-1.1 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OpenSSL OSL-3.0 PHP-3.01 Ruby Unicode-3.0 Unicode-DFS-2016 UPL-1.0 Vim W3C X11 ZPL-2.1 bzip2-1.0.6 curl libpng-2.0 libtiff".split()


def _families() -> dict[str, tuple[str, ...]]:
    """The names of the GNU and Creative Commons licences, by rule."""
    out = {}
    for short, long, versions in (("gpl", "general public license", ("2.0", "3.0")), ("lgpl", "lesser general public license", ("2.1", "3.0")), ("agpl", "affero general public license", ("3.0",))):
        for version in versions:
            number = version.removesuffix(".0").replace(".", " ")
            forms = [f"{n} {v}{x}" for n in (f"gnu {long}", f"gnu {short}", short, long) for v in ("version ", "v ", "v", "") for x in dict.fromkeys((number, version.replace(".", " ")))] + [f"{short}v{number}", f"gnu {short}v{number}"]
            out[f"{short.upper()}-{version}-only"] = (*forms, *[f"{x} only" for x in forms])
            out[f"{short.upper()}-{version}-or-later"] = tuple(f"{x} {y}" for x in forms for y in ("or later", "or any later version", "or at your option any later version", "or newer"))
    words = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            v, long = version.replace(".", " "), " ".join(words[x] for x in parts)
            short = " ".join(parts)
            spread = long.replace("noncommercial", "non commercial").replace("sharealike", "share alike").replace("noderivatives", "no derivatives")
            names = [f"cc {short} {v}", f"creative commons {short} {v}", *[f"creative commons {x} {v}{y}" for x in dict.fromkeys((long, spread)) for y in ("", " international", " unported")]]
            out["-".join(["CC", *[x.upper() for x in parts], version])] = tuple(names)
    return out


def _spelled(identifier: str) -> str:
    return re.sub("[^a-z0-9]+", " ", identifier.lower()).strip()


ALL_NAMES = NAMES | _families()
#: Normalised names to licences: of references, and of SPDX identifiers (with the older ones of the GNU licences, which say no more than the version).
REFERRED = {name: licence for licence, names in ALL_NAMES.items() for name in (*names, _spelled(licence))}
EXPRESSED = {_spelled(x): x for x in (*ALL_NAMES, *IDENTIFIERS)} | {_spelled(x.removesuffix("-only")): x for x in ALL_NAMES if x.endswith("-only")}
#: What stands before and behind a licence's name in a reference.
SUBJECTS = "this project|this work|this software|this program|this library|this package|this file|this code|this repository|this module|this tool|this document|the project|the software|the code|the source code|this source code|source code|the library|all code|all files|everything|it"
VERBS = "licensed under|licenced under|dual licensed under|released under|distributed under|available under|made available under|published under|provided under|offered under|shared under|open sourced under|covered by|governed by|under|license|licence|licensed|license is"
TERMS = "the |a |an |the terms of the |the terms and conditions of the |terms of the "
TAILS = "see license|see the license|see licence|see license file|see the license file|see the file license|see license md|see license txt|see license for details|see the license file for details|see license file for details|see license for more information|the license|for details see license|or later versions"
#: Words of a slot <name>, at most.
SLOT = 8
PIECE_END = r"[.!?;:]\s+|\n"
NOT_WORD = "[^a-z0-9|]+"


def _either(options) -> str:
    return "|".join(sorted(options, key=lambda x: (-len(x), x)))


def references(referred: dict[str, str]) -> str:
    """An everyday line: a subject or up to four words of a project's name, a verb, and the name of a licence (the group)."""
    return rf"(?:(?:{SUBJECTS}|[a-z0-9]+(?: [a-z0-9]+){{0,3}}) (?:is |are ))?(?:{_either(VERBS.split('|'))}) (?:{_either(TERMS.split('|'))})?({_either(referred)})(?: license| licence)?(?: (?:{_either(TAILS.split('|'))}))?"


def expressions(expressed: dict[str, str]) -> str:
    """An SPDX line: identifiers joined by and, or, with (the group)."""
    one = rf"(?:{_either(expressed)})(?: with [a-z0-9]+(?: [a-z0-9]+){{0,4}}? (?:exception|note)(?: [0-9]+){{0,2}})?"
    return rf"spdx license identifier ({one}(?: (?:and|or) {one})*)"


def variants(sentence: str) -> list[str]:
    """A sentence with and without each [optional phrase]."""
    head, mark, rest = sentence.partition("[")
    if not mark:
        return [sentence]
    inner, _, tail = rest.partition("]")
    return [f"{head}{x}{y}" for x in (inner, "") for y in variants(tail if x else tail.removeprefix(" "))]


def _with_slots(sentence: str) -> str:
    return sentence.replace("<name>", rf"[a-z0-9]+(?: [a-z0-9]+){{0,{SLOT - 1}}}")


def spelled_out(sentences: dict[str, str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(sentence, identifier) of sentences without slots, and (expression, identifier) of those with."""
    pairs = [(v, k) for k, s in sentences.items() for v in variants(s)]
    return [p for p in pairs if "<" not in p[0]], [(_with_slots(v), k) for v, k in pairs if "<" in v]


def anchors(sentences: dict[str, str]) -> list[str]:
    """The longest word of each sentence. A text that holds a sentence holds its word, so texts without any need no further look."""
    words = {max((w for w in v.split() if "<" not in w), key=len) for s in sentences.values() for v in variants(s)}
    return sorted(words | {"licen", "spdx", "under", "covered", "governed"})


def _pieces(text: Column) -> Column:
    """The normalised words of a text, with | before, between and after its pieces. A + behind a version is "or later"."""
    low = F.regexp_replace(F.lower(F.translate(text, "|", ",")), r"([0-9])\+", "$1 or later ")
    marked = F.regexp_replace(low, PIECE_END, "|")
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("|"), marked, F.lit("|")), NOT_WORD, " "), r" ?\|[ |]*", " | ")


def template_rules(referred: dict[str, str] = REFERRED, expressed: dict[str, str] = EXPRESSED) -> tuple:
    """A rule for each licence that a reference or an SPDX line can name."""
    return tuple((x, (f"{kind}{_spelled(x).replace(' ', '_')}",)) for kind, names in (("ref_", referred), ("spdx_", expressed)) for x in sorted(set(names.values())))


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs for x in (k, v)])


def scanned(docs: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES | MORE_SENTENCES, rules: tuple = RULES + MORE_RULES, blocked: dict = BLOCKED) -> DataFrame:
    """docs with sentence_ids (array, in text order) and licenses (array, sorted)."""
    plain, slotted = spelled_out(sentences)
    reference, expression = references(REFERRED), expressions(EXPRESSED)
    wrap = lambda x: x.replace(" ", r"(?: \|)? ")  # noqa: E731  between its words pieces may end
    wrapped = "|".join([wrap(v) for v in sorted((v for v, _ in plain), key=lambda v: (-len(v), v))] + [f"(?:{wrap(x)})" for x in (*[v for v, _ in slotted], expression, reference)])
    found = F.regexp_extract_all(_pieces(F.col(text)), F.lit(rf"(?<=\| )(?:{wrapped})(?= \|)"), F.lit(0))
    known, names, expressed = _map(plain), _map((k, "ref_" + _spelled(v).replace(" ", "_")) for k, v in REFERRED.items()), _map((k, "spdx_" + _spelled(v).replace(" ", "_")) for k, v in EXPRESSED.items())

    def ids(sentence: Column) -> Column:
        one = F.coalesce(known[sentence], *[F.when(sentence.rlike(f"^(?:{x})$"), F.lit(i)) for x, i in slotted])
        listed = F.transform(F.regexp_extract_all(F.concat(F.lit(" "), F.regexp_extract(sentence, f"^{expression}$", 1), F.lit(" ")), F.lit(f"(?<= )(?:{_either(EXPRESSED)})(?= )"), F.lit(0)), lambda x: expressed[x])
        return F.when(one.isNotNull(), F.array(one)).when(sentence.startswith("spdx "), listed).otherwise(F.array(names[F.regexp_extract(sentence, f"^{reference}$", 1)]))

    hits = F.when(F.lower(text).rlike("|".join(anchors(sentences))), F.flatten(F.transform(found, lambda s: ids(F.replace(s, F.lit(" |"), F.lit(""))))))
    df = docs.withColumn("sentence_ids", F.coalesce(hits, F.array().cast("array<string>")))
    spelled = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit(" "), i, F.lit(" "))), "")  # each identifier between blanks of its own
    sequences = {"".join(f" {i} " for i in ids): name for name, ids in (*template_rules(), *rules)}
    longest = "|".join(re.escape(x) for x in sorted(sequences, key=lambda x: (-x.count("  "), x)))
    name_of = _map(sequences.items())
    fits = F.transform(F.regexp_extract_all(spelled, F.lit(longest), F.lit(0)), lambda x: name_of[x])
    held = F.array_sort(F.array_distinct(fits))
    for licence, (phrase, known_ids) in blocked.items():
        other = F.array_contains(held, licence) & ~F.arrays_overlap("sentence_ids", F.array(*[F.lit(i) for i in known_ids])) & F.contains(F.replace(_pieces(F.col(text)), F.lit(" |"), F.lit("")), F.lit(phrase))
        held = F.when(other, F.array_remove(held, licence)).otherwise(held)
    return df.withColumn("licenses", held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scanned(text_table(spark, sf_dir).select("doc_id", "text"))
    return df.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


_PLAIN, _SLOTTED = spelled_out(SENTENCES | MORE_SENTENCES)
_KNOWN = ", ".join(f"('{k}', '{v}')" for v, k in _PLAIN)
_RULES = ", ".join(f"('{name}', [{', '.join(repr(i) for i in ids)}])" for name, ids in (*template_rules(), *RULES, *MORE_RULES))
_MAPS = [", ".join(f"('{k}', '{kind}{_spelled(v).replace(' ', '_')}')" for k, v in names.items()) for kind, names in (("ref_", REFERRED), ("spdx_", EXPRESSED))]
_SLOT_IDS = " ".join(f"WHEN regexp_full_match(t, '{x}') THEN ['{i}']" for x, i in _SLOTTED)
#: By places of words instead of a pattern: words with the number of their piece, known sentences by their first word and
#: their joined words, templates by the words between the beginning and the end of pieces, and both greedy choices as folds over lists.
ORACLE_SQL = rf"""
WITH known AS (SELECT id, string_split(s, ' ') AS ws, len(string_split(s, ' ')) AS n FROM (VALUES {_KNOWN}) v(id, s)),
rules AS (SELECT *, len(ids) AS n FROM (VALUES {_RULES}) v(license, ids)),
refs AS (SELECT map_from_entries(list((name, id))) AS m FROM (VALUES {_MAPS[0]}) v(name, id)),
spdx AS (SELECT map_from_entries(list((name, id))) AS m FROM (VALUES {_MAPS[1]}) v(name, id)),
pieces AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '([0-9])\+', '\1 or later ', 'g'), '[.!?;:]\s+|\n') AS ps FROM documents)),
bare AS (SELECT doc_id, pi, list_filter(regexp_split_to_array(p, '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM pieces),
words AS (
  SELECT doc_id, pi, w, k = 1 AS opens, k = n AS shuts, row_number() OVER (PARTITION BY doc_id ORDER BY pi, k) AS i
  FROM (SELECT doc_id, pi, unnest(ws) AS w, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM bare)),
whole AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM words GROUP BY doc_id),
hits AS (
  SELECT a.doc_id, a.i AS first, a.i + known.n - 1 AS last, [known.id] AS ids, 0 AS kind
  FROM words a JOIN known ON a.w = known.ws[1]
  JOIN words b ON a.doc_id = b.doc_id AND b.i = a.i + known.n - 1 AND b.w = known.ws[-1] JOIN whole ON whole.doc_id = a.doc_id
  WHERE a.opens AND b.shuts AND known.ws = whole.ws[a.i:a.i + known.n - 1]),
runs AS (
  SELECT a.doc_id, a.i AS first, b.i AS last, array_to_string(whole.ws[a.i:b.i], ' ') AS t
  FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 60 JOIN whole ON whole.doc_id = a.doc_id
  WHERE a.opens AND b.shuts AND len(list_filter(whole.ws[a.i:b.i], lambda w: contains(w, 'licen') OR w IN ('under', 'spdx', 'endorse', 'covered', 'governed'))) > 0),
made AS (
  SELECT doc_id, first, last, CASE {_SLOT_IDS} WHEN regexp_full_match(t, '{expressions(EXPRESSED)}')
    THEN list_transform(regexp_extract_all(' ' || replace(regexp_extract(t, '^{expressions(EXPRESSED)}$', 1), ' ', '  ') || ' ', ' (' || replace('{_either(EXPRESSED)}', ' ', '  ') || ') ', 1), lambda x: spdx.m[replace(x, '  ', ' ')])
    WHEN regexp_full_match(t, '{references(REFERRED)}') THEN [refs.m[regexp_extract(t, '^{references(REFERRED)}$', 1)]] END AS ids,
    CASE {_SLOT_IDS.replace("THEN [", "THEN len([").replace("']", "']) * 0 + 1")} WHEN t LIKE 'spdx %' THEN 2 ELSE 3 END AS kind
  FROM runs, refs, spdx),
listed AS (SELECT doc_id, list({{'first': first, 'last': last, 'ids': ids}} ORDER BY first, kind, last DESC) AS hs FROM (FROM hits UNION ALL FROM made WHERE ids IS NOT NULL) GROUP BY doc_id),
chosen AS (
  SELECT doc_id, list_reduce(hs, lambda done, h: CASE WHEN h[1].first > done[-1].last THEN list_concat(done, h) ELSE done END) AS hs
  FROM (SELECT doc_id, list_transform(hs, lambda h: [h]) AS hs FROM listed)),
spelled AS (SELECT doc_id, flatten(list_transform(hs, lambda h: h.ids)) AS ids FROM chosen),
fits AS (
  SELECT s.doc_id, i AS first, i + r.n - 1 AS last, r.license
  FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM spelled) s JOIN rules r ON s.ids[s.i:s.i + r.n - 1] = r.ids),
ranked AS (SELECT doc_id, list({{'first': first, 'last': last, 'license': license}} ORDER BY first, last DESC) AS fs FROM fits GROUP BY doc_id),
used AS (
  SELECT doc_id, list_reduce(fs, lambda done, f: CASE WHEN f[1].first > done[-1].last THEN list_concat(done, f) ELSE done END) AS fs
  FROM (SELECT doc_id, list_transform(fs, lambda f: [f]) AS fs FROM ranked)),
blocked AS (SELECT w.doc_id FROM whole w LEFT JOIN spelled s ON s.doc_id = w.doc_id WHERE contains(array_to_string(w.ws, ' '), 'endorse or promote products') AND NOT list_has_any(coalesce(s.ids, []), ['bsd_endorse', 'bsd_endorse_the'])),
named AS (SELECT used.doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(fs, lambda f: f.license), lambda x: x <> 'BSD-2-Clause' OR b.doc_id IS NULL))), ',') AS licenses FROM used LEFT JOIN blocked b ON b.doc_id = used.doc_id)
SELECT d.doc_id, coalesce(len(s.ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(s.ids, ' '), '') AS sentence_ids, coalesce(n.licenses, '') AS licenses
FROM documents d LEFT JOIN spelled s ON d.doc_id = s.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""
