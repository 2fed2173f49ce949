"""Licence scans by sentences and rules.

A text is cut into sentences; a normalised sentence (lower case, letters and digits only, single spaces) that stands in the
table of known licence sentences becomes that sentence's identifier. The sequence of a text's identifiers is then matched
against ordered rules: each rule is a run of consecutive identifiers, longer and stricter rules come first, and what one rule
has matched is taken away before the next is tried. Sentences that are not known may stand between the known ones. A sentence
begins and ends at a sentence end or a line feed, and line feeds may stand within it, so that wrapped texts are known as well.

Defined results: a null text counts as empty (no licences); repeated rows, null ids, empty tables and further columns make no
difference, one row comes out for each row in, and only a column of docs that has the name of a result gives way to it; a licence
that occurs twice is listed once. Texts are scanned whole. A text
without any of the words that every known sentence has one of is not cut into sentences, as it can have no identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

#: Normalised sentence -> identifier. One character each in a sequence: their place in this table.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-notice",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "spdx license identifier apache 2 0": "apache2-tag",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice-2",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "spdx license identifier mit": "mit-tag",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl2-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    "see the gnu general public license for more details": "gpl-details",
    "spdx license identifier gpl 3 0 only": "gpl3-tag",
    "spdx license identifier gpl 3 0 or later": "gpl3-tag-later",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "licensed under cc0 1 0": "cc0-1",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "all rights reserved without any license": "reserved",
}
#: Every known sentence has one of these.
HINTS = ("licens", "copyright", "permi", "warrant", "redistribut", "mpl", "unencumbered")
#: (licence, identifiers in order, whether commercial use is restricted), in the order in which they are tried.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-warranty"), False),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty"), False),
    ("Apache-2.0", ("apache2-notice", "apache2-copy", "apache2-warranty"), False),
    ("GPL", ("gpl-grant", "gpl-details"), True),
    ("BSD", ("bsd-grant", "bsd-source"), False),
    ("Apache-2.0", ("apache2-notice",), False),
    ("Apache-2.0", ("apache2-tag",), False),
    ("MIT", ("mit-notice",), False),
    ("MIT", ("mit-notice-2",), False),
    ("MIT", ("mit-tag",), False),
    ("MIT", ("mit-grant",), False),
    ("GPL-3.0", ("gpl3-notice",), True),
    ("GPL-3.0", ("gpl3-tag",), True),
    ("GPL-3.0", ("gpl3-tag-later",), True),
    ("GPL-2.0", ("gpl2-notice",), True),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",), True),
    ("CC-BY-4.0", ("cc-by-4",), False),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",), False),
    ("CC0-1.0", ("cc0-1",), False),
    ("BSD", ("bsd-grant",), False),
    ("proprietary", ("reserved",), True),
)

_GPL = "you can redistribute it and or modify it under the terms of the gnu {}general public license"
_FSF = "as published by the free software foundation"
_CC = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
#: (identifier, the word in the licence's name, versions) of the GPL and its relatives.
_FAMILY = (("gpl", "", ("2", "3")), ("lgpl", "lesser ", ("2 1", "3")), ("agpl", "affero ", ("3",)))
#: The sentences of the licences' own texts and headers, where these are longer than the ones above or of other licences.
FULL = {
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2-copy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of its holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "this is free and unencumbered software released into the public domain": "unlicense",
    **{f"this work is licensed under {a} creative commons {name} {v} international license": f"cc-{k}-{v[0]}-text" for k, name in _CC.items() for a in ("a", "the") for v in ("4 0",)},
    **{f"spdx license identifier {tag.lower().replace('-', ' ').replace('.', ' ')}": f"tag-{tag}" for tag in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Zlib", "BSL-1.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "Unlicense")},
    **{
        f"{start}{_GPL.format(kind)} {rest}": f"{name}{v[0]}-grant"
        for name, kind, versions in _FAMILY
        for v in versions
        for start in ("", "this program is free software ", "this library is free software ")
        for rest in (f"{_FSF} either version {v} of the license or at your option any later version", f"{_FSF} version {v} of the license", f"{_FSF} version {v}", f"version {v} {_FSF}", f"version {v} only {_FSF}")
    },
    **{f"{start}licensed under the {name}{end}": x for start in ("this project is ", "") for end in (" see the license file for details", " see the license md file for details", " see license for details", " see the license file", " see license md for details") for name, x in (("mit license", "mit-notice-2"), ("apache license 2 0", "apache2-notice"), ("apache license version 2 0", "apache2-notice"), ("gnu general public license v3 0", "gpl3-notice"))},
    **{f"{start} apache license version 2 0 the license": "apache2-notice" for start in ("the asf licenses this file to you under the", "licenses this file to you under the")},
    _GPL.format(""): "gpl-grant",
    "licensed to the apache software foundation asf under one or more contributor license agreements": "apache2-contributors",
    "apache license version 2 0 january 2004": "apache2-title",
    **{f"gnu {kind}general public license version {v}": f"{name}{v[0]}-title" for name, kind, v in (("gpl", "", "3 29 june 2007"), ("gpl", "", "2 june 1991"), ("lgpl", "lesser ", "3 29 june 2007"), ("lgpl", "lesser ", "2 1 february 1999"), ("agpl", "affero ", "3 19 november 2007"))},
    **{f"this work is licensed under cc {k.replace('-', ' ')} 4 0": f"cc-{k}-4-text" for k in _CC},
    **{f"this work is licensed under a creative commons {name} 3 0 unported license": f"cc-{k}-3-text" for k, name in _CC.items()},
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "boost-notice",
    "boost software license version 1 0 august 17th 2003": "boost-notice",
    **{f"this program and the accompanying materials are made available under the terms of the eclipse public license v {v} {rest}": f"epl{v[0]}-notice" for v, rest in (("1 0", "which accompanies this distribution and is available at http www eclipse org legal epl v10 html"), ("1 0", "which accompanies this distribution"), ("2 0", "which is available at https www eclipse org legal epl 2 0"), ("2 0", "which accompanies this distribution and is available at https www eclipse org legal epl 2 0"))},
    "see the gnu lesser general public license for more details": "lgpl-details",
    "see the gnu affero general public license for more details": "agpl-details",
}
#: As RULES; tried before these, the longer first.
FULL_RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), False),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), False),
    *((f"{name.upper()}-{v.replace(' ', '.') if ' ' in v else v + '.0'}", ids, True) for name, _, versions in _FAMILY for v in versions for ids in ((f"{name}{v[0]}-grant", f"{name}-details"), (f"{name}{v[0]}-grant",))),
    ("Apache-2.0", ("apache2-title",), False),
    *((f"{name.upper()}-{v}", (f"{name}{v[0]}-title",), True) for name, v in (("gpl", "3.0"), ("gpl", "2.0"), ("lgpl", "3.0"), ("lgpl", "2.1"), ("agpl", "3.0"))),
    *((f"CC-{k.upper()}-3.0", (f"cc-{k}-3-text",), "nc" in k or "nd" in k) for k in _CC),
    ("Zlib", ("zlib-warranty", "zlib-grant"), False),
    ("Zlib", ("zlib-grant",), False),
    ("BSL-1.0", ("boost-notice",), False),
    ("EPL-1.0", ("epl1-notice",), False),
    ("EPL-2.0", ("epl2-notice",), False),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy"), False),
    ("MPL-2.0", ("mpl2-notice",), False),
    ("ISC", ("isc-grant",), False),
    ("Unlicense", ("unlicense",), False),
    *((f"CC-{k.upper()}-4.0", (f"cc-{k}-4-text",), "nc" in k or "nd" in k) for k in _CC),
    *((x[4:].removesuffix("-only").removesuffix("-or-later"), (x,), "GPL" in x) for x in dict.fromkeys(FULL.values()) if x.startswith("tag-")),
)

_ALL = SENTENCES | FULL
_CODE = {name: chr(0x100 + k) for k, name in enumerate(dict.fromkeys(_ALL.values()))}
assert all(any(h in s for h in HINTS) for s in _ALL)
#: The first two words of the known sentences, and the words of the longest, which is more lines than one can be wrapped into.
_OPENINGS = tuple(sorted({" ".join(s.split()[:2]) for s in _ALL}))
_LONGEST = max(len(s.split()) for s in _ALL)


def _tags(t: Column) -> Column:
    for _ in range(6):  # a pass takes one licence more off what is left of each expression
        t = F.regexp_replace(t, r"(spdx-license-identifier:[ \t]*\(*[\w.+-]+)\)*[ \t]+(?:or|and)[ \t]+\(*(?=[\w.+-])", "$1; spdx-license-identifier: ")
    return t


def _marked(text: Column) -> Column:
    """Words in lower case, with X for the ends of sentences and Y for line feeds. Each licence of an SPDX expression has a tag of its own."""
    low = lambda x: F.when(F.contains(x, F.lit("spdx-license-identifier")), _tags(x)).otherwise(x)
    t = F.regexp_replace(let(F.lower(text), low), r"(following\s+conditions:|conditions\s+are\s+met:|licenses/license-2\.0)\s+", "$1; ")
    # the second version of the GPL has a semicolon before its version
    t = F.regexp_replace(t, r"(free\W+software\W+foundation);(?=\W+either\W+version)", "$1,")
    # the holder named in the third condition of the BSD, and full stops that end no sentence
    t = F.regexp_replace(t, r"(neither\W+the\W+name)s?\W+(?:of\W+)?(?:\S+\s+){1,12}?(nor\W+the\W+names\W+of)\W+(?:\S+\s+){1,6}?(?=contributors)", "$1 of its holder $2 its ")
    t = F.regexp_replace(t, r"\bv\.\s+(?=\d)", "v ")
    t = F.regexp_replace(F.regexp_replace(t, r"[.!?;]\s+", " X "), r"\n", " Y ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9XY]+", " "), "Y(?: Y)+", "Y"))


def _known(text: Column) -> Column:
    """The identifiers' codes in the order of the text.

    A sentence is one or more whole lines between two sentence ends. Lines that open like a known one are put together with those
    after them, and what the table has is found by its hash; the longest from a line on counts and takes its lines.
    """
    codes = F.create_map(*(F.lit(x) for s, name in _ALL.items() for x in (s, _CODE[name])))
    number = lambda n: F.lit(n).cast("int")

    def of_sentences(lines: Column) -> Column:
        joined = lambda i, n: F.array_join(F.slice(lines, i, n), " ")
        starts = F.filter(F.sequence(number(1), F.size(lines)), lambda i: F.substring_index(joined(i, number(2)), " ", 2).isin(*_OPENINGS))
        lengths = lambda i: F.sequence(F.least(number(_LONGEST), F.size(lines) - i + 1), number(1), number(-1))
        longest = lambda i: F.get(F.filter(F.transform(lengths(i), lambda n: F.struct(i.alias("i"), (i + n).alias("next"), joined(i, n).alias("s"))), lambda c: c["s"].isin(*_ALL)), 0)
        none = F.struct(number(1).alias("next"), F.array().cast("array<string>").alias("found"))
        taken = F.aggregate(
            F.array_compact(F.transform(starts, longest)), none,
            lambda acc, c: F.when(c["i"] >= acc["next"], F.struct(c["next"].alias("next"), F.concat(acc["found"], F.array(c["s"])).alias("found"))).otherwise(acc),
        )
        return taken["found"]

    pieces = F.filter(F.split(_marked(text), "(?:^| )X(?: |$)"), lambda p: p.rlike("|".join(HINTS)))
    found = F.flatten(F.transform(pieces, lambda p: let(F.array_remove(F.split(p, "(?:^| )Y(?: |$)"), ""), lambda x: F.when(F.size(x) > 0, of_sentences(x)).otherwise(F.array().cast("array<string>")))))
    return F.array_join(F.transform(found, lambda s: F.element_at(codes, s)), "")


def identify(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids (array, in order), licences (array, in the order of the rules) and restricted."""
    t = text_of(text)
    out = docs.select(F.struct("*").alias("row"), F.when(t.rlike("(?i)" + "|".join(HINTS)), _known(t)).otherwise(F.lit("")).alias("seq"))
    hits, limits, seq = [], [], F.col("seq")
    for name, ids, restricted in FULL_RULES + RULES:
        codes = F.lit("".join(_CODE[x] for x in ids))
        hit = F.contains(seq, codes)
        hits.append(F.when(hit, F.lit(name)))
        if restricted:
            limits.append(hit)
        if len(ids) > 1:  # what a longer rule has matched is no match for a shorter one; single sentences can't overlap
            seq = F.replace(seq, codes, F.lit("-"))
    names = F.create_map(*(F.lit(x) for name, code in _CODE.items() for x in (code, name)))
    restricted = limits[0]
    for x in limits[1:]:
        restricted = restricted | x
    none = F.array().cast("array<string>")
    results = {
        "sentence_ids": F.when(F.col("seq") == "", none).otherwise(F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c: F.element_at(names, c))),
        "licences": F.when(F.col("seq") == "", none).otherwise(F.array_distinct(F.array_compact(F.array(*hits)))),
        "restricted": restricted,
    }
    return out.select(*(F.col("row")[x].alias(x) for x in docs.columns if x not in results), *(c.alias(x) for x, c in results.items()))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: licences of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return identify(docs).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
        "restricted",
    )


def _sql() -> str:
    q = lambda s: "'" + s + "'"
    known = ", ".join(f"({q(s)}, {q(name)})" for s, name in SENTENCES.items())
    steps, seq = [], "s"
    cases, limits = [], []
    for k, (name, ids, restricted) in enumerate(RULES):
        run = q("".join(f"<{x}>" for x in ids))
        cases.append(f"CASE WHEN contains({seq}, {run}) THEN {q(name)} END")
        if restricted:
            limits.append(f"contains({seq}, {run})")
        if len(ids) > 1:
            steps.append(f"replace({seq}, {run}, '-') AS s{k}")
            seq = f"s{k}"
    nested = "SELECT *, row_number() OVER () AS rid0 FROM ids"
    for step in steps:
        nested = f"SELECT *, {step} FROM ({nested})"
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT rid, i, trim(regexp_replace(lower(list_extract(parts, i)), '[^a-z0-9]+', ' ', 'g')) AS sentence
  FROM (SELECT rid, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT rid, string_split(regexp_replace(t, '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM d))
),
found AS (
  SELECT rid, count(*) AS n, string_agg('<' || name || '>', '' ORDER BY i) AS seq, string_agg(name, ',' ORDER BY i) AS list
  FROM s JOIN known USING (sentence) GROUP BY rid
),
ids AS (SELECT d.rid, doc_id, coalesce(n, 0) AS n, coalesce(seq, '') AS s, coalesce(list, '') AS list FROM d LEFT JOIN found USING (rid))
SELECT doc_id, n::BIGINT AS n_sentences, list AS sentence_ids, array_to_string(lic, ',') AS licences, restricted
FROM (
  SELECT doc_id, n, list, list_filter(list_transform(range(1, len(all_hits) + 1),
           lambda i: CASE WHEN list_position(all_hits, all_hits[i]) = i THEN all_hits[i] END), lambda x: x IS NOT NULL) AS lic, restricted
  FROM (SELECT doc_id, n, list, list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL) AS all_hits,
               ({" OR ".join(limits)}) AS restricted FROM ({nested}))
)
"""


SQL = _sql()
