"""Licence scans by sentence rules.

Texts are normalised (lower case, single spaces, no punctuation, one spelling of licence), with
marks where lines, sentences and paragraphs end. A known sentence begins and ends at marks and may
have more between its words, so wrapped lines, comment signs, 'software: you' and 'v. 2.0' do not
part it. The SQL knows only sentences that no line end, ':' or ';' parts. The identifiers of a
text's known sentences, in order, are then matched against ordered rules: a rule that finds its
sequence names a licence and uses up the identifiers, so a longer text's rule comes before the
rules of its parts. Identifiers that no rule uses are reported as unmatched.

DataFrame functions only. Edge cases: null, empty and licence-free texts have no licence and no
identifier; a sentence that occurs several times is reported once per licence; texts of any length
are scanned whole; of rules that tie the first listed wins; repeated rows are scanned each; an
empty table gives an empty result. Extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common

# Identifiers of known sentences and patterns of their normalised form.
SENTENCES = [
    ("SpdxApache2", "spdx license identifier apache 2 0"),
    ("SpdxMit", "spdx license identifier mit"),
    ("SpdxBsd3", "spdx license identifier bsd 3 clause"),
    ("SpdxBsd2", "spdx license identifier bsd 2 clause"),
    ("SpdxGpl3", "spdx license identifier gpl 3 0( only| or later)?"),
    ("SpdxGpl2", "spdx license identifier gpl 2 0( only| or later)?"),
    ("SpdxMpl2", "spdx license identifier mpl 2 0"),
    ("ApacheRef2", "(this \\w+ is )?(licensed|released|distributed|available) under the( terms of the)? apache (software )?license,?( version)? 2( 0)?( the license)?"),
    ("ApacheCompliance", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at.*"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", "(this \\w+ is )?(licensed|released|distributed|available) under the( terms of the)? mit license"),
    ("MitPermission", "permission is hereby granted free of charge to any person obtaining a copy.*"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in.*"),
    ("MitAsIs", "the software is provided as is without warranty of any kind.*"),
    ("BsdRedistribution", "redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("BsdSource", ".*redistributions of source code must retain the above copyright notice.*"),
    ("BsdBinary", ".*redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdEndorse", ".*neither the name of .* may be used to endorse or promote products.*"),
    ("BsdRef", "(this \\w+ is )?(licensed|released|distributed|available) under the( terms of the)?( new| modified| simplified)? bsd( \\d clause)? license"),
    ("AgplRef3", "(this \\w+ is )?(licensed|released|distributed|available) under the( terms of the)? gnu affero general public license( version 3)?( 0)?"),
    ("LgplRef", "(this \\w+ is )?(licensed|released|distributed|available) under the( terms of the)? gnu lesser general public license( version \\d)?( \\d)?"),
    ("GplRef3", "(this \\w+ is )?(licensed|released|distributed|available) under the( terms of the)? gnu general public license version 3( 0)?"),
    ("GplRef2", "(this \\w+ is )?(licensed|released|distributed|available) under the( terms of the)? gnu general public license version 2( 0)?"),
    ("GplRef", "(this \\w+ is )?(licensed|released|distributed|available) under the( terms of the)? gnu general public license"),
    ("GplFree2", "(this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license.*version 2 .*"),
    ("LgplFree", "(this library|this program|it) is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license.*version [23].*"),
    ("AgplFree", "(this program|it) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license.*version 3.*"),
    ("LgplNoWarranty", "this library is distributed in the hope that it will be useful but without any warranty.*"),
    ("IscPermission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("IscAsIs", "the software is provided as is and (the author|isc|\\w+) disclaims all warranties with regard to this software.*"),
    ("ZlibAsIs", "this software is provided as is without any express or implied warranty"),
    ("ZlibPermission", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely.*"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Cc0Waived", "to the extent possible under law .* waived all copyright and related or neighboring rights to .*"),
    ("Cc0Ref", "(this \\w+ is )?(licensed|released|distributed|available) under( the)? (cc0|creative commons zero)( 1 0)?( universal)?( license)?"),
    ("EplAvailable", "this program and the accompanying materials are made available under the terms of the eclipse public license( version)? v?[12]( 0)?.*"),
    ("SpdxIsc", "spdx license identifier isc"),
    ("SpdxEpl2", "spdx license identifier epl 2 0"),
    ("SpdxAgpl3", "spdx license identifier agpl 3 0( only| or later)?"),
    ("SpdxLgpl", "spdx license identifier lgpl [23] [01]( only| or later)?"),
    ("SpdxUnlicense", "spdx license identifier unlicense"),
    ("SpdxCc0", "spdx license identifier cc0 1 0"),
    ("GplFree", "(this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license.*version 3.*"),
    ("GplNoWarranty", "this program is distributed in the hope that it will be useful but without any warranty.*"),
    ("MplRef2", "(this \\w+ is )?(licensed|released|distributed|available) under the( terms of the)? mozilla public license( version| v)? 2( 0)?"),
    ("MplSubject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("CcByNc4", "(this \\w+ is )?(licensed|released|distributed|available) under( the)?( a)? (cc by nc|creative commons attribution noncommercial)( license)? 4 0( international license)?"),
    ("CcBySa4", "(this \\w+ is )?(licensed|released|distributed|available) under( the)?( a)? (cc by sa|creative commons attribution sharealike)( license)? 4 0( international license)?"),
    ("CcBy4", "(this \\w+ is )?(licensed|released|distributed|available) under( the)?( a)? (cc by|creative commons attribution)( license)? 4 0( international license)?"),
    ("PublicDomain", "this (\\w+ )?is( hereby)? (released|placed) (in)?to the public domain"),
    ("AllRights", "(copyright .*)?all rights reserved"),
]
# Licences and the sequences of identifiers that give them, tried in this order.
RULES = [
    ("Apache-2.0", "ApacheRef2,ApacheCompliance,ApacheCopy,(ApacheAsIs,)?(ApacheSee,)?"),
    ("MIT", "MitPermission,(MitNotice,)?MitAsIs,"),
    ("BSD-3-Clause", "BsdRedistribution,BsdSource,BsdBinary,BsdEndorse,"),
    ("BSD-2-Clause", "BsdRedistribution,BsdSource,BsdBinary,"),
    ("GPL-3.0", "GplFree,(GplNoWarranty,)?"),
    ("GPL-2.0", "GplFree2,(GplNoWarranty,)?"),
    ("LGPL", "LgplFree,(LgplNoWarranty,|GplNoWarranty,)?"),
    ("AGPL-3.0", "AgplFree,(GplNoWarranty,)?"),
    ("ISC", "IscPermission,(IscAsIs,)?"),
    ("Zlib", "(ZlibAsIs,)?ZlibPermission,"),
    ("EPL", "(AllRights,)?EplAvailable,"),
    ("Unlicense", "(Unlicense|SpdxUnlicense),"),
    ("CC0-1.0", "(Cc0Waived|Cc0Ref|SpdxCc0),"),
    ("ISC", "SpdxIsc,"),
    ("EPL", "SpdxEpl2,"),
    ("AGPL-3.0", "SpdxAgpl3,"),
    ("LGPL", "SpdxLgpl,"),
    ("Apache-2.0", "(ApacheRef2|SpdxApache2),"),
    ("MIT", "(MitRef|SpdxMit),"),
    ("BSD-3-Clause", "SpdxBsd3,"),
    ("BSD-2-Clause", "SpdxBsd2,"),
    ("BSD", "BsdRef,"),
    ("AGPL-3.0", "AgplRef3,"),
    ("LGPL", "LgplRef,"),
    ("GPL-3.0", "(GplRef3|SpdxGpl3),"),
    ("GPL-2.0", "(GplRef2|SpdxGpl2),"),
    ("GPL", "GplRef,"),
    ("MPL-2.0", "(MplRef2|MplSubject|SpdxMpl2),"),
    ("CC-BY-NC-4.0", "CcByNc4,"),
    ("CC-BY-SA-4.0", "CcBySa4,"),
    ("CC-BY-4.0", "CcBy4,"),
    ("Public-Domain", "PublicDomain,"),
    ("All-Rights-Reserved", "AllRights,"),
]
#: every known sentence has one of these words, so other sentences are not matched at all
HINT = "licen[sc]e|spdx|redistribut|permission|warrant|copyright|public domain|all rights reserved|licen[sc]ed|cc.by|creative commons|free software"
#: the same where lines are wrapped, behind comment signs too
WRAPPED_HINT = "(?is)" + HINT.replace(" ", "[^a-z0-9]+")
# Marks of a wrapped line, ':' or ';', of a sentence's end, and of an empty line.
WRAP, END, GAP = "\x01", "\x02", "\x03"
#: what the ``.*`` within a sentence may cross; those of other sentences stay within a line
ACROSS = {**dict.fromkeys(("GplFree", "GplFree2", "LgplFree", "AgplFree", "Cc0Waived"), f"[^{END}{GAP}]*?"), "BsdEndorse": f"[^{GAP}]*?"}


def normalised(text: Column) -> Column:
    """Lower case, single spaces, no punctuation, one spelling of licence, and the marks where a sentence may begin or end."""
    s = F.translate(F.replace(F.lower(text), F.lit("\r\n"), F.lit("\n")), f"\r{WRAP}{END}{GAP}", "\n   ")
    s = F.regexp_replace(s, "licence", "license")
    s = F.regexp_replace(s, r"\n[^a-z0-9]*\n", GAP)
    s = F.regexp_replace(s, r"(?<=[.!?])\s+", END)
    s = F.regexp_replace(s, r"(?<=[:;])\s+|\n", WRAP)
    s = F.regexp_replace(s, f"[^a-z0-9{WRAP}{END}{GAP}]+", " ")
    return F.trim(F.regexp_replace(s, f" ?([{WRAP}{END}{GAP}]) ?", "$1"))


def _wrapped(key: str, pattern: str) -> str:
    """``pattern`` over marked texts: words may be parted by marks."""
    ends = f"[^{WRAP}{END}{GAP}]*"
    head, tail = pattern.startswith(".*"), pattern.endswith(".*")
    core = pattern[2 * head : len(pattern) - 2 * tail].replace(".*", ACROSS.get(key, ends)).replace(" ", f"[ {WRAP}{END}{GAP}]+")
    return ends * head + core + ends * tail


KNOWN = f"(?<![a-z0-9 ])(?:{'|'.join(_wrapped(k, p) for k, p in SENTENCES)})(?![a-z0-9 ])"


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of ``text``, in order."""

    def name(s: Column) -> Column:
        found = F.when(F.lit(False), F.lit(None).cast("string"))
        for key, pattern in SENTENCES:
            found = found.when(s.rlike(f"^(?:{pattern})$"), F.lit(key))
        return found

    found = F.regexp_extract_all(normalised(text), F.lit(KNOWN), F.lit(0))
    names = F.transform(F.transform(found, lambda s: F.regexp_replace(s, f"[ {WRAP}{END}{GAP}]+", " ")), name)
    return F.when(text.rlike(WRAPPED_HINT), F.filter(names, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def recognised(ids: Column) -> Column:
    """struct<left: identifiers that no rule used, names: licences found, each once> by the ordered rules."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f"(?<=,){p}").alias("rule")) for n, p in RULES])
    start = F.struct(F.concat(F.lit(","), F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit(","))), "")).alias("left"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, r: Column) -> Column:
        hit = F.regexp_like(acc["left"], r["rule"])
        return F.when(hit, F.struct(F.regexp_replace(acc["left"], r["rule"], F.lit("")).alias("left"), F.array_append(acc["names"], r["name"]).alias("names"))).otherwise(acc)

    return F.aggregate(rules, start, step)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, licences (sorted, each once), sentence_ids in order, unmatched identifiers."""
    rows = docs.select(*keep, identifiers(_common.text_of(docs)).alias("sentence_ids"))
    found = F.when(F.size("sentence_ids") > 0, recognised(F.col("sentence_ids")))
    rows = rows.withColumn("__found", found)
    none = F.array().cast("array<string>")
    return rows.select(
        *keep,
        F.coalesce(F.array_sort(F.array_distinct("__found.names")), none).alias("licences"),
        "sentence_ids",
        F.coalesce(F.filter(F.split("__found.left", ","), lambda x: x != ""), none).alias("unmatched"),
    )
