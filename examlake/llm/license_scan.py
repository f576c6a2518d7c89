"""License scans by sentence rules.

A text is cut into sentences, each sentence is normalised and looked up among
known licence sentences, and the identifiers found, in the order of the text,
are matched against ordered licence rules. A rule that matches consumes its
identifiers, so a longer licence is tried before its parts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

# Identifier -> licence sentences, already normalised (lower case,
# only letters, digits, "+", "." and "-", single spaces, no final stop). Where a
# licence's own sentence holds a ";" or the stop of "v. 2.0", which end a
# sentence here, the part that tells the licence stands for it.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-grant": ("licensed under the apache license version 2.0 the license",),
    "apache-short": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license 2.0",
        "released under the apache license version 2.0",
        "this work is licensed under the apache license version 2.0",
        "this project is licensed under the apache license version 2.0",
    ),
    "apache-comply": (
        "you may not use this file except in compliance with the license",
        "you may not use this work except in compliance with the license",
    ),
    "apache-copy": (
        "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "you may obtain a copy of the license at https www.apache.org licenses license-2.0",
        "you may obtain a copy of the license at",
    ),
    "apache-asis": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "apache-limits": ("see the license for the specific language governing permissions and limitations under the license",),
    "mit-short": (
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the mit license",
        "this work is licensed under the mit license",
        "distributed under the mit license",
        "mit license",
        "the mit license",
    ),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-asis": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsd-names": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd-short": ("released under the bsd license", "licensed under the bsd license"),
    "gpl2-short": (
        "this work is licensed under the gnu general public license version 2",
        "licensed under the gnu general public license version 2",
        "released under the gnu general public license version 2",
    ),
    "gpl3-short": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
    ),
    "gpl3-free": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl2-free": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "gpl-nowarranty": (
        "this program is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "gpl-details": (
        "see the gnu general public license for more details",
        "see the gnu lesser general public license for more details",
        "see the gnu affero general public license for more details",
    ),
    "lgpl3-free": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "lgpl21-free": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    ),
    "agpl3-free": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "lgpl-short": ("licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2.1"),
    "agpl-short": ("licensed under the gnu affero general public license version 3",),
    "mpl-short": (
        "this source code form is subject to the terms of the mozilla public license v",  # the stop of "v. 2.0" ends it
        "licensed under the mozilla public license version 2.0",
    ),
    "cc-by-short": ("licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "cc-by-sa-short": (
        "licensed under cc by-sa 4.0",
        "this work is licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
    ),
    "cc-by-nc-short": (
        "licensed under cc by-nc 4.0",
        "this work is licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    ),
    "cc-by-nd-short": ("licensed under cc by-nd 4.0",),
    "cc0-short": ("licensed under cc0 1.0", "this work is dedicated to the public domain under a cc0 1.0 universal license"),
    "unlicense": ("this is free and unencumbered software released into the public domain under the unlicense license",),
    "reserved": ("all rights reserved",),
    "spdx-apache": ("spdx-license-identifier apache-2.0",),
    "spdx-mit": ("spdx-license-identifier mit",),
    "spdx-bsd3": ("spdx-license-identifier bsd-3-clause",),
    "spdx-bsd2": ("spdx-license-identifier bsd-2-clause",),
    "spdx-isc": ("spdx-license-identifier isc",),
    "spdx-mpl": ("spdx-license-identifier mpl-2.0",),
    "spdx-gpl2": ("spdx-license-identifier gpl-2.0-only", "spdx-license-identifier gpl-2.0"),
    "spdx-gpl2-later": ("spdx-license-identifier gpl-2.0-or-later", "spdx-license-identifier gpl-2.0+"),
    "spdx-gpl3": ("spdx-license-identifier gpl-3.0-only", "spdx-license-identifier gpl-3.0"),
    "spdx-gpl3-later": ("spdx-license-identifier gpl-3.0-or-later", "spdx-license-identifier gpl-3.0+"),
    "spdx-cc-by": ("spdx-license-identifier cc-by-4.0",),
    "spdx-cc-by-sa": ("spdx-license-identifier cc-by-sa-4.0",),
    "spdx-cc0": ("spdx-license-identifier cc0-1.0",),
    "spdx-unlicense": ("spdx-license-identifier unlicense",),
}

# Ordered rules, longest first within a family.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-copy", "apache-asis", "apache-limits")),
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-short", "mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("MIT", ("spdx-mit",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("BSD", ("bsd-short",)),
    ("BSD-2-Clause", ("spdx-bsd2",)),
    ("ISC", ("spdx-isc",)),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-nowarranty", "gpl-nowarranty", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-nowarranty", "gpl-nowarranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-nowarranty", "gpl-nowarranty", "gpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "gpl-nowarranty", "gpl-nowarranty", "gpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-nowarranty", "gpl-nowarranty", "gpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("GPL-3.0-or-later", ("spdx-gpl3-later",)),
    ("GPL-2.0-or-later", ("spdx-gpl2-later",)),
    ("GPL-2.0", ("spdx-gpl2",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("GPL-2.0", ("gpl2-short",)),
    ("LGPL", ("lgpl-short",)),
    ("AGPL-3.0", ("agpl-short",)),
    ("MPL-2.0", ("mpl-short",)),
    ("MPL-2.0", ("spdx-mpl",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-short",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-4.0", ("spdx-cc-by",)),
    ("CC-BY-SA-4.0", ("spdx-cc-by-sa",)),
    ("CC0-1.0", ("cc0-short",)),
    ("CC0-1.0", ("spdx-cc0",)),
    ("Unlicense", ("unlicense",)),
    ("Unlicense", ("spdx-unlicense",)),
    ("All-Rights-Reserved", ("reserved",)),
)

# Every sentence above holds one of these, so other texts need no cutting. Letters and digits only: whatever parts two words in a text, a word stays whole.
MARKERS = ("licens", "reserved", "permission", "redistribution", "copyright", "warrant", "cc0")
END = "\x01"


def sentences(text: Column) -> Column:
    """The text's sentences, normalised but for their line breaks.

    Whatever marks a line as a comment or an item (anything before its first
    letter or digit) is left out first. A sentence ends at stops before white
    space, at the text's end, at a blank line, at a colon that ends a line and
    after an address that ends one; another single line break is kept, for a
    sentence can be wrapped.
    """
    t = F.translate(text, UPPER, LOWER)
    t = F.regexp_replace(t, "(?dm)^[^0-9a-z\\n]+", "")
    t = F.regexp_replace(t, "[.;!?]+(?:[ \\t\\r\\n]+|$)", END)
    t = F.regexp_replace(t, "(?::|(://[^ \\t\\r\\n]+))[ \\t\\r]*\\n", f"$1{END}")
    t = F.regexp_replace(t, "\\n[ \\t\\r]*\\n", END)
    return F.split(F.regexp_replace(t, f"[^0-9a-z.+{END}\\n-]+", " "), END)


def words_of(sentence_ids: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The longest run of letters and digits of each sentence, once each."""
    return tuple(sorted({max(re.findall("[0-9a-z]+", s) or [""], key=len) for v in sentence_ids.values() for s in v}))


def license_scan(docs: DataFrame, sentence_ids: dict[str, tuple[str, ...]] | None = None, rules=RULES, markers: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, sentence_ids, licenses, unruled for every row of docs.

    sentence_ids lists the identifiers found, as ``<a><b>``, in text order. A
    sentence is looked up with its lines joined; if it isn't known, each of its
    lines is. Unknown sentences between two known ones don't part them (a
    licence may hold an owner's line). licenses names the licences of the rules
    that matched, sorted, once each, joined by ``;``. unruled counts identifiers
    that no rule took. A null or empty text has "", "" and 0. Rows are judged
    one by one without a shuffle, so repeated rows repeat; other columns of docs
    are not read. A text without any of the markers (parts of words; unless
    given, they follow from the sentences) is not cut: every sentence must hold one.
    """
    if markers is None:
        markers = words_of(sentence_ids) if sentence_ids else MARKERS
    known = [(s, k) for k, v in (sentence_ids or SENTENCES).items() for s in v]
    keys, ids = F.array(*[F.lit(s) for s, _ in known]), F.array(*[F.lit(f"<{k}>") for _, k in known])

    def look(s: Column) -> Column:
        at = F.array_position(keys, s)
        return F.when(at > 0, F.element_at(ids, F.greatest(at, F.lit(1)).cast("int"))).otherwise(F.lit(""))

    def clean(s: Column) -> Column:
        return F.trim(F.regexp_replace(s, "[ .\\n-]+$|[ \\n]+", " "))

    def of_sentence(s: Column) -> Column:
        lines = F.transform(F.split(s, "\n"), lambda x: look(clean(x)))
        return F.transform(F.array(look(clean(s))), lambda w: F.when(w != "", w).otherwise(F.array_join(lines, "")))[0]

    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.translate(text, UPPER, LOWER)
    may = F.lit(False)
    for m in markers:
        may = may | F.contains(low, F.lit(m))
    seq = F.when(may, F.array_join(F.transform(sentences(text), of_sentence), "")).otherwise(F.lit(""))
    out = F.col("sentence_ids")
    for name, parts in rules:
        out = F.replace(out, F.lit("".join(f"<{p}>" for p in parts)), F.lit("{%s}" % name))
    found = docs.select("doc_id", seq.alias("sentence_ids")).withColumn("ruled", out)
    return found.select(
        "doc_id",
        "sentence_ids",
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("ruled", F.lit("\\{([^}]*)\\}"), 1))), ";").alias("licenses"),
        (F.length("ruled") - F.length(F.translate("ruled", "<", ""))).cast("long").alias("unruled"),
    )
