"""Licence scans by sentence recognition; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised as
# ``normalise`` does (lower case, runs of other than letters and digits one space).
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-notice-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under cc by 4 0": "cc-by-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "licensed under cc by nd 4 0": "cc-by-nd-notice",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-notice",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "all rights reserved": "all-rights",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-or-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-or-later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-or-later",
    "see the gnu affero general public license for more details": "agpl-see",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which accompanies this distribution": "epl2-notice",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "this software is distributed without any warranty": "cc0-warranty",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "bsl1-notice",
    "licensed under the boost software license version 1 0": "bsl1-notice",
    "licensed under the artistic license 2 0": "artistic2-notice",
    "licensed under the bsd 3 clause license": "bsd3-notice",
    "licensed under the bsd 2 clause license": "bsd2-notice",
    "licensed under the isc license": "isc-notice",
}

#: Ordered rules: name, category, the identifiers in order. A text fits a rule if
#: its recognised identifiers have these in a row; the rules are tried in this
#: order and each identifier serves the first rule that takes it.
RULES: list[tuple[str, str, list[str]]] = [
    ("Apache-2.0-header", "permissive", ["apache2-notice-comply", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("Apache-2.0-header", "permissive", ["apache2-notice", "apache2-comply", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("MIT-text", "permissive", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("BSD-3-Clause-text", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause-text", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later-header", "copyleft", ["gpl3-or-later", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-or-later-header", "copyleft", ["gpl2-or-later", "gpl-warranty", "gpl-see"]),
    ("LGPL-2.1-or-later-header", "copyleft", ["lgpl21-or-later", "gpl-warranty", "lgpl-see"]),
    ("LGPL-3.0-or-later-header", "copyleft", ["lgpl3-or-later", "gpl-warranty", "lgpl-see"]),
    ("AGPL-3.0-or-later-header", "copyleft", ["agpl3-or-later", "gpl-warranty", "agpl-see"]),
    ("Zlib-text", "permissive", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("CC0-1.0-header", "permissive", ["cc0-dedication", "cc0-warranty"]),
    ("Apache-2.0", "permissive", ["apache2-notice-comply"]),
    ("Apache-2.0", "permissive", ["apache2-notice"]),
    ("MIT", "permissive", ["mit-notice"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("GPL-3.0", "copyleft", ["gpl3-notice"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3-or-later"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-or-later"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-or-later"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-or-later"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3-or-later"]),
    ("EPL-2.0", "copyleft", ["epl2-notice"]),
    ("CC0-1.0", "permissive", ["cc0-dedication"]),
    ("BSL-1.0", "permissive", ["bsl1-notice"]),
    ("Artistic-2.0", "permissive", ["artistic2-notice"]),
    ("BSD-3-Clause", "permissive", ["bsd3-notice"]),
    ("BSD-2-Clause", "permissive", ["bsd2-notice"]),
    ("ISC", "permissive", ["isc-notice"]),
    ("MPL-2.0", "copyleft", ["mpl2-notice"]),
    ("CC-BY-4.0", "permissive", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-notice"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc-by-nc-notice"]),
    ("CC-BY-NC-SA-4.0", "noncommercial", ["cc-by-nc-sa-notice"]),
    ("CC-BY-NC-ND-4.0", "noncommercial", ["cc-by-nc-nd-notice"]),
    ("CC-BY-ND-4.0", "no-derivatives", ["cc-by-nd-notice"]),
    ("Unlicense", "permissive", ["unlicense-notice"]),
    ("All-Rights-Reserved", "proprietary", ["all-rights"]),
]

#: Sentences end at a blank line (a bare comment mark is blank too), or at one of
#: ``.!?`` before white space. A mark that begins a line is a comment's.
SPLIT = r"\n(?:[^a-zA-Z0-9\n]*+\n)++|(?<![.!?;:])(?<!\n[ \t]{0,8})[;:]*+[.!?][.!?;:]*+(?:[ \t]|\r?\n)"

#: Inside of these, a known sentence begins and ends at a line's end or a clause's;
#: it may run over them, as wrapped lines do.
BREAK = r"[.!?;:]++[ \t]|\n"

#: Words of which every known sentence has one.
NEEDED = "(?i)licen[sc]|free|copyright|permi|redistrib|software|reserved|warrant"


def normalise(sentence: Column) -> Column:
    """Lower case; every run of other than a-z and 0-9 one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _known_pattern() -> str:
    """The known sentences between two breaks (``/``), shortest first, so that a notice of one line is one."""
    each = sorted(SENTENCES, key=lambda s: (len(s), s))
    return "(?<=/)(?:" + "|".join(s.replace(" ", "[ /]") for s in each) + ")(?=/)"


def _broken(piece: Column) -> Column:
    """``piece`` normalised, with one ``/`` for each of its breaks and at both ends."""
    low = F.regexp_replace(F.translate(F.lower(piece), "/", " "), BREAK, "/")
    plain = F.regexp_replace(low, "[^a-z0-9/]+", " ")
    return F.regexp_replace(F.concat(F.lit("/"), plain, F.lit("/")), " ?(?:/ ?)+", "/")


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of ``text``, in order, wrapped and commented ones too."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    # each known sentence has one of these words; the others are not normalised
    maybe = F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT, -1), lambda s: s.rlike(NEEDED))
    found = F.flatten(
        F.transform(maybe, lambda s: F.regexp_extract_all(_broken(s), F.lit(_known_pattern()), F.lit(0)))
    )
    return F.transform(found, lambda s: F.element_at(known, F.translate(s, "/", " ")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licenses, categories)`` of each text.

    ``sentence_ids`` joins the recognised sentences' identifiers in order,
    ``licenses`` the names of the rules that fit, in the rules' order, and
    ``categories`` their distinct categories, sorted; all with commas. A rule's
    identifiers must stand in a row among the recognised ones; text between
    them that is not recognised does not part them.

    A null or empty text has none of them: zero and empty strings. Rows are
    independent of each other; other columns are not read.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col).cast("string")).alias("ids"))
    joined = found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
    )
    rules = F.array(
        *[F.struct(F.lit("".join(f",{i}," for i in ids)).alias("needle"), F.lit(f"{n}|{c}").alias("label")) for n, c, ids in RULES]
    )
    start = F.struct(
        F.concat(F.lit(","), F.replace("sentence_ids", F.lit(","), F.lit(",,")), F.lit(",")).alias("rest"),
        F.array().cast("array<string>").alias("fits"),
    )
    matched = F.aggregate(
        rules,
        start,
        lambda acc, r: F.struct(
            F.replace(acc["rest"], r["needle"], F.lit("#")).alias("rest"),
            F.when(F.contains(acc["rest"], r["needle"]), F.array_append(acc["fits"], r["label"]))
            .otherwise(acc["fits"])
            .alias("fits"),
        ),
        lambda acc: F.array_distinct(acc["fits"]),
    )
    out = joined.withColumn("_fits", F.when(F.col("n_sentences") > 0, matched).otherwise(F.array().cast("array<string>")))
    fits = F.col("_fits")
    return out.select(
        "doc_id",
        "n_sentences",
        "sentence_ids",
        F.array_join(F.transform(fits, lambda x: F.substring_index(x, "|", 1)), ",").alias("licenses"),
        F.array_join(
            F.sort_array(F.array_distinct(F.transform(fits, lambda x: F.substring_index(x, "|", -1)))), ","
        ).alias("categories"),
    )
