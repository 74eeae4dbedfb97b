"""License scan by sentence rules, in DataFrame functions only.

A text is cut into sentences at full stops and blank lines; lines of comment marks alone are blank.
Each is normalised (lower case, letters, digits and single spaces only, so that comment marks and
line ends within it go), and known licence sentences are looked up in it, as a whole or as a part,
the leftmost first and at a place the longest; one after "not" doesn't count. The identifiers found,
in the order of the text, are then matched against the ordered rules. A rule is a sequence of sentence identifiers that
must follow one another among the identifiers found; the first rule that matches at a place wins
there, since more specific rules stand earlier.

Defined results: null and empty texts have no sentences and no licence; repeated rows get equal
results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import has_columns

#: Known sentences, normalised, by identifier. Fixed values.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the apache license version 2 0",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4 0",
    5: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    6: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    7: "you may not use this file except in compliance with the license",
    8: "you may obtain a copy of the license at",
    9: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    10: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    11: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    12: "licensed under the apache license version 2 0 the license",
    13: "licensed under the mit license",
    14: "this work is licensed under a creative commons attribution 4 0 international license",
    15: "licensed under cc by 4 0",
    16: "licensed under cc by sa 4 0",
}
#: Ordered rules: sentence identifiers that follow one another -> licence. Fixed values.
RULES = (
    ((5, 6), "MIT"), ((12, 7, 8), "Apache-2.0"), ((10, 11), "BSD-3-Clause"), ((12, 7), "Apache-2.0"),
    ((1,), "MIT"), ((13,), "MIT"), ((5,), "MIT"), ((2,), "Apache-2.0"), ((12,), "Apache-2.0"),
    ((3,), "GPL-3.0"), ((9,), "GPL-3.0-or-later"), ((10,), "BSD-2-Clause"), ((4,), "CC-BY-NC-4.0"),
    ((14,), "CC-BY-4.0"), ((15,), "CC-BY-4.0"), ((16,), "CC-BY-SA-4.0"),
)
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
_LATER = "license as published by the free software foundation either version {} of the license or at your option any later version"
#: Further sentences and their rules, which the SQL doesn't know.
MORE = {
    17: f"this program {_FREE} general public {_LATER.format('2')}",
    18: f"this library {_FREE} lesser general public {_LATER.format('2 1')}",
    19: f"this library {_FREE} lesser general public {_LATER.format('3')}",
    20: f"this program {_FREE} lesser general public {_LATER.format('3')}",
    21: f"this program {_FREE} affero general public {_LATER.format('3')}",
    22: f"this program {_FREE} general public license version 2 as published by the free software foundation",
    23: f"this program {_FREE} general public license as published by the free software foundation version 2",
    24: "this work is licensed under the gnu general public license version 3 or later",
    25: "this source code form is subject to the terms of the mozilla public license v 2 0",
    26: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    27: "this is free and unencumbered software released into the public domain",
}
MORE_RULES = (
    ((17,), "GPL-2.0-or-later"), ((18,), "LGPL-2.1-or-later"), ((19,), "LGPL-3.0-or-later"), ((20,), "LGPL-3.0-or-later"),
    ((21,), "AGPL-3.0-or-later"), ((22,), "GPL-2.0-only"), ((23,), "GPL-2.0-only"), ((24,), "GPL-3.0-or-later"),
    ((25,), "MPL-2.0"), ((26,), "ISC"), ((27,), "Unlicense"),
)
#: Every known sentence has one of these words.
HINT = r"(?i)licen|permission|redistribut|copyright|unencumbered"
#: Over lower case. A full stop after a lone v is no end ("v. 2.0").
END = r"(?<![ ,\n]v)[.!?]+(?:\s+|$)|\n[^a-z0-9\n]*(?:\n|$)"
MARK = r"(?m)^[ \t]*(?:dnl|rem)\b"


def sentences(text: Column) -> Column:
    """The normalised sentences in one text, apart by bars."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(text), MARK, ""), r"\|", " ")
    return F.regexp_replace(F.regexp_replace(cut, END, "|"), "[^a-z0-9|]+", " ")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses): text lists joined by commas."""
    docs = has_columns(docs, "doc_id", "text")
    table, rules = SENTENCES | MORE, RULES + MORE_RULES
    known = F.create_map(*[F.lit(x) for i, s in table.items() for x in (s, f"{i:02d}")])
    text = F.coalesce(F.col("text"), F.lit(""))
    # As one alternation: the leftmost place first, and at a place the longest sentence.
    found = r"(?<!\bnot )\b(" + "|".join(sorted(table.values(), key=len, reverse=True)) + r")\b"
    ids = F.when(text.rlike(HINT), F.transform(
        F.regexp_extract_all(sentences(text), F.lit(found), F.lit(1)), lambda s: F.element_at(known, s))
    ).otherwise(F.array().cast("array<string>"))
    # Rules in their order, as one alternation over the identifiers' text: the leftmost place first,
    # and at a place the earliest rule.
    rule = "|".join("".join(f"{i:02d}," for i in seq) for seq, _ in rules)
    named = F.create_map(*[F.lit(x) for seq, name in rules for x in ("".join(f"{i:02d}," for i in seq), name)])
    rows = docs.select("doc_id", ids.alias("ids"))
    line = F.concat_ws("", F.transform("ids", lambda x: F.concat(x, F.lit(","))))
    hits = F.transform(F.regexp_extract_all(line, F.lit(f"({rule})"), F.lit(1)), lambda m: F.element_at(named, m))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.when(F.size("ids") > 0, F.array_sort(F.array_distinct(hits))).otherwise(
            F.array().cast("array<string>")), ",").alias("licenses"))
