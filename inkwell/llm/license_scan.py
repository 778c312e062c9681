"""License scan by a positional index of rare words (operator 2), in DataFrame functions only.

Each template is a run of words with a mandatory key phrase; short notices and the wording
of whole licenses are templates, and base phrases are templates that are all key.

1. A file's license words are those of its words that occur in key phrases, the rarest
   (highest inverse document frequency over the whole corpus) first. Templates of which a
   key word is missing are out.
2. Of each template left the two key words that come first in that order are looked up in
   the file. Each place proposes a start (position less the word's offset in the
   template); the postings of the two words are intersected by it.
3. At each start in both, the key phrase is verified word by word, and the share of the
   template's words that stand at their relative places is its cover.

Work grows in proportion to a text's words and the starts in it: positions travel as one
long of template and start, so that no step compares starts with each other.

Defined cases: a null text is empty: no words, no labels, score 0; places may overlap; very
long texts are scanned whole; repeated rows are scanned each; null ids stay; other columns
are ignored. ``first_word`` and ``last_word`` are null without a base place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Fixed values: (label, words of the notice, its mandatory key phrase).
TEMPLATES = (
    ("agpl", "this program is licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright", "waived all copyright"),
    ("creative-commons", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("lgpl", "this library is licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Fixed values: (label, words of the license's own text, its mandatory key phrase).
TEXTS = (
    (
        "mit-full",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons "
        "to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software",
        "without limitation the rights to use copy modify merge publish distribute sublicense",
    ),
    (
        "bsd-full",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code "
        "must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list "
        "of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "isc-full",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies",
        "with or without fee is hereby granted",
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "the origin of this software must not be misrepresented",
    ),
    (
        "apache-2.0-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        "you may not use this file except in compliance with the license",
    ),
    (
        "gpl-header",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose",
        "gnu general public license as published by the free software foundation",
    ),
    (
        "lgpl-header",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version 2 1 of the license or at your option any later version",
        "gnu lesser general public license as published by the free software foundation",
    ),
    (
        "mpl-2.0-header",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file",
    ),
    (
        "unlicense-full",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code "
        "form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "anyone is free to copy modify publish use compile sell or distribute",
    ),
    (
        "wtfpl",
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
        "changing it is allowed as long as the name is changed",
    ),
)
#: Between words: ASCII that is neither a digit nor a letter.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str) -> tuple[int, dict[str, int]]:
    """Documents in all and by word; the vocabulary bounds what comes to the driver.

    ``lower`` also folds a few letters outside ASCII; that can shift a count, and so which
    word of a template is looked up, but never whether a place matches.
    """
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATOR, -1)
    present = F.array_intersect(words, F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts.get("", 0), counts


def templates() -> list[dict]:
    """All templates: words, label, and where the key phrase begins and how long it is."""
    found = []
    for base, label, text, key in [*((True, label, text, text) for text, label in BASE), *((False, *t) for t in (*TEMPLATES, *TEXTS))]:
        words, part = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        found.append({"base": base, "label": label, "words": words, "key": part, "key_at": at})
    return found


def looked_up(entry: dict, order: dict[str, int]) -> list[int]:
    """Offsets in the template of the two key words that are rarest by ``order`` (ties: the first)."""
    inside = range(entry["key_at"], entry["key_at"] + len(entry["key"]))
    return sorted(inside, key=lambda i: (order[entry["words"][i]], i))[:2]


def as_column(entry: dict) -> Column:
    return F.struct(
        F.lit(entry["base"]).alias("base"),
        F.lit(entry["label"]).alias("label"),
        F.array(*map(F.lit, entry["words"])).alias("words"),
        F.lit(entry["key_at"]).alias("key_at"),
        F.lit(len(entry["key"])).alias("key_n"),
    )


#: A proposed start is one long: template number times STRIDE, plus the start, plus SHIFT (starts can be negative).
STRIDE, SHIFT = 1 << 32, 1 << 16


def license_scan(docs: DataFrame, text_col: str = "text", min_cover: float = 0.75) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``min_cover``: share of a template's words that must stand at their relative places,
    besides its key phrase. ``score``: the best share over all starts that the postings of a
    template's two rarest key words have in common.
    """
    entries = templates()
    vocabulary = sorted({w for e in entries for w in e["key"]})
    n_docs, frequency = document_frequencies(docs, vocabulary, text_col)
    idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (-idf[w], w)))}
    # ties of frequency are ties of order as well: a template's first word wins them
    rank = {w: min(order[v] for v in vocabulary if frequency.get(v, 0) == frequency.get(w, 0)) for w in vocabulary}
    postings: list[dict[str, list[tuple[int, int]]]] = [{}, {}]
    for k, e in enumerate(entries):
        for slot, offset in enumerate(looked_up(e, rank)):
            postings[slot].setdefault(e["words"][offset], []).append((k, offset))

    text = F.coalesce(F.col(text_col), F.lit(""))
    # split leaves an empty part before a leading and after a trailing separator
    lead = (F.element_at("parts", 1) == "").cast("int")
    tail = (F.element_at("parts", -1) == "").cast("int")
    present = F.array_intersect(F.array(*(F.lit(w) for w in sorted(order, key=order.get))), F.split(F.lower(text), SEPARATOR, -1))
    rows = docs.select("doc_id", F.split(text, SEPARATOR, -1).alias("parts"), present.alias("present"))
    rows = rows.withColumns({"lead": lead, "n_words": F.greatest(F.size("parts") - lead - tail, F.lit(0)).cast("long")})
    keys = F.array(*(F.array(*(F.lit(w) for w in sorted(set(e["key"]), key=order.get))) for e in entries))
    complete = F.filter(F.transform(keys, lambda key, k: F.when(F.size(F.array_except(key, F.col("present"))) == 0, k)), lambda k: k.isNotNull())
    rows = rows.withColumn("complete", F.when(F.size("present") > 1, complete).otherwise(F.array().cast("array<int>")))

    def proposed(slot: int) -> Column:
        """Starts by one looked-up word of each template, as longs."""
        index = F.create_map(*(x for w, p in sorted(postings[slot].items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(o).alias("o")) for k, o in p)))))
        hits = F.filter(F.transform("parts", lambda w, i: F.struct(F.element_at(index, ascii_lower(w)).alias("p"), (i - F.col("lead")).alias("at"))), lambda h: h.p.isNotNull())
        code = lambda h, p: p.k.cast("long") * STRIDE + (h["at"] - p.o).cast("long") + SHIFT
        return F.flatten(F.transform(hits, lambda h: F.transform(F.filter(h.p, lambda p: F.array_contains("complete", p.k)), lambda p: code(h, p))))

    starts = F.when(F.size("complete") > 0, F.array_intersect(proposed(0), proposed(1))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("starts", starts).drop("present", "complete")
    table = F.array(*map(as_column, entries))

    def matched(start: Column, e: Column) -> Column:
        """By template word: whether it stands at its place; nothing stands before the first word."""
        return F.transform(e.words, lambda w, i: (start + i >= 0) & F.coalesce(ascii_lower(F.get(F.col("parts"), (start + i + F.col("lead")).cast("int"))) == w, F.lit(False)))

    def judged(s: Column) -> Column:
        e = F.get(table, F.shiftright(s, 32).cast("int"))
        start = F.pmod(s, F.lit(STRIDE)) - SHIFT
        m = matched(start, e)
        return F.struct(
            e.base.alias("base"),
            e.label.alias("label"),
            start.alias("start"),
            (F.size(F.filter(m, lambda x: x)) / F.size(m)).alias("cover"),
            F.forall(F.slice(m, e.key_at + 1, e.key_n), lambda x: x).alias("key"),
        )

    rows = rows.withColumn("found", F.transform("starts", judged)).drop("parts", "starts")
    base = F.filter("found", lambda x: x.base & x.key)
    places = F.transform(base, lambda x: x.start)
    base_labels = F.transform(base, lambda x: x.label)
    added = F.transform(F.filter("found", lambda x: ~x.base & x.key & (x.cover >= min_cover)), lambda x: x.label)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, added)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.cover)), F.lit(0.0)).alias("score"),
    )
