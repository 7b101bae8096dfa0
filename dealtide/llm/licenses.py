"""License scans by template markup compiled into token automata.

A template is wording in words, with ``[...]`` around what may be missing and ``{m-n}`` where any m to n words may stand. It compiles
into a non-deterministic automaton over words: one state before each symbol, jumps over optional regions and over the
spare words of replaceable ones. A run is a set of states, held as the bits of one number, and starts wherever
the first word stands; the wording is accepted if its last state is reached, so all that is mandatory matches exactly.
Fixed phrases are templates without markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .registry import query

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MARK = re.compile(r"[\[\]]|\{(\d+)-(\d+)\}|[^\s\[\]{}]+")

# The phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public licenses and of their usual notices, with the label each gives.
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and [non infringement] [noninfringement] in no event shall {1-12} be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and {1-12} disclaims all warranties with regard "
        "to this software including all implied warranties of merchantability and fitness in no event shall {1-12} be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution this software is provided by {1-12} as is and any express or implied warranties including but "
        "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {1-12} be liable "
        "for any direct indirect incidental special exemplary or consequential damages",
    ),
    (
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution [3] neither the name of {1-12} nor the names of {1-2} contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission this software is provided by {1-12} as is and any express or implied warranties including but "
        "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {1-12} be liable "
        "for any direct indirect incidental special exemplary or consequential damages",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will {1-6} be held liable for any damages arising from the "
        "use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions [1] the origin of this software must not be misrepresented you must not claim that "
        "you wrote the original software [if you use this software in a product an acknowledgment in the product documentation would be appreciated but is "
        "not required] [2] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [3] this notice "
        "may not be removed or altered from any source distribution",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 [0] [the license] you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at {0-6} apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    (
        "gpl-2-or-later",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 2 of the license or [at your option] any later version",
    ),
    (
        "gpl-3-or-later",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or [at your option] any later version",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 [if a copy of the mpl was not distributed with this file you can "
        "obtain one at {0-2} mozilla org mpl 2 0]",
    ),
    ("cc-by", "licensed under a creative commons attribution [{1-1} 0] [international] license"),
    ("cc-by-sa", "licensed under a creative commons attribution share alike [{1-1} 0] [international] license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike [{1-1} 0] [international] license"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    ),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("bsd-3", "spdx license identifier bsd 3 clause"),
]


def symbols_of(template: str) -> tuple[list[str | None], list[tuple[int, int]]]:
    """The symbols of ``template``, None for any word, and the jumps (from, to) between the states before them."""
    symbols: list[str | None] = []
    jumps, opened = [], []
    for mark in MARK.finditer(template):
        token = mark.group()
        if token == "[":
            opened.append(len(symbols))
        elif token == "]":
            jumps.append((opened.pop(), len(symbols)))
        elif mark.group(1) is None:
            symbols.append(token)
        else:
            least, most = int(mark.group(1)), int(mark.group(2))
            end = len(symbols) + most
            jumps += [(len(symbols) + n, end) for n in range(least, most)]
            symbols += [None] * most
    if opened or not symbols or symbols[0] is None or any(start == 0 for start, _ in jumps):
        raise ValueError(f"a template starts with a mandatory word and closes what it opens: {template[:60]}")
    return symbols, jumps


class Automaton:
    """The automaton of one template; state k stands before symbol k, the last one accepts."""

    def __init__(self, label: str, template: str, base: bool = False):
        symbols, jumps = symbols_of(template)
        self.label, self.base, self.first = label, base, symbols[0].encode()
        self.reached = [1 << k for k in range(len(symbols) + 1)]  # states reached without a word
        for start, end in sorted(jumps, reverse=True):
            self.reached[start] |= self.reached[end]
        self.jumping = sum(1 << start for start in {s for s, _ in jumps})
        self.any = sum(1 << k for k, s in enumerate(symbols) if s is None)
        self.takes: dict[bytes, int] = {}
        for k, s in enumerate(symbols):
            if s is not None:
                self.takes[s.encode()] = self.takes.get(s.encode(), 0) | 1 << k
        self.accepts = 1 << len(symbols)

    def closed(self, states: int) -> int:
        open_ = states & self.jumping
        while open_:
            low = open_ & -open_
            states |= self.reached[low.bit_length() - 1]
            open_ ^= low
        return states

    def end(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted wording that starts at ``start``, if there is one."""
        states, found = 1, None
        for k in range(start, len(words)):
            states = (states & (self.takes.get(words[k], 0) | self.any)) << 1
            if not states:
                break
            states = self.closed(states)
            if states & self.accepts:
                found = k + 1
        return found


def automata(templates: list[tuple[str, str]], phrases: dict[str, str]) -> list[Automaton]:
    return [Automaton(label, phrase, True) for phrase, label in phrases.items()] + [Automaton(label, template) for label, template in templates]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_covered, spans) for every row of ``docs`` (doc_id, text); spans (start, end, label, base) in words, end exclusive.

    A span is the longest accepted wording from its start, for each template and phrase that accepts there; ``base`` tells
    the phrases. ``n_covered`` counts the words in any span. Null and empty texts have no words. Repeated rows are each
    scanned. No shuffle; work is one pass over a text and the runs that start in it.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starting: dict[bytes, list[Automaton]] = {}
        for made in automata(templates, phrases):
            starting.setdefault(made.first, []).append(made)
        for batch in batches:
            sizes, covered, rows = [], [], []
            for text in batch.column(1).cast(pa.large_string()).cast(pa.large_binary()):
                words = WORD.findall(text.as_py().translate(LOWER))
                spans = []
                for at in [k for k, word in enumerate(words) if word in starting]:
                    for made in starting[words[at]]:
                        end = made.end(words, at)
                        if end:
                            spans.append({"start": at, "end": end, "label": made.label, "base": made.base})
                inside, last = 0, 0
                for s in spans:  # ascending by start
                    inside += max(0, s["end"] - max(s["start"], last))
                    last = max(last, s["end"])
                sizes.append(len(words))
                covered.append(inside)
                rows.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(covered, pa.int64()), pa.array(rows, kind)], ["doc_id", "n_words", "n_covered", "spans"])

    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_covered long, spans array<struct<start:long,end:long,label:string,base:boolean>>"
    return source.mapInArrow(run, schema)


def sql(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> str:
    """The scan as a recursive query over words, symbols and jumps."""
    rows, jumps = [], []
    for n, (label, template, base) in enumerate([(la, p, True) for p, la in phrases.items()] + [(la, t, False) for la, t in templates]):
        symbols, own = symbols_of(template)
        rows.append(f"({n}, '{label}', {base}, '{' '.join(s or '*' for s in symbols)}')")
        jumps += [f"({n}, {a}, {b})" for a, b in own]
    return f"""
WITH RECURSIVE template(t, label, base, symbols) AS (VALUES {', '.join(rows)}),
jump(t, k, other) AS (VALUES {', '.join(jumps)}),
listed AS (SELECT t, label, base, string_split(symbols, ' ') AS s FROM template),
symbol AS (SELECT t, unnest(s) AS word, unnest(range(len(s))) AS k FROM listed),
d AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
),
w AS (SELECT row_no, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
state AS (
  SELECT row_no, symbol.t, pos AS start, pos + 1 AS pos, k + 1 AS k FROM w JOIN symbol USING (word) WHERE k = 0
  UNION
  SELECT state.row_no, state.t, start, state.pos + step, next FROM state JOIN (
    SELECT symbol.t, symbol.k, symbol.k + 1 AS next, 1 AS step, symbol.word FROM symbol UNION ALL SELECT t, k, other, 0, NULL FROM jump
  ) way ON way.t = state.t AND way.k = state.k LEFT JOIN w ON w.row_no = state.row_no AND w.pos = state.pos
  WHERE step = 0 OR (w.word IS NOT NULL AND way.word IN ('*', w.word))
),
span AS (SELECT row_no, state.t, label, base, start, max(pos) AS stop FROM state JOIN listed ON listed.t = state.t AND state.k = len(s) GROUP BY ALL),
inside AS (SELECT row_no, count(DISTINCT pos) AS n FROM (SELECT row_no, unnest(range(start, stop)) AS pos FROM span) GROUP BY row_no),
found AS (
  SELECT row_no, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM span GROUP BY row_no
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE n::DOUBLE / len(words) END AS score
FROM d LEFT JOIN found USING (row_no) LEFT JOIN inside USING (row_no)
"""


@query("op12_license_scan", sql())
def op12(spark, sf_dir):
    found = scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )
