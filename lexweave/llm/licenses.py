"""License scans by template markup.

A template is the wording of a license or of a notice, in which regions may be marked as optional or as replaceable. Templates are compiled together into one
deterministic automaton over words: an optional region adds a way around it, a replaceable one a way through any words up to a number, and a text is accepted
where all that is mandatory stands word by word. Case, punctuation and white space don't count. The automaton is started at each word that can begin
a template and read until no template can go on.

Documents are scanned one by one in the scan's own partitions: no shuffle. Of a text, a task holds four bytes a word.

Markup: ``((...))`` is optional and may hold other regions, ``[[a-b]]`` stands for a to b words of any kind, ``x/y`` for one of two words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded
from .kernels import buffers
from .tokens import WORD, numbered, split


@dataclass(frozen=True)
class Template:
    """A label and a wording with markup; ``base``: a plain phrase."""

    label: str
    wording: str
    base: bool = False


# Phrases that count as base.
BASE = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))

_UNDER = "licensed/released/distributed/available under ((the)) ((terms of)) ((the)) ((a))"
_AS_IS_MIT = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD_START = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
((1)) redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
((2)) redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution"""
_BSD_END = """this software is provided by [[1-12]] as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall [[1-12]] be liable for any direct indirect incidental special exemplary or
consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however
caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use
of this software even if advised of the possibility of such damage"""

# The public wording of licenses and of the notices that name them.
TEMPLATES = (
    Template("mit", f"""((the mit license)) ((mit)) ((copyright ((c)) [[1-12]] ((all rights reserved))))
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice ((including the next paragraph)) shall be included in all copies or substantial portions of the software
(({_AS_IS_MIT}))"""),
    Template("mit", f"((this [[1-4]] is)) {_UNDER} mit license/licence"),
    Template("apache", """((copyright [[1-12]])) licensed under the apache license version 2 0 ((the license ((you may not use this file except in
compliance with the license you may obtain a copy of the license at [[1-10]] unless required by applicable law or agreed to in writing software distributed
under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
language governing permissions and limitations under the license))))"""),
    Template("gpl", """((this work/program/software/file/library is)) ((free software)) licensed/released/distributed/available under ((the)) ((terms of)) the gnu
((lesser/affero/library)) general public license ((version/v 2/3 ((0)))) ((or ((at your option)) ((any)) later ((version))))"""),
    Template("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
free software foundation either version 2/3 of the license or at your option any later version
((this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
particular purpose see the gnu general public license for more details))"""),
    Template("bsd", f"((copyright ((c)) [[1-12]] ((all rights reserved)))) {_BSD_START} ((((3)) neither the name of [[1-12]] nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission)) {_BSD_END}"),
    Template("bsd", f"((this [[1-4]] is)) {_UNDER} ((2/3/modified/simplified/new)) ((clause)) bsd license/licence"),
    Template("isc", """((copyright ((c)) [[1-12]] ((all rights reserved)))) permission to use copy modify and or distribute this software for any purpose with or without fee
is hereby granted provided that the above copyright notice and this permission notice appear in all copies
((the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and
fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use
data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software))"""),
    Template("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0
((if a copy of the mpl was not distributed with this file you can obtain one at [[1-8]]))"""),
    Template("unlicense", """this is free and unencumbered software released into the public domain
((anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose
commercial or non commercial and by any means))"""),
    *[
        Template(label, f"((this [[1-4]] is)) {_UNDER} {name} ((1/2/3/4 0/5)) ((international/unported)) ((license/licence))")
        for label, code, words in (
            ("cc-by", "by", "attribution"), ("cc-by-nc", "by nc", "attribution noncommercial"), ("cc-by-sa", "by sa", "attribution sharealike"), ("cc-by-nd", "by nd", "attribution noderivatives"),
            ("cc-by-nc-sa", "by nc sa", "attribution noncommercial sharealike"), ("cc-by-nc-nd", "by nc nd", "attribution noncommercial noderivatives"),
        )
        for name in (f"cc {code}", f"creative commons {words}")
    ],
)

_MARK = re.compile(r"(\(\()|(\)\))|\[\[(\d+)-(\d+)\]\]|([^\s()\[\]]+)")


def parsed(wording: str) -> list:
    """The wording as a list of sets of words, (a, b) for a to b words of any kind, and lists for what is optional."""
    stack: list[list] = [[]]
    for opens, closes, least, most, word in _MARK.findall(wording):
        if opens:
            stack.append([])
        elif closes:
            region = stack.pop()
            stack[-1].append(region)
        elif word:
            stack[-1].append({w for x in word.split("/") for w in split(x)})
        else:
            stack[-1].append((int(least), int(most)))
    if len(stack) != 1:
        raise ValueError(f"a region is not closed: {wording[:60]}")
    return stack[0]


@dataclass
class Net:
    """States with ways by a word, by any word and without one."""

    by_word: list[dict[str, set[int]]] = field(default_factory=list)
    by_any: list[set[int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)

    def state(self) -> int:
        self.by_word.append({})
        self.by_any.append(set())
        self.free.append(set())
        return len(self.free) - 1

    def add(self, regions: list, at: int) -> int:
        """Ways for ``regions`` from ``at``; where they end."""
        for r in regions:
            if isinstance(r, list):
                end = self.add(r, at)
                over = self.state()
                self.free[at].add(over)
                self.free[end].add(over)
                at = over
            elif isinstance(r, tuple):
                over = self.state()
                for i in range(r[1] + 1):
                    if i >= r[0]:
                        self.free[at].add(over)
                    if i < r[1]:
                        after = self.state()
                        self.by_any[at].add(after)
                        at = after
                at = over
            else:
                after = self.state()
                for w in r:
                    self.by_word[at].setdefault(w, set()).add(after)
                at = after
        return at

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)


@dataclass
class Automaton:
    """``step[state]``: the state after each word's number, ``other[state]``: after any other word, -1 for none; ``accepts[state]``: places of
    templates that end there. State 0 starts."""

    number: dict[bytes, int]
    step: list[dict[int, int]]
    other: list[int]
    accepts: list[tuple[int, ...]]
    starts: np.ndarray  # whether a word's number can begin a template


def compiled(templates: tuple[Template, ...]) -> Automaton:
    net = Net()
    start, ends = net.state(), {}
    for i, t in enumerate(templates):
        at = net.state()
        net.free[start].add(at)
        ends[net.add(parsed(t.wording), at)] = i
    first = net.closed({start})
    if first & ends.keys() or any(net.by_any[s] for s in first):
        raise ValueError("a template must begin with a word and may not be empty")
    words = sorted({w for ways in net.by_word for w in ways})
    number = {w: i for i, w in enumerate(words, 1)}
    known, todo = {first: 0}, [first]
    step: list[dict[int, int]] = []
    other: list[int] = []
    accepts: list[tuple[int, ...]] = []

    def place(states: set[int]) -> int:
        if not states:
            return -1
        at = net.closed(states)
        if at not in known:
            known[at] = len(known)
            todo.append(at)
        return known[at]

    for at in todo:  # grows meanwhile
        passing = {x for s in at for x in net.by_any[s]}
        ways: dict[str, set[int]] = {}
        for s in at:
            for w, to in net.by_word[s].items():
                ways.setdefault(w, set()).update(to)
        other.append(place(passing))
        step.append({number[w]: place(to | passing) for w, to in ways.items()})
        accepts.append(tuple(sorted(ends[s] for s in at if s in ends)))
    starts = np.zeros(len(words) + 1, bool)
    starts[list(step[0])] = True
    return Automaton({w.encode(): i for w, i in number.items()}, step, other, accepts, starts)


def places(a: Automaton, text: memoryview, base: frozenset[int]) -> tuple[int, list[tuple[int, int, int]]]:
    """How many words a text has, and what is accepted: first word, end and template. Of several templates that begin at one word those with the
    longest wording count ("by nc" is not "by"), and the ``base`` ones, which always stay."""
    parts = list(numbered(text, a.number))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    found = []
    for at in np.flatnonzero(a.starts[ids]).tolist():
        state, i, last = 0, at, []
        ahead: list[int] = []
        while True:
            if i - at >= len(ahead):
                ahead += ids[i : i + 2 if i == at else i + 64].tolist()
                if i - at >= len(ahead):
                    break
            state = a.step[state].get(ahead[i - at], a.other[state])
            i += 1
            if state < 0:
                break
            found += [(at, i, t) for t in a.accepts[state] if t in base]
            last = [(at, i, t) for t in a.accepts[state] if t not in base] or last
        found += last
    return len(ids), found


@functools.cache
def automaton(templates: tuple[Template, ...]) -> Automaton:
    """Compiled once in each Python worker."""
    return compiled(templates)


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("end", pa.int64())]))
RESULTS = {"n_words": "bigint", "n_covered": "bigint", "places": "array<struct<label:string,base:boolean,first:bigint,end:bigint>>"}


def _scanned(templates: tuple[Template, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, base = automaton(templates), frozenset(i for i, t in enumerate(templates) if t.base)
        for batch in batches:
            data, off = buffers(batch.column("text"))
            raw = memoryview(data)
            n_words, n_covered, found = [], [], []
            for i in range(batch.num_rows):
                n, here = places(a, raw[off[i] : off[i + 1]], base)
                covered = upto = 0
                for at, end, _ in sorted(here):
                    covered += max(end - max(at, upto), 0)
                    upto = max(upto, end)
                n_words.append(n)
                n_covered.append(covered)
                found.append([{"label": templates[t].label, "base": templates[t].base, "first": at, "end": end} for at, end, t in here])
            new = [pa.array(n_words, pa.int64()), pa.array(n_covered, pa.int64()), pa.array(found, _PLACES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *RESULTS])

    return run


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + TEMPLATES) -> DataFrame:
    """``docs`` (text) with n_words, n_covered (words within accepted wording) and places: label, base, first word and end of each accepted template; of
    several that begin at one word, those with the longest wording and the base ones.

    Null or empty text: no words, no places. Rows are scanned one by one, so repeated rows and ties each get their own; columns of ``docs`` keep their
    names, but those with the names of the results, in whatever case, are replaced. An empty table gives an empty table. A text is read in pieces;
    its places and four bytes for each word are held by its task.
    """
    rows = shielded(docs.withColumn("text", F.col("text").cast("string")), "text")
    kept = [(n, c) for n, c in zip(rows.columns, docs.columns) if c.lower() not in RESULTS]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], *[f"{c} {t}" for c, t in RESULTS.items()]])
    return rows.mapInArrow(_scanned(templates), schema).select(*[F.col(n).alias(c) for n, c in kept], *RESULTS)


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def license_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, of its doc_id and text alone, as :func:`license_scan`; the score is the share of words within accepted wording."""
    base = F.filter("places", lambda p: p["base"])
    first = F.transform(base, lambda p: p["first"])
    score = F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(0.0)
    return license_scan(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("places")).alias("labels"), score.alias("score"),
    )


def pattern(regions: list) -> str:
    """The same as a regular expression over words with a space after each."""
    out = ""
    for r in regions:
        if isinstance(r, list):
            out += f"(?:{pattern(r)})?"
        elif isinstance(r, tuple):
            out += f"(?:[^ ]+ ){{{r[0]},{r[1]}}}"
        else:
            out += f"(?:{'|'.join(sorted(r))}) "
    return out


def longest(regions: list) -> int:
    return sum(longest(r) if isinstance(r, list) else r[1] if isinstance(r, tuple) else 1 for r in regions)


def _oracle() -> str:
    all_ = [(t, parsed(t.wording)) for t in BASE + TEMPLATES]
    tried = " UNION ALL ".join(f"SELECT r, i, '{t.label}' AS label, {t.base} AS base, regexp_extract(ahead, '^{pattern(r)}') AS x FROM s" for t, r in all_)
    begin = ", ".join(f"'{w.decode()}'" for w, i in automaton(BASE + TEMPLATES).number.items() if automaton(BASE + TEMPLATES).starts[i])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
s AS (SELECT r, i, array_to_string(w[i:i + {max(longest(r) for _, r in all_)}], ' ') || ' ' AS ahead FROM p JOIN d USING (r) WHERE word IN ({begin})),
x AS ({tried}),
a AS (SELECT r, i, label, base, length(x) - length(replace(x, ' ', '')) AS n FROM x WHERE x <> ''),
m AS (SELECT * FROM a QUALIFY base OR n = max(n) OVER (PARTITION BY r, i, base)),
c AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
l AS (SELECT r, count(*) FILTER (base) AS n_base, min(i) FILTER (base) - 1 AS first_word, max(i) FILTER (base) - 1 AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN len(w) > 0 THEN coalesce(n, 0) / len(w) ELSE 0.0::DOUBLE END AS score
FROM d LEFT JOIN l USING (r) LEFT JOIN c USING (r)
"""


#: The same rows in DuckDB's SQL.
ORACLE = _oracle()
