"""Licence scans: matching statistics against a generalised suffix automaton of licence texts, chained into spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxquarry.llm.arrow_batches import byte_slices
from boxquarry.llm.licence_texts import FULL
from boxquarry.llm.suffix_automaton import SuffixAutomaton, item_words
from boxquarry.llm.text_hashing import ALNUM_WORDS, word_hashes

# The phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short publicly known notices and their labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

TEMPLATES = [*NOTICES, *FULL]


class LicenceIndex:
    """The automaton of phrases and templates; a match counts from ``least`` words on."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], least: int = 4, gap: int = 6, share: float = 0.75):
        texts = [item_words(p) for p in phrases] + [item_words(t) for _, t in templates]
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.sizes = [len(t) for t in texts]
        self.n_phrases, self.least, self.gap, self.share = len(phrases), least, gap, share
        self.automaton = SuffixAutomaton(texts)
        self.marks = self.automaton.marks({n: self.sizes[n] for n in range(self.n_phrases)})
        self.shortest = min([least, *self.sizes[: self.n_phrases]])
        self.places: list[list[int]] = [[] for _ in texts]
        self._starts: dict[tuple[int, int, int], list[int]] = {}

    def _template_starts(self, state: int, length: int, template: int) -> list[int]:
        """Where the last ``length`` words of the state's runs begin in a template."""
        if (key := (state, length, template)) not in self._starts:
            end = self.automaton.end[state] + 1
            owner = self.automaton.members[state][0]
            run = self.automaton.streams[owner][end - length : end]
            own = self.automaton.streams[template]
            self._starts[key] = [k for k in range(len(own) - length + 1) if own[k : k + length] == run]
        return self._starts[key]

    def scan(self, tokens: list[int], at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrase places (start, phrase) and matches (start, end, template, start in template) of one stretch."""
        states, lengths = self.automaton.statistics(tokens)
        phrases, matches = [], []
        for k, (state, length) in enumerate(zip(states, lengths, strict=True)):
            for phrase, size in self.marks[state]:
                if length >= size:
                    phrases.append((at + k + 1 - size, phrase))
            if length >= self.least and (k + 1 == len(tokens) or lengths[k + 1] <= length):
                for template in self.automaton.members[state]:
                    if template >= self.n_phrases:
                        for begin in self._template_starts(state, length, template):
                            matches.append((at + k + 1 - length, at + k + 1, template, begin))
        return phrases, matches

    def chains(self, matches: list[tuple[int, int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """For each template, spans (start, end, covered template words) of its best chains of matches.

        Matches of a chain rise in both texts and leave at most ``gap`` words between them in the document.  Dynamic
        programming finds the chain that covers most template words up to each match; of those with one first match the fullest is a span.
        """
        by: dict[int, set[tuple[int, int, int]]] = {}
        for start, end, template, begin in matches:
            by.setdefault(template, set()).add((end, start, begin))
        out: dict[int, list[tuple[int, int, int]]] = {}
        for template, found in by.items():
            order, best, root = sorted(found), [], []
            for i, (end, start, begin) in enumerate(order):
                most, first = end - start, i
                for j in range(i - 1, -1, -1):
                    before, since, at = order[j]
                    if before < start - self.gap:
                        break
                    # what the earlier match has of this one's words goes to the earlier
                    common = max(0, before - start)
                    done = at + before - since
                    if before < end and since < start and begin + common >= done and best[j] + end - start - common > most:
                        most, first = best[j] + end - start - common, root[j]
                best.append(most)
                root.append(first)
            fullest: dict[int, int] = {}
            for i, first in enumerate(root):
                if first not in fullest or best[i] > best[fullest[first]]:
                    fullest[first] = i
            out[template] = sorted((order[r][1], order[i][0], best[i]) for r, i in fullest.items())
        return out


    def spans(self, matches: list[tuple[int, int, int, int]]) -> list[dict]:
        """Chains over enough of their template, without those inside a span of another label that covers more words."""
        found = [(start, -end, -covered, self.labels[t], min(1.0, covered / self.sizes[t])) for t, chained in self.chains(matches).items() for start, end, covered in chained if covered >= self.share * self.sizes[t]]
        out, around = [], (0, 0, "")
        for start, end, covered, label, share in sorted(found):
            if -end <= around[0] and -covered < around[1] and label != around[2]:
                continue
            around = max(around, (-end, -covered, label))
            out.append({"start": start, "end": -end, "label": label, "coverage": share})
        return out


_KIND = "n_words long, bases array<struct<word:bigint,label:string>>, spans array<struct<start:bigint,end:bigint,label:string,coverage:double>>"


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each row of ``docs``: (id, n_words, bases, spans).

    bases: each place where a phrase's words stand consecutively, overlapping ones too.  spans: covered template spans
    in words, with the label and the share of the template's words that the span covers, if three quarters or more; a span
    inside one of another label that covers more words goes.
    Null and empty texts have no words; repeated rows are each answered; extra columns are ignored.
    """
    index = LicenceIndex(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part in byte_slices(batch, "text"):
                words, bounds = word_hashes(part.column("text"), ALNUM_WORDS)
                bases: list[list[dict]] = [[] for _ in range(len(part))]
                matches: dict[int, list[tuple[int, int, int, int]]] = {}
                stretches = block.automaton.runs(words, block.shortest, bounds)
                rows = (np.searchsorted(bounds, [s[0] for s in stretches], side="right") - 1).tolist() if stretches else []
                for (at, tokens), row in zip(stretches, rows, strict=True):
                    phrases, found = block.scan(tokens, at - int(bounds[row]))
                    bases[row] += [{"word": w, "label": block.labels[p]} for w, p in phrases]
                    if found:
                        matches.setdefault(row, []).extend(found)
                spans: list[list[dict]] = [[] for _ in range(len(part))]
                for row, found in matches.items():
                    spans[row] = block.spans(found)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "n_words": pa.array(np.diff(bounds), pa.int64()), "bases": pa.array(bases, _ARROW["bases"]), "spans": pa.array(spans, _ARROW["spans"])})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {_KIND}").withColumnRenamed("id", id_col)


_ARROW = {
    "bases": pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("coverage", pa.float64())])),
}


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    labels are those of base phrases and of covered template spans; score is the largest coverage of a span, 1 with a base phrase.
    """
    base = F.transform("bases", lambda b: b["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return license_spans(docs, id_col, text_col).select(
        id_col,
        "n_words",
        F.size("bases").cast("long").alias("n_base"),
        F.array_min(F.transform("bases", lambda b: b["word"])).alias("first_word"),
        F.array_max(F.transform("bases", lambda b: b["word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.when(F.size("bases") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))).alias("score"),
    )
