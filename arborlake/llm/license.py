"""License statements in documents: exact phrases, and text close to known templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm import passages

# The exact phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Well-known public license notices and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


def _phrase_finder(phrases: dict[str, str]) -> Callable[[list[bytes]], tuple]:
    """(places, first word, last word, labels) of the phrases among a document's words."""
    known = [(list(passages.words_in(p)), label) for p, label in phrases.items()]
    known = [(w, label, max(range(len(w)), key=lambda i, w=w: len(w[i]))) for w, label in known if w]

    def find(words: list[bytes]) -> tuple:
        starts, labels = [], set()
        for phrase, label, anchor in known:
            at, word, n = anchor - 1, phrase[anchor], len(phrase)
            while True:
                try:
                    at = words.index(word, at + 1)
                except ValueError:
                    break
                start = at - anchor
                if start >= 0 and words[start : start + n] == phrase:
                    starts.append(start)
                    labels.add(label)
        return len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)

    return find


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] | None = None, threshold: float = 0.8, shingle: int = 5
) -> DataFrame:
    """One row per document: doc_id, n_words, phrase places (n, first, last, labels), template matches.

    phrases: exact phrases with a label each (default PHRASES). templates: (label, text) pairs, a bounded list
    (default TEMPLATES): every block of text that holds ``threshold`` of the template's distinct shingles within as many words
    as the template's divided by ``threshold`` is found, so words may be changed, left out or put in. ``starts`` and ``ends``
    are the matching blocks, ``found`` their labels, ``containment`` the highest part held (0.0: none).
    Null and empty texts have no words; repeated documents give repeated rows; other columns are ignored.
    """
    known = TEMPLATES if templates is None else templates
    queries = [passages.Passage(passages.words_in(text), threshold, label, longest=1 / threshold) for label, text in known]

    def make(n: int, matches) -> tuple:
        rows = sorted({(start, end, label, part) for label, start, end, part in matches})
        best = max((x[3] for x in rows), default=0.0)
        return n, [x[0] for x in rows], [x[1] for x in rows], sorted({x[2] for x in rows}), best

    return passages.match_queries(
        docs, queries, shingle, ["doc_id"],
        make, "n_words long, starts array<long>, ends array<long>, found array<string>, containment double",
        _phrase_finder(PHRASES if phrases is None else phrases), "n_base long, first_word long, last_word long, base array<string>",
    )


def license_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1.0 for an exact phrase).

    A row per row of ``docs``, repeated ones too. Null and empty texts have no words, null first and last places, empty
    labels and a score of 0.0. Labels stand in ascending order, each once; how many phrases or templates tie for the score
    does not matter.
    """
    rows = scan_licenses(docs, **how)
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat("base", "found"))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("containment"))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score")
    )
