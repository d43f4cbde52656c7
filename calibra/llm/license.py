"""License scans with a positional rare-token index.

Licence templates are word sequences. The index holds, for every template word, its postings (template, position),
and the word's inverse document frequency over all documents. A file looks up, for every template, the rarest
template words that the file itself contains; each occurrence at ``p`` of a word posted at ``q`` votes for the
alignment ``p - q`` (and its neighbours up to ``SLACK``). Alignments on which enough of the rare words' relative
positions intersect are verified: every mandatory key phrase must stand near its place, and the share of template words
found in place is the score. A notice may lack some words; so many more words are looked up that every alignment that
verification accepts has ``RARE`` votes, and the result is that of verifying all alignments.

Exact phrases (``PHRASES``) label a file by themselves.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text

#: Phrases whose words, standing consecutively, give the label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Fixed values: (label, notice, mandatory phrases), wording of public licences and their usual notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files, to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ["permission is hereby granted", "without restriction"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at", ["apache license", "version 2"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation", ["general public license", "free software"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ["mozilla public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted", ["permission to use copy modify", "with or without fee"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
     "this work", ["waived all copyright"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
     ["creative commons attribution sharealike"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ["creative commons attribution 4 0"]),
]

#: Votes of the file's rarest template words that an alignment needs to be verified.
RARE = 4
#: Share of a template's words that must stand in place, and how far from it a word or phrase may stand.
SCORE, SLACK = 0.75, 3

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of the A-Z-lower-cased text: runs of digits, letters and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def phrase_starts(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions where the phrase's words stand consecutively; ``joined``: words with single spaces all round."""
    out, at, seen, n = [], 0, 0, 0
    needle = b" " + phrase + b" "
    while (at := joined.find(needle, at)) >= 0:
        n += joined.count(b" ", seen, at)
        seen = at
        out.append(n)
        at += 1
    return out


class Index:
    """Templates with their postings and, once counted, their words' inverse document frequencies."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.texts = [words(t[1]) for t in templates]
        self.keys = [[words(p) for p in t[2]] for t in templates]
        self.vocabulary = {w for t in self.texts for w in t}
        self.idf: dict[bytes, float] = {}

    def weigh(self, counts: dict[bytes, int], n: int) -> Index:
        self.idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in self.vocabulary}
        self.rarest = []  # per template: its (word, position) by falling IDF
        for t in self.texts:
            self.rarest.append(sorted(((w, q) for q, w in enumerate(t)), key=lambda wq: (-self.idf[wq[0]], *wq)))
        return self

    def scan(self, file: list[bytes]) -> dict[str, float]:
        """Label -> best score of the templates verified in the file."""
        here = self.vocabulary.intersection(file)
        looked = []  # (template, (word, position) of the rarest words present, votes needed)
        joined = b""
        for k, rare in enumerate(self.rarest):
            n = len(rare)
            some = [(w, q) for w, q in rare if w in here]
            if not some or len(some) / n < SCORE:
                continue
            joined = joined or b" " + b" ".join(file) + b" "
            if all(not key or b" " + b" ".join(key) + b" " in joined for key in self.keys[k]):
                lost = len(some) - next(h for h in range(n + 1) if h / n >= SCORE)  # places that may be out of place
                some = some[:lost + RARE]
                looked.append((k, some, max(1, len(some) - lost)))
        if not looked:
            return {}
        wanted = {w for _, some, _ in looked for w, _ in some}
        places = defaultdict(list)
        for p, w in enumerate(file):
            if w in wanted:
                places[w].append(p)
        out: dict[str, float] = {}
        for k, some, need in looked:
            votes: Counter = Counter()
            for w, q in some:
                votes.update({p - q + d for p in places[w] for d in range(-SLACK, SLACK + 1)})
            for shift, n in votes.items():
                if n < need:
                    continue
                score = self.verify(file, k, shift)
                if score >= SCORE:
                    label = self.labels[k]
                    out[label] = max(out.get(label, 0.0), score)
        return out

    def verify(self, file: list[bytes], k: int, shift: int) -> float:
        """Share of template words in place (``SLACK`` words aside at most); 0 without every mandatory phrase."""
        text = self.texts[k]
        low, high = max(0, shift - SLACK), shift + len(text) + SLACK
        part = file[low:high]
        for key in self.keys[k]:
            m = len(key)
            if not any(part[i:i + m] == key for i in range(len(part) - m + 1)):
                return 0.0
        hits = 0
        for q, w in enumerate(text):
            at = shift + q
            hits += w in file[max(0, at - SLACK):max(0, at + SLACK + 1)]
        return hits / len(text)


def document_counts(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """Document frequency of every template word over all documents, and the number of documents."""
    known = index.vocabulary

    def each(texts):
        seen: Counter = Counter()
        for t in texts:
            seen.update(known.intersection(words(t)))
        yield "", len(texts)
        for w, n in seen.items():
            yield w.decode(), n

    rows = by_text(docs, [text_col], each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}  # at most one row per template word
    return counts, counts.pop(b"", 0)


def scan_documents(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base (places of exact phrases), first_word, last_word (null without), base_labels, labels
    (arrays, distinct and sorted; labels has the base ones too) and score (1 for an exact phrase, else the best
    template's share, 0 without a label). One row per input row; a null text counts as empty."""
    index = Index(templates)
    index.weigh(*document_counts(docs, index, text_col))
    exact = [(b" ".join(words(p)), label) for p, label in phrases.items()]

    def each(ids, texts):
        for d, t in zip(ids, texts):
            file = words(t)
            joined = b" " + b" ".join(file) + b" "
            starts, base = [], set()
            for phrase, label in exact:
                if at := phrase_starts(joined, phrase):
                    starts += at
                    base.add(label)
            found = index.scan(file)
            score = 1.0 if base else max(found.values(), default=0.0)
            yield (d, len(file), len(starts), min(starts, default=None), max(starts, default=None), sorted(base),
                   sorted(base | set(found)), score)

    return by_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                   ["doc_id", "text"], each,
                   "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
                   "labels array<string>, score double")
