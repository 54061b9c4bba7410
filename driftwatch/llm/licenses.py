"""License scans: template markup compiled into token automata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftwatch.llm import flat

# Phrases whose places are counted, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label and notice. Words in [ ] may be absent; {name:min-max} stands for that many words of any kind,
# {name#min-max} for that many numbers. A captured slot can be named in the label.
TEMPLATES = (
    ("gpl-{version}", "licensed under the gnu general public license version {version#1-2}"),
    ("gpl-{version}-or-later", "under the terms of the gnu general public license as published by the free software "
                               "foundation either version {version#1-2} of the license or at your option any later version"),
    ("lgpl-{version}", "licensed under the gnu lesser general public license version {version#1-2}"),
    ("apache-{version}", "licensed under the apache license version {version#1-2}"),
    ("cc-by-{version}", "licensed under [a] [the] [terms of the] cc by {version#1-2}"),
    ("cc-by-sa-{version}", "licensed under [a] [the] [terms of the] cc by sa {version#1-2}"),
    ("cc-by-nc-{version}", "licensed under [a] [the] [terms of the] cc by nc {version#1-2}"),
    ("cc-by-nc-sa-{version}", "licensed under [a] [the] [terms of the] cc by nc sa {version#1-2}"),
    ("cc-by-nd-{version}", "licensed under [a] [the] [terms of the] cc by nd {version#1-2}"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the [terms of the] mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this {what:1-3} and "
                 "associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this {what:1-3} for any purpose with or without fee is "
            "hereby granted"),
)


@dataclass
class Automaton:
    """A template as states: ``steps[state]`` lists (test, slot, next state); ``skips[state]`` states reached for free."""

    label: str
    steps: list[list[tuple[str, str | None, int]]] = field(default_factory=lambda: [[]])
    skips: dict[int, list[int]] = field(default_factory=dict)
    anchor: str = ""

    def _word(self, test: str, slot: str | None = None) -> None:
        self.steps[-1].append((test, slot, len(self.steps)))
        self.steps.append([])

    def longest(self, words: list[str]) -> tuple[int, dict[str, list[str]]] | None:
        """Words taken by the longest acceptance from the start of ``words``, and what the slots hold."""
        threads, best = {0: {}}, None
        for n in range(len(words) + 1):
            todo = list(threads)
            while todo:
                state = todo.pop()
                for free in self.skips.get(state, ()):
                    if free not in threads:
                        threads[free] = threads[state]
                        todo.append(free)
            if len(self.steps) - 1 in threads:
                best = n, threads[len(self.steps) - 1]
            if n == len(words) or not threads:
                break
            after = {}
            for state, held in threads.items():
                for test, slot, state_after in self.steps[state]:
                    if test == words[n] or test == "*" or (test == "#" and words[n].isdigit()):
                        after[state_after] = {**held, slot: [*held.get(slot, []), words[n]]} if slot else held
            threads = after
        return best


def compiled(label: str, markup: str) -> Automaton:
    a = Automaton(label)
    for part in re.findall(r"\[[^\]]*\]|\{[^}]*\}|[^\s\[\]{}]+", markup):
        if part[0] == "[":
            start = len(a.steps) - 1
            for word in part[1:-1].split():
                a._word(word)
            a.skips.setdefault(start, []).append(len(a.steps) - 1)
        elif part[0] == "{":
            name, kind, least, most = re.fullmatch(r"\{(\w+)([:#])(\d+)-(\d+)\}", part).groups()
            ends = []
            for n in range(int(most)):
                if n >= int(least):
                    ends.append(len(a.steps) - 1)
                a._word("#" if kind == "#" else "*", name)
            for state in ends:
                a.skips.setdefault(state, []).append(len(a.steps) - 1)
        else:
            a._word(part)
    a.anchor = a.steps[0][0][0]
    return a


def _hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return flat.span_hashes(data, np.array([0]), np.array([len(data)]))[0]


class Scanner:
    def __init__(self, phrases=None, templates=None, reach: int = 64):
        self.phrases = {tuple(p.split()): label for p, label in (PHRASES if phrases is None else phrases).items()}
        self.automata = [compiled(*t) for t in (TEMPLATES if templates is None else templates)]
        self.by_anchor: dict[str, list[Automaton]] = {}
        for a in self.automata:
            self.by_anchor.setdefault(a.anchor, []).append(a)
        self.reach = max([reach, *(len(a.steps) for a in self.automata)])
        self.codes = {w: _hash(w) for w in {w for p in self.phrases for w in p} | set(self.by_anchor)}

    def scan(self, block: flat.Block):
        w = flat.words(block, "plain")
        h = flat.span_hashes(block.data, w.start, w.end)
        begins = w.begins
        word = lambda i: block.data[w.start[i]:w.end[i]].tobytes().decode("utf-8", "replace")
        places, found = [[] for _ in range(len(block))], [set() for _ in range(len(block))]
        kept = [set() for _ in range(len(block))]
        for phrase, label in self.phrases.items():
            at = np.flatnonzero(h == self.codes[phrase[0]])
            for i in at[at + len(phrase) <= len(h)].tolist():
                d = int(w.doc[i])
                if i + len(phrase) <= begins[d + 1] and tuple(map(word, range(i, i + len(phrase)))) == phrase:
                    places[d].append(i - int(begins[d]))
                    kept[d].add(label)
        for anchor, automata in self.by_anchor.items():
            for i in np.flatnonzero(h == self.codes[anchor]).tolist():
                d = int(w.doc[i])
                ahead = [word(j) for j in range(i, min(i + self.reach, int(begins[d + 1])))]
                for a in automata:
                    if taken := a.longest(ahead):
                        found[d].add(a.label.format(**{k: ".".join(v) for k, v in taken[1].items()}))
        return w.counts, places, kept, found


def licenses(docs: DataFrame, phrases=None, templates=None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Phrases are counted wherever their words stand consecutively. A template is accepted at any place where
    its mandatory words match exactly, optional ones are there or not, and slots hold words of their kind;
    its label joins the phrases' labels. The score is 1 with an accepted template, 0.5 with phrases only, else 0.

    Null and empty texts have no words, places and labels; each repeated row gets its own result; further
    columns are not read; an empty table gives an empty result.
    """
    def scan(texts, ids):
        scanner, out = Scanner(phrases, templates), ([], [], [], [], [], [], [])
        for block in flat.blocks(texts):
            counts, places, kept, found = scanner.scan(block)
            out[0].extend(counts.tolist())
            for p, k, f in zip(places, kept, found, strict=True):
                out[1].append(len(p))
                out[2].append(min(p, default=None))
                out[3].append(max(p, default=None))
                out[4].append(",".join(sorted(k)))
                out[5].append(",".join(sorted(k | f)))
                out[6].append(1.0 if f else 0.5 if k else 0.0)
        kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64())
        return [ids, *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))]

    return flat.per_document(docs, scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                         "base_labels string, labels string, score double")
