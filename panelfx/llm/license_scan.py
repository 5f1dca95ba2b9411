"""License scans by template-markup matching.

A template is mandatory wording with ``<<optional>> ... <</optional>>`` regions
and ``<<var n>>`` places that stand for up to n words of any kind.  It is
compiled into a nondeterministic automaton over words and run from every
anchor, the places where its first mandatory words stand.  A text is labelled
when an automaton accepts, that is when all mandatory wording stands there in
order, word for word.

Defined results: a null or empty text has no words, no labels and score 0;
equal texts get equal results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import LOWER, buffer_of, slices, word_strings

#: Phrases of the base search and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of the method and their labels: license names and notices as people write them (fixed values).
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the <<optional>>terms of the<</optional>> mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files"],
    "apache-2.0": ["licensed under the apache license version 2 <<optional>>0<</optional>>"],
    "gpl-3.0": ["licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by "
                "the free software foundation<</optional>> <<optional>>either<</optional>> version 3"],
    "cc-by-4.0": ["licensed under <<optional>>a<</optional>> cc by 4 <<optional>>0<</optional>>",
                  "creative commons attribution 4 0 <<optional>>international<</optional>> license"],
    "cc-by-nc-4.0": ["licensed under <<optional>>a<</optional>> cc by nc 4 <<optional>>0<</optional>>"],
    "cc-by-sa-4.0": ["licensed under <<optional>>a<</optional>> cc by sa 4 <<optional>>0<</optional>>"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"],
    "copyright-reserved": ["copyright <<optional>>c<</optional>> <<var 8>> all rights reserved"],
}
ANY = -1
ANCHOR_WORDS = 2
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:0x80] = True
NOT_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False


def template_words(markup: str) -> list[str]:
    return re.findall(r"<<[^<>]+>>|[^\s<>]+", markup.lower())


@lru_cache(maxsize=4)
def vocabulary(key: tuple) -> dict[str, int]:
    """Codes from 1 of all words that phrases and templates use."""
    words = [w for markup in key for w in template_words(markup) if not w.startswith("<<")]
    return {w: k for k, w in enumerate(dict.fromkeys(words), 1)}


class Automaton:
    """States 0..n: ``steps`` lead on by a word (or ANY), ``free`` without one."""

    def __init__(self, markup: str, codes: dict[str, int]):
        self.steps: list[list[tuple[int, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []
        anchor: list[int] = []
        fixed = True
        self.mandatory = 0
        self.weight = [0]  # mandatory words read on the way to each state
        for token in template_words(markup):
            here = len(self.steps) - 1
            if token == "<<optional>>":
                opened.append(here)
                fixed = fixed and not self.mandatory
            elif token == "<</optional>>":
                self.free[opened.pop()].append(here)
            elif m := re.fullmatch(r"<<var (\d+)>>", token):
                fixed = fixed and not self.mandatory  # in front of the first mandatory word it may be empty as well
                for _ in range(int(m[1])):
                    at = self._state(ANY, self.weight[-1])
                    self.free[here].append(at)
            else:
                self.mandatory += not opened
                self._state(codes[token], self.weight[-1] + (not opened))
                if fixed and not opened:
                    anchor.append(codes[token])
        if not anchor:
            raise ValueError(f"a template needs a mandatory word: {markup!r}")
        self.anchor = anchor[:ANCHOR_WORDS]
        self.last = len(self.steps) - 1

    def _state(self, word: int, weight: int) -> int:
        self.steps[-1].append((word, len(self.steps)))
        self.steps.append([])
        self.free.append([])
        self.weight.append(weight)
        return len(self.steps) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def run(self, words: np.ndarray) -> tuple[bool, float]:
        """Whether the words begin with an accepted text, and the largest share of mandatory words read."""
        states, most = self.closed({0}), 0
        for word in words:
            if self.last in states:
                break
            states = self.closed({to for s in states for want, to in self.steps[s] if want in (ANY, word)})
            if not states:
                break
            most = max(most, *(self.weight[s] for s in states))
        return self.last in states, most / max(1, self.mandatory)


@lru_cache(maxsize=4)
def compiled(templates: tuple, phrases: tuple) -> tuple[dict[str, int], list[tuple[str, Automaton]], list[tuple[str, list[int]]]]:
    codes = vocabulary(tuple(p for p, _ in phrases) + tuple(m for _, m in templates))
    return codes, [(label, Automaton(m, codes)) for label, m in templates], [(label, [codes[w] for w in p.split()]) for p, label in phrases]


def standing(codes: np.ndarray, ends: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Places where the phrase stands within one text; ``ends``: end of the text of each word."""
    n = len(phrase)
    if len(codes) < n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(codes[:len(codes) - n + 1] == phrase[0])
    for k in range(1, n):
        at = at[codes[at + k] == phrase[k]]
    return at[at + n <= ends[at]]


def scan_texts(texts: pa.Array, templates: tuple, phrases: tuple) -> dict[str, list]:
    codes_of, automata, base = compiled(templates, phrases)
    data, offsets = buffer_of(texts)
    data = LOWER[data].copy()
    data[NOT_WORD[data]] = 0x20  # single bytes, so the text keeps its length
    clean = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    words, counts = word_strings(clean)
    found = pc.index_in(words, value_set=pa.array(list(codes_of), words.type))
    codes = pc.fill_null(pc.add(found, 1), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(counts)))
    rows = len(counts)
    row = np.repeat(np.arange(rows), counts)
    end = first[1:][row]

    n_base = np.zeros(rows, np.int64)
    first_word, last_word = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    base_labels: dict[int, set[str]] = {}
    for label, phrase in base:
        at = standing(codes, end, phrase)
        r, place = row[at], at - first[row[at]]
        np.add.at(n_base, r, 1)
        np.minimum.at(first_word, r, place)
        np.maximum.at(last_word, r, place)
        for k in np.unique(r):
            base_labels.setdefault(int(k), set()).add(label)
    own: dict[int, set[str]] = {}
    score = np.where(n_base > 0, 0.5, 0.0)
    for label, automaton in automata:
        for at in standing(codes, end, automaton.anchor):
            k = int(row[at])
            accepted, share = automaton.run(codes[at:end[at]])
            score[k] = max(score[k], share if not accepted else 1.0)
            if accepted:
                own.setdefault(k, set()).add(label)
    none = set()
    return {
        "n_words": counts.astype(np.int64), "n_base": n_base,
        "first_word": [int(v) if n else None for v, n in zip(first_word, n_base)],
        "last_word": [int(v) if n else None for v, n in zip(last_word, n_base)],
        "base_labels": [",".join(sorted(base_labels.get(k, none))) for k in range(rows)],
        "labels": [",".join(sorted(base_labels.get(k, none) | own.get(k, none))) for k in range(rows)],
        "score": score,
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(documents: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """License labels of every whole text.

    ``score`` is 1 where a template is accepted, else the largest share of a
    template's mandatory words that stand in order from an anchor (at least
    0.5 where a base phrase stands), else 0.
    """
    markup = tuple((label, m) for label, ms in (TEMPLATES if templates is None else templates).items() for m in ms)
    base = tuple((PHRASES if phrases is None else phrases).items())
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = scan_texts(part.column("text"), markup, base)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(found[n], t) for n, t in zip(names, types))], ["doc_id", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
