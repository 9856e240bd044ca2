"""Substring deduplication by repeated-phrase automata.

Removes every word that a window of 20 words covers whose word sequence also starts earlier. The shared
plan (``repeats``) confirms the passages that recur and says which of them each document may hold. The
passages of a block of documents are compiled into Aho-Corasick automata of at most ``AUTOMATON_WORDS``
words of text each, each word as two characters, and the block's documents are streamed whole through all of
them to locate every occurrence; all but the first of each passage in the corpus are removed. Nothing else
is: what no automaton finds stays.

Defined cases: a null text has no words; texts shorter than the window lose nothing; very long texts are a
block of their own, with as many automata as their passages need; repeated rows are one document; rows with
the same id but other texts, or without an id, are ordered by a hash of the content (null ids last); an
empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickframe.llm import repeats

WINDOW, GRAM = 20, 6
AUTOMATON_WORDS = 500_000
#: Characters for one word, and where the code points of each of them begin. A node of an automaton looks its next
#: character up one by one, so few different ones are better than one for each word.
CHARACTERS, FIRST_CHARS = 2, (0x1000, 0x20000)


def as_characters(values: np.ndarray, first: np.ndarray) -> str:
    """``CHARACTERS`` characters for each word (other ones in each place) and as many separators after each row."""
    kinds, code = np.unique(values, return_inverse=True)
    base = int(np.ceil(np.sqrt(max(len(kinds), 1))))
    pairs = np.stack([FIRST_CHARS[0] + code // base, FIRST_CHARS[1] + code % base], axis=1).astype("<u4")
    return np.insert(pairs, first[1:], 1, axis=0).tobytes().decode("utf-32-le")


def portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive items of ``most`` together at most, or one larger."""
    total = np.cumsum(sizes)
    x = 0
    while x < len(sizes):
        y = max(int(np.searchsorted(total, (total[x - 1] if x else 0) + most, side="right")), x + 1)
        yield slice(x, y)
        x = y


def locate(block: repeats.Block, ids: np.ndarray, here: repeats.Passages) -> np.ndarray:
    """Which words of the documents ``ids`` are in an occurrence of a passage that isn't its first one."""
    edge = np.zeros(len(block.values) + 1, np.int64)
    text = as_characters(block.values, block.first)
    row_at = block.first[:-1] + np.arange(len(block.first) - 1)  # where rows begin among the characters
    lo, hi = here.lo + block.first[here.row], here.hi + block.first[here.row]
    for part in portions(hi - lo, AUTOMATON_WORDS):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, a, b in zip(range(part.start, part.stop), (lo + here.row)[part].tolist(), (hi + here.row)[part].tolist(), strict=True):
            automaton.add_word(text[CHARACTERS * a : CHARACTERS * b], k)  # of equal passages the last stays: their first occurrence is one
        automaton.make_automaton()
        hits = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
        which, size = hits[:, 1], (hi - lo)[hits[:, 1]]
        place = (hits[:, 0] + 1) // CHARACTERS - size
        row = np.searchsorted(row_at, place, side="right") - 1
        word = place - row
        later = ((ids[row] != here.doc[which]) | (word - block.first[row] != here.at[which]))
        np.add.at(edge, word[later], 1)
        np.add.at(edge, (word + size)[later], -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row."""

    def report(block: repeats.Block, gone: np.ndarray) -> list[pa.Array]:
        kept_at = np.concatenate([[0], np.cumsum(~gone)])[block.first]
        size = (block.end - block.begin)[~gone]
        raw = block.data[repeats.ragged(block.begin[~gone], size + 1)].tobytes()  # each word with its space
        at = np.concatenate([[0], np.cumsum(size + 1)])[kept_at]
        texts = [raw[x : max(x, y - 1)] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        words = np.diff(block.first)
        columns = [pa.array(words), pa.array(words - np.diff(kept_at)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
        return columns + [pa.array([t.decode() for t in texts], pa.string())] * with_text

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return repeats.without_repeats(docs, repeats.word_units, window, gram, locate, report, schema, id_col, text_col)
