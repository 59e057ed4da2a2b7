"""Evaluation texts leaking into training text.

Method: the documents come in shards; the suffixes of each shard, in words, are sorted into a suffix
array (prefix doubling over those still tied, as deep as the longest passage). Every suffix of the
held-out passages is looked up in it by binary search: its neighbours give its longest verbatim match,
and the range that shares its first SEED_WORDS words, the least that a reproduction keeps in a row,
gives all locations. Each location that can't be moved to the left is extended on its diagonal to the
longest reproduction, with single replaced words. In Chinese the units are characters and nothing may
be replaced.

The held-out items are a stated query set: they are read in blocks of about BLOCK_CHARS, whatever their
suites, and each block goes to all shards; documents are never gathered. Which runs of words are
instructions is counted over all items before, in a distributed way.

Defined results
---------------
* A null or empty document, or item, gives no row; so does an empty table. Columns are taken by name.
* A document with a passage several times gives one row an item, with its longest reproduction (of equal
  ones the first in the passage, then in the document); doc_word and item_word count its words (in
  Chinese letters) from 0.
* Instructions are runs of SHARED_RUN words that INSTRUCTION_SHARE of a suite's items hold, and three at
  least. They are no passage, unless an item would be left without one (fewer than MIN_WORDS words): a
  text that a few questions share is a passage.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

MIN_WORDS = 15
MIN_CHARACTERS = 30  # Chinese
KEPT_BETWEEN = 6  # kept words between two replaced ones
SEED_WORDS = 6  # any reproduction keeps so many in a row
SEED_CHARACTERS = 16
INSTRUCTION_SHARE = 0.1  # share of a suite's items that hold an instruction
INSTRUCTION_ITEMS = 3  # and how many at least
SHARED_RUN = 8  # words of a shared run
BLOCK_CHARS = 32_000_000
SHARD_TOKENS = 4_000_000  # tokens sorted at a time; bounds a worker's memory
PAIRS = 2_000_000  # places looked at a time; bounds a worker's memory

# Up to 200 characters of anything, or attributes of any length.
_ATTRIBUTES = r"""(?:[^<>]{0,200}|[\w:-]*(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))?)*\s*/?)"""
_TAG = re.compile(rf"</?[A-Za-z]{_ATTRIBUTES}>")
_BLOCK_TAG = re.compile(rf"</?(?:br|p|div|li|ul|ol|tr|td|h[1-6])\b{_ATTRIBUTES}>", re.I)
_NUMBERED = re.compile(r"(?m)^[ \t>]*\d{1,3}[.)](?=\s)")
_BROKEN = re.compile(r"-[ \t]*\n[>\s]*(?=\w)")
_LINK = re.compile(r"\]\([^()\s]*\)")
_STOPS = re.compile(r"[.,;:!?…\"“”„«»()\[\]{}|/\\]+")  # between words, with or without a space
_MARKS = re.compile(r"[^\w\s&]+|_+")
_HAN = re.compile(r"[㐀-鿿]")
_NOT_LETTERS = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Without references to characters, markup, numbers of lists, and in one Unicode form and case."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "](" in text:
        text = _LINK.sub("]", text)
    text = _NUMBERED.sub("", text)
    if "-\n" in text:
        text = _BROKEN.sub("", text)
    return text.casefold()


def words_of(text: str) -> list[str]:
    return _MARKS.sub("", _STOPS.sub(" ", text)).split()


def is_han(text: str) -> bool:
    return len(_HAN.findall(text)) * 4 >= len(text) > 0


def run_keys(words: list[str]) -> list[int]:
    """A key of each run of SHARED_RUN words."""
    return [xxhash.xxh3_64_intdigest(" ".join(words[k:k + SHARED_RUN])) - (1 << 63) for k in range(len(words) - SHARED_RUN + 1)]


class Passages:
    """The suffixes of the held-out passages of one block, as integers; small enough to go to every task.

    items: item, suite, text. instructions: {suite: keys of the runs that are its instructions}.
    """

    def __init__(self, items: list[tuple[int, str | None, str | None]], instructions: dict[str | None, set[int]] | None = None):
        self.vocabulary: dict[str, int] = {}
        self.alphabet: dict[str, int] = {}
        word_ids, word_items, char_ids, char_items = [], [], [], []
        for item, suite, text in items:
            if not text:
                continue
            words = words_of(folded(text))
            shared = np.zeros(len(words), dtype=bool)
            known = (instructions or {}).get(suite, ())
            for k, key in enumerate(run_keys(words)):
                if key in known:
                    shared[k:k + SHARED_RUN] = True
            passage = "".join(w for w, s in zip(words, shared) if not s)
            if len(words) - shared.sum() < MIN_WORDS and len(_NOT_LETTERS.sub("", passage)) < MIN_CHARACTERS:
                shared[:] = False  # what several questions share is the passage
                passage = "".join(words)
            if is_han(passage):
                letters = _NOT_LETTERS.sub("", passage)
                char_ids += [self.alphabet.setdefault(c, len(self.alphabet) + 1) for c in letters] + [-1]
                char_items += [item] * (len(letters) + 1)
            else:
                word_ids += [-1 if s else self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w, s in zip(words, shared)] + [-1]
                word_items += [item] * (len(words) + 1)
        self.words = _Side(word_ids, word_items, SEED_WORDS)
        self.letters = _Side(char_ids, char_items, SEED_CHARACTERS)


class _Side:
    """Passages as one array of tokens with a negative one between them, and the suffixes to look up."""

    def __init__(self, ids: list[int], items: list[int], seed: int):
        self.ids = np.array(ids, dtype=np.int64)
        self.items = np.array(items, dtype=np.int64)
        change = np.flatnonzero(np.concatenate(([True], self.items[1:] != self.items[:-1]))) if len(ids) else np.array([], dtype=np.int64)
        self.first = np.repeat(change, np.diff(np.append(change, len(ids)))) if len(ids) else self.items  # of the own item
        self.last = np.repeat(np.append(change[1:], len(ids)), np.diff(np.append(change, len(ids)))) if len(ids) else self.items
        self.seed = seed
        self.run = known_run(np.maximum(self.ids, 0))
        self.starts = np.flatnonzero(self.run >= seed)
        self.depth = int(self.run.max()) if len(ids) else 0


def known_run(ids: np.ndarray) -> np.ndarray:
    """How many known tokens (> 0) follow each other from each place on."""
    n = len(ids)
    stops = np.flatnonzero(ids == 0)
    at = np.searchsorted(stops, np.arange(n))
    return np.append(stops, n)[at] - np.arange(n)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """The places of known tokens in the order of what follows them, up to the next unknown one.

    ids: tokens, 0 for those that no passage holds. Places are told apart to ``depth`` tokens at least.
    Those still tied after h tokens are put in order by the rank of what follows h tokens later, h doubling.
    """
    n = len(ids)
    ids = ids.astype(np.int64)
    run = known_run(ids)
    order = np.flatnonzero(run > 0)
    if not len(order):
        return order
    base = int(ids.max()) + 1
    h = 3 if base < 1 << 20 else 2
    padded = np.concatenate((ids, np.zeros(h, dtype=np.int64)))
    key = padded[:n].copy()
    for k in range(1, h):
        key = key * base + np.where(run > k, padded[k:n + k], 0)
    key = key[order]
    by = np.argsort(key, kind="stable")
    order, key = order[by], key[by]
    rank = np.zeros(n + 1, dtype=np.int64)  # 0 for what is unknown or over
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(order)))
    rank[order] = np.repeat(first, size) + 1
    idx = np.arange(len(order))
    while h < depth:
        # Of the places still in question those whose group may yet be split.
        alive = (size > 1) & np.logical_or.reduceat(run[order[idx]] > h, first)
        idx = idx[np.repeat(alive, size)]
        if not len(idx):
            break
        at = order[idx]
        ahead = np.where(run[at] > h, rank[np.minimum(at + h, n)], 0)
        key = rank[at] * (n + 2) + ahead
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[idx] = at
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(idx)))
        rank[at] = np.repeat(idx[first], size) + 1
        h *= 2
    return order


def _compare(side: _Side, tests: np.ndarray, ids: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(common tokens, whether the shard's suffix is the smaller one) of test and shard suffixes, to ``width`` tokens."""
    common = np.zeros(len(tests), dtype=np.int64)
    less = np.zeros(len(tests), dtype=bool)
    todo = np.arange(len(tests))
    for k in range(width):
        t, p = tests[todo] + k, places[todo] + k
        a = np.where(t < len(side.ids), side.ids[np.minimum(t, len(side.ids) - 1)], -1)
        b = np.where(p < len(ids), ids[np.minimum(p, len(ids) - 1)], 0)
        same = (a == b) & (a > 0)
        less[todo[~same]] = (b < np.maximum(a, 0))[~same]
        todo = todo[same]
        common[todo] = k + 1
        if not len(todo):
            break
    return common, less


def _search(side: _Side, tests: np.ndarray, ids: np.ndarray, order: np.ndarray, width: int, above: bool) -> np.ndarray:
    """Where each test suffix, to ``width`` tokens, would stand in the suffix array; after its equals if ``above``."""
    low, high = np.zeros(len(tests), dtype=np.int64), np.full(len(tests), len(order), dtype=np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        common, less = _compare(side, tests[open_], ids, order[mid], width)
        right = less | (above & (common == width))
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]


def longest_matches(side: _Side, ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest verbatim match of each of side.starts, from its neighbours in the array."""
    tests = side.starts
    if not len(tests) or not len(order):
        return np.zeros(len(tests), dtype=np.int64), np.zeros(len(tests), dtype=np.int64)
    at = _search(side, tests, ids, order, side.depth, False)
    before, after = order[np.maximum(at - 1, 0)], order[np.minimum(at, len(order) - 1)]
    one, _ = _compare(side, tests, ids, before, side.depth)
    two, _ = _compare(side, tests, ids, after, side.depth)
    return np.maximum(one, two), np.where(one > two, before, after)


def place_blocks(side: _Side, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passage positions, shard positions) of all seeds that a passage shares with the shard, PAIRS at a time."""
    if not len(side.starts):
        return
    order = suffix_array(ids, side.depth)
    length, _ = longest_matches(side, ids, order)
    tests = side.starts[length >= side.seed]
    if not len(tests):
        return
    low = _search(side, tests, ids, order, side.seed, False)
    n = _search(side, tests, ids, order, side.seed, True) - low
    upto = np.cumsum(n)
    begin, total = 0, int(upto[-1])
    while begin < total:  # a test suffix with many places is cut, too
        end = min(begin + PAIRS, total)
        flat = np.arange(begin, end)
        which = np.searchsorted(upto, flat, "right")
        yield tests[which], order[low[which] + flat - (upto[which] - n[which])]
        begin = end


def places(side: _Side, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of place_blocks at once."""
    parts = list(place_blocks(side, ids))
    if not parts:
        return side.starts[:0], side.starts[:0]
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


def longest_stretch(equal: np.ndarray, kept: int | None) -> tuple[int, int]:
    """(length, begin) of the longest stretch that begins and ends with equal tokens.

    Differing tokens inside it must have ``kept`` equal ones between each other; None: no differing ones.
    """
    wrong = np.flatnonzero(~equal).tolist()
    if not wrong:
        return len(equal), 0
    close = [True] * (len(wrong) + 1)  # whether a stretch must break between wrong[k - 1] and wrong[k]
    if kept is not None:
        close = [True, *(b - a - 1 < kept for a, b in zip(wrong, wrong[1:])), True]
    best, where, begin = 0, 0, 0
    for k, at in enumerate(wrong):
        if kept is None:
            if at - begin > best:
                best, where = at - begin, begin
            begin = at + 1
        elif close[k + 1]:  # the stretch may hold this token, but not the next one
            stop = wrong[k + 1] if k + 1 < len(wrong) else len(equal)
            first, last = begin, stop
            while first < last and not equal[first]:
                first += 1
            while last > first and not equal[last - 1]:
                last -= 1
            if last - first > best:
                best, where = last - first, first
            begin = at + 1
    return (len(equal) - begin, begin) if len(equal) - begin > best else (best, where)


def longest_run(equal: np.ndarray, kept: int | None) -> int:
    return longest_stretch(equal, kept)[0]


def reproductions(side: _Side, ids: np.ndarray, ends: np.ndarray, least: int, kept: int | None) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{(document number, item): (length, -item word, -document word)}; ends: where each document ends in ids."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    ids = ids.astype(np.int64)
    for test, pos in place_blocks(side, ids):
        # A match that could begin one token earlier is seen there.
        left = (test > 0) & (pos > 0)
        left &= (side.ids[np.maximum(test - 1, 0)] == ids[np.maximum(pos - 1, 0)]) & (side.ids[np.maximum(test - 1, 0)] > 0)
        test, pos = test[~left], pos[~left]
        docs = np.searchsorted(ends, pos, "right")
        _, once = np.unique(np.stack([pos - test, side.first[test], docs]), axis=1, return_index=True)
        for k in once.tolist():
            shift, item, doc = int(pos[k] - test[k]), int(side.items[test[k]]), int(docs[k])
            begin = int(ends[doc - 1]) if doc else 0
            first, last = max(int(side.first[test[k]]), begin - shift), min(int(side.last[test[k]]), int(ends[doc]) - shift)
            own = side.ids[first:last]
            length, at = longest_stretch((own == ids[first + shift:last + shift]) & (own > 0), kept)
            row = (length, int(side.first[test[k]]) - first - at, begin - first - at - shift)
            if length >= least and row > found.get((doc, item), (0, 0, 0)):
                found[doc, item] = row
    return found


def _scan(passages: Passages, texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int, int]]:
    word, letter = passages.vocabulary.get, passages.alphabet.get
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    ids: list[int] = []
    ends: list[int] = []
    letters: list[int] = []
    letter_ends: list[int] = []
    letters_wanted = len(passages.letters.ids) > 0

    def flush(offset: int) -> None:
        for side, stream, stops, least, kept in (
            (passages.words, ids, ends, MIN_WORDS, KEPT_BETWEEN),
            (passages.letters, letters, letter_ends, MIN_CHARACTERS, None),
        ):
            hits = reproductions(side, np.array(stream, dtype=np.int32), np.array(stops, dtype=np.int64), least, kept)
            for (doc, item), row in hits.items():
                found[doc + offset, item] = max(row, found.get((doc + offset, item), (0, 0, 0)))
        for stream in (ids, ends, letters, letter_ends):
            stream.clear()

    offset = 0
    for number, text in enumerate(texts):
        if text:
            text = folded(text)
            ids.extend(map(word, words_of(text), repeat(0)))
            if letters_wanted and _HAN.search(text):
                letters.extend(map(letter, _NOT_LETTERS.sub("", text), repeat(0)))
        ids.append(0)
        letters.append(0)
        ends.append(len(ids))
        letter_ends.append(len(letters))
        if len(ids) + len(letters) >= SHARD_TOKENS:
            flush(offset)
            offset = number + 1
    flush(offset)
    return found


def instruction_runs(items: DataFrame) -> DataFrame:
    """suite, run: the keys of the runs of words that make up the instructions of each suite.

    A run is held by INSTRUCTION_SHARE of a suite's items or more, so that a suite has at most
    1 / INSTRUCTION_SHARE times as many as an item has words on average.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            suites, keys = [], []
            for suite, text in zip(batch.column("suite").to_pylist(), batch.column("text").to_pylist()):
                own = set(run_keys(words_of(folded(text))))
                suites += [suite] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(suites, type=pa.string()), pa.array(keys, type=pa.int64())], names=["suite", "run"])

    n = items.groupBy(F.col("suite").alias("own")).agg(F.count(F.lit(1)).alias("n_items"))
    counts = items.select("suite", "text").mapInArrow(runs, "suite string, run long").groupBy("suite", "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= INSTRUCTION_ITEMS)
    return counts.join(n, F.col("suite").eqNullSafe(F.col("own"))).where(F.col("n") >= F.col("n_items") * INSTRUCTION_SHARE).select("suite", "run")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, length, doc_word, item_word of the longest reproduction of each item in each document.

    documents: doc_id long, text. items: item_id long, suite, text.
    """
    spark = documents.sparkSession
    items = cut(items.where("item_id is not null and text is not null").select("item_id", "suite", "text").distinct())
    blocks = int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]) // BLOCK_CHARS + 1
    instructions: dict[str | None, set[int]] = {}
    for row in instruction_runs(items).collect():  # bounded by the words of ten items a suite
        instructions.setdefault(row["suite"], set()).add(row["run"])
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        passages = Passages([tuple(r) for r in own.collect()], instructions)
        shared = spark.sparkContext.broadcast(passages)

        def shard(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                hits = _scan(shared.value, batch.column("text").to_pylist())
                rows = [(ids[d], i, n, -at, -own) for (d, i), (n, own, at) in hits.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.int64()) for k in range(5)], names=_COLUMNS)

        part = documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(shard, ", ".join(f"{c} long" for c in _COLUMNS))
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("length", -F.col("item_word"), -F.col("doc_word")))
    found = out.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "item_id", "best.length", (-F.col("best.col3")).alias("doc_word"), (-F.col("best.col2")).alias("item_word"))


_COLUMNS = ["doc_id", "item_id", "length", "doc_word", "item_word"]


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without those that hold a passage."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
