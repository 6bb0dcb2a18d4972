"""Texts of an Arrow batch as one array of code points: n-grams, marks and words counted for each account."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bits of a code point's kind.
LETTER, UPPER = 1, 2
#: Bytes of text that are handled at once, and rows that a task holds before it passes them on.
PART, HELD = 1 << 19, 1 << 20
#: Cells of the tables that number grams.
CELLS = 1 << 23


def parts(batch: pa.RecordBatch, column: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts come to about `most` bytes each; a longer text is a slice by itself."""
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(end, (end[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_rows(batch: pa.RecordBatch, column: int, rows: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """`parts`, each with its part of an array that has a value for each row."""
    start = 0
    for part in parts(batch, column):
        yield part, rows[start : start + part.num_rows]
        start += part.num_rows


def code_points(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """(the texts joined, their code points, where each begins with the total's end); nulls count as empty."""
    texts = pc.fill_null(texts, "")
    whole = "".join(texts.to_pylist())
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=at[1:])
    return whole, np.frombuffer(whole.encode("utf-32-le"), np.uint32), at


def numbered(values: list, known: dict) -> np.ndarray:
    """Each value's number, in the order of first appearance."""
    return np.fromiter((known.setdefault(v, len(known)) for v in values), np.int64, len(values))


# Kinds of characters -------------------------------------------------------------------------------


_KINDS: list = []


def kinds(spark: SparkSession) -> tuple[tuple[tuple[int, int], ...], ...]:
    """Ranges (first, last) of the letters and of the capitals that Java's expressions know, so that results are theirs."""
    if not _KINDS:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for p in (r"[^\p{L}]+", r"[^\p{Lu}]+"):
            _KINDS.append(_ranges(spark._jvm.java.util.regex.Pattern.compile(p).matcher(every).replaceAll("")))
    return tuple(_KINDS)


def _ranges(letters: str) -> tuple[tuple[int, int], ...]:
    at = np.array([ord(c) for c in letters])
    cut = np.flatnonzero(np.diff(at) > 1)
    return tuple(zip(at[np.concatenate(([0], cut + 1))].tolist(), at[np.concatenate((cut, [len(at) - 1]))].tolist()))


@lru_cache(maxsize=2)
def kind_table(ranges) -> np.ndarray:
    """The bits of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for bit, own in zip((LETTER, UPPER), ranges):
        for a, b in own:
            out[a : b + 1] |= bit
    return out


# n-grams -------------------------------------------------------------------------------------------


class _Crowded(Exception):
    """Tables would get larger than CELLS."""


class Grams:
    """Numbers of the grams in texts, by tables that tell from a gram's number and the next character the longer gram's.

    Tables grow to CELLS cells at most. Where there are more grams and characters than that, a part's grams are
    numbered by hashing; the numbers that callers get are the same.
    """

    def __init__(self, sizes, number_of: Callable[[str], int]):
        self.sizes, self.number_of, self.crowded = sizes, number_of, 0
        self.reset()

    def reset(self):
        self.char, self.n_chars, self.width = np.full(0x110000, -1, np.int32), 0, 128
        top = max(self.sizes)
        self.tables = {k: np.full((256, self.width), -1, np.int32) for k in range(2, top + 1)}
        self.count = dict.fromkeys(range(1, top + 1), 0)
        self.told = {k: np.zeros(256, np.int64) for k in range(1, top + 1)}

    def __call__(self, whole: str, points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size: (places where a gram begins, its number). A gram lies within one text."""
        left = np.repeat(at[1:], np.diff(at)) - np.arange(len(points))
        if self.crowded < 3:
            try:
                return self._by_tables(whole, points, left)
            except _Crowded:
                self.crowded += 1
                self.reset()
        return self._by_hashing(whole, points, left)

    def _by_tables(self, whole, points, left):
        out, char = [], self.char[points]
        new = np.flatnonzero(char < 0)
        if len(new):
            fresh, first = np.unique(points[new], return_index=True)
            self.char[fresh] = np.arange(self.n_chars, self.n_chars + len(fresh))
            self.n_chars += len(fresh)
            while self.width < self.n_chars:
                self._resize(width=2 * self.width)
            self._tell(1, whole, new[first])
            char = self.char[points]
        place, number = np.arange(len(points)), char
        for size in range(1, max(self.sizes) + 1):
            if size > 1:
                keep = np.flatnonzero(left[place] >= size)
                place, number = place[keep], number[keep]
                flat = self.tables[size].reshape(-1)
                cell = number.astype(np.int64) * self.width + char[place + size - 1]
                number = flat[cell]
                new = np.flatnonzero(number < 0)
                if len(new):
                    fresh, first = np.unique(cell[new], return_index=True)
                    flat[fresh] = np.arange(self.count[size], self.count[size] + len(fresh))
                    self._tell(size, whole, place[new[first]])
                    number[new] = flat[cell[new]]
            if size in self.sizes:
                out.append((place, self.told[size][number]))
        return out

    def _tell(self, size: int, whole: str, places: np.ndarray):
        """Numbers the grams at these places, which are new, and makes room for longer ones."""
        told = np.fromiter((self.number_of(whole[i : i + size]) for i in places.tolist()), np.int64, len(places)) if size in self.sizes else np.zeros(len(places), np.int64)
        count = self.count[size] + len(places)
        if count > len(self.told[size]):
            self.told[size] = np.concatenate((self.told[size], np.zeros(2 * count - len(self.told[size]), np.int64)))
        self.told[size][self.count[size] : count] = told
        self.count[size] = count
        if size + 1 in self.tables and count > len(self.tables[size + 1]):
            self._resize(size + 1, 2 * count)

    def _resize(self, only: int = 0, rows: int = 0, width: int = 0):
        width = width or self.width
        for k in [only] if only else list(self.tables):
            old = self.tables[k]
            if max(rows, len(old)) * width > CELLS:
                raise _Crowded
            self.tables[k] = np.full((max(rows, len(old)), width), -1, np.int32)
            self.tables[k][: len(old), : old.shape[1]] = old
        self.width = width

    def _by_hashing(self, whole, points, left):
        out, place, number = [], np.arange(len(points)), points.astype(np.int64)
        for size in range(1, max(self.sizes) + 1):
            keep = left[place] >= size
            place, number = place[keep], number[keep]
            if size > 1:
                number, _ = pd.factorize((number << 21) | points[place + size - 1].astype(np.int64))
            if size in self.sizes:
                first = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
                first[number[::-1]] = place[::-1]
                told = np.fromiter((self.number_of(whole[i : i + size]) for i in first.tolist()), np.int64, len(first))
                out.append((place, told[number]))
        return out


def account_gram_counts(batches, sizes, number_of: Callable[[str], int], emit: Callable[[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], forget: Callable[[], None] | None = None, space: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """Counts of (account, number of a gram) over batches of (account, text): how often it is there, and in how many texts.

    Counts are added up in the task, with HELD rows at most between parts, and passed on by emit(accounts, account
    number, gram number, n, df); an account and gram may be passed on several times. After each time, forget() is called.
    """
    accounts: dict = {}
    grams = Grams(sizes, number_of)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size_held = 0

    def merged():
        key, n, df = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[new], np.add.reduceat(n[order], new), np.add.reduceat(df[order], new)

    def out(rows):
        key, n, df = rows
        for a in range(0, len(key), 1 << 17):
            k = key[a : a + (1 << 17)]
            yield emit(list(accounts), k // space, k % space, n[a : a + (1 << 17)], df[a : a + (1 << 17)])
        accounts.clear()
        if forget:
            forget()
            grams.reset()

    for b in batches:
        for part in parts(b, 1):
            whole, points, at = code_points(part.column(1))
            owner = numbered(part.column(0).to_pylist(), accounts)
            text = np.repeat(np.arange(part.num_rows), np.diff(at))
            of = np.repeat(np.arange(part.num_rows), np.diff(at))
            found = grams(whole, points, at)
            text, number = np.concatenate([of[p] for p, _ in found]), np.concatenate([k for _, k in found])
            held.append(_counted(owner, text, number, space))
            size_held += len(held[-1][0])
            if size_held > 2 * HELD:
                rows = merged()
                held, size_held = [rows], len(rows[0])
                if size_held > HELD:
                    held, size_held = [], 0
                    yield from out(rows)
    if size_held:
        yield from out(merged())


def _counted(owner: np.ndarray, text: np.ndarray, number: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct owner * space + number, how often each is there, in how many texts), from each gram's text and number."""
    if not len(number):
        return (np.zeros(0, np.int64),) * 3
    n_texts, owners = len(owner), np.unique(owner)
    cell = np.searchsorted(owners, owner)[text] * space + number
    known = None
    if len(owners) * space * n_texts >= 1 << 63:  # a word can't hold it: distinct cells are numbered first
        cell, known = pd.factorize(cell)
    both = np.sort(cell * n_texts + text)
    new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    cell = both[new] // n_texts
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    n, df = np.diff(np.append(new[first], len(both))), np.diff(np.append(first, len(new)))
    cell = cell[first] if known is None else known[cell[first]]
    return owners[cell // space] * space + cell % space, n, df


# Marks ---------------------------------------------------------------------------------------------


def mark_counts(texts: pa.Array, owner: np.ndarray, n_owners: int, punctuation: str, kind: np.ndarray) -> dict[str, np.ndarray]:
    """For each owner: double spaces, marks p0 to p31, repeated marks, capitals, letters, elongations, emoji and length of its texts."""
    _, points, at = code_points(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    per = lambda places: np.bincount(owner[text[places]], minlength=n_owners)
    flags = kind[points]
    marks = np.zeros(128, np.int64) - 1
    marks[[ord(c) for c in punctuation]] = np.arange(len(punctuation))
    low = np.flatnonzero(points < 128)
    mark = marks[points[low]]
    low, mark = low[mark >= 0], mark[mark >= 0]
    each = np.bincount(owner[text[low]] * len(punctuation) + mark, minlength=n_owners * len(punctuation)).reshape(n_owners, -1)
    # Places whose next character is the same one in the same text; a run begins where the place before is none.
    twice = np.flatnonzero((points[1:] == points[:-1]) & (text[1:] == text[:-1]))
    begins = np.concatenate(([True], np.diff(twice) > 1)) if len(twice) else np.zeros(0, bool)
    thrice = np.concatenate((np.diff(twice) == 1, [False])) if len(twice) else begins
    same = points[twice]
    is_mark = (same < 128) & (marks[np.minimum(same, 127)] >= 0)
    high = np.flatnonzero(points >= 0x2026)
    p = points[high]
    emoji = ((p >= 0x1F300) & (p <= 0x1FAFF)) | ((p >= 0x2600) & (p <= 0x27BF)) | ((p >= 0x2300) & (p <= 0x23FF))
    return {
        "double_space": per(twice[same == 32]), **{f"p{i}": each[:, i] for i in range(len(punctuation))}, "repeated": per(twice[begins & is_mark]) + per(high[p == 0x2026]),
        "upper": per(np.flatnonzero(flags & UPPER)), "alpha": per(np.flatnonzero(flags & LETTER)), "elongated": per(twice[begins & thrice & ((kind[same] & LETTER) > 0)]), "emoji": per(high[emoji]),
        "len": np.bincount(owner, np.diff(at), n_owners).astype(np.int64),
    }


# Words ---------------------------------------------------------------------------------------------


class Words:
    """Counts listed words (casefolded, distinct) among the casefolded runs of letters."""

    def __init__(self, listed: list[str], kind: np.ndarray):
        self.kind, self.listed, self.number = kind, listed, {w: i for i, w in enumerate(listed)}
        # How letters fold: to one other, or (marked) to several or by none.
        self.fold = np.arange(0x110000, dtype=np.uint32)
        self.several = np.zeros(0x110000, bool)
        for c in np.flatnonzero(kind & LETTER).tolist():
            to = chr(c).casefold()
            self.several[c] = len(to) != 1
            self.fold[c] = ord(to[0])
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]] = {}
        for size in {len(w) for w in listed}:
            own = np.array([[ord(c) for c in w] for w in listed if len(w) == size], np.uint32)
            at = np.array([self.number[w] for w in listed if len(w) == size])
            factor = 0x9E3779B97F4A7C15
            while len(set(self._hash(own, factor).tolist())) < len(own):
                factor += 2
            h = self._hash(own, factor)
            order = np.argsort(h)
            self.lengths[size] = h[order], own[order], at[order], factor

    @staticmethod
    def _hash(rows: np.ndarray, factor: int) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(rows.shape[1]):
                out = out * np.uint64(factor) + rows[:, j].astype(np.uint64) + np.uint64(1)
        return out

    def count(self, texts: pa.Array, owner: np.ndarray, n_owners: int) -> np.ndarray:
        """(owners, 1 + words): all runs of letters, and those that are each word."""
        whole, points, at = code_points(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(at))
        letter = (self.kind[points] & LETTER) > 0
        joins = letter[1:] & letter[:-1] & (text[1:] == text[:-1]) if len(points) else letter
        start = np.flatnonzero(letter & ~np.concatenate(([False], joins))[: len(points)])
        end = np.flatnonzero(letter & ~np.concatenate((joins, [False]))[: len(points)]) + 1
        who, width = owner[text[start]], 1 + len(self.listed)
        out = np.bincount(who * width, minlength=n_owners * width)
        odd = np.zeros(len(start), bool)
        places = np.flatnonzero(self.several[points])
        if len(places):
            odd[np.searchsorted(start, places, "right") - 1] = True
            for i in np.flatnonzero(odd).tolist():
                k = self.number.get(whole[start[i] : end[i]].casefold())
                if k is not None:
                    out[who[i] * width + 1 + k] += 1
        for size, (hashes, own, number, factor) in self.lengths.items():
            at_size = np.flatnonzero((end - start == size) & ~odd)
            rows = self.fold[points[start[at_size][:, None] + np.arange(size)]]
            h = self._hash(rows, factor)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = np.flatnonzero(hashes[k] == h)
            found = found[(own[k[found]] == rows[found]).all(axis=1)]
            out += np.bincount(who[at_size[found]] * width + 1 + number[k[found]], minlength=len(out))
        return out.reshape(n_owners, width)


@lru_cache(maxsize=2)
def word_counter(listed: tuple[str, ...], ranges) -> Words:
    return Words(list(listed), kind_table(ranges))
