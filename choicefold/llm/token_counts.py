"""Exact token counts of every prefix, by dynamic programming.

Between words: counts of words add up, so a running sum over a text's words is the exact count of each prefix that
ends with a word.  Inside a word: the count of a prefix is one more than that of the prefix before its last token,
which is the one token that ends there and is *compatible* with the last token before it
(byte-pair encodings are exactly the sequences whose neighbours are compatible).  Every prefix, by characters,
has its count, in both tables: they answer how many tokens a prefix has and where a budget ends, without encoding again.

New words come many at a time: pieces of plain ones are sorted, so what a word shares with its neighbour is counted once.
Words that the program can't treat for certain (not in composed form, odd control characters, or a sum that the
library doesn't confirm) have each of their prefixes encoded by the library: exact too, but quadratic in the word.

Null or empty text: no prefixes, count 0.  Repeated rows, and rows without an id: a row each.  Very long texts are taken whole; a batch
holds at least one text and about 2 MB.  Ties (prefixes of equal counts): the longest is the answer.  An empty table: no rows.  Other columns play no part.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import runs, slices, table_path
from .tokens import WordEncoder, encoder

#: A word: what stands between characters that are white space by any definition.
_WORD = re.compile("[^ \n\t\r\x0b\x0c\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Classes of characters stand for themselves: a letter, 0 number, ! other.
_PIECE = re.compile("a+|0|!+")
_SHORT = re.compile("'(?:s|t|re|ve|m|ll|d)")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
_WHITE = np.zeros(0x3002, bool)
_WHITE[[i for i in range(0x3002) if not _WORD.match(chr(i))]] = True
#: Letters and other characters up to U+017F that keep their number and their composed form in lower case; words of these are cut many at a time.
_LETTERS = "".join(c for c in map(chr, range(0x61, 0x180)) if unicodedata.category(c)[0] == "L" and c == c.lower())
_PLAIN = np.array([(33 <= i < 127 or unicodedata.category(chr(i))[0] in "LPS") and chr(i).lower() in {*map(chr, range(33, 127)), *_LETTERS, chr(i)} and ord(chr(i).lower()[-1]) < 0x180 for i in range(0x180)])
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|\n|[^{_LETTERS}0-9\n]+")
#: New words that are confirmed by the library at a time.
_RUN = 500
#: Words whose steps a worker keeps, about 200 bytes each (a bound of memory, not of work).
KEPT_WORDS = 500_000
#: Pairs of tokens whose fit a worker keeps.
KEPT_PAIRS = 400_000
STEPS = "doc_id long, n_bytes long, steps binary"
TABLE = "doc_id long, n_bytes long, n_tokens long, ends array<int>, counts array<int>"


def prefix_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document ``ends`` (1, 2, ... characters) and ``counts`` (tokens of that prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, inner = encoder(vocabulary, False), prefixes(vocabulary)
        for batch, texts in slices(batches, "text", 1_000_000):
            counts = [_text_counts(t, enc, inner) for t in texts]
            bounds = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
            flat = np.concatenate([np.zeros(0, np.int64), *counts])
            ends = np.concatenate([np.zeros(0, np.int64), *[np.arange(1, len(c) + 1) for c in counts]])
            off = pa.array(bounds.astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (ends, flat)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _bytes(texts), pa.array(_last(flat, bounds)), *lists], ["doc_id", "n_bytes", "n_tokens", "ends", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TABLE)


def write_counts(docs: DataFrame, vocabulary: str, path: str) -> None:
    """A Parquet table of all prefixes: per document ``steps``, by how much each character of the text changes the count (16-bit little-endian integers).

    The count of a prefix is the sum of its steps, inside words too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = steps(vocabulary)
        for batch, texts in slices(batches, "text", 2_000_000):
            # A line feed between texts keeps their words apart.
            flat = own.of("\n".join(texts)).astype("<i2")
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            starts = np.cumsum(lens + 1) - lens - 1
            data = [flat[i : i + n].tobytes() for i, n in zip(starts.tolist(), lens.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _bytes(texts), pa.array(data, pa.binary())], ["doc_id", "n_bytes", "steps"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STEPS)
    table.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def prefix_counts(docs: DataFrame, vocabulary: str, budget: int) -> DataFrame:
    """Writes the table of all prefixes and answers from it, without encoding again: the whole count, and the tokens of the longest prefix within ``budget``, inside a word too."""
    spark = docs.sparkSession
    path = table_path(spark, "prefix-counts")
    write_counts(docs, vocabulary, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "steps", 4_000_000):
            each = [np.frombuffer(x.as_buffer(), "<i2") for x in batch.column("steps")]
            n = np.fromiter((x.sum(dtype=np.int64) for x in each), np.int64, len(each))
            within = n.copy()
            # A longer prefix may have fewer tokens, so a whole text within the budget is its own longest prefix.
            for i in np.flatnonzero(n > budget).tolist():
                c = np.cumsum(each[i], dtype=np.int64)
                fits = np.flatnonzero(c <= budget)
                within[i] = c[fits[-1]] if len(fits) else 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > budget), pa.array(within)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "budget_tokens"])

    return spark.read.schema(STEPS).parquet(path).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_tokens long")


class Steps:
    """What each character adds to the count of tokens, for words seen and texts of them."""

    def __init__(self, vocabulary: str):
        self.enc, self.inner = encoder(vocabulary, False), prefixes(vocabulary)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int16), 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.piece_at: dict[str, int] = {"\n": 0}
        self.piece_steps: list[bytes] = [b""]

    def _add(self, new: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        if len(flat) and np.abs(flat).max() > np.iinfo(np.int16).max:
            raise ValueError("a character changes the count by more than 16 bits hold")
        k = len(self.at)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(flat), len(self.pool)), np.int16)])
        if k + len(new) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros(max(len(x), len(new)), np.int64)]) for x in (self.starts, self.lens))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[k : k + len(new)], self.lens[k : k + len(new)] = self.used + np.cumsum(lens) - lens, lens
        self.used += len(flat)
        self.at.update(zip(new, range(k, k + len(new)), strict=True))

    def _learn(self, new: list[str]) -> None:
        code = np.frombuffer("\n".join(new).encode("utf-32-le"), "<u4")
        wide = np.fromiter(map(len, new), np.int64, len(new))
        odd = ~_PLAIN[np.minimum(code, len(_PLAIN) - 1)] | (code >= len(_PLAIN))
        before = np.concatenate([[0], np.cumsum(odd)])
        ends = np.cumsum(wide + 1) - 1
        plain = before[ends] == before[ends - wide]
        plain &= np.fromiter(("<|" not in w for w in new), bool, len(new))
        many = [new[i] for i in np.flatnonzero(plain).tolist()]
        sure = self._many(many) if many else np.zeros(0, bool)
        rest = [new[i] for i in np.flatnonzero(~plain).tolist()] + [many[i] for i in np.flatnonzero(~sure).tolist()]
        if rest:
            found = [self.inner.counts_of(w, n) for w, n in zip(rest, _lens(rest, self.enc).tolist(), strict=True)]
            self._add(rest, np.concatenate([np.diff(c, prepend=0) for c in found]), np.fromiter(map(len, found), np.int64, len(found)))

    def _many(self, words: list[str]) -> np.ndarray:
        """Steps of words of plain characters, piece by piece; which of them the library's counts confirm (only these are learned)."""
        parts = _PIECES.findall("\n".join(words).lower())
        at = np.fromiter(map(self.piece_at.get, parts, repeat(-1)), np.int64, len(parts))
        per = np.diff(np.concatenate([[-1], np.flatnonzero(at == 0), [len(parts)]])) - 1
        if len(miss := np.flatnonzero(at < 0)):
            lost = [parts[i] for i in miss.tolist()]
            for p, x in self.inner.steps_of(list(dict.fromkeys(lost))):
                self.piece_at[p] = len(self.piece_steps)
                self.piece_steps.append(x)
            at[miss] = np.fromiter(map(self.piece_at.__getitem__, lost), np.int64, len(lost))
        flat = np.frombuffer(b"".join(map(self.piece_steps.__getitem__, at.tolist())), np.int16)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        cum = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
        ends = np.cumsum(lens)
        sure = cum[ends] - cum[ends - lens] == self.inner.counts_by_library(words, per)
        self._add([w for w, s in zip(words, sure.tolist(), strict=True) if s], flat[np.repeat(sure, lens)], lens[sure])
        return sure

    def of(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        out = np.zeros(len(code), np.int16)
        words = _WORD.findall(text)
        if not words:
            return out
        if len(self.at) > KEPT_WORDS or self.used > 16 * KEPT_WORDS:
            self._clear()
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        if len(miss := np.flatnonzero(at < 0)):
            lost = [words[i] for i in miss.tolist()]
            self._learn(list(dict.fromkeys(lost)))
            at[miss] = np.fromiter(map(self.at.__getitem__, lost), np.int64, len(lost))
        lens = self.lens[at]
        ends = np.cumsum(lens)
        # Words come in order, and so do the characters that are in words.
        out[~_WHITE[np.minimum(code, len(_WHITE) - 1)]] = self.pool[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(int(ends[-1]))]
        return out


@lru_cache
def steps(vocabulary: str) -> Steps:
    """One per worker process and vocabulary."""
    return Steps(vocabulary)


def _lens(words: list[str], enc: WordEncoder) -> np.ndarray:
    at = enc.locate(["\0" + w if "\0" in w else w for w in words])
    return enc.lens[at]


def _text_counts(text: str, enc: WordEncoder, inner: Prefixes) -> np.ndarray:
    """Tokens of text[:1], text[:2], ..."""
    found = list(_WORD.finditer(text))
    lens = _lens([m[0] for m in found], enc)
    out, total, at = np.zeros(len(text), np.int64), 0, 0
    for m, n in zip(found, lens.tolist(), strict=True):
        out[at : m.start()] = total
        out[m.start() : m.end()] = total + inner.counts(m[0], n)
        total, at = total + n, m.end()
    out[at:] = total
    return out


def tokens_before(pos: Column, ends: str = "ends", counts: str = "counts") -> Column:
    """Exact tokens of the first ``pos`` characters, from a row of :func:`prefix_table`."""
    n = F.size(F.filter(ends, lambda e: e <= pos))
    return F.when(n == 0, 0).otherwise(F.get(F.col(counts), n - 1))


def cut_at(budget: Column, ends: str = "ends", counts: str = "counts") -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens; inside a word a longer prefix may have fewer."""
    return F.coalesce(F.array_max(F.zip_with(ends, counts, lambda e, c: F.when(c <= budget, e))), F.lit(0))


def _last(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if not len(counts):
        return np.zeros(len(bounds) - 1, np.int64)
    return np.where(bounds[1:] > bounds[:-1], counts[np.maximum(bounds[1:] - 1, 0)], 0)


def _bytes(texts: list[str]) -> pa.Array:
    return pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())


class PrefixCounter:
    """Token counts of all prefixes of one word, from the merges of a word-end encoder."""

    def __init__(self, vocabulary: str):
        with open(vocabulary) as f:
            model = json.load(f)["model"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.known, self.end = model["vocab"].keys(), model["end_of_word_suffix"]
        #: Tokens by their characters: 1 inside a word, 2 at its end, 3 both, 0 the beginning of one.
        self.kind: dict[str, int] = {}
        for x in self.known:
            t, at = (x.removesuffix(self.end), 2) if x.endswith(self.end) and x != self.end else (x, 1)
            self.kind[t] = self.kind.get(t, 0) | at
            for i in range(1, len(t)):
                self.kind.setdefault(t[:i], 0)
        self._forget()
        self.split = lru_cache(None)(self._split)
        self.whole = lru_cache(1 << 16)(lambda t: self.merge(self._symbols(t)) == [t])

    def merge(self, symbols: list[str], least: int = 1) -> list[str]:
        """Greedy merging by rank, while there are more than ``least`` symbols."""
        while len(symbols) > least:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), len(self.rank)))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                hit = i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair
                out.append(symbols[i] + symbols[i + 1] if hit else symbols[i])
                i += 1 + hit
            symbols = out
        return symbols

    def _symbols(self, token: str) -> list[str]:
        last = token.endswith(self.end) and token != self.end
        body = list(token.removesuffix(self.end)) if last else list(token)
        return [*body[:-1], body[-1] + self.end] if last else body

    def _split(self, token: str) -> tuple[int, str, str]:
        """Rank and parts of the merge that makes a token in the end; -1 for a symbol."""
        parts = self._symbols(token)
        if len(parts) < 2:
            return -1, "", ""
        parts = self.merge(parts, 2)
        return self.rank[parts[0], parts[1]], parts[0], parts[1]

    def fit(self, a: str, b: str) -> bool:
        """Whether two tokens stay as they are beside each other: undoing their merges from the last, no pair across the border comes before those undone."""
        limit = len(self.rank)
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            (left, _, rest), (right, first, _) = self.split(a), self.split(b)
            if left > right:
                limit, a = left, rest
            elif right >= 0:
                limit, b = right + 1, first
            else:
                return True

    def word(self, w: str) -> list[int]:
        """For i = 1..len(w): tokens of the word that the first i symbols make. ``w`` is in the encoder's byte letters."""
        return next(self.words([w]))

    def words(self, words: list[str]) -> Iterator[list[int]]:
        """:meth:`word` of each; what a word shares with the one before it is counted once, so words should be sorted."""
        if self.judged > KEPT_PAIRS:
            self._forget()
        kind, rows = self.kind, self.rows
        # By characters: the count, what may follow the last token, and where the longest end begins that a token begins with.
        plain, row, low, out, before = [0], [rows[""]], [0], [], ""
        for w in words:
            k, most = 0, min(len(w), len(before))
            while k < most and w[k] == before[k]:
                k += 1
            del plain[k + 1 :], row[k + 1 :], low[k + 1 :], out[k:]
            for i in range(k + 1, len(w) + 1):
                inside, ends, j = True, True, low[-1]
                while (t := w[j:i]) not in kind:
                    j += 1
                low.append(j)
                while True:
                    if of := kind.get(t):
                        to = row[j]
                        if inside and of & 1:
                            fits = to[0].get(t)
                            if self._judge(to, 0, t) if fits is None else fits:
                                inside, n, last = False, plain[j] + 1, t
                                if not ends:
                                    break
                        if ends and of & 2:
                            fits = to[1].get(t)
                            if self._judge(to, 1, t) if fits is None else fits:
                                ends = False
                                out.append(plain[j] + 1)
                                if not inside:
                                    break
                    j += 1
                    t = w[j:i]
                plain.append(n)
                found = rows.get(last)
                if found is None:
                    found = rows[last] = ({}, {}, last)
                row.append(found)
            before = w
            yield out.copy()

    def _forget(self) -> None:
        #: By last token: which tokens may follow it, inside a word and at its end.
        self.rows: dict[str, tuple[dict[str, bool], dict[str, bool], str]] = {"": ({}, {}, "")}
        self.judged = 0

    def _judge(self, row: tuple[dict[str, bool], dict[str, bool], str], end: int, t: str) -> bool:
        self.judged += 1
        whole = t + self.end if end else t
        row[end][t] = out = self.whole(whole) and (not row[2] or self.fit(row[2], whole))
        return out


class Prefixes:
    """Token counts of all prefixes of words as they stand in a text."""

    def __init__(self, vocabulary: str):
        self.tok, self.counter = encoder(vocabulary, False).tok, PrefixCounter(vocabulary)
        self.piece = lru_cache(1 << 16)(self._piece)
        self.short = lru_cache(1 << 14)(self.counts_of)
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(self.counter.end)]] = True

    def counts(self, w: str, n: int) -> np.ndarray:
        """``n``: the library's count of the whole word."""
        return self.short(w, n) if len(w) <= 64 else self.counts_of(w, n)

    def counts_of(self, w: str, n: int) -> np.ndarray:
        out = self._by_program(w)
        return out if out is not None and out[-1] == n else self._by_library(w)

    def counts_by_library(self, words: list[str], per: np.ndarray) -> np.ndarray:
        """The library's count of each word, of known numbers of pieces; -1 where it doesn't cut a run of words into as many."""
        out = np.full(len(words), -1)
        starts = range(0, len(words), _RUN)
        for i, e in zip(starts, self.tok.encode_batch_fast([" ".join(words[i : i + _RUN]) for i in starts], add_special_tokens=False), strict=True):
            # A piece's last token says that it is the last.
            ends = np.flatnonzero(self.last[np.array(e.ids)]) + 1
            upto = np.cumsum(per[i : i + _RUN])
            if len(ends) == upto[-1]:
                out[i : i + _RUN] = np.diff(ends[upto - 1], prepend=0)
        return out

    def steps_of(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """By how much each character of a piece changes the count, as 16-bit integers."""
        short = [p for p in pieces if p[0] == "'" and p[1:].isalpha()]
        rest = [p for p in pieces if p[0] != "'" or not p[1:].isalpha()]
        inner = "\n".join(rest).encode().decode("latin-1").translate(_LETTERED).split("\n") if rest else []
        order = sorted(range(len(rest)), key=inner.__getitem__)
        names = [*short, *[rest[i] for i in order]]
        counts = [self._plain(p, "!" + "a" * (len(p) - 1)) for p in short]
        for p, c in zip(names[len(short) :], self.counter.words([inner[i] for i in order]), strict=True):
            counts.append(c if p.isascii() else [c[e - 1] for e in accumulate(len(x.encode()) for x in p)])
        ends = np.cumsum(np.fromiter(map(len, counts), np.int64, len(counts)))
        flat = np.fromiter(chain.from_iterable(counts), np.int64, int(ends[-1]))
        steps = np.diff(flat, prepend=0)
        steps[ends[:-1]] = flat[ends[:-1]]
        if np.abs(steps).max() > np.iinfo(np.int16).max:
            raise ValueError("a character changes the count by more than 16 bits hold")
        data, places = steps.astype(np.int16).tobytes(), (2 * ends).tolist()
        return zip(names, [data[a:b] for a, b in zip([0, *places], places, strict=False)], strict=True)

    def _by_library(self, w: str) -> np.ndarray:
        out: list[int] = []
        for i in range(0, len(w), 256):
            out += [len(e.ids) for e in self.tok.encode_batch_fast([w[: j + 1] for j in range(i, min(i + 256, len(w)))], add_special_tokens=False)]
        return np.array(out, np.int64)

    def _by_program(self, w: str) -> np.ndarray | None:
        low = "".join(c.lower() for c in w)
        if not w.isascii() and (len(low) != len(w) or not unicodedata.is_normalized("NFC", w) or not unicodedata.is_normalized("NFC", low)):
            return None
        kinds = "".join([("a" if k[0] == "L" else "0" if k[0] == "N" else "?" if k == "Cc" and c != "\0" else "!") for c in low for k in (unicodedata.category(c),)])
        if "?" in kinds:
            return None
        # A special string counts once it is complete; what comes before, and its own beginnings, is plain.
        out, base, at = [], 0, 0
        for m in _SPECIAL.finditer(w):
            plain = self._plain(low[at : m.end() - 1], kinds[at : m.end() - 1])
            out += [base + x for x in plain]
            base += (plain[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        out += [base + x for x in self._plain(low[at:], kinds[at:])]
        return np.array(out, np.int64)

    def _plain(self, low: str, kinds: str) -> list[int]:
        out: list[int] = []
        i = base = 0
        while i < len(low):
            if m := _SHORT.match(low, i):
                # Before its last letter it is an apostrophe and a letter.
                parts = [self.piece("'")[0], *[self.piece("'")[0] + self.piece(m[0][1])[0]][: len(m[0]) - 2], self.piece(m[0])[-1]]
            else:
                m = _PIECE.match(kinds, i)
                p = low[i : m.end()]
                parts = self.piece(p) if len(p) <= 64 else self._piece(p)
            out += [base + x for x in parts]
            base, i = out[-1], m.end()
        return out

    def _piece(self, p: str) -> list[int]:
        """Counts at the ends of characters of a piece that the encoder doesn't cut."""
        counts = self.counter.word("".join([_LETTER[b] for b in p.encode()]))
        return counts if p.isascii() else [counts[e - 1] for e in np.cumsum([len(c.encode()) for c in p]).tolist()]


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level encoders."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_LETTER = _byte_letters()
#: The same for texts whose bytes are read as characters; a line feed stays.
_LETTERED = {i: c for i, c in enumerate(_LETTER) if i != 10}


@lru_cache
def prefixes(vocabulary: str) -> Prefixes:
    """One per worker process and vocabulary."""
    return Prefixes(vocabulary)
