"""Exact tokenization by a dictionary of words.

Both byte-pair encoders cut a text at white space before they merge, so the ids
of a text are those of its words one after the other.  Arrow splits texts and numbers their distinct
words, the tokenizers library encodes each new word once, and NumPy puts texts together.  The cut is made only where
it is certain: before a space or line feed that follows a character which no
definition of white space holds.  Everything else stays inside one piece, which
the library sees as it is.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps, about 200 bytes each, with and without spaces; beyond it only those in use stay (a bound of memory, not of work).
CACHE_WORDS = {True: 600_000, False: 300_000}
#: Two characters of white space in a row, or one at an end, by any definition.
_WHITE = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]"
_SPECIAL = "\\x00|<\\|"
_ODD = f"{_WHITE}{_WHITE}|^{_WHITE}|{_WHITE}$|{_SPECIAL}"
#: A letter and the ASCII punctuation after it (but an apostrophe, which may begin a contraction) are never in one piece.
_BREAK = r"(\pL)([!-&(-/:-@\[-`{-~])"
_CUT = re.compile(r"(?<=\S)(?=[ \n\t\r])")
#: New words that the library gets as one text.
_RUN = 500


class WordEncoder:
    """``keep_space``: the encoder joins a space to the next word (byte-level BPE); else white space is dropped and A-Z lower-cased.

    Keys of the dictionary: a word, which a space precedes; one that begins with a line feed;
    or NUL and a piece of text just as it is.
    """

    def __init__(self, path: str, keep_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.keep_space = Tokenizer.from_file(path), keep_space
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, keys: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        """New words with their ids one after the other."""
        n, k = len(ids), len(self.at)
        if self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(n, len(self.pool)), np.uint32)])
        if k + len(keys) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros(max(len(x), len(keys)), np.int64)]) for x in (self.starts, self.lens))
        self.pool[self.used : self.used + n] = ids
        self.starts[k : k + len(keys)] = self.used + np.cumsum(lens) - lens
        self.lens[k : k + len(keys)] = lens
        self.used += n
        self.at.update(zip(keys, range(k, k + len(keys)), strict=True))

    def _learn(self, new: list[str]) -> None:
        raw = [w for w in new if w[0] == "\0"]
        if raw:
            found = [e.ids for e in self.tok.encode_batch_fast([w[1:] for w in raw], add_special_tokens=False)]
            lens = np.fromiter(map(len, found), np.int64, len(found))
            self._add(raw, np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum())), lens)
        rest = [w for w in new if w[0] != "\0"]
        # Whole runs of words as one text each: offsets tell which word a token is of.
        runs = [rest[i : i + _RUN] for i in range(0, len(rest), _RUN)]
        pieces = [[w if w[0] == "\n" else " " + w for w in r] for r in runs]
        for r, p in zip(runs, pieces, strict=True):
            e = self.tok.encode("".join(p), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, p), np.int64, len(p)))
            first = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            self._add(r, np.array(e.ids, np.uint32), np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(r)))

    def locate(self, keys: list[str]) -> np.ndarray:
        """Places of keys in the dictionary."""
        if len(self.at) + len(keys) > CACHE_WORDS[self.keep_space]:
            # What this batch uses stays, and with it the words that are common.
            kept = [k for k in dict.fromkeys(keys) if k and k in self.at]
            ids, ends = self.gather(np.fromiter(map(self.at.__getitem__, kept), np.int64, len(kept)))
            self._clear()
            self._add(kept, ids, np.diff(ends, prepend=0))
        at = np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))
        if len(miss := np.flatnonzero(at < 0)):
            lost = [keys[i] for i in miss.tolist()]
            self._learn(list(dict.fromkeys(lost)))
            at[miss] = np.fromiter(map(self.at.__getitem__, lost), np.int64, len(lost))
        return at

    def pieces(self, text: str) -> list[str]:
        """Keys of the pieces of one text whose joined pieces are the text but for dropped spaces and line feeds."""
        if self.keep_space or "\0" in text:
            return ["\0" + p for p in _CUT.split(text)] if text else []
        return [w for w in text.replace("\n", " ").split(" ") if w]

    def index(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pieces, one text after the other, and how many pieces each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD if self.keep_space else _SPECIAL)
        plain = pc.if_else(odd, "", texts)
        plain = pc.replace_substring_regex(plain, _BREAK, "\\1 \0\\2" if self.keep_space else r"\1 \2")
        if self.keep_space:
            plain = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), plain, pa.scalar("", pa.large_string())), "\n", " \n")
        else:
            plain = pc.ascii_lower(pc.replace_substring(plain, "\n", " "))
        lists = pc.split_pattern(plain, " ")
        coded = lists.flatten().dictionary_encode()
        words, per = coded.dictionary.to_pylist(), pc.list_value_length(lists).to_numpy()
        # Texts with unusual white space go piece by piece, and then to their places among the others.
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        own = [self.pieces(t) for t in texts.take(pa.array(where)).to_pylist()]
        places = self.locate(words + [w for x in own for w in x])
        at, known = places[: len(words)][coded.indices.to_numpy()], places[len(words) :]
        if not len(where):
            return at, per
        ends = np.cumsum(per)
        parts, new_per, k, last = [], per.copy(), 0, 0
        for i, x in zip(where.tolist(), own, strict=True):
            parts += [at[last : ends[i] - per[i]], known[k : k + len(x)]]
            last, k = ends[i], k + len(x)
            new_per[i] = len(x)
        return np.concatenate([*parts, at[last:]]), new_per

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, one after the other, and where each one's end."""
        lens = self.lens[at]
        ends = np.cumsum(lens)
        take = np.repeat((self.starts[at] - (ends - lens)).astype(np.int32), lens)
        take += np.arange(len(take), dtype=np.int32)
        return self.pool[take], ends

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after the other, and each text's number of ids."""
        at, per = self.index(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        ids, ends = self.gather(at)
        cum = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(per)])
        return ids, cum[bounds[1:]] - cum[bounds[:-1]]


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, keep_space: bool) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    key = (path, keep_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, keep_space)
    return _ENCODERS[key]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, by the installed package that describes them."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
