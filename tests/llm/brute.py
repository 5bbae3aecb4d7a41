"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def library(name):
    return Tokenizer.from_file(P.path(name))


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def op2(rows):
    tok, start, out = library("byte_bpe_50k.json"), 0, {}
    for doc_id, text in sorted(rows):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    return out


def op3(rows):
    tok = library("word_bpe_49k.json")
    return {d: (len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in rows}


def op4_targets(sizes):
    """sizes: {source: words}; targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if got[s] > 3 * sizes[s]}
        if not over:
            return fixed | got
        fixed |= over


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def op5(rows, n=4, percent=85):
    sets = {d: shingles(t, n) for d, t in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    c = components(ids, links)
    return {d: (len(sets[d]), c[d]) for d in ids}


def op7(rows):
    out = {}
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = {}
        for x in win:
            many[x] = many.get(x, 0) + 1
        hit = {i + k for i, x in enumerate(win) if many[x] > 1 for k in range(5)}
        n_rep = len(hit)
        out[d] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n_rep, len(w) < 10 or 100 * n_rep > 20 * len(w))
    return out


def op9(rows):
    tok, out = library("word_bpe_49k.json"), {}
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        at, n = 0, len(ids)
        while at < n:
            size = min(2048, 1 << ((n - at).bit_length() - 1))
            out[d, at] = (size, crc(ids[at : at + size]), n)
            at += size
    return out


def luhn(s):
    x = [int(c) for c in reversed(s)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(x)) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    pats = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, p in pats.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15)
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def op10(rows):
    out = {}
    for d, t in rows:
        s = base_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        out[d] = (*[sum(k == x[0] for x in s) for k in ("email", "ip", "card", "phone")], hashlib.sha256(joined.encode()).hexdigest(), s)
    return out
