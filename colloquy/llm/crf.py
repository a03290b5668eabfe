"""A linear-chain conditional random field over lexical tokens.

Texts are tokenised and featurised as flat numpy arrays (a token is a run of letters and digits, a run of letters of a script without case, or a run of one other
visible character), decoded by Viterbi over all sequences of a batch at once, one position a step. Features are hashed into a table of 2**BITS rows. What a
token is in itself (shape, suffix, lexicon) is looked up once for each distinct token; what stands around it is hashed from the neighbours.

Every token of every text is decoded. A text of more than CHUNK tokens is decoded in chunks that begin at a line where there is one; features see across chunks.
"""

from __future__ import annotations

import gc
import re
import unicodedata
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BITS, CHUNK, KNOWN = 17, 512, 400_000
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
SPACE, LINE, WORD, SCRIPT, SIGN = 0, 1, 2, 3, 4
_LIMIT = 0x20000


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each code point; those past the limit are signs."""
    out = np.full(_LIMIT + 1, SIGN, np.uint8)
    for c in range(_LIMIT):
        k = unicodedata.category(chr(c))
        if c == 10:
            out[c] = LINE
        elif k in ("Zs", "Cc", "Cf", "Zl", "Zp"):
            out[c] = SPACE
        elif k in ("Lu", "Ll", "Lt", "Nd", "Mn", "Lm") or k == "Lo" and c < 0x250:
            out[c] = WORD
        elif k == "Lo":
            out[c] = SCRIPT
    return out


_SHAPES = [re.compile(p) for p in (r"[0-9]+", r"[a-z]+", r"[A-Z]+", r"[A-Z][a-z]+", r"[0-9a-f]+", r"[0-9A-Z]+", r"[0-9a-z]+", r"[A-Za-z]+", r"[0-9A-Za-z]+")]


def shape(token: str) -> int:
    n = len(token)
    if n == 1 and not token.isalnum():
        return 10 * 12 + 1
    size = n if n < 6 else 6 if n < 9 else 7 if n < 13 else 8 if n < 18 else 9 if n < 26 else 10 if n < 41 else 11
    # letters outside ASCII count by their case
    plain = token if token.isascii() else "".join(c if c.isascii() else "A" if c.isupper() else "a" if c.islower() else c for c in token)
    kind = next((i for i, p in enumerate(_SHAPES) if p.fullmatch(plain)), 9 if token[0].isalpha() else 10)
    return kind * 12 + size


@dataclass
class Tokens:
    """Flat arrays over all texts of a batch; begin and end are offsets within the text."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    gap: np.ndarray
    attr: np.ndarray  # columns: word, shape, own


class _Ids(dict):
    """Numbers the distinct tokens that a worker has seen; rows holds what is known of each."""

    def __init__(self, own: Callable[[str], int]) -> None:
        super().__init__()
        self.own, self.rows, self.fixed = own, [], np.zeros((0, 4), np.int64)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        self.rows.append((zlib.crc32(low.encode("utf-8", "surrogatepass")), shape(token), self.own(token), zlib.crc32(low[-4:].encode("utf-8", "surrogatepass")) if len(low) > 5 else 0))
        self[token] = n = len(self.fixed) + len(self.rows) - 1
        return n

    def table(self) -> np.ndarray:
        if self.rows:
            self.fixed = np.concatenate((self.fixed, np.array(self.rows, np.int64)))
            self.rows = []
        return self.fixed


class Lexer:
    """own: a small number for each token that says what a caller's lexicon or patterns know of it."""

    def __init__(self, own: Callable[[str], int]) -> None:
        self.own, self.ids = own, _Ids(own)

    def __call__(self, texts: list[str]) -> Tokens:
        collect = gc.isenabled()
        gc.disable()  # many short-lived strings and no cycles
        try:
            return self._tokens(texts)
        finally:
            if collect:
                gc.enable()

    def _tokens(self, texts: list[str]) -> Tokens:
        whole = "\n".join(texts) + "\n"
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[np.minimum(cp, _LIMIT)]
        edge = np.empty(len(cp), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge[1:] |= (kind[1:] == SIGN) & (cp[1:] != cp[:-1])
        at = np.flatnonzero(edge)
        keep = kind[at] >= WORD
        begin, end = at[keep], np.append(at[1:], len(cp))[keep]
        n = len(begin)
        if not n:
            z = np.zeros(0, np.int64)
            return Tokens(z, z, z, z, np.zeros((0, 4), np.int64))
        if len(self.ids) > KNOWN:
            self.ids = _Ids(self.own)
        ids = np.fromiter(map(self.ids.__getitem__, [whole[b:e] for b, e in zip(begin.tolist(), end.tolist())]), np.int64, n)
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[:-1]))
        text = np.searchsorted(starts, begin, "right") - 1
        before = np.concatenate(([0], end[:-1]))
        lines = np.flatnonzero(cp == 10)
        gap = np.where(begin == before, 0, np.minimum(1 + np.searchsorted(lines, begin) - np.searchsorted(lines, before), 3))
        first = np.ones(n, bool)
        first[1:] = text[1:] != text[:-1]
        gap[first] = 3
        return Tokens(text, begin - starts[text], end - starts[text], gap, self.ids.table()[ids])


def _shift(x: np.ndarray, by: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The neighbour's value, 7 beyond either end of the whole batch; text ends show as gaps of 3."""
    out = np.full_like(x, 7)
    if by > 0:
        out[by:] = x[:-by]
    elif by < 0:
        out[:by] = x[-by:]
    return out


def features(t: Tokens) -> np.ndarray:
    """(templates, tokens): the row of the weight table that each template picks."""
    n = len(t.text)
    u = lambda a: a.astype(np.uint32)
    word, shp, own, suffix, gap = (u(a) for a in (t.attr[:, 0], t.attr[:, 1], t.attr[:, 2], t.attr[:, 3], t.gap))
    first = last = None
    idx = np.arange(n)
    # the last two words (not signs) before and after, the first word of the line, and the last word before = or : on this line
    is_word = shp < 10 * 12
    last_word = np.maximum.accumulate(np.where(is_word, idx, -1)) if n else idx
    prev_word = np.concatenate(([-1], last_word[:-1])) if n else idx
    pw = np.where(prev_word >= 0, word[prev_word], np.uint32(5))
    prev2 = np.where(prev_word >= 0, prev_word[prev_word], -1) if n else idx
    pw2 = np.where(prev2 >= 0, word[prev2], np.uint32(5))
    line0 = np.maximum.accumulate(np.where(gap >= 2, idx, 0)) if n else idx
    lw = word[line0]
    assign = np.isin(t.attr[:, 0], _ASSIGN)
    last_assign = np.maximum.accumulate(np.where(assign, idx, -1)) if n else idx
    last_assign = np.concatenate(([-1], last_assign[:-1])) if n else idx
    key_at = np.where(last_assign >= line0, prev_word[np.maximum(last_assign, 0)], -1)
    key_own = np.where(key_at >= line0, own[key_at], np.uint32(99))
    # inside a -----BEGIN block: 1 of a private key, 2 of another; 3 after its END, 0 before any
    edge = np.isin(t.attr[:, 0], _BLOCK_EDGE)
    edge[1:] &= t.attr[:-1, 0] == _DASHES
    block = np.zeros(n, np.uint32)
    if edge.any():
        at = np.flatnonzero(edge)
        private = np.zeros(len(at), bool)
        for k in (1, 2, 3):
            private |= t.attr[np.minimum(at + k, n - 1), 0] == _PRIVATE
        value = np.where(t.attr[at, 0] == _BLOCK_EDGE[1], 3, np.where(private, 1, 2)).astype(np.uint32)
        latest = np.searchsorted(at, idx, "right") - 1
        ok = latest >= 0
        ok[ok] = t.text[at[latest[ok]]] == t.text[idx[ok]]
        block[ok] = value[latest[ok]]
    p1, p2, p3 = (_shift(word, k, first, last) for k in (1, 2, 3))
    n1, n2 = (_shift(word, -k, first, last) for k in (1, 2))
    s1, s2, sn1, sn2 = (_shift(shp, k, first, last) for k in (1, 2, -1, -2))
    o1, o2, on1, on2 = (_shift(own, k, first, last) for k in (1, 2, -1, -2))
    g1 = _shift(gap, -1, first, last)
    kind = shp // np.uint32(12)
    k1, kn1 = s1 // np.uint32(12), sn1 // np.uint32(12)
    cells = [
        (word,), (shp, gap), (p1, gap), (n1, g1), (p2, p1), (n1, n2), (p1, word), (word, n1),
        (s1, shp, sn1, gap, g1), (p1, kind, own), (n1, kind, own), (p2, p1, shp), (p3, p2, p1, kind), (n1, n2, kind),
        (own, o1, on1, kind), (own, o2, o1, on1, on2), (suffix, kind), (pw, shp), (pw2, pw, kind), (lw, kind, np.minimum(u(idx - line0), np.uint32(6))),
        (s2, s1, shp), (shp, sn1, sn2), (k1, kind, kn1, pw), (key_own, shp, gap), (key_own, k1, kind, kn1), (block, kind), (block, word, p1),
    ]
    out, h, part = np.empty((len(cells), n), np.int32), np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i, cell in enumerate(cells):
        h[:] = (i + 1) * 0x632BE59B & 0xFFFFFFFF
        for x, odd in zip(cell, _ODD):
            np.multiply(x, np.uint32(odd), out=part)
            h ^= part >> np.uint32(13) if len(cell) > 1 else np.uint32(0)
            h += part
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x297A2D39)
        np.right_shift(h, np.uint32(32 - BITS), out=part)
        out[i] = part
    return out


_BLOCK_EDGE, _DASHES, _PRIVATE = np.array([zlib.crc32(b"begin"), zlib.crc32(b"end")]), zlib.crc32(b"-----"), zlib.crc32(b"private")
_ASSIGN = np.array([zlib.crc32(c.encode()) for c in ("=", ":", "==", "`")])


def _chunks(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(first token, number of tokens) of each sequence."""
    n = len(t.text)
    new = np.ones(n, bool)
    new[1:] = t.text[1:] != t.text[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    if len(at) and size.max() > CHUNK:
        extra = []
        for a, k in zip(at[size > CHUNK].tolist(), size[size > CHUNK].tolist()):
            b = a
            while a + k - b > CHUNK:
                breaks = np.flatnonzero(t.gap[b + CHUNK // 2 : b + CHUNK] >= 2)
                b = b + CHUNK // 2 + int(breaks[-1]) if len(breaks) else b + CHUNK
                extra.append(b)
        at = np.unique(np.concatenate((at, extra)))
        size = np.diff(np.append(at, n))
    return at, size


class Crf:
    def __init__(self, labels: list[str], weights: np.ndarray | None = None, moves: np.ndarray | None = None) -> None:
        self.labels, k = labels, len(labels)
        self.weights = np.zeros((1 << BITS, k), np.float32) if weights is None else weights.astype(np.float32)
        self.moves = np.zeros((k, k), np.float32) if moves is None else moves.astype(np.float32)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((rows.shape[1], len(self.labels)), np.float32)
        for r in rows:
            out += np.take(self.weights, r, axis=0)
        return out

    def decode(self, t: Tokens) -> np.ndarray:
        """The label number of each token on the best path of its sequence."""
        n, k = len(t.text), len(self.labels)
        path = np.zeros(n, np.uint8)
        if not n:
            return path
        score = self.scores(features(t))
        at, size = _chunks(t)
        # No path beats all-O where every token loses more against O than its moves can gain; elsewhere the path is searched for.
        gain = 2 * max(0.0, float((self.moves - self.moves[0, 0]).max()))
        open_ = np.maximum.reduceat(score[:, 1:].max(1) - score[:, 0], at) + gain >= 0
        at, size = at[open_], size[open_]
        if not len(at):
            return path
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        live = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than each position
        back = np.zeros((n, k), np.uint8)
        best = score[at].copy()
        ends = np.empty((len(at), k), np.float32)
        for p in range(1, int(size[0])):
            m = live[p]
            ends[m : len(best)] = best[m:]
            via = best[:m, :, None] + self.moves[None]
            b = via.argmax(1)
            here = at[:m] + p
            back[here] = b
            best = np.take_along_axis(via, b[:, None, :], 1)[:, 0] + score[here]
        ends[: len(best)] = best
        now = ends.argmax(1).astype(np.uint8)
        path[at + size - 1] = now
        for p in range(int(size[0]) - 1, 0, -1):
            m = live[p]
            here = at[:m] + p
            path[here - 1] = back[here, path[here]]
        return path

    def fit(self, t: Tokens, gold: np.ndarray, epochs: int = 14, batch: int = 256, rate: float = 0.25, decay: float = 2e-6, seed: int = 7) -> "Crf":
        """Maximum likelihood by forward-backward and AdaGrad over batches of sequences."""
        rows, k = features(t), len(self.labels)
        at, size = _chunks(t)
        rng = np.random.default_rng(seed)
        seen, seen_moves = np.full_like(self.weights, 1e-3), np.full_like(self.moves, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(at))
            for lo in range(0, len(at), batch):
                pick = order[lo : lo + batch]
                pick = pick[np.argsort(-size[pick], kind="stable")]
                a, s = at[pick], size[pick]
                tok = np.concatenate([np.arange(x, x + y) for x, y in zip(a, s)])
                flat = np.concatenate(([0], np.cumsum(s)[:-1]))
                r = rows[:, tok]
                g = gold[tok]
                node, move = self._expect(self.scores(r), flat, s)
                node[np.arange(len(tok)), g] -= 1
                inner = np.ones(len(tok), bool)
                inner[flat] = False
                pos = np.flatnonzero(inner)
                np.add.at(move, (g[pos - 1], g[pos]), -1)
                touched, inv = np.unique(r.ravel(), return_inverse=True)
                grad = np.stack([np.bincount(inv, weights=np.tile(node[:, j], len(r)), minlength=len(touched)) for j in range(k)], 1)
                grad += decay * len(tok) * self.weights[touched]
                seen[touched] += grad**2
                self.weights[touched] -= rate * grad / np.sqrt(seen[touched])
                seen_moves += move**2
                self.moves -= rate * move / np.sqrt(seen_moves)
        return self

    def _expect(self, score: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected label of each token and expected moves; sequences by falling size."""
        k, top = len(self.labels), int(size[0])
        live = np.searchsorted(-size, -np.arange(top), "left")
        fwd, bwd = score.astype(np.float64), np.zeros((len(score), k))
        m64 = self.moves.astype(np.float64)

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            top_ = x.max(axis, keepdims=True)
            return (top_ + np.log(np.exp(x - top_).sum(axis, keepdims=True))).squeeze(axis)

        for p in range(1, top):
            here = at[: live[p]] + p
            fwd[here] += lse(fwd[here - 1][:, :, None] + m64[None], 1)
        for p in range(top - 1, 0, -1):
            here = at[: live[p]] + p
            bwd[here - 1] = lse((score[here] + bwd[here])[:, None, :] + m64[None], 2)
        total = lse(fwd[at + size - 1], 1)
        of = np.repeat(np.arange(len(at)), size)
        node = np.exp(fwd + bwd - total[of][:, None])
        inner = np.ones(len(score), bool)
        inner[at] = False
        pos = np.flatnonzero(inner)
        pair = fwd[pos - 1][:, :, None] + m64[None] + (score[pos] + bwd[pos])[:, None, :] - total[of[pos]][:, None, None]
        return node, np.exp(pair).sum(0)

    def save(self, path: str) -> None:
        used = np.flatnonzero(np.abs(self.weights).max(1) > 1e-3)
        np.savez_compressed(path, labels=np.array(self.labels), used=used.astype(np.int32), weights=self.weights[used].astype(np.float16), moves=self.moves)

    @classmethod
    def load(cls, path: str) -> "Crf":
        z = np.load(path)
        w = np.zeros((1 << BITS, len(z["labels"])), np.float32)
        w[z["used"]] = z["weights"]
        return cls(z["labels"].tolist(), w, z["moves"])


def spans(t: Tokens, path: np.ndarray, n: int) -> list[list[tuple[int, int, int]]]:
    """For each of n texts the (begin, end, label) of its runs of one label other than 0."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    on = path > 0
    if not on.any():
        return out
    start = on.copy()
    start[1:] &= (path[1:] != path[:-1]) | (t.text[1:] != t.text[:-1])
    stop = on.copy()
    stop[:-1] &= (path[1:] != path[:-1]) | (t.text[1:] != t.text[:-1])
    for a, b in zip(np.flatnonzero(start).tolist(), np.flatnonzero(stop).tolist()):
        out[int(t.text[a])].append((int(t.begin[a]), int(t.end[b]), int(path[a])))
    return out
