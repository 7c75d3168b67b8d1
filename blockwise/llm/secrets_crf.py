"""Secret scans (operator 4): fixed patterns, and a linear-chain CRF that adds spans.

Tokens are words. The CRF tags them O (outside), B (begin) or I (inside a secret) from
their shape, the words around them and two features of the file. It is trained here, on
labelled sequences made from a fixed seed (secrets in settings and code beside
look-alikes: numbers, mail and web addresses, unique ids, digests of contents, table cells, shouted or
marked-up prose). All features are computed on whole words, however long.

Decoding is exact Viterbi. A token is *closed* when its score for O exceeds the others by more than any change of
transitions could gain; every best path then passes it as O, so chains are decoded between
closed tokens only. Shape and surroundings of all words are arrays; only words that these leave open are looked at
one by one.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from blockwise.llm.frames import table
from blockwise.llm.textblocks import Block, Words, blocks, word_hashes, words

# The base patterns of the contract.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
MIN_ASSIGN = 12
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# Words that stand beside secrets, and openings of well-known kinds of keys.
BESIDE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "authorization", "bearer", "credential", "credentials", "private_key", "access_key", "secret_key", "client_secret", "passphrase")
# Words that stand beside ids and digests, which look like keys and are none.
NAMING = ("id", "uuid", "guid", "commit", "sha", "sha1", "sha256", "sha512", "md5", "hash", "digest", "checksum", "etag", "revision", "rev", "version", "ref", "order", "invoice", "isbn", "integrity", "object", "tree", "parent", "request_id", "trace", "trace_id", "session", "run", "build", "serial", "tracking")
OPENINGS = (b"ghp_", b"gho_", b"ghs_", b"sk-", b"sk_live_", b"pk_live_", b"rk_live_", b"xoxb-", b"xoxp-", b"glpat-", b"eyJ", b"AIza", b"ya29.", b"ssh-", b"npm_", b"hf_", b"AKIA", b"ASIA")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, each leftmost and non-overlapping.

    Runs below the length limits fail wherever one starts in them, so the limits of ``access`` and ``hex`` are in
    their patterns; a failing ``assign`` match still consumes its text, so that limit is tested after.
    """
    low = text.lower()
    out: list[tuple[int, int, str]] = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- features -----------------------------------------------------------------------------------------------

_LOWER, _UPPER, _DIGIT, _KEYCH, _MARK = (np.zeros(256, dtype=bool) for _ in range(5))
_LOWER[0x61:0x7B] = _UPPER[0x41:0x5B] = _DIGIT[0x30:0x3A] = True
_KEYCH[list(b"+/_=-")] = True
_MARK[list(b"#*$%&|<>!@()[]{}\\^~`")] = True
_TRIM = np.zeros(256, dtype=bool)
_TRIM[list(b"\"'`,;:.()[]{}<>")] = True

LENGTH_BINS = (4, 8, 12, 16, 20, 28, 40)
SHAPES = ("lower", "upper", "digit", "keych", "mark", "other", "switches>=3", "switches>=7", "upper_inside", "digits>=4", "plain")
AROUND = ("prev_beside", "prev_sign", "prev2_beside", "prev_naming", "next_same_shape", "line_start", "beside_in_file", "marked_file")
#: What the characters of a word itself say; plain words have none of these.
OWN = ("opening", "at_or_url", "own_assign", "own_naming", "unique_id", "path")
CONTEXT = AROUND + OWN
N_FEATURES = 1 + (len(LENGTH_BINS) + 1) + len(SHAPES) + len(CONTEXT)
_FIRST_CONTEXT = N_FEATURES - len(CONTEXT)
_FIRST_OWN = N_FEATURES - len(OWN)
_PLAIN = np.uint32(1 << SHAPES.index("plain"))


@functools.lru_cache(maxsize=2)
def _known(names: tuple[str, ...]) -> np.ndarray:
    block = next(blocks(pa.array([" ".join(names)])))
    return np.sort(word_hashes(block, words(block)))


def word_kinds(block: Block, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word, without quotes and signs at its ends, is one of BESIDE, and one of NAMING."""
    n = block.n_bytes
    inner = ~_EDGE[block.buf[:n]]
    at = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    start = np.minimum.accumulate(np.where(inner, at, n)[::-1])[::-1][w.start].astype(np.int64)
    end = np.maximum.accumulate(np.where(inner, at, -1))[w.end - 1].astype(np.int64) + 1
    small = np.flatnonzero((end > start) & (end - start <= max(map(len, BESIDE + NAMING))))
    h = word_hashes(block, Words(start[small], end[small], np.zeros(1, np.int64)))
    out = []
    for names in (BESIDE, NAMING):
        known = _known(names)
        flag = np.zeros(len(w.start), dtype=bool)
        flag[small] = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        out.append(flag)
    return out[0], out[1]


def shapes(block: Block, w: Words) -> np.ndarray:
    """Shape features of every word as bits, the length bin above them."""
    buf = block.buf
    size = (w.end - w.start).astype(np.int64)
    out = np.searchsorted(LENGTH_BINS, size, side="right").astype(np.uint32) << np.uint32(len(SHAPES))
    # Words of lower-case letters with at most a capital first and a stop last are the bulk: no counts for them.
    plain_byte = _LOWER | (np.arange(256) >= 0x80)
    odd = np.concatenate([[0], np.cumsum(~plain_byte[buf[: block.n_bytes]], dtype=np.int64)])
    n_odd = odd[w.end] - odd[w.start]
    last = buf[w.end - 1]
    edge = _UPPER[buf[w.start]].astype(np.int64) + ((last == 0x2E) | (last == 0x2C))
    plain = _PLAIN
    out |= np.uint32(1) | plain
    todo = np.flatnonzero((n_odd > edge) | (size == edge))
    if len(todo):
        n = size[todo]
        at = np.repeat(w.start[todo] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        b = buf[at]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        kind = np.select([_LOWER[b], _UPPER[b], _DIGIT[b], _KEYCH[b], _MARK[b]], [0, 1, 2, 3, 4], 5).astype(np.int8)
        bits = np.zeros(len(todo), dtype=np.uint32)
        for i in range(6):
            bits |= (np.add.reduceat(kind == i, first) > 0).astype(np.uint32) << np.uint32(i)
        change = np.zeros(len(kind), dtype=np.int64)
        change[1:] = (kind[1:] != kind[:-1]) & (kind[1:] < 3) & (kind[:-1] < 3)
        change[first] = 0
        switches = np.add.reduceat(change, first)
        inner = kind == 1
        inner[first] = False
        digits = np.add.reduceat((kind == 2).astype(np.int64), first)
        bits |= np.where(size[todo] <= 3, plain, np.uint32(0))
        for i, flag in enumerate((switches >= 3, switches >= 7, np.add.reduceat(inner, first) > 0, digits >= 4)):
            bits |= flag.astype(np.uint32) << np.uint32(6 + i)
        out[todo] = (out[todo] & ~np.uint32((1 << len(SHAPES)) - 1)) | bits
    return out


def shape_rows(codes: np.ndarray) -> np.ndarray:
    """0/1 features (without context) of shape codes."""
    x = np.zeros((len(codes), N_FEATURES), dtype=np.float32)
    x[:, 0] = 1
    x[np.arange(len(codes)), 1 + (codes >> np.uint32(len(SHAPES))).astype(np.int64)] = 1
    for i in range(len(SHAPES)):
        x[:, 2 + len(LENGTH_BINS) + i] = (codes >> np.uint32(i)) & np.uint32(1)
    return x


def around(block: Block, w: Words, codes: np.ndarray) -> np.ndarray:
    """The features AROUND of every word: words x features, as 0 and 1."""
    n, n_docs = len(codes), block.n_docs
    doc = np.repeat(np.arange(n_docs), np.diff(w.first))
    beside, naming = word_kinds(block, w)
    out = np.zeros((n, len(AROUND)), dtype=bool)
    first, last = block.buf[w.start], block.buf[w.end - 1]
    sign = (last == 0x3D) | (last == 0x3A) | (first == 0x3D)
    for k, flag, back in ((0, beside, 1), (1, sign, 1), (2, beside, 2), (3, naming, 1), (3, naming, 2)):
        out[back:, k] |= flag[:-back] & (doc[:-back] == doc[back:])
    out[:-1, 4] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    out[:, 5] = (w.start == 0) | (block.buf[np.maximum(w.start - 1, 0)] == 0x0A)
    marks = np.concatenate([[0], np.cumsum(_MARK[block.buf[: block.n_bytes]], dtype=np.int64)])

    def per_doc(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[w.first[1:]] - total[w.first[:-1]]

    out[:, 6] = (per_doc(beside) > 0)[doc]  # a word that stands beside secrets occurs in the file
    out[:, 7] = (per_doc(marks[w.end] > marks[w.start]) * 10 > np.diff(w.first))[doc]  # a tenth of its words hold marks
    return out


def all_features(block: Block, w: Words, codes: np.ndarray, near: np.ndarray, at: np.ndarray) -> np.ndarray:
    """All features of the words ``at``; ``near`` are those around every word."""
    x = shape_rows(codes[at])
    x[:, _FIRST_CONTEXT:_FIRST_OWN] = near[at]
    for k in np.flatnonzero(codes[at] & _PLAIN == 0).tolist():
        i = int(at[k])
        word = block.buf[w.start[i] : w.end[i]].tobytes()
        bare = word.strip(b"\"'`,;:.()[]{}<>")
        head, sign, tail = bare.replace(b":", b"=", 1).partition(b"=")
        name = head.strip(b"\"'").lower()
        last_part = re.split(rb"[_.-]", name)[-1]
        x[k, _FIRST_OWN:] = (
            bare.startswith(OPENINGS),
            b"@" in word or b"://" in word or word.startswith(b"www."),
            bool(sign) and len(tail) >= 8 and (name in _BESIDE_SET or last_part in _BESIDE_SET),
            bool(sign) and (name in _NAMING_SET or last_part in _NAMING_SET),
            UNIQUE_ID.search(bare) is not None,
            bare.startswith((b"/", b"./", b"../", b"~/")) or (bare.count(b"/") >= 2 and b"." in bare),
        )
    return x


_BESIDE_SET, _NAMING_SET = (frozenset(k.encode() for k in names) for names in (BESIDE, NAMING))
_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b"\"'`,;:.=()[]{}<>")] = True
UNIQUE_ID = re.compile(rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


# --- training -----------------------------------------------------------------------------------------------

_SYL = "an be con de er fi ga ha in jo ka lo me no or pa qu re so ti un ver wa xi yo za th st nd ble tion".split()


def training_texts(n: int = 1200, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, secret word ranges) made from a fixed seed."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    chars = lambda a, lo, hi: "".join(a[int(i)] for i in r.integers(len(a), size=int(r.integers(lo, hi + 1))))
    word = lambda: "".join(pick(_SYL) for _ in range(int(r.integers(1, 6))))

    def uid() -> str:
        return "-".join(chars(hexa, m, m) for m in (8, 4, 4, 4, 12))

    def digest() -> str:
        m = pick([7, 8, 10, 32, 40, 64])
        return chars(hexa, m, m)

    def chosen() -> str:
        """A password as people choose them: a changed word, digits and marks."""
        w = word() + word()
        return w[: int(r.integers(4, 9))].capitalize().replace("o", "0").replace("a", "4") + chars("0123456789", 1, 4) + pick("!&#$%*?@") + chars(alnum, 1, 5)

    def secret() -> str:
        return [
            lambda: chars(hexa, 32, 64), lambda: chars(alnum, 20, 48), lambda: pick(["ghp_", "sk-", "sk_live_", "hf_", "npm_", "AIza"]) + chars(alnum, 20, 40),
            lambda: "xoxb-" + chars("0123456789", 10, 12) + "-" + chars(alnum, 20, 26), lambda: "eyJ" + chars(alnum, 20, 30) + "." + "eyJ" + chars(alnum, 20, 40) + "." + chars(alnum + "_-", 20, 43),
            lambda: chars(alnum + "+/", 38, 42) + "==", lambda: chars(alnum + "_-", 24, 40), lambda: "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16),
        ][int(r.integers(8))]()

    def decoy() -> list[str]:
        return [
            lambda: [chars("0123456789", 13, 19)], lambda: [word() + "." + chars("0123456789", 1, 3) + "@" + word() + ".example.com"], lambda: ["https://" + word() + ".example.org/" + word() + "/" + chars("0123456789", 2, 6)],
            lambda: ["+1", "(" + chars("0123456789", 3, 3) + ")", chars("0123456789", 3, 3) + "-" + chars("0123456789", 4, 4)], lambda: [word().upper() + "!!" for _ in range(4)],
            lambda: [word() + pick(["###", "***", "$$$", "%%%", "&&&"]) for _ in range(4)], lambda: [x for _ in range(3) for x in (word(), "|")], lambda: [".".join(chars("0123456789", 1, 3) for _ in range(4))],
            lambda: [word() + "-" + word() + "-" + word()], lambda: [word().capitalize() + word().capitalize() + "()"], lambda: ["20" + chars("0123456789", 2, 2) + "-0" + chars("123456789", 1, 1) + "-1" + chars("0123456789", 1, 1)],
            lambda: [pick(BESIDE), word(), "="], lambda: ["".join(word() for _ in range(5))], lambda: [word() + "_" + word() + "_" + chars("0123456789", 1, 2)], lambda: [pick(BESIDE), "is", word()],
            lambda: [chars("0123456789", 4, 4) for _ in range(4)], lambda: ["".join(word() for _ in range(7)).capitalize() + "."], lambda: [pick(["token", "key"]), "=", word()],
            lambda: [pick(BESIDE) + pick([":", "="]), word() + word()], lambda: [pick(BESIDE), pick(["=", ":"]), '"' + word() + word() + '"'], lambda: ["Authorization:", "Bearer", word()],
            lambda: [word() + pick([".", ","]) for _ in range(3)], lambda: [word().capitalize() + word() + word() + "." for _ in range(2)],
            lambda: [uid()], lambda: [pick(NAMING) + pick([":", "=", ""]), uid()], lambda: [pick(NAMING) + pick([":", "=", ""]), digest()], lambda: [pick(NAMING) + pick([":", "="]) + pick([digest, uid])()],
            lambda: ["https://" + word() + ".example.org/" + word() + "/" + pick([digest, uid])() + pick(["", ".html", "?" + word() + "=" + chars(alnum, 6, 20)])], lambda: [pick(NAMING), pick([":", "="]), '"' + pick([digest, uid])() + '"'],
            lambda: ["sha" + pick(["256", "384", "512"]) + "-" + chars(alnum + "+/", 43, 86) + "="], lambda: [pick(["/", "./", "~/"]) + "/".join(word() + pick(["", "_", "-"]) + chars("0123456789", 0, 3) for _ in range(4)) + pick([".py", ".txt", ""])],
            lambda: [pick(["const", "let", "var", "def", "class"]), word() + word().capitalize() + word().capitalize() + str(int(r.integers(100)))], lambda: [word() + "." + word() + "." + word().capitalize() + word().capitalize() + "Test"], lambda: ["v" + ".".join(chars("0123456789", 1, 2) for _ in range(3)) + "-rc." + chars("0123456789", 1, 1)],
            lambda: ["10." + chars("0123456789", 4, 4) + "/" + word() + "." + chars("0123456789", 4, 8)], lambda: [":".join(chars(hexa, 1, 4) for _ in range(8))],
            lambda: ["".join(word().capitalize() for _ in range(int(r.integers(2, 6)))) + chars("0123456789", 0, 2)],
        ][int(r.integers(37))]()

    out = []
    for _ in range(n):
        toks: list[str] = []
        spans: list[tuple[int, int]] = []
        for _ in range(int(r.integers(2, 6))):
            toks += [word() for _ in range(int(r.integers(1, 5)))]
            if r.random() < 0.55:
                toks += decoy()
            else:
                s, q, form, key = secret(), pick(["", '"', "'"]), int(r.integers(5)), pick(BESIDE)
                if form < 3 and r.random() < 0.25:
                    s = chosen()
                if form == 0:
                    toks += [key, pick(["=", ":", ":="]), q + s + q]
                elif form == 1:
                    toks += [key + pick([":", "="]), q + s + q]
                elif form == 2:
                    toks += [key + pick(["=", ":"]) + q + s + q]
                elif form == 3:
                    toks += ["Authorization:", "Bearer", s]
                else:
                    toks += [s]
                spans.append((len(toks) - 1, len(toks)))
                if r.random() < 0.15 and form != 2 and len(s) > 18:  # a secret wrapped onto a second word
                    toks.append(secret())
                    spans[-1] = (spans[-1][0], len(toks))
        out.append((" ".join(toks), spans))
    return out


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    block = next(blocks(pa.array(texts), 1 << 62))
    w = words(block)
    codes = shapes(block, w)
    return all_features(block, w, codes, around(block, w, codes), np.arange(len(codes))), w.first


class Crf:
    """Weights (features x 3), transitions (3 x 3); the chain starts and ends in O."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights.astype(np.float64), transitions.astype(np.float64)
        t, gain = self.transitions, self.weights[:, 1:] - self.weights[:, :1]
        # What B or I can gain over O by transitions, whatever stands before and after.
        self.slack = np.array([(t[:, x] - t[:, 0]).max() + (t[x] - t[0]).max() for x in (1, 2)])
        # What the characters of a word can add at most; nothing for plain words.
        self.own_gain = np.clip(gain[_FIRST_OWN:], 0, None).sum(0)
        self.around_gain = gain[_FIRST_CONTEXT:_FIRST_OWN].astype(np.float32)
        self._gain: dict[int, np.ndarray] = {}

    def may_open(self, codes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """False where O wins by more than the word's own characters and transitions can change; shape and surroundings are exact."""
        some, inverse = np.unique(codes, return_inverse=True)
        for c in some.tolist():
            if c not in self._gain:
                e = shape_rows(np.array([c], dtype=np.uint32))[0, :_FIRST_CONTEXT] @ self.weights[:_FIRST_CONTEXT]
                self._gain[c] = e[1:] - e[:1] + self.slack + (0.0 if c & int(_PLAIN) else self.own_gain)
        top = np.array([self._gain[c] for c in some.tolist()]).reshape(-1, 2)[inverse]
        return (top + near.astype(np.float32) @ self.around_gain).max(1, initial=-np.inf) >= -1e-3

    def is_open(self, emit: np.ndarray) -> np.ndarray:
        return (emit[:, 1:] - emit[:, :1] + self.slack).max(1) >= 0

    def viterbi(self, emit: np.ndarray) -> np.ndarray:
        """Best tags of one chain; ties go to the lower tag."""
        t, n = self.transitions, len(emit)
        back = np.zeros((n, 3), dtype=np.int8)
        score = t[0] + emit[0]
        for i in range(1, n):
            m = score[:, None] + t
            back[i] = m.argmax(0)
            score = m.max(0) + emit[i]
        tag = int((score + t[:, 0]).argmax())
        out = np.zeros(n, dtype=np.int8)
        for i in range(n - 1, -1, -1):
            out[i] = tag
            tag = int(back[i, tag])
        return out


@functools.lru_cache(maxsize=1)
def trained() -> Crf:
    """Penalised maximum likelihood by Adam over forward-backward, from a fixed seed; some seconds, once on the driver."""
    made = training_texts()
    x, first = _rows([t for t, _ in made])
    n, longest = len(made), int(np.diff(first).max())
    wide = np.zeros((n, longest, N_FEATURES))
    gold = np.zeros((n, longest), dtype=np.int64)
    real = np.zeros((n, longest), dtype=bool)
    for d, (_, spans) in enumerate(made):
        m = first[d + 1] - first[d]
        wide[d, :m] = x[first[d] : first[d + 1]]
        real[d, :m] = True
        for a, b in spans:
            gold[d, a] = 1
            gold[d, a + 1 : b] = 2
    w, t = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    onehot = np.eye(3)[gold] * real[:, :, None]
    flat = wide.reshape(-1, N_FEATURES)
    seen = flat.T @ onehot.reshape(-1, 3)
    pair = np.zeros((3, 3))
    np.add.at(pair, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
    m1 = [np.zeros_like(w), np.zeros_like(t)]
    m2 = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, 141):
        e = (flat @ w).reshape(n, longest, 3)
        e = np.where(real[:, :, None], e, np.array([0.0, -1e4, -1e4]))
        alpha = np.zeros((n, longest, 3))
        beta = np.zeros((n, longest, 3))
        alpha[:, 0] = e[:, 0] + t[0]
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        for i in range(1, longest):
            alpha[:, i] = lse(alpha[:, i - 1, :, None] + t, 1) + e[:, i]
        for i in range(longest - 2, -1, -1):
            beta[:, i] = lse(t[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
        q = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        grads = [(seen - flat.T @ p.reshape(-1, 3)) - 0.2 * w, (pair - q.sum((0, 1))) - 2.0 * t]
        for k, (param, g) in enumerate(zip((w, t), grads, strict=True)):
            g = g / n
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            param += 0.15 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return Crf(w, t)


# --- scanning -----------------------------------------------------------------------------------------------


def crf_words(block: Block, model: Crf) -> dict[int, list[tuple[int, int]]]:
    """Per document with a tagged secret: its (first byte, end byte) spans, relative to the document."""
    w = words(block)
    if not len(w.start):
        return {}
    codes = shapes(block, w)
    near = around(block, w, codes)
    maybe = np.flatnonzero(model.may_open(codes, near))
    if not len(maybe):
        return {}
    doc = np.searchsorted(w.first, maybe, side="right") - 1
    emit = all_features(block, w, codes, near, maybe).astype(np.float64) @ model.weights
    use = model.is_open(emit)
    maybe, doc, emit = maybe[use], doc[use], emit[use]
    if not len(maybe):
        return {}
    cut = np.flatnonzero(np.concatenate([[True], (maybe[1:] != maybe[:-1] + 1) | (doc[1:] != doc[:-1])]))
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(maybe)], strict=True):
        tags = model.viterbi(emit[a:b])
        i = 0
        while i < b - a:
            if tags[i]:
                j = i + 1
                while j < b - a and tags[j] == 2:
                    j += 1
                s, e = int(w.start[maybe[a + i]]), int(w.end[maybe[a + j - 1]])
                while s < e and _TRIM[block.buf[s]]:
                    s += 1
                while e > s and _TRIM[block.buf[e - 1]]:
                    e -= 1
                if e > s:
                    base = int(block.offsets[doc[a]])
                    out.setdefault(int(doc[a]), []).append((s - base, e - base))
                i = j
            else:
                i += 1
    return out


def _suspects(block: Block) -> np.ndarray:
    """Documents that may have a base span: a long hex run, AKIA, or a keyword."""
    n = block.n_bytes
    out = np.zeros(block.n_docs, dtype=bool)
    hexa = _HEXCH[block.buf[:n]]
    edge = np.zeros(n + 1, dtype=bool)  # documents lie end to end, so a run also ends where its document does
    edge[block.offsets] = True
    edge[1:-1] |= hexa[1:] != hexa[:-1]
    cut = np.flatnonzero(edge)
    long = cut[:-1][(np.diff(cut) >= 16) & hexa[cut[:-1]]]
    data = block.buf[:n].tobytes()
    low = data.lower()
    found = [long]
    for needle, where in ((b"AKIA", data), (b"passw", low), (b"secret", low), (b"token", low), (b"api", low)):
        at, hits = where.find(needle), []
        while at >= 0:
            hits.append(at)
            at = where.find(needle, at + 1)
        found.append(np.array(hits, dtype=np.int64))
    out[np.searchsorted(block.offsets, np.concatenate(found), side="right") - 1] = True
    return out


_HEXCH = np.zeros(256, dtype=bool)
_HEXCH[list(b"0123456789abcdef")] = True


_NAME = string.ascii_letters + string.digits + "_$.-[]\"'({"
_ENDS = "\"'`,;:.()[]{}<> \t\n\v\f\r"


class BaseSpans:
    """Base spans, sorted by start, so that those which touch a range are found without a scan."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.spans = spans
        self.starts = [s for s, _, _ in spans]
        self.ends = list(itertools.accumulate((e for _, e, _ in spans), max))  # the largest end so far

    def touching(self, start: int, end: int) -> list[tuple[int, int, str]]:
        lo, hi = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        return [s for s in self.spans[lo:hi] if s[1] > start]


def uncovered(text: str, start: int, end: int, base: BaseSpans) -> list[tuple[int, int]]:
    """What a CRF span adds to the base spans: all of it, or the rests beside those it touches.

    Quotes and stops at the ends of a rest are not part of it, nor is the name before a base span
    (``client_`` of ``client_secret=...``, ``id=`` of ``id=<hex>``), nor are mere marks after a closing quote.
    """
    out: list[tuple[int, int]] = []
    at = start
    for x, y, kind in [*base.touching(start, end), (end, end, "")]:
        if x > at:
            rest = text[at:x]
            if kind == "assign":
                rest = rest.rstrip(_NAME).rstrip("&;,?|")
            elif kind and rest.rstrip("\"'").endswith(("=", ":")) and not rest.rstrip("\"'").endswith("=="):
                rest = rest.rstrip("\"'").rstrip(":=").rstrip(_NAME).rstrip("&;,?|")
            short = rest.strip(_ENDS) if at > start or x < end else rest
            closed = rest[0:1] in ("'", '"') and at > start and not any(c.isalnum() for c in short)
            if short and not closed:
                s = at + rest.index(short)
                out.append((s, s + len(short)))
        at = max(at, y)
    return out


def block_spans(block: Block, model: Crf) -> Iterator[tuple[int, str, list[tuple[int, int, str]]]]:
    """(document, text, all spans) of each document with a span; offsets are code points."""
    tagged = crf_words(block, model)
    suspects = _suspects(block)
    for d in range(block.n_docs):
        if not suspects[d] and d not in tagged:
            continue
        raw = block.buf[block.offsets[d] : block.offsets[d + 1]]
        text = raw.tobytes().decode("utf-8", "replace")
        spans = base_spans(text) if suspects[d] else []
        if d in tagged:
            base = BaseSpans(list(spans))
            # Code points that begin before a byte: its offset in the text.
            point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
            for a, b in tagged[d]:
                spans += [(x, y, "crf") for x, y in uncovered(text, int(point[a]), int(point[b]), base)]
        if spans:
            yield d, text, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, n_crf, base_sha256, spans.

    Null and empty texts have no spans (the hash is that of the empty string). Repeated rows
    are scanned one by one, an empty table gives an empty result, other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    none = hashlib.sha256(b"").hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(1)):
                n = block.n_docs
                counts = {k: [0] * n for k in KINDS}
                digest, spans = [none] * n, [""] * n
                for d, _, found in block_spans(block, shared.value):
                    for k in KINDS:
                        counts[k][d] = sum(f[2] == k for f in found)
                    digest[d] = hashlib.sha256(joined(f for f in found if f[2] != "crf").encode()).hexdigest()
                    spans[d] = joined(found)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(block.first, n), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                    names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, base_sha256 string, spans string")


def mask(docs: DataFrame, placeholder: str = "[SECRET]", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced (of an assignment only its value); ``chars_col``, if there, counts the new text.

    Null and empty texts stay as they are, repeated rows are masked one by one, an empty table gives an empty
    result; all other columns are passed through, whatever their names.
    """
    names = docs.columns
    at = names.index(text_col)
    chars = names.index(chars_col) if chars_col in names else -1
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def clean(text: str, spans: list[tuple[int, int, str]]) -> str:
        cuts: list[list[int]] = []
        for s, e, k in spans:
            if k == "assign":
                s = ASSIGN.match(text, s).start(2)
            if cuts and s <= cuts[-1][1]:
                cuts[-1][1] = max(cuts[-1][1], e)
            else:
                cuts.append([s, e])
        out, pos = [], 0
        for s, e in cuts:
            out += [text[pos:s], placeholder]
            pos = e
        return "".join([*out, text[pos:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            changed: dict[int, str] = {}
            for block in blocks(b.column(at)):
                for d, text, spans in block_spans(block, shared.value):
                    changed[block.first + d] = clean(text, spans)
            if changed:
                flag = np.zeros(b.num_rows, dtype=bool)
                flag[list(changed)] = True
                columns = list(b.columns)
                columns[at] = pa.compute.replace_with_mask(columns[at], pa.array(flag), pa.array([changed[i] for i in sorted(changed)], columns[at].type))
                if chars >= 0:
                    columns[chars] = pa.compute.replace_with_mask(columns[chars], pa.array(flag), pa.array([len(changed[i]) for i in sorted(changed)], columns[chars].type))
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
