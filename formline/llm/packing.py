"""Packing of tokenised documents into windows by non-negative least squares over lengths.

Documents are dealt by a hash of ``doc_id``, text and place in the table to shards of about equal text, so a
hot source, a group of copies or rows without ids spread evenly and a shard has bounded rows. Each shard cuts full windows off long
documents and counts what is left of each by length class. All multisets of up to three classes
that fill a window are enumerated; non-negative least squares finds how often to repeat each so
that the histogram is used up; the counts are rounded down and pieces assigned. The residual pieces
are packed greedily: they fill what the rounding of lengths left free, cut where a window is full,
and the rest goes into windows in order. The last one is cut into powers of two, which need no
padding. If the residual is too short for the free room, the loosest windows join it.

Null and empty texts have the one closing id. Rows that repeat a ``doc_id`` are packed one by one;
a null ``doc_id`` is packed and returned as null. A shard's rows are taken in the order of ``doc_id`` and
text, which decides between pieces of equal length. A very long text is encoded whole, by one task. An empty table gives no pieces. Other columns are
not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 4096
#: Length classes of the histogram are this wide.
GRID = 64
#: Characters of text in a shard, about; a longer document is a shard's only excess.
SHARD_CHARS = 3_000_000
CLOSING_ID = 2
#: Words whose ids a Python worker remembers, of up to MEMO_CHARS each.
MEMO_WORDS, MEMO_CHARS = 400_000, 48

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long"


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, with a memo of words.

    The tokenizer's pattern never spans white space, so the ids of a text are those of its words in
    order, and it parts a run of letters from the marks after it. New words go to it many at a time: those
    of letters alone, but for marks at their end, once for all that differ in marks and case alone, and parted by
    the ids that close a word; others with a word between them whose one id no other word can give. Texts with separators U+001C to U+001F, on which Python and the tokenizer disagree about
    white space, go to the tokenizer whole. That all this gives the ids of the whole text is tried once on ``TRIAL``; if it does
    not, whole texts are encoded.
    """

    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    MARKS = "~^`♥★"
    ENDS = ".,;:!?"
    AT_ONCE = 400
    TRIAL = "Ab ab. é É! don't x1 12.5 naïve—so... ÀÉ, 日本 word?! ~ ^ \U0001f389 straße STRASSE; a:b"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        vocab = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closing[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.between, self.mark = next(((c, int(x[0])) for c in self.MARKS if len(x := self._ids(c)) == 1), (None, None))
        self.whole = False
        self.whole = not np.array_equal(self([self.TRIAL])[0], self._ids(self.TRIAL))
        self.memo.clear()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def _cores(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters, parted after ids that close a word."""
        out: list[bytes] = []
        for i in range(0, len(words), self.AT_ONCE):
            part = words[i : i + self.AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = ((np.flatnonzero(self.closing[ids]) + 1) * self.kind.itemsize).tolist()
            if len(ends) != len(part):  # a tokenizer whose ids do not say where words end
                out += [self._ids(w).tobytes() for w in part]
                continue
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)]
        return out

    def _marked(self, words: list[str]) -> list[bytes]:
        """Ids of words, with a mark between them."""
        out: list[bytes] = []
        for i in range(0, len(words), self.AT_ONCE):
            e = self.tokenizer.encode_batch_fast([f" {self.between} ".join(words[i : i + self.AT_ONCE])], add_special_tokens=False)[0]
            ids = np.array(e.ids, dtype=self.kind)
            raw, ends = ids.tobytes(), (np.append(np.flatnonzero(ids == self.mark), len(ids)) * self.kind.itemsize).tolist()
            size = self.kind.itemsize
            out += [raw[x:y] for x, y in zip([0, *[x + size for x in ends]], ends, strict=False)]
        return out

    def _new(self, words: list[str]) -> dict[str, bytes]:
        rest: list[str] = []
        cores: dict[str, list[str]] = {}
        marks = self.ENDS
        for w in words:
            bare = w.rstrip(marks)
            if bare.isalpha() and len(w) <= MEMO_CHARS:
                cores.setdefault(bare.lower(), []).append(w)
            else:
                rest.append(w)
        every = " ".join(cores)
        if "ς" in every or not unicodedata.is_normalized("NFC", every) or not all(map(str.isalpha, cores)) or not unicodedata.is_normalized("NFC", " ".join(words)):
            odd = [c for c, own in cores.items() if "ς" in c or not c.isalpha() or not all(unicodedata.is_normalized("NFC", x) for x in (c, *own))]
            rest += [w for c in odd for w in cores.pop(c)]
        out: dict[str, bytes] = {}
        for ids, own in zip(self._cores(list(cores)), cores.values(), strict=True):
            for w in own:
                end = w[len(w.rstrip(marks)) :]
                if not end:
                    out[w] = ids
                    continue
                if end not in self.ends:
                    self.ends[end] = self._ids(end).tobytes()
                out[w] = ids + self.ends[end]
        known = [w for w in rest if self.between and self.between not in w and len(w) <= MEMO_CHARS]
        out.update(zip(known, self._marked(known), strict=True))
        out.update((w, self._ids(w).tobytes()) for w in rest if w not in out)
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words = [None if self.whole or any(c in t for c in self.ODD) else t.split() for t in texts]
        memo = self.memo
        new = set(filterfalse(memo.__contains__, chain.from_iterable(filter(None, words))))
        if len(memo) >= MEMO_WORDS and 4 * len(new) > sum(map(len, filter(None, words))):
            memo.clear()  # other words than before are common now
            new = set().union(*filter(None, words))
        rest = self._new(list(new))
        room = max(0, MEMO_WORDS - len(memo))
        memo.update(rest)  # all of them for these texts, and only as many as there is room for afterwards
        out = [self._ids(t) if ws is None else np.frombuffer(b"".join(map(memo.__getitem__, ws)), dtype=self.kind) for t, ws in zip(texts, words, strict=True)]
        for i, w in enumerate(rest):
            if i >= room or len(w) > MEMO_CHARS:
                del memo[w]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


@lru_cache(maxsize=4)
def combinations(classes: int) -> np.ndarray:
    """Columns: how often each class 1..classes occurs in a multiset of up to 3 that sums to ``classes``."""
    found = [(a, b, classes - a - b) for a in range(classes + 1) for b in range(a, classes + 1) if classes - a - b >= b]
    out = np.zeros((classes, len(found)))
    for j, parts in enumerate(found):
        for p in parts:
            if p:
                out[p - 1, j] += 1
    return out


@lru_cache(maxsize=4)
def _problem(classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The combinations, their products, and the step that suits them: the same for every shard."""
    a = combinations(classes)
    gram = a.T @ a
    return a, gram, 1.0 / np.linalg.norm(gram, 2)


def nnls(classes: int, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |combinations x - histogram|, by projected gradient with momentum and restarts."""
    a, gram, step = _problem(classes)
    target = a.T @ histogram
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (gram @ y - target))
        if (y - new) @ (new - x) > 0:
            t = 1.0
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / nt * (new - x)
        if np.abs(new - x).max() < 1e-4:
            return new
        x, t = new, nt
    return x


def plan(lengths: np.ndarray, window: int = WINDOW, grid: int = GRID) -> pd.DataFrame:
    """Pieces (item, start, length, sequence, offset, window) of items of the given lengths."""
    lengths = np.asarray(lengths, dtype=np.int64)
    items, starts, sizes, seqs, offs = ([] for _ in range(5))

    def put(item, start, size, seq, off):
        for to, x in zip((items, starts, sizes, seqs, offs), (item, start, size, seq, off), strict=True):
            to.append(np.asarray(x, dtype=np.int64))

    # Full windows of long items.
    full = lengths // window
    item = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(full) - full, full)
    put(item, nth * window, np.full(len(item), window), np.arange(len(item)), np.zeros(len(item)))
    n_seq = len(item)
    left, at = lengths % window, full * window

    # The histogram of what is left, and repeat counts of its combinations.
    classes = window // grid
    kind = -(-left // grid)
    hist = np.bincount(kind, minlength=classes + 1)[1:]
    matrix = _problem(classes)[0]
    repeats = np.floor(nnls(classes, hist.astype(float)) + 1e-6).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=classes + 1))
    nxt = ends - np.bincount(kind, minlength=classes + 1)  # next unused item of each class, in ``order``
    groups: list[list[int]] = []
    for j in np.flatnonzero(repeats):
        parts = [c + 1 for c in np.flatnonzero(matrix[:, j]) for _ in range(int(matrix[c, j]))]
        for _ in range(repeats[j]):
            take = {p: parts.count(p) for p in parts}
            if any(nxt[p] + n > ends[p] for p, n in take.items()):
                break
            group = []
            for p in parts:
                group.append(int(order[nxt[p]]))
                nxt[p] += 1
            groups.append(group)
    rest = [int(i) for c in range(classes, 0, -1) for i in order[nxt[c] : ends[c]]]

    # The loosest windows are undone until the residual can fill all free room.
    room = [window - int(left[g].sum()) for g in groups]
    by_room = sorted(range(len(groups)), key=lambda g: room[g])
    free, have = sum(room), int(left[rest].sum())
    while by_room and have < free:
        g = by_room.pop()
        free -= room[g]
        have += window - room[g]
        rest += groups[g]
    gaps_seq, gaps_off, gaps_len = [], [], []
    for g in by_room:
        off = 0
        for i in groups[g]:
            put([i], [at[i]], [left[i]], [n_seq], [off])
            off += int(left[i])
        if off < window:
            gaps_seq.append(n_seq), gaps_off.append(off), gaps_len.append(window - off)
        n_seq += 1

    # The residual, laid end to end, against the room: cut wherever either ends.
    tail = have - free
    last = tail % window
    sizes_of = {}
    new = [window] * (tail // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if last >> b & 1]
    for size in new:
        gaps_seq.append(n_seq), gaps_off.append(0), gaps_len.append(size)
        sizes_of[n_seq] = size
        n_seq += 1
    rest_arr = np.array(rest, dtype=np.int64)
    stream = left[rest_arr] if len(rest_arr) else np.zeros(0, dtype=np.int64)
    s_end, g_end = np.cumsum(stream), np.cumsum(np.array(gaps_len, dtype=np.int64))
    cuts = np.unique(np.concatenate([s_end, g_end, [0]]).astype(np.int64))
    if len(cuts) > 1:
        lo, hi = cuts[:-1], cuts[1:]
        s, g = np.searchsorted(s_end, lo, side="right"), np.searchsorted(g_end, lo, side="right")
        s0, g0 = (s_end - stream)[s], (g_end - np.array(gaps_len))[g]
        put(rest_arr[s], at[rest_arr[s]] + lo - s0, hi - lo, np.array(gaps_seq)[g], np.array(gaps_off)[g] + lo - g0)

    cols = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (items, starts, sizes, seqs, offs)]
    out = pd.DataFrame(dict(zip(("item", "start", "length", "sequence", "offset"), cols, strict=True)))
    out["window"] = out["sequence"].map(sizes_of).fillna(window).astype("int64")
    return out


def _packer(path: str, window: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        encode = encoder(path)
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable", ignore_index=True)
        closing = np.array([CLOSING_ID], dtype=encode.kind)
        ids = [np.concatenate([x, closing]) for x in encode(list(pdf["text"]))]
        out = plan(np.array([len(x) for x in ids], dtype=np.int64), window)
        item = out["item"].to_numpy()
        crc = [zlib.crc32(ids[i][s : s + n].astype("<u4").tobytes()) for i, s, n in zip(item, out["start"], out["length"], strict=True)]
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64").to_numpy()[item] if len(item) else pd.Series(dtype="Int64"),
            "start": out["start"], "length": out["length"], "ids_crc32": np.array(crc, dtype=np.int64),
            "doc_tokens": np.array([len(x) for x in ids], dtype=np.int64)[item],
            "sequence_id": (np.int64(key[0]) << np.int64(32)) + out["sequence"], "offset": out["offset"], "window": out["window"],
        })

    return pack_shard


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Pieces of all documents; ``window`` is the padded length of the piece's sequence."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.length(text) + 64), F.count("*")).first()
    shards = max(1, -(-int(size[0] or 0) // shard_chars))
    # Text and place take part in the shard, so that rows without an id, or with one id, and repeated rows spread as well.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_packer(path, window), SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
