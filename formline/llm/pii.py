"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field labels the words of each line with begin and inside marks of five kinds. It is trained on a
small labelled table, which a rule generates by default, and decoded by Viterbi in numpy batches. A
line on which no word's best mark can outweigh "outside", whatever its transitions, is outside as a
whole and needs no search. Spans of the field are added to the base spans, but for those inside a base span
or across one of their own kind.

Null and empty texts have no spans. Rows are scanned one by one; repeated rows agree. Spans that
start together keep the order of the kinds, and marks that score alike go to the first of ``MARKS``. A very
long text is scanned whole, by one task, in time that follows its length. An empty table gives an empty
one. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table

#: Order of kinds where spans start together. The base patterns have no secrets.
KINDS = ("email", "ip", "card", "phone", "secret")
MARKS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits whose start failed, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOISE = "#*$%&|<>"


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[::-1][::2]]
    even = [int(c) * 2 for c in digits[::-1][1::2]]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = []
    # All starts in the run before an @ have the same match or none, so each @ is tried once, from the run's start.
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 or int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(out)


# Word shapes.

#: Words that speak of what follows or joins parts; they are their own shape.
CUES = frozenset((
    "token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "pw", "bearer", "authorization", "tel", "phone", "call", "fax", "mobile",
    "email", "mail", "contact", "card", "visa", "ip", "host", "server", "at", "dot",
))
# How keys of well-known services begin.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza")
#: Characters of a shape that are told one by one; a longer shape says which kinds it holds.
SHAPE = 24
_RUN = re.compile(r"9+|a+|A+")


def shape(word: str) -> str:
    bare = word.strip(_NOISE)
    low = bare.strip(".,:;!?\"'()[]").lower()
    if low in CUES:
        return f"={low}{bare[-1:] if bare[-1:] in ':=' else ''}"
    core = bare.strip(".,;!?\"'()[]")
    if len(core) >= 16 and core.startswith(PREFIXES):
        return "keyed"
    if bare.isalpha():
        return "a"
    cue, mark, rest = core.partition("=") if "=" in core else core.partition(":")
    if mark and rest and cue.lower() in CUES:
        return f"={cue.lower()}{mark}{shape(rest)}"
    if len(core) >= 16:
        letters = core.replace("_", "").replace("-", "")
        if letters.isalnum() and not letters.isalpha() and not letters.isdigit() and len(letters) >= 0.9 * len(core):
            return "code"
    kinds = _RUN.sub(lambda m: m[0][0] + (str(min(len(m[0]), 5)) if m[0][0] == "9" else ""), "".join("9" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isalpha() else c for c in bare.strip(".,;!?\"'")))
    return kinds if len(kinds) <= SHAPE else "…" + "".join(sorted(set(kinds))) + "." * min(3, kinds.count("."))


def features(name: str) -> list[str]:
    """A shape and what it has in common with others."""
    if name[:1] == "=":
        return [name, *[f"~={x}" for x in ("code", "keyed") if name.endswith((f"={x}", f":{x}"))]]
    if name in ("a", "code", "keyed"):
        return [name]
    has = lambda c: c in name
    coarse = "".join(sorted({"9" if c.isdigit() else "a" if c.isalpha() else "." if c == "." else "@" if c == "@" else "(" if c in "()" else "-" if c == "-" else "+" if c == "+" else "=" if c == "=" else "_" for c in name}))
    return [name, f"~{coarse}", f"~digit{has('9')}", f"~dots{min(name.count('.'), 4)}"]


# The labelled table.


def labelled(rows: int = 800, seed: int = 5) -> list[list[tuple[str, str]]]:
    """Lines of (word, mark), by a rule: invented words around values of each kind, and numbers that are none."""
    rng = np.random.default_rng(seed)
    syllables = "ba co di el fu gra hin jo ka lu mer né or pü qua ró sten tiñ un vès wi za the of and".split()
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
        if rng.random() < 0.15:
            w = w.capitalize()
        return w + (pick([".", ",", ":", "%%%", "***", ";"]) if rng.random() < 0.25 else "")

    def value() -> tuple[list[str], list[str], str]:
        """Words before, the words of the value, its kind."""
        kind = pick(["email", "email", "ip", "card", "phone", "phone", "phone", "secret", "secret", "secret", "", "", "", ""])
        name, host = word().strip(".,:%*;"), pick(["mail", "post", "host", word().strip(".,:%*;").lower()]) + pick(["", "", digits(1)])
        hexes = "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(24, 44))))
        if kind == "email":
            return ([pick(["email", "contact", "mail:"])] if rng.random() < 0.3 else [], pick([[pick([digits(2), name, f"{name}.{digits(2)}", f"{name}.{name}", f"{name}_{digits(1)}", f"{name}+{name}"]) + "@" + host + pick([".example.com", ".org", ".net", ".co.uk"])], [name, "at", host, "dot", pick(["com", "org", "net"])]]), kind)
        if kind == "ip":
            return ([pick(["ip", "host", "server"])] if rng.random() < 0.3 else [], [".".join(str(int(rng.integers(1, 255))) for _ in range(4))], kind)
        if kind == "card":
            return ([pick(["card", "visa"])] if rng.random() < 0.3 else [], pick([[digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))]]), kind)
        if kind == "phone":
            forms = [[f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(3), digits(4)]]
            *rest, last = pick(forms)
            return ([pick(["tel", "phone", "call"])] if rng.random() < 0.3 else [], [*rest, last + pick(["", "", "", "###", "."])], kind)
        if kind == "secret":
            cue = pick(["token", "password", "secret", "api_key", "key", "pw", "pwd", "bearer"])
            if rng.random() < 0.35:
                return pick([[], [], [f"{cue}:"], [cue]]), [pick(PREFIXES) + pick([hexes, hexes.upper()])[:36]], kind
            text = pick([hexes, hexes.upper(), pick(["sk", "pk"]) + digits(4) + hexes, hexes[:20]])
            noise = pick(["", "", "", "###", "%%", "."])
            quote = pick(["'", '"', ""])
            return pick([([cue, "="], [f'"{text}"{noise}'], kind), ([f"{cue}:"], [text + noise], kind), ([f"{cue}="], [f"'{text}'{noise}"], kind), ([cue], [text + noise], kind), ([], [f"{cue}{pick('=:')}{quote}{text}{quote}{noise}"], kind)])
        other = [digits(4), f"{digits(4)}-{digits(2)}-{digits(2)}", f"${digits(2)}.{digits(2)}", f"v{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", digits(1), digits(2), f"{digits(3)}%", f"#{digits(3)}", f"({digits(4)})", f"{digits(1)},{digits(3)}", f"{digits(4)}-{digits(4)}", pick(sorted(CUES)), f"{word()}/{word()}", f"{name}-{name}", "|", "-", "=", f"{name}'s", f'"{name}"']
        return [], [pick(other)], ""

    out = []
    for _ in range(rows):
        line: list[tuple[str, str]] = []
        for _ in range(int(rng.integers(1, 4))):
            # Values may follow one another.
            line += [(word(), "O") for _ in range(0 if rng.random() < 0.4 else int(rng.integers(1, 5)))]
            before, words, kind = value()
            line += [(w, "O") for w in before]
            line += [(w, f"{'I' if i else 'B'}-{kind}" if kind else "O") for i, w in enumerate(words)]
        out.append(line + [(word(), "O")])
    return out


# The field.

_ROLES = 3  # the word itself, the one before, the one after
_FAR = -1e4


@dataclass
class Crf:
    names: dict[str, int]  # features
    emit: np.ndarray  # role x feature x mark
    move: np.ndarray  # mark x mark
    begin: np.ndarray

    def of_shape(self, name: str | None) -> np.ndarray:
        """Role x mark scores of a shape; None stands for the end of a line."""
        ids = [self.names[f] for f in (["<end>"] if name is None else features(name)) if f in self.names]
        return self.emit[:, ids].sum(axis=1)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    k = len(MARKS)
    move, begin = np.zeros((k, k)), np.zeros(k)
    for j, b in enumerate(MARKS):
        if b[0] == "I":
            begin[j] = _FAR
            for i, a in enumerate(MARKS):
                if a[1:] != b[1:] or a == "O":
                    move[i, j] = _FAR
    return move, begin


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(lines: list[list[tuple[str, str]]], rounds: int = 45, rate: float = 0.2, ridge: float = 0.02) -> Crf:
    """Maximum likelihood by Adam; forward and backward sums run over all lines at once."""
    n, steps, k = len(lines), max(map(len, lines)), len(MARKS)
    names: dict[str, int] = {"<end>": 0}
    which, role, feat = [], [], []  # cell, role and feature of every active feature
    gold, size = np.zeros((n, steps), dtype=np.int64), np.array([len(x) for x in lines])
    for i, line in enumerate(lines):
        per = [[names.setdefault(f, len(names)) for f in features(shape(w))] for w, _ in line]
        for t, (_, mark) in enumerate(line):
            gold[i, t] = MARKS.index(mark)
            for r, at in enumerate((t, t - 1, t + 1)):
                for f in per[at] if 0 <= at < len(line) else [0]:
                    which.append(i * steps + t), role.append(r), feat.append(f)
    which, slot = np.array(which), np.array(role) * len(names) + np.array(feat)
    mask = np.arange(steps)[None, :] < size[:, None]
    move0, begin0 = _allowed()
    emit, move, begin = np.zeros((_ROLES * len(names), k)), np.zeros((k, k)), np.zeros(k)
    params = [emit, move, begin]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = np.zeros((n, steps, k))
    np.put_along_axis(target, gold[:, :, None], 1.0, axis=2)
    target *= mask[:, :, None]
    gold_move, gold_begin = np.zeros((k, k)), np.bincount(gold[:, 0], minlength=k).astype(float)
    both = mask[:, 1:]
    np.add.at(gold_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for it in range(1, rounds + 1):
        score = np.stack([np.bincount(which, emit[slot, j], n * steps) for j in range(k)], axis=1).reshape(n, steps, k)
        full = move + move0
        alpha, beta = np.zeros((n, steps, k)), np.zeros((n, steps, k))
        alpha[:, 0] = score[:, 0] + begin + begin0
        for t in range(1, steps):
            alpha[:, t] = np.where(mask[:, t, None], _logsum(alpha[:, t - 1, :, None] + full, 1) + score[:, t], alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _logsum(full + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        total = _logsum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        g_move = -gold_move
        for t in range(1, steps):
            pair = alpha[:, t - 1, :, None] + full + (score[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
            g_move = g_move + (np.exp(pair) * mask[:, t, None, None]).sum(axis=0)
        diff = (p - target).reshape(-1, k)
        g_emit = np.stack([np.bincount(slot, diff[which, j], len(emit)) for j in range(k)], axis=1)
        for i, g in enumerate((g_emit, g_move, p[:, 0].sum(axis=0) - gold_begin)):
            g = g + ridge * params[i]
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            params[i] -= rate * (m1[i] / (1 - 0.9**it)) / (np.sqrt(m2[i] / (1 - 0.99**it)) + 1e-8)
        emit, move, begin = params
    return Crf(names, emit.reshape(_ROLES, len(names), k), move + move0, begin + begin0)


class Decoder:
    """Viterbi over lines of words, with a memo of words' shapes."""

    MEMO_WORDS = 300_000
    MEMO_SHAPES = 50_000

    def __init__(self, crf: Crf):
        self.crf = crf
        allowed = crf.move[crf.move > _FAR / 2]
        start = crf.begin[crf.begin > _FAR / 2]
        self.gain = max(0.0, float(allowed.max() - crf.move[0, 0]), float((start - crf.begin[0]).max()))
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.rows = [self.crf.of_shape(None)]
        self.table = np.stack(self.rows)

    def _ids(self, lines: list[list[str]]) -> np.ndarray:
        if len(self.words) > self.MEMO_WORDS or len(self.shapes) > self.MEMO_SHAPES:
            self.clear()
        words, shapes = self.words, self.shapes
        out: list[int] = []
        for line in lines:
            out.append(0)
            for w in line:
                i = words.get(w)
                if i is None:
                    name = shape(w)
                    i = shapes.get(name)
                    if i is None:
                        i = shapes[name] = len(self.rows)
                        self.rows.append(self.crf.of_shape(name))
                    words[w] = i
                out.append(i)
        out.append(0)
        if len(self.table) < len(self.rows):
            self.table = np.stack(self.rows)
        return np.array(out, dtype=np.int64)

    def __call__(self, lines: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """(line, marks) of the lines that have any."""
        ids = self._ids(lines)  # each line is preceded by an end, and the last followed by one
        t = self.table
        scores = t[ids[1:-1], 0] + t[ids[:-2], 1] + t[ids[2:], 2]
        size = np.array([len(x) for x in lines], dtype=np.int64)
        first = np.cumsum(size + 1) - (size + 1)  # place of a line's first word in ``scores``
        over = np.append((scores[:, 1:].max(axis=1) - scores[:, 0] > -2 * self.gain) & (ids[1:-1] > 0), False)
        reach = np.cumsum(np.concatenate([[0], over]))
        open_ = np.flatnonzero(reach[np.minimum(first + size, len(over))] > reach[np.minimum(first, len(over))])
        open_ = open_[np.argsort(-size[open_], kind="stable")]
        at = 0
        while at < len(open_):
            # Lines of like length together, and no more than some cells at once.
            n = max(1, min(len(open_) - at, 60_000 // max(1, int(size[open_[at]]))))
            part = open_[at : at + n]
            at += n
            yield from self._viterbi(part, size[part], first[part], scores)

    def _viterbi(self, lines: np.ndarray, size: np.ndarray, first: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        steps, k = int(size[0]), len(MARKS)
        back = np.zeros((steps, len(lines), k), dtype=np.int8)
        best = scores[first] + self.crf.begin
        ends = best.copy()
        for s in range(1, steps):
            live = int(np.searchsorted(-size, -s, side="left"))  # lines longer than s come first
            reach = best[:live, :, None] + self.crf.move
            back[s, :live] = reach.argmax(axis=1)
            best = reach.max(axis=1) + scores[first[:live] + s]
            ends[:live] = best
        mark = ends.argmax(axis=1)
        marks = np.zeros((len(lines), steps), dtype=np.int8)
        for s in range(steps - 1, -1, -1):
            here = size > s
            marks[here, s] = mark[here]
            if s:
                mark = np.where(here, back[s, np.arange(len(lines)), mark], mark)
        for i in np.flatnonzero(marks.any(axis=1)):
            yield int(lines[i]), marks[i, : size[i]]


def plausible(kind: int, text: str) -> bool:
    """Whether a span of the field can be of its kind; numbers keep the checks of the base patterns."""
    digits = _only_digits(text)
    match KINDS[kind]:
        case "email":
            return "@" in text.strip("@") or " at " in text and " dot " in text
        case "ip":
            return len(p := text.split(".")) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in p)
        case "card":
            return 12 <= len(digits) <= 19 and luhn(digits)
        case "phone":
            return 9 <= len(digits) <= 15
    return len(text) >= 12 and (len(digits) >= 2 or text.startswith(PREFIXES))


_TRIM = _NOISE + ".,:;!?\"'[]="
_ASSIGNED = re.compile(rf"(?i)[^\w]*(?:{'|'.join(sorted(CUES, key=len, reverse=True))})[=:]")


def spans_of(words: list[str], marks: np.ndarray, line: str, offset: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) in the text, without punctuation around."""
    out: list[tuple[int, int, int]] = []
    at, open_kind, start, end = 0, -1, 0, 0
    for w, m in zip([*words, ""], [*marks.tolist(), 0], strict=True):
        lo = line.index(w, at)
        kind, inside = (m - 1) // 2 if m else -1, m > 0 and m % 2 == 0
        if open_kind >= 0 and not (inside and kind == open_kind):
            text = line[start:end]
            if KINDS[open_kind] == "secret" and (m := _ASSIGNED.match(text)):
                start += m.end()
                text = line[start:end]
            start += len(text) - len(text.lstrip(_TRIM))
            end -= len(text) - len(text.rstrip(_TRIM))
            if end > start and plausible(open_kind, line[start:end]):
                out.append((offset + start, open_kind, offset + end))
            open_kind = -1
        if kind >= 0:
            if open_kind < 0:
                open_kind, start = kind, lo
            end = lo + len(w)
        at = lo + len(w)
    return out


def scan(texts: list[str], decode: Decoder) -> Iterator[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    lines, owner = [], []
    for i, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            lines.append(line)
            owner.append((i, at))
            at += len(line) + 1
    words = [x.split() for x in lines]
    extra: dict[int, list] = {}
    for n, marks in decode(words):
        i, at = owner[n]
        extra.setdefault(i, []).extend(spans_of(words[n], marks, lines[n], at))
    for i, text in enumerate(texts):
        base = base_spans(text)
        more = [s for s in extra[i] if not any(s[0] < b[2] and b[0] < s[2] and (s[1] == b[1] or b[0] <= s[0] and s[2] <= b[2]) for b in base)] if i in extra else []
        yield base, sorted(base + more)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """Spans in every whole text: ``base_spans`` and ``spans``, as kind:start:end in code points."""
    held = docs.sparkSession.sparkContext.broadcast(crf or train(labelled()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = Decoder(held.value)
        for pdf in bounded(batches, chars=1_000_000):
            rows = [(_join(base), _join(spans)) for base, spans in scan(list(pdf["text"]), decode)]
            out = pd.DataFrame(rows, columns=["base_spans", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, base_spans string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the first counts."""
    out, at = [], 0
    for kind, start, end in (s.split(":") for s in spans.split(",") if s):
        if int(start) >= at:
            out += [text[at : int(start)], f"<{kind}>"]
            at = int(end)
    return "".join([*out, text[at:]])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter(F.split("base_spans", ","), lambda x: x.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
