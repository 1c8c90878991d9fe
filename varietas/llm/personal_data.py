"""Personal data: exact base patterns plus a character BiLSTM-CRF that adds spans.

*Base.*  Emails, IPv4 addresses, card numbers (Luhn) and phone numbers by the contract's patterns,
leftmost and non-overlapping per kind, written as linear scans that give the same matches on any text
(long runs of one character class included).

*Model.*  A character-level bidirectional LSTM with CRF transitions tags B/I per kind.  It is trained
in numpy on the driver from labelled spans: the base spans of a bounded sample (``SAMPLE`` documents
that hold a digit or an @, in hash order, texts up to ``MAX_CHARS``), some rewritten in other usual
spellings (phone without +, card with dots or double blanks, address parts with blanks around dots or
the @), and stretches around digits that are no span.  At most ``PER_TEXT`` windows and rewritten spans
of a text and ``MAX_WINDOWS`` in all are drawn by hash, windows with spans first.  Every kind's span
holds a digit or an @, so windows of ``WINDOW`` characters, overlapping by half, are decoded only around those characters, up to
the ends of the address parts beside an @; that leaves out no possible span.  A span at a window's edge
inside the text is joined with the overlapping windows' spans of its kind and left out if it stays cut;
an email always reaches to the ends of the parts beside its @.  The windows' spans are reconciled over the document by falling probability without
overlaps.  A span is added if its mean tag probability reaches ``SURE``, it touches no base span and
it passes its kind's check (digit counts, parts up to 255, Luhn), so base spans always stay as they are.

Offsets are code points, end exclusive.  A null text is empty; repeated rows are searched each; with no
sample spans there is no model and only base spans are returned.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import blocks, map_batches
from varietas.llm.crf_lstm import Tagger

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN, EDGE = 64, 32, 24, 8
SAMPLE, MAX_CHARS, MAX_WINDOWS, PER_TEXT, STEPS, SURE = 2_000, 100_000, 6_000, 32, 450, 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _addresses(text: str) -> list[Span]:
    out = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        place, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append(("ip", place, place + length))
            place += length + 1
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind and start."""
    out = _emails(text) + _addresses(text)
    for m in _DIGITS.finditer(text):
        d = digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def acceptable(kind: str, s: str) -> bool:
    """The check that a span found by the model must pass."""
    d = digits(s)
    if kind == "email":
        local, _, domain = s.replace(" ", "").partition("@")
        return bool(local) and _DOMAIN.fullmatch(domain) is not None
    if kind == "ip":
        parts = [p.strip() for p in s.split(".")]
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and set(s) <= set("0123456789 .-")
    separators = len(re.findall(r"[^0-9+]+", s))
    return 9 <= len(d) <= 15 and separators >= 2 and set(s) <= set("0123456789 ().-+")


# Symbols the tagger tells apart; other characters fall into classes.
_PLAIN = "\n @.+-()_%:/,=\"'#*|<>!?;"
SYMBOLS = len(_PLAIN) + 5


def symbol(c: str) -> int:
    at = _PLAIN.find(c)
    if at >= 0:
        return at
    k = len(_PLAIN)
    if "0" <= c <= "9":
        return k
    if "a" <= c <= "z":
        return k + 1
    if "A" <= c <= "Z":
        return k + 2
    return k + 3 if c.isalpha() else k + 4


def _address(text: str, a: int, b: int) -> tuple[int, int]:
    """Ends of the address parts beside text[a:b], blanks between skipped."""
    lo, hi = a, b
    while lo > 0 and text[lo - 1] == " ":
        lo -= 1
    while lo > 0 and text[lo - 1] in _LOCAL:
        lo -= 1
    while hi < len(text) and text[hi] == " ":
        hi += 1
    m = _DOMAIN.match(text, hi)
    return lo, m.end() if m else b


def windows(text: str) -> list[tuple[int, int, bool, bool]]:
    """(start, end, whether the start and the end are cuts inside the text) of the windows around digits and @."""
    regions: list[list[int]] = []
    for m in re.finditer(r"[0-9@]+", text):
        a, b = m.span()
        lo, hi = a - MARGIN, b + MARGIN
        if "@" in m.group():
            first, last = text.find("@", a), text.rfind("@", a, b)
            lo, hi = min(lo, _address(text, first, first + 1)[0] - EDGE), max(hi, _address(text, last, last + 1)[1] + EDGE)
        lo, hi = max(0, lo), min(len(text), hi)
        while regions and lo <= regions[-1][1]:
            before = regions.pop()
            lo, hi = min(lo, before[0]), max(hi, before[1])
        regions.append([lo, hi])
    out = []
    for lo, hi in regions:
        at = lo
        while True:
            end = min(at + WINDOW, hi)
            out.append((at, end, at > 0, end < len(text)))
            if end == hi:
                break
            at += STRIDE
    return out


def _symbols(texts: list[str]) -> np.ndarray:
    x = np.full((len(texts), WINDOW), -1, np.int64)
    for i, t in enumerate(texts):
        x[i, :len(t)] = [symbol(c) for c in t]
    return x


def _tags(length: int, spans: list[Span], lo: int) -> np.ndarray:
    y = np.zeros(WINDOW, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        a, b = a - lo, b - lo
        for i in range(max(a, 0), min(b, length)):
            y[i] = 1 + 2 * k + (i != a)
    return y


def _rewrite(kind: str, s: str, rng: np.random.Generator) -> str:
    """Another usual spelling of a span."""
    n = int(rng.integers(3))
    if kind == "email":
        return s.replace("@", (" @ ", " @", "@ ")[n])
    if kind == "ip":
        return s.replace(".", (" . ", ". ", " .")[n])
    if kind == "card":
        d = digits(s)
        return (". ", ".", "  ")[n].strip(" " if n == 0 else "").join(d[i:i + 4] for i in range(0, len(d), 4))
    d = digits(s)[-10:]
    return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}")[n] if len(d) == 10 else s


def training_windows(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and tag rows: windows of the texts, and of texts with some spans rewritten."""
    rng = np.random.default_rng(seed)
    drawn: list[tuple[bool, int, str, np.ndarray]] = []

    def add(text: str, spans: list[Span]) -> None:
        inside = np.zeros(len(text) + 1, np.int64)
        for _, a, b in spans:
            inside[a + 1:b + 1] = 1
        upto = np.cumsum(inside)
        some = [(bool(upto[hi] == upto[lo]), zlib.crc32(text[lo:hi].encode("utf-8", "replace")), lo, hi) for lo, hi, *_ in windows(text)]
        for none, h, lo, hi in sorted(some)[:PER_TEXT]:
            near = [s for s in spans if s[1] < hi and s[2] > lo]
            drawn.append((none, h, text[lo:hi], _tags(hi - lo, near, lo)))

    for text in texts:
        spans = sorted(base_spans(text), key=lambda s: s[1])
        add(text, spans)
        for kind, a, b in sorted(spans, key=lambda s: zlib.crc32(text[s[1]:s[2]].encode("utf-8", "replace")))[:PER_TEXT]:
            before, after = text[max(0, a - 40):a], text[b:b + 40]
            if re.search(r"[0-9@]", before + after):
                continue
            new = _rewrite(kind, text[a:b], rng)
            add(before + new + after, [(kind, len(before), len(before) + len(new))])
    drawn.sort(key=lambda w: w[:3])
    n_some = sum(not w[0] for w in drawn)
    # windows with spans first; they leave room for as many others
    kept = min(n_some, max(MAX_WINDOWS // 2, MAX_WINDOWS - (len(drawn) - n_some)))
    drawn = drawn[:kept] + drawn[n_some:n_some + MAX_WINDOWS - kept]
    return _symbols([w[2] for w in drawn]), np.array([w[3] for w in drawn], np.int64).reshape(len(drawn), WINDOW)


def train(texts: list[str], steps: int = STEPS) -> Tagger | None:
    x, y = training_windows(texts)
    if not (y > 0).any():
        return None
    # the rarer windows with spans make up half of what is drawn
    rng = np.random.default_rng(9)
    some, none = np.flatnonzero((y > 0).any(axis=1)), np.flatnonzero(~(y > 0).any(axis=1))
    rows = np.concatenate((some, rng.choice(none, min(len(none), len(some)), replace=False) if len(none) else none))
    model = Tagger(SYMBOLS, 1 + 2 * len(KINDS))
    model.fit(x[rows], y[rows], steps)
    return model


def _tagged(tags: np.ndarray, prob: np.ndarray, length: int) -> list[tuple[str, int, int, float]]:
    out, i = [], 0
    while i < length:
        t = int(tags[i])
        if t and (t % 2 == 1 or i == 0):           # at a window's start a span can go on
            t -= t % 2 == 0
            j = i + 1
            while j < length and tags[j] == t + 1:
                j += 1
            out.append((KINDS[(t - 1) // 2], i, j, float(prob[i:j].mean())))
            i = j
        else:
            i += 1
    return out


Piece = tuple[str, int, int, float, bool, bool]


def _joined_pieces(pieces: list[Piece]) -> list[Piece]:
    """Pieces (kind, start, end, probability, cut at the start, at the end) with cut ones joined to overlapping ones of their kind."""
    out: list[Piece] = []
    for kind, s, e, sure, cut_left, cut_right in sorted(pieces):
        if out and out[-1][0] == kind and s < out[-1][2] and (out[-1][5] or cut_left):
            _, s0, e0, sure0, left0, right0 = out.pop()
            if e <= e0 and not (left0 or right0):
                sure = sure0                       # the one before has it whole
            elif s > s0 or cut_left or cut_right:
                sure = (sure0 * (e0 - s0) + sure * (e - s)) / (e0 - s0 + e - s)
            cut_left = left0 and (s > s0 or cut_left)
            cut_right = right0 and cut_right if e == e0 else cut_right if e > e0 else right0
            s, e = s0, max(e, e0)
        out.append((kind, s, e, sure, cut_left, cut_right))
    return out


def added_spans(texts: list[str], base: list[list[Span]], model: Tagger, batch: int = 512) -> list[list[Span]]:
    """Per text the spans that the model adds to the base spans."""
    where = [(n, *w) for n, t in enumerate(texts) for w in windows(t)]
    pieces: list[list[Piece]] = [[] for _ in texts]
    for lo in range(0, len(where), batch):
        part = where[lo:lo + batch]
        tags, prob = model.decode(_symbols([texts[n][a:b] for n, a, b, _, _ in part]))
        for (n, a, b, cut_left, cut_right), t, p in zip(part, tags, prob, strict=True):
            for kind, i, j, sure in _tagged(t, p, b - a):
                pieces[n].append((kind, a + i, a + j, sure, i == 0 and cut_left, j == b - a and cut_right))
    found: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    for n, text in enumerate(texts):
        for kind, s, e, sure, cut_left, cut_right in _joined_pieces(pieces[n]):
            at = text.find("@", s, e) if kind == "email" else -1
            if at >= 0:
                s, e = _address(text, at, at + 1)  # whole parts, also of an address longer than a window
            elif cut_left or cut_right:
                continue
            found[n].append((sure, kind, s, e))
    out = []
    for n, text in enumerate(texts):
        taken, new = [(s, e) for _, s, e in base[n]], []
        for sure, kind, s, e in sorted(found[n], key=lambda f: (-f[0], f[2], f[1], f[3])):
            if sure >= SURE and all(e <= a or s >= b for a, b in taken) and acceptable(kind, text[s:e]):
                taken.append((s, e))
                new.append((kind, s, e))
        out.append(new)
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find_spans(texts: list[str], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) per text."""
    base = [base_spans(t) for t in texts]
    new = added_spans(texts, base, model) if model else [[] for _ in texts]
    return [(b, b + n) for b, n in zip(base, new, strict=True)]


_ANCHOR = np.zeros(256, bool)
_ANCHOR[[*range(48, 58), 64]] = True


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    text = F.col("text")
    sample = (docs.where(text.rlike("[0-9@]") & (F.length(text) <= MAX_CHARS)).select("doc_id", F.xxhash64("doc_id").alias("h"))
              .dropDuplicates(["doc_id"]).orderBy("h", "doc_id").limit(SAMPLE))
    texts = docs.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text").toPandas()
    model = train(texts.sort_values("doc_id")["text"].tolist())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        column, n = batch.column("text"), batch.num_rows
        # texts without a digit or @ have no span of any kind and never become Python strings
        some = np.zeros(n, bool)
        for lo, _, b in blocks(column):
            at = np.flatnonzero(_ANCHOR[b.data])
            some[lo + np.searchsorted(b.doc_start, at, "right") - 1] = True
        rows = np.flatnonzero(some)
        counts, sha, all_spans = np.zeros((4, n), np.int64), [hashlib.sha256(b"").hexdigest()] * n, [""] * n
        found = find_spans(column.take(pa.array(rows)).to_pylist(), shared.value)
        for i, (base, spans) in zip(rows.tolist(), found, strict=True):
            for kind, _, _ in spans:
                counts[KINDS.index(kind), i] += 1
            sha[i], all_spans[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)
        return {"doc_id": batch.column("doc_id"), **{f"n_{k}": counts[i] for i, k in enumerate(KINDS)}, "base_sha256": sha, "spans": all_spans}
    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
