"""SentencePiece encoding and decoding of whole texts with a merge-type (BPE) vocabulary.

*Method.*  The text is normalised by the model's own rules and starts as single characters.  An agenda
(a heap, a list for short chunks) holds the adjacent symbol pairs that form a piece, best score first, the leftmost of equals
first; the top pair is merged, pairs that no longer stand are skipped, and the merged symbol's two new
neighbours enter the agenda.  What is left are the ids; a character outside the vocabulary becomes its
UTF-8 bytes' ids where the model falls back to bytes, else the unknown id.

No piece of such a vocabulary holds a space mark behind another character, so merges never cross the
start of a run of space marks (checked when the model is read; a vocabulary with such pieces is encoded in
one agenda a text).  Nor do they cross two characters that stand side by side in no piece.  Each chunk
between those places has an agenda of its own, and a worker remembers the chunks it has met (``CACHE`` of
at most ``CACHE_CHARS`` characters each; the others are encoded every time).

*Check.*  Every text is also encoded by the library, batch by batch, and ``agrees`` says whether its ids
are the agenda's.  Decoding is the library's.  Texts of over ``SEGMENT`` characters are checked and
decoded in segments that begin at a chunk, which bounds what the library holds at once.

Defined results: a null text is empty (begin and end ids only, decoded to the empty text); a null id is
carried; repeated rows are encoded each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
CACHE, CACHE_CHARS = 500_000, 48
#: Chunks of at most so many characters keep their agenda as a plain list, a pair per place.
LISTED = 24
SEGMENT = 1 << 20

_encoders: dict = {}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message; nested messages stay bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + n], at + n
        yield tag >> 3, value


def model_type(model: bytes) -> int:
    """Kind of vocabulary of a serialised model: 1 unigram, 2 merges (BPE), 3 words, 4 characters."""
    trainer = next((v for number, v in _fields(model) if number == 2), b"")
    return next((v for number, v in _fields(trainer) if number == 3), 1)


class _Cache(dict):
    """Chunk → its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode, split):
        super().__init__()
        self.encode, self.split = encode, split

    def __missing__(self, chunk: str) -> bytes:
        parts = self.split(chunk)
        ids = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else array("I", self.encode(chunk)).tobytes()
        if len(chunk) <= CACHE_CHARS and len(self) < CACHE:
            self[chunk] = ids
        return ids


class Encoder:
    """Agenda encoder of a serialised merge-type model, and the library's processor beside it."""

    def __init__(self, model: bytes):
        import sentencepiece
        if model_type(model) != 2:
            raise ValueError("the vocabulary is not of the merge type")
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in ids]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in ids]
        if any(sp.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.rank = {p: (-sp.get_score(i), i) for i, p in enumerate(pieces) if plain[i]}
        self.bytes = {p: i for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        inner = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        stop = "" if any("\n" in p for p in self.rank) else "\n"
        self.pairs = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}
        # where no piece holds another character behind a letter, a chunk ends with a run of letters
        closed = not any(LETTER.match(a) and not LETTER.match(b) for a, b in self.pairs)
        other = f"[^{SPACE}{stop}{LETTER.pattern[1:]}"
        runs = f"{SPACE}*+(?:{other}*+{LETTER.pattern}++|{other}++)" if closed else f"{SPACE}*[^{SPACE}{stop}]+"
        self.chunk = re.compile("(?s).+" if inner else f"(?s){runs}|{SPACE}+|\n")
        self.cache = _Cache(self.merge, self.split)

    def split(self, chunk: str) -> list[str]:
        """The chunk cut between characters that stand side by side in no piece."""
        pairs = self.pairs
        cuts = [i for i, (a, b) in enumerate(zip(chunk, chunk[1:]), 1) if a + b not in pairs]
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)])] if cuts else [chunk]

    def merge(self, chunk: str) -> list[int]:
        """Ids of a normalised chunk by the agenda of adjacent pairs."""
        return self.numbers(self.listed(chunk) if len(chunk) <= LISTED else self.heaped(chunk))

    def listed(self, chunk: str) -> list[str]:
        """Symbols that merging leaves: the agenda holds the score of every adjacent pair, the first of the least is merged."""
        rank, none = self.rank, (float("inf"), -1)
        symbols = list(chunk)
        agenda = [rank.get(a + b, none)[0] for a, b in zip(chunk, chunk[1:])]
        while agenda and (best := min(agenda)) < none[0]:
            at = agenda.index(best)
            symbols[at] += symbols.pop(at + 1)
            del agenda[at]
            if at < len(agenda):
                agenda[at] = rank.get(symbols[at] + symbols[at + 1], none)[0]
            if at:
                agenda[at - 1] = rank.get(symbols[at - 1] + symbols[at], none)[0]
        return symbols

    def heaped(self, chunk: str) -> list[str]:
        """The same with the agenda as a heap, for long chunks."""
        rank, symbols, n = self.rank, list(chunk), len(chunk)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(entry[0], i, i + 1, 2) for i in range(n - 1) if (entry := rank.get(chunk[i:i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue                                   # one of the two has been merged since
            symbols[left], symbols[right] = a + b, ""
            after, first = behind[right], before[left]
            behind[left] = after
            if after < n:
                before[after] = left
                piece = a + b + symbols[after]
                if (entry := rank.get(piece)) is not None:
                    heapq.heappush(agenda, (entry[0], left, after, len(piece)))
            if first >= 0:
                piece = symbols[first] + a + b
                if (entry := rank.get(piece)) is not None:
                    heapq.heappush(agenda, (entry[0], first, left, len(piece)))
        return list(filter(None, symbols))

    def numbers(self, symbols: list[str]) -> list[int]:
        rank = self.rank
        out: list[int] = []
        for symbol in symbols:
            if (entry := rank.get(symbol)) is not None:
                out.append(entry[1])
            elif self.bytes:
                out += [self.bytes[f"<0x{byte:02X}>"] for byte in symbol.encode()]
            else:
                out.append(self.unknown)
        if not self.bytes:                                 # the library joins a run of unknown symbols
            out = [i for i, run in groupby(out) for _ in (run if i != self.unknown else (0,))]
        return out

    def ids(self, normalised: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.chunk.findall(normalised)))

    def _segments(self, normalised: str) -> list[str]:
        """The text in runs of chunks, each but the first beginning with a space mark."""
        out, at = [], 0
        while len(normalised) - at > SEGMENT:
            cut = normalised.find(SPACE, at + SEGMENT)
            while cut > 0 and normalised[cut - 1] == SPACE:
                cut = normalised.find(SPACE, cut + 1)
            if cut < 0:
                break
            out.append(normalised[at:cut])
            at = cut
        return [*out, normalised[at:]]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[str]]:
        """Per text: its ids with begin and end, whether the library agrees, and the decoded text."""
        sp, begin, end = self.sp, self.sp.bos_id(), self.sp.eos_id()
        edge = [np.array([i], "<u4").tobytes() for i in (begin, end)]
        out, agrees, decoded = [], [], []
        short = [i for i, t in enumerate(texts) if len(t) <= SEGMENT]
        normal = dict(zip(short, sp.normalize([texts[i] for i in short]))) if short else {}
        checked = dict(zip(short, sp.encode([texts[i] for i in short], add_bos=True, add_eos=True, num_threads=1))) if short else {}
        for i, text in enumerate(texts):
            if i in normal:
                ids = edge[0] + self.ids(normal[i]) + edge[1]
                own = np.frombuffer(ids, "<u4").tolist()
                out.append(ids)
                agrees.append(own == checked[i])
                decoded.append(sp.decode(own))
                continue
            same, ids, parts = True, [], []
            for j, part in enumerate(self._segments(sp.normalize(text))):
                # the library puts the first space mark back, but to an empty text
                plain = part[1:] if part.startswith(SPACE) else part
                ids.append(self.ids(part))
                own = np.frombuffer(ids[-1], "<u4").tolist()
                same &= own == (sp.encode(plain.replace(SPACE, " "), num_threads=1) if plain else [sp.piece_to_id(SPACE)])
                parts.append((" " if j else "") + sp.decode(own))
            out.append(edge[0] + b"".join(ids) + edge[1])
            agrees.append(bool(same))
            decoded.append("".join(parts))
        return out, agrees, decoded


def encoder(model: bytes) -> Encoder:
    """The worker's encoder of a model (read once a process)."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ids, n_tokens, decoded, agrees) of every text: ids as little-endian unsigned 32-bit integers,
    begin and end included; decoded by the library; ``agrees`` where the library's ids are the same."""
    with open(model_path, "rb") as f:
        model = f.read()
    narrow = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    id_type = narrow.schema[key].dataType.simpleString()

    def run(batches):
        e = encoder(model)
        for batch in batches:
            keys, texts = batch.columns
            for row in range(0, batch.num_rows, 512):
                ids, agrees, decoded = e.encode(texts.slice(row, 512).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(row, 512), pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64()),
                     pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
                    names=[key, "ids", "n_tokens", "decoded", "agrees"])

    return narrow.mapInArrow(run, f"`{key}` {id_type}, ids binary, n_tokens long, decoded string, agrees boolean")
