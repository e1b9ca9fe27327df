"""SentencePiece encoding and decoding as shortest paths of weighted finite-state transducers."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import documents, with_columns

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Paths of different stretches never share an arc: no piece goes on with the space mark after another character, or holds
#: a line feed (which is a byte to the model).
STRETCHES = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")
MEMORY = 600_000
NOTHING: dict[str, bool] = {}


class Transducer:
    """The normaliser, the pieces and the byte fallback, compiled from a model file; composed lazily with each input.

    The normaliser maps a space to the space mark and puts one before a text. The piece transducer has an arc for each
    piece, weighted by its rank, and one for each byte of a character that no piece has. As the model's pieces come
    from merges, a path may hold two neighbouring arcs only if merging their joined text leaves both as they are: that is
    the weight (zero or infinite) of the bigram acceptor it is composed with. A state of the composition is a place and the
    arc that leads there, and the shortest path in the tropical semiring is the model's own segmentation.
    """

    def __init__(self, name: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        size = model.get_piece_size()
        self.bytes_of = [b""] * size
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.byte_id = [0] * 256
        self.piece: dict[str, tuple[int, float]] = {}
        for k in range(size):
            text = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(text[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(text[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.piece[text] = (k, -model.get_score(k))
                self.bytes_of[k] = text.replace(SPACE, " ").encode()
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.piece):
            raise ValueError("pieces reach over stretches")
        # states of the piece transducer: every beginning of a piece, with the arcs to longer ones by their next character
        # and, under "", the longest piece on the way there; `shorter` leads on to the next shorter piece that begins alike
        self.root: dict = {}
        self.shorter: dict[str, str | None] = {}
        for piece in sorted(self.piece, key=len):
            state, longest = self.root, None
            for c in piece:
                state = state.setdefault(c, {"": longest or c})
                longest = state[""]
            self.shorter[piece] = longest if longest != piece else None
            state[""] = piece
        self.reach = max(map(len, self.piece))
        self.after: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.edges: dict[tuple[str, int], list[tuple[str, float]] | None] = {}
        self.seen: dict[str, bytes] = {}

    def _merged(self, text: str, parts_left: int = 1) -> list[str]:
        """Merges by rank, the leftmost of the best first, until so many parts are left or none can be merged."""
        parts = list(text)
        while len(parts) > parts_left:
            ranks = [self.piece.get(a + b, (0, np.inf))[1] for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == np.inf:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]] | None:
        """The parts that touch a piece's right (-1) or left (0) end while it is merged together, smallest first, each with the
        rank of the merge that ends it (infinite for the whole piece). None if merging never makes the piece."""
        found = self.edges.get((piece, side), ())
        if found == ():
            if len(piece) == 1:
                found = [(piece, np.inf)]
            elif self._merged(piece) != [piece]:
                found = None
            else:
                part = self._merged(piece, 2)[side]
                found = [*self._edge(part, side)[:-1], (part, self.piece[piece][1]), (piece, np.inf)]
            self.edges[piece, side] = found
        return found

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging the joined text keeps both pieces: no part at the right end of one is merged with the part at the
        left end of the other that exists at the same time, before its own next merge (the left one of equal rank is first)."""
        ends, starts = self._edge(left, -1), self._edge(right, 0)
        if ends is None or starts is None:
            return False
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = ends[i], starts[j]
            rank = self.piece.get(x + y, (0, np.inf))[1]
            if rank < x_gone and rank <= y_gone:
                return False
            if x_gone == y_gone == np.inf:
                return True
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1

    def _follows(self, before: str, piece: str) -> bool:
        """Whether the acceptor has an arc from `before` ("": the start) to `piece`; kept in `after`."""
        if self.n_pairs >= MEMORY:
            self.after.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        found = self._apart(before, piece) if before else self._edge(piece, 0) is not None
        self.after.setdefault(before, {})[piece] = found
        return found

    def shortest(self, stretch: str) -> list[str]:
        """Pieces of the shortest path; a character that no piece has stands for itself.

        The acceptor gives all paths to a place but one an infinite weight: the segmentation of the text up to there. So the
        first finite path found to the end is the shortest. The search goes on from a place by the longest arc first and back
        where none is left; no place is reached by a finite path twice.
        """
        root, shorter, after, follows, reach = self.root, self.shorter, self.after, self._follows, self.reach
        path: list[str] = []
        place, before = 0, ""
        while place < len(stretch):
            state = root
            for c in stretch[place : place + reach]:
                onward = state.get(c)
                if onward is None:
                    break
                state = onward
            piece = state[""] if state is not root else stretch[place]
            while True:
                known = after.get(before, NOTHING)
                while piece:
                    found = known.get(piece)
                    if found is None:
                        found = follows(before, piece)
                    if found:
                        break
                    piece = shorter.get(piece)
                if piece:
                    break
                piece = shorter.get(before)
                place -= len(path.pop())
                before = path[-1] if path else ""
            path.append(piece)
            place += len(piece)
            before = piece
        return path

    def _packed(self, stretch: str) -> bytes:
        ids: list[int] = []
        for piece in self.shortest(stretch):
            if piece in self.piece:
                ids.append(self.piece[piece][0])
            else:
                ids += [self.byte_id[b] for b in piece.encode()]
        return b"".join([self.packed[i] for i in ids])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes; none for a null or empty text."""
        normal = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        parts = [STRETCHES.findall(t) for t in normal]
        new = set().union(*parts).difference(self.seen)
        if len(self.seen) + len(new) > MEMORY:
            self.seen.clear()
            new = set().union(*parts)
        for stretch in new:
            self.seen[stretch] = self._packed(stretch)
        get = self.seen.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The inverse: bytes of all pieces, space marks as spaces, less the space put before the text."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@cache
def transducer(name: str) -> Transducer:
    """One for each worker process and model."""
    return Transducer(name)


def encode(docs: DataFrame, text: str = "text", carry: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """`carry` (by default all columns but the text) with the ids as an array; null and empty texts have an empty array."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (text, ids)]

    work = lambda texts: [[np.frombuffer(x, "<u4").astype(np.int32) for x in transducer(MODEL).encode(texts)]]
    return with_columns(docs, text, carry, [(ids, "array<int>", pa.list_(pa.int32()))], work)


def decode(rows: DataFrame, ids: str = "ids", text: str = "text") -> DataFrame:
    """`rows` with the array of ids replaced by its text; a null array is an empty text."""
    carry = [c for c in rows.columns if c not in (ids, text)]

    machine = lambda x: transducer(MODEL).decode(np.array(x or [], "<u4").tobytes())
    return with_columns(rows, ids, carry, [(text, "string", pa.string())], lambda lists: [[machine(x) for x in lists]])


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, n_pieces, ids_crc32, decoded_sha256, same): every text encoded and decoded again.

    `same` is false only where a text holds the space mark itself, which decodes to a space. Null texts are empty. The
    crc32 is that of the ids as little-endian unsigned 32-bit integers. An empty table gives an empty one.
    """

    def work(texts: list) -> list:
        machine, rows = transducer(MODEL), []
        for t, x in zip(texts, machine.encode(texts), strict=True):
            back = machine.decode(x)
            rows.append((len(x) // 4, zlib.crc32(x), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
        return list(zip(*rows, strict=True))

    long, string = pa.int64(), pa.string()
    made = [("n_pieces", "long", long), ("ids_crc32", "long", long), ("decoded_sha256", "string", string), ("same", "boolean", pa.bool_())]
    return with_columns(docs, text, [doc_id], made, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir)).select("doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "same")
