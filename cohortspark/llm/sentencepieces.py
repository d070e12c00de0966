"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import text_slices
from cohortspark.llm.tokens import Encoder, crc

SPACE_MARK = "▁"


class Pieces:
    """The pieces of a model file, its automaton, and the pass over one stretch of text.

    ``merges`` says whether the scores are ranks of merges (a byte-pair model: whole numbers that count down by one) or log
    probabilities (a unigram model). Either way one pass goes over the text; at each position the automaton's output
    links give every piece that ends there, and each relaxes the position's best segmentation. In a unigram model that is
    the one with the largest sum of scores. In a byte-pair model the sum of ranks says nothing; there a segmentation
    counts where each neighbouring pair is what merging their text by rank gives, which holds for exactly one last piece
    at each position, so the pass gives the same ids as merging the whole text.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.unknown = self.model.unk_id()
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i):
                self.bytes_of.append(b"")
            elif self.model.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(SPACE_MARK, " ").encode())
                if not self.model.is_unused(i):
                    self.id_of[piece], self.score[piece] = i, self.model.get_score(i)
        ranked = sorted((s for p, s in self.score.items() if s > -1e8), reverse=True)
        self.merges = bool(ranked) and all(s == int(s) for s in ranked) and ranked[-1] <= -(len(ranked) // 2)
        self.chars = {p for p in self.id_of if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if not self.merges or len(piece) == 1 or self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), piece, i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.floor = min(self.score.values(), default=0.0) - 10.0
        # may a piece go on over a space? If not, texts can be cut before spaces
        self.cuts_at_space = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.id_of)

    def merge(self, text: str) -> list[str]:
        """Joins the neighbouring pair whose piece has the best score, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def _known(self, text: str) -> list[int]:
        n = len(text)
        last: list[tuple[int, str, int] | None] = [None] * (n + 1)
        if self.merges:
            for end, (size, piece, i) in self.automaton.iter(text):
                start = end + 1 - size
                if last[end + 1] is None and (start == 0 or (last[start] is not None and self._fits(last[start][1], piece))):
                    last[end + 1] = (start, piece, i)
        else:
            best = [0.0] + [float("-inf")] * n
            for end, (size, piece, i) in self.automaton.iter(text):
                start = end + 1 - size
                total = best[start] + self.score[piece]
                if total > best[end + 1]:
                    best[end + 1], last[end + 1] = total, (start, piece, i)
        out, at = [], n
        while at:
            step = last[at]
            if step is None:
                raise AssertionError("a known character has no piece")
            out.append(step[2])
            at = step[0]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of a stretch of text with its spaces marked; characters without a piece become bytes (or the unknown id)."""
        if all(c in self.chars for c in text):
            return self._known(text)
        out, run = [], []
        for c in text:
            if c in self.chars:
                run.append(c)
                continue
            if run:
                out += self._known("".join(run))
                run = []
            if self.byte_ids:
                out += [self.byte_ids[b] for b in c.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out + (self._known("".join(run)) if run else [])

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join([self.bytes_of[i] for i in ids.tolist()])
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


class PieceEncoder(Encoder):
    """Rows are taken with a space before their text, as the model's dummy prefix wants it; stretches begin at spaces."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.keeps_space = True
        self._clear()

    def _borders(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start = np.zeros(len(data) + 1, bool)
        start[offsets] = True
        start[len(data)] = True
        if self.pieces.cuts_at_space and len(data) > 1:
            # 0x81 ends the space mark, should a text have it, and then belongs to the same run of marks
            start[1:-1] |= (data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81)
        return np.flatnonzero(start)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.pieces.encode(p.replace(" ", SPACE_MARK)) for p in pieces]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for g in got for i in g), np.uint32, int(size.sum())), size

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by row) of a text slice."""
        raw = data.tobytes()
        parts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        spaced = b"".join([b" " + p if p else b"" for p in parts])
        moved = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        return self(np.frombuffer(spaced, np.uint8), moved)


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_pieces, ids_crc32, round_trip[, ids]) of every whole text (null: empty, which has no pieces).

    ``round_trip``: decoding gives the text again; it fails only where the text has the space mark itself or what the
    model has no piece for. Repeated rows are encoded each; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(path)
        for batch in batches:
            for first, end, data, offsets in text_slices(batch, "text"):
                ids, bounds = enc.rows(data, offsets)
                raw = data.tobytes()
                own = [ids[bounds[k]:bounds[k + 1]] for k in range(end - first)]
                back = [enc.pieces.decode(x).encode() == raw[offsets[k]:offsets[k + 1]] for k, x in enumerate(own)]
                columns = [batch.column("id").slice(first, end - first), pa.array(np.diff(bounds)), pa.array([crc(x) for x in own], pa.int64()), pa.array(back)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_pieces", "ids_crc32", "round_trip", "ids"][:len(columns)])

    schema = f"id {kind}, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from rows of ids; a null row of ids gives a null text."""
    kind = encoded.schema[id_col].dataType.simpleString()
    src = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_encoder(path).pieces
        for batch in batches:
            text = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string())], ["id", "text"])

    return src.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
