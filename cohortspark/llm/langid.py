"""Language identification by cross-parsing entropy.

A suffix automaton of a language's sample text answers "how far does the longest match go from here". A text is parsed
greedily into phrases, each the longest piece found in the sample; a text needs few phrases against its own language.
With phrases c over n letters and a sample of N letters, c * log2(N) / n estimates the cross entropy in bits; the language
with the fewest normalised phrases wins.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import text_slices, uniform

SAMPLE_DOCS = 64            # documents of each language in the sample, at most
SAMPLE_CHARS = 400          # characters of each
TOTAL_CHARS = 1 << 20       # characters of all samples together, shared by the languages
ALPHABET = 96               # letters that the automata tell apart; rarer ones share one class
STRETCH = 512               # letters parsed as one lane; a longer text is several lanes, which add up
HELD_OUT = 192              # labelled documents of each language outside the sample that set its bound, at most
QUANTILE = 0.98             # of their bits a letter
MARGIN = 1.4                # a text in the language stays below this multiple of that quantile
STRAY_PHRASES = 8           # phrases beyond that (an address, a number) that a text may hold, which tell in short texts only
FEW_LETTERS = 20            # texts with fewer letters go by their letters: half of them must be in a sample
LANES = 8192                # lanes stepped together


def _fold_table() -> np.ndarray:
    """Code point (Basic Multilingual Plane) -> folded code point; anything that is no letter becomes a space."""
    out = np.full(65536, 32, np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_fold: np.ndarray | None = None


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes -> folded code points. Letters beyond the first plane stay themselves."""
    global _fold
    if _fold is None:
        _fold = _fold_table()
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    high = points > 65535
    out = _fold[np.where(high, 0, points)]
    if high.any():
        out[high] = [p if unicodedata.category(chr(p))[0] == "L" else 32 for p in points[high]]
    return out


def suffix_automaton(letters: Sequence[int], width: int) -> np.ndarray:
    """Transitions (states x width, -1: none) of the smallest automaton that accepts every substring of ``letters``.

    Built letter by letter: a new state for the whole prefix, and a split where a suffix link would join a longer string.
    """
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in letters:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in go[at]:
            go[at][c] = new
            at = link[at]
        if at >= 0:
            target = go[at][c]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(go)
                go.append(dict(go[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                link[target] = link[new] = copy
                while at >= 0 and go[at].get(c) == target:
                    go[at][c] = copy
                    at = link[at]
        last = new
    table = np.full((len(go), width), -1, np.int32)
    for state, edges in enumerate(go):
        for c, to in edges.items():
            table[state, c] = to
    return table


class Model:
    """Automata of all languages over one alphabet, made from their sample texts."""

    def __init__(self, samples: Sequence[tuple[str, str]]):
        self.langs = [lang for lang, _ in samples]
        folded = [fold(np.frombuffer(text.encode(), np.uint8)) for _, text in samples]
        every = np.concatenate(folded) if folded else np.empty(0, np.uint32)
        values, counts = np.unique(every[every != 32], return_counts=True)
        known = values[np.argsort(-counts, kind="stable")][:ALPHABET - 2]
        self.known = np.sort(known)
        self.seen = values                          # also letters beyond the alphabet
        self.width = len(self.known) + 2            # 0: space, 1: another letter
        self.tables = [suffix_automaton(self._squeeze(self.codes(x)).tolist(), self.width) for x in folded]
        self.bits = np.array([math.log2(max(2, len(x))) for x in folded])

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, points)
        hit = (at < len(self.known)) & (self.known[np.minimum(at, max(0, len(self.known) - 1))] == points) if len(self.known) else np.zeros(len(points), bool)
        return np.where(points == 32, 0, np.where(hit, at + 2, 1)).astype(np.int32)

    @staticmethod
    def _squeeze(codes: np.ndarray) -> np.ndarray:
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        return codes[keep]

    def phrases(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of phrases of each row (runs of ``codes``) against each language; lanes of a row add up."""
        rows = len(bounds) - 1
        sizes = np.diff(bounds)
        lanes = -(-sizes // STRETCH)
        row = np.repeat(np.arange(rows), lanes)
        start = bounds[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * STRETCH
        length = np.minimum(STRETCH, bounds[1:][row] - start)
        order = np.argsort(-length, kind="stable")
        out = np.zeros((rows, len(self.langs)))
        for part in range(0, len(order), LANES):
            pick = order[part:part + LANES]
            size, begin = length[pick], start[pick]
            active = np.searchsorted(-size, -np.arange(int(size[0])), "left")      # lanes longer than step i
            letters = np.zeros((int(size[0]), len(pick)), np.int32)
            for i, n in enumerate(active):
                letters[i, :n] = codes[begin[:n] + i]
            for k, table in enumerate(self.tables):
                flat, width = table.ravel(), self.width
                root = table[0]
                state = np.zeros(len(pick), np.int32)
                count = np.zeros(len(pick), np.int64)
                for i, n in enumerate(active):
                    c = letters[i, :n]
                    to = flat[state[:n] * width + c]
                    stop = np.flatnonzero(to < 0)
                    if len(stop):
                        count[stop] += 1
                        again = root[c[stop]]
                        to[stop] = np.maximum(again, 0)
                    state[:n] = to
                count += state > 0
                out[:, k] += np.bincount(row[pick], weights=count, minlength=rows)
        return out


    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, bits, letters) of the rows of a text slice; see :func:`predict`."""
        lead = (data & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])[offsets]
        codes = self.codes(fold(data))
        # runs of non-letters count as one space
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        bounds, codes = np.concatenate([[0], np.cumsum(keep)])[at], codes[keep]
        letters = np.concatenate([[0], np.cumsum(codes != 0)])
        n = letters[bounds[1:]] - letters[bounds[:-1]]
        if not self.langs:
            return np.array(["und"] * len(n), object), np.zeros(len(n)), np.zeros(len(n)), n
        cost = self.phrases(codes, bounds) * self.bits / np.maximum(1, n)[:, None]
        order = np.argsort(cost, axis=1, kind="stable")
        best = np.take_along_axis(cost, order[:, :1], 1)[:, 0]
        second = np.take_along_axis(cost, order[:, 1:2], 1)[:, 0] if len(self.langs) > 1 else np.full(len(best), np.inf)
        names = np.array(self.langs, object)[order[:, 0]]
        score = np.clip(np.where(np.isinf(second), 1.0, 1.0 - best / np.maximum(second, 1e-12)), 0.0, 1.0)
        none = n == 0
        names[none], score[none], best[none] = "und", 0.0, 0.0
        return names, score, best, n


_models: dict[tuple, Model] = {}


def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    if samples not in _models:
        _models.clear()
        _models[samples] = Model(samples)
    return _models[samples]


def _drawn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """Of each language the first SAMPLE_CHARS characters of SAMPLE_DOCS + HELD_OUT documents at most, by a hash of their id."""
    d = labelled.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l"))
    d = d.where("t IS NOT NULL AND l IS NOT NULL AND l <> 'und'")
    counts = d.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    chosen = d.join(F.broadcast(counts), "l").where(uniform(F.col("i"), F.lit(11)) < 4.0 * SAMPLE_DOCS / F.col("n"))
    chosen = chosen.select("l", F.xxhash64("i", F.lit(3)).alias("h"), F.substring("t", 1, SAMPLE_CHARS).alias("t"))
    # the draw leaves about four times the sample; the smallest hashes of each language are kept
    rows = chosen.groupBy("l").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "t"))), 1, SAMPLE_DOCS + HELD_OUT).alias("s")).orderBy("l").collect()
    return [(r["l"], [x["t"] for x in r["s"]]) for r in rows]


def _samples(drawn: list[tuple[str, list[str]]]) -> tuple[tuple[str, str], ...]:
    each = TOTAL_CHARS // max(1, len(drawn))
    return tuple((lang, "\n".join(texts[:SAMPLE_DOCS])[:each]) for lang, texts in drawn)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """Sample text of each language: at most SAMPLE_DOCS documents of it, chosen by a hash of their id, the first
    SAMPLE_CHARS characters of each, and TOTAL_CHARS in all. Rows without text or label are left out."""
    return _samples(_drawn(labelled, id_col, text_col, lang_col))


def fit_bounds(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang") -> tuple[tuple[tuple[str, str], ...], dict[str, float]]:
    """The samples of :func:`fit` and for each language the bits a letter that its texts stay below.

    MARGIN times the QUANTILE of labelled documents outside the sample. A language with few such documents is judged on
    the second half of its sample by the first half; one with less than two documents has the largest bound of the others.
    """
    drawn = _drawn(labelled, id_col, text_col, lang_col)
    learned, held = [], []
    for lang, texts in drawn:
        k = SAMPLE_DOCS if len(texts) >= SAMPLE_DOCS + 16 else len(texts) // 2
        learned.append((lang, texts[:k] or texts))
        held.append(texts[k:] if k else [])
    model, bounds = Model(_samples(learned)), {}
    for (lang, _), texts in zip(drawn, held):
        raw = [x.encode() for x in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        _, _, bits, letters = model.judge(np.frombuffer(b"".join(raw), np.uint8), offsets)
        bits = bits[letters >= FEW_LETTERS]
        if len(bits):
            bounds[lang] = MARGIN * float(np.quantile(bits, QUANTILE))
    most = max(bounds.values(), default=math.inf)
    return _samples(drawn), {lang: bounds.get(lang, most) for lang, _ in drawn}


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits) of every whole text; nothing but the text is looked at.

    ``bits`` is the estimated cross entropy a letter against the chosen language, ``score`` the relative lead
    ``1 - best / second`` of the normalised phrase counts (with one language: 1). ``und`` with score 0 where the text is
    null or has no letter, or where nothing was learned. Ties go to the language that sorts first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples)
        for batch in batches:
            for first, end, data, offsets in text_slices(batch, "text", 1 << 20):
                names, score, best, _ = model.judge(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), pa.array(names, pa.string()),
                                                  pa.array(score), pa.array(best)], ["id", "lang_pred", "score", "bits"])

    return src.mapInArrow(run, f"id {kind}, lang_pred string, score double, bits double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, samples: tuple[tuple[str, str], ...], bounds: dict[str, float], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is in a learned language.

    A row is rejected where the prediction is ``und`` (null text, no letter), where even the best language needs more bits a
    letter than its texts do (``bounds`` of :func:`fit_bounds`, and STRAY_PHRASES phrases), or, with under FEW_LETTERS letters,
    where most of them are in no sample. Texts in several learned languages stay. No shuffle: rows are filtered where they
    are read. With nothing learned nothing can be told apart, and all rows stay.
    """
    if not samples:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples)
        size = dict(zip(model.langs, model.bits))
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for _, _, data, offsets in text_slices(batch, text_col, 1 << 20):
                names, _, bits, letters = model.judge(data, offsets)
                bound = np.array([bounds.get(x, 0.0) for x in names]) + STRAY_PHRASES * np.array([size.get(x, 0.0) for x in names]) / np.maximum(1, letters)
                good = (names != "und") & (bits <= bound)
                for k in np.flatnonzero((names != "und") & (letters < FEW_LETTERS)).tolist():
                    points = fold(data[offsets[k]:offsets[k + 1]])
                    points = points[points != 32]
                    good[k] = 2 * int(np.isin(points, model.seen).sum()) >= len(points)
                keep.append(good)
            yield batch.filter(pa.array(np.concatenate(keep).astype(bool)))

    return docs.mapInArrow(run, docs.schema)
