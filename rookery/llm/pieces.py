"""SentencePiece encoding and decoding with numpy: words of equal length advance together through one Viterbi.

A vocabulary file (its path is a parameter) gives pieces and scores. Texts are cut before every run of spaces and around line ends, which
no piece crosses, so a distinct word is solved once per batch. For each end position and piece length, hashes of the
substrings of all words of that length are probed in the sorted hashes of the pieces, hits are compared character
by character, and a vectorised maximum stores the way back. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import ship

ship(__name__)

SPACE = "▁"
#: Kinds of pieces in the file format, fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: What an unknown character costs beyond the lowest score, fixed by the library.
UNKNOWN_PENALTY = 10.0
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    """The public vocabulary with byte pieces on this machine, unless ROOKERY_PIECES names another file."""
    if "ROOKERY_PIECES" in os.environ:
        return os.environ["ROOKERY_PIECES"]
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Vocabulary:
    """Pieces by id, with what encoding and decoding look up."""

    surface: list[str]
    kind: np.ndarray
    score: np.ndarray
    keys: np.ndarray  # sorted substring hashes of the pieces that may be used in a path
    ids: np.ndarray  # their ids
    chars: np.ndarray  # their characters, zero-padded
    seen: np.ndarray  # which top bits of a hash occur
    byte_ids: np.ndarray
    unknown: float
    out_bytes: np.ndarray  # what each id decodes to, end to end
    out_start: np.ndarray
    out_length: np.ndarray

    @property
    def longest(self) -> int:
        return self.chars.shape[1]


def load(path: str, scores: str = "stored") -> Vocabulary:
    """Reads a vocabulary file with byte pieces.

    ``scores`` is ``stored`` for the file's own numbers, as a unigram model takes them, or ``rank`` for a file of merge
    ranks: fewest pieces first, then the smallest sum of ranks.
    """
    surface, score, kind = [], [], []
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                piece = dict(_fields(value))
                surface.append(piece[1].decode())
                score.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                kind.append(piece.get(3, NORMAL))
    kinds, stored = np.array(kind), np.array(score)
    byte_ids = np.full(256, -1)
    for i in np.flatnonzero(kinds == BYTE):
        byte_ids[int(surface[i][3:5], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte pieces")
    normal = kinds == NORMAL
    lowest, highest = stored[normal].min(), stored[normal].max()
    for i in np.flatnonzero(kinds == USER_DEFINED):  # always preferred, as in the library
        stored[i] = len(surface[i].encode()) * highest - 0.1
    unknown = lowest - UNKNOWN_PENALTY
    if scores == "rank":
        # one piece more costs more than any sum of ranks can gain
        step = float(1 << 40)
        stored = np.where(kinds == USER_DEFINED, -step, stored - step)
        unknown = -8 * step
    usable = np.flatnonzero(normal | (kinds == USER_DEFINED))
    usable = usable[[bool(surface[i]) for i in usable]]
    if any("\n" in surface[i] or SPACE in surface[i].lstrip(SPACE) for i in usable):
        raise ValueError("a piece crosses a cut between words")
    longest = max(len(surface[i]) for i in usable)
    chars = np.zeros((len(usable), longest), np.uint32)
    for row, i in enumerate(usable):
        chars[row, : len(surface[i])] = np.frombuffer(surface[i].encode("utf-32-le"), np.uint32)
    lengths = np.array([len(surface[i]) for i in usable])
    hashes = _hashes(chars)[np.arange(len(usable)), lengths]
    order = np.argsort(hashes, kind="stable")
    if (np.diff(hashes[order]) == 0).any():
        raise ValueError("two pieces share a hash")
    seen = np.zeros(1 << 20, bool)
    seen[hashes >> np.uint64(44)] = True
    out = []
    for i, text in enumerate(surface):
        if kinds[i] == BYTE:
            out.append(bytes([int(text[3:5], 16)]))
        else:
            out.append(b"" if kinds[i] in (CONTROL, UNKNOWN) else text.replace(SPACE, " ").encode())
    sizes = np.array([len(x) for x in out])
    return Vocabulary(
        surface, kinds, stored, hashes[order], usable[order], chars[order], seen, byte_ids, unknown,
        np.frombuffer(b"".join(out), np.uint8), np.cumsum(sizes) - sizes, sizes,
    )


def _hashes(words: np.ndarray) -> np.ndarray:
    """Prefix hashes (n, L + 1) of words (n, L) of characters."""
    found = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    for j in range(words.shape[1]):
        found[:, j + 1] = found[:, j] * _FACTOR + (words[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return found


def viterbi(vocabulary: Vocabulary, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of words (n, L) of characters: ids end to end, -1 - c for a character c without a piece, and how many per word.

    Of equal sums the path with the longer last piece wins, as in the library.
    """
    n, size = words.shape
    prefix = _hashes(words)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(vocabulary.longest, _FACTOR)]), dtype=np.uint64)
    best = np.zeros((n, size + 1))
    length = np.zeros((n, size + 1), np.int64)
    chosen = np.zeros((n, size + 1), np.int64)
    place = np.arange(vocabulary.longest)
    for end in range(1, size + 1):
        most = min(end, vocabulary.longest)  # column c holds the substring of most - c characters
        key = prefix[:, end, None] - prefix[:, end - most : end] * powers[most:0:-1]
        rows, columns = np.nonzero(vocabulary.seen[key >> np.uint64(44)])
        probe = key[rows, columns]
        at = np.minimum(np.searchsorted(vocabulary.keys, probe), len(vocabulary.keys) - 1)
        hit = vocabulary.keys[at] == probe
        rows, columns, at = rows[hit], columns[hit], at[hit]
        k = most - columns
        inside = place[None, :] < k[:, None]
        own = words[rows[:, None], np.minimum(end - k[:, None] + place, size - 1)]
        same = (np.where(inside, own, 0) == vocabulary.chars[at]).all(axis=1)
        rows, columns, k, ids = rows[same], columns[same], k[same], vocabulary.ids[at[same]]
        total = np.full((n, most), -np.inf)
        total[:, -1] = best[:, end - 1] + vocabulary.unknown
        piece = np.zeros((n, most), np.int64)
        piece[:, -1] = -1 - words[:, end - 1].astype(np.int64)
        total[rows, columns] = best[rows, end - k] + vocabulary.score[ids]
        piece[rows, columns] = ids
        pick = total.argmax(axis=1)
        best[:, end], length[:, end], chosen[:, end] = total[np.arange(n), pick], most - pick, piece[np.arange(n), pick]
    steps = np.zeros((n, size), np.int64)
    counts = np.zeros(n, np.int64)
    at = np.full(n, size)
    while (live := np.flatnonzero(at > 0)).size:
        steps[live, counts[live]] = chosen[live, at[live]]
        counts[live] += 1
        at[live] -= length[live, at[live]]
    back = counts[:, None] - 1 - np.arange(size)[None, :]
    ordered = np.take_along_axis(steps, np.maximum(back, 0), axis=1)
    return ordered[back >= 0], counts


_WORD = re.compile(r" *[^ \n]+| +|\n+")


def cut_words(text: str) -> list[str]:
    """The text with the leading space that every text gets, cut before every run of spaces and around line ends."""
    return _WORD.findall(" " + text)


class Encoder:
    """Encodes batches of texts; keeps the paths of up to ``keep`` words between batches, then starts afresh."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 300_000):
        self.vocabulary, self.keep = vocabulary, keep
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.counts = [], []
        self.total = 0

    def _solve(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for size, group in by_length.items():
            per_block = max(1, (1 << 22) // (size + 1) // 16)
            for at in range(0, len(group), per_block):
                block = group[at : at + per_block]
                chars = np.frombuffer("".join(block).encode("utf-32-le", errors="surrogatepass"), np.uint32).reshape(len(block), size).copy()
                literal = chars == ord(SPACE)  # not a space: kept apart from the mark, and spelt in bytes
                chars[chars == 32] = ord(SPACE)
                chars[literal] = 0x110000
                ids, counts = viterbi(self.vocabulary, chars)
                ids, counts = self._spell(ids, counts)
                for k, w in enumerate(block):
                    self.index[w] = len(self.counts) + k
                self.flat.append(ids)
                self.counts.extend(counts.tolist())

    def _spell(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of characters without a piece."""
        missing = np.flatnonzero(ids < 0)
        if not len(missing):
            return ids, counts
        spelt = [(SPACE if c == 0x110000 else chr(c)).encode("utf-8", errors="replace") for c in (-1 - ids[missing]).tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[missing] = [len(b) for b in spelt]
        owner = np.repeat(np.arange(len(counts)), counts)
        wide = np.repeat(ids, sizes)
        wide[np.repeat(ids < 0, sizes)] = self.vocabulary.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        return wide, np.bincount(owner, weights=sizes, minlength=len(counts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has. An empty text has none."""
        if len(self.index) > self.keep:
            self._clear()
        words = [cut_words(t) if t else [] for t in texts]
        fresh = {w for ws in words for w in ws if w not in self.index}
        if fresh:
            self._solve(sorted(fresh))
            self.flat = [np.concatenate(self.flat)]
        if not self.flat:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        counts = np.array(self.counts)
        starts = np.cumsum(counts) - counts
        per_text = np.array([len(ws) for ws in words])
        index = self.index
        which = np.fromiter((index[w] for ws in words for w in ws), np.int64, per_text.sum())
        own = counts[which]
        ids = self.flat[0][np.repeat(starts[which] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
        return ids, np.bincount(np.repeat(np.arange(len(texts)), per_text), weights=own, minlength=len(texts)).astype(np.int64)


def decode(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """UTF-8 of each text; the leading space of the encoding goes."""
    own = vocabulary.out_length[ids]
    flat = vocabulary.out_bytes[np.repeat(vocabulary.out_start[ids] - (np.cumsum(own) - own), own) + np.arange(own.sum())].tobytes()
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(np.bincount(owner, weights=own, minlength=len(counts)).astype(np.int64)).tolist()
    return [flat[a + 1 : b] for a, b in zip([0, *ends[:-1]], ends)]


def encode_pieces(docs: DataFrame, path: str, scores: str = "stored", id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 22) -> DataFrame:
    """(id, n_pieces, ids, round_trip): the piece ids of every whole text and whether decoding them gives the text back.

    Null and empty texts have no ids and decode to the empty text (``round_trip`` true). Repeated rows each get a row;
    other columns are ignored. The file at ``path`` is read on the driver and its tables go out with the tasks.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(vars(load(path, scores)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**vocabulary.value))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                part, chars = [], 0
                while at + len(part) < len(batch) and (chars < batch_chars or not part):
                    part.append(texts[at + len(part)].as_py() or "")
                    chars += len(part[-1])
                ids, counts = encoder.encode(part)
                back = decode(encoder.vocabulary, ids, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(at, len(part)), pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32())),
                        pa.array([b == t.encode() for b, t in zip(back, part)], pa.bool_()),
                    ],
                    names=[id_col, "n_pieces", "ids", "round_trip"],
                )
                at += len(part)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_pieces long, ids array<int>, round_trip boolean")
