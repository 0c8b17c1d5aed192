"""Token ids of whole texts with a `tokenizers` vocabulary file.

The vocabulary's pre-tokenizer never joins characters across a blank or a line
feed, so the ids of a text are the ids of its blank-separated pieces, one after
the other. Pieces repeat often; each worker encodes a piece once and keeps its
ids in tables of bounded size: letters in an Arrow array beside a flat array of
ids (some 30 bytes an entry), other pieces in a dict. Property tests hold this
against plain `encode`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import caches

#: What the two tables hold before they are emptied: pieces and their characters, stems and their bytes.
CACHE_PIECES, CACHE_CHARS = 50_000, 4 << 20
CACHE_STEMS, CACHE_BYTES = 900_000, 24 << 20
JOINED = 2_000
BLOCK_CHARS = 4 << 20
LONG = 1_000
TAIL = ".,;:!?#$%&*|()"
TAIL_BYTES = 4
_encoders: dict[str, "Encoder"] = {}
caches.register("tokens", _encoders.clear)


def encoder(path: str, most_stems: int | None = None) -> "Encoder":
    """One per Python worker and vocabulary; workers are reused between tasks. `most_stems` keeps its largest table smaller."""
    caches.claim("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most_stems = most_stems
    return _encoders[path]


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _gathered(table: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs number `at` of a table of runs with these sizes, one after the other, and where each ends."""
    starts, lengths = (np.cumsum(sizes) - sizes)[at], sizes[at]
    ends = np.cumsum(lengths)
    return table[np.arange(lengths.sum()) + np.repeat(starts - ends + lengths, lengths)], ends


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # a special token stands between pieces that are encoded together
        self.mark, self.mark_id = max(special.items(), key=lambda x: x[1]) if special else (None, None)
        self.special = tuple(special)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.word_ends = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.word_ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.word_ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.folds = "Lowercase" in str(self.tokenizer.normalizer)
        self.small = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.most_stems: int | None = None
        self._empty_pieces()
        self._empty_stems()

    def _empty_pieces(self) -> None:
        self.held: dict[str, bytes] = {}
        self.chars = 0

    def _empty_stems(self) -> None:
        self.stems = pa.array([], pa.large_string())
        self.stem_ids, self.stem_sizes = np.empty(0, self.small), np.empty(0, np.int64)

    def _plain(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of pieces that aren't letters with a tail into the table `held`."""
        joined = []
        for piece in pieces:
            if self.mark is None or len(piece) > LONG or any(s in piece for s in self.special):
                self.held[piece] = self._plain(piece)
            else:
                joined.append(piece)
        self._many(joined, self.mark, self.held)

    def _many(self, pieces: list[str], between: str, into: dict[str, bytes]) -> None:
        """Encode many pieces in one call; a piece ends at a special token, or with an end-of-word token."""
        for at in range(0, len(pieces), JOINED):
            part = pieces[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, "<u4")
            if between == " ":
                ends = np.flatnonzero(self.word_ends[ids]) + 1
                skip = 0
            else:
                ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
                skip = 4
            if len(ends) != len(part):
                into.update((p, self._plain(p)) for p in part)
                continue
            raw, low = ids.tobytes(), 0
            for piece, high in zip(part, (4 * ends).tolist()):
                into[piece] = raw[low:high]
                low = high + skip

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces that aren't letters with a tail; a full table is emptied before what is missing is learnt."""
        if len(self.held) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self._empty_pieces()
        new = [p for p in pieces if p not in self.held]
        self.chars += sum(map(len, new))
        self._learn(new)
        return list(map(self.held.__getitem__, pieces))

    def _stems(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for different letters: their ids, one after the other, and their numbers."""
        if len(self.stems) > (CACHE_STEMS if self.most_stems is None else self.most_stems) or self.stems.nbytes > CACHE_BYTES:
            self._empty_stems()
        at = np.array(pc.fill_null(pc.index_in(words, value_set=self.stems), -1).to_numpy(zero_copy_only=False), np.int64)
        missing = at < 0
        if missing.any():
            new = words.filter(pa.array(missing))
            pieces, found = new.to_pylist(), {}
            self._many(pieces, " ", found)
            ids = list(map(found.__getitem__, pieces))
            at[missing] = len(self.stems) + np.arange(len(pieces))
            self.stems = pa.concat_arrays([self.stems, new])
            self.stem_ids = np.concatenate([self.stem_ids, np.frombuffer(b"".join(ids), "<u4").astype(self.small)])
            self.stem_sizes = np.concatenate([self.stem_sizes, np.fromiter(map(len, ids), np.int64, len(ids)) // 4])
        return _gathered(self.stem_ids, self.stem_sizes, at)[0], self.stem_sizes[at]

    def _ids(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces, one after the other, and their numbers."""
        stems = pc.utf8_rtrim(pieces, characters=TAIL)
        tail = pc.subtract(pc.binary_length(pieces), pc.binary_length(stems)).to_numpy()
        # letters, then punctuation: the pre-tokenizer cuts between them, but not after the mark that a small İ ends with
        built = pc.and_not(pc.utf8_is_alpha(stems), pc.match_substring(stems, "İ")).to_numpy(zero_copy_only=False)
        built &= (pc.utf8_length(pieces).to_numpy() <= LONG) & (tail <= TAIL_BYTES) & (self.word_ends is not None)
        coded = stems.filter(pa.array(built)).dictionary_encode()
        letters, letter_sizes = self._stems(coded.dictionary)
        first = np.empty(len(pieces), np.int64)
        first[built] = coded.indices.to_numpy()
        first[~built] = np.arange(len(letter_sizes), len(letter_sizes) + np.count_nonzero(~built))
        ids = self._known(pieces.filter(pa.array(~built)).to_pylist())
        # a tail is ASCII; its bytes make one number
        raw, stops = np.frombuffer(pieces.buffers()[2] or b"", np.uint8), np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset + 1 :]
        code = np.zeros(len(pieces), np.int64)
        for k in range(TAIL_BYTES):
            at = np.flatnonzero(built & (tail > k))
            code[at] += raw[stops[at] - 1 - k].astype(np.int64) << 8 * k
        codes, last = np.unique(code, return_inverse=True)
        last += len(letter_sizes) + len(ids)
        ids += [self._plain(c.to_bytes(TAIL_BYTES, "big").lstrip(b"\0").decode()) for c in codes.tolist()]
        sizes = np.concatenate([letter_sizes, np.fromiter(map(len, ids), np.int64, len(ids)) // 4])
        table, _ = _gathered(np.concatenate([letters.astype("<u4"), np.frombuffer(b"".join(ids), "<u4")]), sizes, np.column_stack([first, last]).ravel())
        return table, sizes[first] + sizes[last]

    def _block(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are handled together: each different piece of the block is looked up once."""
        column = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = column.flatten().dictionary_encode()
        flat, ends = _gathered(*self._ids(coded.dictionary), coded.indices.to_numpy())
        cuts = np.concatenate([[0], ends])[column.offsets.to_numpy()].tolist()
        return [flat[low:high].tobytes() for low, high in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is the empty text."""
        out, block, size = [], [], 0
        for text in texts:
            if text and self.folds and "<|" not in text and _latin(text):
                text = text.lower()  # as the vocabulary's normalizer does; it has one letter for one here
            text = text.replace("\n", " ") if text else ""
            if block and size + len(text) > BLOCK_CHARS:
                out += self._block(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        return out + self._block(block) if block else out
