"""Token ids of whole texts with a public vocabulary file, word by word."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

#: Chunks of a generation; the last full one and the one being filled are remembered.
CHUNKS_KEPT = 1 << 17
#: Marks that end a word and are no letters, digits or blanks.
_TAIL = ".,;:!?"


class WordTokenizer:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` as little-endian uint32 bytes.

    Meant for vocabularies that normalise to NFC, drop white space, fold to lower
    case and never join across a blank, as the word-end BPE files do. A text is
    cut at blanks and line breaks only, and each distinct chunk is encoded by the
    library once; chunks of letters with closing marks share the letters' ids.
    Texts where lower case first could change anything (special tokens, a capital
    sigma, characters not in NFC) go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.special_id, self.special = min((i, t.content) for i, t in self.library.get_added_tokens_decoder().items())
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _together(self, chunks: list[str], glue: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([glue.join(chunks)], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, missing: list[str]) -> None:
        known, tailed, bodies, cores, others = self.known, [], [], set(), []
        for chunk in missing:
            core = chunk.rstrip(_TAIL)
            if not core.isalpha():
                others.append(chunk)
                continue
            cores.add(core)
            if len(core) < len(chunk):
                tailed.append(chunk)
                bodies.append(core)
        # A word of letters ends with the only word-end id it has.
        words = [c for c in cores if c not in known]
        ids = self._together(words, " ")
        self._cut(words, ids, np.flatnonzero(self.ends[ids]) + 1, 0)
        # Other chunks stand between special tokens, which none of them holds.
        ids = self._together([*others, ""], self.special)
        self._cut(others, ids, np.flatnonzero(ids == self.special_id) + 1, 1)
        for chunk, core in zip(tailed, bodies, strict=True):
            tail = chunk[len(core) :]
            if tail not in known:
                known[tail] = self._whole(tail)
            known[chunk] = known[core] + known[tail]

    def _cut(self, chunks: list[str], ids: np.ndarray, stops: np.ndarray, glue: int) -> None:
        """Remember the ids of chunks encoded together; one by one if they cannot be told apart."""
        if len(stops) != len(chunks):
            self.known.update((c, self._whole(c)) for c in chunks)
            return
        raw, start = ids.tobytes(), 0
        for chunk, stop in zip(chunks, (4 * stops).tolist(), strict=True):
            self.known[chunk] = raw[start : stop - 4 * glue]
            start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        low, whole = [], []
        for text in texts:
            small = text.lower()
            plain = self.special[:2] not in text and "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", small)
            low.append(small.replace("\n", " ") if plain else "")
            whole.append(not plain)
        chunks = pc.split_pattern(pa.array(low, pa.large_string()), " ")
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist()
        if len(self.known) > CHUNKS_KEPT:
            self.known, self.old = {}, self.known
        known, old, missing = self.known, self.old, []
        for chunk in set(distinct).difference(known):
            if (held := old.get(chunk)) is None:
                missing.append(chunk)
            else:
                known[chunk] = held
        if missing:
            self._learn(missing)
        ids = pa.array(map(self.known.__getitem__, distinct), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], dtype=np.int64, count=len(ids) + 1)[chunks.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2]) if at[-1] else memoryview(b"")
        return [self._whole(t) if w else bytes(raw[a:b]) for t, w, a, b in zip(texts, whole, at[:-1], at[1:], strict=True)]


def worker_tokenizer(path: str) -> WordTokenizer:
    """The process's tokenizer for a file. Python workers outlive tasks, and what they have encoded stays known.

    Tasks bring this module along by value, so it is kept with the library, which is one for the process.
    """
    import tokenizers

    held = tokenizers.__dict__.setdefault("_by_path", {})
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
