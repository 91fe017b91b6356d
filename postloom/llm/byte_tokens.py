"""Token ids of whole texts with a public byte-level vocabulary file."""

from __future__ import annotations

import json
import re
import sys

import numpy as np
from pyspark import cloudpickle

#: Texts with other characters go to the library: its tables of letters and digits may be newer or older.
_KNOWN = re.compile("[^\x00-ɏ̀-ͯΑ-ωЀ-џ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]")
#: So do texts with long runs that one match of the splitting pattern would take.
_RUN = re.compile(r"\S{2000}|\s{2000}")
# Fixed value: where byte-level vocabularies cut a text before they merge.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` as little-endian uint32 arrays.

    Where the file is byte-level BPE whose merges make its tokens in the order of
    their ids, merging by rank gives the same ids, and a faster library does that.
    The file is tested for it; any other file, and texts with special tokens, rare
    characters or very long runs, are encoded by the library of the file itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, cut = held["model"], held.get("pre_tokenizer") or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or odd or held.get("normalizer") or any(cut.get(k) != v for k, v in plain.items()):
            return None
        ids, byte_of = model["vocab"], _byte_of()
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        bases = {t for t in ids if len(t) == 1}
        if bases != set(byte_of) or [ids.get(t) for t in made] != list(range(len(bases), len(bases) + len(made))) or len(ids) != len(bases) + len(made):
            return None
        ranks = {bytes(byte_of[c] for c in token): i for token, i in ids.items()}
        return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or (not text.isascii() and _KNOWN.search(text)) or _RUN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def worker_tokenizer(path: str) -> ByteTokenizer:
    """The process's tokenizer for a file; workers outlive tasks, modules that tasks bring along do not."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_byte_by_path", {})
    if path not in held:
        held[path] = ByteTokenizer(path)
    return held[path]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
