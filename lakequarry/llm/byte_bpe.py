"""Byte-level BPE ids of texts; the vocabulary files are the public ones."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Characters for which every library splits words alike: ASCII, Latin-1 and Latin Extended-A letters. Others take the plain way.
_OTHER = re.compile(r"[^\x09\x0A\x20-\x7EÀ-ÖØ-öø-ſ]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ids_of(): what tokenizers gives with add_special_tokens=False, so the string of a special token within a text is that token.
    Texts of common letters go through tiktoken's table of the same vocabulary, which is quicker; others, and those with special tokens, through tokenizers.
    plain_ids(): the same vocabulary for models that only need ids of some consistent kind; every string is ordinary text, and tokenizers is never loaded.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None, special: tuple[str, ...] = ("<|endoftext|>",)):
        import public_tokenizers
        import tiktoken

        self.path, self.special, self._whole = path, special, None
        with open(ranks or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def whole(self, text: str) -> list[int]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path or vocabulary_path())
        return self._whole.encode(text, add_special_tokens=False).ids

    def ids_of(self, text: str) -> bytes:
        if _OTHER.search(text) or any(x in text for x in self.special):
            return np.array(self.whole(text), "<u4").tobytes()
        return self.plain_ids(text)

    def plain_ids(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes() if text else b""


@lru_cache(maxsize=1)
def shared_bpe(path: str | None = None) -> ByteBpe:
    """One encoder a worker process."""
    return ByteBpe(path)
