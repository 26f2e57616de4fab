"""Byte-level BPE with a bounded cache of space-delimited chunks.

In the byte-level pattern a single space between two other characters always
begins a pre-token, and no pre-token holds such a space further in. So a text is
the concatenation of its chunks, each encoded with its leading space, and a chunk's
ids never depend on its neighbours. Chunks repeat, so most of them are a dictionary
look-up. A text with any other run of white space next to a space is split by a
pattern that looks at both neighbours instead.

Chunks of common scripts go to tiktoken's core over the same merge ranks, which is
several times faster; any chunk with a character from U+0370 on goes to the
``tokenizers`` library itself. The tests hold both against that library.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
import struct

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SINGLE_SPACE = re.compile(r"(?<!\s) (?!\s)")
_FAR = re.compile("[Ͱ-\U0010ffff]")
#: Entries of a worker's cache: about 100 MB.
CACHE_CHUNKS = 500_000


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(file: str, version: str = "1") -> str:
    """Digest of the tokenizer's file, of this encoder's version and of the libraries it uses: a key of the cache."""
    import tiktoken
    import tokenizers

    h = hashlib.sha256(f"{version} tokenizers {tokenizers.__version__} tiktoken {tiktoken.__version__}".encode())
    with open(file, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


class ByteBPE:
    """ids of whole texts as ``Tokenizer.from_file(json).encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, json_file: str, ranks_file: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_file)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.core = None
        if ranks_file:
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.chunks: dict[str, bytes] = {}
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(65)]

    def _pack(self, text: str) -> bytes:
        if self.core is not None and not _FAR.search(text):
            ids = self.core.encode_ordinary(text)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return self.packers[len(ids)](*ids) if len(ids) <= 64 else struct.pack(f"<{len(ids)}I", *ids)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        got = list(map(self.chunks.get, rest))
        if (first and first[-1].isspace()) or not self._fill(rest, got):
            first, *rest = _SINGLE_SPACE.split(text)
            got = [self._pack(" " + x) for x in rest]
        return self._pack(first) + b"".join(got) if first else b"".join(got)

    def _fill(self, rest: list[str], got: list[bytes | None]) -> bool:
        """Encode the chunks that aren't in the cache. False if a chunk begins or ends with
        white space or is empty. A full cache stays as it is: frequent chunks come early."""
        chunks, pack, i = self.chunks, self._pack, -1
        room = CACHE_CHUNKS - len(chunks)
        try:
            while True:
                i = got.index(None, i + 1)
                x = rest[i]
                if not x or x[0].isspace() or x[-1].isspace():
                    return False
                got[i] = y = pack(" " + x)
                if room > 0 and len(x) <= 64:
                    chunks[x] = y
                    room -= 1
        except ValueError:
            return True

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not any(s in text for s in self.special):
            return self._ordinary(text)
        out = []
        for i, part in enumerate(self.split_special.split(text)):
            out.append(struct.pack("<I", self.special[part]) if i % 2 else self._ordinary(part))
        return b"".join(out)


@functools.lru_cache(maxsize=4)
def byte_bpe(json_name: str, ranks_name: str | None) -> ByteBPE:
    """One encoder for each Python worker."""
    return ByteBPE(path(json_name), ranks_name and path(ranks_name))
