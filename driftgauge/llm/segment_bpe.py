"""Operator 7, BPE encoding and decoding with a segment tree.

The leaves of the tree are the ranks of adjacent symbol pairs, each inner node the
smaller (rank, place) of its two. So the root is the leftmost pair of lowest rank;
a merge changes two leaves and removes one, in logarithmic time each, until the
root holds no mergeable pair. A run of letters as long as a whole document takes
n log n steps.

White space separates words for good in this tokenizer (it is dropped), so a text's
ids are those of its white-space-delimited chunks, and chunks repeat: a worker
keeps the first 300,000 it meets. Decoding joins the ids' token strings with a
space, as the library does for a file that names no decoder.

A document is worked on alone: no shuffle, no state but the bounded cache.

Edge cases: null and empty texts have no ids and decode to the empty text; special
tokens' strings inside a text are those tokens, as is the library's default; ties,
repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .common import table, text_of

JSON = "word_bpe_49k.json"
CACHE_CHUNKS = 300_000
#: What str.split() takes for white space and Unicode's White_Space property doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
TYPE = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


def merge_word(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges to a word. pairs: (left, right) -> (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1
    while size < n:
        size *= 2
    none = 1 << 62
    tree = [none] * (2 * size)  # a leaf is rank * size + place
    get = pairs.get
    for i in range(n - 1):
        if (p := get((symbols[i], symbols[i + 1]))) is not None:
            tree[size + i] = p[0] * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != none:
        i = root % size
        j = after[i]
        symbols[i] = pairs[symbols[i], symbols[j]][1]
        symbols[j] = -1
        after[i] = k = after[j]
        put(j, none)
        if k < n:
            before[k] = i
            p = get((symbols[i], symbols[k]))
            put(i, none if p is None else p[0] * size + i)
        else:
            put(i, none)
        if (h := before[i]) >= 0:
            p = get((symbols[h], symbols[i]))
            put(h, none if p is None else p[0] * size + h)
    return [s for s in symbols if s >= 0]


class WordBPE:
    def __init__(self, file: str):
        import regex

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + self.suffix] for s in symbols]
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            data = word.encode()
            found = merge_word([*(self.inner[b] for b in data[:-1]), self.last[data[-1]]], self.pairs)
            if len(self.words) < CACHE_CHUNKS and len(word) <= 64:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, decimal ids, tokens of a chunk without white space."""
        text = unicodedata.normalize("NFC", chunk)
        # Characters are lowered one by one, without the rule for a final sigma.
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        ids = [i for w in self.pieces(text) for i in self.word(w)]
        found = len(ids), " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))
        if len(self.chunks) < CACHE_CHUNKS and len(chunk) <= 64:
            self.chunks[chunk] = found
        return found

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        pieces = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        out: list[tuple[int, str, str]] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                i = self.special[piece]
                out.append((1, str(i), piece))
                continue
            chunks = [c for c in _WHITE.split(piece) if c] if _SEPARATORS.search(piece) else piece.split()
            got = list(map(self.chunks.get, chunks))
            if None in got:
                got = [self.chunk(c) if g is None else g for c, g in zip(chunks, got)]
            out += got
        return [x for x in out if x[0]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids if i in self.token)

    def digests(self, text: str) -> tuple[int, str, str]:
        parts = self.parts(text)
        sha = [hashlib.sha256(" ".join([p[i] for p in parts]).encode()).hexdigest() for i in (1, 2)]
        return sum(p[0] for p in parts), sha[0], sha[1]


@functools.lru_cache(maxsize=2)
def word_bpe(json_name: str) -> WordBPE:
    return WordBPE(vocab.path(json_name))


def encode_ids(json_name: str = JSON):
    """A column function: text -> array of ids."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = word_bpe(json_name)
        for b in batches:
            yield pa.array([bpe.encode(t) for t in b.to_pylist()], pa.list_(pa.int32()))

    return run


def decode_ids(json_name: str = JSON):
    """A column function: array of ids -> text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = word_bpe(json_name)
        for b in batches:
            yield pa.array([bpe.decode(i or []) for i in b.to_pylist()], pa.string())

    return run


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_name: str = JSON) -> DataFrame:
    """id, n_tokens and the digests of the ids and of the decoded text; ids never leave the worker."""

    @F.arrow_udf(TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = word_bpe(json_name)
        for b in batches:
            n, ids, decoded = zip(*map(bpe.digests, b.to_pylist())) if len(b) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), run(text_of(text_col)).alias("_r")).select(id_col, "_r.*")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))
