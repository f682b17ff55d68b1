"""Byte-level BPE: encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{O}]+|\s+(?!\S)|\s+"
#: Letters and numbers that are assigned in newer Unicode versions only, which the tokenizer takes as signs.
YOUNG = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81
1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f
"""
CACHE = 300_000
_NONE = np.int64(1) << 40


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: visible Latin-1 characters for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """A vocabulary, and the trees that apply its merges. Built on the driver; its size is that of the vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model, letters = content["model"], byte_letters()
        vocab = model["vocab"]
        back = {c: b for b, c in letters.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = max(self.bytes_of) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[order, 0]
        self.cache: dict[str, bytes] = {}
        self.split = None

    def ready(self) -> None:
        if self.split is None:
            self.split = regex.compile(WORDS.format(L=r"\p{L}", N=r"\p{N}", O=r"\p{L}\p{N}"))
            young = "".join("-".join(f"\\U{int(x, 16):08x}" for x in span.split("-")) for span in YOUNG.split())
            self.careful = regex.compile(WORDS.format(L=rf"[\p{{L}}--[{young}]]", N=rf"[\p{{N}}--[{young}]]", O=rf"[[\p{{L}}\p{{N}}]--[{young}]]"), regex.V1)
            self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; _NONE where the pair has no merge or one side is missing (-1)."""
        key = np.where((a < 0) | (b < 0), -1, a * self.base + b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers. Words are worked through together, in groups of like length."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for size, members in groups.items():
            step = max(1, (1 << 17) // size)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], size: int) -> list[bytes]:
        """One tree a row, `size` leaves: leaf p holds the rank of the pair that starts at p, tied with p, and each node the
        smallest of its two children. So the root names the leftmost pair of lowest rank; a merge changes three leaves and
        the nodes above them."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        here = np.arange(size)
        inside = here < lengths[:, None]
        symbols = np.full((n, size), -1, np.int64)
        symbols[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after = np.where(here + 1 < lengths[:, None], here + 1, size)
        before = np.broadcast_to(here - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), _NONE * size, np.int64)
        tree[:, size : 2 * size - 1] = self.rank(symbols[:, :-1], symbols[:, 1:]) * size + here[:-1]
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        none = _NONE * size
        rows = np.arange(n)
        while True:
            rows = rows[tree[rows, 1] < none]
            if not len(rows):
                break
            root = tree[rows, 1]
            p, r = root % size, root // size
            q = after[rows, p]
            end = after[rows, q]
            symbols[rows, p] = self.merged[r]
            symbols[rows, q] = -1
            after[rows, p] = end
            has = end < size
            before[rows[has], end[has]] = p[has]
            left = before[rows, p]
            lead = left >= 0
            follow = np.where(has, symbols[rows, np.minimum(end, size - 1)], -1)
            ahead = np.where(lead, symbols[rows, left], -1)
            self._point(tree, size, rows, q, np.full(len(rows), none))
            self._point(tree, size, rows, p, self.rank(self.merged[r], follow) * size + p)
            self._point(tree, size, rows[lead], left[lead], (self.rank(ahead, self.merged[r]) * size + left)[lead])
        kept = symbols >= 0
        flat, ends = symbols[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    @staticmethod
    def _point(tree: np.ndarray, size: int, rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + size
        tree[rows, node] = value
        while size > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            size //= 2

    def words(self, text: str) -> list[str]:
        """A text cut before its merges."""
        return (self.split if text.isascii() or max(map(ord, set(text))) < 0x558 else self.careful).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; the strings of special tokens become these."""
        self.ready()
        parts: list[list[str | int]] = []
        for text in texts:
            own: list[str | int] = []
            for piece in self.marks.split(text) if self.marks and any(t in text for t in self.special) else [text]:
                if piece in self.special:
                    own.append(self.special[piece])
                else:
                    own.extend(self.words(piece))
            parts.append(own)
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list({w for own in parts for w in own if w.__class__ is str} - self.cache.keys())
        known = self.cache
        known.update(zip(new, self.encode_words([w.encode() for w in new]), strict=True))
        return [b"".join([known[w] if w.__class__ is str else w.to_bytes(4, "little") for w in own]) for own in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def bpe_encoding(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, ids (array, if with_ids), n_tokens, ids_sha256, decoded, decoded_sha256.

    `path` names the vocabulary file, a byte-level BPE with merges in order of rank; it is read once, on the driver, and its
    content goes to the tasks. Whole texts are encoded; null counts as empty. An empty text has no ids. The string of a special
    token becomes that token. ids_sha256 is over the ids as little-endian unsigned 32-bit numbers, decoded_sha256 over the
    UTF-8 of the decoded text, which equals the text. Without with_ids the two long columns are left out.
    """
    merges = docs.sparkSession.sparkContext.broadcast(Merges(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merges.value
        for batch in batches:
            for lo, hi in _slices(batch.column("text")):
                texts = [t or "" for t in batch.column("text")[lo:hi].to_pylist()]
                coded = own.encode(texts)
                ids = [np.frombuffer(c, "<u4") for c in coded]
                decoded = [own.decode(i) for i in ids]
                cols = [
                    batch.column("doc_id")[lo:hi], pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                if with_ids:
                    bounds = pa.array(np.cumsum([0] + [len(i) for i in ids]), pa.int32())
                    cols += [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ids).astype(np.int32))), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def _slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes."""
    lengths = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(lengths, int(lengths[row]) + size, "right")) - 1)
        yield row, last
        row = last
