"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

Every text is cut into words by the byte-level split pattern. A word's parts
are kept as one array of boundaries with a parallel array holding the merge
rank of each adjacent pair. The smallest rank is found by scanning (words are
short), the boundary between the two parts is deleted and the two neighbouring
ranks are refreshed, until no pair has a rank. Words met before come from a
bounded per-worker table.

Cases: a null text counts as empty (no tokens); an empty text gives no tokens
and an empty decoded text; a special token's literal inside a text is that
token, as in the tokenizers library; very long words (a run without a break)
use a heap of pairs in place of scanning, with the same result; repeated rows
are encoded row by row; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kestrel.llm.common import slices

# The byte-level split pattern. White space is spelled out, as the
# two regex libraries differ on the control characters 1C-1F.
_S = r"\t-\r\x20\x85\xa0  -     　"
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _S + r"\p{L}\p{N}]+"
         r"|[" + _S + r"]+(?![^" + _S + r"])|[" + _S + r"]+")
# Bytes (about) of each of a worker's two tables of words; when the newer is full it takes the older
# one's place. An entry costs its texts and about so much besides.
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 200
# Words of more bytes are merged with a heap instead of scans.
SCAN_BYTES = 256
NO_RANK = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: bytes that print
    stand for themselves, the others take the code points from 256 on, in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Bpe:
    """Encoder and decoder for one byte-level BPE vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: i for i, c in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {
            i: bytes(back[c] for c in tok) for tok, i in vocab.items()}
        ids = {b: i for i, b in self.token_bytes.items()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pair[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode("utf-8")
        self.special_re = regex.compile("|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.find = regex.compile(SPLIT).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_bytes, self.held = cache_bytes, 0

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        if len(word) > SCAN_BYTES:
            return self._merge_long(word)
        parts = [self.byte_id[b] for b in word]
        pair = self.pair.get
        none = (NO_RANK, 0)
        adj = [pair(p, none) for p in zip(parts, parts[1:])]
        while adj:
            best = min(adj)
            if best[0] == NO_RANK:
                break
            i = adj.index(best)
            parts[i: i + 2] = [best[1]]
            del adj[i]
            if i < len(adj):
                adj[i] = pair((parts[i], parts[i + 1]), none)
            if i:
                adj[i - 1] = pair((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        """The same merges for a long word: pairs wait in a heap by (rank, place)."""
        n = len(word)
        tok = [self.byte_id[b] for b in word]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pair.get
        heap = [(r[0], i, tok[i], tok[i + 1], r[1]) for i in range(n - 1) if (r := pair((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i] if tok[i] == a else n
            if j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if r := pair((new, tok[nxt[i]])):
                    heapq.heappush(heap, (r[0], i, new, tok[nxt[i]], r[1]))
            if prv[i] >= 0 and (r := pair((tok[prv[i]], new))):
                heapq.heappush(heap, (r[0], prv[i], tok[prv[i]], new, r[1]))
        return [t for t in tok if t >= 0]

    def _word(self, word: str) -> bytes:
        out = self.older.get(word) or np.array(self.merge(word.encode("utf-8")), dtype="<u4").tobytes()
        size = ENTRY_BYTES + len(word) + len(out)
        if self.held + size > self.cache_bytes:
            self.older, self.cache, self.held = self.cache, {}, 0
        if size <= self.cache_bytes:
            self.cache[word] = out
            self.held += size
        return out

    def _plain(self, text: str) -> list[bytes]:
        get, word = self.cache.get, self._word
        return [get(w) or word(w) for w in self.find(text)]

    def encode_bytes(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        if self.special_re is None or not any(s in text for s in self.special):
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += self._plain(text[at: m.start()])
            out.append(np.array([self.special[m[0]]], dtype="<u4").tobytes())
            at = m.end()
        return b"".join(out + self._plain(text[at:]))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are no UTF-8 become the replacement character."""
        t = self.token_bytes
        return b"".join([t[i] for i in ids]).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def worker_bpe(path: str) -> Bpe:
    """The vocabulary, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row: the encoding as data for later steps. ``path`` is the
    vocabulary file on each executor."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for batch in batches:
            for part in slices(batch):
                ids = [np.frombuffer(bpe.encode_bytes(t or ""), dtype="<i4") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of token ids; null ids count as none."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for batch in batches:
            for part in slices(batch):
                text = [bpe.decode(x or ()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row in one pass; keep counts and digests only, so that neither ids
    nor texts leave the task: (id, n_tokens, ids_sha256, decoded_sha256)."""
    schema = (f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, "
              "ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch):
                n, a, b = [], [], []
                for text in part.column(1).to_pylist():
                    ids = bpe.encode_bytes(text or "")
                    n.append(len(ids) // 4)
                    a.append(sha(ids).hexdigest())
                    back = bpe.decode(np.frombuffer(ids, dtype="<u4").tolist())
                    b.append(sha(back.encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
