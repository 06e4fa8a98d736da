"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is cut into pre-tokens; each knows its length and its number of tokens.
Pre-tokens are kept in buckets, and a segment tree over the buckets holds the
sums of lengths and tokens. An edit finds its place by descending the tree,
cuts the text anew from a little before the edit until a cut falls on an old
one behind it, encodes only the pre-tokens in between, and updates the sums on
the paths above the buckets it touched.

The cut of a text depends only on what stands to its right, and looks ahead at
most two characters (or the length of a special token), so that much context
before the edit is enough.

Cases: a null text counts as empty; null edits, or an empty list, change
nothing; an edit's place is moved into the text, its removal ends with the
text, a null insertion is empty; a special token's literal is one token, also
if an edit makes or breaks it; repeated rows are counted one by one; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.bpe import ENTRY_BYTES, SPLIT, _S, Bpe, worker_bpe
from kestrel.llm.common import ddl, id_text, slices

BUCKET = 64
# Bytes (about) of each of a worker's two tables of words, as in the encoder.
CACHE_BYTES = 24 << 20


class Counter:
    """Pre-tokens of a text and the number of tokens of each."""

    def __init__(self, bpe: Bpe, cache_bytes: int = CACHE_BYTES) -> None:
        self.bpe, self.cache_bytes, self.held = bpe, cache_bytes, 0
        self.cache: dict[str, int] = dict.fromkeys(bpe.special, 1)
        self.older: dict[str, int] = {}
        # The split pattern over a whole text: a special token's literal is cut out first, and what
        # stands before it is split as if the text ended there.
        literal = "|".join(regex.escape(s) for s in sorted(bpe.special, key=len, reverse=True))
        if literal:
            other = "[^" + _S + r"\p{L}\p{N}]"
            blank = "[" + _S + "]"
            pattern = (f"(?:{literal})" + r"|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
                       + f"| ?(?:(?!{literal}){other})+|{blank}+(?:(?={literal})|(?!{'[^' + _S + ']'}))|{blank}+")
        else:
            pattern = SPLIT
        self.pattern = regex.compile(pattern)
        self.plain = regex.compile(SPLIT).findall
        self.context = 1 + max([2, *map(len, bpe.special)])

    def split(self, text: str) -> list[str]:
        if any(s in text for s in self.bpe.special):
            return self.pattern.findall(text)
        return self.plain(text)

    def tokens(self, word: str) -> int:
        n = self.cache.get(word)
        if n is None:
            n = self.older.get(word) or len(self.bpe.merge(word.encode("utf-8")))
            size = ENTRY_BYTES + len(word)
            if self.held + size > self.cache_bytes:
                self.older, self.cache, self.held = self.cache, dict.fromkeys(self.bpe.special, 1), 0
            if size <= self.cache_bytes:
                self.cache[word] = n
                self.held += size
        return n


class TokenTree:
    """The pre-tokens of one text under a segment tree."""

    def __init__(self, counter: Counter, text: str, leaves: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.counter, self.text = counter, text
        if leaves is None:
            words = counter.split(text)
            get, count = counter.cache.get, counter.tokens
            leaves = (np.fromiter(map(len, words), np.int64, len(words)),
                      np.fromiter([get(w) or count(w) for w in words], np.int64, len(words)))
        self.reencoded = 0
        self._build(*leaves)

    def _build(self, size: np.ndarray, tokens: np.ndarray) -> None:
        """Buckets of the leaves and the sums above them."""
        at = range(0, max(1, len(size)), BUCKET)
        self.buckets = [(size[i: i + BUCKET], tokens[i: i + BUCKET]) for i in at]
        self.width = 1 << (len(self.buckets) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        if len(size):
            self.sums[self.width: self.width + len(self.buckets), 0] = np.add.reduceat(size, at)
            self.sums[self.width: self.width + len(self.buckets), 1] = np.add.reduceat(tokens, at)
        low = self.width
        while low > 1:
            self.sums[low // 2: low] = self.sums[low: 2 * low].reshape(-1, 2, 2).sum(axis=1)
            low //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_leaves(self) -> int:
        return sum(len(s) for s, _ in self.buckets)

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([s for s, _ in self.buckets]), np.concatenate([t for _, t in self.buckets])

    def _bucket_at(self, place: int) -> tuple[int, int]:
        """(bucket that holds the character at ``place``, or the last one; the bucket's start)."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.width, len(self.buckets) - 1), start

    def edit(self, place: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``place`` on by ``inserted``."""
        old = self.text
        place = min(max(0, place), len(old))
        removed = min(max(0, removed), len(old) - place)
        text = self.text = old[:place] + inserted + old[place + removed:]
        shift = len(inserted) - removed
        first, start = self._bucket_at(max(0, place - self.counter.context))
        size, tokens = self.buckets[first]
        # Leaves that end early enough before the edit keep their cut.
        ends = start + np.cumsum(size)
        keep = int(np.searchsorted(ends, place - self.counter.context, side="right"))
        at = int(ends[keep - 1]) if keep else start
        new_size, new_tokens = list(size[:keep]), list(tokens[:keep])
        last = first
        behind = iter(ends[keep:].tolist())
        cut = at
        rest = None
        old_end = next(behind, None)
        leaf = keep
        for m in self.counter.pattern.finditer(text, at) if at < len(text) else ():
            new_size.append(m.end() - m.start())
            new_tokens.append(self.counter.tokens(m[0]))
            self.reencoded += 1
            cut = m.end()
            if cut < place + len(inserted):
                continue
            # Move along the old cuts up to this one; equal places mean the rest is unchanged.
            while old_end is None or old_end + shift < cut:
                if old_end is None:
                    if last + 1 >= len(self.buckets):
                        break
                    begin = int(ends[-1]) if len(ends) else start
                    last += 1
                    size, tokens = self.buckets[last]
                    ends, start, leaf = begin + np.cumsum(size), begin, -1
                    behind = iter(ends.tolist())
                else:
                    leaf += 1
                old_end = next(behind, None)
                if leaf < 0:
                    leaf = 0
            if old_end is not None and old_end + shift == cut and old_end >= place + removed:
                rest = leaf + 1
                break
        if rest is None:  # cut anew up to the end of the text
            last, rest = len(self.buckets) - 1, len(self.buckets[-1][0])
        new_size += list(self.buckets[last][0][rest:])
        new_tokens += list(self.buckets[last][1][rest:])
        self._replace(first, last, np.array(new_size, np.int64), np.array(new_tokens, np.int64))

    def _replace(self, first: int, last: int, size: np.ndarray, tokens: np.ndarray) -> None:
        """Put leaves in place of the buckets first .. last and update the sums above them."""
        n = last - first + 1
        if len(size) > 4 * BUCKET * n:
            old_size = [s for s, _ in self.buckets[:first]], [s for s, _ in self.buckets[last + 1:]]
            old_tokens = [t for _, t in self.buckets[:first]], [t for _, t in self.buckets[last + 1:]]
            self._build(np.concatenate([*old_size[0], size, *old_size[1]]),
                        np.concatenate([*old_tokens[0], tokens, *old_tokens[1]]))
            return
        for i, (s, t) in enumerate(zip(np.array_split(size, n), np.array_split(tokens, n))):
            self.buckets[first + i] = (s, t)
            self.sums[self.width + first + i] = (s.sum(), t.sum())
        lo, hi = (self.width + first) // 2, (self.width + last) // 2
        while lo:
            self.sums[lo: hi + 1] = self.sums[2 * lo: 2 * hi + 2].reshape(-1, 2, 2).sum(axis=1)
            lo, hi = lo // 2, hi // 2


_COUNTERS: dict[str, Counter] = {}


def worker_counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(worker_bpe(path))
    return _COUNTERS[path]


def _apply(tree: TokenTree, edits) -> None:
    for e in edits or ():
        if e is not None:
            tree.edit(int(e["place"] or 0), int(e["removed"] or 0), e["inserted"] or "")


def trees(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sizes, tokens): every document with its leaves, to be stored and edited later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for batch in batches:
            for part in slices(batch):
                built = [TokenTree(counter, t or "") for t in part.column(1).to_pylist()]
                leaves = [t.leaves() for t in built]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t.text for t in built], pa.string()),
                     pa.array([s for s, _ in leaves], pa.list_(pa.int64())),
                     pa.array([t for _, t in leaves], pa.list_(pa.int64()))], [id_col, "text", "sizes", "tokens"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"{ddl(df, [id_col])}, text string, sizes array<bigint>, tokens array<bigint>")


def edit_trees(stored: DataFrame, path: str, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """Apply each row's edits (array of struct place, removed, inserted, one after the other) to a
    stored tree: the same columns, and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, size, tokens, edits in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                    tree = TokenTree(counter, text, (np.array(size, np.int64), np.array(tokens, np.int64)))
                    _apply(tree, edits)
                    out.append((tree.text, *tree.leaves(), tree.n_tokens))
                text, size, tokens, n = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(text, pa.string()), pa.array(size, pa.list_(pa.int64())),
                     pa.array(tokens, pa.list_(pa.int64())), pa.array(n, pa.int64())],
                    [id_col, "text", "sizes", "tokens", "n_tokens"])

    return stored.select(id_col, "text", "sizes", "tokens", edits_col).mapInArrow(
        run, f"{ddl(stored, [id_col])}, text string, sizes array<bigint>, tokens array<bigint>, n_tokens bigint")


def count_edits(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Build every document's tree and apply its edits in the same pass, keeping only counts:
    id, n_pretokens, n_tokens (before), n_tokens_edited, n_reencoded (pre-tokens encoded by edits)."""
    names = ["n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, edits in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    tree = TokenTree(counter, text or "")
                    was = (tree.n_leaves, tree.n_tokens)
                    _apply(tree, edits)
                    rows.append((*was, tree.n_tokens, tree.reencoded))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows)]], [id_col, *names])

    return df.select(id_col, text_col, edits_col).mapInArrow(
        run, ddl(df, [id_col]) + "".join(f", {n} bigint" for n in names))


def derived_edits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three edits per document, fixed by its id and made of its own text: a passage is copied to
    another place, a few characters are removed, a few are replaced."""
    h = F.crc32(id_text(id_col).cast("binary"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.char_length(text)

    def place(step: int) -> Column:
        return (F.floor(h / step) % (n + 1)).cast("int")

    def edit(at: Column, removed: int, inserted: Column) -> Column:
        return F.struct(at.alias("place"), F.lit(removed).alias("removed"), inserted.alias("inserted"))

    return F.array(edit(place(1), 0, F.substring(text, place(7) + 1, F.lit(24))),
                   edit(place(11), 10, F.lit("")),
                   edit(place(13), 6, F.concat(F.lit(" "), F.substring(text, place(17) + 1, F.lit(9)))))
