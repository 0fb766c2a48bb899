"""Token counts by heap-and-linked-list byte-pair merging.

A text is split as the byte-level scheme splits it; each piece starts as
a linked list of byte symbols, and the adjacent pair of the lowest rank
is merged again and again (the leftmost first among equals). The count is
the number of symbols at the start less the number of merges; no token
identifiers are made.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern of the public byte-level scheme.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where chunks may not be cut at spaces: a space with white space on both sides, or after white space at the end.
_RUN = re.compile(r"\s \s|\s \Z")
#: Entries of one generation of a worker's cache, and the longest key that it keeps.
CACHE, LONGEST = 200_000, 64


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Generations(dict):
    """A mapping that computes missing values and holds at most two generations of them."""

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Merger:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.start = [vocab[s] for s in byte_symbols()]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        special = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN).findall
        self.words = Generations(self.piece)
        self.chunks = Generations(self.chunk)
        self.spaced = self.chunks.__getitem__

    def piece(self, text: str) -> int:
        """Tokens of one piece of the split."""
        ids = [self.start[b] for b in text.encode("utf-8")]
        n = count = len(ids)
        if n < 2:
            return n
        pairs = self.pairs
        heap = []
        for i in range(n - 1):
            if found := pairs.get(ids[i] << 32 | ids[i + 1]):
                heap.append(found[0] << 32 | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = pairs.get(ids[i] << 32 | ids[j])
            if found is None or found[0] != top >> 32:
                continue
            ids[i], ids[j] = found[1], -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get(ids[i] << 32 | ids[k]):
                    heapq.heappush(heap, found[0] << 32 | i)
            h = before[i]
            if h >= 0 and (found := pairs.get(ids[h] << 32 | ids[i])):
                heapq.heappush(heap, found[0] << 32 | h)
        return count

    def chunk(self, text: str) -> int:
        """Tokens of a chunk that follows a space, with that space."""
        words = self.words
        return sum([words[p] for p in self.split(" " + text)])

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        The split never joins what stands on both sides of a single space
        before a visible character, so chunks between spaces are counted
        one by one, from the cache; where white space stands in runs that
        a cut could change, the whole text is split at once.
        """
        if not text:
            return 0
        if _RUN.search(text):
            return self.whole(text)
        first, _, rest = text.partition(" ")
        return (self.whole(first) if first else 0) + (sum(map(self.spaced, rest.split(" "))) if _ else 0)

    def whole(self, text: str) -> int:
        """Tokens of a text that is split at once."""
        words = self.words
        return sum([words[p] for p in self.split(text)])

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special string in it is one token, as is the library's default."""
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One merger for each vocabulary and Python worker."""
    return Merger(path)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Count the tokens of every whole text; one row for each row, no shuffle.

    Returns the id column as ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``
    and ``over_limit``. A null text counts as empty (0 bytes, 0 tokens), a
    repeated row is counted again, a null id stays null, an empty table
    gives an empty result, and further columns, whatever their names, are
    not read. A text of any length is counted whole; ties do not arise. A
    worker remembers counts of pieces and chunks of at most ``LONGEST``
    characters, so its memory is bounded whatever the texts.
    """
    own = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(path).count
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return own.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
