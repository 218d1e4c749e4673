"""Token ids of a public byte-level BPE vocabulary, by speculation and verification.

A text is cut into words by the vocabulary's pattern. For each new word the longest known prefix is
taken again and again, which proposes tokens in one pass. A sequence of tokens is what merging would
give exactly if every two neighbours are what merging gives for the two of them; that is tested for all
neighbours of all new words at once, on arrays. Words that fail are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT_DIRECTORY = "/opt/tokenizers"
#: words kept with their ids in a worker; beyond it the store starts anew
CACHED_WORDS = 400_000
#: characters encoded before a batch is handed on
CHUNK_CHARACTERS = 2_000_000
# fixed value: the pattern the public vocabulary was made with
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Ranks of byte strings, with the last merge of each token."""

    def __init__(self, ranks: dict[bytes, int], left: np.ndarray, right: np.ndarray):
        self.ranks, self.left, self.right = ranks, left, right
        merged = np.flatnonzero(left != np.arange(left.size))
        keys = left[merged].astype(np.int64) * left.size + right[merged]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], merged[order]
        self.longest = [0] * 256
        for b in ranks:
            self.longest[b[0]] = max(self.longest[b[0]], len(b))

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the adjacent pair of lowest rank, the leftmost of equals."""
        ranks, n = self.ranks, len(word)
        if n < 2:
            return [ranks[word]] if n else []
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = end[i] if alive[i] else n
            if j >= n or not alive[i] or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(queue, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def longest_match(self, word: bytes) -> list[int]:
        ranks, out, i, n = self.ranks, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest[word[i]]), i, -1):
                if (r := ranks.get(word[i:j])) is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging the text of each two tokens gives just these two.

        Both tokens are undone step by step, the later merge first. At each step the pieces that meet
        at the border must not have a merge that would have come before the one just undone.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        good = np.ones(a.size, dtype=bool)
        limit = np.full(a.size, np.iinfo(np.int64).max)
        live = np.arange(a.size)
        while live.size:
            x, y = a[live], b[live]
            key = x * self.left.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), self.pair_keys.size - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_ids[at] < limit[live])
            good[live[clash]] = False
            # a pair to the right that was merged at the same rank would have come later, hence the + 1
            can_a, can_b = self.left[x] != x, self.left[y] != y
            undo_a = can_a & ((x > y) | ~can_b)
            undo_b = can_b & ~undo_a
            limit[live] = np.where(undo_a, x, y + 1)
            a[live] = np.where(undo_a, self.right[x], x)
            b[live] = np.where(undo_b, self.left[y], y)
            live = live[~clash & (undo_a | undo_b)]
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        proposed = [[r] if (r := self.ranks.get(w)) is not None else self.longest_match(w) for w in words]
        sizes = np.array([len(p) for p in proposed], dtype=np.int64)
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(sizes.sum()))
        word_of = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(word_of[1:] == word_of[:-1]) if flat.size else np.zeros(0, dtype=np.int64)
        for w in np.unique(word_of[inner[~self.compatible(flat[inner], flat[inner + 1])]]):
            proposed[w] = self.merge(words[w])
        return proposed


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


@lru_cache(4)
def load_vocabulary(path: str) -> Vocabulary:
    """Reads a .tiktoken file; the last merge of a token is what merging with lower ranks leaves of its bytes."""
    ranks = read_ranks(Path(path).read_bytes())
    n = max(ranks.values()) + 1
    left, right = np.arange(n), np.arange(n)
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min((ranks.get(parts[i] + parts[i + 1], n), i) for i in range(len(parts) - 1))
                if best >= rank:
                    raise ValueError(f"token {rank} can't be reached by merging")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
    return Vocabulary(ranks, left, right)


class _Worker:
    """The vocabulary and the word store of a Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary, self.find, self.known = vocabulary, regex.compile(PATTERN).findall, {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = list({w for words in cut for w in words if w not in self.known})
        self.known.update(zip(new, self.vocabulary.encode_words([w.encode("utf-8", "replace") for w in new])))
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]


_worker: list = []


def _worker_for(shared) -> _Worker:
    if not _worker or _worker[0] != shared.id:
        ranks, left, right = shared.value
        _worker[:] = [shared.id, _Worker(Vocabulary(ranks, left, right))]
    return _worker[1]


class _Shared:
    """A broadcast vocabulary (about 1 MB, the size of its file) under a name of its own."""

    def __init__(self, spark: SparkSession, path: str):
        v = load_vocabulary(path)
        self.id, self._b = path, spark.sparkContext.broadcast((v.ranks, v.left, v.right))

    @property
    def value(self):
        return self._b.value


def tokenizer_path(directory: str, name: str) -> str:
    return str(Path(directory) / f"{name}.tiktoken")


def encode_column(spark: SparkSession, df: DataFrame, text: str, keep: list[str], out: str = "ids", count_only: bool = False, tokenizer: str = "byte_bpe_50k", directory: str = DEFAULT_DIRECTORY) -> DataFrame:
    """keep columns and the token ids of `text` (array<int>), or with count_only their number (bigint).

    Texts that spell a special token are ordinary text. Null and empty texts give an empty list or 0;
    whole texts are encoded, however long; rows are neither joined nor reordered. Columns of df that
    aren't kept, whatever their names, play no part.
    """
    shared = _Shared(spark, tokenizer_path(directory, tokenizer))
    source = df.select(*keep, df[text].cast("string").alias("_text"))
    schema = source.drop("_text").schema.add(out, T.LongType() if count_only else T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker_for(shared)
        for batch in batches:
            texts = batch.column("_text")
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(lengths) // CHUNK_CHARACTERS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for start, stop in zip(edges, edges[1:]):
                ids = worker.encode(texts.slice(start, stop - start).to_pylist())
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                if count_only:
                    column = pa.array(sizes)
                else:
                    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(sizes.sum()))
                    column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
                rows = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), column], names=[*keep, out])

    return source.mapInArrow(run, schema)
