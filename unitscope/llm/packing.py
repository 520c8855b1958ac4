"""Packing token sequences with balanced attention cost.

A document costs ``LINEAR * n + QUADRATIC * n * n`` for ``n`` tokens in one sequence, since
attention stays inside a document. Documents of a task are gathered to ``GROUP_TOKENS`` and
then assigned in descending length: each to the sequence with the lowest cost so far that has
room for it. A document longer than a sequence gives full sequences first. What fits
nowhere whole fills the room that is left, largest room first. Sequences that are not full
wait for the next group, so a task has padding once, and there the tokens that are left
go into sequences of powers of two, which are not padded at all.

Nothing is shuffled: a task packs what it reads, in bounded memory, and its number is part
of the sequence ids, so a lost task gives the same pieces again.

Defined results: a null or empty text is the end token alone. Rows are packed each for itself, repeated ids
too. An empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from unitscope.llm.common import small_batches, table
from unitscope.llm.registry import query

LENGTH = 4096
END = 2
_END = np.array([END], dtype="<u4").tobytes()
GROUP_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CACHE_WORDS = 300_000
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Encoder:
    """Token ids of whole texts by a tokenizer file whose tokens never cross white space.

    Words are encoded once and remembered, as little-endian bytes of their ids, in two
    generations of ``CACHE_WORDS``. New ones are encoded together, between marks that none of them holds.
    """

    MARK = "~"
    #: Marks that, in runs at the end of a word, are encoded by themselves behind a letter.
    ENDS = ".,;:!?$#*%&"

    def __init__(self, path: str) -> None:
        # Spark keeps the cores busy; threads in each task cost time and memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        (self.mark,) = self._ids(self.MARK)
        self.ends: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._ids(text), dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        known, old, ends = self.known, self.old, self.ends
        split = []
        stems = set()
        for w in words:
            if w in old:
                known[w] = old[w]
                continue
            stem = w.rstrip(self.ENDS)
            # letters beyond these may be lowered to a letter and a mark
            if len(stem) == len(w) or not stem or stem[-1] > "\xff" or not stem[-1].isalpha():
                stems.add(w)
                continue
            split.append((w, stem))
            if stem not in known:
                if stem in old:
                    known[stem] = old[stem]
                else:
                    stems.add(stem)
        odd = [w for w in stems if self.MARK in w]
        plain = list(stems.difference(odd)) if odd else list(stems)
        for w in odd:
            known[w] = self._bytes(w)
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        between = f" {self.MARK} "
        made = self.tokenizer.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, made):
            ids = np.array(encoding.ids, dtype="<u4")
            cuts = 4 * np.flatnonzero(ids == self.mark)
            if len(cuts) != len(group) - 1:
                raise ValueError("the tokenizer does not keep words apart")
            raw = ids.tobytes()
            lo = 0
            for w, hi in zip(group, [*cuts.tolist(), len(raw)]):
                known[w] = raw[lo:hi]
                lo = hi + 4
        for w, stem in split:
            end = w[len(stem) :]
            if end not in ends:
                if len(ends) >= 10_000:
                    ends.clear()
                ends[end] = self._bytes(end)
            known[w] = known[stem] + ends[end]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text and the end token."""
        parts = []
        for t in texts:
            t = t or ""
            with contextlib.suppress(UnicodeEncodeError):
                # the tokenizer lowers letters too, so fewer words are new; beyond these
                # letters lowering may depend on what is composed first
                t.encode("latin-1")
                t = t.lower()
            for space in "\t\n\r\x0b\x0c":
                t = t.replace(space, " ")
            parts.append(t.split(" "))
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {"": b""}, self.known
        known = self.known
        new = [w for w in set().union(*parts) if w not in known]
        if new:
            self._learn(new)
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)) + _END, dtype="<u4") for words in parts]


#: The last encoder of a worker process, which is used for many tasks: words stay known between them.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Packer:
    """Assigns documents to sequences of ``length`` tokens; keeps those with room between groups."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.open: list[list] = []  # cost, number, tokens
        self.made = 0

    def _new(self) -> list:
        self.made += 1
        return [0.0, self.made - 1, 0]

    def add(self, sizes: list[int], last: bool) -> list[tuple[int, int, int, int, int]]:
        """``(document, start, length, sequence, offset)`` of every piece; ``last``: nothing follows."""
        pieces: list[tuple[int, int, int, int, int]] = []
        rest: list[tuple[int, int, int]] = []  # tokens, document, start
        for d, n in enumerate(sizes):
            full = n // self.length
            for k in range(full):
                pieces.append((d, k * self.length, self.length, self._new()[1], 0))
            if n % self.length:
                rest.append((n % self.length, d, full * self.length))
        rest.sort(key=lambda r: (-r[0], r[1]))
        total = sum(r[0] for r in rest)
        room = sum(self.length - s[2] for s in self.open)
        bins = self.open + [self._new() for _ in range(max(0, (total - room) // self.length))]
        heap = [(s[0], s[1], s) for s in bins]
        heapq.heapify(heap)
        over: list[tuple[int, int, int]] = []
        for n, d, start in rest:
            passed, target = [], None
            while heap:
                item = heapq.heappop(heap)
                s = item[2]
                if s[2] + n <= self.length:
                    target = s
                    break
                passed.append(item)
                if len(passed) >= len(bins):
                    break
            if target is None:
                over.append((n, d, start))
            else:
                pieces.append((d, start, n, target[1], target[2]))
                target[2] += n
                target[0] += cost(n)
                if target[2] < self.length:
                    heapq.heappush(heap, (target[0], target[1], target))
            for item in passed:
                heapq.heappush(heap, item)
        waiting = sorted((s for s in bins if s[2] < self.length), key=lambda s: (s[2], s[1]), reverse=True)
        for n, d, start in over:  # cut to fill the room that is left, largest room first
            while n:
                if not waiting:
                    waiting.append(self._new())
                s = waiting[-1]
                take = min(n, self.length - s[2])
                pieces.append((d, start, take, s[1], s[2]))
                s[0] += cost(take)
                s[2] += take
                start, n = start + take, n - take
                if s[2] == self.length:
                    waiting.pop()
        self.open = waiting
        if last:
            pieces = self._close(pieces)
        return pieces

    def _close(self, pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Give the pieces of this group that lie in open sequences to full ones and powers of two."""
        ends = {s[1]: s[2] for s in self.open}
        moved = [p for p in pieces if p[3] in ends]
        mine = {s: sum(p[2] for p in moved if p[3] == s) for s in ends}
        fixed = {s: n - mine[s] for s, n in ends.items()}  # tokens that earlier groups put there
        kept = [p for p in pieces if p[3] not in ends]
        moved.sort(key=lambda p: (-p[2], p[0], p[1]))
        left = sum(p[2] for p in moved)
        slots: list[list[int]] = []  # sequence, offset, room
        for s, n in sorted(fixed.items(), key=lambda x: -x[1]):
            if n:  # must be filled: first to the full length, at the end to a power of two
                room = min(left, self.length - n)
                if room < self.length - n:
                    room = max((k - n for k in (1 << b for b in range(32)) if n <= k <= self.length and k - n <= left), default=room)
                slots.append([s, n, room])
                left -= room
        while left:
            room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            slots.append([self._new()[1], 0, room])
            left -= room
        slots.reverse()
        slots = [s for s in slots if s[2]]
        for d, start, n, _, _ in moved:
            while n:
                s = slots[-1]
                take = min(n, s[2])
                kept.append((d, start, take, s[0], s[1]))
                s[1] += take
                s[2] -= take
                start, n = start + take, n - take
                if not s[2]:
                    slots.pop()
        self.open = []
        return kept


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents; ``path`` is the tokenizer file."""
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(length)
        base = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def emit(last: bool) -> pa.RecordBatch:
            pieces = packer.add([len(x) for x in ids], last)
            rows = [
                (names[d], start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), base + s, offset)
                for d, start, n, s, offset in pieces
            ]
            columns = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[p.split()[0] for p in PIECES.split(", ")])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 64):
                made = encode(texts[at : at + 64])
                ids += made
                names += batch.column(0)[at : at + 64].to_pylist()
                held += sum(map(len, made))
                if held >= GROUP_TOKENS:
                    yield emit(False)
                    ids, names, held = [], [], 0
        if ids or packer.open:
            yield emit(True)

    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return docs.mapInArrow(run, PIECES)


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
