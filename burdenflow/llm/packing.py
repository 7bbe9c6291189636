"""Packing documents into training sequences by the sum-of-squares rule, online.

Each task packs the documents it reads, in their order. A document of several windows' length first fills whole
windows; what is left, or a shorter document, goes into the fill level where it leaves the smallest sum of
squared counts of partly filled windows. Counts stand in an array by level. At the end of a task the windows
still partly filled are closed: those with least in them are cut up to fill those with most, until one is left,
which is cut into sequences whose lengths are powers of two and so need no padding. Documents may be cut anywhere.

The rows don't move between tasks, so there is no shuffle. A task holds the ids of the documents that have a
part in a window still open; the rule keeps the number of those windows small (some for each level).

Null texts are empty ones and have only the end id. Rows with equal doc_id are packed like any others. Other
columns of the input are not read. An empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burdenflow.llm.slices import map_slices
from burdenflow.llm.tokens import encoder

WINDOW = 2048
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences that one task can number.
PER_TASK = 1 << 40


class Packer:
    """Windows of one task. A part is (document, start, length); documents are numbers of the caller's."""

    def __init__(self, window: int = WINDOW):
        self.window, self.counts = window, np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)

    def add(self, document: int, length: int) -> list[list[tuple]]:
        """Windows that become full."""
        whole = [[(document, at, self.window)] for at in range(0, length - self.window + 1, self.window)]
        rest = length - self.window * len(whole)
        if rest:
            whole += self._place((document, length - rest, rest))
        return whole

    def _place(self, part: tuple) -> list[list[tuple]]:
        size, counts = part[2], self.counts
        # the sum of squares changes by 2 (count after - count before) + 2 if a window moves between levels,
        # by 1 - 2 count if it becomes full, and by 1 + 2 count if a new one is opened
        top = self.window - size
        change = 2 * (counts[size : self.window] - counts[:top]) + 2
        change[counts[:top] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * counts[size] + 1
        level = int(change.argmin())
        if counts[top] and 1 - 2 * counts[top] <= change[level]:
            level = top
        window = self.open[level].pop() if level else []
        if level:
            counts[level] -= 1
        window.append(part)
        if level + size == self.window:
            return [window]
        counts[level + size] += 1
        self.open[level + size].append(window)
        return []

    def close(self) -> list[list[tuple]]:
        """The rest: full windows, then lengths that are powers of two."""
        left = [w for level in sorted(self.open) for w in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        done, low, high = [], 0, len(left) - 1
        fill = [sum(p[2] for p in w) for w in left]
        while low < high:
            need = self.window - fill[high]
            while need and low < high:
                document, start, length = left[low].pop()
                take = min(need, length)
                if take < length:
                    left[low].append((document, start, length - take))
                left[high].append((document, start + length - take, take))
                need, fill[low], fill[high] = need - take, fill[low] - take, fill[high] + take
                low += not fill[low]
            if not need:
                done.append(left[high])
                high -= 1
        rest = left[low] if low <= high else []
        total = sum(p[2] for p in rest)
        for size in [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]:
            sequence = []
            while size:
                document, start, length = rest.pop()
                take = min(size, length)
                if take < length:
                    rest.append((document, start + take, length - take))
                sequence.append((document, start, take))
                size -= take
            done.append(sequence)
        return done


def pack(docs: DataFrame, vocabulary: str, end: int, window: int = WINDOW) -> DataFrame:
    """Pieces of documents with their place in a sequence of at most `window` tokens."""
    names = [x.split()[0] for x in PIECE.split(", ")]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all, packer = encoder(vocabulary).encode_all, Packer(window)
        waiting: dict[int, list] = {}  # documents of open windows: id, ids, tokens not yet written
        number, sequence = 0, TaskContext.get().partitionId() * PER_TASK

        def rows(windows):
            nonlocal sequence
            for parts in windows:
                at = 0
                for document, start, length in parts:
                    held = waiting[document]
                    yield held[0], start, length, zlib.crc32(held[1][4 * start : 4 * (start + length)]), len(held[1]) // 4, sequence, at
                    at += length
                    held[2] -= length
                    if not held[2]:
                        del waiting[document]
                sequence += 1

        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], encode_all(batch["text"], end)):
                waiting[number] = [None if pd.isna(doc_id) else int(doc_id), ids, len(ids) // 4]
                out.extend(rows(packer.add(number, len(ids) // 4)))
                number += 1
            if out:
                yield frame(out)
        if out := list(rows(packer.close())):
            yield frame(out)
        encoder(vocabulary).forget()

    def frame(rows):
        table = pd.DataFrame(rows, columns=names)
        table["doc_id"] = table["doc_id"].astype("Int64")
        return table

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), packed, PIECE)
