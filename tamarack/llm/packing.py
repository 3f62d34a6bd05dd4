"""Hierarchical multi-length packing (operator 5).

Tiers are context sizes, each a power of two that divides the longest. A document's ids are cut
into whole windows of the longest tier; the rest goes to the smallest tier that holds it. Each
tier's rests are packed best-fit; a gap in a window is filled with the longest shorter-tier
rests that fit and at last with a cut one, so windows close full. Every window that closes goes to
the least filled of the open step groups, which close at ``step_tokens``: training steps see
equal numbers of tokens however tiers mix. Only the last windows of an input partition can be
short; they are padded to the longest tier.

Packing is narrow: a partition packs what it reads, in blocks of bounded size, so no id ever
crosses the network. Sequence and step numbers carry the partition's number in their upper bits;
a lost task that runs again gives the same rows.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.bpe import PATTERN
from tamarack.llm.common import pa_schema, release, table, text_batches, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027]")
END_ID = 1
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 65_536
BLOCK_TOKENS = 4_000_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class Encoder:
    """Ids of whole texts as 32-bit little-endian bytes, as the tokenizers library gives them.

    The same vocabulary as a table of ranks lets tiktoken encode several times as fast. It does so
    for texts of the letters, digits, marks and spaces below U+0250 and of general punctuation, where
    both libraries' character classes agree; a text with any other character, or with a special
    token's string, goes to the tokenizers library.
    """

    def __init__(self, path: str, ranks: str | None):
        self.path, self.library, self.fast = path, None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.fast is None or _OTHER.search(text) or SPECIAL in text:
                rest.append(i)
            else:
                out[i] = array("I", self.fast.encode_ordinary(text)).tobytes()
        if rest and self.library is None:  # loaded by workers that meet such a text alone
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        for k in range(0, len(rest), 64):
            part = rest[k : k + 64]
            for i, e in zip(part, self.library.encode_batch([texts[i] for i in part], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out


@lru_cache(maxsize=2)
def load(path: str, ranks: str | None) -> Encoder:
    return Encoder(path, ranks)


class Packer:
    """Windows of one partition. ``add`` and ``finish`` give rows of closed windows."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_id: int):
        self.tiers, self.longest, self.step_tokens = tuple(sorted(tiers)), max(tiers), step_tokens
        self.next_sequence = self.next_step = first_id
        self.steps: list[tuple[int, int]] = []  # heap of (tokens, step group) of the open groups
        self.rests: list[list[tuple]] = [[] for _ in self.tiers]  # (length, doc_id, start, ids, doc_tokens)
        self.held = 0

    def _step(self, tokens: int) -> int:
        if not self.steps:
            self.steps = [(0, self.next_step + i) for i in range(4)]
            self.next_step += 4
        filled, group = heapq.heappop(self.steps)
        if filled + tokens < self.step_tokens:
            heapq.heappush(self.steps, (filled + tokens, group))
        return group

    def _close(self, pieces: list[tuple], tier: int) -> Iterator[tuple]:
        sequence, step, offset = self.next_sequence, self._step(tier), 0
        self.next_sequence += 1
        for length, doc_id, start, ids, doc_tokens in pieces:
            yield doc_id, start, length, zlib.crc32(ids), doc_tokens, sequence, offset, tier, step
            offset += length

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        whole = n - n % self.longest
        for start in range(0, whole, self.longest):
            yield from self._close([(self.longest, doc_id, start, ids[4 * start : 4 * (start + self.longest)], n)], self.longest)
        if n > whole:
            tier = bisect.bisect_left(self.tiers, n - whole)
            self.rests[tier].append((n - whole, doc_id, whole, ids[4 * whole :], n))
            self.held += n - whole
        if self.held >= BLOCK_TOKENS:
            yield from self._pack(False)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        """Close all windows that fill; what is left waits for the next block, or is padded at the end."""
        waiting = [sorted(r, key=lambda x: x[0]) for r in self.rests]  # popped from the end: longest first
        lengths = [[x[0] for x in r] for r in waiting]

        def take(tier: int, at: int) -> tuple:
            lengths[tier].pop(at)
            return waiting[tier].pop(at)

        self.rests, self.held = [[] for _ in self.tiers], 0
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while waiting[tier]:
                window, gap = [], size
                for k in range(tier, -1, -1):  # best fit: the longest that still fits, own tier first
                    while gap and (at := bisect.bisect_right(lengths[k], gap)):
                        window.append(take(k, at - 1))
                        gap -= window[-1][0]
                if gap:
                    k = next((k for k in range(tier + 1) if waiting[k]), None)
                    if k is not None:  # all that wait are longer than the gap: one is cut
                        length, doc_id, start, ids, n = take(k, len(waiting[k]) - 1)
                        window.append((gap, doc_id, start, ids[: 4 * gap], n))
                        rest = (length - gap, doc_id, start + gap, ids[4 * gap :], n)
                        to = bisect.bisect_left(self.tiers, rest[0])
                        at = bisect.bisect_left(lengths[to], rest[0])
                        lengths[to].insert(at, rest[0])
                        waiting[to].insert(at, rest)
                        gap = 0
                if not gap:
                    yield from self._close(window, size)
                elif last:
                    self.rests[0].extend(window)
                else:
                    for piece in window:
                        self.rests[bisect.bisect_left(self.tiers, piece[0])].append(piece)
                        self.held += piece[0]
        if last and self.rests[0]:  # less than one longest window is left over all tiers
            yield from self._tail(self.rests[0])

    def _tail(self, pieces: list[tuple]) -> Iterator[tuple]:
        window, gap = [], self.longest
        for length, doc_id, start, ids, n in pieces:
            while length:
                part = min(length, gap)
                window.append((part, doc_id, start, ids[: 4 * part], n))
                length, start, ids, gap = length - part, start + part, ids[4 * part :], gap - part
                if not gap:
                    yield from self._close(window, self.longest)
                    window, gap = [], self.longest
        if window:
            yield from self._close(window, self.longest)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack whole documents into sequences; a row for each piece of a document in a sequence.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (its padded
    length), step_group. Null and empty texts are the end id alone; repeated rows and null ids are
    documents of their own; other columns are ignored; an empty table gives no sequence.
    """
    path, ranks = tokenizer or tokenizer_path(TOKENIZER), None if tokenizer else tokenizer_path(RANKS)
    if any(max(tiers) % t or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    out_schema = pa_schema(docs.sparkSession, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = load(path, ranks), array("I", [end_id]).tobytes()
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        for ids, texts in text_batches(batches):
            for doc_id, data in zip(ids, encode([t or "" for t in texts])):
                rows.extend(packer.add(doc_id, data + end))
            yield pa.RecordBatch.from_pylist([], out_schema) if not rows else columns(rows)
            rows = []
        if rows := list(packer.finish()):
            yield columns(rows)
        release()

    def columns(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
