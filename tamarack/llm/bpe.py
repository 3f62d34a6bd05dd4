"""Byte-level BPE by DuckDB recursive queries (operator 4).

Each Spark task keeps one in-memory DuckDB. The distinct words of a batch become token-position
rows (one row per byte); a recursive query joins neighbouring rows with the merge table and, for
each word, contracts the leftmost pair of least rank, until no word has a pair left. Decoding
joins ids with the vocabulary and concatenates by ordered aggregation.

A word of n bytes takes up to n - 1 rounds over n rows. Words are queried together as long as these stay
few. Words beyond ``LONG_WORD`` bytes take the same contractions with a heap of pairs (n log n) instead:
measured, four random words of 1,024 bytes take the recursion 0.3 s, of 4,096 bytes 6.4 s and n * n / 2 rows,
the heap 0.03 s. Words that natural text has stay far below it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tamarack.llm.common import map_texts, table, tokenizer_path
from tamarack.llm.pieces import PieceMemory

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The public byte-level pattern, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 1_024
#: Rows that all rounds of one recursive query make at most, about 40 bytes each.
QUERY_ROWS = 3_000_000

#: A row is a token of a word: its position, the token, the position and token that follow, and of the pair that both
#: make rank, position and the position that follows, in one number (null: no such pair). Each round takes the least
#: number of a word, so its leftmost pair of least rank, and rewrites the rows that this pair touches: its left row, the
#: one before, and its right row.
ENCODE = """
WITH RECURSIVE step(word, round, pos, tok, npos, nxt, pair) AS (
  SELECT s.word, 0, s.pos, s.tok, s.npos, s.nxt, m.merged + s.pos * 65536 + s.npos
  FROM start_rows s LEFT JOIN merges m ON m.both = s.tok * 65536 + s.nxt
  UNION ALL
  SELECT s.word, s.round, s.pos, s.tok, s.npos, s.nxt, CASE WHEN s.touched THEN m.merged + s.pos * 65536 + s.npos ELSE s.pair END
  FROM (
    SELECT t.word, t.round + 1 AS round, t.pos, t.pair,
           CASE WHEN t.pos = b.at THEN b.rank ELSE t.tok END AS tok,
           CASE WHEN t.pos = b.at THEN b.after ELSE t.npos END AS npos,
           CASE WHEN t.pos = b.at THEN b.tok_after WHEN t.npos = b.at THEN b.rank ELSE t.nxt END AS nxt,
           t.pos = b.at OR t.npos = b.at AS touched
    FROM step t JOIN (
      SELECT least.word, (least.pair >> 16) & 65535 AS at, least.pair >> 32 AS rank, least.pair & 65535 AS gone,
             r.npos AS after, r.nxt AS tok_after
      FROM (SELECT word, min(pair) AS pair FROM step WHERE pair IS NOT NULL GROUP BY word) least
      JOIN step r ON r.word = least.word AND r.pos = least.pair & 65535
    ) b ON b.word = t.word AND t.pos <> b.gone
  ) s LEFT JOIN merges m ON m.both = CASE WHEN s.touched THEN s.tok * 65536 + s.nxt END
)
SELECT s.word, s.pos, s.tok FROM step s
JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) f ON f.word = s.word AND f.round = s.round
"""
DECODE = """
SELECT t.seq, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS bytes
FROM id_rows t JOIN vocab v ON v.id = t.id GROUP BY t.seq
"""


def _connect():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})


def _positions(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and position of every element of concatenated sequences."""
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    starts = np.cumsum(lengths) - lengths
    return owner, (np.arange(len(owner)) - np.repeat(starts, lengths)).astype(np.int32)


class ByteBpe:
    """Encoder and decoder over one table of ranks; one to a Python worker."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.words = regex.compile(PATTERN)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        merges = [
            (self.ranks[t[:i]], self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        left, right, merged = np.array(merges, dtype=np.int32).reshape(-1, 3).T
        self.con = _connect()
        left, right, merged = (x.astype(np.int64) for x in (left, right, merged))
        self._load("merges", pa.table({"both": left * 65536 + right, "merged": merged << 32}))
        ids = pa.array(self.ranks.values(), pa.int32())
        self._load("vocab", pa.table({"id": ids, "hex": [t.hex() for t in self.ranks]}))
        self.decimal = {i: b"%d," % i for i in self.ranks.values()}
        self.memory = PieceMemory(self._round_trip)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.con.register("loading", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM loading")
        self.con.unregister("loading")

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word, pos = _positions(lengths)
        pos, tok = pos.astype(np.int64), self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        last = np.zeros(len(tok), dtype=bool)
        last[np.cumsum(lengths) - 1] = True
        rows = {"word": word, "pos": pos, "tok": tok}
        rows |= {"npos": pa.array(pos + 1, mask=last), "nxt": pa.array(np.append(tok[1:], tok[:1]), mask=last)}
        self.con.register("start_rows", pa.table(rows))
        got = self.con.execute(ENCODE).fetchnumpy()
        self.con.unregister("start_rows")
        order = np.argsort(got["word"].astype(np.int64) * 65536 + got["pos"])
        tokens, counts = got["tok"][order].tolist(), np.bincount(got["word"], minlength=len(words))
        ends = np.cumsum(counts).tolist()
        return [tokens[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_long(self, word: bytes) -> list[int]:
        """The same contractions, the next pair taken from a heap of (rank, position)."""
        n = len(word)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def rank(i: int):
            return self.ranks.get(word[i : end[end[i]]]) if end[i] < n else None

        heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or self.ranks.get(word[i:stop]) != _:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
            for j in (i, prev[i]):
                if j >= 0 and (r := rank(j)) is not None:
                    heapq.heappush(heap, (r, j, end[end[j]]))
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def _round_trip(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """For each piece its ids in decimal, a comma behind each, and the bytes that these ids decode to."""
        split = [list(map(str.encode, words)) for words in map(self.words.findall, pieces)]
        every = set(chain.from_iterable(split))
        ranks = self.ranks
        ids = {w: (ranks[w],) for w in every if w in ranks}
        short = [w for w in every if w not in ids]
        long = {w for w in short if len(w) > LONG_WORD}
        ids.update((w, self._encode_long(w)) for w in long)
        short = [w for w in short if w not in long] if long else short
        short.sort(key=len)
        rows = np.cumsum([len(w) * len(w) // 2 for w in short])  # that the recursion makes at most
        first = 0
        while first < len(short):
            last = max(first + 1, int(np.searchsorted(rows, (rows[first - 1] if first else 0) + QUERY_ROWS, side="right")))
            part = short[first:last]
            ids.update(zip(part, self._encode_words(part)))
            first = last
        own = [ids[words[0]] if len(words) == 1 else [i for w in words for i in ids[w]] for words in split]
        lengths = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        flat = np.fromiter(chain.from_iterable(own), dtype=np.int32, count=int(lengths.sum()))
        decimal = self.decimal
        return list(zip([b"".join([decimal[i] for i in o]) for o in own], self.decode(flat, lengths)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids in decimal, joined by commas."""
        return [b"".join([d for d, _ in values])[:-1] for values in self.memory(texts)]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Bytes of sequences of ``lengths`` ids that stand one behind the other in ``ids``."""
        out = [b""] * len(lengths)
        seq, pos = _positions(lengths)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        first = 0
        while first < len(lengths):  # whole sequences, about a million ids to a query
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + 1_000_000, side="right")) - 1)
            rows = slice(bounds[first], bounds[last])
            if bounds[last] > bounds[first]:
                self.con.register("id_rows", pa.table({"seq": seq[rows], "pos": pos[rows], "id": ids[rows]}))
                for k, data in self.con.execute(DECODE).fetchall():
                    out[k] = data
                self.con.unregister("id_rows")
            first = last
        return out


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(
    docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every whole text: doc_id, ids array<int>.

    Null and empty texts have no ids; repeated rows and null doc_ids give a row each; other
    columns are ignored; an empty table gives none. Narrow: no shuffle.
    """
    path = ranks or tokenizer_path(RANKS)

    def run(ids: list, texts: list) -> dict:
        found = load(path).encode([t or "" for t in texts])
        return {"doc_id": ids, "ids": [[int(i) for i in x.split(b",") if i] for x in found]}

    return map_texts(docs, run, "doc_id long, ids array<int>", id_col, text_col)


def decode_ids(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """The bytes of each row's ids: doc_id, bytes. Null ids count as none; an id that the ranks lack adds nothing."""
    path = ranks or tokenizer_path(RANKS)

    def run(batches):
        for batch in batches:
            rows = [np.array(r or [], dtype=np.int32) for r in batch.column(1).to_pylist()]
            lengths = np.array([len(r) for r in rows], dtype=np.int64)
            data = load(path).decode(np.concatenate([*rows, np.empty(0, np.int32)]), lengths)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "bytes": pa.array(data, pa.binary())}
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(
    docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode in one pass over each batch and keep digests alone: doc_id, n_tokens,
    ids_sha256 (decimal ids joined by commas), decoded_sha256 (bytes decoded from the ids).

    The ids of a text are those of its pieces, one behind the other, and so are the bytes they
    decode to; a piece that comes again is taken from memory, both ways.

    Cases as in :func:`encode_documents`; the digest of no ids is that of the empty string.
    """
    path = ranks or tokenizer_path(RANKS)

    def run(doc_ids: list, texts: list) -> dict:
        found = load(path).memory([t or "" for t in texts])
        decimal = [b"".join([d for d, _ in values])[:-1] for values in found]
        return {
            "doc_id": doc_ids,
            "n_tokens": [d.count(b",") + bool(d) for d in decimal],
            "ids_sha256": [hashlib.sha256(d).hexdigest() for d in decimal],
            "decoded_sha256": [hashlib.sha256(b"".join([x for _, x in values])).hexdigest() for values in found],
        }

    return map_texts(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
