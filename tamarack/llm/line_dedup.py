"""Line deduplication by an exact set-similarity join (operator 2).

A line is the set of its words. All words of the corpus are counted in a sketch of bounded size
(one pass), which orders the words of each line by rarity. A line is kept for the join by the
rarest words that a line of Jaccard similarity ``threshold`` must share with it (prefix filter);
words that the sketch proves unique are left out, and a line of which nothing is left matches no
other. Equal sets are grouped first and numbered. Lines that share a prefix word meet in one task and
are compared by length, by place of the word (positional filter) and by a parity bitmap that bounds
their difference; what passes is verified on the words themselves. A line goes if an earlier one, in
order of doc_id and place, is that similar.

As one earlier line is enough, each word of a line names its earliest candidate alone, so a group of n
alike lines costs n candidates and not their pairs, and the line is first verified against the one that
most of its words name. Lines that this leaves are compared with the others, and by words that had more
candidates with all of these. A word that more than
``HOT_COUNT`` lines may share never meets in one task: its lines are first compared with its earliest,
in a plain join, and those left with all others in blocks of about ``HOT_COUNT`` lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import release, table
from tamarack.llm.words import mix, words_of
from tamarack.operators.storage import broadcast_if_small, drop, written

THRESHOLD = 0.8
#: The sketch has up to 2 ** SKETCH_BITS counters of one byte; for smaller corpora it is folded.
SKETCH_BITS = 24
_RANGE_BITS = 14
HOT_COUNT = 4_096
#: Tables of up to so many narrow rows (of 64 bytes; 16 positions or 4 places count as one) are broadcast; larger ones
#: are joined by shuffles.
SMALL_ROWS = 400_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps of the logarithmic counter: level k stands for counts up to 1.2 ** k; level 0 stands for a count of 1 alone.
_LEVELS = np.unique(np.ceil(1.2 ** np.arange(0, 220)).clip(max=2**62)).astype(np.int64)[:250]
#: Counted words held by a task before it passes them on.
_HELD = 1_000_000


def words_in(line: Column) -> Column:
    """Distinct words: runs without 0x20 and 0x09-0x0D, A-Z in lower case."""
    return F.array_distinct(
        F.filter(F.split(F.translate(line, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    )


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _summed(bucket: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their sums."""
    order = np.argsort(bucket)
    bucket = bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    return bucket[at], np.add.reduceat(n[order], at) if n is not None and len(at) else np.diff(np.r_[at, len(bucket)])


def count_words(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """A sketch of at most 2 ** SKETCH_BITS levels of how often the words of the corpus occur.

    Tasks sum buckets of hashes and hand them on by ranges of 2 ** _RANGE_BITS buckets; what reaches the
    driver is a byte for each bucket (16 MB at most). Neighbouring buckets are added up while the sketch
    stays filled to a sixteenth at most, so that a small corpus has a small one.
    """
    ranges, width = 1 << (SKETCH_BITS - _RANGE_BITS), 1 << _RANGE_BITS

    def parts(bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = bucket >> _RANGE_BITS
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        low, n = (bucket & (width - 1)).astype("<u2"), n.astype("<i8")
        # most counts fit a byte; others follow with their places
        small, big = np.minimum(n, 255).astype(np.uint8), n >= 255
        ends = np.r_[at[1:], len(bucket)]
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(at, ends)]
        return pa.RecordBatch.from_pydict(
            {"part": part[at].astype(np.int32), "low": cut(low), "n": cut(small), "big": [n[a:b][big[a:b]].tobytes() for a, b in zip(at, ends)]}
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, words in words_of(batch.column(0)):
                held.append(_summed(_bucket(words.hash, SKETCH_BITS)))
                size += len(held[-1][0])
                if size >= _HELD:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size >= _HELD:
                        yield parts(*held[0])
                        held, size = [], 0
        if size:
            yield parts(*_summed(*map(np.concatenate, zip(*held))))
        del held
        release()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, low, small, big in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = np.frombuffer(small, dtype=np.uint8).astype(np.int64)
                n[n == 255] = np.frombuffer(big, dtype="<i8")
                np.add.at(sums.setdefault(part, np.zeros(width, dtype=np.int64)), np.frombuffer(low, dtype="<u2"), n)
        for part, n in sums.items():
            level = np.where(n > 0, np.searchsorted(_LEVELS, n).clip(max=249) + 1, 0)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "level": [level.astype(np.uint8).tobytes()]})

    schema = "part int, low binary, n binary, big binary"
    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema).repartition("part")
    sketch = np.zeros((ranges, width), dtype=np.uint8)
    for row in sums.mapInArrow(total, "part int, level binary").collect():  # a byte for each bucket
        sketch[row["part"]] = np.frombuffer(row["level"], dtype=np.uint8)
    return _folded(sketch.reshape(-1))


def _folded(sketch: np.ndarray) -> np.ndarray:
    """Neighbouring buckets joined while at most a sixteenth is filled; a joined level is an upper bound of the sum's."""
    one = int(np.searchsorted(_LEVELS, 1)) + 1
    while len(sketch) > 1 << 10 and 16 * np.count_nonzero(sketch) <= len(sketch):
        a, b = sketch[::2], sketch[1::2]
        both = (a > 0) & (b > 0)
        n = _LEVELS[np.maximum(a, 1).astype(np.int64) - 1] + _LEVELS[np.maximum(b, 1).astype(np.int64) - 1]
        sketch = np.where(both, np.maximum(np.searchsorted(_LEVELS, n) + 1, one + 1).clip(max=250), np.maximum(a, b)).astype(np.uint8)
    return sketch


def line_rows(docs: DataFrame, sketch: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line that may match another: doc_id, text_hash, pos, s1, s2 (hash of the set), n,
    low and high (parity of its words in 128 bits), and for each prefix word its hash (prefix: 40 bits, above a bit that says it may be common) and place."""
    spread = docs.sparkSession.sparkContext.broadcast(sketch)  # 2 ** SKETCH_BITS bytes at most
    bits = int(len(sketch)).bit_length() - 1
    hot_level, one_level = int(np.searchsorted(_LEVELS, HOT_COUNT, side="right")) + 1, int(np.searchsorted(_LEVELS, 1)) + 1
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()),
         ("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("prefix", pa.list_(pa.int64())), ("place", pa.list_(pa.int32()))]
    )

    def rows_of(batch: pa.RecordBatch, rows: np.ndarray, words) -> pa.RecordBatch | None:
        h, line = words.hash, words.line
        if not len(h):
            return None
        level = spread.value[_bucket(h, bits)]
        # by line, rare words first; words of one level by their hash, the same order everywhere
        top = int(line[-1] + 1).bit_length()
        key = (line.astype(np.uint64) << np.uint64(64 - top)) | (level.astype(np.uint64) << np.uint64(56 - top)) | (h >> np.uint64(8 + top))
        order = np.argsort(key)
        h, line, level, key = h[order], line[order], level[order], key[order]
        again = np.r_[False, key[1:] == key[:-1]]
        if (h[1:] != h[:-1])[again[1:]].any():  # equal in the bits that fit: by whole hashes
            order = np.lexsort((h, level, line))
            h, line, level = h[order], line[order], level[order]
            again = np.r_[False, (h[1:] == h[:-1]) & (line[1:] == line[:-1])]
        h, line, level = h[~again], line[~again], level[~again]  # a line's words once each
        n = np.bincount(line)
        starts = np.cumsum(n) - n
        s1 = np.add.reduceat(mix(h + np.uint64(0x632BE59BD9B4E019)), starts)
        s2 = np.add.reduceat(mix(h ^ np.uint64(0xD6E8FEB86659FD93)), starts)
        bit, upper = np.uint64(1) << (h & np.uint64(63)), (h & np.uint64(64)) > 0
        low = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), bit), starts)
        high = np.bitwise_xor.reduceat(np.where(upper, bit, np.uint64(0)), starts)
        place = np.arange(len(h)) - np.repeat(starts, n)
        width = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
        use = (place < np.repeat(width, n)) & (level > one_level)
        per_line = np.bincount(line[use], minlength=len(n))
        some = per_line > 0
        if not some.any():
            return None
        offsets = pa.array(np.r_[0, np.cumsum(per_line[some])].astype(np.int32))
        word = ((h[use] >> np.uint64(24)).astype(np.int64) << 1) | (level[use] >= hot_level)
        at = pa.array(rows[words.text_of_line[some]])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(words.pos_of_line[some].astype(np.int32)),
             pa.array(s1[some].view(np.int64)), pa.array(s2[some].view(np.int64)), pa.array(n[some].astype(np.int32)),
             pa.array(low[some].view(np.int64)), pa.array(high[some].view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(word)),
             pa.ListArray.from_arrays(offsets, pa.array(place[use].astype(np.int32)))],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in words_of(batch.column(2)):
                out = rows_of(batch, rows, words)
                if out is not None:
                    yield out
        release()

    source = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text")
    )
    return source.mapInArrow(
        run, "doc_id long, text_hash long, pos int, s1 long, s2 long, n int, low long, high long, prefix array<long>, place array<int>"
    )


def alike(n1, p1, low1, high1, n2, p2, low2, high2, threshold: float) -> np.ndarray:
    """Lossless filters on a longer line 1 and one no longer, 2, that share a prefix word at places p1, p2.

    Length; place: what both can still share, and the shorter prefix of |x| - ceil(2t / (1 + t) |x|) + 1
    words in which line 2 must have the word; and the bitmaps, of which no more bits differ than words may.
    """
    least = np.ceil((n1 + n2) * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)
    shared = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    short = n2 - np.ceil(n2 * (2 * threshold / (1 + threshold)) - 1e-9) + 1
    differ = np.bitwise_count(low1 ^ low2).astype(np.int64) + np.bitwise_count(high1 ^ high2)
    return (n2 >= np.ceil(threshold * n1 - 1e-9)) & (shared >= least) & (p2 < short) & (differ <= n1 + n2 - 2 * least)


#: ``key`` says which rows meet; ``np`` has n in its upper 32 bits, place below, and in the last two whether the row asks and answers.
_ROW = ("key", "np", "id", "doc", "low", "high")
_ASKS, _ANSWERS = 2, 1


def _numbers(role: int) -> Column:
    return F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("place").cast("long"), 2)).bitwiseOR(F.lit(role)).alias("np")


def candidates(rows: DataFrame, threshold: float, every: bool) -> DataFrame:
    """rows: (key, np, id, doc, low, high) -> (a, b, more, key): sets that may be alike, a's doc not above b's.

    For each row b that asks, of the rows a of its key that answer: all if ``every``, else the earliest alone, and
    whether there are more. A key's rows are held together.
    """

    def pairs(group, n, place, low, high, id_, doc, asks, answers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(earlier, later) rows of one group that pass the filters, a chunk at a time; rows are by group and n.

        Two rows of one doc come both ways: which is the earlier is known when they are verified.
        """
        key = (group << 32) | n
        since = np.searchsorted(key, (group << 32) | np.ceil(threshold * n - 1e-9).astype(np.int64))
        count = np.arange(len(key)) - since
        ends = np.cumsum(count)
        first = 0
        while first < len(key):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 500_000, side="right")))
            c = count[first:last]
            one = np.repeat(np.arange(first, last), c)
            two = np.arange(len(one)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(since[first:last], c)
            ok = alike(n[one], place[one], low[one], high[one], n[two], place[two], low[two], high[two], threshold) & (id_[one] != id_[two])
            one, two = one[ok], two[ok]
            up, down = doc[one] >= doc[two], doc[one] <= doc[two]
            early, late = np.r_[two[up], one[down]], np.r_[one[up], two[down]]
            some = asks[late] & answers[early]
            yield early[some], late[some]
            first = last

    def work(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, both, id_, doc, low, high = held
        group, n = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1, both >> 32
        order = np.lexsort((n, group))
        key, group, n, both, id_, doc, low, high = (x[order] for x in (key, group, n, both, id_, doc, low, high))
        place, low, high, asks, answers = both >> 2 & 0x3FFFFFFF, low.view(np.uint64), high.view(np.uint64), both & _ASKS > 0, both & _ANSWERS > 0
        by_rank = np.lexsort((id_, doc))
        rank = np.empty(len(doc), dtype=np.int64)
        rank[by_rank] = np.arange(len(doc))
        best, seen = np.full(len(doc), len(doc)), np.zeros(len(doc), dtype=np.int64)
        for early, late in pairs(group, n, place, low, high, id_, doc, asks, answers):
            if every:
                for a in range(0, len(late), 100_000):
                    here = late[a : a + 100_000]
                    yield out(id_[early[a : a + 100_000]], id_[here], np.zeros(len(here), dtype=bool), key[here])
            else:
                np.minimum.at(best, late, rank[early])
                seen += np.bincount(late, minlength=len(seen))
        if not every:
            found = np.flatnonzero(seen)
            yield out(id_[by_rank[best[found]]], id_[found], seen[found] > 1, key[found])

    def out(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "more", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(c) for c in zip(held, columns)] if held else columns
            if len(held[0]) < 50_000:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
            if cut:
                yield from work([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held and len(held[0]):
            yield from work(held)
        release()

    return rows.select(*_ROW).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, more boolean, key long")


def _opened(rows: DataFrame) -> DataFrame:
    """A row for each prefix word of sets: word, hot, n, place, id, doc, low, high."""
    opened = rows.select("id", F.col("first.doc_id").alias("doc"), "low", "high", "n", F.explode(F.arrays_zip("prefix", "place")).alias("w"))
    return opened.select(
        F.shiftright("w.prefix", 1).alias("word"), (F.col("w.prefix").bitwiseAND(F.lit(1)) == 1).alias("hot"), "n", "w.place", "id", "doc", "low", "high"
    )


def _led(hot: DataFrame, threshold: float) -> DataFrame:
    """(a, b, more, key): rows b of common words with the earliest row of the word, null where that can't match."""
    leaders = hot.groupBy("word").agg(F.min(F.struct("doc", "id", "n", "place", "low", "high")).alias("a"))
    n1, n2, p1, p2 = F.col("n"), F.col("a.n"), F.col("place"), F.col("a.place")
    big, small = F.greatest(n1, n2), F.least(n1, n2)
    least = F.ceil((n1 + n2) * (threshold / (1 + threshold)) - 1e-9)
    shared = F.least(p1, p2) + 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    differ = F.bit_count(F.col("low").bitwiseXOR(F.col("a.low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("a.high")))
    may = (small >= F.ceil(threshold * big - 1e-9)) & (shared >= least) & (differ <= n1 + n2 - 2 * least)
    # each row of a common word counts as one with more candidates
    return hot.join(leaders, "word").select(F.when(may & (F.col("id") != F.col("a.id")), F.col("a.id")).alias("a"), F.col("id").alias("b"), F.lit(True).alias("more"), F.col("word").alias("key"))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """pairs: (a, b) set ids -> (id) of sets that an earlier one of their pairs matches, verified on all words."""
    ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    places = written(
        sets.select("id", "first.*").join(broadcast_if_small(ids, SMALL_ROWS), "id", "left_semi")
        .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("id", "pos")).alias("places")),
        "places",
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    named = lambda lines: F.transform("places", lambda p: F.struct(p["id"].alias("id"), p["pos"].alias("pos"), F.element_at(lines, p["pos"] + 1).alias("line")))
    words = written(
        texts.join(broadcast_if_small(places, SMALL_ROWS, F.size("places") / 4), ["doc_id", "text_hash"])
        .select("doc_id", "text_hash", F.explode(F.get(F.transform(F.array(F.split("text", "\n")), named), F.lit(0))).alias("p"))  # a text is split once
        .select("p.id", F.struct("doc_id", "text_hash", "p.pos").alias("first"), F.transform(words_in(F.col("p.line")), lambda w: F.xxhash64(w)).alias("words")),
        "words",
    )
    side = lambda name: words.select(F.col("id").alias(name), F.col("first").alias(f"first_{name}"), F.col("words").alias(f"words_{name}"))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    enough = shared >= threshold * (F.size("words_a") + F.size("words_b") - shared) - 1e-9
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(enough)
    out = written(met.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct(), "losers")
    for df in (ids, places, words):
        drop(df)
    return out


def _alike_earlier(sets: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(id) of sets that an earlier one matches."""
    opened = _opened(sets)
    # of the words that the sketch can't rule out, those that more sets have in their prefix
    counts = opened.where("hot").groupBy("word").agg(F.count("*").alias("y")).where(F.col("y") > HOT_COUNT)
    common = written(counts, "common")
    some_hot, cool = not common.isEmpty(), opened
    if some_hot:
        small = broadcast_if_small(common.select("word"), SMALL_ROWS)
        hot = written(opened.where("hot").join(small, "word", "left_semi"), "hot")
        cool = opened.where("not hot").unionByName(opened.where("hot").join(small, "word", "left_anti"))
    found = candidates(cool.select(F.col("word").alias("key"), _numbers(_ASKS | _ANSWERS), *_ROW[2:]), threshold, every=False)
    found = found.unionByName(_led(hot, threshold)) if some_hot else found
    found = written(found, "found")
    pairs = written(found.where("a is not null").groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    # first the one that a line shares most of its rare words with
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    lost = _verified(written(best, "best"), sets, docs, threshold, id_col, text_col)
    # a line that isn't lost then is compared with its other candidates, and asks for more where a word has more
    few = broadcast_if_small(lost.select(F.col("id").alias("b")), SMALL_ROWS)
    others = pairs.join(few, "b", "left_anti").select("a", "b")
    asking = written(found.where("more").select("b", "key").distinct().join(few, "b", "left_anti").select(F.col("b").alias("id"), F.col("key").alias("word")), "asking")
    used = [common, asking, pairs, *([hot] if some_hot else [])]
    drop(found)
    asker = sets.join(broadcast_if_small(written(asking.select("id").distinct(), "ids"), SMALL_ROWS), "id", "left_semi")
    asks = written_asks = written(_opened(asker).join(broadcast_if_small(asking, SMALL_ROWS), ["id", "word"], "left_semi"), "asks")
    words = written(asks.select("word").distinct(), "words")
    answers = opened.join(broadcast_if_small(words, SMALL_ROWS), "word", "left_semi")
    key = asked = F.col("word")
    if some_hot:  # so many blocks of rows that ask (x) and that answer (y); each x meets each y in a task
        shares = asks.where("hot").groupBy("word").agg(F.ceil(F.count("*") / HOT_COUNT).cast("long").alias("x"))
        sizes = written(shares.join(common.select("word", F.ceil(F.col("y") / HOT_COUNT).cast("long").alias("y")), "word"), "sizes")
        small = broadcast_if_small(sizes, SMALL_ROWS)
        dealt = lambda df: df.join(small, "word", "left").withColumns({k: F.coalesce(k, F.lit(1)) for k in ("x", "y")})
        own = lambda name: F.pmod(F.xxhash64("id"), F.col(name))
        every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
        asks, answers = dealt(asks).withColumn("other", every("y")), dealt(answers).withColumn("other", every("x"))
        asked, key = F.xxhash64("word", own("x"), "other"), F.xxhash64("word", "other", own("y"))
        used.append(sizes)
    here = asks.select(asked.alias("key"), _numbers(_ASKS), *_ROW[2:])
    there = answers.select(key.alias("key"), _numbers(_ANSWERS), *_ROW[2:])
    late = candidates(here.unionByName(there), threshold, every=True).select("a", "b")
    late = written(late.unionByName(others).distinct(), "late")
    more = _verified(late, sets, docs, threshold, id_col, text_col)
    out = written(lost.unionByName(more).distinct(), "lost")
    for df in (*used, written_asks, words, late, lost, more):
        drop(df)
    return out


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, pos (from 0) of every line that an earlier line matches."""
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must lie above 0.5 and not above 1")
    rows = written(line_rows(docs, count_words(docs, text_col), threshold, id_col, text_col), "lines")
    first = F.min(F.struct("doc_id", "text_hash", "pos")).alias("first")
    grouped = rows.groupBy("s1", "s2").agg(first, F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "low", "high", "prefix", "place")))
    # numbers are taken when the table is written, and so stay
    sets = written(grouped.withColumn("id", F.monotonically_increasing_id()), "sets")
    many = written(sets.where("copies > 1").select("s1", "s2", "first"), "many")
    again = (
        rows.select("doc_id", "text_hash", "pos", "s1", "s2").join(broadcast_if_small(many, SMALL_ROWS), ["s1", "s2"])
        .where(F.struct("doc_id", "text_hash", "pos") != F.col("first")).select("doc_id", "text_hash", "pos")
    )
    again = written(again, "again")
    drop(rows)
    drop(many)
    lost = _alike_earlier(sets, docs, threshold, id_col, text_col)
    gone = sets.select("id", "first").join(broadcast_if_small(lost, SMALL_ROWS), "id", "left_semi").select("first.*")
    out = written(gone.unionByName(again), "gone")
    for df in (again, lost, sets):
        drop(df)
    return out


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines cut out of its text, and two columns more: _n_lines, _n_removed.

    Lines are separated by a line feed; blank lines stay and match nothing. Equal rows of one doc_id
    count as one document. Null texts stay null (0 lines); rows with a null doc_id stay as they are
    and no line counts as a repeat of theirs. A text of which every line goes is empty. Extra columns
    stay as they are, whatever their names (but for _n_lines and _n_removed, which are replaced).
    """
    gone = repeated_lines(docs, threshold, id_col, text_col)
    cut = written(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("cut")), "cut")
    drop(gone)
    cut = broadcast_if_small(cut, SMALL_ROWS, F.size("cut") / 16)
    mine, text = f"cut_{uuid.uuid4().hex}", docs[text_col]  # a name that no column of docs has
    cut = cut.select(F.col("doc_id").alias(f"{mine}_id"), F.col("text_hash").alias(f"{mine}_hash"), F.col("cut").alias(mine))
    joined = docs.join(cut, (docs[id_col].cast("long") == F.col(f"{mine}_id")) & (F.xxhash64(text) == F.col(f"{mine}_hash")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(mine, i)), "\n")
    return joined.select(
        *(F.when(F.col(mine).isNull(), text).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns if c not in ("_n_lines", "_n_removed")),
        F.when(text.isNull(), 0).otherwise(1 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("_n_lines"),
        F.coalesce(F.size(mine), F.lit(0)).cast("long").alias("_n_removed"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).withColumnsRenamed({"_n_lines": "n_lines", "_n_removed": "n_removed"})


#: All pairs of different word sets of comparable size, without any filter on words.
OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), sets AS (
  SELECT doc_id, pos, list_sort(list_distinct(list_filter(
           regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda w: w <> ''))) AS words, line
  FROM lines
), firsts AS (
  SELECT words, min((doc_id, pos)) AS first, len(words) AS n FROM sets WHERE len(words) > 0 GROUP BY words
), lost AS (
  SELECT DISTINCT b.words FROM firsts a JOIN firsts b
    ON b.n BETWEEN a.n * 0.8 - 1e-9 AND a.n / 0.8 + 1e-9 AND a.first < b.first
  WHERE len(list_intersect(a.words, b.words)) * 1.8 >= 0.8 * (a.n + b.n) - 1e-9
), kept AS (
  SELECT s.*, len(s.words) > 0 AND (s.words IN (SELECT words FROM lost) OR (s.doc_id, s.pos) <> f.first) AS gone
  FROM sets s LEFT JOIN firsts f ON f.words = s.words
)
SELECT d.doc_id, coalesce(k.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)) AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM kept GROUP BY doc_id
) k ON k.doc_id = d.doc_id
"""
