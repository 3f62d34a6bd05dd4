"""SimHash near-duplicates by a binary-trie self-join (operator 3).

Fingerprints are made in one Arrow pass and collapsed to distinct values, so a group of copies
is one trie leaf. Two fingerprints within two bits agree on at least two of four 16-bit blocks, so
a trie is built for each of the six pairs of blocks, these two blocks leading: only tries whose
first 32 bits agree need to be traversed, and each such subtree is a group of its own. Inside,
node pairs are traversed together bit by bit; a pair carries the bits in which its nodes differ
and is pruned when these exceed the budget. Subtrees with more than ``HOT_NODE`` leaves are led by
two of the four 8-bit blocks that remain, in the same way; these hold at most 65,536 leaves however
large the corpus is. Each subtree gives star edges of its local components, which is all that
reachability needs; distributed components join them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import map_texts, table
from tamarack.operators.components import connected_components
from tamarack.operators.storage import broadcast_if_small, drop, written

SHINGLE_WORDS = 3
MAX_BITS = 2
HOT_NODE = 1024
SEED = 42
#: So many ids are broadcast (8 bytes each); more are joined by shuffles.
SMALL_ROWS = 400_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text (see :func:`fingerprints`)."""
    import xxhash

    # bytes.lower changes A-Z alone; bytes.split cuts at 0x20 and 0x09-0x0D alone
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for first in range(0, n, 100_000):  # bounded memory for a text of any length
        upto = min(n, first + 100_000)
        hashes = [digest(b" ".join(tokens[i : i + words]), SEED) for i in range(first, upto)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long). Null and empty texts have fingerprint zero."""

    def run(ids: list, texts: list) -> dict:
        values = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
        return {"doc_id": ids, "fp": values.view(np.int64)}

    return map_texts(docs, run, "doc_id long, fp long", id_col, text_col)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int32)


def trie_pairs(group: np.ndarray, value: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose values differ in at most ``budget`` of ``bits`` bits.

    Rows are sorted by (group, value) and distinct; each group is the root of a trie whose nodes
    are ranges of rows. All node pairs of a level are handled together.
    """
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    a0, a1 = starts[many].astype(np.int32), ends[many].astype(np.int32)
    b0, b1, err = a0.copy(), a1.copy(), np.zeros(len(a0), dtype=np.int32)
    left, right = [], []
    for level in range(bits - 1, -1, -1):
        if not len(a0):
            break
        ones = np.r_[0, np.cumsum((value >> np.uint32(level)) & np.uint32(1), dtype=np.int64)]
        am, bm = (a1 - (ones[a1] - ones[a0])).astype(np.int32), (b1 - (ones[b1] - ones[b0])).astype(np.int32)
        same = (a0 == b0) & (a1 == b1)
        kids = [
            (a0, am, b0, bm, err, None),
            (am, a1, bm, b1, err, None),
            (a0, am, bm, b1, err + 1, None),
            (am, a1, b0, bm, err + 1, ~same),  # a node with itself has this pair once already
        ]
        parts = []
        for x0, x1, y0, y1, e, only in kids:
            keep = (x1 > x0) & (y1 > y0) & (e <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
            keep = keep if only is None else keep & only
            parts.append((x0[keep], x1[keep], y0[keep], y1[keep], e[keep]))
        a0, a1, b0, b1, err = (np.concatenate(c) for c in zip(*parts))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():  # two leaves: the bits below are compared at once
            x, y = a0[leaf], b0[leaf]
            below = np.uint32((1 << level) - 1)
            near = err[leaf] + _popcount((value[x] ^ value[y]) & below) <= budget
            left.append(x[near])
            right.append(y[near])
            a0, a1, b0, b1, err = (c[~leaf] for c in (a0, a1, b0, b1, err))
    none = np.empty(0, dtype=np.int32)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _stars(node: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node) of the components that the pairs make of rows of a batch."""
    label = node.copy()
    while len(left):
        before = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        if (label == before).all():
            break
    moved = label != node
    return node[moved], label[moved]


def _subtree_edges(keyed: DataFrame, bits: int, budget: int, partitions: int) -> DataFrame:
    """keyed: (k1, k2, rest, node), all longs -> star edges src, dst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work(columns: list[np.ndarray]):
            k1, k2, rest, node = columns
            new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
            src, dst = _stars(node, *trie_pairs(np.cumsum(new), rest.astype(np.uint32), bits, budget))
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = [np.concatenate(c) for c in zip(held, columns)] if held else columns
            if len(held[0]) < 50_000:
                continue
            # the last group may go on in the next batch
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = int(np.argmax(last))
            if cut:
                yield work([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held and len(held[0]):
            yield work(held)

    dealt = keyed.repartition(partitions, "k1", "k2").sortWithinPartitions("k1", "k2", F.col("rest"))
    return dealt.mapInArrow(run, "src long, dst long")


def near_links(distinct: DataFrame, budget: int = MAX_BITS, hot: int = HOT_NODE) -> DataFrame:
    """distinct: (fp long, node long), fp distinct -> star edges (src, dst) between nodes.

    Nodes that fingerprints within ``budget`` (0 to 2) bits connect are connected by the edges.
    """
    if not 0 <= budget <= 2:
        raise ValueError("the leading blocks are proven for budgets of 0, 1 and 2 bits")
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = lambda c, low, width: F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << width) - 1))

    def leads(column, blocks: int, width: int, tag):
        """Structs (k2 lead, rest) for each pair of blocks, the pair first, the others behind."""
        out = []
        for i, (a, b) in enumerate(combinations(range(blocks), 2)):
            c, d = (x for x in range(blocks) if x not in (a, b))
            word = lambda x: part(column, x * width, width)
            lead = F.shiftleft(word(a), width).bitwiseOR(word(b))
            rest = F.shiftleft(word(c), width).bitwiseOR(word(d))
            out.append(F.struct(tag(i).cast("long").alias("t"), lead.alias("lead"), rest.alias("rest")))
        return F.explode(F.array(*out))

    first = distinct.select("node", leads(F.col("fp"), 4, 16, lambda i: F.lit(i)).alias("s")).select(
        F.col("s.t").alias("k1"), F.col("s.lead").alias("k2"), F.col("s.rest").alias("rest"), "node"
    )
    counts = first.groupBy("k1", "k2").count()
    sizes = counts.where("count > 1").select("k1", "k2", (F.col("count") > hot).alias("hot"))
    grown = written(first.join(sizes, ["k1", "k2"]), "trie")
    cool = grown.where("not hot").select("k1", "k2", "rest", "node")
    heated = grown.where("hot").select(
        "node", "k1", "k2", leads(F.col("rest"), 4, 8, lambda i: F.col("k1") * 8 + i).alias("s")
    ).select(
        F.col("s.t").alias("k1"),
        F.shiftleft("k2", 16).bitwiseOR(F.col("s.lead")).alias("k2"),
        F.col("s.rest").alias("rest"),
        "node",
    )
    links = written(
        _subtree_edges(cool, 32, budget, partitions).unionByName(_subtree_edges(heated, 16, budget, partitions)), "links"
    )
    drop(grown)
    return links


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    budget: int = MAX_BITS,
    hot: int = HOT_NODE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable by links.

    Null and empty texts share fingerprint zero and link with each other (and with any fingerprint
    of ``budget`` bits or fewer). Repeated rows give a row each. A row with a null doc_id has a
    fingerprint, and the component of its fingerprint's other documents (null if it has none).
    Other columns are ignored; an empty table gives an empty result.
    """
    marked = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    links = near_links(distinct.where("node is not null"), budget, hot)
    found = connected_components(links).withColumnsRenamed({"node": "n", "component": "c"})
    drop(links)
    roots = distinct.join(found, distinct["node"] == found["n"], "left").select(
        "fp", F.coalesce("c", "node").alias("component_id")
    )
    return marked.join(roots, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents of ``docs`` that stand for their group: one row each, the least doc_id's.

    Rows with a null doc_id stay. Of repeated rows with one doc_id the one of the least text hash (then the least as
    JSON) stays. Columns may have any names. Only the ids that go, or that are repeated, are joined with the texts, and
    these are broadcast where they are counted to be few.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    by_id = near_duplicates(docs, **options).where("doc_id is not null").groupBy("doc_id").agg(
        F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n")
    )
    marked = written(by_id.where("n > 1 or not stays"), "marked")
    mine = f"id_{uuid.uuid4().hex}"  # a name that no column of docs has
    listed = broadcast_if_small(marked.select(F.col("doc_id").alias(mine)), SMALL_ROWS)
    met = docs[id_col].cast("long") == F.col(mine)
    single = docs.join(listed, met, "left_anti")
    repeated = marked.where("stays").select(F.col("doc_id").alias(mine))
    if repeated.isEmpty():
        return single
    row = F.struct(*(docs[c] for c in docs.columns))
    rows = docs.join(broadcast_if_small(repeated, SMALL_ROWS), met).select(mine, row.alias("row"), F.xxhash64(docs[text_col]).alias("h"))
    # as many rows of one id as there may be are combined before they are shuffled
    first = rows.groupBy(mine).agg(F.min_by("row", F.struct("h", F.to_json("row"))).alias("row"))
    return single.unionByName(first.select("row.*"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
