"""Token counts by overlap resynchronisation (operator 9).

A document is counted with the sentencepiece library as it stands. A huge one is encoded in
chunks that overlap, each with the offsets of its pieces. Neighbouring encodings are spliced
at a boundary that both have in the overlap and that is proven stable: a space (which
sentencepiece writes as U+2581) after a character that is none. No piece of the vocabulary
holds U+2581 after another character (checked when the model is loaded), so no merge of the
whole text can cross that place, and what stands on either side is encoded as in the whole
text. Where the overlap holds no such boundary it is widened, up to the whole document.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm.common import map_texts, table, tokenizer_path

MODEL = "piece_bpe_32k.model"
CHUNK_BYTES = 65_536
OVERLAP_BYTES = 1_024
LIMIT_TOKENS = 4_096
SPACE, LOWER_BLOCK = b" ", "▁".encode()


@lru_cache(maxsize=4)
def load(path: str):
    """The processor, and whether a boundary before a space is stable under its vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    spaces_lead = not any("▁" in piece.lstrip("▁") for piece in pieces)
    # an identity normaliser keeps characters one to one, so that offsets and splices hold
    probe = " a  béﬁ\t\n　c "
    identity = sp.decode(sp.encode(probe)) == probe
    return sp, spaces_lead and identity


def _begins(sp, data: bytes, inner: bool = False) -> list[int]:
    """Byte offsets where the pieces of ``data`` begin.

    The library puts a space of its own before what it encodes. Where ``data`` stands inside a text
    and leads with a space (``inner``), that one takes its place, so that it isn't there twice.
    """
    space = (len(SPACE) if data.startswith(SPACE) else len(LOWER_BLOCK)) if inner else 0
    found = [p.begin + space for p in sp.encode(data[space:].decode(), return_type="proto").pieces]
    return [0, *found[1:]] if inner else found


def _snap(data: bytes, at: int) -> int:
    """The nearest start of a character at or before ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _stable(data: bytes, at: int) -> bool:
    space = data.startswith(SPACE, at) or data.startswith(LOWER_BLOCK, at)
    return space and not data.endswith((SPACE, LOWER_BLOCK), max(0, at - 3), at)


def count_spliced(sp, text: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> int:
    """Tokens of ``text``, as ``len(sp.encode(text))`` gives them, in chunks of bounded size."""
    data = text.encode()
    chunk, overlap = max(chunk, 8), max(overlap, 4)
    total, start, n = 0, 0, len(data)
    end = _snap(data, min(n, chunk))
    begins = _begins(sp, data[start:end])
    while end < n:
        right_end, width = _snap(data, min(n, end + chunk)), overlap
        while True:
            left = _snap(data, max(start, end - width))
            right = _begins(sp, data[left:right_end], inner=left == start > 0)
            ours = {start + b for b in begins[bisect.bisect_left(begins, left - start) :]}
            shared = (left + b for b in reversed(right[: bisect.bisect_left(right, end - left)]))
            cut = next((at for at in shared if at > left and at in ours and _stable(data, at)), None)
            if cut is not None or left == start:
                break
            width *= 2
        if cut is None:  # nothing stable in all that is open: it goes on, now with what follows
            begins, end, chunk = right, right_end, 2 * chunk
            continue
        total += bisect.bisect_left(begins, cut - start)
        begins = [b + left - cut for b in right[bisect.bisect_left(right, cut - left) :]]
        start, end = cut, right_end
    return total + len(begins)


def count_tokens(
    docs: DataFrame,
    model: str | None = None,
    limit: int = LIMIT_TOKENS,
    chunk: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Bytes and tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    One narrow Arrow pass, no shuffle. Null and empty texts have 0 bytes and 0 tokens; repeated
    rows and null ids give a row each; an empty table gives none; other columns are ignored.
    """
    path = model or tokenizer_path(MODEL)

    def run(ids: list, texts: list) -> dict:
        sp, stable = load(path)
        texts = [t or "" for t in texts]
        huge = {i for i, t in enumerate(texts) if len(t) > chunk and stable}
        whole = iter(sp.encode([t for i, t in enumerate(texts) if i not in huge], num_threads=1))
        counts = [count_spliced(sp, t, chunk, overlap) if i in huge else len(next(whole)) for i, t in enumerate(texts)]
        return {
            "doc_id": ids,
            "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
            "n_tokens": counts,
            "over_limit": [c > limit for c in counts],
        }

    return map_texts(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
