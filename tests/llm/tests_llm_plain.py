"""Plain versions of operators, to compare with."""

import re

import xxhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    near = {a: [b for b in ids if (prints[a] ^ prints[b]).bit_count() <= 2] for a in ids}
    comp = {i: i for i in ids}
    while True:
        after = {a: min(comp[b] for b in near[a]) for a in ids}
        if after == comp:
            return comp
        comp = after


def line_words(line):
    line = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))


def brute_lines(docs, threshold=0.8):
    """docs: (doc_id, text) with distinct ids -> {doc_id: (text, lines, removed)}."""
    by_size, out = {}, {}
    for i, text in sorted(d for d in docs if d[1] is not None):
        kept, lines = [], text.split("\n")
        for line in lines:
            own = line_words(line)
            if not own:
                kept.append(line)
                continue
            m = len(own)
            sizes = [s for s in by_size if 5 * min(s, m) >= 4 * max(s, m)]
            if not any(len(own & o) >= threshold * len(own | o) - 1e-9 for s in sizes for o in by_size[s]):
                kept.append(line)
            by_size.setdefault(m, set()).add(own)
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out
