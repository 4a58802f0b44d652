"""Plain versions of the operators' results, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def statistics(text):
    w = words(text)
    seen = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def without_earlier(rows, length=50):
    """rows of (doc_id, text): (doc_id, n_bytes, n_removed, n_spans, sha256), rows with equal ids at once."""
    last = max([i for i, _ in rows if i is not None], default=0) + 1
    seen, out = set(), []
    for key in sorted({last if i is None else i for i, _ in rows}):
        own = [(i, (t or "").encode()) for i, t in rows if (last if i is None else i) == key]
        for i, b in own:
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - length + 1):
                if b[k:k + length] in seen:
                    gone[k:k + length] = True
            spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
            kept = bytes(np.frombuffer(b, np.uint8)[~gone])
            out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        for _, b in own:
            seen.update(b[k:k + length] for k in range(len(b) - length + 1))
    return out


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """rows of (doc_id, text): (doc_id, fingerprint, smallest id within reach)."""
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                group[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, f"{fps[k]:016x}", least.get(top(k))) for k, (i, _) in enumerate(rows)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
