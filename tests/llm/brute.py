"""Plain-Python versions of the operators' contracts."""

import re
from hashlib import sha256

from xxhash import xxh64_intdigest


def spans_of(text, pattern, kind, ok):
    return [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if ok(m)]


def listed(found, names):
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def secrets(text):
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = spans_of(text, assign, 0, lambda m: len(m[2]) >= 6)
    found += spans_of(text, "AKIA[A-Z0-9]+", 1, lambda m: len(m[0]) >= 20)
    found += spans_of(text, "[0-9a-f]+", 2, lambda m: len(m[0]) >= 24)
    return found


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = spans_of(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, lambda m: True)
    found += spans_of(text, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 1, lambda m: all(int(x) <= 255 for x in m[0].split(".")))
    found += spans_of(text, r"[0-9]([\x20-]?[0-9])+", 2, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)))
    found += spans_of(text, r"\+[0-9][\x20().0-9-]+[0-9]", 3, lambda m: 10 <= len(digits(m)) <= 15)
    return found


def digest(found, names):
    return sha256(listed(found, names).encode()).hexdigest()


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def smallest(ids, links):
    """The smallest id reachable from each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def substrings(rows, length=100):
    """``n_bytes, n_removed, n_spans, digest`` of each document."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(raw), len(raw) - len(kept), spans, sha256(kept).hexdigest())
    return out
