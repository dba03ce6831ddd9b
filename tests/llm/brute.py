"""What the contracts say, in plain loops over lists of rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WS = "[\x20\x09-\x0d]"
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text):
    return WORD.findall(text or "")


def op2(rows, min_docs=10):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))

    split = [(d, (t or "").split("\n")) for d, t in rows]
    found = Counter(k for _, lines in split for k in {key(x) for x in lines})
    out = []
    for d, lines in split:
        kept = [x for x in lines if not key(x) or found[key(x)] < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


KINDS3 = ["email", "ip", "card", "phone"]


def op3(text):
    text, spans = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (KINDS3.index(s[0]), s[1]))


KINDS4 = ["assign", "access", "hex"]
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def op4(text):
    text, spans = text or "", []
    spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda s: (s[1], KINDS4.index(s[0])))


def spelled(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op5(rows, length=400):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(t), sum(gone), runs, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def op7_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op7(rows, radius=2):
    prints = [(d, op7_fingerprint(t)) for d, t in rows]
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{p:016x}", least[root(i)]) for i, (d, p) in enumerate(prints)]


def op8(rows, length=20):
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if k in first:
                gone[i : i + length] = [True] * length
            else:
                first[k] = d
        out[d] = (d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return list(out.values())


def op9(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(WS, "", t or "")].append((-len(t or ""), d))
    return [
        (d, min(g := groups[k])[1], len(g), min(g)[1] == d, sha(k)) for d, t in rows for k in [re.sub(WS, "", t or "")]
    ]


def op10(text):
    w = words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(tri), set()
    for i, x in enumerate(tri):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    stats = (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )
    return *stats, stats[0] < 50 or 100 * stats[4] > 50 * stats[0]


def crc(ids) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
