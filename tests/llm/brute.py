"""Plain versions of the operators, for small inputs."""

import hashlib
import re

SPACE = " \t\n\x0b\x0c\r"


def suffix_dedup(rows, length):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of what is kept)}"""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def simhash(text):
    import xxhash

    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    """Smallest id each id reaches; fps: [(id, fingerprint)]."""
    parent = {i: i for i, _ in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(fps):
        for j, b in fps[:n]:
            if bin(a ^ b).count("1") <= radius:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def quality(text):
    words = [w for w in re.split(f"[{SPACE}]+", text or "") if w]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if any(c not in SPACE for c in x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside),
    )


def decontaminate(rows, items, window=13):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = {}
    for item, text in items:
        words = cut(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        words, hit, names = cut(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[w]
        out.append((doc_id, len(words), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def boundaries(text):
    return [0, *(m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text, re.S))]


def fill_middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    at = boundaries(text)
    n = len(at) - 1
    a, b = (at[k] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def top_k(rows, asked, k, scale=256):
    """[(query_id, rank, vec_id, score)]; asked: predicate of an id."""
    import math

    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)

    have = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and usable(v)]
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for query, q in sorted({(i, v) for i, v in have if asked(i)}):
        scores = sorted((-clip(sum(x * y for x, y in zip(q, v))), i) for i, v in have if i != query)
        out += [(query, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def repaired(rows, costs=(0, 1, 2, 5, 5)):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation's (turn, role, text)."""
    keep, rerole, delete, insert, extra = costs
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # by the initial before
    whole, counts, seen = {"s": "system", "u": "user", "a": "assistant"}, dict.fromkeys("fine truncated duplicate blank".split(), 0), set()

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                for letter in "ua":
                    if (then := step.get((state, letter))) is not None:
                        new = (cost + insert, audit + "I", (*lines, whole[letter] + ":"))
                        best[then] = min(best.get(then, new), new, key=lambda x: x[:2])
        return best

    best = inserted({"": (0, "", ())})
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "fine" if bare[-1] in ".!?" else "truncated"
        counts[fault] += 1
        seen.add((role, text))
        now = {}
        for state, (cost, audit, lines) in best.items():
            found = [(state, (cost + delete, audit + "D", lines))]
            if fault in ("fine", "truncated"):
                more = extra * (fault == "truncated")
                if (then := step.get((state, role[:1]))) is not None:
                    found.append((then, (cost + keep + more, audit + "K", (*lines, f"{role}:{text}"))))
                for letter in "ua":
                    if (then := step.get((state, letter))) is not None:
                        found.append((then, (cost + rerole + more, audit + "R", (*lines, f"{whole[letter]}:{text}"))))
            for then, new in found:
                now[then] = min(now.get(then, new), new, key=lambda x: x[:2])
        best = inserted(now)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, lines
