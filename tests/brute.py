"""Plain Python versions that the operators are held against."""

import random
from collections import Counter, defaultdict

FLIP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(FLIP)


def genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def counts(seqs, k):
    c = Counter()
    for s in seqs:
        c.update(min(s[i : i + k], rc(s[i : i + k])) for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT"))
    return c


def unitigs(c, k, solid=2, low_run=0):
    """Walks from every solid k-mer in both strands; the set of canonical (larger) sequences, without cycles."""
    ok = lambda m: c.get(min(m, rc(m)), 0)

    def follow(m):
        ext = [m[1:] + b for b in "ACGT"]
        good = [e for e in ext if ok(e) >= solid]
        low = [e for e in ext if ok(e) >= 1] if low_run else []
        if len(good) == 1:
            return good[0]
        return low[0] if not good and len(low) == 1 else None

    def step(m):
        n = follow(m)
        return n if n and follow(rc(n)) == rc(m) else None

    out = set()
    for kmer, n in c.items():
        if n < solid:
            continue
        for m in (kmer, rc(kmer)):
            # Back to the start of the path, then forward.
            first, run, seen, cycle = m, 0, {m}, False
            now = m
            while (p := step(rc(now))) is not None:
                now = rc(p)
                if now in seen:
                    cycle = True
                    break
                seen.add(now)
                run = 0 if ok(now) >= solid else run + 1
                if run > low_run:
                    break
                if ok(now) >= solid:
                    first = now
            if cycle:
                continue
            path, last, run, now = [first], 1, 0, first
            while (n2 := step(now)) is not None:
                now = n2
                path.append(now)
                run = 0 if ok(now) >= solid else run + 1
                if run > low_run:
                    break
                if ok(now) >= solid:
                    last = len(path)
            path = path[:last]
            s = path[0] + "".join(x[-1] for x in path[1:])
            out.add(max(s, rc(s)))
    return out


def overlaps(us, k):
    n, out = k - 1, set()
    for a, sa in us.items():
        for b, sb in us.items():
            if a == b:
                continue
            for ori, t in (("N", sb), ("I", rc(sb))):
                if sa[-n:] == t[:n]:
                    out.add((a, b, len(sa) - n, len(sb) - n, ori))
                if sa[:n] == t[-n:]:
                    out.add((a, b, n - len(sb), n - len(sa), ori))
    return out


def adjacency(us, k):
    out = defaultdict(set)
    for a, sa in us.items():
        for oa, x in (("F", sa), ("R", rc(sa))):
            for b, sb in us.items():
                if a != b:
                    for ob, y in (("F", sb), ("R", rc(sb))):
                        if x[-(k - 1) :] == y[: k - 1]:
                            out[a, oa].add((b, ob))
    return out
