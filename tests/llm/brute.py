"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def jaccard(rows, threshold=0.8):
    """[(class id, links)] of (id, text) rows."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j > i).items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    key = lambda v: (v is not None, v or 0)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min(low.get(r, d), d, key=key) if r in low else d
    return [(low[find(i)], links[i]) for i in range(len(rows))]


def repeats(rows, passage=50):
    """{id: spans} of words in passages that stand in two documents; ids are distinct."""
    holders = defaultdict(set)
    texts = {i: words(t) for i, t in rows}
    for i, w in texts.items():
        for k in range(len(w) - passage + 1):
            holders[tuple(w[k : k + passage])].add(i)
    out = {}
    for i, w in texts.items():
        spans = []
        for k in range(len(w) - passage + 1):
            if len(holders[tuple(w[k : k + passage])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + passage
                else:
                    spans.append([k, k + passage])
        if spans:
            out[i] = spans
    return out


def contamination(texts, items, size=10):
    """[(words, hit words, items)] of texts."""
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for t in texts:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    got |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in got if x is not None)))
    return out


def line_dedup(rows, min_chars=20, min_docs=3):
    """[(id, lines, dropped lines, kept text)] of (id, text) rows."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    rank = lambda i: (i is not None, i or 0)
    last = {k: max(h, key=rank) for k, h in holders.items() if len(k) >= min_chars and len(h) >= min_docs}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [line for line in ls if key(line) not in last or last[key(line)] == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def centroids(rows, clusters=16, dim=64, rounds=3, scale=64, limit=1 << 27):
    """[(id, cluster, distance, cluster inertia, inertia, digest)] of (id, vector) rows."""
    kept = [(i, [max(-limit, min(limit, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        best = [min((apart(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        for j in range(len(centres) if k < rounds else 0):
            own = [v for (_, v), (_, b) in zip(kept, best, strict=True) if b == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for d, j in best if kept else []:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    cap = (1 << 63) - 1
    return [(i, j, d, min(cap, inertia[j]), min(cap, sum(inertia.values())), names[j]) for (i, _), (d, j) in zip(kept, best if kept else [], strict=True)]


def divergence(rows, min_docs=10, top=10):
    """[(lang, source, part, item, value, rank)] of (text, lang, source) rows."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        got = Counter(term.findall((text or "").translate(LOW)))
        counts[lang, source].update(got)
        held[lang].update(got.keys())
    out = []
    for lang in held.keys() | {x for x, _ in counts}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def rates(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: rates(c) for s, c in groups.items()}
        q = rates(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1]))[: top if part == "term" else None]
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1)]
    return out


def quality_score(machine, bucket_of, text):
    """Score of a text by a factorisation machine, with every pair of features; ``bucket_of`` gives a word's bucket."""
    raw = (text or "").encode()
    w = words(text)
    n, per = max(1, len(w)), max(1, len(raw))
    count = Counter(map(bucket_of, w))
    symbols = {c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()"}
    of = lambda keep: sum(1 for c in raw if keep(c))
    stats = [
        math.log1p(len(raw)) / 10,
        math.log1p(len(w)) / 10,
        sum(len(x.encode()) for x in w) / n / 10,
        len(count) / n,
        of(symbols.__contains__) / per * 10,
        of(lambda c: 48 <= c <= 57) / per * 10,
        of(lambda c: 65 <= c <= 90) / per * 10,
        of(b".!?".__contains__) / n * 5,
        of(lambda c: c == 10) / n * 5,
        of(lambda c: c == 32) / n,
        of(lambda c: c >= 128) / per * 5,
        max(count.values(), default=0) / n * 5,
    ]
    size = len(machine.weight) - len(stats)
    x = {b: math.sqrt(c) / math.sqrt(n) for b, c in count.items()}
    for k, v in enumerate(stats):
        x[size + k] = max(-4.0, min(4.0, (v - machine.mean[k]) / machine.scale[k])) / math.sqrt(len(stats))
    z = machine.bias + sum(machine.weight[i] * v for i, v in x.items())
    some = list(x)
    for a, i in enumerate(some):
        for j in some[:a]:
            z += float(machine.factor[i] @ machine.factor[j]) * x[i] * x[j]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def licenses(text, templates, bigrams, threshold=0.8):
    """{template: best Dice coefficient} over the lines, paragraphs, whole text and all windows of the template's size."""
    text = text or ""
    blocks = re.split(r"\n[ ]*\n\s*", text) if re.search(r"\n[ ]*\n", text) else []
    units = [bigrams(u) for u in text.split("\n") + blocks + ([text] if "\n" in text else [])]
    every, out = bigrams(text), {}
    for name, own in templates.items():
        need, m = Counter(own), len(own)
        dice = lambda w: 2 * sum((Counter(w) & need).values()) / (len(w) + m) if w else 0.0  # noqa: B023, E731
        best = max((dice(w) for w in units), default=0.0)
        have, common = Counter(), 0
        for k, g in enumerate(every):  # the window that ends here
            have[g] += 1
            common += have[g] <= need[g]
            if k >= m:
                common -= have[every[k - m]] <= need[every[k - m]]
                have[every[k - m]] -= 1
            if k >= m - 1:
                best = max(best, common / m)
        if best >= threshold - 1e-12:
            out[name] = best
    return out


def mixed_scores(texts, training, weights, refined, prior=0.1, exact=64, places=4, seen=12, cells=33):
    """log10 probability of each text by context mixing with given weights and map, bit by bit with counts of whole contexts."""

    def kind(byte):
        return 1 if byte > 127 or chr(byte).isalnum() else 2 if byte in b".!?" else 3

    def tokens(text):
        out, before = [], 0
        for w in re.findall(b"[^ \t\n\x0b\x0c\r]+", (text or "").translate(LOW).encode()):
            out.append((before, w))
            before = kind(w[-1])
        return [*out, (before, b"")]

    def steps(before, w):
        """(symbol, place, contexts) of each byte and the terminator."""
        symbols = [*w, 32]
        for p, s in enumerate(symbols):
            last = [symbols[p - d] if p >= d else before + 1 if p == d - 1 else 0 for d in range(1, 5)]
            yield s, p, [*(tuple(last[: d + 1]) for d in range(4)), ("so far", *symbols[:p])]

    counts = defaultdict(int)  # (predictor, context, bits so far of the symbol)
    for t, use in zip(texts, training, strict=True):
        for before, w in tokens(t) if use else ():
            for s, _, contexts in steps(before, w):
                bits = f"{s:08b}"
                for i, c in enumerate(contexts):
                    for b in range(1, 9):
                        counts[i, c, bits[:b]] += 1
    code = lambda n: n if n <= exact else exact * 2 ** ((min(255, exact + round(6 * math.log2(n / exact))) - exact) / 6)

    def token(before, w):
        total = 0.0
        for s, p, contexts in steps(before, w):
            bits = f"{s:08b}"
            for b in range(8):
                pairs = [(code(counts[i, c, bits[:b] + "0"]), code(counts[i, c, bits[:b] + "1"])) for i, c in enumerate(contexts)]
                level = [min(int(math.log2(x + y + 1)), seen - 1) for x, y in pairs]
                row = weights[(min(p, places - 1) * seen + level[3]) * seen + level[4]]
                z = float(row[5]) + sum(float(row[i]) * (math.log(y + prior) - math.log(x + prior)) for i, (x, y) in enumerate(pairs))
                z = (z + float(refined[b][min(cells - 1, max(0, round(z * 2) + cells // 2))])) / 2
                z = max(-14.0, min(14.0, z))
                total -= math.log1p(math.exp(-z if bits[b] == "1" else z)) / math.log(10)
        return total

    known = {}
    return [sum(known.setdefault(x, token(*x)) if x not in known else known[x] for x in tokens(t)) for t in texts]
