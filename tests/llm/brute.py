"""Plain-Python versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import defaultdict


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def op1(docs, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - n + 1)):
                windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if got := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def op4(docs, least=10):
    def key(line):
        return ascii_lower(line.strip(" \t\n\x0b\x0c\r"))

    first = {}
    for doc, text in docs:
        if doc is not None:
            for line in (text or "").split("\n"):
                first[key(line)] = min(doc, first.get(key(line), doc))
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < least or first[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def op7(docs):
    """Ids must be distinct and not null."""
    sets = {doc: shingles(text) for doc, text in docs}
    where = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            where[x].append(doc)
    shared = defaultdict(int)
    for held in where.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                shared[min(a, b), max(a, b)] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    of = components(sets, links)
    return [(doc, len(sets[doc]), of[doc], of[doc] == doc) for doc in sets]


def op10(rows, least=0.93):
    """Ids must be distinct and not null."""
    import numpy as np

    ok = {}
    for vec, v, label in rows:
        if label is not None and v is not None and None not in v and len(v):
            x = np.array(v, float)
            if np.isfinite(x).all() and np.linalg.norm(x) > 0:
                ok[vec] = (label, x / np.linalg.norm(x))
    links = []
    for label in {k for k, _ in ok.values()}:
        ids = [i for i, (k, _) in ok.items() if k == label]
        for size in {len(ok[i][1]) for i in ids}:
            own = [i for i in ids if len(ok[i][1]) == size]
            x = np.stack([ok[i][1] for i in own])
            a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
            links += [(own[i], own[j]) for i, j in zip(a, b)]
    of = components([r[0] for r in rows], links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return [(r[0], n[r[0]], of[r[0]], of[r[0]] == r[0]) for r in rows]


def op9_base(docs):
    kinds = (
        ("assign", r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    out = []
    for doc, text in docs:
        spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
        digest = sha(",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(spans)))
        out.append((doc, *(sum(1 for x in spans if x[1] == k) for k in range(3)), digest))
    return out


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return ascii_lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def op8_rule(url, rules):
    host, path = host_path(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def op2(docs, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    out = []
    for doc, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def op6(docs, path, limit=1024):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    out = []
    for doc, text in docs:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out.append((doc, len((text or "").encode()), n, n > limit))
    return out


def kept_lines(docs, least=10):
    """The texts that line dedup leaves."""
    report = {}

    def key(line):
        return ascii_lower(line.strip(" \t\n\x0b\x0c\r"))

    first = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            first[key(line)] = min(doc, first.get(key(line), doc))
    for doc, text in docs:
        report[doc] = text if text is None else "\n".join(x for x in text.split("\n") if len(key(x)) < least or first[key(x)] == doc)
    return report


def runs(w, least=12):
    """(start, length, period) of every run of a list of words, lag by lag."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            first = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - first >= q and i - first + q >= least:
                found.setdefault((first, i - first + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def op11(docs):
    import zlib

    out = []
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if doc is not None and w and zlib.crc32(str(doc).encode()) % 10 == 0:
            g, n = zlib.crc32(str(doc).encode()) // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc, len(found), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def op13(rows):
    """Rows (vec_id, embedding, label); ids must be distinct."""
    import math

    whole = {}
    for vec, v, label in rows:
        if vec is not None and label is not None and v is not None and None not in v and all(map(math.isfinite, v)):
            whole[vec] = ((label + 1) % 10 if vec % 7 == 0 else label, [math.floor(256 * x) for x in v])
    out = []
    for a in (i for i in whole if i % 50 == 0):
        score = {i: sum(x * y for x, y in zip(whole[a][1], whole[i][1])) for i in whole if i != a}
        by = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in by if whole[i][0] == whole[a][0]][:5]:
            fit = [i for i in by if whole[i][0] != whole[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:3])]
    return out


def lm(docs, train, deleted, order, start=0.5, rounds=200):
    """(tokens, known, N, base, score) of each text by deleted interpolation, one token at a time."""
    import math
    from collections import Counter

    texts = [[*re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text)), None] for _, text in docs]

    def padded(w):
        return ["<s>"] * (order - 1) + w

    def count(which):
        grams, contexts = Counter(), Counter()
        for w, use in zip(texts, which):
            w = padded(w) if use else []
            for i in range(order - 1, len(w)):
                for r in range(1, order + 1):
                    grams[tuple(w[i - r + 1 : i + 1])] += 1
                    contexts[(r, *w[i - r + 1 : i])] += 1
        return grams, contexts, sum(1 for g in grams if len(g) == 1)

    def events(w, upto, model, weights):
        """(bucket, estimate, mixture below) of order ``upto`` at each token."""
        grams, contexts, types = model
        w = padded(w)
        for i in range(order - 1, len(w)):
            below = 1 / (types + 1)
            for r in range(1, upto + 1):
                n = contexts[(r, *w[i - r + 1 : i])]
                f = grams[tuple(w[i - r + 1 : i + 1])] / max(n, 1)
                last = (n.bit_length(), f, below)
                x = weights[r].get(n.bit_length(), 0.0) if n else 0.0
                below = x * f + (1 - x) * below
            yield *last, below

    kept, full = count([t and not d for t, d in zip(train, deleted)]), count(train)
    weights = {}
    for r in range(1, order + 1):
        weights[r] = {}
        seen = [e for w, t, d in zip(texts, train, deleted) if t and d for e in events(w, r, kept, weights)]
        by = defaultdict(list)
        for b, f, below, _ in seen:
            if b:
                by[b].append(f / below)
        found = {}
        for b, ratios in by.items():
            x = start
            for _ in range(rounds):
                x = sum(x * q / (x * q + 1 - x) for q in ratios) / len(ratios)
                x = min(max(x, 1e-6), 1 - 1e-6)
            found[b] = x
        for b in range(1, 65):
            lower = [k for k in found if k <= b]
            weights[r][b] = found[max(lower)] if lower else found[min(found)] if found else start
    total = sum(n for g, n in full[0].items() if len(g) == 1)
    out = []
    for w in texts:
        c = [full[0][(x,)] for x in w]
        base = sum(math.log10((x + 1) / (total + full[2] + 1)) for x in c)
        out.append((len(w), sum(x > 0 for x in c), total, base, sum(math.log10(e[3]) for e in events(w, order, full, weights))))
    return out
