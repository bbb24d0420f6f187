"""Plain Python forms of what the queries must return, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from tokenizers import Tokenizer

BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN_WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(UPPER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def line_dedup(docs, max_ratio=0.05, min_pages=5):
    strip = " \t\n\x0b\f\r"
    texts = {(d["source"], d["text"]) for d in docs if d["text"] is not None}
    totals = Counter(source for source, _ in texts)
    pages = Counter((source, line) for source, text in texts for line in {x.strip(strip) for x in text.split("\n")} - {""})
    bad = set()
    for (source, line), n in pages.items():
        words = len(PLAIN_WORD.findall(line))
        if n >= (3 if words > 50 else min_pages) and n > max_ratio * totals[source] * min(1, (10 / words) ** 2):
            bad.add((source, line))
    out = []
    for d in docs:
        lines = [] if d["text"] is None else d["text"].split("\n")
        kept = [x for x in lines if (d["source"], x.strip(strip)) not in bad]
        out.append((d["doc_id"], len(lines), len(lines) - len(kept), None if d["text"] is None else "\n".join(kept)))
    return out


def decontamination(docs, items):
    windows = {}
    for item in items:
        words = BENCH_WORD.findall(low(item["text"]))
        n = min(13, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k:k + n]), set()).add("null" if item["item_id"] is None else str(item["item_id"]))
    out = []
    for d in docs:
        words = BENCH_WORD.findall(low(d["text"]))
        hit, names = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if found := windows.get(tuple(words[k:k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((d["doc_id"], len(words), len(hit), len(names), sha(",".join(sorted(names))), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def secret_spans(text):
    kinds = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
             ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16))
    spans = []
    for k, (name, pattern, ok) in enumerate(kinds):
        spans += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if ok(m)]
    return sorted(spans)


def secrets(docs):
    out = []
    for d in docs:
        spans = secret_spans(d["text"])
        joined = ",".join(f"{name}:{start}:{end}" for start, _, name, end in spans)
        out.append((d["doc_id"], *(sum(s[1] == k for s in spans) for k in range(3)), sha(joined)))
    return out


def fingerprint(text, size=3):
    words = PLAIN_WORD.findall(low(text))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + size]) for k in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, radius=2, size=3):
    prints = [fingerprint(d["text"], size) for d in docs]
    parent = list(range(len(docs)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in combinations(range(len(docs)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            parent[root(a)] = root(b)
    least = {}
    for k, d in enumerate(docs):
        if d["doc_id"] is not None:
            least[root(k)] = min(least.get(root(k), d["doc_id"]), d["doc_id"])
    return [(d["doc_id"], f"{p:016x}", least.get(root(k))) for k, (d, p) in enumerate(zip(docs, prints))]


def token_ids(docs, path, end=()):
    tokenizer = Tokenizer.from_file(path)
    return [[*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, *end] for d in docs]


def token_files(docs, path):
    docs = sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, d["text"] or ""))
    out, start = [], 0
    for d, ids in zip(docs, token_ids(docs, path, (1,))):
        out.append((d["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    return out


def token_counts(docs, path):
    return [(d["doc_id"], len((d["text"] or "").encode()), len(ids), len(ids) > 2048) for d, ids in zip(docs, token_ids(docs, path))]


def pieces(docs, path, capacity=2048):
    out = []
    for d, ids in zip(docs, token_ids(docs, path, (0,))):
        first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
        bounds = [0, *range(first, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        out += [(d["doc_id"], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    return out


def license_base(docs):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    out = []
    for d in docs:
        words = BENCH_WORD.findall(low(d["text"]))
        found = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k:k + len(p)]) == p]
        starts = [k for k, _ in found]
        out.append((d["doc_id"], len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))))
    return out


def template_labels(text, templates, threshold=0.9):
    labels, words = set(), BENCH_WORD.findall(low(text))
    longest = max(len(BENCH_WORD.findall(low(t))) for _, t in templates)
    for at in range(0, max(len(words), 1), longest):
        block = set(words[at:at + 2 * longest])
        for label, template in templates:
            own = set(BENCH_WORD.findall(low(template)))
            if len(own & block) >= threshold * len(own) - 1e-9:
                labels.add(label)
    return labels


def quality_base(docs):
    out = []
    for d in docs:
        text = d["text"] or ""
        words = PLAIN_WORD.findall(text)
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        seen = Counter(windows)
        repeated = {p for k, w in enumerate(windows) if seen[w] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in text.split("\n") if PLAIN_WORD.search(x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        out.append((d["doc_id"], len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed))
    return out


def kept(docs, min_rows, fence=3.0, widen=6.0, gamma=1.01 / 0.99):
    """Verdicts of the adaptive rules: quantiles by rank over the documents that pass the base rule, in the widest group needed."""
    import math

    base = quality_base(docs)
    share = lambda n, of: n / of if of else 0.0
    measures = [{"word_length": share(b[2], b[1]), "symbol_share": share(b[3], b[2]), "dup_line_share": share(b[4], b[1]), "repeat_share": share(b[5], b[1])} for b in base]
    bucket = lambda v: 0 if v <= 1e-6 else math.ceil(math.log(v / 1e-6) / math.log(gamma))
    value = lambda b: 0.0 if b == 0 else 1e-6 * gamma ** b * 2 / (1 + gamma)
    passed = [k for k, b in enumerate(base) if not b[-1]]
    out = []
    for k, d in enumerate(docs):
        scopes = ([j for j in passed if (docs[j]["lang"], docs[j]["source"]) == (d["lang"], d["source"])], [j for j in passed if docs[j]["lang"] == d["lang"]], passed)
        rows = next((s for s in scopes if len(s) >= min_rows), passed)
        ok = not base[k][-1]
        for m in measures[0]:
            ordered = sorted(value(bucket(measures[j][m])) for j in rows)
            at = lambda q: ordered[max(math.ceil(q * len(ordered)), 1) - 1]
            spread = at(0.75) - at(0.25)
            floor = {"word_length": 0.5, "symbol_share": 0.02, "dup_line_share": 0.05, "repeat_share": 0.2}[m]
            reach = max(fence * spread, floor) * (1 + widen / math.sqrt(len(ordered)))
            ok &= measures[k][m] <= at(0.75) + reach
            ok &= m != "word_length" or measures[k][m] >= at(0.25) - reach
        out.append((d["doc_id"], ok))
    return out
