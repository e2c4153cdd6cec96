"""Plain versions of the operators, for comparison."""

import hashlib
import itertools
import math
import re

import numpy as np
import zstandard

from wakeline.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def shingle_set(text, k):
    w = words(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(texts, k, percent):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def secret_spans(text, rules):
    out = []
    for k, r in enumerate(rules):
        pattern = "[0-9a-f]+" if r.kind == "hex" else r.pattern
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(r.group)) >= r.least]
    return sorted(out)


def redacted(text, rules):
    if text is None:
        return None
    out, at = "", 0
    for start, k, end in secret_spans(text, rules):
        if start >= at:
            out += text[at:start] + f"<{rules[k].kind}>"
        at = max(at, end)
    return out + text[at:]


def quality_verdict(text):
    """kept by the definition, one text at a time."""
    raw, n_words, repeated = text.encode(), len(words(text)), base_counts(text)[4]
    if n_words < 50 or 100 * repeated > 50 * n_words:
        return False
    size = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x))
    if len(raw) >= 256:
        at = [math.log2(b[0]) for b in quality_rules.BANDS]
        low, high = (float(np.interp(math.log2(len(raw)), at, [b[i] for b in quality_rules.BANDS])) for i in (1, 2))
        if not low - 1e-12 <= size(raw) / len(raw) <= high + 1e-12:
            return False
    chunks = [size(raw[i * 4096 : (i + 1) * 4096]) / 4096 for i in range(len(raw) // 4096)]
    return sum(not quality_rules.CHUNK_BAND[0] <= r <= quality_rules.CHUNK_BAND[1] for r in chunks) <= quality_rules.MAX_BAD_CHUNKS * len(chunks)


def mixed(rows, block_rows, target):
    """Rows (ident, source, tokens) as the mix takes them, straight from the definition."""
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    have, by = {}, {}
    for ident, src, n in rows:
        have[src] = have.get(src, 0) + n
        by.setdefault(src, []).append((ident, n))
    _, w = mixing.weights(have, **target)
    out = []
    for src, held in by.items():
        quota = round(w[src] * sum(have.values()))
        epochs, rest = divmod(quota, have[src])
        blocks = {}
        for ident, n in held:
            b = int(digest(f"{mixing.SEED}:block:{ident}")[:8], 16) % -(-len(held) // block_rows)
            blocks.setdefault(b, []).append((digest(f"{mixing.SEED}:{epochs}:{ident}"), ident, n))
        part = []
        for b in sorted(blocks, key=lambda b: digest(f"{mixing.SEED}:{epochs}:b{b}")):
            size = sum(n for *_, n in blocks[b])
            if size > rest:
                for _, ident, n in sorted(blocks[b]):
                    if n > rest:
                        break
                    rest -= n
                    part.append(ident)
                break
            rest -= size
            part += [ident for _, ident, _ in blocks[b]]
        out += [(ident, e) for ident, _ in held for e in range(epochs)] + [(ident, epochs) for ident in part]
    return sorted(out)
