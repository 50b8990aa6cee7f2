"""Plain, slow versions of the operators, straight from their definitions."""

import base64
import hashlib
import re
import struct


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def simhash(docs, shingle, radius):
    """{doc_id: (fingerprint, component_id)} for docs [(doc_id, text)]."""
    import xxhash

    prints = {}
    for d, text in docs:
        w = re.findall("[^\x20\x09-\x0D]+", lower(text))
        grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    groups = components(prints, radius)
    return {d: (f, groups[d]) for d, f in prints.items()}


def components(prints, radius):
    parent = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    return {d: find(parent, d) for d in prints}


def similar(docs, shingle=5, similarity=0.8):
    """{doc_id: component_id} for docs [(doc_id, text)] by the Jaccard similarity of word shingles, all pairs."""
    sets = {}
    for d, text in docs:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        n = min(shingle, len(w))
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    parent = {d: d for d in sets}
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    return {d: find(parent, d) for d in sets}


def contamination(docs, items, width=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([str(i)] if i is not None else [])
    out = {}
    for d, t in docs:
        w, hit, own = cut(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    own |= ids
        out[d] = (len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    """[(kind, start, end)] in order."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def all_spans(docs, rounds=3, support=3, confidence=0.8):
    """{doc_id: [(kind, start, end)]} of docs [(doc_id, text)]: base spans, keys, and what patterns find, straight from the definitions."""
    import math

    kinds = ["email", "ip", "card", "phone", "secret"]
    raw = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}+)(?![A-Za-z0-9])",
        "identifier": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{6,}+",
    }
    behind = re.compile(r"""([^\x00-\x20=:#"'(<\[]{1,32}[\x20\t]?[=:#"'(<\[]{1,2}[\x20\t]?["']?|[^\x00-\x20]{1,32}\x20[^\x00-\x20]{1,32}\x20)\Z""")
    seeds, others, edges = {}, {}, {}
    for d, text in docs:
        text, found = text or "", {}
        good = {*base_spans(text)}
        for k, p in raw.items():
            last = 0
            for m in re.finditer(p, text):
                c = behind.search(text[last : m.start()][-72:])
                last = m.end()
                if k in ("secret", "identifier") or (k, *m.span()) in good:
                    found.setdefault(k, []).append((*m.span(), c[1].lower() if c else "", m[0]))
        seeds[d] = [(k, *x) for k in kinds for x in found.get(k, ())]
        others[d] = [x for x in found.get("identifier", ()) if not any(a < x[1] and x[0] < b for _, a, b, *_ in seeds[d])]
        for k, _, _, c, v in [*seeds[d], *((None, *x) for x in others[d])]:
            if c:
                n, old = edges.get((c, v), (0, None))
                edges[c, v] = (n + 1, kinds.index(k) if k and (old is None or kinds.index(k) < old) else old)
    score = {}
    for (_, v), (_, k) in edges.items():
        old = score.get(v, (0.0, None))
        score[v] = (1.0, k if old[1] is None else min(k, old[1])) if k is not None else old
    certain = {v for v in score if score[v][1] is not None}
    for r in range(rounds):
        trust = {}
        for c in {c for c, _ in edges}:
            own = [(n, *score[v]) for (x, v), (n, _) in edges.items() if x == c]
            votes = [k for _, s, k in own if s >= confidence]
            if len(votes) >= support:
                trust[c] = (sum(s * n for n, s, _ in own) / sum(n for n, *_ in own), min(votes, key=lambda k: (-votes.count(k), k)))
        if r + 1 < rounds:
            now = {}
            for v in score:
                own = [trust[c] for c, x in edges if x == v and c in trust]
                best = min(own, key=lambda t: (-t[0], t[1]), default=(0, None))
                now[v] = score[v] if v in certain else (1 - math.prod(1 - min(t[0], 0.999999) for t in own), best[1])
            score = now
    trust = {c: k for c, (p, k) in trust.items() if p >= confidence}
    out = {}
    for d in seeds:
        spans = [(kinds.index(k), a, b) for k, a, b, *_ in seeds[d]] + [(trust[c], a, b) for a, b, c, _ in others[d] if c in trust]
        out[d] = [(kinds[k], a, b) for k, a, b in sorted(spans)]
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), n < 10 or 100 * len(covered) > 20 * n


def tokens(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(tokenizer.decode(ids, skip_special_tokens=False))


def base32_sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def line_chunks(lines):
    """{(start, end)}: a cut comes after a line, two or more into the chunk, where the xor of its hash with that of the line before, turned left by one bit, is even."""
    import xxhash

    h = [xxhash.xxh64_intdigest(x.encode()) for x in lines]
    cuts, last = set(), 0
    for i in range(1, len(h) + 1):
        even = i > 1 and (h[i - 1] & 1) == (h[i - 2] >> 63)
        if i == len(h) or (i - last >= 2 and even):
            cuts.add((last, i))
            last = i
    return cuts


def dedup_lines(docs, runs=False, need=50):
    """{doc_id: kept text} of docs [(doc_id, text)] by brute force: every repeated chunk, and with `runs` every repeated run of lines of `need` words, but for the first."""
    places = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        words = [len(re.findall("[^\x20\x09-\x0D]+", x)) for x in lines]
        cut = {(True, a, b) for a, b in line_chunks(lines) if sum(words[a:b]) >= need or (b - a > 1 and sum(words[a:b]))}
        if runs:
            cut |= {(False, a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if sum(words[a:b]) >= need}
        for chunk, a, b in cut:
            places.setdefault((chunk, "\n".join(lines[a:b])), []).append((d, a, b))
    gone = set()
    for own in places.values():
        (first, _, end), *rest = sorted(own)
        gone |= {(d, i) for d, a, b in rest if d != first or a >= end for i in range(a, b)}
    return {d: "\n".join(x for i, x in enumerate((text or "").split("\n")) if (d, i) not in gone) for d, text in docs}
