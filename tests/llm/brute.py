"""Plain Python definitions of what the numbered operators return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def contamination(docs, items):
    """doc_id -> n_words, n_hit, n_items, items_sha256, contaminated; unique doc_ids only."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def roots(nodes, links):
    """node -> smallest node reachable."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    words = lower_ascii(text or "")
    words = re.findall("[^\x20\x09-\x0d]+", words)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similar_pairs(sets):
    """Pairs of keys whose sets have a Jaccard similarity of at least 0.8, by counting all."""
    by = defaultdict(list)
    for key, s in sets.items():
        for x in s:
            by[x].append(key)
    for key, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for other in by[x]:
                if other > key:
                    common[other] += 1
        for other, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[other]) - n):
                yield key, other


def groups(docs):
    sets = {doc: shingles(text) for doc, text in docs}
    root = roots(sets, similar_pairs(sets))
    return {doc: (len(s), root[doc]) for doc, s in sets.items()}


def removed_lines(docs):
    """doc_id -> n_lines, removed numbers; unique doc_ids, not null."""
    sets, out = {}, {}
    for doc, text in docs:
        lines = [] if text is None else text.split("\n")
        out[doc] = (len(lines), set())
        for i, line in enumerate(lines):
            words = frozenset(w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w)
            if words:
                sets[doc, i] = words
    for _, (doc, i) in similar_pairs(sets):
        out[doc][1].add(i)
    return {doc: (n, sorted(gone)) for doc, (n, gone) in out.items()}


def embedding_groups(rows):
    """vec_id -> n_links, component_id."""
    good = {
        v: np.array(x, float)
        for v, x in rows
        if x is not None and len(x) and all(y is not None and np.isfinite(y) for y in x) and any(x)
    }
    unit = {v: x / np.linalg.norm(x) for v, x in good.items()}
    links = [
        (a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9
    ]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    root = roots([v for v, _ in rows], links)
    return {v: (count[v], root[v]) for v, _ in rows}


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_verdict(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = lower_ascii(host)
    fits = [
        (len(h) + len(p), len(h), v, h + p)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def pages(rows):
    """page_id -> payload_bytes, payload_digest, record_type, refers_to."""
    data = {p: (html or "").encode() for p, html in rows}
    largest = {}
    for p, d in data.items():
        if len(d) >= 1000:
            largest[d] = max(p, largest.get(d, p))
    out = {}
    for p, d in data.items():
        to = largest.get(d, p)
        out[p] = (len(d), hashlib.sha1(d).hexdigest(), "response" if to == p else "revisit", None if to == p else to)
    return out


def held_out(doc, modulus, remainder):
    return zlib.crc32(str(doc).encode()) % modulus == remainder


def least_padding(lengths, buckets):
    """Padding of the best choice of bucket boundaries, by trying all."""
    from itertools import combinations

    distinct = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(distinct)) + 1):
        for ends in combinations(distinct[:-1], k - 1):
            ends = [*ends, distinct[-1]]
            cost = sum(min(e for e in ends if e >= n) - n for n in lengths)
            best = cost if best is None else min(best, cost)
    return best


def spelling(docs):
    """word -> form, root, n, n_near, form_n."""
    from collections import Counter

    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    return spelling_of(words)


def near_words(words):
    """word -> words one edit away, by all strings that a letter less leaves."""
    less = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[w[:i], w[i + 1 :]].add(w)
    shorter = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            if (x := w[:i] + w[i + 1 :]) in words:
                shorter[w].add(x)
    near = {w: set(shorter[w]) for w in words}
    for w, xs in shorter.items():
        for x in xs:
            near[x].add(w)
    for ws in less.values():
        for w in ws:
            near[w] |= ws - {w}
    return near


def spelling_of(words):
    out, form = {}, {}
    near = near_words(words)
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None)
    return out


def alignment(docs):
    """doc_id -> n_a, n_b, n_groups, n_links, n_best, count_sum, groups; unique doc_ids.

    Every pair of tokens is looked at; their bytes come from the libraries' own offsets or pieces.
    """
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_file.encode_special_tokens = True
    b_file = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def spans(ids, bytes_of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(bytes_of(i)), i))
            at = out[-1][1]
        return out

    def a_bytes(i):
        return bytes(back[c] for c in a_file.id_to_token(i))

    def b_bytes(i):
        p = b_file.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("\u2581", " ").encode()

    links, groups, sizes, holds = {}, {}, {}, defaultdict(set)
    for doc, text in docs:
        links[doc], groups[doc], sizes[doc] = [], "", (0, 0, 0)
        if not text:
            continue
        whole = (" " + text).encode()
        a = spans(a_file.encode(" " + text, add_special_tokens=False).ids, a_bytes)
        b = spans(b_file.encode(text), b_bytes)
        if b"".join(a_bytes(i) for *_, i in a) != whole or b"".join(b_bytes(i) for *_, i in b) != whole:
            continue
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        parts = [([], []) for _ in ends]
        for which, side in enumerate((a, b)):
            at = 0
            for _, e, i in side:
                at += e > ends[at]
                parts[at][which].append(str(i))
        parts = ["|".join(map(",".join, part)) for part in parts]
        groups[doc], sizes[doc] = ";".join(parts), (len(a), len(b), len(ends))
        j = 0
        for s, e, i in a:
            while b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                links[doc].append((i, b[k][2]))
                holds[i, b[k][2]].add(doc)
                k += 1
    count = {pair: len(held) for pair, held in holds.items()}
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return {
        doc: (
            *sizes[doc],
            len(found),
            sum(count[p] == most[p[0]] for p in found),
            sum(count[p] for p in found),
            groups[doc],
        )
        for doc, found in links.items()
    }
