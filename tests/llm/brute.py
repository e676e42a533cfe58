"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer


def token_ids(texts, end_id):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [end_id] for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words(text):
    return (text or "").encode().split()


def substring(docs, window=50):
    """{doc_id: (n_words, n_removed, sha256)} from [(doc_id, text)] with distinct ids."""
    first: dict[bytes, int] = {}
    split = {d: words(t) for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - window + 1):
            key = b" ".join(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[b" ".join(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(docs):
    """{doc_id: (n_shingles, component_id)} from [(doc_id, text)]."""
    sets = {d: shingle_set(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    shared = defaultdict(int)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    pairs = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    found = groups(sets, pairs)
    return {d: (len(s), found[d]) for d, s in sets.items()}


def embedding_links(rows, least=0.93):
    """{vec_id: (n_links, component_id)} from [(vec_id, embedding, label)]."""
    sound = {}
    for i, x, label in rows:
        if x is not None and label is not None and len(x) == 8 and None not in x and np.isfinite(x).all() and any(x):
            v = np.array(x, float)
            sound[i] = (v / np.sqrt(v @ v), label)
    counts, pairs = {i: 0 for i, *_ in rows}, []
    for a, (x, k) in sound.items():
        for b, (y, m) in sound.items():
            if a != b and k == m and x @ y >= least:
                counts[a] += 1
                pairs.append((a, b))
    found = groups(counts, pairs)
    return {i: (counts[i], found[i]) for i in counts}


def runs(words_of_text, least=24, exponent=3):
    """[(start, length, period)] by comparing every word with the one a period before it."""
    w, out = words_of_text, {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def alignment(docs):
    """{doc_id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)} by comparing all token pairs."""
    import sentencepiece

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def ranges(tokens):
        out, at = [], 0
        for token in tokens:
            out.append((at, at + len(token)))
            at += len(token)
        return out

    out, links, counts = {}, {}, defaultdict(int)
    for doc_id, text in docs:
        a = tool.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        a_tokens = [bytes(byte[c] for c in tool.id_to_token(i)) for i in a]
        b_tokens = [bytes([int(n[3:5], 16)]) if n.startswith("<0x") else n.replace("▁", " ").encode() for n in map(pieces.id_to_piece, b)]
        if not text or not b"".join(a_tokens) == b"".join(b_tokens) == b" " + text.encode():
            out[doc_id], links[doc_id] = (0, 0, 0, 0, ""), []
            continue
        x, y = ranges(a_tokens), ranges(b_tokens)
        cuts = sorted({e for _, e in x} & {e for _, e in y})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, spans) if low < e <= cut) for ids, spans in ((a, x), (b, y))))
            low = cut
        links[doc_id] = [(i, j) for i, (s, e) in zip(a, x) for j, (t, f) in zip(b, y) if max(s, t) < min(e, f)]
        for pair in links[doc_id]:
            counts[pair] += 1
        out[doc_id] = (len(a), len(b), len(groups), len(links[doc_id]), ";".join(groups))
    highest = defaultdict(int)
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return {
        d: (*f[:4], sum(counts[p] == highest[p[1]] for p in links[d]), sum(counts[p] for p in links[d]), f[4])
        for d, f in out.items()
    }
