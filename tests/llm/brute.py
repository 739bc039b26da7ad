"""Plain versions of what the queries return, for small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def rules(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    inside = {k for i in range(len(ws) - 4) if grams[tuple(ws[i:i + 5])] > 1 for k in range(i, i + 5)}
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside),
            "base_failed": len(ws) < 10 or 100 * len(inside) > 20 * len(ws)}


def host_verdicts(docs, least_rate=0.2, max_rate=0.5, doubt=2.0):
    """doc index -> kept, for rows of (source, base_failed)."""
    n, f = Counter(), Counter()
    for source, failed in docs:
        n[source] += 1
        f[source] += failed
    m = sum(f.values()) / sum(n.values())
    rates = [f[s] / n[s] for s in n]
    mean = sum(rates) / len(rates)
    beyond = sum((r - mean) ** 2 for r in rates) / len(rates) - m * (1 - m) * sum(1 / n[s] for s in n) / len(n)
    total = sum(n.values())
    strength = min(max(m * (1 - m) / beyond - 1, 0.5), total) if beyond > 0 and 0 < m < 1 else total
    rate = {s: (m * strength + f[s]) / (strength + n[s]) for s in n}
    bound = min(max(m + (m * (1 - m) / (strength + 1)) ** 0.5, least_rate), max_rate)
    least = {s: r - doubt * (r * (1 - r) / (strength + n[s] + 1)) ** 0.5 for s, r in rate.items()}
    return [not failed and least[source] <= bound for source, failed in docs]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """source -> target by sharing the excess again and again; sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        whole = sum(w[s] for s in open_)
        for s in open_:
            goal[s] += left * w[s] / whole
        left = sum(max(0.0, goal[s] - most * sizes[s]) for s in open_)
        for s in list(open_):
            if goal[s] >= most * sizes[s]:
                goal[s] = float(most * sizes[s])
                open_.discard(s)
    return goal


def byte_bpe(texts, ranks_path, pattern):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for text in texts:
        ids = t.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.decode_bytes(ids)).hexdigest()))
    return out


def token_ids(rows, path, end_id=2):
    """doc_id -> (start, n, crc32) for rows of (doc_id, text) in order."""
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def base_scores(rows):
    """doc_id -> (held_out, n_tokens, n_known, N, base) for rows of (doc_id, text)."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    end = object()
    tokens = {d: [*words(t, True), end] for d, t in rows}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for d, ws in tokens.items()}


def shingle_set(text, width):
    ws = words(text, True)
    return {tuple(ws[i:i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()


def jaccard_components(rows, width, percent):
    """doc_id -> (set size, smallest doc_id reachable, number of links) by comparing all pairs."""
    sets = [(d, shingle_set(t, width)) for d, t in rows]
    lists = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            lists[x].append(i)
    parent, links = list(range(len(sets))), Counter()

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, (_, s) in enumerate(sets):
        for j, common in Counter(j for x in s for j in lists[x] if j > i).items():
            if 100 * common >= percent * (len(s) + len(sets[j][1]) - common):
                links[i] += 1
                links[j] += 1
                parent[top(j)] = top(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: (len(s), least[top(i)], links[i]) for i, (d, s) in enumerate(sets)}


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def url_rule(url):
    """(host, path, rule, verdict of the rule)."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for rule in RULES:
        domain, below = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + below):
            fits.append(rule)
    best = max(fits, key=len, default=None)
    return host, path, best, RULES.get(best)


def paragraphs(text, width=32):
    out = set()
    for line in (text or "").split("\n"):
        ws = words(line)
        out |= {tuple(ws[i:i + width]) for i in range(0, len(ws), width)}
    return out


def paragraph_likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def token_bytes(a_path, b_path):
    """Functions from a text to [(id, bytes)] by the byte-level and by the piece vocabulary."""
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    shown = {pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]: c for c in range(128)}
    for c in range(128, 0x100):
        for ch, byte in zip(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0], chr(c).encode()):
            shown[ch] = byte
    for lead in (*range(0xC4, 0xE0), *range(0xE1, 0xF0), 0xE0, *range(0xF0, 0xF5)):
        tail = {0xE0: "\xa0\x80", 0xF0: "\x90\x80\x80"}.get(lead, "\x80" * (1 if lead < 0xE0 else 2 if lead < 0xF0 else 3)).encode("latin-1")
        try:
            text = (bytes([lead]) + tail).decode()
        except UnicodeDecodeError:
            continue
        for ch, byte in zip(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0], text.encode()):
            shown[ch] = byte

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    return (lambda t: [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids],
            lambda t: [(i, piece(i)) for i in b.encode(t)])


def token_links(texts, a_path, b_path):
    """(n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups) of each text, byte by byte."""
    split_a, split_b = token_bytes(a_path, b_path)
    found = []
    for text in texts:
        a, b = (split_a(text), split_b(text)) if text else ([], [])
        line = (" " + (text or "")).encode()
        if not text or any(b"".join(x for _, x in side) != line for side in (a, b)):
            found.append(([], [], set(), []))
            continue
        of_a, of_b = ([k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b))
        links = sorted({(i, j) for i, j in zip(of_a, of_b)})
        groups = [([], [])]
        for at in range(len(line)):
            if not groups[-1][0] or groups[-1][0][-1] != of_a[at]:
                groups[-1][0].append(of_a[at])
            if not groups[-1][1] or groups[-1][1][-1] != of_b[at]:
                groups[-1][1].append(of_b[at])
            if at + 1 == len(line) or of_a[at] != of_a[at + 1] and of_b[at] != of_b[at + 1]:
                groups.append(([], []))
        found.append((a, b, links, groups[:-1]))
    counts = Counter((a[i][0], b[j][0]) for a, b, links, _ in found for i, j in links)
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for a, b, links, groups in found:
        pairs = [(a[i][0], b[j][0]) for i, j in links]
        said = ";".join(",".join(str(a[i][0]) for i in x) + "|" + ",".join(str(b[j][0]) for j in y) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), sum(counts[p] == highest[p[1]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


def merkle(rows, tampered):
    """Sorted (doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            out.append([(level[j], j < i) for j in (i ^ 1,) if j < len(level)])
            i //= 2
        return out

    langs = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted([r for r in rows if r[2] == s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in langs}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in langs}
    crown = tree([trees[s][-1][0] for s in langs]) if langs else [[]]
    out = []
    for k, s in enumerate(langs):
        for i, r in enumerate(own[s]):
            steps = path(trees[s], i) + path(crown, k)
            changed = (*r[:3], r[3] + 1, r[4]) if tampered(r) and r[3] is not None else r
            value = leaf(changed)
            for step in steps:
                value = h(*[x for x, left in step if left], value, *[x for x, left in step if not left])
            out.append((r[0], s, leaf(r), trees[s][-1][0], crown[-1][0], h(*[x for step in steps for x, _ in step]), value, value == crown[-1][0]))
    return sorted(out, key=str)


def merged(piece, ranks):
    """Merge the leftmost pair of lowest rank until none is left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank > len(ranks):
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts
