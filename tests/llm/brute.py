"""Plain versions of the contracts, written without the operators' methods."""

import hashlib
import re

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_duplicates(rows, percent=85):
    """doc_id -> (n_shingles, component_id), all pairs compared through an inverted index."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    common = {}
    for ids in index.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def decontamination(rows, items, window=13):
    """doc_id -> (n_words, n_hit, items, contaminated), by looking every window up in a dictionary."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    windows = {}
    for item, text in items:
        words = split(text)
        if words:
            n = min(window, len(words))
            for i in range(len(words) - n + 1):
                windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in rows:
        words, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        listed = ",".join(sorted(found))
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def line_dedup(rows, least_words=8):
    """doc_id -> text without lines that equal an earlier one or lie within one word of an earlier one; rows have distinct ids."""
    first = {}
    for doc, text in sorted(rows):
        for pos, line in enumerate((text or "").split("\n")):
            if w := tuple(words(line)):
                first.setdefault(w, (doc, pos))

    def close(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    long_lines = [w for w in first if len(w) >= least_words]
    gone = {a for a in long_lines if any(first[b] < first[a] and close(a, b) for b in long_lines if abs(len(a) - len(b)) <= 1)}
    return {doc: "\n".join(line for pos, line in enumerate((text or "").split("\n")) if not (w := tuple(words(line))) or (w not in gone and first[w] == (doc, pos))) for doc, text in rows}


def quality_measures(text):
    w = words(text)
    hit = set()
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(ASCII_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host, path):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def url_tokens(url):
    if not url or "://" not in url:
        return set()
    host, path = url_parts(url)
    rest = url.split("://", 1)[1]
    number = lambda s: re.sub("[0-9]+", "#", s)
    query = (re.match(r"[^?#]*\?([^#]*)", rest) or ["", ""])[1]
    found = {"s:" + re.match("[A-Za-z]*", url)[0].lower(), "f:#" if "#" in rest else "f:", "e:" + (re.search(r"\.([A-Za-z0-9]+)$", path) or ["", ""])[1]}
    found |= {"h:" + x for x in number(host).split(".") if x} | {"p:" + x for x in number(path).split("/") if x}
    found |= {"q:" + x.split("=")[0] for x in query.split("&") if x.split("=")[0]} | {"v:" + x for x in number(query).split("&") if "=" in x}
    return found | ({"t:" + number(rest.split("#", 1)[1])} if rest.partition("#")[2] else set())


def mined_rules(labelled, support, confidence):
    """(tokens, verdict, confidence, support) from (token set, verdict), by counting every subset of every set; surest first."""
    from collections import Counter
    from itertools import combinations

    have, hit = Counter(), Counter()
    for tokens, verdict in labelled:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                have[c] += 1
                hit[c, verdict] += 1
    n, sure = len(labelled), {}
    for (c, verdict), k in hit.items():
        if k >= support * n and k >= confidence * have[c]:
            sure[frozenset(c), verdict] = (k / have[c], k / n)
    rules = [(t, v, c, s) for (t, v), (c, s) in sure.items() if not any(sure.get((frozenset(u), v), (-1,))[0] >= c for k in range(1, len(t)) for u in combinations(sorted(t), k))]
    return sorted(rules, key=lambda r: (-r[2], -r[3], len(r[0]), sorted(r[0]), r[1]))
