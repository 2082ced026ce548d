"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    told = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(f[1] == k for f in found) for k in range(3)] + [sha(told)]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows, twice = {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            twice.update(i + k for i in places for k in range(3))
    seen, n_dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            n_dup += line in seen
            seen.add(line)
    n = len(words)
    return [n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), n_dup, len(twice),
            n < 50 or 100 * len(twice) > 50 * n]


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset([
        (words[0],)])


def components(ids, links):
    """The smallest id reachable from every id."""
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_duplicates(texts):
    """doc_id -> component for a dict of texts, by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return components(ids, links)


def url_parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.split("[?#]", url[at + 3:], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path


def url_rule(url, rules):
    """The winning rule, by trying every rule without globs on every URL."""
    host, path = url_parts(url)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host))
           and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def aligned(text, bytes_a, a, bytes_b, b):
    """Groups and links (as id pairs) of two token lists, by looking at every pair of ranges."""
    def ranges(ids, table):
        at, out = 0, []
        for k in ids:
            out.append((at, at + len(table[k]), k))
            at += len(table[k])
        return out

    raw = b" " + text.encode()
    if not text or b"".join(bytes_a[k] for k in a) != raw or b"".join(bytes_b[k] for k in b) != raw:
        return None
    x, y = ranges(a, bytes_a), ranges(b, bytes_b)
    links = [(i[2], j[2]) for i in x for j in y if i[0] < j[1] and j[0] < i[1]]
    groups, last = [], 0
    for end in sorted({i[1] for i in x} & {j[1] for j in y}):
        groups.append("|".join(",".join(str(t[2]) for t in side if last < t[1] <= end)
                               for side in (x, y)))
        last = end
    return len(x), len(y), groups, links


def token_links(texts, bytes_a, ids_a, bytes_b, ids_b):
    """Rows of token alignment for lists of texts and of their ids."""
    found = [aligned(t or "", bytes_a, a, bytes_b, b)
             for t, a, b in zip(texts, ids_a, ids_b, strict=True)]
    count, best = {}, {}
    for f in found:
        for pair in set(f[3]) if f else ():
            count[pair] = count.get(pair, 0) + 1
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == best[p[0]] for p in f[3]),
             sum(count[p] for p in f[3]), sha(";".join(f[2]))) if f else (0, 0, 0, 0, 0, 0, "")
            for f in found]


def merkle(rows):
    """``doc_id -> (leaf, subroot, root, proof, folded, verified)`` of rows with unique doc_id."""
    import zlib

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(level):
        """Root, and of each leaf the siblings (left, right) from below."""
        ways, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            runs = [level[k:k + 16] for k in range(0, len(level), 16)]
            for way, k in zip(ways, at, strict=True):
                run = runs[k // 16]
                way.append(("".join(run[:k % 16]), "".join(run[k % 16 + 1:])))
            level, at = [sha("".join(run)) for run in runs], [k // 16 for k in at]
        return level[0], ways

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of, trees = {}, []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0]))
        trees.append((mine, *climb([leaf(r) for r in mine])))
    root, above = climb([t[1] for t in trees])
    for (mine, subroot, ways), up in zip(trees, above, strict=True):
        for r, way in zip(mine, ways, strict=True):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            h = leaf([*r[:4], text])
            for left, right in way + up:
                h = sha(left + h + right)
            of[r[0]] = (leaf(r), subroot, root, sha("".join(a + b for a, b in way + up)), h,
                        h == root)
    return of
