"""Plain Python versions of the operators, by other ways than the operators take."""

import datetime
import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict


def components(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def normal_line(line):
    return re.sub("[\x20\x09-\x0d]+", " ", line.lower()).strip(" ")


def line_groups(texts, least=20, size=5, threshold=0.8):
    """Normalised line -> group, over all pairs."""
    lines = sorted({normal_line(x) for t in texts if t for x in t.split("\n") if len(x) >= least and len(normal_line(x)) >= least})
    sets = [{x[i : i + size] for i in range(len(x) - size + 1)} for x in lines]
    order = sorted(range(len(lines)), key=lambda i: len(sets[i]))
    links = []
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if len(sets[i]) < threshold * len(sets[j]):
                break
            shared = len(sets[i] & sets[j])
            if shared >= threshold * (len(sets[i]) + len(sets[j]) - shared):
                links.append((lines[i], lines[j]))
    return components(lines, links)


def dedup_lines(docs):
    """{doc_id: text} of docs [(doc_id, text)] with distinct ids."""
    group, seen, out = line_groups([t for _, t in docs]), set(), {}
    for doc_id, text in sorted(docs):
        keep = []
        for line in (text or "").split("\n"):
            g = group.get(normal_line(line)) if len(line) >= 20 else None
            if g is None or g not in seen:
                keep.append(line)
            if g is not None:
                seen.add(g)
        out[doc_id] = None if text is None else "\n".join(keep)
    return out


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def leaks(docs, items, similarity=0.8, n=5):
    """{(doc_id, item_id)} whose best window of the item's size is similar enough; every window is tried."""
    def grams(w):
        k = min(n, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    of = {i: grams(words(t)) for i, t in items if words(t)}
    size = {i: len(words(t)) for i, t in items}
    df = Counter(g for c in of.values() for g in c)
    weight = lambda g: round(math.log(1 + len(of) / df.get(g, 1)) * 1000)
    holders = defaultdict(set)
    for i, c in of.items():
        for g in c:
            holders[g].add(i)
    found = set()
    for doc_id, text in docs:
        w = words(text)
        grams_by_k = {k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for k in range(1, n + 1)}
        near = {i for k in grams_by_k for g in grams_by_k[k] for i in holders.get(g, ())}
        for i in near:
            for start in range(max(1, len(w) - size[i] + 1)):
                c = grams(w[start : start + size[i]])
                low = sum(min(c[g], of[i][g]) * weight(g) for g in c.keys() & of[i].keys())
                high = sum(c[g] * weight(g) for g in c) + sum(of[i][g] * weight(g) for g in of[i]) - low
                if low >= similarity * high:
                    found.add((doc_id, i))
                    break
    return found


def simhash(text, seed=42):
    import xxhash

    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=seed).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def simhash_groups(docs, radius=3):
    prints = {i: simhash(t) for i, t in docs}
    ids = sorted(prints)
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= radius]
    return prints, components(ids, links)


def luhn_digit(payload):
    total = sum(int(d) if i % 2 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(payload)))
    return str(-total % 10)


def feistel(left, right, a, b, key, kind, rounds=8):
    for n in range(1, rounds + 1):
        half, modulus = (right, a) if n % 2 == 0 else (left, b)
        move = int(hashlib.sha256(f"{key}|{kind}|{a}|{b}|{n}|{half}".encode()).hexdigest()[:15], 16) % modulus
        left, right = ((left + move) % a, right) if n % 2 == 0 else (left, (right + move) % b)
    return left, right


def permute_digits(digits, key, kind):
    half = len(digits) // 2
    left, right = feistel(int(digits[:half]), int(digits[half:]), 10**half, 10 ** (len(digits) - half), key, kind)
    return str(left).zfill(half) + str(right).zfill(len(digits) - half)


def refill(value, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in value)


def pseudonymise(text, key, patterns):
    """(text, kinds) of an ASCII text: one regular expression, each match replaced in plain Python."""
    kinds = []

    def card(value):
        groups, digits, at = re.split("[ -]", value), re.sub("[ -]", "", value), 0
        starts = [sum(map(len, groups[:i])) for i in range(len(groups))]
        ends, new, i = {s + len(g) for s, g in zip(starts, groups)}, "", 0
        while i < len(groups):
            s = starts[i]
            size = next((n for n in (16, 15, 14, 13, 19, 18, 17) if s + n in ends and luhn_digit(digits[s : s + n - 1]) == digits[s + n - 1]), 0) if s >= at else 0
            if size:
                payload = permute_digits(digits[s : s + size - 1], key, "card")
                new, at = new + digits[at:s] + payload + luhn_digit(payload), s + size
                kinds.append("card")
            i += 1
        return refill(value, new + digits[at:])

    def one(match):
        value = match[0]
        kind = next(k for k, p in patterns.items() if re.fullmatch(p, value))
        new = None
        if kind == "card":
            return card(value)
        if kind == "email":
            new = "u" + hashlib.sha256(f"{key}|email|{value.lower()}".encode()).hexdigest()[:12] + "@" + value.rsplit("@", 1)[1]
        elif kind == "ipv4" and all(int(x) <= 255 for x in value.split(".")):
            o = [int(x) for x in value.split(".")]
            left, right = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4")
            new = f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
        elif kind == "phone":
            digits = re.sub("[^0-9]", "", value)
            new = refill(value, digits[:-10] + permute_digits(digits[-10:], key, "phone"))
        elif kind == "date":
            for sign, form in (("-", "%Y-%m-%d"), ("/", "%d/%m/%Y"), ("/", "%m/%d/%Y"), (".", "%d.%m.%Y")):
                try:
                    day = datetime.datetime.strptime(value, form) if sign in value else None
                except ValueError:
                    day = None
                index = (day - datetime.datetime(1900, 1, 1)).days if day else -1
                if 0 <= index < 229 * 319:
                    left, right = feistel(index // 319, index % 319, 229, 319, key, "date")
                    new = (datetime.datetime(1900, 1, 1) + datetime.timedelta(left * 319 + right)).strftime(form)
                    break
        if new is None:
            return value
        kinds.append(kind)
        return new

    return re.sub("|".join(f"(?:{p})" for p in patterns.values()), one, text), kinds


def page_rank(seeds, edges, damping, rounds):
    degree = Counter(a for a, _ in edges)
    score = dict(seeds)
    for _ in range(rounds):
        new = defaultdict(float, seeds)
        for a, b in edges:
            new[b] += damping * score.get(a, 0.0) / degree[a]
        score = dict(new)
    return score
