"""Plain-Python versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def crc_text(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def quality_base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    hit = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def spark_hash(value, seed=42):
    """Spark's xxhash64 of one string or long; several columns chain by the seed."""
    raw = value.encode() if isinstance(value, str) else value.to_bytes(8, "little")
    return xxhash.xxh64_intdigest(raw, seed)


def quality_verdicts(rows, good, buckets, prior, threshold, slack):
    """rows: [(doc_id, text)] -> per row (llr, kept), from counts over all rows and over those of `good` ids."""
    grams = []
    for _, text in rows:
        one = [spark_hash(w) for w in WORD.findall(text or "")]
        two = [spark_hash(b, spark_hash(a)) for a, b in zip(one, one[1:], strict=False)]
        grams.append([h % buckets for h in one + two])
    raw = Counter(b for g in grams for b in g)
    target = Counter(b for (i, _), g in zip(rows, grams, strict=True) if i in good for b in g)
    share = target.total() / max(1, raw.total())
    out = []
    for (_, text), g in zip(rows, grams, strict=True):
        n = max(1, len(g))
        llr = sum(math.log((target[b] + prior) / (raw[b] * share + prior)) for b in g) / n if share else 0.0
        out.append((llr, not quality_base(text)[-1] and llr + slack / math.sqrt(n) >= threshold))
    return out


def toxic_features(folded, weights, exceptions):
    """The four features of a folded text, word by word, from every entry tried at every word."""
    spans = [(i, i + len(e)) for e in exceptions for i in range(len(folded)) if folded.startswith(e, i)]
    total, top, n = 0.0, 0.0, len(folded.split())
    for at in (i for i in range(len(folded) - 1) if folded[i] == " " and folded[i + 1] != " "):
        met = [w for p, w in weights.items() if folded.startswith(p, at) and not any(a <= at and at + len(p) <= b for a, b in spans)]
        total, top = total + max(met, default=0.0), max([top, *met])
    n = max(1, n)
    return math.log1p(total), math.log1p(100 * total / n), top, total / math.sqrt(n)


def toxic_lexicon(toxic, clean, shortest, longest, pure, varied, sure, nearly):
    """Entries and weights from folded distinct texts of either kind, by plain counting and the exact binomial tail."""

    def patterns(t):
        return {f" {w} " for w in t.split()} | {f" {w[:k]}" for w in t.split() for k in range(shortest, min(longest, len(w)) + 1)}

    a, b = (Counter(p for t in side for p in patterns(t)) for side in (toxic, clean))
    tried = {p for p in a | b if a[p] + b[p] >= 3}
    share = len(toxic) / (len(toxic) + len(clean))

    def tail(p):
        n = a[p] + b[p]
        return sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(a[p], n + 1))

    def odds(p):
        return math.log((a[p] + 0.5) / (len(toxic) + 1) * (len(clean) + 1) / (b[p] + 0.5))

    def contexts(p):
        found = set()
        for t in toxic:
            words = t.split()
            for i, w in enumerate(words):
                if p in (f" {w} ", f" {w[: len(p) - 1]}"):
                    after = (words[i + 1] if i + 1 < len(words) else "") if p.endswith(" ") else w[len(p) - 1 :]
                    found.add((words[i - 1] if i else "", after))
                    break
        return len(found)

    sound = [p for p in tried if a[p] >= 3 and odds(p) >= pure and tail(p) * len(tried) < sure]
    lexicon = {}
    for p in sorted(sound, key=lambda p: (-a[p], -len(p), p)):
        longer = max((a[q] for q in sound if q != p and q.startswith(p)), default=0)
        heads = [lexicon[q] for q in lexicon if p.startswith(q)]
        weight = min(8.0, odds(p))
        if contexts(p) >= varied * a[p] and longer < 0.9 * a[p] and all(weight > h + nearly for h in heads):
            lexicon[p] = weight
    return lexicon


ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text):
    return ITEM.findall((text or "").translate(UPPER))


def decontaminate(text, items):
    """items: [(item_id, text)]"""
    w = item_words(text)
    hit, ids = set(), set()
    for item_id, body in items:
        v = item_words(body)
        if not v:
            continue
        k = min(8, len(v))
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                ids.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(w), len(hit), len(ids), digest, len(ids) >= 2


def fingerprint(text):
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """rows: [(doc_id, fingerprint)] -> component id of each row."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(rows))]


def place(value):
    return int((value or "").encode()[:6].hex().ljust(12, "0") or "0", 16)


def kd_shards(rows, depth, tolerance=0.002):
    """rows: [(doc_id, text, lang, source)], ids unique -> {doc_id: shard}, by sorting every node in memory."""
    body = {d: (t or "").encode() for d, t, _, _ in rows}
    crc, w = {d: zlib.crc32(b) for d, b in body.items()}, {d: len(b) + 1 for d, b in body.items()}
    least = {}
    for d, _, lang, source in rows:
        a, b = least.get(body[d], (2**62, 2**62))
        least[body[d]] = min(a, place(lang)), min(b, place(source))
    at = {d: (*least[body[d]], w[d]) for d in body}
    spans = [max(1, max(x[i] for x in at.values()) - min(x[i] for x in at.values())) for i in range(3)] if at else []

    def split(node, level, ids):
        if level == depth or not ids:
            return dict.fromkeys(ids, node)
        dim = max(range(3), key=lambda i: ((max(at[d][i] for d in ids) - min(at[d][i] for d in ids)) / spans[i], -i))
        group = lambda d: (at[d][dim], crc[d])
        total = sum(w[d] for d in ids)
        room, sides, last = [total // 2, total - total // 2], ([], []), float("inf")
        rest = sorted(ids, key=lambda d: (*group(d), crc_text(d)))
        while True:
            heavy, run = None, 0
            for g in dict.fromkeys(map(group, rest)):
                members = [d for d in rest if group(d) == g]
                size = sum(w[d] for d in members)
                if run + size >= max(1, room[0]):
                    heavy = members, size, max(0, room[0] - run)
                    break
                run += size
            if heavy is None:
                sides[0].extend(rest)
                break
            members, size, short = heavy
            first = rest.index(members[0])
            far = min(short, size - short) > tolerance * total
            if size > total - total // 2 and far:
                run = 0
                for k, d in enumerate(members):
                    if run + w[d] >= max(1, short):
                        k += 2 * (short - run) >= w[d]
                        break
                    run += w[d]
                first += k
            elif far and size < last:
                side = 0 if (2 * short >= size and size <= room[0]) or size > room[1] else 1
                sides[side].extend(members)
                rest = [d for d in rest if d not in set(members)]
                room[side] -= size
                last = size
                continue
            elif 2 * short >= size:
                first += len(members)
            sides[0].extend(rest[:first])
            sides[1].extend(rest[first:])
            break
        return split(2 * node, level + 1, sides[0]) | split(2 * node + 1, level + 1, sides[1])

    return split(0, 0, list(body))


class Tree(HTMLParser):
    """Nodes [tag, attributes, parts] of a page whose tags match, but for paragraphs, which a block closes; parts are nodes and strings."""

    BLOCK = set("html head body nav ul li div article section main aside footer header form p h1 h2 h3 blockquote".split())

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.path = [["#root", {}, []]]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.path[-1][2].append(" ")
        if tag in ("meta", "link", "img", "br"):
            return
        if tag in self.BLOCK and any(n[0] == "p" for n in self.path):
            while self.path.pop()[0] != "p":
                pass
        node = [tag, dict(attrs), []]
        self.path[-1][2].append(node)
        self.path.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.path):
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1][2].append(data)


def main_text(html, scoring=True):
    """Tree scoring by recursion over plain nodes; without scoring, every block of the body."""
    root, where = Tree(html).path[0], []  # where: (ancestors from the root, text, characters in links, links)

    def collect(node, above):
        run, linked, n = [], 0, 0

        def flush():
            nonlocal run, linked, n
            text = " ".join("".join(run).split())
            if text:
                where.append((above, text, min(linked, len(text)), n))
            run, linked, n = [], 0, 0

        def inline(x, in_link):
            nonlocal linked, n
            for y in x[2]:
                if isinstance(y, str):
                    run.append(y)
                    linked += len(y.strip()) * in_link
                elif y[0] in ("script", "style", "title", "head"):
                    continue
                elif y[0] in Tree.BLOCK:
                    flush()
                    collect(y, [*above, y])
                else:
                    n += y[0] == "a"
                    inline(y, in_link or y[0] == "a")

        inline(node, False)
        flush()

    collect(root, [root])
    if not scoring:
        return "\n".join(t for _, t, _, _ in where)
    prose = {"p", "blockquote", "div", "section", "article", "main", "li", "body"}
    value = lambda b: (1 + b[1].count(",") + min(len(b[1]) / 100, 3)) * (1 - b[2] / len(b[1])) if b[0][-1][0] in prose and len(b[1]) >= 25 else 0
    under = lambda x: [b for b in where if any(a is x for a in b[0])]
    points = lambda x: sum(map(value, under(x)))
    chars = lambda x: sum(len(b[1]) for b in under(x))

    def odd(x, above):
        no = x[0] in ("nav", "footer", "aside", "form") or (x[0] == "header" and not any(a[0] in ("article", "main") for a in above)) or x[1].get("class") in ("ad", "comments", "sidebar")
        rest = points(root) - points(x)
        return no and not (rest < max(1, 0.05 * points(x)) and chars(root) - chars(x) < chars(x))

    nodes, gone = [], set()

    def walk(x, above):
        nodes.append((x, above))
        if (above and id(above[-1]) in gone) or odd(x, above):
            gone.add(id(x))
        for y in x[2]:
            if not isinstance(y, str):
                walk(y, [*above, x])

    walk(root, [])
    score = {}
    for b in where:
        if value(b) and id(b[0][-1]) not in gone:
            up = b[0][::-1][b[0][-1][0] not in ("div", "section", "article", "main", "body") :]
            for a, share in zip(up, (1, 0.5, 0.25, 0.125), strict=False):
                score[id(a)] = score.get(id(a), 0) + value(b) * share
    density = lambda x: sum(b[2] for b in under(x)) / max(1, chars(x))
    final = {id(x): (score.get(id(x), 0) + {"article": 25, "main": 20}.get(x[0], 0) * (chars(x) > 0)) * (1 - density(x)) for x, _ in nodes}
    able = [(x, above) for x, above in nodes if final[id(x)] > 0 and id(x) not in gone and (x[0] in Tree.BLOCK)]
    best, above = max(able, key=lambda e: final[id(e[0])], default=(root, []))
    articles = [a for a in [*above, best] if a[0] == "article"] or [a for a in [best, *above[::-1]] if a[0] == "main"][-1:]
    top = articles[0] if articles else best
    kept = [top]
    if top is best and best[0] not in ("#root", "body", "html", "article", "main"):
        family = [x for x in above[-1][2] if not isinstance(x, str) and id(x) not in gone]
        for k, x in enumerate(family):
            first = k < next(i for i, y in enumerate(family) if y is best)
            if final[id(x)] >= max(10, 0.2 * final[id(best)]) or (x[0] == "p" and chars(x) >= 25 and density(x) < 0.25) or (first and x[0] in ("h1", "h2") and chars(x)):
                kept.append(x)

    def listing(x):
        n, marks = sum(b[3] for b in under(x)), sum(b[1].count(",") + b[1].endswith((".", "!", "?")) for b in under(x))
        links = n > 1 and (density(x) > 0.5 or (density(x) > 0.25 and chars(x) < 100 and not marks))
        return x[0] in ("div", "section", "ul") and not any(x is k for k in kept) and links and points(root) - points(x) >= 1

    lists = {id(x) for x, _ in nodes if listing(x)}
    good = lambda b: any(a is k for a in b[0] for k in kept) and not any(id(a) in gone or id(a) in lists for a in b[0])
    return "\n".join(b[1] for b in where if good(b))
