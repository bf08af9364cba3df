"""The operators' results by the plainest means, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
LETTER_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACE_WORD.findall(text or "")


# ── near duplicates ──


def fingerprint(text, width):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fps, radius=2):
    """Group number of each fingerprint."""
    group = list(range(len(fps)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                group[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


# ── personal data ──

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), rank, kind, m.end(), m[0]))
    return sorted(found)


def written(spans):
    return ",".join(f"{kind}:{start}:{stop}" for start, _, kind, stop, *_ in spans)


# ── quality ──


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def slots(text, buckets):
    w = [x.encode() for x in words(text)]
    one = [xxhash.xxh64_intdigest(x, 42) for x in w]
    two = [xxhash.xxh64_intdigest(y, h) for h, y in zip(one, w[1:])]
    return [_signed(h) % buckets for h in one + two]


def quality(docs, labels, buckets, smoothing, threshold):
    """``{index: (counts, base_failed, kept, score)}`` of ``(doc_id, text)`` rows."""
    good = {d for d, q in labels if q == 1 and d is not None}
    every, trusted = Counter(), Counter()
    for d, text in docs:
        every.update(slots(text, buckets))
        trusted.update(slots(text, buckets) if d in good else [])
    n, t = every.total(), trusted.total()
    weight = {b: round(math.log((trusted[b] + smoothing) / (t + smoothing * buckets)) - math.log((every[b] + smoothing) / (n + smoothing * buckets)), 6) if t else 0.0 for b in every}
    out = {}
    for i, (_, text) in enumerate(docs):
        counts = base_counts(text)
        s = slots(text, buckets)
        score = sum(weight[b] for b in s) / len(s) if s else 0.0
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        out[i] = counts, failed, not failed and score >= threshold, score
    return out


# ── lines ──


def line_dedup(docs, min_sites, long_words=50, long_sites=2):
    """New texts and numbers of removed lines of ``(doc_id, text, site)`` rows with distinct ids."""
    sites, first = defaultdict(set), {}
    for d, text, site in docs:
        for place, line in enumerate((text or "").split("\n") if text is not None else []):
            if words(line):
                sites[line].add(site)
                key = (d is None, d if d is not None else 0, place)
                first[line] = min(first.get(line, key), key)
    least = {line: long_sites if len(words(line)) > long_words else min_sites for line in sites}
    out = []
    for d, text, _ in docs:
        lines = text.split("\n") if text is not None else []
        keep = [x for place, x in enumerate(lines) if len(sites[x]) < least.get(x, 1) or first[x] == (d is None, d if d is not None else 0, place)]
        out.append((None if text is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


# ── benchmark passages ──


def decontamination(docs, items, width=13):
    """``(n_words, n_hit, items, contaminated)`` per text."""
    patterns = defaultdict(set)
    for item, text in items:
        w = LETTER_WORD.findall((text or "").translate(LOWER))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[i : i + n])].add("" if item is None else str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for text in docs:
        w = LETTER_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


# ── tokens ──


def encode(text, name, end):
    if name not in _tokenizers:
        _tokenizers[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return [*_tokenizers[name].encode(text or "", add_special_tokens=False).ids, end]


_tokenizers: dict[str, Tokenizer] = {}


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def cut(ids, capacity=2048):
    """``(start, ids)`` of the pieces."""
    first = len(ids) % capacity or capacity
    edges = [0, *range(first, len(ids) + 1, capacity)]
    return [(a, ids[a:b]) for a, b in zip(edges, edges[1:])]


def best_fit(lengths, capacity=2048):
    """Number of sequences of best-fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


# ── language model ──


class Katz:
    """Backoff model over ``(id text, text)`` rows, with counts in dictionaries."""

    def __init__(self, docs, order, discounts):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        self.contexts = Counter()
        for id_text, text in docs:
            if zlib.crc32((id_text or "").encode()) % 7 == 2:
                continue
            t = self.tokens(text)
            for i in range(1, len(t)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        gram = tuple(t[i - k + 1 : i + 1])
                        self.counts[k - 1][gram] += 1
                        if k > 1:
                            self.contexts[gram[:-1]] += 1
        self.total = self.counts[0].total()
        top = 5
        self.factors = [discounts([sum(c == r for c in level.values()) for r in range(1, top + 2)]) for level in self.counts]
        mass = sum(self.less(0, c) for c in self.counts[0].values())
        self.denominator = self.total if self.total - mass > 1e-9 * self.total else self.total + 1
        self.unknown = 1 - mass / self.denominator
        self.after = defaultdict(list)
        for level in self.counts[1:]:
            for gram in level:
                self.after[gram[:-1]].append(gram[-1])

    @staticmethod
    def tokens(text):
        return ["<start>", *[w.encode().lower() for w in words(text)], "<end>"]

    def less(self, level, c):
        return self.factors[level][min(c, 6)] * c

    def p(self, context, word):
        if not context:
            c = self.counts[0][(word,)]
            return self.less(0, c) / self.denominator if c else self.unknown
        n = self.contexts[context]
        if not n:
            return self.p(context[1:], word)
        level = len(context)
        mass = sum(self.less(level, self.counts[level][(*context, w)]) for w in self.after[context])
        below = n if n - mass > 1e-9 * n else n + 1
        c = self.counts[level][(*context, word)]
        if c:
            return self.less(level, c) / below
        alpha = (1 - mass / below) / (1 - sum(self.p(context[1:], w) for w in self.after[context]))
        return alpha * self.p(context[1:], word)

    def score(self, text):
        t = self.tokens(text)
        return sum(math.log10(self.p(tuple(t[max(0, i - self.order + 1) : i]), t[i])) for i in range(1, len(t)))

    def base(self, text):
        known = len(self.counts[0])
        return sum(math.log10((self.counts[0][(w,)] + 1) / (self.total + known + 1)) for w in self.tokens(text)[1:])


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ── conversations ──


def damaged(rows):
    """``(conv_id, turn, role, text)`` with faults put in."""
    for cid, turn, role, text in rows:
        pick = zlib.crc32(f"{' ' if cid is None else cid}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if pick == 1:
            text = ""
        if pick == 2:
            text = re.sub("[.!?]", "", text)
        if pick == 4:
            role = "user"
        yield from [(cid, turn, role, text)] * (0 if pick == 0 else 2 if pick == 3 else 1)


def audit(rows):
    """Figures, audit and repaired messages of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{r[2]}:{r[3]}".encode()).hexdigest()))
    faults = []
    for i, (_, _, role, text) in enumerate(rows):
        w = words(text)
        seen = any((role, text) == r[2:] for r in rows[:i])
        faults.append("blank" if not w else "duplicate" if seen else "" if w[-1][-1] in ".!?" else "truncated")
    # (state, initials so far must go on to match) -> cheapest audit, with the repaired messages
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def offer(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def inserted(table):
        for _ in range(3):
            for state, (cost, text, out) in list(table.items()):
                for c, name in names.items():
                    if (state, c) in moves:
                        offer(table, moves[state, c], (cost + 3, text + "I", (*out, (name, ""))))
        return table

    for (_, _, role, text), fault in zip(rows, faults):
        following = {}
        for state, (cost, edits, out) in inserted(best).items():
            offer(following, state, (cost + 4, edits + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            if (state, role[:1]) in moves:
                offer(following, moves[state, role[:1]], (cost + extra, edits + "K", (*out, (role, text))))
            for c, name in names.items():
                if (state, c) in moves:
                    offer(following, moves[state, c], (cost + 3 + extra, edits + "R", (*out, (name, text))))
        best = following
    cost, edits, out = min(v for k, v in inserted(best).items() if k in ("", "a"))
    turns = {r[1] for r in rows if r[1] is not None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest), list(out)


def audits(rows):
    """The audit of each conversation, damaged first."""
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    return {c: audit(g)[0] for c, g in groups.items()}


# ── manifest ──


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows, lower=True):
    """``(doc_id, leaf, subroot, root, proof, folded, verified)`` of rows ``(doc_id, source, lang, n_chars, text)``."""

    def leaf(*values):
        return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def tree(digests):
        """Root, and for each digest its steps ``(left, right)``."""
        paths = [[] for _ in digests]
        at = list(range(len(digests)))
        while len(digests) > 1:
            runs = [digests[i : i + 8] for i in range(0, len(digests), 8)]
            for k, i in enumerate(at):
                run = runs[i // 8]
                paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            digests, at = [_h(*run) for run in runs], [i // 8 for i in at]
        return digests[0], paths

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row, leaf(*row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: tree([x[1] for x in groups[g]]) for g in order}
    root, crown = tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, crown):
        subroot, paths = trees[g]
        for (row, own), path in zip(groups[g], paths):
            path = path + above
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            digest = leaf(*row[:4], row[4].translate(LOWER)) if changed and row[4] is not None else own
            for a, b in path:
                digest = _h(a, digest, b)
            out.append((row[0], own, subroot, root, _h(*[x for step in path for x in step]), digest, digest == root))
    return out


# ── licences ──


def licences(rows, phrases, notices, most, share):
    """``(id, n_words, n_base, first, last, base labels, labels, score)`` of ``(id, text)`` rows."""
    texts = [LETTER_WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    df = Counter(w for t in texts for w in set(t))
    out = []
    for (key, _), w in zip(rows, texts):
        base = [(label, i) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels, score = {x for x, _ in base}, 0.0
        for label, text in notices:
            entry = text.replace("[", "").replace("]", "").split()
            must = [i for i, _ in enumerate(entry) if f" {text} ".count("[", 0, _at(text, i)) > f" {text} ".count("]", 0, _at(text, i))]
            rare = sorted(set(entry), key=lambda x: (df[x], x))[:most]
            for offset in range(-len(entry), len(w)):
                same = [i for i, x in enumerate(entry) if 0 <= offset + i < len(w) and w[offset + i] == x]
                if len({entry[i] for i in same} & set(rare)) >= math.ceil(share * len(rare)) and set(must) <= set(same):
                    labels.add(label)
                    score = max(score, len(same) / len(entry))
        starts = [i for _, i in base]
        out.append((key, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), score))
    return out


def _at(text, i):
    """End of the ``i``-th word of ``text``, one blank put before it."""
    return 1 + [m.end() for m in re.finditer(r"[0-9a-z]+", text)][i]
