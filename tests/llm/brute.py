"""Plain versions of the operators over lists of rows, for comparison."""

import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def op1(docs, min_sites=10, min_words=1):
    """docs: (doc_id, text, source), ids not null."""
    sites, first = defaultdict(set), {}
    of = lambda line: line.strip(" \t\r\x0b\x0c")
    for d, t, s in docs:
        for p, line in enumerate((t or "").split("\n")):
            if len(BLANK.findall(line)) >= min_words:
                sites[of(line)] |= {s} - {None}
                first[of(line)] = min(first.get(of(line), (d, p)), (d, p))
    out = []
    for d, t, _ in docs:
        ls = (t or "").split("\n")
        keep = [x for p, x in enumerate(ls) if len(BLANK.findall(x)) < min_words or len(sites[of(x)]) < min_sites or first[of(x)] == (d, p)]
        out.append((d, 0 if t is None else len(ls), len(ls) - len(keep), sha("\n".join(keep))))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def op2(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def op3(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[x] - {None}
        out.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit)))
    return out


def op6(docs):
    def print_of(t):
        w = BLANK.findall((t or "").translate(LOWER))
        if not w:
            return 0
        g = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d: print_of(t) for d, t in docs}
    values = sorted(set(prints.values()))
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    a = np.array(values, dtype=np.uint64)
    for k, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ np.uint64(v)) <= 3):
            up[root(values[k + 1 + int(j)])] = root(v)
    least = {}
    for d, v in prints.items():
        least[root(v)] = min(least.get(root(v), d), d)
    return [(d, f"{v:016x}", least[root(v)]) for d, v in prints.items()]


def op7(docs, n=50):
    words = [(d, BLANK.findall(t or "")) for d, t in docs]
    least = {}
    for d, w in words:
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            least[x] = min(least.get(x, d), d)
    out = []
    for d, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < d:
                gone |= set(range(k, k + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def op8_base(text):
    text = text or ""
    w = BLANK.findall(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = Counter(grams)
    rep = {k + j for k, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))


def op9(pages):
    import base64

    data = {i: (h or "").encode() for i, h in pages}
    first = {}
    for i, x in data.items():
        first[x] = min(first.get(x, i), i)
    return [(i, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if first[x] == i else "revisit", None if first[x] == i else first[x]) for i, x in data.items()]


def crc_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def op2_instances(text):
    """(start, stop, name, kind, contexts) of every instance of a short text: base spans, words with a digit or an at sign, runs of such words."""
    marks, pairs = "\"'()[]{}<>,;:!?.=|*#$%&", {"(": ")", "[": "]", "{": "}", "<": ">"}
    name = lambda x: x.lower() if len(x) <= 128 else sha(x.lower())

    def stripped(a, b):
        while b > a and text[b - 1] in marks:
            partner = next((o for o, c in pairs.items() if c == text[b - 1]), None)
            if partner and partner in text[a + 1 : b]:
                break
            b -= 1
        while a < b and text[a] in marks:
            if text[a] in pairs and a < text.find(pairs[text[a]], a, b) < b - 1:
                break
            a += 1
        return a, b

    def before(at):
        words = text[:at].split()
        near = [w[-128:].lower() for w in words[-2:]]
        return near[-1:] if words and len(words[-1]) > 128 else near

    def contexts(a, b, kind):
        x, near, after = text[a:b], before(a), (text[b:].split() or [""])[0][:128].lower()
        out = set()
        if kind != 4 and len(x) <= 128 and ("@" in x or x.count(".") == 3 or sum(c.isdigit() for c in x) >= 9):
            form, digits = re.sub(r"[^\W\d_]+", "a", x), re.sub(r"\D", "", x)
            form += " checked" if 14 <= len(digits) <= 19 and luhn(digits) else ""
            out |= {"form " + re.sub(r"\d", "9", form), "form " + re.sub(r"\d+", "9", form)}
        like = name("".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in x))
        if near:
            out.add(f"shape {near[-1]} _ {like}")
        if near and after:
            out.add(f"1 {near[-1]} _ {after}")
        if len(near) == 2:
            out |= {f"2 {near[0]} {near[1]}", f"shape {near[0]} * _ {like}"}
        if near and near[-1][-1] in ":=":
            out.add("label " + (" ".join(near) if near[-1] in ":=" else near[-1]))
        return out

    def kind(x):
        if re.fullmatch(r"[A-Za-z0-9+/_=-]{20,}", x) and sum(a.isdigit() != b.isdigit() and (a + b).isalnum() and (a + b).isascii() for a, b in zip(x, x[1:], strict=False)) >= 4:
            return 4
        digits = len(re.sub("[^0-9]", "", x))
        return -2 if IP.fullmatch(x) or PHONE.fullmatch(x) or (CARD.fullmatch(x) and 14 <= digits <= 19) else -1

    base = op2(text)
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text) if re.search("[0-9@]", m[0])]
    runs = [[]]
    for a, b in words:
        bare = len(text[a:b]) - len(text[a:b].lstrip(marks)) + a, len(text[a:b].rstrip(marks)) + a
        if any(x < bare[1] and bare[0] < y for x, _, y in base):
            runs.append([])
            continue
        if runs[-1] and not re.fullmatch(r"[\x20\t\xa0()\[\]-]+", text[runs[-1][-1][1] : a]):
            runs.append([])
        runs[-1].append((a, b))
    spans = {stripped(*w) for r in runs for w in r} | {stripped(r[0][0], r[-1][1]) for r in runs if len(r) > 1}
    out = [(a, b, name(text[a:b]), k, contexts(a, b, k)) for a, k, b in base]
    for a, b in spans:
        if a < b:
            k = kind(text[a:b])
            out.append((a, b, name(text[a:b]), k, contexts(a, b, k)))
    return out


def op2_added(docs, rounds=3, support=5, limit=0.8):
    """docs: different (doc_id, text); spans that contexts add: the graph of contexts and instances in plain dictionaries."""
    each = [(d, *x) for d, t in docs if t for x in op2_instances(t)]
    weight, kinds = defaultdict(set), {}
    for d, _, _, token, kind, contexts in each:
        for c in contexts:
            weight[c, token].add(d)
            kinds[c, token] = max(kinds.get((c, token), -2), kind)
    n = {e: len(ds) for e, ds in weight.items()}
    seeds, total = {}, Counter()
    for (c, token), k in kinds.items():
        total[c] += n[c, token] * (0.25 if c.startswith("form ") and k == -1 else 1)
        if k >= 0:
            seeds[token] = max(seeds.get(token, -1), k)
    scores, good = {(t, k): 1.0 for t, k in seeds.items()}, {}
    for _ in range(rounds):
        of = defaultdict(list)
        for (t, k), s in scores.items():
            of[t].append((k, s))
        got, backers = Counter(), Counter()
        for (c, t), m in n.items():
            for k, s in of[t]:
                got[c, k] += m * s
                backers[c, k] += s >= limit
        good = {(c, k): g / (total[c] + (4.0 if c.startswith(("shape ", "form ")) else 0.5)) for (c, k), g in got.items() if backers[c, k] >= support}
        by = defaultdict(list)
        for (c, k), s in good.items():
            by[c].append((k, s))
        scores = {(t, k): 1.0 for t, k in seeds.items()}
        for (c, t), k0 in kinds.items():
            if (k0 == -1 or k0 > 3) and t not in seeds:
                for k, s in by[c]:
                    scores[t, k] = max(scores.get((t, k), 0), s)
    out = defaultdict(set)
    for d, a, b, token, kind, contexts in each:
        fit = [k for c in contexts for k in range(5) if good.get((c, k), 0) >= limit and scores.get((token, k), 0) >= limit]
        if (kind == -1 or kind > 3) and fit:
            out[d].add((a, min(fit), b))
    return {d: sorted(x for x in s if not any(o != x and o[0] <= x[0] and x[2] <= o[2] for o in s)) for d, s in out.items()}


def op5(rows, langid, clusters=4):
    """rows: (doc_id, text, lang) whose training part is within the sample; (doc_id, lang_pred, score) by loops over single n-grams."""

    def grams(text):
        spaced = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        s = f" {spaced} " if spaced else ""
        codes = [*s, *(s[k : k + 2] for k in range(len(s) - 1)), *(s[k : k + 3] for k in range(len(s) - 2))]
        counts = Counter()
        for g in codes:
            if g == " " or (len(g) == 3 and g[1] == " "):
                continue
            code = 0
            for c in g:
                code = code << 21 | (32 if c == " " else ord(c))
            code = (code | 1 << 63) if len(g) == 2 else code
            counts[int(langid._bin(np.array([code & (1 << 64) - 1], dtype=np.uint64))[0])] += 1
        return counts

    def vector(counts):
        v = {b: (1 + np.log(n)) * idf[b] for b, n in counts.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        out = np.zeros(langid.BINS)
        for b, x in v.items():
            out[b] = x / norm
        return out

    train = [(d, t, lang) for d, t, lang in rows if d is not None and t is not None and lang is not None and not crc_held_out(d)]
    df, n = Counter(), len(train)
    for _, t, _ in train:
        df.update(grams(t).keys())
    idf = [np.log((1 + n) / (1 + df[b])) + 1 for b in range(langid.BINS)]
    model = []
    for lang in sorted({x for *_, x in train}):
        x = np.array([vector(c).astype(np.float32) for d, t, g in sorted(train) if g == lang and (c := grams(t))]).astype(np.float64)
        if not len(x):
            continue
        chosen = [int(np.argmax(x @ x.mean(axis=0)))]
        while len(chosen) < min(clusters, len(x)):
            chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
        centroids, own = x[chosen].copy(), None
        for _ in range(12):
            now = np.argmax(x @ centroids.T, axis=1)
            if own is not None and np.array_equal(now, own):
                break
            own = now
            for j in set(own.tolist()):
                mean = x[own == j].mean(axis=0)
                centroids[j] = mean / np.linalg.norm(mean)
        model += [(lang, c) for j, c in enumerate(centroids) if np.mean(own == j) >= max(langid.LEAST, 1e-9)]
    out = []
    for d, t, _ in rows:
        c = grams(t)
        best = max(((float(vector(c) @ m), lang) for lang, m in model), key=lambda x: x[0]) if c and model else (0.0, "und")
        out.append((d, best[1], best[0]))
    return out


def op11_edits(rows):
    """(cost, audit, turns) of the cheapest edits of (role, text, fault) rows, by trying every sequence of edits for short conversations."""
    import re
    from itertools import product

    best = None
    n = len(rows)
    # between rows and at the ends any of no, one or two inserted turns; every row K, R or D
    gaps = ["", "u", "a", "ua", "au"]
    for acts in product("DKRr", repeat=n):
        if any(a != "D" and f in ("blank", "duplicate") for a, (_, _, f) in zip(acts, rows, strict=True)):
            continue
        for gap in product(gaps, repeat=n + 1):
            turns, audit, cost = [], "", 0
            for k in range(n + 1):
                for c in gap[k]:
                    turns.append(({"u": "user", "a": "assistant"}[c], ""))
                    audit, cost = audit + "I", cost + 2
                if k < n:
                    role, text, f = rows[k]
                    if acts[k] == "D":
                        audit, cost = audit + "D", cost + 3
                    else:
                        role = {"K": role, "R": "user", "r": "assistant"}[acts[k]]
                        audit, cost = audit + acts[k].upper(), cost + (0 if acts[k] == "K" else 2) + (f == "truncated")
                        turns.append((role, text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)) and all(r for r, _ in turns) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
    return best


def op11_search(rows):
    """As op11_edits, for conversations of any length: least (cost, audit) pairs from the end."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    put = {"": "u", "s": "u", "u": "a", "a": "u"}
    long = {"u": "user", "a": "assistant"}
    none = (10**9, "", [])

    def opened(best):
        for _ in range(2):
            best = {s: min(best[s], (best[put[s]][0] + 2, "I" + best[put[s]][1], [(long[put[s]], ""), *best[put[s]][2]])) for s in best}
        return best

    best = opened({"": (0, "", []), "a": (0, "", []), "s": none, "u": none})
    for role, text, f in reversed(rows):
        now = {}
        for s in best:
            options = [(best[s][0] + 3, "D" + best[s][1], best[s][2])]
            if f not in ("blank", "duplicate"):
                extra = int(f == "truncated")
                if role[:1] in after[s]:
                    to = best[after[s][role[:1]]]
                    options.append((to[0] + extra, "K" + to[1], [(role, text), *to[2]]))
                to = best[put[s]]
                options.append((to[0] + 2 + extra, "R" + to[1], [(long[put[s]], text), *to[2]]))
            now[s] = min(options)
        best = opened(now)
    return best[""]


def op11(rows):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of (conv_id, turn, role, text) rows; turns of a conversation are distinct."""
    import zlib

    out, groups = [], {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        groups[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text in found:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in found if t is not None}
        initials = [r[:1] for _, r, _ in found]
        cost, audit, left = op11_search([(r, t, f) for (_, r, t), f in zip(found, faults, strict=True)])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left))))
    return out


def op12(rows):
    """(doc_id, keep_id, group_size, sha) of (doc_id, text) rows."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        out += [(d, keep, len(ids), sha(t)) for d in ids]
    return out


def op13(rows):
    """(anchor, positive, rank, negative, positive score, negative score) of (vec_id, embedding, label) rows."""
    import math

    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label))
    by = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, other == label) for n, (j, w, other) in enumerate(kept) if n != k]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=by)[:5]:
            fit = sorted((s for s in scored if not s[2] and 80 * p <= 100 * s[0] <= 100 * p), key=by)[:5]
            out += [(i, pid, n + 1, s[1], p, s[0]) for n, s in enumerate(fit)]
    return out
