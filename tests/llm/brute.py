"""Plain re-statements of the operators' contracts, for small inputs."""

import collections
import functools
import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def top_k(rows, k=10):
    """rows: (vec_id, vector or None) -> {query_id: [(rank, vec_id, score)]}."""
    good = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, u in good:
        if q is not None and q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in good if i != q and len(v) == len(u))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def quality(text):
    text = text or ""
    found = WORD.findall(text)
    counts = collections.Counter(zip(found, found[1:], found[2:], strict=False))
    covered = {i + k for i in range(len(found) - 2) if counts[tuple(found[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(found)
    return (
        n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered), n < 50 or 100 * len(covered) > 50 * n,
    )


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, width=5):
    found = WORD.findall(lowered(text))
    return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


def near_components(docs, percent=75, width=5):
    """docs: (doc_id, text) -> {doc_id: (size, component)}; every pair is compared."""
    sets = {i: shingle_set(t, width) for i, t in docs}
    owners = collections.defaultdict(set)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in owners[x])
        for j, common in shared.items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            owners[x].add(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def base_secrets(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m.group(1)) >= 12:
            spans.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 18:
            spans.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m.group()) >= 16:
            spans.append((m.start(), 2, m.end(), "hex"))
    spans.sort()
    counts = collections.Counter(s[3] for s in spans)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined.encode()).hexdigest()


def damaged(rows):
    """rows: (conv, turn, role, text) -> the same after damage."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub(r"[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """rows: (initial, must go, truncated) -> (cost, audit): every edit sequence is tried, states and rest of the rows being all that matters."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.lru_cache(maxsize=None)
    def best(at, last, inserted):
        options = []
        if at == len(rows):
            if last in ("", "a"):
                options.append((0, ""))
        else:
            initial, gone, cut = rows[at]
            cost, rest = best(at + 1, last, 0)
            options.append((3 + cost, "D" + rest))
            if not gone:
                if initial and initial in step[last]:
                    cost, rest = best(at + 1, initial, 0)
                    options.append((cut + cost, "K" + rest))
                for new in "ua":
                    if new in step[last]:
                        cost, rest = best(at + 1, new, 0)
                        options.append((2 + cut + cost, "R" + rest))
        if inserted < 4:
            for new in "ua":
                if new in step[last]:
                    cost, rest = best(at, new, inserted + 1)
                    options.append((2 + cost, "I" + rest))
        return min(options, default=(10**9, ""))

    return best(0, "", 0)


def conversations(original):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}"""
    groups = {r[0]: [] for r in original}
    for r in damaged(original):
        groups[r[0]].append(r[1:])
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in rows:
            stripped = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "b" if not stripped else "d" if (role, text) in seen else "t" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest(tuple((i, f in ("b", "d"), int(f == "t")) for i, f in zip(initials, faults, strict=True)))
        left, kept, last = list(rows), [], ""
        for letter in audit:
            new = "a" if last == "u" else "u"
            if letter == "I":
                kept.append((new, ""))
            else:
                _, role, text = left.pop(0)
                if letter == "D":
                    continue
                kept.append((role, text) if letter == "K" else (new, text))
            last = kept[-1][0][:1]
        whole = {"u": "user", "a": "assistant"}
        joined = "\n".join(f"{whole.get(r, r)}:{t}" for r, t in kept)
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(joined.encode()).hexdigest())
    return out


def vector_codes(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label) -> {vec_id: (code, error, label_error)} and the codebooks' digest; every entry is compared."""
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: r[0])
    x = np.array([[int(np.floor(np.float64(c) * 1024)) for c in r[1]] for r in rows])
    step = x.shape[1] // 4
    parts = [x[:, p * step : (p + 1) * step] for p in range(4)]
    books = [part[:entries].copy() for part in parts]

    def assigned(part, book):
        away = ((part[:, None, :] - book[None]) ** 2).sum(2)
        return away.argmin(1), away.min(1)

    for _ in range(rounds):
        for part, book in zip(parts, books, strict=True):
            index, _ = assigned(part, book)
            for e in np.unique(index):
                own = part[index == e]
                book[e] = [int(s) // len(own) for s in own.sum(0)]
    found = [assigned(part, book) for part, book in zip(parts, books, strict=True)]
    errors = sum(e for _, e in found)
    by_label = collections.Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return {r[0]: ("".join(f"{i[k]:02x}" for i, _ in found), int(errors[k]), by_label[r[2]]) for k, r in enumerate(rows)}, digest
