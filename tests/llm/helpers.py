"""Brute-force versions and small tables for the operators' tests."""

import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, extra="extra string, id string, n string, component string"):
    """rows of (doc_id, text[, lang[, source]]) with columns that clash with names the operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", "e", "i", "n", "c") for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, {extra}").repartition(3)


def shingle_set(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= width:
        return frozenset(" ".join(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([" ".join(w)]) if w else frozenset()


def classes(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_classes(texts, percent, width=5):
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return classes(links, sets), {i: len(s) for i, s in sets.items()}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def luhn(d):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def base_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def base_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 12:
            out.append(("assign", m.start(), m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 18:
            out.append(("access", m.start(), m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m.group()) >= 16:
            out.append(("hex", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
