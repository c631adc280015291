"""Plain versions of the operators, straight from their definitions."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import xxhash

from tokenloom.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def simhash(text):
    w = WORDS.findall(lower(text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def linked(ids, fps, bits=4):
    """Smallest id reachable from each row; None ids never name a component."""
    left, out = set(range(len(fps))), [None] * len(fps)
    while left:
        todo, seen = [left.pop()], []
        while todo:
            i = todo.pop()
            seen.append(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= bits}
            left -= near
            todo += near
        named = [ids[i] for i in seen if ids[i] is not None]
        for i in seen:
            out[i] = min(named, default=None)
    return out


def figures(text):
    t = text or ""
    w = WORDS.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": len(w) < 10 or 100 * len(covered) > 20 * len(w)}


def cleaned(text):
    """The text without failed lines, or None if the document goes."""
    t = text or ""
    mark = r"[.!?…:;,][\"'”’»)\]]*"
    ends, last = re.compile(rf"{mark}(?:\s|$)|[。！？]"), re.compile(rf"(?:{mark}|[。！？])\s*\Z")
    furniture = re.compile(quality.BOILERPLATE)
    lines = t.split("\n")
    entries = [0 < len(WORDS.findall(x)) <= 3 and len(x) <= 120 and not last.search(x) for x in lines]

    def fails(i, line):
        n = len(WORDS.findall(line))
        many = lambda chars: sum(line.count(c) for c in chars)
        bars, symbols, shouts, commas = many("|»›•·"), many("#*$%&|<>"), many("!"), many(",")
        brief = len(line) <= 480 and (not last.search(line) and commas >= 2 and n <= 2 * (commas + 1) or n <= 12 and furniture.search(line))
        menu = any(a >= 0 and entries[a : a + 3] == [True] * 3 for a in (i - 2, i - 1, i))
        return n > 0 and bool(not ends.search(line) and n >= 3 or bars >= 3 and n <= 5 * (bars + 1) or symbols * 3 >= n and symbols >= 3 or shouts * 3 >= n and shouts >= 4 or brief or menu)

    out = "\n".join(x for i, x in enumerate(lines) if not fails(i, x))
    total, left = (sum(map(len, WORDS.findall(x))) for x in (t, out))
    return None if figures(t)["base_failed"] or total - left > 0.5 * total else out


def contaminated(texts, items):
    """Per text: n_words, hit word numbers, items."""
    windows = collections.defaultdict(set)
    for name, text in items:
        w = PLAIN.findall(lower(text or ""))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(name)
    out = []
    for text in texts:
        w, hit, names = PLAIN.findall(lower(text or "")), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        out.append((len(w), hit, {x for x in names if x is not None}))
    return out


def secrets(text):
    t = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def private(text):
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def archive(pages):
    """Per page (id, payload): bytes, digest, type, refers_to."""
    first = {}
    for page, payload in pages:
        data = (payload or "").encode()
        first[data] = min(page, first.get(data, page))
    out = []
    for page, payload in pages:
        data = (payload or "").encode()
        same = first[data] == page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else first[data]))
    return out


def ids_of(tokenizer, text, end=2):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def check_packing(rows, documents, length=4096):
    """rows: dicts of pieces; documents: {doc_id: ids}.  All ids once, no gaps, and padding in one sequence alone."""
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    assert by.keys() == documents.keys()
    for doc_id, ids in documents.items():
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert sorted(seq) == list(range(len(seq)))
    short = 0
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        short += at < length
    assert short <= 1
