"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
from xxhash import xxh64_intdigest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def tokenizer():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def without_common_lines(texts: dict[int, str | None]) -> dict[int, str]:
    """Whole texts without the lines in three documents or more, but for the largest id."""
    split = {i: (t or "").split("\n") for i, t in texts.items()}
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    held = defaultdict(set)
    for i, lines in split.items():
        for line in lines:
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return {i: "\n".join(x for x in lines if common.get(key(x), i) == i) for i, lines in split.items()}


def quality_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    found = words(text)
    windows = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    times = Counter(windows)
    repeated = {k + j for k, x in enumerate(windows) if times[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n = len(found)
    return n, sum(map(len, found)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(re.sub("[^0-9]", "", x)) <= 19 and luhn(re.sub("[^0-9]", "", x))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
}


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, order of the kind, kind, end), sorted."""
    return sorted((m.start(), k, kind, m.end()) for k, (kind, (pattern, valid)) in enumerate(PII.items()) for m in re.finditer(pattern, text or "") if valid(m.group()))


def fingerprint(text: str | None) -> int:
    found = words((text or "").translate(LOWER))
    if not found:
        return 0
    shingles = [" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], radius: int = 2) -> dict[int, int]:
    """The smallest id reachable, over all pairs."""
    ids = sorted(prints)
    value = np.array([prints[i] for i in ids], np.uint64)
    label = np.arange(len(ids))
    while True:
        new = np.array([label[np.bitwise_count(value ^ v) <= radius].min() for v in value])
        if (new == label).all():
            return {i: ids[k] for i, k in zip(ids, label, strict=True)}
        label = new


def without_repeats(texts: dict[int, str | None], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """(words, removed words, kept words) of each text."""
    seen, out = set(), {}
    for i in sorted(texts):
        found = words(texts[i])
        covered = set()
        for k in range(len(found) - window + 1):
            x = tuple(found[k : k + window])
            if x in seen:
                covered.update(range(k, k + window))
            seen.add(x)
        out[i] = len(found), len(covered), " ".join(w for k, w in enumerate(found) if k not in covered)
    return out


def manifest(rows: list[dict]) -> dict[int, tuple]:
    """By place in ``rows``: leaf, subroot, root, proof (an array of texts) and folded root of the document, tampered or not."""

    def leaf(row: dict, text: str | None) -> str:
        values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(nodes: list[str], place: int) -> tuple[str, list[tuple[list[str], int]]]:
        steps = []
        while len(nodes) > 1:
            run = nodes[place - place % 16 :][:16]
            steps.append((run[: place % 16] + run[place % 16 + 1 :], place % 16))
            nodes, place = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)], place // 16
        return nodes[0], steps

    trees = defaultdict(list)
    for k, row in enumerate(rows):
        trees[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row, row["text"]), k))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots = [climb([x[2] for x in sorted(trees[s])], 0)[0] for s in sources]
    out = {}
    for at, s in enumerate(sources):
        nodes = [x[2] for x in sorted(trees[s])]
        root, upper = climb(subroots, at)
        for place, x in enumerate(sorted(trees[s])):
            row, steps = rows[x[3]], climb(nodes, place)[1] + upper
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"] is not None
            node = leaf(row, row["text"].translate(LOWER)) if hit else x[2]
            for others, k in steps:
                node = sha("".join(others[:k]) + node + "".join(others[k:]))
            out[x[3]] = (x[2], subroots[at], root, ["".join(others) for others, _ in steps], node)
    return out


def spelling_variants(rows: list[dict]) -> dict[str, tuple]:
    """By word: form, root, n, n_near, form_n."""
    seen = Counter()
    for row in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if row['doc_id'] is None else row['doc_id']}:{run}".encode())
            at = h % len(run)
            seen[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    # every two words of equal or neighbouring lengths, a letter at a time from both ends
    near = defaultdict(set)
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)

    def ends(a: str, b: str) -> int:
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    for size, own in list(by_size.items()):
        for a in own:
            for b in by_size[size] + by_size[size + 1]:
                if a != b and ends(a, b) + ends(a[::-1], b[::-1]) >= size - (len(b) == size):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w: str) -> str:
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def contamination(texts: list[str | None], items: list[tuple[object, str | None]], window: int = 10) -> list[tuple[int, int, list[str]]]:
    """For each text: its words, those hit, and the items with occurring windows."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    asked = defaultdict(set)
    for name, text in items:
        found = split(text)
        for k in range(max(1, len(found) - window + 1) if found else 0):
            asked[tuple(found[k : k + window])].add("null" if name is None else str(name))
    out = []
    for text in texts:
        found, hit, names = split(text), set(), set()
        for size in {len(x) for x in asked}:
            for k in range(len(found) - size + 1):
                if (x := tuple(found[k : k + size])) in asked:
                    hit.update(range(k, k + size))
                    names |= asked[x]
        out.append((len(found), len(hit), sorted(names)))
    return out
