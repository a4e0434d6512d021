"""Small corpora with the odd cases in them, and plain versions of what the operators do."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def corpus(seed: int, n: int = 80) -> list[tuple[int, str | None]]:
    """Prose with exact and near copies, shared passages and lines, and odd texts."""
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ka", "lo", "é", "日本", "mu", "ß", "tri", "x#") for b in ("n", "ra", "Tes", "o", "vi", "l's", "12")]
    prose = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passages = [prose(rnd.randint(14, 120)) for _ in range(5)]
    lines = [prose(rnd.randint(3, 14)) for _ in range(6)]
    texts: list[str | None] = []
    for i in range(n):
        kind = i % 5
        if texts and kind == 0:
            texts.append(rnd.choice(texts))
        elif texts and kind == 1:
            words = (rnd.choice(texts) or "").split(" ")
            for _ in range(rnd.randint(1, 5)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(prose(rnd.randint(0, 60)) + " " + rnd.choice(passages) + "\n" + prose(rnd.randint(0, 60)) + rnd.choice(passages))
        elif kind == 3:
            near = rnd.choice(lines).split(" ")
            near[rnd.randrange(len(near))] = "other"
            texts.append("\n".join([prose(rnd.randint(40, 90)), rnd.choice(lines), " ".join(near), "", rnd.choice(lines)]))
        else:
            texts.append(prose(rnd.randint(1, 300)))
    odd = [None, "", " \t\n ", "one", "A B c", "a b c d", "A b C d", "a " * 700, "  ", "<|endoftext|> x", "é" * 900, "é" * 901, "don't  it's\r\nÉCOLE"]
    ids = rnd.sample(range(1, 9 * (n + len(odd))), n + len(odd))
    return list(zip(ids, texts + odd, strict=True))


def frame(spark, rows, more: bool = True):
    """documents with the given (doc_id, text); columns that clash with names used inside stand beside them."""
    extra = ("x", "y", "begin", "name", "key", "line", "size", "n_words", "component") if more else ()
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(i, t, "en", "hot", len(t) if t is not None else None, *("odd" for _ in extra)) for i, t in rows], schema).repartition(3)


def shingles(text: str | None, n: int) -> frozenset:
    words = WORD.findall((text or "").translate(_UPPER))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def near_groups(rows, n: int, p: int, q: int) -> dict:
    sets = {i: shingles(t, n) for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if q * common >= p * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeated_bytes(rows, length: int) -> dict:
    data = {i: (t or "").encode() for i, t in rows}
    count = Counter(d[k : k + length] for d in data.values() for k in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def earlier_passages(rows, length: int) -> dict:
    words = {i: WORD.findall(t or "") for i, t in rows}
    first: dict = {}
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def base_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(triples)
    again = {i + d for i, t in enumerate(triples) if count[t] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(lines)


def tail(k: int, n: int, p: float) -> float:
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def kept_by_quality(rows, good: set, ladders: dict, allowed: float, risk: float) -> dict:
    """base_failed and kept, for documents of a single stratum."""
    counts = {i: base_counts(t) for i, t in rows}
    per = lambda a, b: a / b if b else 0.0
    rates = {i: {"symbol_ratio": per(c[2], c[1]), "dup_line_ratio": per(c[3], c[5]), "repeat_ratio": per(c[4], c[0]), "long_words": per(c[1], c[0]), "short_words": -per(c[1], c[0])} for i, c in counts.items()}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, c in counts.items()}
    held = [rates[i] for i in counts if i in good and not failed[i]]
    cut = {}
    for rule, ladder in ladders.items():
        for step in ladder:
            if not held or tail(sum(r[rule] > step for r in held), len(held), allowed / len(ladders)) > risk / len(ladders):
                break
            cut[rule] = step
    return {i: (failed[i], not failed[i] and all(rates[i][r] <= c for r, c in cut.items())) for i in counts}


def _one_apart(a: list, b: list) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def deduplicated_lines(rows, least_words: int = 3, fuzzy_words: int = 8) -> dict:
    """doc_id to text and number of lines removed."""
    spots = sorted((i, k, line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")))
    gone = defaultdict(set)
    for at, (i, k, line) in enumerate(spots):
        words = line.split(" ")
        if not line or len(words) < least_words:
            continue
        for _, _, other in spots[:at]:
            own = other.split(" ")
            if other == line or (len(words) >= fuzzy_words and len(own) >= fuzzy_words and _one_apart(words, own)):
                gone[i].add(k)
                break
    return {i: (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in rows}


def tiled_tokens(doc: list, item: list, least: int) -> int:
    """Greedy string tiling by looking at every pair of places, round after round."""
    used_doc, used_item, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_doc and j + n not in used_item:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        used_doc.update(range(i, i + n))
        used_item.update(range(j, j + n))
        total += n


def coverage(text: str | None, item: str | None, seed: int = 5) -> tuple[float, int]:
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    doc, own = tokens(text), tokens(item)
    if not own:
        return 0.0, 0
    n = tiled_tokens(doc, own, min(seed, len(own)))
    return n / len(own), n


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def ids_sha(ids) -> str:
    return sha(b"".join(int(i).to_bytes(4, "little") for i in ids))
