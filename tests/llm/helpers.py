"""Small documents with awkward cases, and plain versions of the operators to compare with."""

import hashlib
import re
import zlib

import public_tokenizers as P

ODD = ["", None, "a", "  two  spaces \n\n", "x" * 5000, "long " * 4000, "It's O'Neil’s ÀÉ ﬁ Σς İ", "<|endoftext|>", "你好 世界" * 40, "tab\tand\x1ccontrol\x85", "same text twice here it is", "same text twice here it is",
       "🎉 emoji 🎉", "1234567890" * 30, "\r\n \r\n end ", "a.b@c.de mail a@b.c_d@e.f"]


def documents(spark, texts=ODD, **extra):
    """doc_id from 0, one null id, one repeated row, and columns whose names operators use inside."""
    rows = [(k, t, "en", "src", 1, k % 3, "kept") for k, t in enumerate(texts)] + [(None, "no id at all", "en", "src", 1, 0, "kept"), (2, texts[2], "en", "src", 1, 2, "kept")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _k1 int, toxicity string")


def empty(df):
    return df.where("false")


def shingle_sets(rows):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_components(rows):
    """{position: smallest id reachable} over all pairs."""
    sets = shingle_sets(rows)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(sets[k][0])
    return [(sets[k][0], len(sets[k][1]), min((i for i in groups[find(k)] if i is not None), default=None)) for k in range(len(sets))]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def word_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def brute_context_pii(texts):
    """{position: sorted (kind, start, end, string)} found by context only, with plain loops over all patterns and instances."""
    identifier = r"(?<![A-Za-z0-9@._%+#/-])[A-Za-z._%+#/-]*+[0-9@][A-Za-z0-9@._%+#/-]*[A-Za-z0-9]"

    def form(w):
        return re.sub("[0-9]", "0", w.lower())

    def kinds(m):
        n = len(re.sub("[^0-9]", "", m))
        return [k for k, ok in (("email", "@" in m), ("ip", re.search(r"^[0-9]+(?:\.[0-9]+){3}$", m)), ("card", re.search("^[0-9-]+$", m) and 12 <= n <= 19), ("phone", re.search("^[0-9+.-]+$", m) and 7 <= n <= 15)) if ok]

    def matches(pattern, t):
        at = 0
        for m in re.finditer(pattern, t, re.A):
            tail = ((" " if at == 0 else "") + t[at:m.start()])[-64:]
            words = [re.search(rf"\s({w})\s*$", tail, re.A) for w in (r"\S+", r"\S+\s+\S+")]
            yield m.start(), m.end(), m[0], [re.sub(r"\s+", " ", form(w[1])) for w in words if w]
            at = m.end()

    occ, words = [], {}
    for i, t in enumerate(texts):
        t = t or ""
        base = {tuple(x.split(":")) for x in brute_pii(t)}
        spans = [(int(a), int(b)) for _, a, b in base]
        for k, pattern in PII.items():
            occ += [(i, k, a, b, m, left, 1) for a, b, m, left in matches(pattern, t) if (k, str(a), str(b)) in base]
        for a, b, m, left in matches(identifier, t):
            if not any(x < b and a < y for x, y in spans):
                occ += [(i, k, a, b, m, left, 0) for k in kinds(m)]
        if re.search("[0-9@]", t):
            w = form(t).split()
            for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]:
                words[x] = words.get(x, 0) + 1
    uses, score = {}, {}
    for _, k, _, _, m, left, seed in occ:
        for w in left:
            n = uses.setdefault((k, w), {})
            n[m] = n.get(m, 0) + 1
            score[k, w, m] = max(score.get((k, w, m), 0.0), float(seed))
    total = {p: max(words.get(p[1], 0), sum(n.values())) + 1 for p, n in uses.items()}
    sure = {}
    while True:
        conf = {p: round(sum(c * score[*p, m] for m, c in n.items()) / total[p], 9) for p, n in uses.items()}
        new = {p: conf[p] for p, n in uses.items() if conf[p] >= 0.5 and sum(score[*p, m] > 0 for m in n) >= 5}
        if len(new) == len(sure):
            break
        sure, miss = new, {}
        for (k, w), c in sure.items():
            for m in uses[k, w]:
                if score[k, w, m] < 1:
                    miss[k, m] = miss.get((k, m), 1.0) * (1 - c)
        for k, w, m in score:
            if (k, m) in miss:
                score[k, w, m] = max(score[k, w, m], 1 - miss[k, m])
    best = {}
    for i, k, a, b, m, left, seed in occ:
        for w in left:
            if not seed and (k, w) in sure:
                best[i, a, b] = min(best.get((i, a, b), (0.0, "", "")), (-sure[k, w], k, m))
    out = {}
    for (i, a, b), (_, k, m) in best.items():
        out.setdefault(i, []).append((k, a, b, m))
    return {i: sorted(x) for i, x in out.items()}
