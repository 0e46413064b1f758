"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def components(docs, n, num, den):
    """[(doc_id, n_shingles, component_id)]"""
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    of = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in of[g])
        for j, both in shared.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for g in s:
            of[g].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)]


def lines(docs, min_chars=40, min_docs=5):
    """[(doc_id, n_lines, n_dropped, text)]"""
    key = lambda x: x.strip(BLANK).translate(LOWER)
    rank = lambda d: -1 << 70 if d is None else d
    holders = defaultdict(list)
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(rank(d))
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(h := holders.get(key(x), [])) >= min_docs and rank(d) < max(h))]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def repeats(docs, window=13):
    """[(doc_id, n_words, n_removed, text)]"""
    rank = lambda d: -1 << 70 if d is None else d
    words = [WORD.findall(t or "") for _, t in docs]
    least = {}
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(rank(d), least.get(k, rank(d)))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < rank(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def private_text(r):
    """Words, numbers and valid values, each set apart by blanks or punctuation."""
    digits = lambda n: "".join(r.choices("0123456789", k=n))

    def card():
        body = "4" + digits(14)
        n = next(x for x in range(10) if _luhn(body + str(x)))
        d = body + str(n)
        return d if r.random() < 0.5 else " ".join(d[i : i + 4] for i in range(0, 16, 4))

    def iban():
        rest = digits(18)
        check = 98 - int(rest + "131400") % 97
        d = f"DE{check:02d}{rest}"
        return d if r.random() < 0.5 else " ".join(d[i : i + 4] for i in range(0, 22, 4))

    makers = [
        card,
        iban,
        lambda: f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}",
        lambda: f"{''.join(r.choices('abcdef', k=5))}.{digits(2)}@mail.example.org",
        lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}",
    ]
    plain = [lambda: "".join(r.choices("ghijkl", k=4)), lambda: digits(2), lambda: f"{digits(1)}.{digits(1)} litres", lambda: f"2021-13-{r.randrange(10, 29)}", lambda: "999.1.1.1"]
    parts = []
    for _ in range(r.randrange(1, 9)):
        parts.append(r.choice(makers)() if r.random() < 0.5 else r.choice(plain)())
        parts.append(r.choice([", ", "; ", " (", ") ", " and ", "\n"]))
    return "".join(parts)


def private_values(text):
    """[(kind, value)] in order: from the left, at each place the longest piece between word edges that is valid as some kind."""
    import datetime

    def kind(v):
        d = v.replace(" ", "")
        if re.fullmatch(r"\d{16}|\d{4}( \d{4}){3}", v) and _luhn(d):
            return "card"
        if re.fullmatch(r"[A-Z]{2}\d{2}( ?[A-Z0-9]){11,30}", v) and int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1:
            return "iban"
        if re.fullmatch(r"\d{4}-\d\d-\d\d", v):
            try:
                return datetime.date.fromisoformat(v) and "date"
            except ValueError:
                return None
        if re.fullmatch(r"[a-z]+\.\d+@[a-z.]+\.[a-z]+", v):
            return "email"
        if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", v) and all(int(x) < 256 for x in v.split(".")):
            return "ip"
        if re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", v):
            return "phone"
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", v) and v[4:6] != "00" and v[7:] != "0000" and v[:3] != "666":
            return "ssn"
        return None

    out, i = [], 0
    while i < len(text):
        if i and (text[i - 1].isalnum() or text[i - 1] in ".-+@"):
            i += 1
            continue
        ends = [j for j in range(min(len(text), i + 40), i, -1) if j == len(text) or not (text[j].isalnum() or text[j] in "-@" or text[j] == "." and j + 1 < len(text) and text[j + 1].isalnum())]
        hit = next(((k, text[i:j]) for j in ends if (k := kind(text[i:j]))), None)
        if hit:
            out.append(hit)
            i += len(hit[1])
        else:
            i += 1
    return out


def fused(rows, languages, alpha):
    """[(id, language, probability)] of rows (id, log likelihoods, declared, suffix, domain, host)."""
    import math

    names = [*languages, "und"]
    k = range(len(names))

    def soft(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    post = [soft(r[1]) for r in rows]

    def added(key):
        out = defaultdict(lambda: [0.0] * len(names))
        for r, p in zip(rows, post):
            out[key(r)] = [x + y for x, y in zip(out[key(r)], p)]
        return out

    everything = [sum(p[i] for p in post) + 1 for i in k]
    codes, suffixes, domains, hosts = (added(f) for f in (lambda r: r[2], lambda r: r[3], lambda r: (r[3], r[4]), lambda r: (r[3], r[4], r[5])))
    ended = [sum(v[i] for s, v in suffixes.items() if s) for i in k]
    known = [*languages, "other"]
    said = {c: [codes[c][i] + 0.5 + 5.0 * (j == i) for i in k] for j, c in enumerate(known)}
    out = []
    for r in rows:
        base = [x / sum(everything) for x in everything]
        for level in (domains[r[3], r[4]], hosts[r[3], r[4], r[5]]):
            base = [(level[i] + alpha * base[i]) / (sum(level) + alpha) for i in k]
        log = [r[1][i] + math.log(base[i]) for i in k]
        if r[2] != "none":
            log = [x + math.log(said[r[2]][i] / sum(said[c][i] for c in known)) for i, x in enumerate(log)]
        if r[3]:
            s = suffixes[r[3]]
            log = [x + math.log((s[i] + alpha * sum(s) / sum(ended)) / (ended[i] + alpha)) for i, x in enumerate(log)]
        p = soft(log)
        best = max(k, key=lambda i: p[i])
        out.append((r[0], names[best], p[best]))
    return out
